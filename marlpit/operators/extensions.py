"""Places where a caller's own Python joins a plan: fact extractors, renderers, scorers, token counters. All get Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.text import evidence_span, verified_evidence

Extractor = Callable[[list[str]], list[tuple[str, str] | None]]
Renderer = Callable[[list[str]], list[str]]
Scorer = Callable[[list[str], list[list[str]]], list[list[float]]]


def with_facts(df: DataFrame, text: str, extractor: Extractor, out: str = "fact") -> DataFrame:
    """``df`` with ``out``: the extractor's (fact, evidence, own) for each text, taken only when its evidence stands in the text.

    Otherwise, and for texts that the extractor gives up, the rule speaks: the first fair sentence as its own evidence. An
    extractor takes a list of texts and may be slow; equal texts of a batch are asked once.
    """
    kind = df.select(text).schema[0].dataType.simpleString()

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = list(dict.fromkeys(t for t in b["_t"] if t))
            got = dict(zip(known, extractor(known))) if known else {}
            said = [got.get(t) or (None, None) for t in b["_t"]]
            yield pd.DataFrame({"_t": b["_t"], "_f": [f for f, _ in said], "_e": [e for _, e in said]})

    asked = df.select(F.col(text).alias("_t")).distinct().mapInPandas(ask, f"_t {kind}, _f string, _e string")
    proof = verified_evidence("_t", "_e")
    own = proof.isNotNull() & (F.coalesce(F.trim("_f"), F.lit("")) != "")
    fact = F.struct(F.when(own, F.trim("_f")).alias("fact"), F.when(own, proof).otherwise(evidence_span("_t")).alias("evidence"), own.alias("own"))
    return df.join(asked.select("_t", fact.alias(out)), F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def rendered(df: DataFrame, draft: str, renderer: Renderer, out: str = "state") -> DataFrame:
    """``df`` with ``out``: each draft as the renderer words it; a null draft stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            have = b[draft].notna()
            text = pd.Series([None] * len(b), index=b.index, dtype=object)
            text[have] = renderer(b.loc[have, draft].tolist())
            yield b.assign(**{out: text})

    return df.mapInPandas(run, schema)


def predicted(questions: DataFrame, prompt: str, scorer: Scorer, predictor: str, template: str = "direct") -> DataFrame:
    """Predictions (record_id, qid, predictor, template, options, logits) of a scorer that gets prompts and option keys.

    A scorer that returns a wrong number of logits, or one that is not finite, fails the row's task with the question's id.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [list(k) for k in b["keys"]]
            logits = [[float(z) for z in row] for row in scorer(b["p"].tolist(), keys)]
            for r, q, k, z in zip(b["record_id"], b["qid"], keys, logits):
                if len(z) != len(k) or any(v != v or v in (float("inf"), float("-inf")) for v in z):
                    raise ValueError(f"{r} {q}: logits must be finite, one per option")
            yield pd.DataFrame({"record_id": b["record_id"], "qid": b["qid"], "predictor": predictor, "template": template, "options": keys, "logits": logits})

    rows = questions.select("record_id", "qid", F.col(prompt).alias("p"), "keys")
    return rows.mapInPandas(run, "record_id string, qid string, predictor string, template string, options array<string>, logits array<double>")


def counted_tokens(df: DataFrame, text: str, encode: Callable[[str], list[int]], out: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of a text by the caller's tokenizer; null for a null text."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int32")

    return df.withColumn(out, count(F.col(text)))


def without_long(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Rows within a token limit; a row of unknown length is kept."""
    return df.filter(F.col(tokens).isNull() | (F.col(tokens) <= most))
