"""Abusive, hateful or sexual content: a factorization machine over hashed terms of a sentence."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.fold import fold
from marlpit.functions.memo import Memo
from marlpit.session import spread

LABELLED = 12_000  # bound on the labelled documents a model is fitted on
WIDTH = 1 << 17  # hashed terms
RANK = 8
REVIEW = 0.85
_SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
_TOKEN = re.compile(r"[\w@$*]+(?:['’\-][\w@$*]+)*")
#: Digits and signs that stand for a letter in disguised words.
_DISGUISE = str.maketrans("013457@$!", "oieastasi")
_STRETCHED = re.compile(r"([^\W\d])\1{2,}")
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_]){2,}\w(?!\w)")


def terms(sentence: str) -> list[str]:
    """Terms of a sentence with its disguises undone: look-alikes, invisible signs, stretched and spelled-out words,
    digits for letters; a masked word (``p**n``) stands as its visible outline. Words, word pairs and word stems."""
    text = fold(sentence)
    text = _SPELLED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text)
    words = []
    for t in _TOKEN.findall(text):
        t = _STRETCHED.sub(r"\1", t) if not t.isdigit() else t
        if t.isdigit():
            t = "0"
        elif not t.isalpha():
            t = t.strip("*").translate(_DISGUISE) if "**" not in t else re.sub(r"\*+", "*", t)
        if t:
            words.append(t)
    out = [f"w:{t}" for t in words] + [f"b:{a} {b}" for a, b in zip(["^", *words], [*words, "$"])]
    out += [f"s:{t[:4]}{len(t) // 3}" for t in words if len(t) > 4] + [f"o:{t[0]}{len(t)}{t[-1]}" for t in words if "*" in t]
    return out


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCES.split(text or "") if any(c.isalnum() for c in s)]


class Model:
    """Second-order factorization machine: bias + linear weights + pairwise interactions of rank ``RANK``."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = -3.0, np.zeros(WIDTH, dtype=np.float32), rng.normal(0, 0.03, (WIDTH, RANK)).astype(np.float32)
        self.known, self.scored = Memo(400_000), Memo(500_000)

    def ids(self, sentence: str) -> np.ndarray:
        self.known.trim()
        out = []
        for t in terms(sentence):
            i = self.known.get(t)
            if i is None:
                i = self.known[t] = xxhash.xxh32_intdigest(t) % WIDTH
            out.append(i)
        return np.unique(np.array(out, dtype=np.int64))

    def raw(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of sentences given as consecutive runs of term ids (each term counts ``1 / sqrt(terms)``)."""
        n = np.diff(np.append(starts, len(flat)))
        scale = (1 / np.sqrt(n)).astype(np.float32)
        v = self.v[flat]
        s = np.add.reduceat(v, starts, axis=0)
        q = np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[flat], starts) * scale + 0.5 * ((s * s - q).sum(axis=1)) * scale**2

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.15, decay: float = 2e-5) -> None:
        """Adagrad on the weighted logistic loss, in mini-batches of a fixed order."""
        rng = np.random.default_rng(1)
        gw, gv, gb = np.full(WIDTH, 0.1, dtype=np.float32), np.full((WIDTH, RANK), 0.1, dtype=np.float32), 1.0
        sizes = np.array([len(r) for r in rows])
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                flat = np.concatenate([rows[i] for i in part])
                n = sizes[part]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                scale = np.repeat((1 / np.sqrt(n)).astype(np.float32), n)
                p = 1 / (1 + np.exp(-np.clip(self.raw(flat, starts), -30, 30)))
                err = (weight[part] * (p - y[part])).astype(np.float32)
                e = np.repeat(err, n)
                v = self.v[flat]
                s = np.repeat(np.add.reduceat(v, starts, axis=0), n, axis=0)
                by = np.argsort(flat, kind="stable")
                ids, first = np.unique(flat[by], return_index=True)
                dw = np.add.reduceat((e * scale)[by], first) + decay * self.w[ids]
                dv = np.add.reduceat(((e * scale**2)[:, None] * (s - v))[by], first, axis=0) + decay * self.v[ids]
                gw[ids] += dw**2
                gv[ids] += dv**2
                gb += float(err.sum()) ** 2
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                self.bias -= rate * float(err.sum()) / gb**0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text: the highest probability of its sentences, 0 for a text without words.

        Scores of sentences are remembered (a bounded table), so what many documents quote is scored once.
        """
        out = np.zeros(len(texts))
        self.scored.trim()
        parts = [sentences(t) for t in texts]
        fresh = list(dict.fromkeys(s for p in parts for s in p if s not in self.scored))
        rows = [(s, ids) for s in fresh if len(ids := self.ids(s))]
        for s in fresh:
            self.scored[s] = 0.0
        if rows:
            sizes = np.array([len(ids) for _, ids in rows])
            margin = self.raw(np.concatenate([ids for _, ids in rows]), np.cumsum(sizes) - sizes)
            self.scored.update(zip((s for s, _ in rows), (1 / (1 + np.exp(-np.clip(margin, -30, 30)))).tolist()))
        for i, p in enumerate(parts):
            out[i] = max(map(self.scored.__getitem__, p), default=0.0)
        return out


def train(texts: list[str], labels: list[float], rounds: int = 3) -> Model:
    """A model from labelled documents, some labels wrong: which sentence of a positive document is the reason is latent.

    Every sentence of a negative document is an example of 0. In each round the sentences of positive documents are
    weighted by how likely the last model holds each to be the reason; a document without any likely sentence is
    treated as wrongly labelled and fades out, and so do sentences of negative documents that the model is sure of.
    Sentences that are common among negative documents thus cannot become reasons.
    """
    rows, doc, y = [], [], []
    model = Model()
    for i, (t, l) in enumerate(zip(texts, labels)):
        for s in sentences(t):
            ids = model.ids(s)
            if len(ids):
                rows.append(ids)
                doc.append(i)
                y.append(l)
    if not rows or not any(v >= 0.5 for v in labels):
        model.bias = -6.0
        return model
    doc, y = np.array(doc), np.array(y)
    positive = y >= 0.5
    flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    count = np.bincount(doc)[doc]
    # start: how much rarer a sentence's rarest words are among negative documents than among positive ones
    pos_n, neg_n = max(1, sum(v >= 0.5 for v in labels)), max(1, sum(v < 0.5 for v in labels))
    df = np.zeros((2, WIDTH))
    for side in (0, 1):
        pick = positive == bool(side)
        if pick.any():
            term = np.concatenate([rows[i] for i in np.flatnonzero(pick)])
            who = np.repeat(doc[pick], [len(rows[i]) for i in np.flatnonzero(pick)])
            np.add.at(df[side], np.unique(np.stack([term, who]), axis=1)[0], 1)
    odds = np.log((df[1] + 0.5) / (pos_n + 1)) - np.log((df[0] + 0.5) / (neg_n + 1))
    lead = np.add.reduceat(odds[flat], starts) / np.sqrt(np.diff(np.append(starts, len(flat))))
    for n in range(rounds):
        best = np.full(doc.max() + 1, -np.inf)
        np.maximum.at(best, doc, lead)
        target = np.where(positive, (lead >= best[doc] - 1e-9) | (lead > np.log(3.0) if n else False), 0.0).astype(float)
        weight = np.where(positive, np.where(target > 0, 4.0, 0.5), 1.0)
        if n:
            p = 1 / (1 + np.exp(-lead))
            weight = np.where(positive & (target > 0), 4.0 * np.clip(p * 2, 0.05, 1), weight)
            weight = np.where(~positive & (p > 0.9), 0.1, weight)
        model = Model()
        model.fit(rows, target, weight / np.maximum(1, np.where(positive, 1, count / 8)))
        lead = model.raw(flat, starts)
    return model


def fit_abuse(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "abusive", limit: int = LABELLED) -> Model:
    """The model, fitted on the driver on at most ``limit`` labelled documents (those with the smallest hashed ids).

    Several labels of a document are averaged; null labels, documents without text and labels without document are left
    out; without any positive label every score is near 0.
    """
    votes = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).dropna().groupBy("k").agg(F.avg("y").alias("y"))
    rows = votes.join(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k").filter("t is not null").orderBy(F.xxhash64("k"), "k").limit(limit).toPandas()
    return train(rows["t"].tolist(), rows["y"].tolist())


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, score) of every document; null, empty and wordless texts score 0. The model has a fixed size."""
    model.known, model.scored = Memo(400_000), Memo(500_000)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [shared.value.score(b["t"].iloc[i : i + 1000].tolist()) for i in range(0, len(b), 1000)]
            yield pd.DataFrame({"doc_id": b["k"], "source": b["s"], "score": np.concatenate(parts) if parts else []})

    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")), "k")
    return rows.mapInPandas(run, f"doc_id {kind}, source string, score double")


def abuse_rates(scored: DataFrame, review: float = REVIEW) -> DataFrame:
    """(source, n_docs, n_review, review_rate)."""
    bad = F.count_if(F.col("score") >= review)
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), bad.alias("n_review"), F.round(bad / F.count("*"), 6).alias("review_rate"))
