"""Paired tests and n-gram decontamination that SQL alone does not express."""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections.abc import Iterable, Iterator
from math import lgamma, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.session import cut


def mcnemar_p(gained: int, lost: int) -> float:
    """Exact two-sided McNemar test: the binomial tail of the discordant pairs, in log space. 1 without any."""
    n, k = gained + lost, min(gained, lost)
    if n == 0:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(t - top) for t in terms))


def mcnemar(pairs: DataFrame, base: str, cand: str) -> DataFrame:
    """(gained, lost, p) of boolean columns; rows with a null on either side are left out."""
    counts = pairs.agg(F.count_if(F.col(cand) & ~F.col(base)).alias("gained"), F.count_if(F.col(base) & ~F.col(cand)).alias("lost"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[mcnemar_p(int(g), int(x)) for g, x in zip(b["gained"], b["lost"])])

    return counts.mapInPandas(run, "gained bigint, lost bigint, p double")


def bootstrap_deltas(clusters: DataFrame, draws: int = 10_000, seed: int = 20260930, block: int = 500) -> DataFrame:
    """(draw, family, delta): resampled differences cand - base of each family's rate and, with family ``*``, of their mean.

    ``clusters`` has (state_id, family, n, base, cand), one row per state and family. Whole states are resampled: each has a
    Poisson(1) weight per draw from a generator seeded by ``seed`` and the state, so results depend on neither partitioning
    nor order. Every task reduces its states to sums per draw before anything is shuffled: what moves is ``draws`` numbers
    a task and family, and no task holds more than its share of the states. A family absent from a draw is null there and
    does not count in the mean. No states give no rows.
    """

    def resample(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            rows = b.groupby("family", sort=False).indices
            weight = {}
            for s in b["state_id"].unique():
                weight[s] = np.random.default_rng([seed, xxhash.xxh32_intdigest(str(s))]).poisson(1.0, draws)
            for f, at in rows.items():
                part = b.iloc[at]
                w = np.stack([weight[s] for s in part["state_id"]])
                sums[f] = sums.get(f, 0.0) + np.stack([part[c].to_numpy(dtype=float) @ w for c in ("n", "base", "cand")])
        for f, x in sums.items():
            for k in range(0, draws, block):
                yield pd.DataFrame({"block": [k], "family": [f], "n": [x[0, k : k + block]], "base": [x[1, k : k + block]], "cand": [x[2, k : k + block]]})

    def rates(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(g["family"].unique())
        total = {f: [np.sum(np.stack(x[c].to_list()), axis=0) for c in ("n", "base", "cand")] for f, x in g.groupby("family")}
        with np.errstate(invalid="ignore", divide="ignore"):
            delta = np.stack([np.where(total[f][0] > 0, (total[f][2] - total[f][1]) / total[f][0], np.nan) for f in names])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # a draw without any family
            delta = np.concatenate([delta, np.nanmean(delta, axis=0, keepdims=True)])
        draw = int(g["block"].iloc[0]) + np.arange(delta.shape[1])
        return pd.DataFrame({"draw": np.tile(draw, len(delta)), "family": np.repeat([*names, "*"], delta.shape[1]), "delta": [None if v != v else float(v) for v in delta.ravel()]})

    parts = clusters.select(F.col("state_id").cast("string").alias("state_id"), F.col("family").cast("string").alias("family"), "n", "base", "cand")
    sums = parts.mapInPandas(resample, "block int, family string, n array<double>, base array<double>, cand array<double>")
    return sums.groupBy("block").applyInPandas(rates, "draw int, family string, delta double")


def clusters_of(base: DataFrame, cand: DataFrame, value: str = "correct") -> DataFrame:
    """(state_id, family, n, base, cand): sums of a boolean over the questions of a state and family that both predictors scored."""
    a = base.select("record_id", "qid", "state_id", "family", F.col(value).cast("int").alias("base"))
    b = cand.select("record_id", "qid", F.col(value).cast("int").alias("cand"))
    both = a.join(b, ["record_id", "qid"]).filter("base is not null and cand is not null")
    return both.groupBy("state_id", "family").agg(F.count("*").alias("n"), F.sum("base").alias("base"), F.sum("cand").alias("cand"))


def paired_bootstrap(clusters: DataFrame, draws: int = 10_000, seed: int = 20260930) -> DataFrame:
    """(family, delta, low, high, p): observed difference, its 95 % percentile interval and the one-sided p of no gain.

    Family ``*`` is the mean over families. p = (1 + draws at or below 0) / (draws + 1).
    """
    rate = F.try_divide(F.sum("cand") - F.sum("base"), F.nullif(F.sum("n"), F.lit(0)))
    seen = clusters.groupBy(F.col("family").cast("string").alias("family")).agg(rate.alias("delta"))
    seen = seen.unionByName(seen.agg(F.avg("delta").alias("delta")).withColumn("family", F.lit("*")))
    each = bootstrap_deltas(clusters, draws, seed).groupBy("family").agg(
        F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"),
        ((1 + F.count_if(F.col("delta") <= 0)) / (F.count("delta") + 1)).alias("p"),
    )
    return seen.join(each, "family").select("family", "delta", "low", "high", "p")


def noise_floor(clusters: DataFrame, draws: int = 2_000, seed: int = 20260930) -> DataFrame:
    """(family, n, accuracy, half_width, binomial_half_width, paired_half_width) of one predictor: its ``cand`` sums.

    The paired width is that of two predictors with independent errors. Family ``*`` is the mean over families.
    """
    alone = clusters.withColumn("base", F.lit(0))
    boot = paired_bootstrap(alone, draws, seed).select("family", F.col("delta").alias("accuracy"), ((F.col("high") - F.col("low")) / 2).alias("half_width"))
    sizes = clusters.groupBy(F.col("family").cast("string").alias("family")).agg(F.sum("n").alias("n"))
    sizes = sizes.unionByName(sizes.agg(F.sum("n").alias("n")).withColumn("family", F.lit("*")))
    out = boot.join(sizes, "family").withColumn("b", 1.959964 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")))
    mean = out.filter("family <> '*'").agg((F.sqrt(F.sum(F.col("b") * F.col("b"))) / F.count("*")).alias("m"))
    both = out.crossJoin(F.broadcast(mean))  # one row
    return both.select("family", "n", "accuracy", "half_width", F.when(F.col("family") == "*", F.col("m")).otherwise(F.col("b")).alias("binomial_half_width"), (F.sqrt(F.lit(2.0)) * F.col("half_width")).alias("paired_half_width"))


def gate(boot: DataFrame, safety_boot: DataFrame | None = None, guard_delta: float | None = None, min_delta: float = 0.05, drop: float = 0.05, max_p: float | None = None, slack: float = 1e-12) -> DataFrame:
    """(check, passed): conditions under which a candidate replaces the base, from :func:`paired_bootstrap` rows.

    The mean gains at least ``min_delta`` and its interval lies above 0; no family's interval lies below 0 and none loses more
    than ``drop``; no rate of missed risky cases rises significantly; the guard set does not fall; with ``max_p`` the p of the
    gain lies below it. A family without an interval passes; without a guard the guard check fails.
    """
    star, fam = F.col("family") == "*", F.col("family") != "*"
    none_bad = lambda cond: F.coalesce(F.bool_and(F.when(fam, ~cond)), F.lit(True))
    checks = [
        F.coalesce(F.max(F.when(star, F.col("delta") >= min_delta - slack)), F.lit(False)).alias("gain"),
        F.coalesce(F.max(F.when(star, F.col("low") > 0)), F.lit(False)).alias("interval_above_zero"),
        none_bad((F.coalesce(F.col("high"), F.lit(0.0)) < -slack) | (F.coalesce(F.col("delta"), F.lit(0.0)) < -drop - slack)).alias("no_family_falls"),
        F.lit(guard_delta is not None and guard_delta >= -slack).alias("guard"),
    ]
    if max_p is not None:
        checks.append(F.coalesce(F.max(F.when(star, F.col("p") < max_p)), F.lit(False)).alias("p"))
    wide = boot.agg(*checks)
    out = wide.unpivot([], wide.columns, "check", "passed")
    if safety_boot is not None:
        rises = safety_boot.agg(none_bad(F.coalesce(F.col("low"), F.lit(0.0)) > slack).alias("passed")).select(F.lit("safety").alias("check"), "passed")
        out = out.unionByName(rises)
    return out.unionByName(out.agg(F.bool_and("passed").alias("passed")).select(F.lit("all").alias("check"), "passed"))


def ladder(steps: list[DataFrame], top: DataFrame, ceiling: float = 0.95) -> DataFrame:
    """(check, passed): successive predictors must not fall significantly, the best stays below ``ceiling``.

    ``steps`` are :func:`paired_bootstrap` rows of each stronger predictor against the one before; ``top`` has ``accuracy``.
    """
    out = top.agg((F.max("accuracy") < ceiling).alias("passed")).select(F.lit("headroom").alias("check"), "passed")
    for i, s in enumerate(steps):
        out = out.unionByName(s.agg(F.bool_and(F.coalesce(F.col("high") >= 0, F.lit(True))).alias("passed")).select(F.lit(f"step_{i + 1}").alias("check"), "passed"))
    return out


def match_kinds(source: DataFrame, target: DataFrame, key: str, text: str, n: int = 8, share: float = 0.8) -> DataFrame:
    """(source_id, kind): the strongest match of each source text with any target text: exact before normalized before n-gram.

    Normalized: NFKC and lower case, all but letters and digits squeezed to one blank. N-gram: word n-grams (the whole text
    when shorter) of which ``share`` of either side is shared. Of a pair that shares so many, the rarest
    ``size - ceil(share * size) + 1`` n-grams of the smaller side must hold one of the other, so only those are looked up,
    from both sides; candidates are counted exactly on their n-gram arrays. An n-gram that stands everywhere is thus looked
    up only by texts that have nothing rarer. Each distinct text is matched once. Null and blank texts match nothing.
    """

    def normal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(norm=[" ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", x).lower()).split()) for x in b["raw"]])

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.col(text).alias("raw")).filter("id is not null and raw is not null")
        return rows.mapInPandas(normal, f"id {rows.schema['id'].dataType.simpleString()}, raw string, norm string").filter("norm <> ''").withColumn("side", F.lit(name))

    def grams(df: DataFrame) -> DataFrame:
        w = df.select("norm").distinct().select(F.xxhash64("norm").alias("t"), F.split("norm", " ").alias("w"))
        g = F.when(F.size("w") < n, F.array(F.xxhash64("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n))))
        return w.select("t", F.array_distinct(g).alias("g"))

    a, b = cut(side(source, "a"), "match"), cut(side(target, "b"), "match")
    exact = a.join(b.select("raw").distinct(), "raw", "left_semi").select("id", F.lit(1).alias("rank"))
    same = a.join(b.select("norm").distinct(), "norm", "left_semi").select("id", F.lit(2).alias("rank"))
    ga, gb = cut(grams(a), "match"), cut(grams(b), "match")
    each = ga.select("t", F.size("g").alias("m"), F.explode("g").alias("x"), F.lit("a").alias("side")).unionByName(gb.select("t", F.size("g").alias("m"), F.explode("g").alias("x"), F.lit("b").alias("side")))
    often = each.groupBy("x").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")).filter("na > 0 and nb > 0")
    other = F.when(F.col("side") == "a", F.col("nb")).otherwise(F.col("na"))
    kept = each.join(often, "x").withColumn("df", other)
    # n-grams the other side lacks cost nothing to ask for, so they are the rarest and come first in the prefix
    lacking = kept.groupBy("side", "t").agg(F.first("m").alias("m"), F.count("*").alias("have")).select("side", "t", (F.col("m") - F.ceil(share * F.col("m")) + 1 - (F.col("m") - F.col("have"))).alias("ask"))
    line = Window.partitionBy("side", "t").orderBy("df", "x")
    ranked = kept.join(lacking.filter("ask > 0"), ["side", "t"]).withColumn("r", F.row_number().over(line)).filter("r <= ask")
    asked_a, asked_b = (ranked.filter(F.col("side") == s).select("x", F.col("t").alias(f"t{s}")) for s in "ab")
    all_a, all_b = (kept.filter(F.col("side") == s).select("x", F.col("t").alias(f"t{s}")) for s in "ab")
    pairs = asked_a.join(all_b, "x").select("ta", "tb").unionByName(all_a.join(asked_b, "x").select("ta", "tb")).distinct()
    both = pairs.join(ga.select(F.col("t").alias("ta"), F.col("g").alias("g1")), "ta").join(gb.select(F.col("t").alias("tb"), F.col("g").alias("g2")), "tb")
    close = both.filter(F.size(F.array_intersect("g1", "g2")) >= share * F.least(F.size("g1"), F.size("g2"))).select(F.col("ta").alias("t")).distinct()
    near = a.withColumn("t", F.xxhash64("norm")).join(close, "t", "left_semi").select("id", F.lit(3).alias("rank"))
    best = exact.unionByName(same).unionByName(near).groupBy("id").agg(F.min("rank").alias("rank"))
    return best.select(F.col("id").alias("source_id"), F.element_at(F.array(F.lit("exact"), F.lit("normalized"), F.lit("ngram")), F.col("rank")).alias("kind"))


def match_counts(kinds: dict[str, DataFrame]) -> DataFrame:
    """(target, kind, n) of :func:`match_kinds` results by the name of their target."""
    out = None
    for name, k in kinds.items():
        one = k.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "kind", "n")
        out = one if out is None else out.unionByName(one)
    return out
