"""Scored questions of decision records: loading, targets, alignment of predictions, metrics, calibration.

Records hold an array of questions; predictions hold one row per question with the option keys in order and one logit per
option. Every operator is DataFrame to DataFrame, and options stay arrays, so a question is one row from scan to metric.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.ids import hash_unit
from marlpit.functions.text import first_argmax, softmax, tied, total, uniform_logits

#: The log grid of temperatures, the error budget, the bins of the calibration error, the floor of a probability.
GRID = tuple(math.exp(math.log(0.05) + i * (math.log(50.0) - math.log(0.05)) / 480) for i in range(481))
BUDGET, BINS, FLOOR = 0.05, 15, 1e-12
#: The label at risk of each safety family of the test tables.
AT_RISK = {"approve_ok": "yes", "share_ok": "no", "route_ok": "yes"}


# ---- records to questions


def option_keys(kind: Column, criteria: Column) -> Column:
    """Names of the options in order: level numbers where a score names none, false and true where a yes-or-no does."""
    named = F.transform(criteria, lambda c, i: F.when(kind == "score", F.coalesce(c["key"], i.cast("string"))).otherwise(c["key"]))
    return F.when((kind == "noul") & (F.coalesce(F.size(criteria), F.lit(0)) < 1), F.array(F.lit("false"), F.lit("true"))).otherwise(named)


def soft_target(keys: Column, soft: Column) -> Column:
    """Shares of the options in key order; null when a key is unknown, a share is negative or nothing has mass."""
    named = F.map_from_entries(F.array_distinct(soft))
    values = F.transform(keys, lambda k: F.coalesce(F.try_element_at(named, k), F.lit(0.0)))
    wrong = F.exists(soft, lambda s: ~F.array_contains(keys, s["key"]) | (s["p"] < 0)) | (total(values) <= 0)
    return F.when(~wrong, F.transform(values, lambda v: v / total(values)))


def questions(records: DataFrame) -> DataFrame:
    """(record_id, qid, pos, state_id, family, kind, keys, label, target, ambiguous, copies) of every question of (id, state_id, families, questions).

    The family is the record's own entry for the question, else the question's source without its prefix. A soft label
    that ties within 1e-9 is ambiguous: it counts for target metrics only. ``label`` is the option index, null when the
    label is not one of the options; ``copies`` counts rows of one (record, question), of which the first is kept.

    Defined results: null questions give no rows; a null id leaves the record out; a question without options has a null label.
    """
    q = records.filter("id is not null").select("id", "state_id", "families", F.posexplode("questions").alias("pos", "q"))
    keys = option_keys(F.col("q.type"), F.col("q.criteria"))
    hard = F.when(F.col("q.type") == "score", F.col("q.label_idx")).otherwise(F.nullif(F.array_position(keys, F.col("q.label_key")), F.lit(0)) - 1)
    q = q.select(
        F.col("id").alias("record_id"), F.col("q.qid").alias("qid"), "pos", F.coalesce("state_id", "id").alias("state_id"),
        F.coalesce(F.try_element_at("families", F.col("q.qid")), F.regexp_replace("q.src", "^[a-z]+/", "")).alias("family"),
        F.col("q.type").alias("kind"), keys.alias("keys"), hard.cast("int").alias("hard"), F.col("q.soft_label").alias("soft"),
    )
    one_hot = F.transform(F.col("keys"), lambda k, i: F.when(i == F.col("hard"), 1.0).otherwise(0.0))
    q = q.withColumn("target", F.when(F.col("soft").isNotNull(), soft_target(F.col("keys"), F.col("soft"))).when(F.col("hard").between(0, F.size("keys") - 1), one_hot))
    q = q.withColumn("label", first_argmax("target")).withColumn("ambiguous", F.col("soft").isNotNull() & tied("target"))
    same = Window.partitionBy("record_id", "qid")
    q = q.withColumn("copies", F.count("*").over(same)).withColumn("_r", F.row_number().over(same.orderBy("pos", "label")))
    return q.filter("_r = 1").drop("_r", "hard", "soft")


def question_violations(q: DataFrame) -> DataFrame:
    """(check, n) of what a strict reader refuses: labels outside the options, questions twice, no family, no options."""
    checks = {
        "bad_label": F.col("label").isNull(), "twice": F.col("copies") > 1, "no_family": F.col("family").isNull(), "no_options": F.coalesce(F.size("keys"), F.lit(0)) < 1,
    }
    wide = q.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return wide.unpivot([], list(checks), "check", "n")


def stand_in_predictions(q: DataFrame, name: str, boost: float = 1.5, scale: float = 3.0) -> DataFrame:
    """Predictions of a made-up predictor: hashed logits with ``boost`` at the label. For tests and the bench, which have no model."""
    unit = lambda i: hash_unit(F.lit(name), F.col("record_id"), F.col("qid"), i.cast("string"))
    logits = F.transform("keys", lambda k, i: scale * unit(i) + F.when(i == F.col("label"), boost).otherwise(0.0))
    return q.select("record_id", "qid", F.lit(name).alias("predictor"), F.lit("direct").alias("template"), F.col("keys").alias("options"), logits.alias("logits"))


# ---- predictions


def alignment(q: DataFrame, p: DataFrame) -> DataFrame:
    """One row of counts: missing, extra and repeated predictions, option lists that differ, logits that are not finite or too few, and how many predictors and templates the file mixes."""
    mine = q.select("record_id", "qid", "keys")
    theirs = p.groupBy("record_id", "qid").agg(F.count("*").alias("n"), F.first("options").alias("options"), F.first("logits").alias("logits"))
    finite = F.forall("logits", lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))) & (F.size("logits") == F.size("keys"))
    both = mine.join(theirs, ["record_id", "qid"], "full_outer")
    known = F.col("keys").isNotNull() & F.col("n").isNotNull()
    counts = both.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("keys").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(known & (F.col("options") != F.col("keys"))).alias("other_options"), F.count_if(known & ~finite).alias("bad_logits"),
    )
    return counts.crossJoin(p.agg(F.count_distinct("predictor", "template").alias("identities")))  # one row by one row


def scored(q: DataFrame, p: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The questions with (probs, conf, pred, correct, brier, nll, expected) of a predictor.

    ``correct`` is null where the question is ambiguous; ``expected`` is the target's share of the predicted option. Ties of
    the largest probability go to the first option. A question whose option list differs from its prediction's has no row.
    """
    both = q.join(p.select("record_id", "qid", "options", "logits"), ["record_id", "qid"]).filter(F.col("options") == F.col("keys"))
    both = both.withColumn("probs", softmax("logits", temperature))
    sq = F.aggregate(F.zip_with("probs", "target", lambda a, t: F.pow(a - t, 2)), F.lit(0.0), lambda a, x: a + x)
    ce = F.aggregate(F.zip_with("probs", "target", lambda a, t: t * F.log(F.greatest(a, F.lit(FLOOR)))), F.lit(0.0), lambda a, x: a - x)
    pred = first_argmax("logits")
    return both.select(
        "record_id", "qid", "state_id", "family", "kind", "keys", "label", "target", "ambiguous", "logits", "probs", F.array_max("probs").alias("conf"), pred.alias("pred"),
        F.when(~F.col("ambiguous"), pred == F.col("label")).alias("correct"), sq.alias("brier"), ce.alias("nll"), F.get("target", pred).alias("expected"),
    )


# ---- selective prediction: the curve is built from counts per confidence, not from one sorted table


def risk_curve(s: DataFrame, by: list[str], places: int = 9) -> DataFrame:
    """(by, conf, accepted, errors): for each confidence that occurs, how many questions at or above it, and errors among them.

    Questions are first counted per confidence. Running sums go within 1,024 ranges of confidence and over the totals of
    the ranges, so no task ever holds more than one range of one group.
    """
    per = s.filter("not ambiguous").groupBy(*by, F.round("conf", places).alias("conf")).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("wrong"))
    per = per.withColumn("_cell", F.floor(F.col("conf") * 1024).cast("int"))
    cells = per.groupBy(*by, "_cell").agg(F.sum("n").alias("_n"), F.sum("wrong").alias("_w"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most 1,025 rows
    cells = cells.select(*by, "_cell", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(above), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy(*by, "_cell").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    return per.join(cells, [*by, "_cell"]).select(
        *by, "conf", (F.col("_n0") + F.sum("n").over(inside)).alias("accepted"), (F.col("_w0") + F.sum("wrong").over(inside)).alias("errors")
    )


def select_threshold(s: DataFrame, by: list[str] = [], budget: float = BUDGET, least: int = 1) -> DataFrame:  # noqa: B006
    """(by, threshold, accepted, errors, n): the largest set of most confident questions whose errors stay within the budget; threshold null: none."""
    curve = risk_curve(s, by)
    ok = (F.col("errors") <= budget * F.col("accepted")) & (F.col("accepted") >= least)
    return curve.groupBy(*by).agg(
        F.min(F.when(ok, F.col("conf"))).alias("threshold"), F.coalesce(F.max(F.when(ok, F.col("accepted"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.max_by(F.when(ok, F.col("errors")), F.when(ok, F.col("accepted"))), F.lit(0)).alias("errors"), F.max("accepted").alias("n"),
    )


def _metrics(threshold: float | None) -> list[Column]:
    sure = F.lit(False) if threshold is None else (F.col("conf") >= threshold) & ~F.col("ambiguous")
    accepted, errors = F.count_if(sure), F.count_if(sure & ~F.col("correct"))
    return [
        F.count("*").alias("n"), F.count_if(~F.col("ambiguous")).alias("n_scored"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("brier").alias("brier"), F.avg("nll").alias("nll"), accepted.alias("accepted"), errors.alias("errors"),
        F.try_divide(accepted, F.nullif(F.count_if(~F.col("ambiguous")), F.lit(0))).alias("coverage"), F.try_divide(errors, F.nullif(accepted, F.lit(0))).alias("realized_error"),
    ]


def calibration_error(s: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """(by, ece): mean gap of confidence and target share over equal bins of confidence, the last one closed."""
    binned = s.groupBy(*by, F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count("*").alias("_n"), F.avg("expected").alias("_e"), F.avg("conf").alias("_c"))
    return binned.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_e") - F.col("_c"))) / F.sum("_n")).alias("ece"))


def report(s: DataFrame, threshold: float | None, by: str = "family") -> DataFrame:
    """One row per family, one ``micro`` row over all questions and one ``macro`` row, the mean of the families' values.

    Means skip families whose value is null; the realized error is null where nothing was accepted.
    """
    names = ["accuracy", "brier", "nll", "ece", "coverage", "realized_error", "coverage_in_sample"]
    counts = ["n", "n_scored", "accepted", "errors"]

    def level(x: DataFrame, keys: list[str]) -> DataFrame:
        best = select_threshold(x, keys).withColumn("coverage_in_sample", F.col("accepted") / F.col("n")).select(*keys, "coverage_in_sample")
        return x.groupBy(*keys).agg(*_metrics(threshold)).join(calibration_error(x, keys), keys, "left").join(best, keys, "left")

    families = level(s.withColumn("scope", F.lit("family")), ["scope", by])
    micro = level(s.withColumn("scope", F.lit("micro")).withColumn(by, F.lit("all")), ["scope", by])
    macro = families.agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in names]).select(F.lit("macro").alias("scope"), F.lit("all").alias(by), *counts, *names)
    return families.select("scope", by, *counts, *names).unionByName(micro.select("scope", by, *counts, *names)).unionByName(macro)


def safety(s: DataFrame, at_risk: dict[str, str] = AT_RISK) -> DataFrame:
    """(family, n_at_risk, missed, fn_rate): questions whose label is the value at risk, and how often the other one was predicted."""
    label = F.get("keys", F.col("label"))
    risky = F.coalesce(*[F.when(F.col("family") == f, label == v) for f, v in at_risk.items()], F.lit(False))
    known = s.filter(F.col("family").isin(*at_risk)).withColumn("_risk", risky & ~F.col("ambiguous"))
    missed = F.count_if(F.col("_risk") & (F.col("pred") != F.col("label")))
    return known.groupBy("family").agg(F.count_if("_risk").alias("n_at_risk"), missed.alias("missed"), F.try_divide(missed, F.nullif(F.count_if("_risk"), F.lit(0))).alias("fn_rate"))


# ---- calibration


def temperature_losses(q: DataFrame, p: DataFrame) -> DataFrame:
    """(i, temperature, nll): mean cross-entropy at each of the 481 temperatures.

    Batches are reduced to 481 partial sums each before anything is shuffled, so the corpus of questions is read once and
    what moves is 481 numbers a task.
    """
    grid = np.array(GRID)

    def losses(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total_loss, n = np.zeros(len(grid)), 0
        for b in batches:
            width = max((len(z) for z in b["logits"]), default=0)
            if not width:
                continue
            z, t = np.full((len(b), width), -np.inf), np.zeros((len(b), width))
            for i, (x, y) in enumerate(zip(b["logits"], b["target"])):
                z[i, : len(x)], t[i, : len(y)] = x, y
            z -= z.max(1, keepdims=True)
            for k, temperature in enumerate(grid):
                v = z / temperature
                log_p = np.maximum(v - np.log(np.exp(v).sum(1, keepdims=True)), math.log(FLOOR))
                total_loss[k] -= (t * log_p).sum()
            n += len(b)
        yield pd.DataFrame({"i": np.arange(len(grid), dtype=np.int32), "loss": total_loss, "n": n})

    both = q.filter("target is not null").join(p.select("record_id", "qid", "logits"), ["record_id", "qid"]).select("logits", "target")
    sums = both.mapInPandas(losses, "i int, loss double, n bigint").groupBy("i").agg((F.sum("loss") / F.nullif(F.sum("n"), F.lit(0))).alias("nll"))
    return sums.select("i", F.element_at(F.array(*[F.lit(float(t)) for t in GRID]), F.col("i") + 1).alias("temperature"), "nll")


def fit_temperature(q: DataFrame, p: DataFrame) -> DataFrame:
    """(temperature, nll_raw, nll_calibrated, at_grid_edge): the first temperature of least loss. One row."""
    losses = temperature_losses(q, p)
    best = losses.agg(F.min_by(F.struct("i", "temperature", "nll"), F.struct(F.round("nll", 12), "i")).alias("b"))
    raw = scored(q, p).agg(F.avg("nll").alias("nll_raw"))
    return best.crossJoin(raw).select(  # one row by one row
        F.col("b.temperature").alias("temperature"), "nll_raw", F.col("b.nll").alias("nll_calibrated"), F.col("b.i").isin(0, len(GRID) - 1).alias("at_grid_edge")
    )


def best_template(reports: dict[str, DataFrame]) -> DataFrame:
    """(template, accuracy): the template with the best macro accuracy, the first named on ties."""
    each = None
    for at, (name, r) in enumerate(reports.items()):
        one = r.filter("scope = 'macro'").select(F.lit(at).alias("_at"), F.lit(name).alias("template"), "accuracy")
        each = one if each is None else each.unionByName(one)
    return each.agg(F.max_by(F.struct("template", "accuracy"), F.struct("accuracy", -F.col("_at"))).alias("b")).select("b.template", "b.accuracy")


# ---- checks of the data themselves


def oracle(q: DataFrame) -> DataFrame:
    """(family, accuracy, max_brier_hard): the labels themselves as predictions; anything but 1 and about 0 is a fault of the data or the scorer."""
    logits = F.transform("target", lambda t: F.log(F.greatest(t, F.lit(FLOOR))))
    s = scored(q, q.select("record_id", "qid", F.col("keys").alias("options"), logits.alias("logits")))
    return s.groupBy("family").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.max(F.when(F.array_max("target") == 1.0, F.col("brier"))).alias("max_brier_hard"))


def null_baselines(q: DataFrame, permutations: int = 50, seed: str = "null-v1") -> DataFrame:
    """(family, n, chance, band, majority, position, shuffled): what knowing nothing scores, per family of scorable questions.

    ``majority`` always says the commonest label key, ``position`` the best constant position, ``shuffled`` is the mean of
    ``permutations`` permutations of the labels among questions with equally many options. The mean over permutations of
    the hits is exact for random permutations: the sum of squared label shares, so it is computed from counts.
    ``band`` is 1.96 standard deviations of chance.
    """
    base = q.filter("not ambiguous and label is not null").select("family", F.size("keys").alias("k"), "label", F.get("keys", F.col("label")).alias("word"))
    by = base.groupBy("family").agg(F.count("*").alias("n"), F.avg(1.0 / F.col("k")).alias("chance"))
    most = lambda col: base.groupBy("family", col).agg(F.count("*").alias("c")).groupBy("family").agg(F.max("c").alias(col))
    cells = base.groupBy("family", "k", "label").agg(F.count("*").alias("c"))
    size = cells.groupBy("family", "k").agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("m"))
    shuffled = size.groupBy("family").agg(F.sum(F.col("sq") / F.col("m")).alias("hits"))
    out = by.join(most("word"), "family").join(most("label"), "family").join(shuffled, "family")
    return out.select(
        "family", "n", "chance", (1.959964 * F.sqrt(F.col("chance") * (1 - F.col("chance")) / F.col("n"))).alias("band"),
        (F.col("word") / F.col("n")).alias("majority"), (F.col("label") / F.col("n")).alias("position"), (F.col("hits") / F.col("n")).alias("shuffled"),
    )


def prediction_difference(p: DataFrame, other: DataFrame) -> DataFrame:
    """One row: questions in both, same argmax, and the largest and mean difference of logits and probabilities."""
    both = p.select("record_id", "qid", F.col("logits").alias("a")).join(other.select("record_id", "qid", F.col("logits").alias("b")), ["record_id", "qid"])
    gap = lambda x, y: F.zip_with(x, y, lambda u, v: F.abs(u - v))
    both = both.select(
        (first_argmax("a") == first_argmax("b")).alias("same"), F.array_max(gap(F.col("a"), F.col("b"))).alias("dz"), F.array_max(gap(softmax("a"), softmax("b"))).alias("dp"),
        (total(gap(softmax("a"), softmax("b"))) / F.size("a")).alias("mp"), (total(gap(F.col("a"), F.col("b"))) / F.size("a")).alias("mz"),
    )
    return both.agg(
        F.count("*").alias("n"), F.count_if("same").alias("same_argmax"), F.max("dz").alias("max_logit_gap"), F.avg("mz").alias("mean_logit_gap"),
        F.max("dp").alias("max_prob_gap"), F.avg("mp").alias("mean_prob_gap"),
    )


def unscorable(q: DataFrame, name: str) -> DataFrame:
    """Predictions that give every option the same chance, for questions that a predictor cannot answer."""
    return q.select("record_id", "qid", F.lit(name).alias("predictor"), F.lit(None).cast("string").alias("template"), F.col("keys").alias("options"), uniform_logits(F.size("keys")).alias("logits"))
