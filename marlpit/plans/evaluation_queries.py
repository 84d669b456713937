"""Queries of the evaluation operators over the records table, with SQL written apart from them.

There are no predictions among the tables; :func:`marlpit.operators.evaluation.stand_in_predictions` makes hashed ones. The
SQL keeps one row per option (``o``), the operators keep options in arrays, so the two agree only if both are right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.text import defang, option_labels, option_text
from marlpit.operators import evaluation as ev
from marlpit.operators import statistics as st
from marlpit.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _questions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return ev.questions(r.select("id", F.col("meta.state_id").alias("state_id"), F.col("meta.families").alias("families"), "questions"))


def _predictions(q: DataFrame, name: str) -> DataFrame:
    return ev.stand_in_predictions(q, name, {"base": 0.8, "cand": 1.6, "weak": 0.1}[name])


def _scored(spark: SparkSession, d: str, name: str) -> DataFrame:
    q = _questions(spark, d)
    return ev.scored(q, _predictions(q, name))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_Q = """
raw AS (SELECT id, meta.state_id AS sid, meta.families AS fam, unnest(questions) AS q, generate_subscripts(questions, 1) - 1 AS pos FROM records WHERE id IS NOT NULL),
flat AS (SELECT id AS record_id, q.qid AS qid, pos, coalesce(sid, id) AS state_id, coalesce(fam[q.qid], regexp_replace(q.src, '^[a-z]+/', '')) AS family, q.type AS kind,
  q.criteria AS criteria, q.label_key AS label_key, q.label_idx AS label_idx, q.soft_label AS soft, q.instructions AS instructions,
  row_number() OVER (PARTITION BY id, q.qid ORDER BY pos) AS copy, count(*) OVER (PARTITION BY id, q.qid) AS copies FROM raw),
one AS (SELECT *, len(criteria) AS k FROM flat WHERE copy = 1),
opts AS (SELECT record_id, qid, pos, state_id, family, kind, k, copies, label_key, label_idx, soft, unnest(criteria) AS c, generate_subscripts(criteria, 1) - 1 AS i FROM one),
named AS (SELECT *, CASE WHEN kind = 'score' THEN coalesce(c.key, CAST(i AS VARCHAR)) ELSE c.key END AS key FROM opts),
soft AS (SELECT record_id, qid, s.key AS key, s.p / sum(s.p) OVER (PARTITION BY record_id, qid) AS t FROM (SELECT record_id, qid, unnest(soft) AS s FROM one WHERE soft IS NOT NULL) x),
aim AS (SELECT n.*, CASE WHEN n.soft IS NOT NULL THEN coalesce(s.t, 0) WHEN n.kind = 'score' THEN CASE WHEN i = label_idx THEN 1.0 ELSE 0.0 END ELSE CASE WHEN n.key = label_key THEN 1.0 ELSE 0.0 END END AS t
  FROM named n LEFT JOIN soft s ON s.record_id = n.record_id AND s.qid = n.qid AND s.key = n.key),
top AS (SELECT *, max(t) OVER w AS best, min(t) OVER w AS low FROM aim WINDOW w AS (PARTITION BY record_id, qid)),
lab AS (SELECT record_id, qid, min(CASE WHEN t = best AND best > 0 THEN i END) AS label, count(*) FILTER (t >= best - 1e-9) > 1 AND bool_or(soft IS NOT NULL) AS ambiguous FROM top GROUP BY record_id, qid),
o AS (SELECT top.*, lab.label, lab.ambiguous FROM top JOIN lab USING (record_id, qid)),
q AS (SELECT record_id, qid, min(pos) AS pos, min(state_id) AS state_id, min(family) AS family, min(kind) AS kind, min(k) AS k, min(label) AS label, bool_or(ambiguous) AS ambiguous, min(copies) AS copies, max(t) AS best FROM o GROUP BY record_id, qid)
"""


def _z(name: str, boost: float) -> str:
    unit = f"CAST(('0x' || substr(sha256('{name}:' || record_id || ':' || qid || ':' || i), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return f"3.0 * ({unit}) + CASE WHEN i = label THEN {boost} ELSE 0.0 END"


_BOOST = {"base": 0.8, "cand": 1.6, "weak": 0.1}


def _s(name: str) -> str:
    """CTEs: ``p_name`` one row per option with z, p, and ``s_name`` one row per question with its scores."""
    return f"""
z_{name} AS (SELECT *, {_z(name, _BOOST[name])} AS z FROM o),
m_{name} AS (SELECT *, max(z) OVER (PARTITION BY record_id, qid) AS zmax FROM z_{name}),
p_{name} AS (SELECT *, exp(z - zmax) / sum(exp(z - zmax)) OVER (PARTITION BY record_id, qid) AS p FROM m_{name}),
s_{name} AS (SELECT record_id, qid, min(state_id) AS state_id, min(family) AS family, min(kind) AS kind, min(label) AS label, bool_or(ambiguous) AS ambiguous, max(p) AS conf, min(CASE WHEN z = zmax THEN i END) AS pred,
  sum((p - t) * (p - t)) AS brier, -sum(t * ln(greatest(p, 1e-12))) AS nll, sum(CASE WHEN z = zmax THEN t ELSE 0 END) AS expected FROM p_{name} GROUP BY record_id, qid)"""


_NAMES = ("record_id", "qid", "pos", "state_id", "family", "kind")


@query(f"WITH {_Q} SELECT record_id, qid, CAST(pos AS INT) AS pos, state_id, family, kind, CAST(k AS INT) AS n_options, CAST(label AS INT) AS label, ambiguous, copies, round(best, 6) AS target FROM q")
def eval_questions(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return _rounded(q.select(*_NAMES, F.size("keys").alias("n_options"), "label", "ambiguous", "copies", F.array_max("target").alias("target")))


@query(f"""WITH {_Q} SELECT 'bad_label' AS "check", count(*) FILTER (label IS NULL) AS n FROM q UNION ALL SELECT 'twice', count(*) FILTER (copies > 1) FROM q
UNION ALL SELECT 'no_family', count(*) FILTER (family IS NULL) FROM q UNION ALL SELECT 'no_options', 0""")
def eval_violations(spark: SparkSession, d: str) -> DataFrame:
    return ev.question_violations(_questions(spark, d))


@query(f"""WITH {_Q} SELECT count(*) FILTER (record_id LIKE '%7') AS missing, count(*) FILTER (record_id LIKE '%9') AS extra, count(*) FILTER (record_id LIKE '%3') AS repeated,
count(*) FILTER (record_id LIKE '%5' AND k > 1) AS other_options, count(*) FILTER (record_id LIKE '%1') AS bad_logits, 1 AS identities FROM q""")
def eval_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The checks of a prediction file with planted faults: rows left out, repeated, foreign, reordered and cut."""
    q = _questions(spark, d)
    p = _predictions(q, "cand")
    ends = lambda c: F.col("record_id").endswith(c)
    p = p.withColumn("options", F.when(ends("5"), F.reverse("options")).otherwise(F.col("options"))).withColumn("logits", F.when(ends("1"), F.slice("logits", 1, 1)).otherwise(F.col("logits")))
    faulty = p.filter(~ends("7")).unionByName(p.filter(ends("3"))).unionByName(p.filter(ends("9")).withColumn("record_id", F.concat("record_id", F.lit("x"))))
    return ev.alignment(q, faulty)


@query(f"WITH {_Q}, {_s('cand')} SELECT record_id, qid, CAST(pred AS INT) AS pred, CASE WHEN ambiguous THEN NULL ELSE pred = label END AS correct, round(conf, 6) AS conf, round(brier, 6) AS brier, round(nll, 6) AS nll, round(expected, 6) AS expected FROM s_cand")
def eval_scored(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d, "cand").select("record_id", "qid", "pred", "correct", "conf", "brier", "nll", "expected"))


def _curve(name: str, by: str) -> str:
    return f"""(SELECT {by} AS family, c, max(a) AS a, max(e) AS e FROM (SELECT *, count(*) OVER (PARTITION BY {by} ORDER BY c DESC) AS a, count(*) FILTER (pred <> label) OVER (PARTITION BY {by} ORDER BY c DESC) AS e
  FROM (SELECT *, round(conf, 9) AS c FROM s_{name} WHERE NOT ambiguous) x) y GROUP BY ALL)"""


def _level(scope: str, by: str) -> str:
    return f"""SELECT '{scope}' AS scope, m.family, n, n_scored, accepted, errors, accuracy, brier, nll, ece, accepted / nullif(n_scored, 0) AS coverage, errors / nullif(accepted, 0) AS realized_error, b.best / nullif(n_scored, 0) AS coverage_in_sample FROM
 (SELECT {by} AS family, count(*) AS n, count(*) FILTER (NOT ambiguous) AS n_scored, count(*) FILTER (conf >= {THRESHOLD} AND NOT ambiguous) AS accepted, count(*) FILTER (conf >= {THRESHOLD} AND NOT ambiguous AND pred <> label) AS errors,
   avg(CASE WHEN ambiguous THEN NULL WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, avg(brier) AS brier, avg(nll) AS nll FROM s_cand GROUP BY 1) m
 JOIN (SELECT family, sum(w * abs(x - y)) / sum(w) AS ece FROM (SELECT {by} AS family, least(floor(conf * 15), 14) AS bin, count(*) AS w, avg(expected) AS x, avg(conf) AS y FROM s_cand GROUP BY 1, 2) GROUP BY family) e USING (family)
 LEFT JOIN (SELECT family, coalesce(max(a) FILTER (e <= 0.05 * a), 0) AS best FROM {_curve('cand', by)} GROUP BY family) b USING (family)"""


@query(f"""WITH {_Q}, {_s('cand')}, f AS ({_level('family', 'family')}), mi AS ({_level('micro', "'all'")}),
al AS (SELECT * FROM f UNION ALL SELECT * FROM mi UNION ALL SELECT 'macro', 'all', CAST(sum(n) AS BIGINT), CAST(sum(n_scored) AS BIGINT), CAST(sum(accepted) AS BIGINT), CAST(sum(errors) AS BIGINT), avg(accuracy), avg(brier), avg(nll), avg(ece), avg(coverage), avg(realized_error), avg(coverage_in_sample) FROM f)
SELECT scope, family, n, n_scored, accepted, errors, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(nll, 6) AS nll, round(ece, 6) AS ece, round(coverage, 6) AS coverage, round(realized_error, 6) AS realized_error, round(coverage_in_sample, 6) AS coverage_in_sample FROM al""")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.report(_scored(spark, d, "cand"), THRESHOLD))


@query(f"WITH {_Q}, {_s('cand')} SELECT family, round(c, 6) AS conf, a AS accepted, e AS errors FROM {_curve('cand', 'family')} v")
def eval_risk_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.risk_curve(_scored(spark, d, "cand"), ["family"]))


@query(f"""WITH {_Q}, {_s('cand')} SELECT family, round(min(c) FILTER (e <= 0.05 * a), 6) AS threshold, coalesce(max(a) FILTER (e <= 0.05 * a), 0) AS accepted,
coalesce(arg_max(e, a) FILTER (e <= 0.05 * a), 0) AS errors, max(a) AS n FROM {_curve('cand', 'family')} v GROUP BY family""")
def eval_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.select_threshold(_scored(spark, d, "cand"), ["family"]))


@query(f"""WITH {_Q}, {_s('cand')}, r AS (SELECT *, CASE WHEN kind = 'score' THEN CAST(label AS VARCHAR) END AS x FROM s_cand), k AS (SELECT record_id, qid, key FROM o WHERE i = label)
SELECT family, count(*) FILTER (risk) AS n_at_risk, count(*) FILTER (risk AND pred <> label) AS missed, round(count(*) FILTER (risk AND pred <> label) / nullif(count(*) FILTER (risk), 0), 6) AS fn_rate
FROM (SELECT r.*, NOT ambiguous AND ((family = 'approve_ok' AND key = 'yes') OR (family = 'share_ok' AND key = 'no') OR (family = 'route_ok' AND key = 'yes')) AS risk FROM r JOIN k USING (record_id, qid) WHERE family IN ('approve_ok', 'share_ok', 'route_ok')) y GROUP BY family""")
def eval_safety(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.safety(_scored(spark, d, "cand")))


_LOSSES = f"""WITH {_Q}, {_s('cand')}, g AS (SELECT CAST(i AS INT) AS gi, exp(ln(0.05) + i * (ln(50.0) - ln(0.05)) / 480) AS temp FROM range(481) r(i)),
e AS (SELECT gi, temp, record_id, qid, t, (z - zmax) / temp AS v FROM m_cand, g), l AS (SELECT gi, temp, record_id, qid, -sum(t * greatest(v - lz, ln(1e-12))) AS nll FROM (SELECT *, ln(sum(exp(v)) OVER (PARTITION BY gi, record_id, qid)) AS lz FROM e) x GROUP BY ALL),
c AS (SELECT gi, temp, avg(nll) AS nll FROM l GROUP BY ALL)"""


@query(f"{_LOSSES} SELECT gi AS i, round(temp, 6) AS temperature, round(nll, 6) AS nll FROM c")
def eval_temperature_losses(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return _rounded(ev.temperature_losses(q, _predictions(q, "cand")))


@query(f"{_LOSSES} SELECT round(b.temp, 6) AS temperature, round(raw, 6) AS nll_raw, round(b.nll, 6) AS nll_calibrated, b.gi IN (0, 480) AS at_grid_edge FROM (SELECT * FROM c ORDER BY round(nll, 12), gi LIMIT 1) b, (SELECT avg(nll) AS raw FROM s_cand) r")
def eval_temperature(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return _rounded(ev.fit_temperature(q, _predictions(q, "cand")))


@query(f"""WITH {_Q}, {_s('base')}, {_s('cand')}, {_s('weak')}, a AS (SELECT 'base' AS template, * FROM s_base UNION ALL SELECT 'cand', * FROM s_cand UNION ALL SELECT 'weak', * FROM s_weak)
SELECT template, round(accuracy, 6) AS accuracy FROM (SELECT template, avg(acc) AS accuracy FROM (SELECT template, family, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS acc FROM a WHERE NOT ambiguous GROUP BY ALL) x GROUP BY template) y ORDER BY accuracy DESC LIMIT 1""")
def eval_template(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return _rounded(ev.best_template({n: ev.report(ev.scored(q, _predictions(q, n)), None) for n in ("base", "cand", "weak")}))


@query(f"WITH {_Q} SELECT family, CASE WHEN count(*) FILTER (NOT ambiguous) > 0 THEN 1.0::DOUBLE END AS accuracy, CASE WHEN count(*) FILTER (best = 1.0) > 0 THEN 0.0::DOUBLE END AS max_brier_hard FROM q GROUP BY family")
def eval_oracle(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.oracle(_questions(spark, d)))


@query(f"""WITH {_Q}, b AS (SELECT q.family, q.k, q.label, o.key FROM q JOIN o ON o.record_id = q.record_id AND o.qid = q.qid AND o.i = q.label WHERE NOT q.ambiguous),
n AS (SELECT family, count(*) AS n, avg(1.0 / k) AS chance FROM b GROUP BY family), s AS (SELECT family, sum(sq / m) AS hits FROM (SELECT family, k, sum(c * c) AS sq, sum(c) AS m FROM (SELECT family, k, label, count(*) AS c FROM b GROUP BY ALL) x GROUP BY ALL) y GROUP BY family)
SELECT n.family, n.n, round(chance, 6) AS chance, round(1.959964 * sqrt(chance * (1 - chance) / n), 6) AS band, round((SELECT max(c) FROM (SELECT count(*) AS c FROM b WHERE b.family = n.family GROUP BY key)) / n, 6) AS majority,
round((SELECT max(c) FROM (SELECT count(*) AS c FROM b WHERE b.family = n.family GROUP BY label)) / n, 6) AS position, round(s.hits / n, 6) AS shuffled FROM n JOIN s USING (family)""")
def eval_null_baselines(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.null_baselines(_questions(spark, d)))


@query(f"""WITH {_Q}, {_s('base')}, {_s('cand')}, x AS (SELECT b.record_id, b.qid, max(abs(b.z - c.z)) AS dz, avg(abs(b.z - c.z)) AS mz, max(abs(b.p - c.p)) AS dp, avg(abs(b.p - c.p)) AS mp FROM p_base b JOIN p_cand c USING (record_id, qid, i) GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (b.pred = c.pred) AS same_argmax, round(max(dz), 6) AS max_logit_gap, round(avg(mz), 6) AS mean_logit_gap, round(max(dp), 6) AS max_prob_gap, round(avg(mp), 6) AS mean_prob_gap FROM x JOIN s_base b USING (record_id, qid) JOIN s_cand c USING (record_id, qid)""")
def eval_prediction_difference(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return _rounded(ev.prediction_difference(_predictions(q, "base"), _predictions(q, "cand")))


_PAIRS = f"WITH {_Q}, {_s('base')}, {_s('cand')}, pr AS (SELECT b.state_id, b.family, b.pred = b.label AS x, c.pred = c.label AS y FROM s_base b JOIN s_cand c USING (record_id, qid) WHERE NOT b.ambiguous)"


@query(f"""{_PAIRS}, n AS (SELECT count(*) FILTER (y AND NOT x) AS gained, count(*) FILTER (x AND NOT y) AS lost FROM pr)
SELECT gained, lost, round(least(1.0, 2 * (SELECT sum(exp(lgamma(gained + lost + 1) - lgamma(k + 1) - lgamma(gained + lost - k + 1) - (gained + lost) * ln(2))) FROM range(100000) r(k) WHERE k <= least(gained, lost))), 6) AS p FROM n""")
def eval_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scored(spark, d, "base"), _scored(spark, d, "cand")
    pairs = a.select("record_id", "qid", F.col("correct").alias("base")).join(b.select("record_id", "qid", F.col("correct").alias("cand")), ["record_id", "qid"])
    return _rounded(st.mcnemar(pairs, "base", "cand"))


@query(f"{_PAIRS} SELECT state_id, family, count(*) AS n, count(*) FILTER (x) AS base, count(*) FILTER (y) AS cand FROM pr GROUP BY ALL")
def eval_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


def _clusters(spark: SparkSession, d: str, base: str = "base", cand: str = "cand") -> DataFrame:
    return st.clusters_of(_scored(spark, d, base), _scored(spark, d, cand))


@query()
def eval_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """10,000 draws over whole states: difference, interval and p, per family and in the mean."""
    return _rounded(st.paired_bootstrap(_clusters(spark, d)))


@query()
def eval_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(st.noise_floor(_clusters(spark, d)))


@query()
def eval_gate(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, "cand").withColumn("correct", F.col("pred") == F.col("label"))
    b = _scored(spark, d, "base")
    label = F.get("keys", F.col("label"))
    risky = F.coalesce(*[F.when(F.col("family") == f, label == v) for f, v in ev.AT_RISK.items()], F.lit(False)) & ~F.col("ambiguous")
    missed = lambda x: x.filter(risky).withColumn("missed", F.col("pred") != F.col("label"))
    return st.gate(st.paired_bootstrap(_clusters(spark, d), 2_000), st.paired_bootstrap(st.clusters_of(missed(b), missed(s), "missed"), 2_000), 0.0, max_p=0.01)


@query()
def eval_ladder(spark: SparkSession, d: str) -> DataFrame:
    steps = [st.paired_bootstrap(_clusters(spark, d, a, b), 1_000) for a, b in (("weak", "base"), ("base", "cand"))]
    return st.ladder(steps, ev.report(_scored(spark, d, "cand"), None).filter("scope = 'macro'"))


@query(f"""{_PAIRS.replace("pr AS (SELECT b.state_id", "pr AS (SELECT b.record_id, b.state_id")}, h AS (SELECT *, CASE WHEN record_id SIMILAR TO '.*[02468]' THEN 'A' ELSE 'B' END AS half FROM pr),
u AS (SELECT 'overall' AS part, * FROM h UNION ALL SELECT half, * FROM h UNION ALL SELECT 'without_choice', * FROM h WHERE family <> 'pick_option')
SELECT part, round(avg(b), 6) AS base, round(avg(c), 6) AS cand, round(avg(c) - avg(b), 6) AS delta, CAST(sum(n) AS BIGINT) AS n FROM (SELECT part, family, count(*) AS n, avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS c FROM u GROUP BY ALL) z GROUP BY part""")
def eval_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Macro accuracy of both predictors overall, on each half of the records, and without one family."""
    a = _scored(spark, d, "base").select("record_id", "qid", "family", F.col("correct").cast("double").alias("base"))
    both = a.join(_scored(spark, d, "cand").select("record_id", "qid", F.col("correct").cast("double").alias("cand")), ["record_id", "qid"]).filter("base is not null")
    half = F.when(F.col("record_id").rlike("[02468]$"), "A").otherwise("B")
    parts = F.array_compact(F.array(F.lit("overall"), half, F.when(F.col("family") != "pick_option", "without_choice")))
    per = both.select(F.explode(parts).alias("part"), "family", "base", "cand").groupBy("part", "family").agg(F.count("*").alias("n"), F.avg("base").alias("base"), F.avg("cand").alias("cand"))
    return _rounded(per.groupBy("part").agg(F.avg("base").alias("base"), F.avg("cand").alias("cand"), (F.avg("cand") - F.avg("base")).alias("delta"), F.sum("n").alias("n")))


# ---- prompts and rows made from questions


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the text of their state, instruction and option lines."""
    r = table(spark, d, "records").filter("id is not null")
    x = r.select("id", "state", F.posexplode("questions").alias("pos", "q")).select(
        F.col("id").alias("record_id"), F.col("q.qid").alias("qid"), defang("state").alias("state"), F.col("q.instructions").alias("instructions"), F.col("q.criteria").alias("criteria"))
    return _questions(spark, d).join(x.dropDuplicates(["record_id", "qid"]), ["record_id", "qid"])


_TEXT = f"""WITH {_Q}, txt AS (SELECT record_id, qid, min(i1) AS instructions FROM (SELECT record_id, qid, instructions AS i1 FROM one) a GROUP BY ALL),
line AS (SELECT record_id, qid, string_agg(lab || ') ' || key || coalesce(': ' || nullif(c.desc, ''), ''), chr(10) ORDER BY i) AS lines, max(CASE WHEN i = label THEN lab END) AS answer, bool_or(ambiguous) AS ambiguous, min(family) AS family
  FROM (SELECT *, CASE kind WHEN 'choice' THEN chr(CAST(65 + i AS INT)) WHEN 'noul' THEN CASE i WHEN 0 THEN 'yes' ELSE 'no' END ELSE CAST(i AS VARCHAR) END AS lab FROM o) x GROUP BY ALL)"""


def _with_lines(x: DataFrame) -> DataFrame:
    labels = option_labels("kind", F.size("keys"))
    texts = F.zip_with("keys", "criteria", lambda k, c: option_text(k, c["desc"]))
    return x.withColumn("labels", labels).withColumn("lines", F.concat_ws("\n", F.zip_with("labels", texts, lambda a, t: F.concat(a, F.lit(") "), t))))


@query(f"{_TEXT} SELECT record_id, qid, instructions || chr(10) || lines AS prompt FROM line JOIN txt USING (record_id, qid)")
def eval_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question part of each prompt: instruction, then one labelled line per option."""
    return _with_lines(_asked(spark, d)).select("record_id", "qid", F.concat_ws("\n", "instructions", "lines").alias("prompt"))


@query(f"{_TEXT} SELECT record_id, qid, family, answer AS completion, length(instructions || chr(10) || lines) // 4 AS tokens FROM line JOIN txt USING (record_id, qid) WHERE NOT ambiguous")
def eval_tuning_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for tuning a model: prompt size and the label of the right option; ambiguous questions are left out."""
    x = _with_lines(_asked(spark, d)).filter("not ambiguous")
    return x.select("record_id", "qid", "family", F.get("labels", F.col("label")).alias("completion"), F.floor(F.length(F.concat_ws("\n", "instructions", "lines")) / 4).cast("bigint").alias("tokens"))


@query(f"""WITH {_Q}, {_s('cand')} SELECT s.record_id, s.qid, s.family, s.kind, CASE WHEN s.ambiguous THEN NULL ELSE pred = s.label END AS correct, round(expected, 6) AS grade, r.shard = 'test' AS withheld
FROM s_cand s JOIN (SELECT id, min(shard) AS shard FROM records GROUP BY id) r ON r.id = s.record_id""")
def eval_round_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an evaluation round: tags, grade, no right or wrong where ambiguous, prompts of the test shard withheld."""
    shard = table(spark, d, "records").groupBy(F.col("id").alias("record_id")).agg(F.min("shard").alias("shard"))
    s = _scored(spark, d, "cand").join(shard, "record_id")
    return _rounded(s.select("record_id", "qid", "family", "kind", "correct", F.col("expected").alias("grade"), (F.col("shard") == "test").alias("withheld")))


@query(f"WITH {_Q} SELECT q.record_id, q.qid, q.kind, o.key AS label FROM q JOIN o ON o.record_id = q.record_id AND o.qid = q.qid AND o.i = q.label")
def eval_strict_requests(spark: SparkSession, d: str) -> DataFrame:
    """Questions in the strict form: a soft label stands as its largest option."""
    return _questions(spark, d).select("record_id", "qid", "kind", F.get("keys", F.col("label")).alias("label"))


@query(f"""WITH {_Q}, {_s('cand')} SELECT count(*) AS n_rows, count(DISTINCT record_id) AS records, count(DISTINCT state_id) AS states, count(DISTINCT family) AS families, max(kk) AS most_options FROM (SELECT s.*, q.k AS kk FROM s_cand s JOIN q USING (record_id, qid)) x""")
def eval_run_receipt(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, "cand")
    return s.agg(F.count("*").alias("n_rows"), F.count_distinct("record_id").alias("records"), F.count_distinct("state_id").alias("states"), F.count_distinct("family").alias("families"), F.max(F.size("keys")).cast("bigint").alias("most_options"))
