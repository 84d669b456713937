"""Sources, streaming forms, statistics and decontamination."""

from __future__ import annotations

import random

import numpy as np
import pytest

from marlpit.operators.statistics import bootstrap_deltas, gate, match_kinds, mcnemar, mcnemar_p, noise_floor, paired_bootstrap
from marlpit.sources.jsonl import EMAILS, first_filled, manifest, read_jsonl, violations, write_jsonl
from pyspark.sql import functions as F

from marlpit.operators.ranking import pending
from marlpit.streaming.events import append_once, checkpointed, first_of_each, first_within, sessions, windowed_counts


def test_jsonl_round_trip_and_violations(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", None, "x"), ("b", "d", "s", "y")], EMAILS)
    write_jsonl(df, str(tmp_path / "m"))
    back = read_jsonl(spark, str(tmp_path / "m"), EMAILS)
    assert manifest(back).first() == manifest(df.repartition(3)).first()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"email_id":"a","body":"b"}\n\n{oops\n{"email_id":"a","body":null}\n')
    got = {r["check"]: r["n"] for r in violations(read_jsonl(spark, str(tmp_path / "bad"), EMAILS, strict=False).cache(), ["email_id"], ["body"]).collect()}
    assert got["malformed"] == 1 and got["null_body"] == 2 and got["repeated_key"] >= 1
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "bad"), EMAILS).collect()
    rows = spark.createDataFrame([("-", "x"), ("y", None), (" ", "\\N")], "a string, b string")
    assert [r[0] for r in rows.select(first_filled(rows, "missing", "a", "b")).collect()] == ["x", "y", None]


def test_mcnemar_published_value(spark):
    assert abs(mcnemar_p(359, 48) / 5.7e-60 - 1) < 0.01 and mcnemar_p(0, 0) == 1.0 and mcnemar_p(1, 1) == 1.0
    rows = [(True, False)] * 3 + [(False, True)] * 12 + [(True, True)] * 5 + [(None, True)]
    r = mcnemar(spark.createDataFrame(rows, "b boolean, c boolean"), "b", "c").first()
    assert (r["gained"], r["lost"]) == (12, 3) and abs(r["p"] - 0.03515625) < 1e-9


def test_paired_bootstrap(spark):
    rows = [(i, i % 3, 4, 1 + i % 2, 2 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "state_id long, family long, n long, base long, cand long")
    got = {r["family"]: r for r in paired_bootstrap(df, 1000).collect()}
    assert set(got) == {"0", "1", "2", "*"}
    assert all(abs(r["delta"] - 0.25) < 1e-9 and abs(r["low"] - 0.25) < 1e-9 and r["p"] == 1 / 1001 for r in got.values())
    assert paired_bootstrap(df.limit(0), 100).filter("family <> '*'").count() == 0


def test_bootstrap_equals_the_multinomial_one(spark):
    """Width and place of the interval agree with resampling whole states with replacement; partitioning does not matter."""
    r = np.random.default_rng(4)
    rows = [(f"s{i}", f, 3, int(b), int(c)) for i in range(300) for f, b, c in ((("x", "y")[i % 2], r.integers(0, 4), r.integers(1, 4)),)]
    df = spark.createDataFrame(rows, "state_id string, family string, n long, base long, cand long")
    got = {x["family"]: x for x in paired_bootstrap(df, 4000).collect()}
    m = np.zeros((3, 300, 2))
    for i, (_, f, n, b, c) in enumerate(rows):
        m[:, i, "xy".index(f)] = n, b, c
    w = r.multinomial(300, np.full(300, 1 / 300), 4000)
    d = ((w @ m[2] - w @ m[1]) / (w @ m[0])).mean(1)
    low, high = np.quantile(d, [0.025, 0.975])
    assert abs(got["*"]["low"] - low) < 0.02 and abs(got["*"]["high"] - high) < 0.02
    drawn = lambda x: {(a["draw"], a["family"]): a["delta"] for a in bootstrap_deltas(x, 50).collect()}
    assert drawn(df.repartition(7)) == pytest.approx(drawn(df))


def test_gate_and_noise(spark):
    boot = lambda star, fam: spark.createDataFrame([("*", *star), ("a", *fam)], "family string, delta double, low double, high double, p double")
    passed = lambda *a, **k: {r["check"]: r["passed"] for r in gate(*a, **k).collect()}
    good = passed(boot((0.05, 0.01, 0.1, 0.001), (0.0, -0.1, 0.1, 0.5)), guard_delta=0.0, max_p=0.01)
    assert all(good.values()) and len(good) == 6
    bad = passed(boot((0.04, -0.01, 0.1, 0.2), (-0.2, -0.3, -0.1, 1.0)), guard_delta=None, max_p=0.01)
    assert not any(bad.values())
    rows = [(f"s{i}", "a", 2, 0, i % 3) for i in range(200)]
    floor = {r["family"]: r for r in noise_floor(spark.createDataFrame(rows, "state_id string, family string, n long, base long, cand long"), 500).collect()}
    assert abs(floor["a"]["paired_half_width"] / floor["a"]["half_width"] - 2**0.5) < 1e-9 and floor["*"]["n"] == 400


def test_match_kinds(spark):
    base = "The quick brown fox jumps over the lazy dog near the old mill every single day"
    src = spark.createDataFrame([(1, base), (2, base.upper() + "!"), (3, "Well " + base), (4, "nothing alike"), (5, None), (6, " "), (7, "ﬁne café"), (8, base.replace(" ", "\u00a0"))], "id long, text string")
    tgt = spark.createDataFrame([(10, base), (11, None), (12, ""), (13, "fine café")], "id long, text string")
    assert {tuple(r) for r in match_kinds(src, tgt, "id", "text").collect()} == {(1, "exact"), (2, "normalized"), (3, "ngram"), (7, "normalized"), (8, "normalized")}
    assert match_kinds(src.limit(0), tgt, "id", "text").count() == 0 and match_kinds(src, tgt.limit(0), "id", "text").count() == 0


def test_match_kinds_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(25)]
    texts = base + [[r.choice(words) if r.random() < 0.02 else w for w in b[: r.randint(3, 70)]] for b in base for _ in range(3)] + [b + b[::-1] for b in base]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    src, tgt = rows[::2], rows[1::2]
    grams = lambda t: {tuple(w[i : i + 8]) for i in range(len(w) - 7)} or {tuple(w)} if (w := t.split()) else set()
    want = set()
    for i, t in src:
        if any(t == u for _, u in tgt):
            want.add((i, "exact"))
        elif any(len(grams(t) & grams(u)) >= 0.8 * min(len(grams(t)), len(grams(u))) for _, u in tgt):
            want.add((i, "ngram"))
    got = match_kinds(spark.createDataFrame(src, "id long, text string"), spark.createDataFrame(tgt, "id long, text string"), "id", "text")
    assert {tuple(x) for x in got.collect()} == want and len({k for _, k in want}) == 2


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:00:00", "a", 1.0), (2, "2024-01-01 00:10:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 4.0), (4, "2024-01-02 00:00:00", "a", 8.0)]
    df = spark.createDataFrame(rows, "id long, t string, k string, v double").selectExpr("id", "cast(t as timestamp) t", "k", "v")
    df.write.parquet(str(tmp_path / "in"))

    def run(make, name):
        stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()

    assert len(run(lambda s: first_within(s, ["id"], "t"), "firsts")) == 4
    assert {(r["k"], r["n"]) for r in run(lambda s: windowed_counts(s, "t", "k", "v"), "counts")} >= {("a", 3), ("b", 1)}
    assert {(r["k"], r["n"]) for r in run(lambda s: sessions(s, "t", "k"), "sess")} >= {("a", 3), ("b", 1)}
    sink = append_once(str(tmp_path / "out"), ["id"])
    sink(df, 0)
    sink(df, 0)
    sink(df.filter("id = 2"), 1)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and first_of_each(out, ["id"]).count() == 4


def test_checkpointed_work(spark, tmp_path):
    df, seen = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, t string"), []

    def work(x):
        seen.append(x.count())
        return x.withColumn("n", F.length("t"))

    path = str(tmp_path / "scores")
    assert checkpointed(spark, path, df, ["id"], lambda x: work(x.filter("id < 4"))).count() == 4
    assert checkpointed(spark, path, df, ["id"], work).count() == 10 and seen == [4, 6]
    with pytest.raises(ValueError):
        checkpointed(spark, path, df.limit(3), ["id"], work)
    assert pending(df, df.filter("id < 3").withColumn("x", F.lit(1)), ["id"]).count() == 7
