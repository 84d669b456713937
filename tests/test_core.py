"""Core: ids, folding, shingles, R-tree, spatial joins, the query registry."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from marlpit.functions.fold import fold, words
from marlpit.functions.ids import canonical_user, hash_bucket, hash_hex
from marlpit.functions.rtree import RTree
from marlpit.functions.shingles import WordHash, line_ngrams, ngrams
from marlpit.operators.spatial import great_circle, inside, near_pairs, points_in_regions, unwrap

POINTS = "k string, latitude double, longitude double"


def test_ids(spark):
    rows = [(" AB-12 ",), ("ab12",), ("a b 12",), ("",), (None,), ("--",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(canonical_user("u")).collect()]
    assert got == ["ab12", "ab12", "ab12", None, None, None]
    r = spark.createDataFrame([("x",)], "u string").select(hash_hex("u").alias("h"), hash_bucket(100, "u").alias("b")).first()
    want = hashlib.sha256(b"x").hexdigest()[:16]
    assert r["h"] == want and r["b"] == int(want, 16) % 100


def test_fold_and_words():
    assert fold("Ｆｕｌｌ") == "full" and fold("nоbоdy") == "nobody" and fold("a​b &amp; c") == "ab & c" and fold("Café") == "cafe"
    assert words("Re-use it, don’t!") == ["reuse", "it", "dont"] and words(None) == [] and words("") == []


def test_line_ngrams_equal_single_lines():
    h = WordHash()
    lines = [["a"], list("abcdef"), list("abc"), list("xyzxyzxyz")]
    flat = h([w for line in lines for w in line])
    want = sorted(np.concatenate([ngrams(h(w), 4) for w in lines]).tolist())
    assert sorted(line_ngrams(flat, [len(x) for x in lines], 4)[0].tolist()) == want
    assert len(ngrams(h([]), 3)) == 0


def test_rtree_against_brute_force():
    rng = np.random.default_rng(0)
    low = rng.random((700, 2))
    boxes = np.concatenate([low, low + rng.random((700, 2)) * 0.05], axis=1)
    probes = np.concatenate([low[:90] - 0.01, low[:90] + 0.02], axis=1)
    got = {(int(p), int(i)) for a, b in RTree(boxes).query(probes, chunk=32) for p, i in zip(a, b)}
    want = {(p, i) for p, q in enumerate(probes) for i, b in enumerate(boxes) if b[0] <= q[2] and b[2] >= q[0] and b[1] <= q[3] and b[3] >= q[1]}
    assert got == want
    assert list(RTree(np.empty((0, 4))).query(probes)) == []


def _places(seed: int, n: int) -> list[tuple[str, float, float]]:
    r = random.Random(seed)
    hubs = [(48.0, 11.0), (0.0005, 179.9999), (0.0, -179.9995), (89.9995, 10.0), (89.9993, -170.0), (-89.9999, 50.0), (60.0, 20.0)]
    out = []
    for i in range(n):
        y, x = r.choice(hubs)
        y = max(-90.0, min(90.0, y + r.gauss(0, 0.001)))
        x = x + r.gauss(0, 0.002) * (1 if abs(y) < 80 else 1000)
        x = (x + 180) % 360 - 180
        out.append((f"k{i:04d}", y, x))
    out += [("same1", 10.0, 10.0), ("same2", 10.0, 10.0), ("same2", 10.0, 10.0)]
    return out


@pytest.mark.parametrize("target", [5, 40, 4000])
def test_near_pairs_against_brute_force(spark, target):
    rows = _places(1, 260)
    bad = [("n1", None, 1.0), ("n2", 0.0, 0.0), ("n3", 91.0, 0.0), ("n4", 5.0, 181.0), (None, 10.0, 10.0), ("n5", float("nan"), 3.0)]
    df = spark.createDataFrame(rows + bad, POINTS)
    got = {tuple(r) for r in near_pairs(df.selectExpr("*", "1 as leaf", "2 as probe"), "k", "latitude", "longitude", 150.0, target).collect()}
    want = {(a, b) for a, ya, xa in rows for b, yb, xb in rows if a < b and great_circle(ya, xa, yb, xb) <= 150.0}
    assert got == want and ("same1", "same2") in got


def test_near_pairs_hot_place_is_blocked(spark):
    rows = [(f"h{i:03d}", 12.5, 12.5) for i in range(60)]
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(rows, POINTS), "k", "latitude", "longitude", 150.0, 5).collect()}
    assert got == {(a, b) for a, _, _ in rows for b, _, _ in rows if a < b}


@pytest.mark.parametrize("metres", [5_000.0, 150_000.0, 9_000_000.0, 21_000_000.0])
def test_near_pairs_far(spark, metres):
    r = random.Random(2)
    rows = [(f"p{i:03d}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)]
    rows += [(f"q{i:03d}", r.choice([84.5, 85.9, -86.4, 40.0]) + r.gauss(0, 0.03), 179.95 + r.gauss(0, 0.6) - 360 * (i % 2)) for i in range(60)]
    rows = [(k, y, (x + 180) % 360 - 180) for k, y, x in rows]
    got = {tuple(x) for x in near_pairs(spark.createDataFrame(rows, POINTS), "k", "latitude", "longitude", metres, 8).collect()}
    assert got == {(a, b) for a, ya, xa in rows for b, yb, xb in rows if a < b and great_circle(ya, xa, yb, xb) <= metres}


def test_near_pairs_empty(spark):
    assert near_pairs(spark.createDataFrame([], POINTS), "k", "latitude", "longitude").count() == 0


def test_points_in_regions(spark):
    corner = "struct<latitude:double,longitude:double>"
    box = lambda *c: [(float(c[i]), float(c[j])) for i, j in ((0, 1), (0, 3), (2, 3), (2, 1))]
    regions = spark.createDataFrame(
        [("donut", box(0, 0, 10, 10), box(4, 4, 6, 6)), ("core", box(4, 4, 6, 6), None), ("date", box(-5, 178, 5, -178), None), ("flat", [(1.0, 1.0), (2.0, 2.0)], None), ("none", None, None)],
        f"area string, ring array<{corner}>, hole array<{corner}>",
    )
    pts = [("a", 2.0, 2.0), ("b", 5.0, 5.0), ("c", 1.0, 179.5), ("d", 1.0, -179.5), ("e", 50.0, 50.0), ("f", None, 2.0)]
    df = spark.createDataFrame(pts, POINTS)
    for target in (1, 4000):
        got = {tuple(r) for r in points_in_regions(df, "k", "latitude", "longitude", regions, "area", target=target).collect()}
        assert got == {("donut", "a"), ("core", "b"), ("date", "c"), ("date", "d")}
    assert points_in_regions(spark.createDataFrame([], POINTS), "k", "latitude", "longitude", regions, "area").count() == 0


def test_unwrap_and_inside():
    x = unwrap(np.array([179.0, -179.0, -179.0, 179.0]))
    assert x.max() - x.min() == 2.0
    assert inside(np.array([180.0]), np.array([0.0]), x, np.array([-1.0, -1.0, 1.0, 1.0])).all()


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    assert {"stratified_hash_sample", "p3_found"} <= set(names)
    assert set(e.oracle_sql()) <= set(names)


def test_key_bits(spark):
    from marlpit.functions.bitmap import KeyBits, key_bits

    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bits = KeyBits(key_bits(spark.createDataFrame([(int(k),) for k in keys], "key bigint")))
    assert bits.has(keys.astype(np.int64).view(np.uint64)).all()
    assert bits.has(np.random.default_rng(2).integers(0, 1 << 62, 5000, dtype=np.uint64)).mean() < 0.1
    assert not KeyBits(key_bits(spark.createDataFrame([], "key bigint"))).has(np.arange(9, dtype=np.uint64)).any()
