"""Training-data operators against brute force, round trips and held-out accuracy on small inputs with dirt."""

from __future__ import annotations

import collections
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlpit.llm import abuse, cutoff, leak, overlap, pii
from marlpit.llm.bpe import Encoder, encode_table, load_ranks
from marlpit.llm.groups import connected_components, draft_groups, proportional_splits
from marlpit.llm.leak import leak_counts, leaks
from marlpit.llm.overlap import containment, cross_split_classes, cross_split_pairs, cross_split_users, lines_of, overlap_counts, state_links, user_links
from marlpit.llm.sample import frozen_batch_sample, rows_of_sample
from marlpit.llm.topn import top_n

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS = "river stone amber quiet lantern copper meadow north garden silver basket thunder velvet orchard window candle marble harvest pepper willow anchor bridge cotton dagger ember falcon".split()


def _sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)).capitalize() + "."


# ---- top N


def test_top_n(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "big", None, ""]), f"i{r.randint(0, 60)}", r.choice([1, 2, 3, 50, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "cat string, item string, n bigint").withColumn("_salt", F.lit(1)).withColumn("rank", F.lit("x"))
    best: dict = {}
    for c, i, n in rows:
        if None not in (c, i, n):
            best[c, i] = max(n, best.get((c, i), n))
    want = set()
    for cat in {c for c, _ in best}:
        want |= {(cat, i) for i, _ in sorted(((i, n) for (c, i), n in best.items() if c == cat), key=lambda x: (-x[1], x[0]))[:10]}
    assert {(x["cat"], x["item"]) for x in top_n(df, "cat", "item", "n", 10, salts=4).collect()} == want
    assert top_n(df.limit(0), "cat", "item", "n").count() == 0


# ---- stable sample


def _users(n: int) -> list[tuple]:
    r = random.Random(3)
    return [(f"u{i}", f"2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} 10:00:00") for i in range(n)]


def test_sample_is_append_only_and_exact(spark):
    rows = _users(900) + [(None, "2024-01-05 00:00:00"), ("", "2024-01-05 00:00:00"), ("u1", "2024-12-30 00:00:00"), ("late", None)]
    df = spark.createDataFrame(rows, "user_id string, t string").withColumn("t", F.col("t").cast("timestamp")).withColumn("batch", F.lit(0))
    whole = frozen_batch_sample(df, "user_id", "t", 0.1).collect()
    sizes: dict = {}
    first: dict = {}
    for u, t in rows:
        if u and t:
            first[u] = min(t, first.get(u, t))
    for t in first.values():
        sizes[t[:7]] = sizes.get(t[:7], 0) + 1
    got: dict = {}
    for x in whole:
        if x["batch"] is not None:
            got[str(x["batch"])[:7]] = got.get(str(x["batch"])[:7], 0) + 1
    assert got == {m: -(-n // 10) for m, n in sizes.items() if m < "2024-12"}
    assert "late" not in {x["user_id"] for x in whole}
    for day in (1, 28):  # a user whose arrival becomes known later: nobody who was selected is dropped
        later = spark.createDataFrame(rows[:-1] + [("late", f"2024-12-{day:02d} 00:00:00"), ("next", "2025-02-01 00:00:00")], "user_id string, t string").withColumn("t", F.col("t").cast("timestamp"))
        assert {x["user_id"] for x in whole} <= {x["user_id"] for x in frozen_batch_sample(later, "user_id", "t", 0.1).collect()}
    for until in ("2024-03-10", "2024-07-01", "2024-11-20"):
        part = frozen_batch_sample(df.filter(F.col("t") < until).repartition(7), "user_id", "t", 0.1).collect()
        assert {x["user_id"] for x in part} <= {x["user_id"] for x in whole}
    assert frozen_batch_sample(df.limit(0), "user_id", "t").count() == 0


def test_rows_of_sample(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "b"), (3, None)], "row_id int, user_id string")
    sample = spark.createDataFrame([("a",)], "user_id string")
    assert [x["row_id"] for x in rows_of_sample(rows, F.lower("user_id"), sample, "user_id").collect()] == [1]


# ---- groups and splits


def _components(edges: list[tuple[str, str]]) -> dict[str, str]:
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(f"n{r.randint(0, 300):03d}", f"n{r.randint(0, 300):03d}") for _ in range(220)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("hub", f"s{i:03d}") for i in range(120)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + edges[:9] + [("x", "x"), ("y", None)], "a string, b string")
    assert {x["node"]: x["component"] for x in connected_components(df).collect()} == _components(edges)
    assert connected_components(df.limit(0)).count() == 0


def test_draft_groups_and_splits(spark):
    draft = spark.createDataFrame(
        [("s1", "AA-1"), ("s2", "aa1"), ("s2", "aa1 "), ("s3", "b"), ("s4", "c"), ("s5", None), ("s6", "e"), ("s7", "f"), (None, "aa1"), ("s8", "lone")], "state_id string, user_id string"
    )
    users = spark.createDataFrame(
        [("aa1", None, "m1"), ("m1", None, "M-2"), ("m2", None, None), ("b", None, "m2"), ("c", "h1", None), ("e", "h1", None), ("f", " ", None), (None, "h1", None)],
        "user_id string, household_id string, merged_into string",
    )
    g = {x["state_id"]: (x["group_id"], x["size"]) for x in draft_groups(draft, users).collect()}
    assert g == {"s1": ("s1", 3), "s2": ("s1", 3), "s3": ("s1", 3), "s4": ("s4", 2), "s6": ("s4", 2), "s5": ("s5", 1), "s7": ("s7", 1), "s8": ("s8", 1)}
    assert draft_groups(draft.limit(0), users.limit(0)).count() == 0


def test_proportional_splits(spark):
    r = random.Random(9)
    rows = [(f"k{i}", f"g{r.randint(0, 2500)}") for i in range(6000)] + [(f"b{i}", "giant") for i in range(900)] + [("z", None), (None, "g1")]
    got = proportional_splits(spark.createDataFrame(rows, "state_id string, group_id string")).collect()
    assert len(got) == 6900 and len({(x["group_id"], x["split"]) for x in got}) == len({x["group_id"] for x in got})
    share = {s: sum(x["split"] == s for x in got) / 6900 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert proportional_splits(spark.createDataFrame([], "state_id string, group_id string")).count() == 0
    rows = [(f"k{i}", f"g{i // 2}") for i in range(4000)] + [(f"b{i}-{j}", f"big{i}") for i in range(30) for j in range(60)]
    got = proportional_splits(spark.createDataFrame(rows, "state_id string, group_id string")).collect()
    assert len({x["split"] for x in got if x["group_id"].startswith("big")}) == 3  # groups of one percent fall in every split
    share = {s: sum(x["split"] == s for x in got) / len(rows) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01


# ---- tokenizer


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")
def test_bpe_equals_library_and_round_trips(spark):
    import tiktoken

    ranks = load_ranks(RANKS)
    from marlpit.llm.bpe import SPLIT

    other = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    back = {i: b for b, i in ranks.items()}
    r = random.Random(2)
    texts = ["", " ", "a", "don't stop", "naïve café 😀 한국어 \t\n  x", "<|endoftext|>", "aaaaaaaa" * 700, "ab" * 3000] + ["".join(r.choice("ab \n'sé1!中") for _ in range(r.randint(1, 90))) for _ in range(300)]
    enc = Encoder(ranks, room=50)
    for t in texts:
        ids = enc.encode(t)
        assert ids == other.encode_ordinary(t) and b"".join(back[i] for i in ids).decode() == t
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi there"), (3, "hi there")], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = sorted((x["doc_id"], list(x["ids"])) for x in encode_table(df, "doc_id", "text", RANKS).collect())
    assert got == [(1, []), (2, []), (3, other.encode_ordinary("hi there"))] + [(3, other.encode_ordinary("hi there"))]


# ---- leaks


def test_leaks(spark):
    r = random.Random(4)
    shared = "Answer with yes or no and nothing else please now."
    items = [(i, "dev", " ".join(_sentence(r, 14) for _ in range(4)) + " " + shared) for i in range(12)] + [(98, "dev", None), (99, "dev", "")]
    noise = lambda n: " ".join(_sentence(r, 10) for _ in range(n))
    w = {i: t.split() for i, _, t in items if t}
    altered = list(w[2][3:35])
    for k in (6, 15, 24):
        altered[k] = "zzz"
    docs = [
        (1, noise(3) + " " + " ".join(w[0][5:30]) + " " + noise(3)), (2, " ".join(w[1][10:30]).upper().replace(" ", "  ,  ")), (3, noise(30) + " " + " ".join(altered) + " " + noise(25)),
        (4, " ".join(w[3][4:18]) + " " + noise(4)), (5, shared * 5), (6, None), (7, ""), (8, noise(9)), (1, " ".join(w[4][:40])), (9, " ".join(w[5][:26]).replace("a", "а").replace(" ", "​ ")),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("k", F.lit(1))
    it = spark.createDataFrame(items, "test_id bigint, split string, text string")
    want = {(1, 0), (2, 1), (3, 2), (1, 4), (9, 5)}
    found = leaks(df, "doc_id", "text", it, "test_id", "text")
    assert {tuple(x) for x in found.collect()} == want
    counts = {x["test_id"]: x["n_docs"] for x in leak_counts(found, it, "test_id", "split").collect()}
    assert counts[0] == 1 and counts[3] == 0 and len(counts) == 14
    assert leaks(df.limit(0), "doc_id", "text", it, "test_id", "text").count() == 0
    assert leaks(df, "doc_id", "text", it.limit(0), "test_id", "text").count() == 0


def test_leaks_of_shortest_passages(spark, monkeypatch):
    """Passages of 20 words, two of them altered, at every offset of an item and of a long document; and a very long item."""
    r = random.Random(14)
    item = [_sentence(r, 1)[:-1].lower() + f"x{i}" for i in range(70)]
    docs = []
    for o in range(51):
        part = item[o : o + 20]
        part[6] = part[13] = "zzz"
        docs.append((o, _sentence(r, 20 + o) + " " + " ".join(part) + " " + _sentence(r, 200)))
    docs += [(100 + o, " ".join(item[o : o + 19]) + " " + _sentence(r, 30)) for o in range(5)]
    long = " ".join(_sentence(r, 9) for _ in range(4000))
    docs.append((200, long[5000:6000]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = leaks(df, "doc_id", "text", spark.createDataFrame([(1, " ".join(item)), (2, long)], "test_id bigint, text string"), "test_id", "text")
    want = {(o, 1) for o in range(51)} | {(200, 2)}
    assert {tuple(x) for x in found.collect()} == want
    monkeypatch.setattr(leak, "FEW_WORDS", 0)  # the way of large item sets
    found = leaks(df, "doc_id", "text", spark.createDataFrame([(1, " ".join(item)), (2, long)], "test_id bigint, text string"), "test_id", "text")
    assert {tuple(x) for x in found.collect()} == want


def test_run_of_kept_words():
    r = np.random.default_rng(6)
    for _ in range(300):
        same = r.random(r.integers(5, 60)) < 0.85
        n = len(same)
        want = any(same[i] and same[j - 1] and (~same[i:j]).sum() * leak.ALTERED <= j - i for i in range(n) for j in range(i + leak.RUN, n + 1))
        assert leak._run(same) == want


# ---- overlaps of splits


def test_cross_split_pairs_against_brute_force(spark):
    r = random.Random(6)
    def state(seed: int) -> list[str]:
        q = random.Random(seed)
        return ["Head:"] + [_sentence(q, 9) for _ in range(8)] + ["", "Tail:"] + [_sentence(q, 11) for _ in range(5)]
    rows = []
    for i in range(40):
        base = state(i)
        rows.append((f"t{i:02d}", "\n".join(base), "train"))
        kind = i % 8
        if kind == 0:
            other = base
        elif kind == 1:
            other = [base[0], *r.sample(base[1:9], 8), *base[9:]]
        elif kind == 2:
            other = [x.upper().replace(".", " !") for x in base]
        elif kind == 3:
            other = [" ".join("changed" if r.random() < 0.03 else w for w in x.split()) for x in base]
        elif kind == 4:
            other = [" ".join("changed" if r.random() < 0.5 else w for w in x.split()) for x in base]
        elif kind == 5:
            other = base + state(900 + i)
        else:
            other = state(500 + i)
        rows.append((f"e{i:02d}", "\n".join(other), r.choice(["dev", "test"])))
    rows += [("n1", None, "dev"), ("n2", "", "train"), ("n3", " \n ", "dev"), ("x1", "Short text", "train"), ("x2", "short  TEXT", "dev"), ("s", "\n".join(state(0)), None), rows[0]]
    df = spark.createDataFrame(rows, "id string, state string, shard string").withColumn("source", F.lit("src")).withColumn("side", F.lit(7))
    body = {k: "\n".join(" ".join(w) for w in lines_of(t)) for k, t, _ in rows if t and lines_of(t)}
    side = {k: s for k, _, s in rows}
    want = {
        (min(a, b), max(a, b)) for a in body for b in body if side[a] == "train" and side[b] not in ("train", None) and containment(body[a], body[b]) >= 0.9
    }
    got = {tuple(x) for x in cross_split_pairs(df, "id", "state", "shard").collect()}
    assert got == want and len(want) >= 25 and ("x1", "x2") in got
    links = state_links(*cross_split_classes(df, "id", "state", "shard"))
    n = overlap_counts(links, df, "id", "shard", "source").agg(F.sum("n_records")).first()[0]
    assert n == len({x for p in want for x in p if side[x] != "train"})
    assert cross_split_pairs(df.limit(0), "id", "state", "shard").count() == 0


def test_cross_split_pairs_with_common_phrases(spark):
    """Records whose rarest phrases stand in unrelated records too: none of the pairs may be lost to those."""
    r = random.Random(16)
    frames = [_sentence(random.Random(100 + i), 45) for i in range(3)]  # many records have these
    rows = []
    for i in range(12):
        base = frames[i % 3] + "\n" + _sentence(random.Random(200 + i), 75)
        for j in range(4):
            own = _sentence(r, 12)
            rows.append((f"{'e' if j == 0 else 't'}{i:02d}{j}", base + "\n" + own, "dev" if j == 0 else "train"))
            rows.append((f"u{i:02d}{j}", own + "\n" + _sentence(r, 90), "train" if j == 0 else "dev"))
    for i in range(20):  # two of twenty words changed: no eight that stand together are kept
        words = _sentence(r, 20).split()
        rows += [(f"p{i:02d}", " ".join(words), "train"), (f"q{i:02d}", " ".join(f"x{i}y{k}" if k in (6, 13) else w for k, w in enumerate(words)), "test")]
    body = {k: "\n".join(" ".join(w) for w in lines_of(t)) for k, t, _ in rows}
    side = {k: s for k, _, s in rows}
    want = {(min(a, b), max(a, b)) for a in body for b in body if side[a] == "train" and side[b] != "train" and containment(body[a], body[b]) >= 0.9}
    got = {tuple(x) for x in cross_split_pairs(spark.createDataFrame(rows, "id string, state string, shard string"), "id", "state", "shard").collect()}
    assert len(want) >= 56 and got == want


def test_questions_are_looked_up_by_their_rarest_words():
    """Few of the asked phrases have lists that a text walks through, and no text that has nine tenths of a class is lost for it."""
    r = random.Random(31)
    pool = [_sentence(random.Random(3000 + i), 9) for i in range(60)]
    bodies = ["\n".join(r.sample(pool, 15)) for _ in range(80)]
    bodies += ["\n".join(" ".join(f"w{i}" if r.random() < 0.07 else w for w in x.split()) for x in b.split("\n")) for i, b in enumerate(bodies[:30])] + ["short", "Short\n" + bodies[0]]
    bodies = ["\n".join(" ".join(w) for w in lines_of(b)) for b in bodies]
    side = [1 + i % 2 for i in range(80)] + [2 - i % 2 for i in range(30)] + [3, 2]
    h = next(overlap._hashed([pd.DataFrame({"form": range(len(bodies)), "side": side, "body": bodies})], np.ones(overlap.CELLS, dtype=bool)))
    count = {s: collections.Counter(g for x, y in zip(h["grams"], side) if s & y for g in x.tolist()) for s in (1, 2)}
    other = {1: count[2], 2: count[1], 3: count[1] + count[2]}
    rows = []
    for form, s, lens, grams, places in zip(h["form"], side, h["lens"], h["grams"], h["places"]):
        phrases = grams[places]
        asked = overlap.questions(np.array(lens), phrases, np.array([other[s][g] for g in phrases.tolist()]), 0.9)
        rows += [(form, s, *asked)] if asked else []
    form, s, need, asked, front, *parts = zip(*rows)
    sizes = np.array([len(g) for g in parts[0]])
    known = overlap.Questions(*map(np.array, (form, s, need, asked, front)), sizes, *map(np.concatenate, parts))
    text, got = known.answer(side, list(h["grams"]))
    got = set(zip(text.tolist(), got.tolist()))
    pairs = [(a, b) for a in range(len(bodies)) for b in range(len(bodies)) if a != b and (side[a] | side[b]) == 3]
    lines = [[x.split() for x in b.split("\n")] for b in bodies]
    phrases = [[(len(w), list(zip(*(w[k:] for k in range(min(3, len(w))))))) for w in x] for x in lines]
    want = {(a, b) for a, b in pairs if overlap._covered(phrases[b], overlap._phrases(lines[a])) >= 0.9}
    assert len(want) >= 20 and want <= got and len(got) < len(pairs) / 10
    assert 2 * len(known.entry) < len(known.code)  # lists hold less than half of what is asked


def test_cross_split_users(spark):
    rows = [("a", "U-1", "train"), ("b", "u1 ", "dev"), ("c", "u1", "dev"), ("d", None, "dev"), ("e", "u2", "train"), ("b", "u1", "dev"), ("f", "u1", None)]
    got = {tuple(x) for x in cross_split_users(spark.createDataFrame(rows, "state_id string, user_id string, shard string")).collect()}
    assert got == {("a", "b"), ("a", "c")}
    rows += [("g", "u1", "train"), ("b", "u1", "train")]
    df = spark.createDataFrame(rows, "state_id string, user_id string, shard string")
    links = {x["k"]: x["n_links"] for x in user_links(df).collect()}
    assert links == {"b": 2, "c": 3} and user_links(df.limit(0)).count() == 0


def test_links_of_copies_equal_the_expanded_pairs(spark):
    """Many copies on both sides, near-copies, and a record in both splits: links are counted from class sizes."""
    r = random.Random(21)
    base = [_sentence(r, 30) for _ in range(5)]
    rows = [(f"t{i:02d}{j}", "train", b) for i, b in enumerate(base) for j in range(4)] + [(f"e{i:02d}{j}", "dev", b.upper()) for i, b in enumerate(base) for j in range(3)]
    rows += [(f"n{i}", "test", " ".join(b.split()[:-1])) for i, b in enumerate(base)] + [("both", "train", base[0]), ("both", "dev", base[0]), ("none", "dev", None), ("lone", "dev", _sentence(r, 20))]
    df = spark.createDataFrame(rows, "id string, shard string, state string")
    pairs = cross_split_pairs(df, "id", "state", "shard").collect()
    want: dict = {}
    evals = {k for k, s, _ in rows if s != "train"}
    trains = {k for k, s, _ in rows if s == "train"}
    for a, b in pairs:
        for e, t in ((a, b), (b, a)):
            if e in evals and t in trains:
                want[e] = want.get(e, 0) + 1
    got = {x["k"]: x["n_links"] for x in state_links(*cross_split_classes(df, "id", "state", "shard")).collect()}
    assert got == want and got["e000"] == 5 and got["both"] == 4 and got["n1"] == 4


# ---- cut texts


def test_cut_rows(spark):
    r = random.Random(8)
    nouns, verbs, ends = "kettle lamp chair table spoon blanket".split(), "arrived broke worked leaked wobbled".split(), "yesterday again slowly badly nicely".split()
    line = lambda: f"The {r.choice(nouns)} from the {r.choice(nouns)} shop {r.choice(verbs)} {r.choice(ends)}."
    rows = [("t", f"r{i}", "s", " ".join(line() for _ in range(4))) for i in range(400)]
    rows += [("t", f"bare{i}", "s", (line() + " " + line())[:-1]) for i in range(40)]
    cut = [("t", "c1", "s", line() + " The kettle from the bla"), ("t", "c2", "s", line() + " The lamp from the"), ("t", "c3", "s", line() + " The chair ... (more)"), ("t", "c4", "s", line() + " The spoon from th�")]
    full = " ".join(line() for _ in range(9))
    cut += [("t", "c5", "s", full[: full.rfind(" ") + 3])]
    fine = [("t", "f1", "s", full), ("t", "f2", "s", line() + " thumbs up"), ("t", "f3", "s", line()[:-1] + " ..."), ("t", "f4", "s", line() + " 🍰"), ("t", "f5", "s", None), ("t", "f6", "s", "  ")]
    rows += [("t", f"signed{i}", "s", line() + " thumbs up") for i in range(30)]
    df = spark.createDataFrame(rows + cut + fine, "tbl string, row_key string, source string, text string").withColumn("cut", F.lit(1)).withColumn("key", F.lit(1))
    judged = cutoff.cut_rows(df).cache()
    assert {x["row_key"] for x in cutoff.cut_found(judged).collect()} == {x[1] for x in cut}
    rate = cutoff.cut_rates(judged).first()
    assert rate["n_texts"] == len(rows) + len(cut) + 4 and rate["n_cut"] == len(cut)
    assert cutoff.cut_rows(df.limit(0)).count() == 0


def test_cut_copy_behind_a_longer_text(spark):
    """The full copy of a cut text is not the longest of its bucket, or has a word more: the cut text is found by it."""
    r = random.Random(17)
    rows, cut = [], set()
    for i in range(8):
        words, more = _sentence(r, 44)[:-1].split(), _sentence(r, 70)[:-1].split()
        rows += [(f"full{i}", " ".join(words) + " " + _sentence(r, 5)), (f"cut{i}", " ".join(words[:-2])), (f"long{i}", " ".join(words[:-2]) + ". " + _sentence(r, 14))]
        rows += [(f"more{i}", " ".join([*more[:3], "really", *more[3:]]) + "."), (f"less{i}", " ".join(more[:-2]))]
        cut |= {f"cut{i}", f"less{i}"}
        rows += [(f"end{i}{j}{k}", _sentence(r, 4)[:-1] + " " + " ".join(w[-4:-2]) + ".") for j in range(6) for k, w in enumerate((words, more))]
    df = spark.createDataFrame([("t", k, "s", t) for k, t in rows], "tbl string, row_key string, source string, text string")
    assert {x["row_key"] for x in cutoff.cut_found(cutoff.cut_rows(df)).collect()} == cut


def test_cut_short_rest_of_a_long_text(spark):
    """A rest of a fifth of its text is found by its opening; a copy that ends with a sentence of the longer text is complete."""
    r = random.Random(23)
    rows, cut = [], set()
    for i in range(6):
        words = [_sentence(r, 6)[:-1].split() for _ in range(12)]
        full = " ".join(" ".join(w) + "." for w in words)
        rows += [(f"full{i}", full), (f"cut{i}", " ".join(full.split()[:15])), (f"whole{i}", " ".join(full.split()[:24])[:-1])]
        cut.add(f"cut{i}")
    rows += [("token", "x" * 50_000 + " " + "y" * 30_000), ("blank", "\u00a0\n"), ("null", None)]
    df = spark.createDataFrame([("t", k, None, t) for k, t in rows], "tbl string, row_key string, source string, text string")
    judged = cutoff.cut_rows(df).collect()
    assert {x["row_key"] for x in judged if x["cut"]} == cut and len(judged) == len(rows) - 2


def test_running_minima_of_openings():
    r = np.random.default_rng(3)
    w = r.integers(1, 1 << 60, 90, dtype=np.uint64)
    sizes = [np.array(cutoff.windows(n)) for n in (90, 30)]
    together = cutoff.Openings().keys(w, np.array([0, 5]), sizes)
    alone = [cutoff.Openings().keys(w[o : o + n], np.array([0]), [np.array([n])])[0] for o, s in zip((0, 5), sizes) for n in s]
    assert (together == np.stack(alone)).all() and all(cutoff.opening(n) == max(cutoff.windows(n), default=0) for n in range(400))


def test_sign_offs_are_ends():
    for text in ("It broke. Regards, Zellwinger, Gideon", "Nett. Grüße, B. Bellweather", "From: ANNA ROE"):
        assert cutoff.SIGNED.search(text), text
    for text in ("It broke. Un saludo, the manage", "The from Anna came to", "Regards, and the"):
        assert not cutoff.SIGNED.search(text), text


def test_aligned():
    assert cutoff._aligned("a b c d e f g h i j k l m".split(), "a b c x d e f g h i j k l m n".split()) == 13
    assert cutoff._aligned("a b c d".split(), "a x c d".split()) is None
    assert cutoff._aligned("a b".split(), "a bc".split()) == 1


# ---- personal information


def test_field_finds_held_out_values():
    held = pii.examples(seed=99, n=300)
    field = pii.Field(pii.trained_weights(), held[0][2], held[0][2], frozenset(held[0][3]))
    right = found = gold = 0
    for text, spans, _, _ in held:
        got = {(a, b, k) for a, b, k in field.decode(text)}
        want = {tuple(s) for s in spans}
        right += sum(any(k == q and a < y and x < b for a, b, k in got) for x, y, q in want)
        found += sum(any(k == q and a < y and x < b for x, y, q in want) for a, b, k in got)
        gold += len(want)
    total = sum(len(field.decode(t)) for t, *_ in held)
    assert right / gold > 0.9 and found / total > 0.9


def test_candidates_of_rare_spellings():
    field = pii.Field({}, {"smith", "john"})
    for kind, value in [
        ("id_number", "QQ123456C"), ("id_number", "QQ-12-34-56-C"), ("id_number", "AB123456"), ("person_name", "J.Smith"), ("person_name", "Dr.Smith"),
        ("email", "jo [ at ] mail.example"), ("email", "jo ( at ) mail.example"), ("phone", "five-five-five-one-two-three-four"),
    ]:
        text = f"well it was {value} then"
        assert (kind, value) in {(k, text[a:b]) for a, b, k, _ in field.candidates(text)}, value
    assert not field.candidates("we came at 10:30 on 2024-01-02 and had 12 of them")


def test_find_personal(spark):
    names = [(f"n{i}", f"We met Alda Fontayne and {w} there.") for i, w in enumerate(["Corwin Drummock", "Petra Ironmoor"] * 6)]
    rows = names + [
        ("e", "Write to jo.ann@mail.example today"), ("o", "jo dot ann at mail dot example"), ("p", "Call (418) 555-0105 after six."), ("i", "SSN 977-29-0741"),
        ("a", "I live at 12 Rosewood Lane, ok"), ("s", "regards, petra ironmoor"), ("once", "It was signed by Zbigniew Kowalczyk on Monday."), ("z1", None), ("z2", ""), ("z3", "order 77-10-2931 and [EMAIL] @shopname"), ("z4", "The Hugo Larkin lamp"), ("z4", "The Hugo Larkin lamp"),
    ]
    df = spark.createDataFrame(rows, "row_key string, text string").withColumn("tbl", F.lit("t")).withColumn("kind", F.lit("x"))
    brands = pii.brand_names(spark.createDataFrame([("Hugo Larkin lamp",), ("hugo  larkin kettle 2",)] * 3 + [("Alda Fontayne chair",), (None,), ("",)], "name string"))
    found = {(x["row_key"], x["kind"]) for x in pii.find_personal(df, brands).collect()}
    assert found == {(k, "person_name") for k, _ in names} | {("e", "email"), ("o", "email"), ("p", "phone"), ("i", "id_number"), ("a", "street_address"), ("s", "person_name"), ("once", "person_name")}
    text = {x["row_key"]: x["text"] for x in pii.find_personal(df, brands, redacted=True).collect()}
    assert text["e"] == "Write to [EMAIL] today" and text["p"] == "Call [PHONE] after six." and text["a"] == "I live at [STREET_ADDRESS], ok"
    assert text["z1"] is None and text["z2"] == "" and text["z3"] == rows[-3][1] and text["s"] == "regards, [PERSON_NAME]"
    assert pii.find_personal(df.limit(0), brands).count() == 0


# ---- abuse


def test_abuse_on_held_out_documents(spark):
    r = random.Random(7)
    plain = lambda: f"The {r.choice(WORDS)} was {r.choice(['nice', 'cold', 'loud', 'stupid', 'heavy'])} and the {r.choice(WORDS)} came late."
    bad = lambda: r.choice(["You are a {} and nobody likes you.", "Get lost, you {} fool.", "All you {} people should vanish."]).format(r.choice(["stupid", "worthless", "filthy", "rotten"]))

    def doc(a: int) -> str:
        s = [plain() for _ in range(r.randint(2, 6))]
        if a:
            s.insert(r.randint(0, len(s)), bad())
        return " ".join(s)

    def noisy(a: int) -> float:
        return float(a if r.random() > 0.04 else 1 - a)

    labels = [int(r.random() < 0.2) for _ in range(700)]
    model = abuse.train([doc(a) for a in labels], [noisy(a) for a in labels])
    truth = [int(r.random() < 0.2) for _ in range(300)]
    score = model.score([doc(a) for a in truth])
    flagged = score >= abuse.REVIEW
    assert flagged[np.array(truth) == 1].mean() > 0.9 and flagged[np.array(truth) == 0].mean() < 0.03
    assert model.score(["Yоu are a w0rthl3ss and nоbоdy likes yоu.", "Y​ou ar​e a filthy and nobody likes you."]).min() > 0.5
    assert model.score([None, "", " \n"]).tolist() == [0, 0, 0]
    df = spark.createDataFrame([(1, "a", doc(1)), (2, None, None), (2, None, None)], "doc_id bigint, source string, text string")
    assert sorted(x["doc_id"] for x in abuse.score_documents(df, model).collect()) == [1, 2, 2]
    empty = abuse.fit_abuse(df, spark.createDataFrame([], "doc_id bigint, abusive int"))
    assert max(x["score"] for x in abuse.score_documents(df, empty).collect()) < 0.1
    assert abuse.abuse_rates(abuse.score_documents(df, model)).agg(F.sum("n_docs")).first()[0] == 3
