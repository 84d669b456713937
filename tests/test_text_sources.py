"""Text expressions, ranks, release operators and sources on small fixtures with dirt."""

from __future__ import annotations

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from marlpit.functions import text as tx
from marlpit.operators import evaluation as ev
from marlpit.operators import ranking as rk
from marlpit.operators import release as rl
from marlpit.sources import delimited, jsonl


def _one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_clips_and_titles(spark):
    assert _one(spark, tx.clip("t", 5), t="  abcdef ") == "abcd…" and _one(spark, tx.clip("t", 5), t=None) == ""
    assert _one(spark, tx.clip_words("t", 9), t="aa  bb cc dd") == "aa bb cc [...]" and _one(spark, tx.clip_words("t", 9), t="abcdefghijkl") == "abcdefghi [...]"
    assert _one(spark, tx.clip_words("t", 9), t="aa   bb  c") == "aa bb c" and _one(spark, tx.clip_words("t", 9), t=None) is None
    assert _one(spark, tx.merge_title("a", "b"), a="Great", b="great stuff") == "great stuff" and _one(spark, tx.merge_title("a", "b"), a="Great", b="stuff") == "Great\nstuff"
    assert _one(spark, tx.merge_title("a", "b"), a="Only", b=None) == "Only"


def test_numbers_places_dates(spark):
    assert [_one(spark, tx.parse_price("t"), t=x) for x in ("$1,234.50", "1.5d", "0", "-3", "", "12", "inf", None)] == [1234.5, None, None, None, None, 12.0, None, None]
    assert [_one(spark, tx.sign_level("t"), t=x) for x in ("$$$", "$1", "", None)] == [3, None, None, None]
    assert [_one(spark, tx.city_of_address("t"), t=x) for x in ("a, b, c", "x, 1 Road, Town , CA 1", "a, b", None)] == ["b", "Town", None, None]
    assert _one(spark, tx.iso_from_millis("n"), n=1_600_000_000_123) == "2020-09-13T12:26:40Z"
    assert [_one(spark, tx.is_airport_code("t"), t=x) for x in ("OSL", "osl", "OSLO", None)] == [True, False, False, False]
    assert _one(spark, tx.money("n"), n=1234.5) == "$1,234.50" and _one(spark, tx.money("n", False), n=1234.4) == "$1,234"
    assert _one(spark, tx.suffix_index("t"), t="a/b/17") == 17 and _one(spark, tx.suffix_index("t"), t="a/b/x") is None


def test_options_and_probabilities(spark):
    labels = lambda kind, n: _one(spark, tx.option_labels("k", F.lit(n)), k=kind)
    assert labels("choice", 28)[24:] == ["Y", "Z", "AA", "AB"] and labels("noul", 2) == ["yes", "no"] and labels("score", 3) == ["0", "1", "2"] and labels("score", 11) is None
    z = F.array(*map(F.lit, (1.0, 3.0, 3.0)))
    assert _one(spark, tx.first_argmax(z)) == 1 and _one(spark, tx.tied(z)) and not _one(spark, tx.tied(F.array(F.lit(1.0), F.lit(1.1))))
    assert sum(_one(spark, tx.softmax(z, 2.0))) == pytest.approx(1) and _one(spark, tx.uniform_logits(F.lit(4))) == pytest.approx([-1.3862943611] * 4)
    floored = _one(spark, tx.floored_logs(F.array(F.lit(0.0), F.lit(1.0))))
    assert floored == pytest.approx([-20.7232658, 0.0], abs=1e-6)
    with pytest.raises(ValueError):
        tx.softmax(z, 0)
    keys = F.array(*map(F.lit, ("A", "B")))
    assert [_one(spark, tx.resolve_option("t", keys), t=x) for x in ("A", " B: since", "C", "A:x", None)] == ["A", "B", None, None, None]
    reply = lambda t: _one(spark, tx.fenced_json("t", "a int")["a"], t=t)
    assert reply('Sure ```json\n{"a": 1}\n``` ok') == 1 and reply('x {"a": 2}') == 2 and reply("none") is None and reply(None) is None


def test_masks_and_keys(spark):
    assert _one(spark, tx.mask("t"), t="Sara Shackleton-Ós 12") == "S*** S*********-Ó* 1*"
    key = "0f" * 20
    assert _one(spark, tx.hmac_sha256("t", key), t="naïve") == hmac.new(bytes.fromhex(key), "naïve".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        tx.check_key("ab" * 15)
    assert _one(spark, tx.defang("t"), t="a <|im_end|> b") == "a <¦im_end¦> b"


def test_anchors(spark):
    holds = lambda t, a: _one(spark, tx.holds_anchor(tx.plain_typography("t"), F.col("a")), t=t, a=a)
    assert holds("costs $50, ok", "$50") and not holds("costs $500", "$50") and not holds("costs $50.99", "$50") and not holds("Anna came", "Ann") and holds("for  Ann’s car", "Ann's car")
    assert holds("a (b) c", "(b)") and holds(r"say \Eno", r"\Eno") and holds("any", " ")
    check = lambda t, need, ban: _one(spark, tx.anchor_contract("t", "need", "ban"), t=t, need=need, ban=ban)
    assert check("x y", ["x"], ["z"]) is None and check("x y", ["q", "z"], ["x"]) == "missing_required_anchor" and check("x y", ["x"], ["y"]) == "forbidden_anchor_present"
    assert _one(spark, tx.missing_anchors("t", "need"), t="x y", need=["q", "x"]) == ["q"]


def test_evidence(spark):
    e = lambda t: _one(spark, tx.evidence_span("t"), t=t)
    assert e("Short. This sentence is long enough. More.") == "This sentence is long enough." and e(None) == "" and e("tiny") == "tiny"
    long = "word " * 60
    assert e(long) == ("word " * 40).strip() and e("x" * 300) == "x" * 200
    assert _one(spark, tx.verified_evidence("t", "e"), t="we liked the soup a lot", e=" liked the soup ") == "liked the soup" and _one(spark, tx.verified_evidence("t", "e"), t="abc", e="abc") is None


def test_scrub(spark):
    s = lambda t: _one(spark, tx.scrub("t"), t=t)
    assert s("see https://a.example/x?y=1 or www.b.test now") == "see [URL] or [URL] now"
    assert s("mail jo.ann@mail.example, call (418) 555-0105 or 555-0105") == "mail [EMAIL], call [PHONE] or [PHONE]"
    assert s("ask Kay Mann/Corp/Acme@ACME today") == "[EMAIL] today" or "[EMAIL]" in s("ask Kay Mann/Corp/Acme@ACME today")
    assert s("Jane Roe @ ACME wrote") == "[EMAIL] wrote" and s(None) is None and s("no 12345678 here") == "no 12345678 here"


def test_ranks_and_batches(spark):
    r = random.Random(3)
    rows = [(i, hashlib.sha256(str(i % 70).encode()).hexdigest()) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, None)], "i long, h string")
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert {x["i"]: x["rank"] for x in rk.global_rank(df, "h", "i", digits=1).collect()} == want
    assert [x["i"] for x in rk.first_by(df.na.drop(), 5, "h", "i").orderBy("place").collect()] == [i for i, n in sorted(want.items(), key=lambda x: x[1])[:5]]
    sizes = spark.createDataFrame([(i, r.randint(1, 50)) for i in range(200)] + [(500, 900), (501, None)], "id long, n int")
    got = rk.budget_batches(sizes, "id", "n", 200).groupBy("batch").agg(F.max("n").alias("m"), F.count("*").alias("c")).collect()
    assert sum(x["c"] for x in got) == 201 and all(x["m"] * x["c"] <= 200 or x["c"] == 1 for x in got)
    quota = {x["g"]: x["quota"] for x in rk.water_filled(spark.createDataFrame([("a", 3), ("b", 50), ("c", 10)], "g string, available long"), "g", 30).collect()}
    assert quota == {"a": 3, "c": 10, "b": 17}


def test_spans_and_release(spark):
    rules = [(k, __import__("re").compile(p)) for k, p in rl.RULES.items()]
    got = [t for t in rl.spans_of("Dr. Anna Roe (anna@mail.example) at 12 Oak Road, 418-555-0105, see http://x.test/a.", rules)]
    assert [k for k, _, _ in got] == ["person_name", "email", "street_address", "phone", "url"]
    assert rl.spans_of("Mr. Bill Dog Toy", rules, ["Mr. Bill Dog Toy"]) == [] and rl.spans_of("Mr. Bill", rules, (), frozenset(["Mr. Bill"])) == []
    df = spark.createDataFrame([(1, "Mrs. Anna Roe wrote to anna@mail.example. Mrs. Anna Roe!", ["Mrs. Anna Roe"], ["zzz"]), (2, None, None, None), (3, "", [], []), (4, "Dr. Pepper here", ["Dr. Pepper"], ["Dr. Pepper"])], "id int, t string, need array<string>, keep array<string>")
    out = {x["id"]: x for x in rl.released(df, "id", "t", "need", "keep", "aa" * 16, ["Nora", "Ilse"], ["Vale", "Marsh"]).collect()}
    name = rl.pseudonym("Mrs. Anna Roe", "aa" * 16, ["Nora", "Ilse"], ["Vale", "Marsh"])
    assert name.startswith("Mrs. ") and out[1]["text"] == f"{name} wrote to [EMAIL]. {name}!" and out[1]["required"] == [name] and out[1]["broken"] is None
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == "Dr. Pepper here"
    assert rl.substitute("Ann met Anna and Ann-Marie", {"Ann": "X", "Ann-Marie": "Y"}) == "X met Anna and Y"
    tally = {x["kind"]: tuple(x)[1:] for x in rl.spans_tally(rl.find_spans(df, "id", "t", "keep")).collect()}
    assert tally == {"person_name": (2, 1, 1), "email": (1, 1, 1)}


def test_question_rules(spark):
    crit = lambda *ks: [{"key": k, "desc": None} for k in ks]
    q = lambda qid, kind, ks, key, idx, soft=None, src="set/fam": {"qid": qid, "type": kind, "instructions": "i", "criteria": crit(*ks), "label_key": key, "label_idx": idx, "src": src, "soft_label": soft}
    soft = lambda *ps: [{"key": k, "p": p} for k, p in ps]
    rows = [
        ("r1", "s", {"c": "own"}, [q("a", "choice", ["x", "y"], "y", None), q("b", "noul", [], "true", None), q("c", "score", ["1", "2", "3"], "3", 2), q("d", "choice", ["x", "y"], "q", None)]),
        ("r1", "s", None, [q("a", "choice", ["x", "y"], "x", None)]),
        ("r2", None, None, [q("a", "choice", ["x", "y", "z"], "x", 0, soft(("y", 1.0), ("z", 3.0))), q("b", "choice", ["x", "y"], "x", 0, soft(("x", 0.5), ("y", 0.5))), q("c", "choice", ["x"], "x", 0, soft(("w", 1.0))), q("d", "choice", ["x"], "x", 0, soft(("x", -1.0)))]),
        ("r3", None, None, None), (None, None, None, [q("a", "choice", ["x"], "x", 0)]),
    ]
    kind = "id string, state_id string, families map<string,string>, questions array<struct<qid string, type string, instructions string, criteria array<struct<key string, desc string>>, label_key string, label_idx int, src string, soft_label array<struct<key string, p double>>>>"
    got = {(x["record_id"], x["qid"]): x for x in ev.questions(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == 8
    assert got["r1", "c"]["family"] == "own" and got["r1", "a"]["copies"] == 2 and got["r1", "b"]["keys"] == ["false", "true"] and got["r1", "b"]["label"] == 1 and got["r1", "c"]["label"] == 2
    assert got["r1", "d"]["label"] is None and got["r1", "b"]["family"] == "fam" and got["r2", "a"]["state_id"] == "r2"
    assert got["r2", "a"]["target"] == [0.0, 0.25, 0.75] and got["r2", "a"]["label"] == 2 and not got["r2", "a"]["ambiguous"] and got["r2", "b"]["ambiguous"]
    assert got["r2", "c"]["target"] is None and got["r2", "d"]["target"] is None
    bad = {x["check"]: x["n"] for x in ev.question_violations(ev.questions(spark.createDataFrame(rows, kind))).collect()}
    assert bad == {"bad_label": 3, "twice": 1, "no_family": 0, "no_options": 0}
    none = ev.questions(spark.createDataFrame([], kind))
    assert ev.report(ev.scored(none, ev.stand_in_predictions(none, "x")), 0.5).filter("scope = 'family'").count() == 0


def test_threshold_takes_the_last_feasible_prefix(spark):
    """One error among the first ten is too many, but not among forty; ties of confidence go in together."""
    conf = [0.99, 0.98] + [0.9] * 38 + [0.5] * 10
    rows = [(f"r{i}", "a", "s", "f", c, False, i not in (1,) and c > 0.6) for i, c in enumerate(conf)]
    s = spark.createDataFrame(rows, "record_id string, qid string, state_id string, family string, conf double, ambiguous boolean, correct boolean")
    x = ev.select_threshold(s, ["family"]).first()
    assert (x["threshold"], x["accepted"], x["errors"], x["n"]) == (0.9, 40, 1, 50)
    none = ev.select_threshold(s.withColumn("correct", F.lit(False)), ["family"]).first()
    assert none["threshold"] is None and none["accepted"] == 0
    assert ev.select_threshold(s, ["family"], least=41).first()["threshold"] is None


def test_delimited(spark, tmp_path):
    (tmp_path / "a.dat").write_text('1,"Goroka, ""East""","Goroka",\\N,"GKA","AYGA",-6.08,145.39,5282,10,"U",\\N,"airport","x"\n2,"",,"PNG","\\N","",abc,1.5d,7.5,,,,,\n3,"short"\n')
    got = {r["airport_id"]: r for r in delimited.read_delimited(spark, str(tmp_path / "a.dat"), delimited.AIRPORTS).collect()}
    assert got[1]["name"] == 'Goroka, "East"' and got[1]["country"] is None and got[1]["latitude"] == -6.08 and got[1]["altitude"] == 5282
    assert got[2]["name"] is None and got[2]["iata"] is None and got[2]["latitude"] is None and got[2]["longitude"] is None and got[3]["city"] is None
    (tmp_path / "r.dat").write_text("2B,410,AER,2965,KZN,2990,,0,CR2 737\n2B,\\N,A,,B,,Y,x,\n")
    r = delimited.read_delimited(spark, str(tmp_path / "r.dat"), delimited.ROUTES).collect()
    assert r[0]["equipment"] == ["CR2", "737"] and not r[0]["codeshare"] and r[1]["codeshare"] and r[1]["equipment"] == [] and r[1]["stops"] is None


def test_json_lines(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.jsonl").write_text('{"iata":"A","name":"n","city":"c","country":"d"}\n\n{"iata":"B"}\noops\n{"iata":"A","name":"n","city":"c","country":"d","more":1}\n')
    assert sorted(r["line"] for r in jsonl.malformed_lines(spark, str(d), jsonl.AIRPORTS).collect()) == [3, 4, 5]
    e = tmp_path / "back"
    e.mkdir()
    (e / "1.jsonl").write_text('{"id":"x","text":"one"}\n{"id":"x","text":"two"}\nbad\n')
    (e / "2.jsonl").write_text('{"id":"x","text":"three"}\n{"id":"y","text":"four"}\n{"id":"z"}\n')
    texts, counts = jsonl.returned_texts(spark, str(e))
    assert {tuple(r) for r in texts.collect()} == {("x", "one"), ("y", "four")}
    assert {(r["file"][-7:], r["rows"], r["malformed"], r["repeated"]) for r in counts.collect()} == {("1.jsonl", 3, 1, 1), ("2.jsonl", 3, 1, 1)}
    df = spark.createDataFrame([(i, None if i % 2 else "t") for i in range(10)], "b int, a string")
    assert [json.loads(x[0]) for x in df.limit(1).select(jsonl.canonical_json(df)).collect()] == [{"b": 0, "a": "t"}]
    out = str(tmp_path / "out")
    jsonl.write_jsonl(df, out, "b")
    jsonl.write_jsonl(df.filter("b < 4"), out, "b")
    assert spark.read.json(out).count() == 4 and len(list(tmp_path.glob("out*"))) == 1
    jsonl.write_document(df.limit(1), str(tmp_path / "doc"))
    assert {tuple(r) for r in jsonl.file_digests(spark, str(d)).collect()} == {("a.jsonl", (d / "a.jsonl").stat().st_size, hashlib.sha256((d / "a.jsonl").read_bytes()).hexdigest())}
    jsonl.write_batches(df.repartition(5), str(tmp_path / "parts"), 3, "b")
    parts = {(r["batch"], r["b"]) for r in spark.read.json(str(tmp_path / "parts")).collect()}
    assert parts == {(b // 4, b) for b in range(10)}
    with pytest.raises(PermissionError):
        jsonl.guarded("/data/Hidden/x")


def test_gzip_columns(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"user_id":"u","item_id":"i","rating":4,"timestamp":"t","text":null,"source":"s","other":[1]}\n\n{"user_id":"v"}\n')
    got = jsonl.read_jsonl(spark, str(tmp_path / "r.jsonl.gz"), jsonl.INTERACTIONS).collect()
    assert [(r["user_id"], r["rating"]) for r in got] == [("u", 4), ("v", None)] and "other" not in got[0].asDict()


def test_no_registered_sql_plan_has_a_cartesian_product(spark):
    import __spark_entry__ as entry
    from marlpit.plans import evaluation_queries, pipeline_queries, reference_queries, text_queries

    for m in (reference_queries, pipeline_queries, evaluation_queries, text_queries):
        for name, f in m.QUERIES.items():
            if name in m.SQL and not name.startswith("eval_te"):
                plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
                assert "CartesianProduct" not in plan, name
    assert len(entry.queries()) > 100


def test_extension_points(spark):
    from marlpit.operators import extensions as ex

    df = spark.createDataFrame([(1, "We really liked the warm soup. Bye."), (2, "We really liked the warm soup. Bye."), (3, None), (4, "tiny")], "id int, t string")

    def extract(texts):
        return [("likes soup", "liked the warm soup") if "soup" in x else ("made up", "never said at all") for x in texts]

    got = {r["id"]: r["fact"] for r in ex.with_facts(df, "t", extract).collect()}
    assert got[1]["fact"] == "likes soup" and got[1]["evidence"] == "liked the warm soup" and got[2]["own"] and got[4]["fact"] is None and got[4]["evidence"] == "tiny" and got[3]["evidence"] == ""
    assert {r["id"]: r["state"] for r in ex.rendered(df, "t", lambda x: [v.upper() for v in x]).collect()}[4] == "TINY"
    q = spark.createDataFrame([("r", "a", "p", ["x", "y"])], "record_id string, qid string, prompt string, keys array<string>")
    assert ex.predicted(q, "prompt", lambda p, k: [[0.5] * len(x) for x in k], "mine").first()["logits"] == [0.5, 0.5]
    with pytest.raises(Exception, match="finite"):
        ex.predicted(q, "prompt", lambda p, k: [[float("nan"), 1.0] for _ in k], "mine").collect()
    n = ex.counted_tokens(df, "t", lambda x: x.split())
    assert {r["id"]: r["tokens"] for r in n.collect()} == {1: 7, 2: 7, 3: None, 4: 1} and ex.without_long(n, "tokens", 3).count() == 2


def test_tolerant_reading(spark):
    df = spark.createDataFrame([("-", "b1", '{"a":"x","n":5,"l":[1],"o":{"k":1},"t":true,"z":null}'), ("a2", None, "no json"), (None, " ", None)], "asin string, item_id string, details string")
    got = jsonl.tolerant(df, {"item": ("item_id", "asin", "missing"), "details": ("details",)}, ("item",)).collect()
    assert [r["item"] for r in got] == ["b1", "a2"]
    entries = [r[0] for r in df.select(tx.scalar_entries("details")).collect()]
    assert entries == [{"a": "x", "n": "5"}, {}, {}]
