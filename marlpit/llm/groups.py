"""Splits that keep related records together: connected components, then proportional hash ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.ids import canonical_user, hash_bucket
from marlpit.session import cut, drop_cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """The smallest node of each node's component, by alternating large-star and small-star.

    ``edges`` are unordered pairs of strings. Every star step takes each node's smallest neighbour by a map-side
    combined aggregate and joins it back to the edges; no neighbour list is ever built, and a node that a third of the
    edges touch is one key of a join whose other side has one row per key, which the adaptive skew join splits. After
    each round the edges are written to the shared folder, so lineage stays short and executors may be lost.

    Defined results: edges with a null end and self-loops are left out (their nodes are no rows here unless another
    edge has them); repeated edges count once; no edges give no rows. Returns (node, component).
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut(e, "cc")
    before = None
    for _ in range(max_rounds):
        done = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before is not None and (done["n"], done["s"]) == before:
            break
        before = (done["n"], done["s"])
        nxt = cut(_small_star(_large_star(e)), "cc")
        drop_cut(e)
        e = nxt
    else:
        raise RuntimeError("connected_components: not converged")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def draft_groups(draft: DataFrame, users: DataFrame) -> DataFrame:
    """(state_id, group_id, component) of every draft: drafts of one user, one household or merged accounts share a group.

    Links: user to household, account to the account it was merged into (over any number of steps and through accounts
    without drafts), and the users of one state_id. group_id is the smallest state_id of the group.

    Defined results: ids are compared in one spelling; drafts without state_id are left out; a draft without user forms
    a group of its own; null households and merges link nothing; repeated rows count once.
    """
    d = draft.select("state_id", canonical_user("user_id").alias("uid")).filter("state_id is not null").distinct()
    u = users.select(
        canonical_user("user_id").alias("uid"), F.nullif(F.trim("household_id"), F.lit("")).alias("home"), canonical_user("merged_into").alias("into")
    ).filter("uid is not null")
    links = (
        u.select(F.concat(F.lit("u:"), "uid").alias("a"), F.concat(F.lit("h:"), "home").alias("b"))
        .unionByName(u.select(F.concat(F.lit("u:"), "uid").alias("a"), F.concat(F.lit("u:"), "into").alias("b")))
        .unionByName(_shared_states(d))
    )
    comp = connected_components(links)
    keyed = d.withColumn("node", F.when(F.col("uid").isNotNull(), F.concat(F.lit("u:"), "uid")).otherwise(F.concat(F.lit("s:"), "state_id")))
    full = keyed.join(comp, "node", "left").select("state_id", F.coalesce("component", "node").alias("component")).distinct()
    least = full.groupBy("component").agg(F.min("state_id").alias("group_id"), F.countDistinct("state_id").alias("size"))
    return full.join(least, "component").groupBy("state_id").agg(F.min("group_id").alias("group_id"), F.max("size").alias("size"))


def _shared_states(d: DataFrame) -> DataFrame:
    """Links between the users of one state_id; the smallest user stands for the state."""
    least = d.groupBy("state_id").agg(F.min("uid").alias("m"), F.max("uid").alias("x")).filter("m <> x").select("state_id", "m")
    return d.join(least, "state_id").select(F.concat(F.lit("u:"), "uid").alias("a"), F.concat(F.lit("u:"), "m").alias("b"))


def proportional_splits(
    groups: DataFrame, key: str = "state_id", group: str = "group_id", shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    salt: str = "split-v1", buckets: int = 4096, big: float = 0.002,
) -> DataFrame:
    """(key, group, split): whole groups on hash ranges whose borders are set so that the *records* have the given shares.

    Groups fall into ``buckets`` by the salted hash of their id. A group of more than ``big`` of all records (at most
    ``1 / big`` exist, they reach the driver) goes, the largest first, to the split its own hash range says, or where that
    has no room left, to the split with most room. The borders of the hash ranges then follow from the room that is left
    in each split: running record counts over the buckets (a table of at most ``buckets`` rows) place each bucket in the
    range that holds its middle.

    Defined results: rows with a null key or group are left out, an empty table gives no rows. A group over the largest
    share makes the shares unreachable; it still stays whole.
    """
    rows = groups.filter(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("_k"), F.col(group).alias("_g")).distinct()
    sizes = cut(rows.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_b", hash_bucket(buckets, F.lit(salt), F.col("_g"))), "split")
    total = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    giants = sizes.filter(F.col("_n") > total * big).collect()  # at most 1 / big rows
    placed, room = _place_giants([(r["_g"], r["_n"], (r["_b"] + 0.5) / buckets) for r in giants], shares, total)
    rest = sum(room.values())
    line = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most `buckets` rows
    cells = sizes.filter(F.col("_n") <= total * big).groupBy("_b").agg(F.sum("_n").alias("_w"))
    cells = cells.withColumn("_mid", (F.sum("_w").over(line) - F.col("_w") / 2) / F.sum("_w").over(Window.partitionBy(F.lit(0))))
    split, border, cases = F.lit(shares[-1][0]), 0.0, None
    for name, _ in shares[:-1]:
        border += room[name] / rest if rest else 0.0
        cases = F.when(F.col("_mid") < border, name) if cases is None else cases.when(F.col("_mid") < border, name)
    split = split if cases is None else cases.otherwise(shares[-1][0])
    known = rows.sparkSession.createDataFrame(placed, f"_g {rows.schema['_g'].dataType.simpleString()}, _giant string")
    small = sizes.join(F.broadcast(cells.select("_b", split.alias("_split"))), "_b", "left").join(F.broadcast(known), "_g", "left")
    return rows.join(small.select("_g", F.coalesce("_giant", "_split").alias("split")), "_g").select(F.col("_k").alias(key), F.col("_g").alias(group), "split")


def _place_giants(giants: list[tuple], shares: tuple[tuple[str, float], ...], total: int) -> tuple[list[tuple], dict[str, float]]:
    """((group, split) of the big groups, records that each split still has room for)."""
    room = {name: share * total for name, share in shares}
    placed = []
    for g, n, unit in sorted(giants, key=lambda x: (-x[1], x[2], x[0])):
        upto, own = 0.0, shares[-1][0]
        for name, share in shares:
            upto += share
            if unit < upto:
                own = name
                break
        if room[own] < n:
            own = max(room, key=room.get)
        room[own] = max(0.0, room[own] - n)
        placed.append((g, own))
    return placed, room
