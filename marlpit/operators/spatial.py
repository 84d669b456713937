"""Points near other points, and the regions that contain points.

Space (longitude by latitude) is cut by a quadtree grown from a bounded sample of the points, so that cells hold about
equally many points however uneven the map is. Each point goes to its home cell and is replicated to the cells its
search box touches; every cell is one independent task that bulk-loads an R-tree and probes it; candidates are refined
by exact geometry; a pair found in several cells is reported by the cell that is home to its reference point.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.functions.rtree import RTree
from marlpit.session import cut, spread

#: Fixed value: radius of the sphere in metres.
EARTH_M = 6_371_008.8
DEPTH = 14  # deepest cells, 0.011 degrees of latitude; fewer levels where the search distance asks for wider cells
SAMPLE_ROWS = 40_000  # bound on the rows of the sample that shapes the quadtree


def usable(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(k, lat, lon) of the rows with a key and a usable location: both coordinates, in range, not (0, 0)."""
    p = df.select(F.col(key).cast("string").alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return p.filter("k is not null and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)")


@dataclass
class Quadtree:
    """Leaves as ranges of Morton codes at ``depth``: leaf i spans codes starts[i] up to starts[i + 1].

    ``blocks[i]`` is above 1 for a leaf at full depth that holds more than a task should (a hot place): its points are
    hashed into that many blocks and each pair of blocks is a task.
    """

    starts: np.ndarray
    blocks: np.ndarray
    depth: int = DEPTH

    @staticmethod
    def grow(lat: np.ndarray, lon: np.ndarray, weight: float, target: int, deepest: int = DEPTH) -> Quadtree:
        codes = np.sort(morton(*grid(lat, lon, deepest), deepest))
        starts, blocks, todo = [], [], [(0, 0)]
        while todo:
            code, depth = todo.pop()
            span = 1 << (2 * (deepest - depth))
            n = (np.searchsorted(codes, code + span) - np.searchsorted(codes, code)) * weight
            if n > target and depth < deepest:
                todo += [(code + q * (span // 4), depth + 1) for q in range(4)]
            else:
                starts.append(code)
                blocks.append(max(1, math.ceil(n / (2 * target))))
        order = np.argsort(starts)
        return Quadtree(np.array(starts, dtype=np.int64)[order], np.array(blocks, dtype=np.int64)[order], deepest)

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, morton(*grid(lat, lon, self.depth), self.depth), side="right") - 1

    def touched(self, box: tuple[float, float, float, float]) -> np.ndarray:
        """Leaves that a box (lon_min, lat_min, lon_max, lat_max) overlaps; longitudes may run over 180."""
        (x0, x1), (y0, y1) = cells(np.array([box[0], box[2]]), 360.0, self.depth), cells(np.clip([box[1], box[3]], -90, 90), 180.0, self.depth)
        side = 1 << self.depth
        y0, y1, x1 = min(int(y0), side - 1), min(int(y1), side - 1), min(int(x1), int(x0) + side - 1)
        found: set[int] = set()
        self._descend(0, 0, 0, 0, int(x0), max(int(y0), 0), x1, y1, found)
        return np.array(sorted(found), dtype=np.int64)

    def _descend(self, depth: int, x: int, y: int, code: int, x0: int, y0: int, x1: int, y1: int, found: set[int]) -> None:
        size, side = 1 << (self.depth - depth), 1 << self.depth
        if y > y1 or y + size <= y0 or not any(x + s <= x1 and x + s + size > x0 for s in (-side, 0, side)):
            return
        i = int(np.searchsorted(self.starts, code, side="right")) - 1
        last = i + 1 == len(self.starts) or self.starts[i + 1] >= code + (1 << (2 * (self.depth - depth)))
        if last:
            found.add(i)
            return
        half = size // 2
        for q in range(4):
            self._descend(depth + 1, x + half * (q & 1), y + half * (q >> 1), code + q * (1 << (2 * (self.depth - depth - 1))), x0, y0, x1, y1, found)


def cells(v: np.ndarray, span: float, depth: int) -> np.ndarray:
    return np.floor((np.asarray(v) + span / 2) / span * (1 << depth)).astype(np.int64)


def grid(lat: np.ndarray, lon: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    top = (1 << depth) - 1
    return np.clip(cells(lon, 360.0, depth), 0, top), np.clip(cells(lat, 180.0, depth), 0, top)


def morton(x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    code = np.zeros(np.shape(x), dtype=np.int64)
    for bit in range(depth):
        code |= ((x >> bit) & 1) << (2 * bit) | ((y >> bit) & 1) << (2 * bit + 1)
    return code


def reach(lat: np.ndarray, metres: float) -> tuple[float, np.ndarray]:
    """Half height and half widths, in degrees, of the boxes around circles at ``lat``; 360 wide where a pole is inside."""
    angle = metres / EARTH_M
    tall = math.degrees(angle) * (1 + 1e-9) + 1e-9
    ratio = math.sin(min(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-300)
    wide = np.where((np.abs(lat) + tall >= 90) | (ratio >= 1), 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1))) * (1 + 1e-9) + 1e-9)
    return tall, wide


def great_circle(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def depth_for(metres: float) -> int:
    """Levels of a quadtree whose cells are at least as tall as a search box, ``DEPTH`` at most."""
    tall = 2 * math.degrees(metres / EARTH_M) * (1 + 1e-6)
    return DEPTH if tall <= 180 / (1 << DEPTH) else max(0, math.floor(math.log2(180 / tall)))


def grow_quadtree(points: DataFrame, target: int, depth: int = DEPTH) -> Quadtree:
    """The quadtree for ``points``, from a hash sample of at most about ``SAMPLE_ROWS`` rows."""
    total = points.count()
    every = max(1, math.ceil(total / SAMPLE_ROWS))
    rows = points.filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).select("lat", "lon").toPandas()
    return Quadtree.grow(rows["lat"].to_numpy(dtype=float), rows["lon"].to_numpy(dtype=float), float(every), target, depth)


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, metres: float = 150.0, target: int = 4000) -> DataFrame:
    """(key_a, key_b), key_a < key_b by bytes: usable locations at most ``metres`` apart along the great circle.

    Points at one and the same place form a class that stands in the search as one point, its members join the pairs
    afterwards; so a crowded address is not copied between tasks. Cells are as wide as the distance asks for, whatever it is.

    Defined results: rows without key or usable location take no part; a repeated key is one point per distinct
    location and never pairs with itself; points across longitude 180 and around the poles are found; an empty table
    gives no rows; further columns are ignored.
    """
    points = usable(df, key, lat, lon)
    classes = cut(points.groupBy("lat", "lon").agg(F.min("k").alias("k"), F.count_distinct("k").alias("n")), "near")
    crowded = classes.filter("n > 1").select("lat", "lon")
    members = points.join(crowded, ["lat", "lon"]).select("lat", "lon", "k").distinct()
    tree = grow_quadtree(classes, target, depth_for(metres))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _place(b, tree, metres)

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        return _pairs(group, metres)

    placed = spread(classes.select("k", "lat", "lon"), "k").mapInPandas(place, "leaf long, pi int, bj int, k string, lat double, lon double, probe boolean, build boolean")
    ends = "lat_a double, lon_a double, key_a string, lat_b double, lon_b double, key_b string"
    found = placed.groupBy("leaf", "pi", "bj").applyInPandas(pair, ends)
    for side in "ab":
        more = members.select(F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"), F.col("k").alias(f"more_{side}"))
        found = found.join(more, [f"lat_{side}", f"lon_{side}"], "left").withColumn(f"key_{side}", F.coalesce(f"more_{side}", f"key_{side}")).drop(f"more_{side}")
    within = members.select("lat", "lon", F.col("k").alias("key_a")).join(members.select("lat", "lon", F.col("k").alias("key_b")), ["lat", "lon"]).select("key_a", "key_b")
    both = found.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionByName(within)
    return both.filter("key_a < key_b").distinct()


def _place(b: pd.DataFrame, tree: Quadtree, metres: float) -> pd.DataFrame:
    lat, lon = b["lat"].to_numpy(dtype=float), b["lon"].to_numpy(dtype=float)
    home = tree.leaf(lat, lon)
    tall, wide = reach(lat, metres)
    rows, leaves = [np.arange(len(b))], [home]
    narrow = (2 * wide <= 360.0 / (1 << tree.depth)) & (2 * tall <= 180.0 / (1 << tree.depth))  # then its corners show all cells it touches
    at = np.flatnonzero(narrow)
    for sx in (-1, 1):
        for sy in (-1, 1):
            x = lon[at] + sx * wide[at]
            x = np.where(x < -180, x + 360, np.where(x > 180, x - 360, x))
            rows.append(at)
            leaves.append(tree.leaf(np.clip(lat[at] + sy * tall, -90, 90), x))
    for i in np.flatnonzero(~narrow):
        hit = tree.touched((lon[i] - wide[i], lat[i] - tall, lon[i] + wide[i], lat[i] + tall))
        rows.append(np.full(len(hit), i))
        leaves.append(hit)
    pair = np.unique(np.stack([np.concatenate(rows), np.concatenate(leaves)], axis=1), axis=0)
    row, leaf = pair[:, 0], pair[:, 1]
    is_home = leaf == home[row]
    blocks = tree.blocks[leaf]
    own = pd.util.hash_array(b["k"].to_numpy(dtype=object))[row].astype(np.uint64) % blocks.astype(np.uint64)
    own = own.astype(np.int64)
    cold = blocks == 1
    parts = [(row[cold], leaf[cold], own[cold], own[cold], is_home[cold], np.ones(cold.sum(), dtype=bool))]
    for i in np.flatnonzero(~cold):
        each, mine = np.arange(blocks[i]), np.full(blocks[i], own[i])
        if is_home[i]:
            parts.append((np.full(blocks[i], row[i]), np.full(blocks[i], leaf[i]), mine, each, np.ones(blocks[i], bool), np.zeros(blocks[i], bool)))
        parts.append((np.full(blocks[i], row[i]), np.full(blocks[i], leaf[i]), each, mine, np.zeros(blocks[i], bool), np.ones(blocks[i], bool)))
    row, leaf, pi, bj, probe, build = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"leaf": leaf, "pi": pi.astype(np.int32), "bj": bj.astype(np.int32), "k": b["k"].to_numpy()[row], "lat": lat[row], "lon": lon[row], "probe": probe.astype(bool), "build": build.astype(bool)})


def _pairs(g: pd.DataFrame, metres: float) -> pd.DataFrame:
    probe, build = g[g["probe"]], g[g["build"]]
    blat, blon, bkey = build["lat"].to_numpy(), build["lon"].to_numpy(), build["k"].to_numpy(dtype=object)
    plat, plon, pkey = probe["lat"].to_numpy(), probe["lon"].to_numpy(), probe["k"].to_numpy(dtype=object)
    names = ["lat_a", "lon_a", "key_a", "lat_b", "lon_b", "key_b"]
    spot = lambda k, y, x: list(zip(k, y.tolist(), x.tolist()))  # noqa: E731 - a key may stand at several places
    rank = {k: i for i, k in enumerate(sorted({*spot(bkey, blat, blon), *spot(pkey, plat, plon)}))}
    brank = np.array([rank[k] for k in spot(bkey, blat, blon)], dtype=np.int64)
    prank = np.array([rank[k] for k in spot(pkey, plat, plon)], dtype=np.int64)
    # ghosts: a point near longitude 180 also stands on the other side
    item = np.concatenate([np.arange(len(blon))] * 3)
    x = np.concatenate([blon, blon + 360, blon - 360])
    tall, wide = reach(plat, metres)
    keep = (np.arange(len(x)) < len(blon)) | (np.abs(x) <= 180 + wide.max(initial=0.0))
    item, x = item[keep], x[keep]
    y = blat[item]
    tree = RTree(np.stack([x, y, x, y], axis=1))
    box = np.stack([plon - wide, plat - tall, plon + wide, plat + tall], axis=1)
    a, b = [], []
    for p, i in tree.query(box):
        i = item[i]
        sel = prank[p] < brank[i]  # reference point: the point with the smaller key, reported by its home cell
        p, i = p[sel], i[sel]
        sel = great_circle(plat[p], plon[p], blat[i], blon[i]) <= metres
        a.append(p[sel])
        b.append(i[sel])
    if not a:
        return pd.DataFrame({c: pd.Series([], dtype=object if c[0] == "k" else float) for c in names})
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame(dict(zip(names, (plat[a], plon[a], pkey[a], blat[b], blon[b], bkey[b])))).drop_duplicates()


def unwrap(lon: np.ndarray) -> np.ndarray:
    """Longitudes of a ring without jumps over 180."""
    step = np.diff(lon)
    return lon + np.concatenate([[0.0], np.cumsum(np.where(step > 180, -360.0, np.where(step < -180, 360.0, 0.0)))])


def inside(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a ring with straight edges, the last corner joined to the first."""
    out = np.zeros(len(px), dtype=bool)
    for x1, y1, x2, y2 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
        crosses = (y1 > py) != (y2 > py)
        if crosses.any():
            out ^= crosses & (px < (x2 - x1) * (py - y1) / ((y2 - y1) or 1.0) + x1)
    return out


def points_in_regions(df: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, ring: str = "ring", hole: str = "hole", target: int = 4000) -> DataFrame:
    """(region key, point key) as (key_a, key_b): usable locations inside a region's ring and not inside its hole.

    Regions are replicated to the quadtree cells their boxes touch and meet the points there; a cell with a hot place
    is salted. Rings may cross longitude 180. Defined results: a null ring, one with under three corners or with a null
    coordinate contains nothing; a null or such a hole excludes nothing; borders follow the even-odd rule; empty tables
    give no rows.
    """
    points = usable(df, key, lat, lon)
    tree = grow_quadtree(points, target)

    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = tree.leaf(b["lat"].to_numpy(dtype=float), b["lon"].to_numpy(dtype=float))
            salt = pd.util.hash_array(b["k"].to_numpy(dtype=object)) % tree.blocks[leaf].astype(np.uint64)
            yield pd.DataFrame({"leaf": leaf, "salt": salt.astype(np.int32), "k": b["k"], "lat": b["lat"], "lon": b["lon"]})

    def reachable(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                shape = _corners(r.rlat, r.rlon)
                if shape is None or r.k is None:
                    continue
                y, x = shape
                for leaf in tree.touched((x.min(), y.min(), x.max(), y.max())):
                    out += [(leaf, salt, r.k, r.rlat, r.rlon, r.hlat, r.hlon) for salt in range(tree.blocks[leaf])]
            yield pd.DataFrame(out, columns=["leaf", "salt", "k", "rlat", "rlon", "hlat", "hlon"])

    def contain(pts: pd.DataFrame, regs: pd.DataFrame) -> pd.DataFrame:
        return _contained(pts, regs)

    shapes = regions.select(
        F.col(region).cast("string").alias("k"),
        F.col(f"{ring}.latitude").alias("rlat"), F.col(f"{ring}.longitude").alias("rlon"),
        F.col(f"{hole}.latitude").alias("hlat"), F.col(f"{hole}.longitude").alias("hlon"),
    )
    at = spread(points, "k").mapInPandas(home, "leaf long, salt int, k string, lat double, lon double").groupBy("leaf", "salt")
    there = shapes.mapInPandas(
        reachable, "leaf long, salt int, k string, rlat array<double>, rlon array<double>, hlat array<double>, hlon array<double>"
    ).groupBy("leaf", "salt")
    return at.cogroup(there).applyInPandas(contain, "key_a string, key_b string").distinct()


def _corners(lat, lon) -> tuple[np.ndarray, np.ndarray] | None:
    if lat is None or lon is None or len(lat) < 3:
        return None
    y, x = np.array(lat, dtype=float), np.array(lon, dtype=float)
    return None if np.isnan(y).any() or np.isnan(x).any() else (y, unwrap(x))


def _contained(pts: pd.DataFrame, regs: pd.DataFrame) -> pd.DataFrame:
    none = pd.DataFrame({"key_a": pd.Series([], dtype=object), "key_b": pd.Series([], dtype=object)})
    if not len(pts) or not len(regs):
        return none
    shapes = [(r.k, _corners(r.rlat, r.rlon), _corners(r.hlat, r.hlon)) for r in regs.itertuples(index=False)]
    boxes, owner = [], []
    for i, (_, (y, x), _h) in enumerate(shapes):
        for turn in (-360.0, 0.0, 360.0):  # a ring over 180 also stands at its other longitudes
            if x.max() + turn >= -180 and x.min() + turn <= 180:
                boxes.append((x.min() + turn, y.min(), x.max() + turn, y.max()))
                owner.append((i, turn))
    lat, lon, keys = pts["lat"].to_numpy(), pts["lon"].to_numpy(), pts["k"].to_numpy(dtype=object)
    a, b = [], []
    for p, box in RTree(np.array(boxes)).query(np.stack([lon, lat, lon, lat], axis=1)):
        for j in np.unique(box):
            i, turn = owner[j]
            at = p[box == j]
            name, (y, x), hole = shapes[i]
            ok = inside(lon[at] - turn, lat[at], x, y)
            if hole is not None:
                hy, hx = hole
                hx = hx + 360.0 * np.round((x.mean() - hx.mean()) / 360.0)
                ok &= ~inside(lon[at] - turn, lat[at], hx, hy)
            a += [name] * int(ok.sum())
            b += list(keys[at[ok]])
    return pd.DataFrame({"key_a": a, "key_b": b}).drop_duplicates() if a else none
