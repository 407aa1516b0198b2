"""Most similar vectors for every vector.

Collision-counting hashing inside the cells of a partition of the collection. A direction (a vector but for its length)
is dealt to the cell of the nearest centroid and visits the cells of the next nearest ones. In a cell every single
projection keeps the members' projections as a sorted array; a query's window around its own projection is a run of that
array, and a member is a candidate when it lies in the windows of at least a threshold's share of the projections. Only
candidates are verified by their exact cosine. At home the windows widen by virtual rehashing, from the width of a cosine
of 0.9 on, until k verified members lie within the radius; a visitor comes with the k-th best cosine it has found at
home, which sets the one width it needs. A query that no radius settles meets all members of its cell, the last rehash.

Collisions are counted 64 members at a time: the sorted array's prefixes are held as bit sets, so a window is the
difference of two of them, and the windows of all projections are added by carry-save adders. Windows end at the edges
of small buckets, so that their places in the sorted array are looked up, not searched for.

Centroids are fitted on a bounded, seeded sample; every row is indexed. Their number grows with the rows: beyond
``most_top`` cells each is cut further by directions drawn from it, one for every ``per_cell`` rows, which are joined,
not broadcast. Cells so keep their size, and the work grows with the rows. Equal directions are collapsed, first in each
batch before any shuffle and then in their cell, so one that a third of all rows share is searched once. Two of n
directions are taken for one with a chance of n^2 / 3.7e19.

What may be lost: a neighbour in a cell that isn't visited, or one that fewer projections than the threshold meet (one
in 10 at the very edge of the radius, far fewer within). The README states the recall.

Defined results: null, empty and all-zero vectors, those with a null, NaN or infinite number and those of another length
than most have no neighbours and are none; scale doesn't matter; ties go to the smaller id; rows without an id are left
out; rows with the same id and direction are one, an id with several directions is searched with each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from evigrain.operators.search import rows_of
from evigrain.operators.skew import salted_join
from evigrain.session import cut

SEED = 42
#: Rows of the sample the centroids are fitted on, rows meant for a cell, centroids at most (0.5 MB of 64 numbers each).
SAMPLE, PER_CELL, MOST_TOP = 20_000, 2_000, 2_048
#: Cells a direction is looked up in, its own among them.
PROBES = 5
#: Bases of projections (as many projections as numbers in a vector each), and standard deviations of what a member at
#: the radius collides with that may be missing.
BASES, SLACK = 1, 1.25
#: The cosines whose radii the windows widen to, one after another.
RADII = (0.9, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)
#: Buckets between the projections -1 and 1, to which windows are rounded outwards.
BUCKETS = 2_048
#: Queries counted at a time, pairs verified at a time, members of a bit table.
STEP, PAIRS, BLOCK = 256, 100_000, 8_192
#: Rows of a cell of the first level that come to a task when it is cut further.
SHARE = 50_000


def projections(dimension: int) -> np.ndarray:
    """Unit projections: random orthonormal bases."""
    rng = np.random.default_rng(SEED + 1)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dimension, dimension)))[0].T for _ in range(BASES)])


def directions(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, names of their directions, their unit vectors as whole numbers of 1e-12)."""
    at, x = rows_of(column, dimension)
    with np.errstate(all="ignore"):
        big = np.abs(x).max(axis=1, initial=0)  # so that no square runs over or vanishes
        x = x / big[:, None]
        n = np.linalg.norm(x, axis=1)
        good = np.isfinite(n) & (n > 0) & np.isfinite(big)
        u = np.rint(x[good] / n[good, None] * 1e12).astype(np.int64)
    names = np.array([int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), "little", signed=True) for row in u], np.int64)
    return at[good], names, u


def packed(u: np.ndarray) -> pa.Array:
    """Whole numbers below 2^47 as six bytes each."""
    return pa.array([row.tobytes() for row in np.ascontiguousarray(u.view(np.uint8).reshape(*u.shape, 8)[:, :, :6])], pa.binary())


def unpacked(column, dimension: int) -> np.ndarray:
    """The unit vectors of packed numbers."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dimension, 8), np.uint8)
    out[:, :, :6] = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), dimension, 6)
    out[:, :, 6:] = np.where(out[:, :, 5:6] & 0x80, 0xFF, 0)
    return out.view(np.int64)[:, :, 0] / 1e12


def fit(units: np.ndarray, cells: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    x = units.astype(np.float32)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 2000] @ c.T, axis=1) for i in range(0, len(x), 2000)])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c[near[order][starts]] = (sums / np.where(norms > 0, norms, 1)).astype(np.float32)
    return c


def nearest_rows(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` rows of ``c`` most similar to each row of ``x``, the nearest first."""
    out = np.empty((len(x), n), np.int64)
    for i in range(0, len(x), 2048):
        s = x[i : i + 2048].astype(np.float32) @ c.T
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
        out[i : i + 2048] = np.take_along_axis(top, order, axis=1)
    return out


class Adder:
    """Sums of bit sets, by carry-save adders: bit i of every sum is a bit set."""

    def __init__(self, shape: tuple[int, int]):
        self.shape = shape
        self.bits: list[np.ndarray] = []
        self.waiting: list[np.ndarray | None] = []

    def add(self, x: np.ndarray, level: int = 0) -> None:
        if level == len(self.bits):
            self.bits.append(np.zeros(self.shape, np.uint64))
            self.waiting.append(None)
        if (a := self.waiting[level]) is None:
            self.waiting[level] = x
            return
        self.waiting[level] = None
        c = self.bits[level]
        s = c ^ a
        carry = c & a
        carry |= s & x
        s ^= x
        self.bits[level] = s
        self.add(carry, level + 1)

    def at_least(self, least: int) -> np.ndarray:
        level = 0
        while level < len(self.bits):
            if (a := self.waiting[level]) is not None:
                self.waiting[level] = None
                c = self.bits[level]
                self.bits[level] = c ^ a
                if (carry := c & a).any() or level + 1 < len(self.bits):
                    self.add(carry, level + 1)
            level += 1
        out = np.full(self.shape, ~np.uint64(0))
        for i in range(max(len(self.bits), least.bit_length())):
            c = self.bits[i] if i < len(self.bits) else np.zeros(self.shape, np.uint64)
            out = c & out if least >> i & 1 else c | out
        return out


class Members:
    """The sorted projections of a cell's members, and the searches in them. ``ranks`` order equal cosines."""

    def __init__(self, members: np.ndarray, ranks: np.ndarray, planes: np.ndarray):
        self.members, self.ranks, self.planes = members, ranks, planes
        n = len(planes)
        #: A member at the radius lies in a window of one standard deviation with this chance.
        chance = math.erf(1 / math.sqrt(2))
        self.least = max(1, math.floor(n * chance - SLACK * math.sqrt(n * chance * (1 - chance))))
        self.short = members.astype(np.float32)
        edges = np.arange(-BUCKETS // 2, BUCKETS // 2 + 1) * (2 / BUCKETS)
        self.blocks = []
        for at in range(0, len(members), BLOCK):
            part = members[at : at + BLOCK] @ planes.T
            orders = np.argsort(part, axis=0, kind="stable")
            m, words = len(part), -(-len(part) // 64)
            tables = np.zeros((n, m + 1, words), np.uint64)
            places = np.empty((n, len(edges)), np.int32)
            for j in range(n):
                o = orders[:, j]
                tables[j, np.arange(1, m + 1), o >> 6] = np.uint64(1) << (o & 63).astype(np.uint64)
                np.bitwise_or.accumulate(tables[j], axis=0, out=tables[j])
                places[j] = np.searchsorted(part[o, j], edges)
            places[:, 0], places[:, -1] = 0, m
            self.blocks.append((at, m, places, tables))
        #: Pairs verified because they collided often enough, and because every member collides.
        self.counted = self.rest = 0

    def candidates(self, centres: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) that collide in enough windows of ``widths`` around the queries' projections."""
        qs, ms = [], []
        each = np.arange(len(self.planes))
        bucket = lambda x, up: np.clip(up((x + 1) * (BUCKETS // 2)).astype(np.int64), 0, BUCKETS)
        low, high = bucket(centres - widths[:, None], np.floor), bucket(centres + widths[:, None], np.ceil)
        for at, m, places, tables in self.blocks:
            adder = Adder((len(centres), tables.shape[2]))
            first, last = places[each, low], places[each, high]
            for j in each:
                window = tables[j].take(last[:, j], axis=0)
                window ^= tables[j].take(first[:, j], axis=0)
                adder.add(window)
            bits = adder.at_least(self.least)
            hits = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool))
            q, i = np.divmod(hits, bits.shape[1] * 64)
            if m & 63:  # what stands behind the last member
                q, i = q[i < m], i[i < m]
            qs.append(q)
            ms.append(i + at)
        return np.concatenate(qs), np.concatenate(ms)

    def verified(self, queries: np.ndarray, q: np.ndarray, m: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose cosine is at least their query's ``least``: in short numbers first, then exactly."""
        short, keep, s = queries.astype(np.float32), [], []
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], m[i : i + PAIRS]
            near = np.flatnonzero(np.einsum("ij,ij->i", short.take(a, axis=0), self.short.take(b, axis=0)) >= least[a] - 1e-5)
            exact = np.round(np.einsum("ij,ij->i", queries[a[near]], self.members[b[near]]), 9)
            good = exact >= least[a[near]]
            keep.append(i + near[good])
            s.append(exact[good])
        at = np.concatenate(keep) if keep else np.zeros(0, int)
        return q[at], m[at], np.concatenate(s) if s else np.zeros(0)

    def best(self, q: np.ndarray, m: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ranks[m], -s, q))
        q, m, s = q[order], m[order], s[order]
        stay = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        return q[stay], m[stay], s[stay]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, cosine) of the ``k`` best members of each query but its ``own`` (-1 for none), in order.
        With ``bounds`` only members of at least that cosine are wanted."""
        found = []
        if not len(self.members):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        spread = 1 / math.sqrt(self.planes.shape[1])  # of a unit step along a random direction
        for at in range(0, len(queries), STEP):
            part, mine = queries[at : at + STEP], own[at : at + STEP]
            centres = part @ self.planes.T
            open_ = np.arange(len(part))

            def met(rows: np.ndarray, least: np.ndarray, part=part, mine=mine, centres=centres):
                q, m = self.candidates(centres[rows], np.sqrt(np.maximum(2 - 2 * least[rows], 0)) * spread)
                q = rows[q]
                keep = m != mine[q]
                q, m = q[keep], m[keep]
                self.counted += len(q)
                return self.verified(part, q, m, least)

            if bounds is not None:
                least = bounds[at : at + STEP]
                q, m, s = met(np.flatnonzero(least > -1), least)
                found.append((at + q, m, s))
                open_ = np.flatnonzero(least <= -1)
            elif len(self.members) > k:
                for radius in RADII:
                    q, m, s = met(open_, np.full(len(part), radius))
                    done = np.bincount(q, minlength=len(part)) >= k
                    good = done[q]
                    found.append((at + q[good], m[good], s[good]))
                    open_ = open_[~done[open_]]
                    if not len(open_):
                        break
            if len(open_):
                s = np.round(part[open_] @ self.members.T, 9)
                self.rest += s.size
                bar = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] if s.shape[1] > k + 1 else np.full(len(s), -2.0)
                q, m = np.nonzero(s >= bar[:, None])
                c, q = s[q, m], open_[q]
                keep = m != mine[q]
                found.append((at + q[keep], m[keep], c[keep]))
        q, m, s = (np.concatenate([f[i] for f in found]) for i in range(3))
        return self.best(q, m, s, k)


def distinct(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One row a direction, that of its smallest id, and the number of its rows."""
    group = group.sort_by([("g", "ascending"), ("id", "ascending")])
    g = group["g"].to_numpy()
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return group.take(pa.array(first)), np.add.reduceat(group["n"].to_numpy(), first) if len(g) else np.zeros(0, int)


def order_of(ids: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[np.argsort(ids.to_numpy(zero_copy_only=False).astype(object), kind="stable")] = np.arange(len(ids))
    return out


ENTRY = pa.struct([("c", pa.float64()), ("other", pa.string()), ("o", pa.int64()), ("many", pa.bool_())])


def entries(q: np.ndarray, m: np.ndarray, s: np.ndarray, n: int, ids: pa.Array, g: np.ndarray, many: np.ndarray) -> pa.ListArray:
    """The lists of ``n`` queries: negative cosine, smallest id, direction, and whether that has several rows."""
    flat = pa.StructArray.from_arrays([pa.array(-s), ids.take(pa.array(m)), pa.array(g[m], pa.int64()), pa.array(many[m])], fields=list(ENTRY))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(n + 1)), pa.int32()), flat)


LISTED = "array<struct<c:double,other:string,o:bigint,many:boolean>>"


def nearest(vectors: DataFrame, k: int = 10, vec_id: str = "chunk_id", vector: str = "embedding", probes: int = PROBES, per_cell: int = PER_CELL, most_top: int = MOST_TOP) -> DataFrame:
    """id, other, cosine (rounded to 9 decimals), rank_no: the ``k`` most similar other vectors of each."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    usual, total = v.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")), F.max("count")).collect()[0]
    if not total:
        return spark.createDataFrame([], "id string, other string, cosine double, rank_no int")
    rate = int(min(1.0, 1.2 * SAMPLE / total) * (1 << 40))
    drawn = v.where((F.size("v") == usual) & (F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 40)) < rate)).orderBy("id").limit(SAMPLE).select("v").toArrow()
    _, _, sample = directions(drawn["v"], usual)
    sample = np.unique(sample, axis=0) / 1e12 if len(sample) else np.zeros((1, usual))
    cells = max(1, total // per_cell)
    centroids = fit(sample, max(1, min(cells, most_top, len(sample) // 8)))
    shared = spark.sparkContext.broadcast((centroids, projections(usual)))
    probes = min(probes, len(centroids))

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for part in parts:
            at, g, u = directions(part.column(1), usual)
            if not len(at):
                continue
            one, n = distinct(pa.table({"g": pa.array(g), "id": part.column(0).take(pa.array(at)), "i": pa.array(np.arange(len(g))), "n": pa.array(np.ones(len(g), np.int64))}))
            u = u[one["i"].to_numpy()]
            near = nearest_rows(u / 1e12, c, probes)
            visits = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * (probes - 1), pa.int32()), pa.array(near[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(near[:, 0]), visits, one["g"].combine_chunks(), packed(u), one["id"].combine_chunks(), pa.array(n)], ["cell", "visits", "g", "code", "id", "n"])

    placed = v.mapInArrow(route, "cell bigint, visits array<bigint>, g bigint, code binary, id string, n bigint")
    if cells > len(centroids):
        placed = cut(cut_further(placed, usual, per_cell))

    def at_home(group: pa.Table) -> pa.Table:
        _, planes = shared.value
        one, n = distinct(group)
        x, g, many = unpacked(one["code"], usual), one["g"].to_numpy(), n > 1
        q, m, s = Members(x, order_of(one["id"]), planes).search(x, np.arange(len(x)), k)
        lists = entries(q, m, s, len(x), one["id"].combine_chunks(), g, many)
        ends = np.searchsorted(q, np.arange(1, len(x) + 1))
        full = ends - np.searchsorted(q, np.arange(len(x))) >= k
        bound = np.where(full, s[np.maximum(ends - 1, 0)] if len(s) else -1.0, -1.0)
        visits = one["visits"].combine_chunks()
        counts = np.diff(visits.offsets.to_numpy())
        # the list goes along with a first row of its own, which visits no cell
        rows = np.repeat(np.arange(len(x)), counts + 1)
        first = np.r_[True, rows[1:] != rows[:-1]]
        cell = np.full(len(rows), -1, np.int64)
        cell[~first] = visits.flatten().to_numpy()
        code = one["code"].combine_chunks().take(pa.array(rows, mask=first))
        kept = lists.take(pa.array(rows, mask=~first))
        return pa.table({"cell": pa.array(cell), "g": pa.array(g[rows]), "code": code, "bound": pa.array(bound[rows]), "own_many": pa.array(many[rows]), "l": kept})

    def on_visit(key, members: pa.Table, visitors: pa.Table) -> pa.Table:
        _, planes = shared.value
        if key[0].as_py() < 0 or not len(visitors) or not len(members):
            return visitors.select(["g", "own_many", "l"])
        one, n = distinct(members)
        house = Members(unpacked(one["code"], usual), order_of(one["id"]), planes)
        x = unpacked(visitors["code"], usual)
        q, m, s = house.search(x, np.full(len(x), -1), k, visitors["bound"].to_numpy())
        return pa.table({"g": visitors["g"], "own_many": visitors["own_many"], "l": entries(q, m, s, len(x), one["id"].combine_chunks(), one["g"].to_numpy(), n > 1)})

    visiting = placed.groupBy("cell").applyInArrow(at_home, f"cell bigint, g bigint, code binary, bound double, own_many boolean, l {LISTED}")
    # rows without a cell, which carry every direction's list, are dealt to as many groups as there are cells
    visiting = visiting.withColumn("cell", F.when(F.col("cell") < 0, -1 - F.pmod("g", F.lit(cells))).otherwise(F.col("cell")))
    found = placed.groupBy("cell").cogroup(visiting.groupBy("cell")).applyInArrow(on_visit, f"g bigint, own_many boolean, l {LISTED}")
    found = cut(found.where("l IS NOT NULL AND (size(l) > 0 OR own_many)"))

    def name(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, g, _ = directions(part.column(1), usual)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(g)], ["id", "g"])

    return ranked(cut(v.mapInArrow(name, "id string, g bigint").distinct()), found, k)


def cut_further(placed: DataFrame, dimension: int, per_cell: int) -> DataFrame:
    """``placed`` in cells of the second level: each of the first is cut by the directions drawn from it by hash, one in
    ``per_cell``. At home a direction goes to the nearest of them and visits the next; in another cell, the nearest."""
    sizes = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / SHARE).cast("int").alias("parts"))
    plan = F.broadcast(sizes)  # at most as many rows as centroids
    pivots = placed.where(F.pmod(F.xxhash64(F.lit(SEED), "g"), F.lit(per_cell)) == 0).select("cell", "code").distinct().join(plan, "cell")
    pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "code").toDF("own_cell", "own_part", "pivot")
    calls = placed.select(F.posexplode(F.concat(F.array("cell"), "visits")).alias("place", "cell"), "g", "code", F.when(F.col("place") == 0, F.col("id")).alias("id"), "n").join(plan, "cell")
    calls = calls.withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).drop("parts")

    def assign(key, drawn: pa.Table, calls: pa.Table) -> pa.Table:
        first = key[0].as_py() << 32
        if not len(calls):
            near = np.zeros((0, 1), np.int64)
        elif not len(drawn):
            near = np.zeros((len(calls), 1), np.int64)
        else:
            codes = pa.chunked_array([drawn["pivot"].combine_chunks().sort()])
            near = nearest_rows(unpacked(calls["code"], dimension), unpacked(codes, dimension).astype(np.float32), min(2, len(drawn)))
        home = calls["place"].to_numpy() == 0
        more = home if near.shape[1] > 1 else np.zeros(len(home), bool)
        rows = np.r_[np.arange(len(home)), np.flatnonzero(more)]
        cell = first + np.r_[near[:, 0], near[more, -1]] if len(home) else np.zeros(0, np.int64)
        lead = np.r_[home, np.zeros(int(more.sum()), bool)]
        out = calls.take(pa.array(rows))
        return pa.table({"cell": pa.array(cell), "lead": pa.array(lead), "g": out["g"], "code": out["code"].combine_chunks().take(pa.array(np.arange(len(rows)), mask=~lead)), "id": out["id"], "n": out["n"]})

    dealt = pivots.groupBy("own_cell", "own_part").cogroup(calls.groupBy("cell", "part")).applyInArrow(assign, "cell bigint, lead boolean, g bigint, code binary, id string, n bigint")
    # rows of a direction come together: one lead row a batch it was met in, and its visits
    per = dealt.groupBy("g").agg(
        F.min(F.when(F.col("lead"), F.col("cell"))).alias("cell"), F.array_distinct(F.collect_list(F.when(~F.col("lead"), F.col("cell")))).alias("visits"),
        F.first("code", ignorenulls=True).alias("code"), F.min("id").alias("id"), F.sum(F.when(F.col("lead"), F.col("n"))).alias("n"),
    )
    return per.select("cell", F.array_except("visits", F.array("cell")).alias("visits"), "g", "code", "id", "n")


def ranked(names: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Each row's k nearest: of its own direction's rows and those of the directions near it, the smallest ids first
    among equals. ``names``: id, g. A direction of several rows offers its k + 1 smallest ids only, found by hash parts
    first, so one that a third of all rows share doesn't come to one task."""
    merged = found.groupBy("g").agg(F.first("own_many").alias("own_many"), F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k).alias("l"))
    several = F.col("own_many") | F.exists("l", lambda e: e["many"])
    bare = lambda c: F.transform(c, lambda e: F.struct(e["c"].alias("c"), e["other"].alias("other")))
    plain = merged.where(~several).select("g", bare(F.col("l")).alias("l"), F.lit(1).cast("long").alias("_w"))
    weights = names.groupBy("g").agg(F.count(F.lit(1)).alias("_w")).where("_w > 1")
    some = names.join(weights.select("g"), "g", "left_semi").withColumn("p", F.pmod(F.xxhash64("id"), F.lit(256)))
    some = some.withColumn("r", F.row_number().over(W.partitionBy("g", "p").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = some.withColumn("r2", F.row_number().over(W.partitionBy("g").orderBy("id"))).where(F.col("r2") <= k + 1).select(F.col("g").alias("o"), "id")
    mixed = merged.where(several)
    own = F.when(F.col("own_many"), F.array(F.struct(F.lit(-1.0).alias("c"), F.lit(None).cast("string").alias("other"), F.col("g").alias("o"), F.lit(True).alias("many")))).otherwise(F.expr(f"CAST(array() AS {LISTED})"))
    # several rows of one id are one row
    each = mixed.select("g", F.explode(F.concat(own, "l")).alias("e")).select("g", "e.*")
    offered = each.where("NOT many").select("g", "c", "other").unionByName(each.where("many").join(heads, "o", "left").select("g", "c", F.coalesce("id", "other").alias("other")).where("other IS NOT NULL"))
    full = offered.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "other"))), 1, k + 1).alias("l"))
    full = full.join(weights, "g", "left").select("g", "l", F.coalesce("_w", F.lit(1).cast("long")).alias("_w"))
    # every row of a direction reads its direction's list of at most k + 1 entries, without its own
    joined = salted_join(names, plain.unionByName(full), ["g"], "_w").select("id", F.posexplode(F.slice(F.filter("l", lambda s: s["other"] != F.col("id")), 1, k)).alias("p", "s"))
    return joined.select("id", F.col("s.other").alias("other"), (-F.col("s.c")).alias("cosine"), (F.col("p") + 1).alias("rank_no"))


def similar_pairs(found: DataFrame, least: float = 0.9, vec_id: str = "chunk_id") -> DataFrame:
    """Pairs, smaller id first, where one is among the other's nearest."""
    return found.where(F.col("cosine") >= least).select(F.least("id", "other").alias(f"{vec_id}_a"), F.greatest("id", "other").alias(f"{vec_id}_b")).distinct()
