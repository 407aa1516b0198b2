"""Evaluation texts leaking into training text.

Pigeonhole edit matching over words (a longest run of letters and digits, case ignored). A passage of ``least`` words
that occurs with at most ``budget`` word edits has, cut into budget + 1 pieces, one piece unharmed. An item is cut
into consecutive pieces short enough that every window of ``least`` words holds budget + 1 whole ones, so looking the
pieces up exactly finds every such window.

The pieces are rows (hash, item, place), never collected. One scan of the documents hashes every window of a piece's
length and keeps those that a filter of fixed size lets through: a bit array with the bits of all pieces' hashes, put
together on the executors, whatever the number of items. What is kept is joined to the pieces by hash, hot pieces dealt
over partitions. Either side carries the hashes of the words around it, as far as a window of ``least`` words can reach,
so hits are verified right after the join, by Myers' bit-parallel distance over words, without any text. Runs of equal
words around neighbouring hits of one diagonal are put together, so the longest run is exact. Words count as equal where
their 63-bit hashes are.

Defined results: null and empty texts leak nothing; an item shorter than ``least`` words leaks nothing; equal documents
and equal items are all reported; letters are compared in lower case; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrain.llm import filters
from evigrain.operators.skew import salted_join
from evigrain.session import cut

LEAST, BUDGET = 12, 1
#: Bytes of the filter, whatever the number of items (2 MB hold a million pieces with one window in 160 passing by chance).
FILTER_BYTES = 2 << 20
BETWEEN = re.compile(r"[\W_]+")


def line_of(text: str | None) -> str:
    """The words of a text, each with a space on either side."""
    return " " + BETWEEN.sub(" ", text.lower()).strip() + " " if text else " "


def words(text: str | None) -> list[str]:
    return line_of(text).split()


def piece_length(least: int = LEAST, budget: int = BUDGET) -> int:
    """The longest piece so that any ``least`` consecutive words hold budget + 1 whole consecutive pieces."""
    return max(1, (least + 1) // (budget + 2))


def item_pieces(item: list[str], length: int) -> list[tuple[int, str]]:
    """(first word, piece) of the item's consecutive pieces; a last short one is left out, as the windows that reach
    into it hold enough whole ones before it."""
    return [(i, " ".join(item[i : i + length])) for i in range(0, len(item) - length + 1, length)]


def myers(pattern: list[str], text: list[str]) -> int:
    """The least number of word edits that turn ``pattern`` into some stretch of ``text``."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


def run_around(doc: list[str], item: list[str], d: int, i: int, length: int) -> tuple[int, int]:
    """(first word in the document, words) of the longest run of equal words around a hit."""
    a = 0
    while d - a > 0 and i - a > 0 and doc[d - a - 1] == item[i - a - 1]:
        a += 1
    b = length
    while d + b < len(doc) and i + b < len(item) and doc[d + b] == item[i + b]:
        b += 1
    return d - a, a + b


def covered(doc: list[str], item: list[str], d: int, i: int, step: int, edits: int) -> int:
    """How many words of the item, from ``i`` on in direction ``step``, the document can follow from ``d`` on with
    so many word edits."""
    n = 0
    while 0 <= d < len(doc) and 0 <= i < len(item) and doc[d] == item[i]:
        n, d, i = n + 1, d + step, i + step
    if not edits or not 0 <= i < len(item):
        return n
    return n + max(
        1 + covered(doc, item, d + step, i + step, step, edits - 1),
        1 + covered(doc, item, d, i + step, step, edits - 1),
        covered(doc, item, d + step, i, step, edits - 1) if 0 <= d < len(doc) else 0,
    )


def within_budget(doc: list[str], item: list[str], d: int, i: int, run: int, least: int, budget: int) -> bool:
    """Whether the run of equal words at ``d`` / ``i`` can lie in ``least`` words of the item with ``budget`` edits."""
    return any(covered(doc, item, d - 1, i - 1, -1, e) + run + covered(doc, item, d + run, i + run, 1, budget - e) >= least for e in range(budget + 1))


class WordHashes(dict):
    """63-bit hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        return h


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every ``length`` consecutive words."""
    n = max(0, len(words) - length + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(length):
        h = (h ^ words[i : i + n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def around(words: np.ndarray, at: np.ndarray, length: int, reach: int) -> pa.ListArray:
    """The words from ``reach`` before each place to ``reach`` behind its piece; -1 beyond the ends."""
    padded = np.concatenate([np.full(reach, -1, np.int64), words, np.full(reach, -1, np.int64)])
    width = length + 2 * reach
    flat = padded[at[:, None] + np.arange(width)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(flat.ravel(), pa.int64()))


def judge(doc: list[int], item: list[int], length: int, reach: int, least: int, budget: int) -> tuple[int, int, int]:
    """(equal words before the piece, behind it, least edits of a window of ``least`` words with the piece in it)."""
    d0 = next((i for i in range(reach, 0, -1) if doc[i - 1] == -1), 0)
    d1 = next((i for i in range(reach + length, len(doc)) if doc[i] == -1), len(doc))
    i0 = next((i for i in range(reach, 0, -1) if item[i - 1] == -1), 0)
    i1 = next((i for i in range(reach + length, len(item)) if item[i] == -1), len(item))
    d, it = doc[d0:d1], item[i0:i1]
    begin, run = run_around(d, it, reach - d0, reach - i0, length)
    before = reach - d0 - begin
    edits = least
    if run >= least:
        edits = 0
    elif budget and within_budget(d, it, begin, reach - i0 - before, run, least, budget):
        at = reach - i0
        for s in range(max(0, at + length - least), min(at, len(it) - least) + 1):
            f = reach - d0 - (at - s)
            edits = min(edits, myers(it[s : s + least], d[max(0, f - budget) : f + least + budget]))
            if edits <= 1:
                break
    return before, run - length - before, edits


def runs_of(equal: np.ndarray) -> np.ndarray:
    """How many of each row's first values are true, one after another."""
    return np.logical_and.accumulate(equal, axis=1).sum(axis=1) if equal.shape[1] else np.zeros(len(equal), int)


def equal_around(x: np.ndarray, y: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and behind the piece, as far as the words around it go."""
    same = (x == y) & (x != -1)
    return runs_of(same[:, :reach][:, ::-1]), runs_of(same[:, reach + length :])


def may_reach(x: np.ndarray, y: np.ndarray, before: np.ndarray, behind: np.ndarray, length: int, reach: int, least: int, budget: int) -> np.ndarray:
    """Whether a window of ``least`` words of the item may hold with ``budget`` edits; exact for one edit, which is put on
    either side, as a word replaced, left out or put in. Any other budget is left to the verification."""
    if budget != 1:
        return np.full(len(x), budget > 0)

    def further(a: np.ndarray, b: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Words of the item covered on one side with an edit; ``a`` and ``b`` lead away from the piece."""
        wide = np.arange(reach)
        best = run.copy()
        for da, db, won in ((1, 1, 1), (0, 1, 1), (1, 0, 0)):
            i, j = run[:, None] + da + wide, run[:, None] + db + wide
            ok = (i < reach) & (j < reach)
            u, v = (np.take_along_axis(m, np.minimum(k, reach - 1), axis=1) for m, k in ((a, i), (b, j)))
            there = (run < reach) & (np.take_along_axis(b, np.minimum(run, reach - 1)[:, None], axis=1)[:, 0] != -1)
            best = np.maximum(best, run + won * there + runs_of(ok & (u == v) & (u != -1)))
        return best

    left, right = further(x[:, :reach][:, ::-1], y[:, :reach][:, ::-1], before), further(x[:, reach + length :], y[:, reach + length :], behind)
    return np.maximum(left + behind, right + before) + length >= least


PLACED = "h bigint, key bigint, place int, near array<bigint>"


def placed_pieces(texts: DataFrame, length: int, reach: int, least: int, every: bool, shared=None) -> DataFrame:
    """h, key, place, near: windows of ``length`` words of each text (key, text), with the words around them: all that
    pass the filter, or (not ``every``) those that stand one after another in texts of ``least`` words or more."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        bits = np.frombuffer(shared.value, np.uint8) if every else None
        for part in parts:
            lists = [words(text) for text in part.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
            if len(flat) < length:
                continue
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            who, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - starts
            n = len(flat) - length + 1
            ok = at[:n] + length <= sizes[who[:n]]  # within one text
            h = window_hashes(flat, length)
            if not every:
                ok &= (at[:n] % length == 0) & (sizes[who[:n]] >= least)
            hit = np.flatnonzero(ok)
            if every:
                hit = hit[filters.passing(bits, h[hit])]
            if not len(hit):
                continue
            # texts stand ``reach`` apart, so that no word of a neighbour is taken for one around
            gap = np.full(len(flat) + reach * len(sizes), -1, np.int64)
            moved = np.arange(len(flat)) + reach * who
            gap[moved] = flat
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), part.column(0).take(pa.array(who[hit])), pa.array(at[hit].astype(np.int32)), around(gap, moved[hit], length, reach)], ["h", "key", "place", "near"])

    return texts.mapInArrow(scan, PLACED)


def leaked(documents: DataFrame, items: DataFrame, least: int = LEAST, budget: int = BUDGET, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, item_id, longest_run (equal consecutive words, of the passages that are reported) and edits (of the best
    window of ``least`` words) of every document that holds a window of an item with at most ``budget`` word edits."""
    length = piece_length(least, budget)
    reach = least + budget - length
    pieces = cut(placed_pieces(items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("key"), "text"), length, reach, least, False))
    shared = documents.sparkSession.sparkContext.broadcast(filters.built(pieces.select("h"), filter_bytes))
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("key"), "text")
    hits = cut(placed_pieces(docs, length, reach, least, True, shared).toDF("h", "doc_id", "d", "doc_near"))
    weights = hits.groupBy("h").agg(F.count(F.lit(1)).alias("_w"))
    right = pieces.select("h", F.col("key").alias("item_id"), F.col("place").alias("i"), F.col("near").alias("item_near")).join(weights, "h")
    met = salted_join(hits, right, ["h"], "_w", spread_by=["doc_id", "d"])

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc, item, d, i = (part.column(n) for n in ("doc_id", "item_id", "d", "i"))
            x, y = (part.column(n).flatten().to_numpy().reshape(len(part), length + 2 * reach) for n in ("doc_near", "item_near"))
            before, behind = equal_around(x, y, length, reach)
            edits = np.where(before + length + behind >= least, 0, budget + 1)
            edits[~(x[:, reach : reach + length] == y[:, reach : reach + length]).all(axis=1)] = least  # another piece of the same hash
            for row in np.flatnonzero((edits == budget + 1) & may_reach(x, y, before, behind, length, reach, least, budget)):
                edits[row] = judge(x[row].tolist(), y[row].tolist(), length, reach, least, budget)[2]
            kept = np.flatnonzero(edits <= budget)
            at, d, i = pa.array(kept), d.to_numpy()[kept], i.to_numpy()[kept]
            yield pa.RecordBatch.from_arrays([doc.take(at), item.take(at), pa.array(d.astype(np.int64) - i), pa.array(d - before[kept], pa.int32()), pa.array(d + length + behind[kept], pa.int32()), pa.array(edits[kept], pa.int32())], ["doc_id", "item_id", "diagonal", "a", "b", "edits"])

    seen = met.mapInArrow(verify, "doc_id bigint, item_id bigint, diagonal bigint, a int, b int, edits int")
    # runs of neighbouring hits on a diagonal overlap, as each reaches further than the next piece
    runs = seen.groupBy("doc_id", "item_id", "diagonal").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"), F.min("edits").alias("edits"))
    start = F.expr("CAST(named_struct('a', -1, 'b', -1, 'n', 0) AS struct<a:int,b:int,n:int>)")

    def step(x, r):
        on = (x["b"] >= r["a"]) & (x["a"] >= 0)
        a, b = F.when(on, x["a"]).otherwise(r["a"]), F.when(on, F.greatest(x["b"], r["b"])).otherwise(r["b"])
        return F.struct(a.alias("a"), b.alias("b"), F.greatest(x["n"], b - a).alias("n"))

    each = runs.select("doc_id", "item_id", F.aggregate("runs", start, step, lambda x: x["n"]).alias("n"), "edits")
    return each.groupBy("doc_id", "item_id").agg(F.max("n").cast("int").alias("longest_run"), F.min("edits").cast("int").alias("edits"))
