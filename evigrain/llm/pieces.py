"""Splitting oversized items at natural boundaries.

Content-defined chunking: a rolling hash over the last 32 characters marks landmarks; a piece ends at the natural
boundary (blank line, sentence end) nearest to the first landmark after the least size, so an edit moves only the cuts
beside it. A natural boundary within reach always wins; only where none lies within the limit is a cut forced, at the
last white space, else at the limit. Each piece after the first repeats the ``overlap`` characters before it and is,
with them, at most ``limit`` long. Positions count code points of the text as stored.

Defined results: a null or empty text, and one within the limit, is no oversized item and gives no row; texts of any
length are read whole; equal texts give equal pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LIMIT, OVERLAP, LEAST = 2000, 200, 600
WINDOW, MASK = 32, (1 << 9) - 1

#: Full stops of these do not end a sentence.
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "cf.", "vs.", "Fig.", "Eq.", "No.", "Dr.", "approx.")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
STOP = re.compile(r"""(?<=[.!?])\s+(?=[A-Z0-9(\["“'])""")
SHORT = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")$")
SPACE = re.compile(r"\s+")


def boundaries(text: str) -> list[int]:
    """Positions just after each natural boundary's signs, ascending, without the ends of the text."""
    found = {m.end() for m in BLANK.finditer(text)}
    for m in STOP.finditer(text):
        if text[m.start() - 1] != "." or not SHORT.search(text, max(0, m.start() - 8), m.start()):
            found.add(m.end())
    found.discard(0)
    found.discard(len(text))
    return sorted(found)


def longest_stretch(cuts: list[int], size: int) -> int:
    return int(np.diff([0, *cuts, size]).max())


def landmarks(text: str) -> np.ndarray:
    """Positions after which the hash of the last 32 characters ends in nine zero bits: one in 512 on average. The
    polynomial hash of all windows comes from five doublings over the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        base, width = np.uint64(0xD6E8FEB86659FD93), 1
        while width < WINDOW:
            shifted = h.copy()
            shifted[width:] += base * h[:-width]
            h, base, width = shifted, base * base, width * 2
        mixed = h ^ (h >> np.uint64(32))
    hits = np.flatnonzero((mixed & np.uint64(MASK)) == 0) + 1
    return hits[hits >= WINDOW]


def cut_positions(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> tuple[list[int], list[bool], bool]:
    """(ends of the pieces, whether each end is natural, whether a stretch is longer than the limit)."""
    natural = np.array(boundaries(text), np.int64)
    marks = landmarks(text)
    size, at = len(text), 0
    ends: list[int] = []
    kinds: list[bool] = []
    while True:
        room = limit if at == 0 else limit - overlap
        if size - at <= room:
            break
        low, high = np.searchsorted(natural, at, "right"), np.searchsorted(natural, at + room, "right")
        if high > low:
            near = natural[low:high]
            far = near[near >= at + least]
            if len(far) == 0:
                end = int(near[-1])
            else:
                k = np.searchsorted(marks, at + least)
                mark = int(marks[k]) if k < len(marks) and marks[k] <= at + room else at + room
                end = int(far[np.argmin(np.abs(far - mark))])
            ok = True
        else:
            spaces = [m.end() for m in SPACE.finditer(text, at + max(1, room // 2), at + room)]
            end, ok = (spaces[-1] if spaces else at + room), False
        ends.append(end)
        kinds.append(ok)
        at = end
    ends.append(size)
    kinds.append(True)
    return ends, kinds, longest_stretch(natural.tolist(), size) > limit


PIECE = "array<struct<piece_no:int,piece_start:int,piece_end:int,overlap_chars:int,natural_end:boolean,forced_item:boolean>>"


def pieces_of(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """The pieces of each text as spans; null for null."""
    fields = [pa.field("piece_no", pa.int32()), pa.field("piece_start", pa.int32()), pa.field("piece_end", pa.int32()), pa.field("overlap_chars", pa.int32()), pa.field("natural_end", pa.bool_()), pa.field("forced_item", pa.bool_())]

    @F.arrow_udf(PIECE)
    def run(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[], [], [], [], [], []]
        offsets = [0]
        for text in texts.to_pylist():
            if text:
                ends, kinds, forced = cut_positions(text, limit, overlap, least)
                at = 0
                for no, (end, kind) in enumerate(zip(ends, kinds)):
                    back = min(overlap, at)
                    for column, value in zip(columns, (no, at - back, end, back, kind, forced)):
                        column.append(value)
                    at = end
            offsets.append(len(columns[0]))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields))

    return run(text)


def split_items(items: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """The pieces of the rows whose ``text`` is longer than ``limit``: the other columns of ``items``, piece_no,
    piece_start, piece_end (with the overlap in front), natural_end, cut_kind of the item and piece_text."""
    keep = [c for c in items.columns if c != text]
    long = items.where(F.length(text) > limit).withColumn("_p", pieces_of(F.col(text), limit, overlap, least))
    flat = long.select(*[F.col(c) for c in keep], F.col(text).alias("_text"), F.explode("_p").alias("_p"))
    return flat.select(
        *[F.col(c) for c in keep], F.col("_p.piece_no").alias("piece_no"), F.col("_p.piece_start").alias("piece_start"), F.col("_p.piece_end").alias("piece_end"),
        F.col("_p.natural_end").alias("natural_end"), F.when(F.col("_p.forced_item"), "forced").otherwise("natural").alias("cut_kind"),
        F.expr("substring(_text, _p.piece_start + 1, _p.piece_end - _p.piece_start)").alias("piece_text"),
    )


def bibliographic_items(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_kind, item_key, item_no, text: the full texts, section bodies and chunk texts."""
    full = records.select(F.lit("full_text").alias("item_kind"), F.col("record_key").cast("string").alias("item_key"), F.lit(0).alias("item_no"), F.col("full_text").alias("text"))
    bodies = records.where(F.size("sections") > 0).select(F.lit("section").alias("item_kind"), F.col("record_key").cast("string").alias("item_key"), F.posexplode("sections").alias("item_no", "s")).select("item_kind", "item_key", "item_no", F.col("s.body").alias("text"))
    parts = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.lit(0).alias("item_no"), "text")
    return full.unionByName(bodies).unionByName(parts)
