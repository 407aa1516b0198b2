"""Noise in text from scanned pages.

Running headers are found by fuzzy repetition of lines at page edges (beside page numbers, inside a paragraph) and by
likeness to the record's own title, venue or authors; page numbers by their forms and by counting up. Lines are then
joined to paragraphs. A word parted by a hyphen at a line or page end is made whole if the corpus has the whole word
more often than the hyphenated one; a misread word is put right if a reversed confusion of characters gives a word that
the corpus has far more often.

The corpus vocabulary (word, number of records) is counted over all records' titles, abstracts, full texts and section
bodies. Neither it nor the corrections found in it are broadcast or collected: a filter of fixed size tells which words
can't be misread, and the others and the line-end pairs of a record are joined to the vocabulary by word, and come back
to the record by its key. There is one way for all sizes.

Defined results: null and empty texts stay as they are and have no noise; a text without noise stays exactly as it is,
wrapped or not; texts of any length are read whole; equal texts of equal records give equal results; a record without
a key is left out; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evigrain.llm import filters
from evigrain.operators.skew import salted_join
from evigrain.session import cut

#: What a reader of scans takes for what, misread first.
HARD = (("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("!", "i"))
SOFT = (("c", "e"), ("f", "t"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("vv", "w"))
HYPHENS = "-‐‑­¬"
#: A right word must be this many times as frequent as the misread one, and be in so many records.
RATIO, LEAST = 20, 3

WORD = re.compile(r"!?[^\W\d_][^\W_]*(?:!+[^\W_]+)*|\d+[^\W\d_][^\W_]*(?:!+[^\W_]+)*")
COUNTED = re.compile(r"!?[^\W_]+(?:!+[^\W_]+)*(?:-[^\W_]+)*")
BROKEN = re.compile(rf"[^\W_]+[{HYPHENS}][ \t]*\n\s*\S*")
DOUBTFUL = re.compile("|".join(bad for bad, _ in HARD + SOFT))
HARD_SIGN = re.compile(r"[^\W\d_][01569!]|[01569!][^\W\d_]")
LINE_END = re.compile(rf"[{HYPHENS}][ \t]*\n")
PAGE = re.compile(r"^\s*(?:(?P<roman>[ivxlc]{1,7})|[-–—]\s*(?P<a>\d{1,4})\s*[-–—]|\[\s*(?P<b>\d{1,4})\s*\]|(?:p\.|pp\.|page|seite|s\.)\s*(?P<c>\d{1,4})(?:\s*(?:of|/|von)\s*\d{1,4})?|(?P<d>\d{1,4})\s*(?:of|/)\s*\d{1,4}|(?P<e>\d{1,4})\s*\|\s*\d{1,4}|(?P<f>\d{1,4}))\s*$", re.I)
ROMAN = re.compile(r"^(?=.)(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
YEAR_END = re.compile(r"\s{2,}(?:1[89]|20)\d\d\s*$")
ET_AL = re.compile(r"^\S.{1,60}? et al\.?\s*(?:(?:1[89]|20)\d\d)?$")


def skeleton(text: str | None) -> str:
    """A form that misreading doesn't change: every confusion made, letters and digits only."""
    if not text:
        return ""
    text = text.lower()
    for bad, good in HARD + SOFT[2:] + SOFT[:2]:
        text = text.replace(bad, good)
    return "".join(filter(str.isalnum, text))


def alike(line: str, full: str) -> bool:
    """Whether ``line`` is ``full`` or its beginning, but for a few characters (both skeletons). Of a line that differs
    in at most 12 % of its characters, one of its pieces of six stands in the other unharmed."""
    if len(line) < 8 or len(line) > len(full) + 4:
        return False
    head = full[: len(line)]
    if line == head:
        return True
    near = full[: len(line) + 4]
    if not any(line[i : i + 6] in near for i in range(0, len(line) - 5, 6)):
        return False
    return SequenceMatcher(None, line, head, autojunk=False).ratio() >= 0.88


def read_pages(text: str, title: str | None, venue: str | None, authors) -> tuple[list[str | None], bool, bool]:
    """(the lines, None where a line is page furniture; whether a header, a page number was found)."""
    lines: list[str | None] = text.split("\n")
    if len(lines) < 2:
        return lines, False, False
    own = [s for s in map(skeleton, [title, venue, *(authors if authors is not None else [])]) if len(s) >= 8]
    stripped = [line.strip() for line in lines]
    width = max(map(len, stripped))
    page = [False] * len(lines)
    numbers: dict[int, str] = {}
    for i, line in enumerate(stripped):
        m = PAGE.match(line) if line and len(line) < 24 else None
        if m and (m.group("roman") is None or ROMAN.match(m.group("roman").lower())):
            page[i] = True
            numbers[i] = next(v for v in m.groups() if v is not None)
    heads: dict[int, str] = {}
    for i, line in enumerate(stripped):
        if line and not page[i] and len(line) <= 110 and (line[-1] not in ".;:" or ET_AL.match(line)):
            heads[i] = skeleton(re.sub(r"\d{4}$", "", line))
    counts = Counter(h for h in heads.values() if len(h) >= 8)

    def inside(i: int) -> bool:
        """Whether a line touches a line of text, other furniture left aside, and is neither the first nor the last."""
        a, b = i - 1, i + 1
        while a >= 0 and (page[a] or a in header):
            a -= 1
        while b < len(lines) and (page[b] or b in header):
            b += 1
        return a >= 0 and b < len(lines) and bool(stripped[a] or stripped[b])

    header: set[int] = set()
    for i, h in heads.items():
        line = stripped[i]
        near = (i > 0 and page[i - 1]) or (i + 1 < len(lines) and page[i + 1])
        if line[:1].islower() and counts[h] < 2 and not near and not ET_AL.match(line):
            continue
        if counts[h] > 1 and not line.endswith((".", "!", "?")):  # it repeats
            header.add(i)
        elif ET_AL.match(line) or any(alike(h, s) for s in own):  # met once only, but by its words a header
            if len(line) < 0.9 * width or near or counts[h] > 1:
                header.add(i)
        elif YEAR_END.search(line) and line[:1].isupper():
            header.add(i)
        elif near and line[:1].isupper() and not line.endswith((".", "!", "?", ",", ";", ":")) and len(line) < 0.9 * width and (line.isupper() or len(h) >= 8 and sum(w[:1].isupper() for w in line.split()) * 2 > len(line.split())):
            header.add(i)
    # fuzzy repetition: a line like one that is a header already
    pieces: dict[str, set[str]] = {}  # lines that are alike share one of their pieces of six signs
    for h in {heads[k] for k in header}:
        for at in range(len(h) - 5):
            pieces.setdefault(h[at : at + 6], set()).add(h)
    for i, h in heads.items() if pieces else ():
        if i not in header and len(h) >= 8:
            near = set().union(*(pieces.get(h[at : at + 6], ()) for at in range(0, len(h) - 5, 6)))
            if any(abs(len(h) - len(k)) < 4 and alike(h, k) for k in near):
                header.add(i)
    header = {i for i in header if inside(i)}
    values = sorted((i, int(v)) for i, v in numbers.items() if v.isdigit())
    sequence = {i for (a, x), (b, y) in zip(values, values[1:]) if 0 < y - x <= 3 for i in (a, b)}
    found = {i for i in numbers if inside(i) or i in sequence and ((i > 0 and i - 1 in header) or (i + 1) in header)}
    for i in header | found:
        lines[i] = None
    return lines, bool(header), bool(found)


SPLIT = re.compile(rf"([^\W_][^\s]*?)[{HYPHENS}]+[ \t]*$")
FIRST = re.compile(r"^[ \t]*([^\W_][^\s]*)")
ENDS = frozenset(HYPHENS)
EDGE = ".,;:()[]{}“”\"'’‘?*"


def joints(lines: list[str | None]) -> list[tuple[int, int, str, str]]:
    """(line, next line, left part, right part) of the hyphens at line ends; furniture between is skipped."""
    out = []
    kept = [i for i, line in enumerate(lines) if line is not None]
    for a, b in zip(kept, kept[1:]):
        m = SPLIT.search(lines[a]) if lines[a].rstrip(" \t")[-1:] in ENDS else None
        n = FIRST.match(lines[b]) if m else None
        if n and not n.group(1)[0].isdigit():
            out.append((a, b, m.group(1).lstrip(EDGE), n.group(1)))
    return out


def core_word(part: str) -> str:
    return part.strip(EDGE).lower()


def whole(left: str, right: str, counts: dict[str, int]) -> bool:
    """Whether the parts are one word not written with a hyphen."""
    left, right = core_word(left), core_word(right)
    both, hyphened = counts.get(left + right, 0), counts.get(f"{left}-{right}", 0)
    if both or hyphened:
        return both >= hyphened
    last, first = left.rpartition("-")[2], right.partition("-")[0]
    both, hyphened = counts.get(last + first, 0), counts.get(f"{last}-{first}", 0)
    if both or hyphened:
        return both >= hyphened
    return not (counts.get(last, 0) >= LEAST and counts.get(first, 0) >= LEAST)


#: A longer run of letters is no word that could be misread (a sequence, a key).
LONGEST_WORD = 60


def fixes(word: str) -> set[str]:
    """Words of which ``word`` may be a misreading: all hard signs put right, and one soft confusion reversed."""
    if len(word) > LONGEST_WORD:
        return set()
    base = word
    for bad, good in HARD:
        base = base.replace(bad, good)
    out = {base} if base != word and not base.isdigit() else set()
    for start in {word, base}:
        for bad, good in SOFT + HARD:
            at = start.find(bad)
            while at >= 0:
                out.add(start[:at] + good + start[at + len(bad) :])
                at = start.find(bad, at + 1)
    out.discard(word)
    return {w for w in out if w.isalpha()}


def plainly_misread(word: str) -> str | None:
    """The reading of a word whose hard signs stand between letters, for words the vocabulary doesn't have."""
    if len(word) > LONGEST_WORD or sum(c.isalpha() for c in word) < 6 or not re.fullmatch(r"[^\W\d_]{2,}(?:[01569!][^\W\d_]+){1,2}", word):
        return None
    for bad, good in HARD:
        word = word.replace(bad, good)
    return word


def matched_case(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


class Doubts(dict):
    """Whether a word in lower case is to be looked up: it has a hard sign, or the filter of the misread words lets it
    through."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = np.frombuffer(bits, np.uint8)

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        open_ = len(word) > 1 and DOUBTFUL.search(word) is not None
        # the same hash as the built-in function of the engine
        self[word] = seen = open_ and (HARD_SIGN.search(word) is not None or len(filters.passing(self.bits, np.array([xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)], np.uint64))) > 0)
        return seen


def lookups(text: str | None, title: str | None, venue: str | None, authors, doubts: Doubts) -> list[str]:
    """The words to look up for a text: doubtful ones, and the forms of its line-end pairs."""
    if not text:
        return []
    out = {w for w in set(WORD.findall(text.lower())) if doubts[w]}
    if not LINE_END.search(text):
        return sorted(out)
    lines, _, _ = read_pages(text, title, venue, authors)
    for _, _, left, right in joints(lines):
        left, right = core_word(left), core_word(right)
        last, first = left.rpartition("-")[2], right.partition("-")[0]
        for a, b in ((left, right), (last, first)):
            out |= {a + b, f"{a}-{b}", a, b}
    return sorted(out)


def misread_words(text: str, counts: dict[str, int], right: dict[str, str]) -> dict[str, str]:
    """The misread words of a text in lower case, with what they stand for."""
    words = set(WORD.findall(text.lower()))
    found = {w: right[w] for w in words & right.keys()}
    for w in words:
        if not w.isalpha() and w not in found and HARD_SIGN.search(w) and counts.get(w, 0) < LEAST and (new := plainly_misread(w)):
            found[w] = new
    return found


def mend(text: str | None, title: str | None, venue: str | None, authors, counts: dict[str, int], right: dict[str, str]) -> tuple[str | None, list[str]]:
    """(readable text, kinds of noise found)."""
    if not text:
        return text, []
    lines, header, number = read_pages(text, title, venue, authors)
    kinds = set()
    if header:
        kinds.add("running_header")
    if number:
        kinds.add("page_number")
    parted = {a: (b, left, r) for a, b, left, r in joints(lines)}
    kept = [i for i, line in enumerate(lines) if line is not None]
    paragraphs: list[str] = []
    now = ""
    glue = False
    for i in kept:
        line = lines[i].strip()
        if not line:
            if now and not glue:
                paragraphs.append(now)
                now = ""
            continue
        now = now + line if glue or not now else f"{now} {line}"
        glue = False
        if i in parted:
            _, left, r = parted[i]
            if whole(left, r, counts):
                kinds.add("hyphenation")
                now = now.rstrip().rstrip(HYPHENS)
            glue = True
    if now:
        paragraphs.append(now)
    mended = "\n\n".join(paragraphs)
    fix = misread_words(mended, counts, right)
    if fix:
        mended = WORD.sub(lambda m: matched_case(fix[m.group().lower()], m.group()) if m.group().lower() in fix else m.group(), mended)
    # a misread word may stand in the furniture only
    if fix or (header and misread_words("\n".join(line for i, line in enumerate(text.split("\n")) if lines[i] is None), counts, right)):
        kinds.add("misread")
    return (mended, sorted(kinds)) if kinds else (text, [])


#: Distinct words a task holds before it passes its counts on.
HELD_WORDS = 300_000


def vocabulary(records: DataFrame) -> DataFrame:
    """word, n: the number of texts that hold it, over titles, abstracts, full texts and section bodies of all records.
    Words parted at line ends are left out. Each task counts its own batches before the shuffle."""
    bodies = F.coalesce(F.transform("sections", lambda s: s["body"]), F.array().cast("array<string>"))

    def count(parts):
        counts: Counter = Counter()

        def out():
            words = list(counts)
            done = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()
            return done

        for part in parts:
            for texts in part.column(0).to_pylist():
                for text in texts:
                    if text:
                        low = text.lower()
                        counts.update(set(COUNTED.findall(BROKEN.sub(" ", low) if LINE_END.search(low) else low)))
                if len(counts) > HELD_WORDS:
                    yield out()
        yield out()

    words = records.select(F.concat(F.array("title", "abstract", "full_text"), bodies).alias("t")).mapInArrow(count, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame) -> DataFrame:
    """word, fix: the misread words and what they stand for."""

    @F.pandas_udf("array<string>")
    def candidates(ws: pd.Series) -> pd.Series:
        return ws.map(lambda w: sorted(fixes(w)))

    doubtful = words.where(F.col("word").rlike("|".join(b for b, _ in HARD + SOFT)) & ~F.col("word").contains("-"))
    pairs = doubtful.select("word", "n", F.explode(candidates("word")).alias("fix"))
    known = words.where(F.col("n") >= LEAST).select(F.col("word").alias("fix"), F.col("n").alias("m"))
    good = pairs.join(known, "fix").where(F.col("m") >= RATIO * F.col("n"))
    hard = pairs.where(F.col("word").rlike("[01569!]")).join(known, "fix").where(F.col("m") >= F.col("n"))
    return good.unionByName(hard).groupBy("word").agg(F.max_by("fix", F.struct("m", "fix")).alias("fix"))


#: Bytes of the filter of misread words (a million of them: one sound word in 160 is looked up by chance).
FILTER_BYTES = 2 << 20


def repair(records: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """record_key, field_name, text_repaired and noise_kinds of the full texts and titles with noise."""
    words = cut(vocabulary(records))
    wrong = cut(corrections(words))
    shared = records.sparkSession.sparkContext.broadcast(filters.built(wrong.select(F.xxhash64("word").alias("h")), filter_bytes))
    fields = F.array(F.struct(F.lit("full_text").alias("field_name"), F.col("full_text").alias("t")), F.struct(F.lit("title").alias("field_name"), F.col("title").alias("t")))
    items = records.where("record_key IS NOT NULL").select("record_key", "venue", "authors", F.col("title").alias("own_title"), F.explode(fields).alias("f"))
    items = items.select("record_key", "f.field_name", "venue", "authors", F.when(F.col("f.field_name") == "full_text", F.col("own_title")).alias("own_title"), F.col("f.t").alias("text")).where("text IS NOT NULL AND text <> ''")

    @F.pandas_udf("array<string>")
    def wanted(text: pd.Series, title: pd.Series, venue: pd.Series, authors: pd.Series) -> pd.Series:
        doubts = Doubts(shared.value)
        return pd.Series([lookups(*row, doubts) for row in zip(text, title, venue, authors)], dtype=object)

    @F.pandas_udf("struct<text_repaired:string,noise_kinds:array<string>>")
    def mended(text: pd.Series, title: pd.Series, venue: pd.Series, authors: pd.Series, names: pd.Series, counts: pd.Series, right: pd.Series) -> pd.DataFrame:
        done = []
        for t, ti, v, a, w, n, r in zip(text, title, venue, authors, names, counts, right):
            w, n, r = ([] if x is None else x for x in (w, n, r))
            done.append(mend(t, ti, v, a, dict(zip(w, n)), {x: y for x, y in zip(w, r) if y}))
        return pd.DataFrame({"text_repaired": [d[0] for d in done], "noise_kinds": [d[1] for d in done]})

    asked = items.select("record_key", "field_name", F.explode(wanted("text", "own_title", "venue", "authors")).alias("word"))
    lexicon = words.join(wrong, "word", "left").where(F.col("fix").isNotNull() | (F.col("n") >= LEAST))
    # of doubtful words only the misread ones matter, of line-end pairs all forms; words in use come with their counts
    answers = salted_join(asked, lexicon.withColumn("_w", F.col("n")), ["word"], "_w").groupBy("record_key", "field_name").agg(F.collect_list(F.struct("word", "n", F.coalesce("fix", F.lit("")).alias("fix"))).alias("a"))
    seen = items.join(answers, ["record_key", "field_name"], "left").select("record_key", "field_name", mended("text", "own_title", "venue", "authors", F.col("a.word"), F.col("a.n"), F.col("a.fix")).alias("r"))
    return seen.select("record_key", "field_name", "r.text_repaired", "r.noise_kinds").where(F.size("noise_kinds") > 0)
