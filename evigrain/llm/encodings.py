"""Garbled text from wrong character encoding.

A hidden Markov model with one clean state and one state per encoding pair labels the characters outside ASCII; a
garbled stretch gets its state's inverse transform (back to bytes by the wrong encoding, decoded by the right one).
Characters of ASCII are the same in every state, so they need no step. A character's emission is its probability
between the classes of its neighbours, times the share of their scripts: in the clean state of the character as it stands, in a pair's state of the
character it turns back into (the further characters of a multi-byte sequence then cost little, characters that can't
be turned back much). A state is entered and left between whole sequences only.

The probabilities are learnt over all documents by expectation-maximisation. One scan counts the distinct clusters of
characters outside ASCII with the classes of their neighbours; the first model leaves out what reads as a multi-byte
sequence of a pair and is rarer than the character it would stand for, and each further round weighs every character of every cluster by the chance that the last model
gives it to be clean (forward-backward), so that what only looked like a sequence comes back and garbled text doesn't
pass for usual text. All smoothing is by shares of the counts, never by numbers of documents, so a corpus of the same
mix gives the same labels at every size. The rounds run over the distinct clusters, distributed; the model is small
whatever the corpus: neighbour classes x characters of Unicode.

Defined results: a null text stays null and is no case; an empty one stays empty; texts of any length are read whole;
equal texts give equal results; U+FFFD marks a lost character, so a text with one is a case that can't be restored;
other columns are kept by ``repair``, and clashing names there are the caller's to avoid (text_repaired, spans,
restored, affected); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evigrain.session import cut, spread

#: (right encoding, wrong encoding it was read with), twice where it happened twice.
PAIRS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "cp1252"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "cp1250"),), (("utf-8", "cp1251"),),
    (("utf-8", "cp437"),), (("utf-8", "cp850"),), (("utf-8", "mac_roman"),), (("utf-8", "koi8_r"),), (("utf-8", "cp866"),),
    (("cp1252", "cp437"),), (("cp1252", "cp850"),), (("cp1252", "mac_roman"),), (("cp1252", "cp1250"),), (("cp1252", "cp1251"),),
    (("mac_roman", "cp1252"),), (("cp850", "cp1252"),), (("cp437", "cp1252"),), (("cp1250", "cp1252"),),
    (("cp1251", "cp1252"),), (("cp1251", "koi8_r"),), (("cp1251", "cp866"),), (("cp1251", "mac_roman"),), (("koi8_r", "cp1251"),), (("koi8_r", "cp1252"),), (("cp866", "cp1251"),), (("cp866", "cp1252"),),
)
#: INVALID: a character that can't be turned back is so much less likely in a pair's state than in the clean one.
#: ALONE: a sign that stands alone between no letters (a rare symbol, say) gains no more than this in a pair of single-byte
#: encodings, so that it takes several to speak for one.
ALONE = 3.0
ENTER, LEAVE, INVALID = math.log(1e-3), math.log(0.05), -15.0
#: A further character of a multi-byte sequence costs this much.
FURTHER = -1.0
#: Shares of all counts: a pair of neighbour classes rarer than SMOOTH has mostly the characters' overall shares, and a
#: character that was never seen has the share FLOOR.
SMOOTH, FLOOR = 5e-5, 2.5e-11
#: The share of a sequence of three scripts counts with this power, so that what only garbled text has doesn't pass for
#: usual because it is usual among its rare neighbours. Small and capital letters are of one script.
SCRIPT = 0.5
ROUNDS = 1
CLUSTER = re.compile(r"[^\x00-\x7f]+")
#: A cluster longer than this is labelled in pieces (a number of whole sequences of two, three or four characters).
PIECES = re.compile(r"([^\x00-\x7f]{1,4092})")
#: Characters of clusters whose emissions, and whose gains alone, a task remembers.
REMEMBERED, NOTED = 200_000, 4_000_000
#: A character before, at most 64 characters outside ASCII, a character after.
COUNTED = re.compile(r"(?:(?<=([\s\S]))|(?<![\s\S]))([^\x00-\x7f]{1,64})(?=([\s\S]?))")
#: Weights are summed as whole numbers of this part, so that sums don't depend on their order.
UNIT = 1_000_000
LOST = "�"


def byte_table(codec: str) -> list[str]:
    """Characters of the bytes 128-255; a byte without one keeps its number, as lenient decoders have it."""
    table = []
    for b in range(128, 256):
        try:
            table.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            table.append(chr(b))
    return table


def to_bytes(codec: str) -> dict[str, int]:
    back = {chr(b): b for b in range(128, 160)} if codec == "cp1252" else {}
    return back | {c: b + 128 for b, c in enumerate(byte_table(codec))}


def char_class(c: str) -> str:
    if not c or c.isspace():
        return "s"
    if c.isascii():
        return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "p"
    if c.isalpha():
        name = unicodedata.name(c, "")
        script = "a" if name.startswith("LATIN") else "c" if name.startswith("CYRILLIC") else "g" if name.startswith("GREEK") else "o"
        return script.upper() if c.isupper() else script
    return "x"


class Classes(dict):
    def __missing__(self, c: str) -> str:
        self[c] = k = char_class(c)
        return k


class Inverse:
    """A pair's way back: lists of (character or None, number of characters it stands for)."""

    def __init__(self, steps: tuple[tuple[str, str], ...]):
        self.steps = [(right == "utf-8", to_bytes(wrong), None if right == "utf-8" else byte_table(right)) for right, wrong in reversed(steps)]
        multi, back, _ = self.steps[0]
        #: Characters without one of which nothing can be turned back.
        self.leads = frozenset(c for c, b in back.items() if 0xC2 <= b <= 0xF4) if multi else frozenset(back)

    def units(self, cluster: str) -> list[tuple[str | None, int]]:
        units: list[tuple[str | None, int]] = [(c, 1) for c in cluster]
        for multi, back, table in self.steps:
            out: list[tuple[str | None, int]] = []
            if not multi:
                for c, n in units:
                    b = back.get(c) if c else None
                    out.append((table[b - 128] if b is not None else None, n))
            else:
                codes = [back.get(c) if c else None for c, _ in units]
                i = 0
                while i < len(units):
                    b = codes[i]
                    need = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
                    part = codes[i : i + need]
                    if need and len(part) == need and None not in part:
                        try:
                            out.append((bytes(part).decode("utf-8"), sum(n for _, n in units[i : i + need])))
                            i += need
                            continue
                        except UnicodeDecodeError:
                            pass
                    out.append((None, units[i][1]))
                    i += 1
            units = out
        return units


#: Pairs whose wrong encoding has so few letters in use that a valid multi-byte sequence is hardly ever usual text.
TELLING = tuple(p for p in PAIRS if len(p) == 1 and p[0][0] == "utf-8" and p[0][1] not in ("koi8_r", "cp866"))


def sequences(cluster: str, inverses: list[Inverse]) -> set[tuple[int, str, str]]:
    """(place, sequence, character it stands for) of the valid multi-byte sequences of telling pairs in a cluster."""
    out = set()
    for inverse in inverses if len(cluster) > 1 else ():
        at = 0
        for c, n in inverse.units(cluster):
            if c is not None:
                out.add((at, cluster[at : at + n], c))
            at += n
    return out


class Gains(dict):
    """The most that any pair's state gains within a cluster, by the characters around it and the cluster."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.held = 0

    def __missing__(self, key: tuple[str, str, str]) -> float:
        self.held += len(key[1])
        if self.held > NOTED:
            self.clear()
            self.held = 0
        classes = self.model.classes
        self[key] = gain = self.model.emissions(classes[key[0]], key[1], classes[key[2]])[2][0]
        return gain


class Model:
    """Weights of characters between neighbour classes, and the labelling they lead to. Only their proportions matter."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        self.near: Counter = Counter()
        self.context: Counter = Counter()
        self.single: Counter = Counter()
        self.scripts: Counter = Counter()
        self.classes = Classes()
        for before, c, after, n in counts:
            self.near[before, c, after] += n
            self.context[before, after] += n
            self.single[c] += n
            self.scripts[before.lower(), self.classes[c].lower(), after.lower()] += n
        self.total = sum(self.single.values()) or 1
        self.inverses = [Inverse(p) for p in PAIRS]
        #: Columns of the pairs of single-byte encodings.
        self.single_byte = [i + 1 for i, p in enumerate(PAIRS) if all(right != "utf-8" for right, _ in p)]
        self.cache: dict = {}
        self.held = 0
        self.logs: dict = {}
        self.gains = Gains(self)

    def log_p(self, before: str, c: str, after: str) -> float:
        key = before, c, after
        if (v := self.logs.get(key)) is None:
            overall = (self.single[c] / self.total + FLOOR) / (1 + 1000 * FLOOR)
            v = math.log((self.near[key] / self.total + SMOOTH * overall) / (self.context[before, after] / self.total + SMOOTH))
            script = self.scripts[before.lower(), self.classes[c].lower(), after.lower()] / self.total
            self.logs[key] = v = v + SCRIPT * math.log((script + SMOOTH) / (1 + SMOOTH))
        return v

    def scored(self, units: list[tuple[str | None, int]], raw: str, before: str, after: str) -> tuple[np.ndarray, np.ndarray]:
        """(score, NaN where a character can't be turned back; whether a unit begins there) of each character."""
        scores, starts = np.zeros(len(raw)), np.zeros(len(raw), bool)
        chars, places, at = [], [], 0
        for c, n in units:
            chars.append(c)
            places.append(at)
            at += n
        starts[places] = True
        for k, (c, n) in enumerate(units):
            if c is None:
                scores[places[k] : places[k] + n] = 0.0 if raw[places[k]] == LOST else np.nan
                continue
            left = before if k == 0 else self.classes[chars[k - 1] or raw[places[k] - 1]]
            right = after if k + 1 == len(units) else self.classes[chars[k + 1] or raw[places[k + 1]]]
            scores[places[k]] = self.log_p(left, c, right)
            scores[places[k] + 1 : places[k] + n] = FURTHER
        return scores, starts

    def emissions(self, before: str, cluster: str, after: str) -> tuple:
        """(characters by states, unit starts by states, bounds, bounds of each pair) of a cluster between two classes.
        Bounds: how much a pair's state gains on the clean one at most within the cluster, from its beginning, up to its
        end, and over the whole of it; the first four are the most of any pair."""
        key = before, cluster, after
        if (v := self.cache.get(key)) is None:
            n = len(cluster)
            clean, _ = self.scored([(c if c != LOST else None, 1) for c in cluster], cluster, before, after)
            bad, each = np.full(n, np.nan), np.ones(n, bool)
            held = set(cluster)
            columns = [(clean, each), *((bad, each) if inv.leads.isdisjoint(held) and LOST not in held else self.scored(inv.units(cluster), cluster, before, after) for inv in self.inverses)]
            e, starts = np.stack([c[0] for c in columns], axis=1), np.stack([c[1] for c in columns], axis=1)
            e = np.where(np.isnan(e), e[:, :1] + INVALID, e)
            if n == 1 and before in "sdp" and after in "sdp":
                e[:, self.single_byte] = np.minimum(e[:, self.single_byte], e[:, :1] + ALONE)
            sums = np.concatenate([np.zeros((1, e.shape[1] - 1)), (e[:, 1:] - e[:, :1]).cumsum(axis=0)])
            # from a unit's start (or the end) to a unit's start (or the end)
            edge = np.concatenate([starts[:, 1:], np.ones((1, e.shape[1] - 1), bool)])
            high, low = np.where(edge, sums, -np.inf), np.where(edge, sums, np.inf)
            pre, total = np.maximum(high.max(axis=0), 0), sums[-1]
            suf = np.maximum(total - low.min(axis=0), 0)
            sub = np.maximum((high - np.minimum.accumulate(low, axis=0)).max(axis=0), 0)
            v = e, starts, (float(sub.max()), float(pre.max()), float(suf.max()), float(total.max())), (sub, pre, suf, total)
            self.held += n
            if self.held > REMEMBERED:
                self.cache.clear()
                self.held = 0
            self.cache[key] = v
        return v

    def clean_chance(self, before: str, cluster: str, after: str) -> np.ndarray:
        """The chance of each character of a cluster to be clean, by forward-backward over the cluster."""
        e, starts, _, _ = self.emissions(before, cluster, after)
        n = len(cluster)
        shut = np.where(starts[:, 1:], 0.0, -np.inf)  # no way between the clean state and a pair's within a sequence
        f, back = np.empty(e.shape), np.zeros(e.shape)
        f[0, 0], f[0, 1:] = e[0, 0], e[0, 1:] + ENTER + shut[0]
        for i in range(1, n):
            f[i, 0] = e[i, 0] + np.logaddexp(f[i - 1, 0], LEAVE + np.logaddexp.reduce(f[i - 1, 1:] + shut[i]))
            f[i, 1:] = e[i, 1:] + np.logaddexp(f[i - 1, 1:], f[i - 1, 0] + ENTER + shut[i])
        for i in range(n - 2, -1, -1):
            x = e[i + 1] + back[i + 1]
            back[i, 0] = np.logaddexp(x[0], ENTER + np.logaddexp.reduce(x[1:] + shut[i + 1]))
            back[i, 1:] = np.logaddexp(x[1:], LEAVE + x[0] + shut[i + 1])
        g = f + back
        return np.exp(g[:, 0] - np.logaddexp.reduce(g, axis=1))

    def label(self, text: str) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, states of the characters) of the clusters of a text in which something is garbled, else []."""
        pieces = PIECES.split(text)
        around = zip([p[-1:] for p in pieces[:-1:2]], pieces[1::2], [p[:1] for p in pieces[2::2]])
        if sum(map(self.gains.__getitem__, around)) + ENTER <= 0:  # all clusters together don't gain enough
            return []
        values, top, run = [], 0.0, 0.0
        classes, cache = self.classes, self.cache
        for i in range(1, len(pieces), 2):
            before, after = pieces[i - 1][-1:] or "".join(pieces[i - 2 : i - 1])[-1:], pieces[i + 1][:1] or "".join(pieces[i + 2 : i + 3])[:1]
            key = classes[before], pieces[i], classes[after]
            v = cache.get(key) or self.emissions(*key)
            values.append(v)
            sub, pre, suf, total = v[2]
            top = max(top, sub, run + pre)
            run = max(run + total, suf)
        if top + ENTER <= 0:  # no run of clusters gains enough even with the best pair for each
            return []
        parts, at = [], 0
        for i, v in enumerate(values):
            at += len(pieces[2 * i])
            parts.append((at, at + len(pieces[2 * i + 1]), v))
            at = parts[-1][1]
        best, runs = np.zeros(len(PAIRS)), np.zeros(len(PAIRS))
        for _, _, v in parts:  # no run of clusters that gains enough, no garbled span
            sub, pre, suf, total = v[3]
            best = np.maximum(np.maximum(best, sub), runs + pre)
            runs = np.maximum(runs + total, suf)
        if best.max() + ENTER <= 0:
            return []
        open_ = [0, *(np.flatnonzero(best + ENTER > 0) + 1).tolist()]
        states = self.viterbi(np.concatenate([v[0][:, open_] for _, _, v in parts]), np.concatenate([v[1][:, open_] for _, _, v in parts]))
        if not any(states):
            return []
        out, at = [], 0
        names = np.array(open_)
        for s, e, _ in parts:
            out.append((s, e, names[states[at : at + e - s]]))
            at += e - s
        return out

    @staticmethod
    def viterbi(em: np.ndarray, starts: np.ndarray) -> list[int]:
        """The best path, state 0 being the clean one; only few pairs are left open, so plain lists are quickest."""
        rows, opens = em.tolist(), starts.tolist()
        others = range(1, em.shape[1])
        never = -math.inf
        clean = rows[0][0]
        score = [ENTER + x for x in rows[0][1:]]
        back: list[list[int]] = []
        for row, free in zip(rows[1:], opens[1:]):
            best = max(others, key=lambda p: score[p - 1] if free[p] else never)
            leave = score[best - 1] + LEAVE if free[best] else never
            come = clean + ENTER
            froms = [best if leave > clean else 0]
            clean = row[0] + max(clean, leave)
            for p in others:
                x = score[p - 1]
                enter = come if free[p] else never
                froms.append(p if x >= enter else 0)
                score[p - 1] = row[p] + max(x, enter)
            back.append(froms)
        state = max(range(em.shape[1]), key=lambda p: clean if p == 0 else score[p - 1])
        path = [state]
        for froms in reversed(back):
            state = froms[state]
            path.append(state)
        return path[::-1]

    def repair(self, text: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
        """(the text put right, spans (start, end, pair number, restored); a pair of -1 is a lost character)."""
        labelled = self.label(text)
        if not labelled and LOST not in text:
            return text, []
        spans: list[list] = []
        out, done = [], 0
        for s, e, states in labelled:
            out.append(text[done:s])
            done = e
            at = 0
            while at < e - s:
                state = int(states[at])
                to = at
                while to < e - s and states[to] == state:
                    to += 1
                raw = text[s + at : s + to]
                if state == 0:
                    out.append(raw)
                elif set(raw) == {LOST}:
                    out.append(raw)
                else:
                    units = self.inverses[state - 1].units(raw)
                    ok = all(c is not None and c != LOST for c, _ in units)
                    place = 0
                    for c, n in units:
                        out.append(raw[place : place + n] if c is None else c)
                        place += n
                    if spans and spans[-1][2] == state - 1 and not (set(text[spans[-1][1] : s + at]) - ASCII):
                        spans[-1][1] = s + to
                        spans[-1][3] = spans[-1][3] and ok
                    else:
                        spans.append([s + at, s + to, state - 1, ok])
                at = to
        out.append(text[done:])
        if LOST in text:
            spans += [[m.start(), m.end(), -1, False] for m in re.finditer(LOST + "+", text) if not any(a <= m.start() < b for a, b, _, _ in spans)]
        return "".join(out), [tuple(x) for x in sorted(spans)]


ASCII = set(map(chr, range(128)))


#: Distinct clusters a task holds before it passes their counts on.
HELD = 200_000
KEYS = "b string, s string, a string"


def clusters(documents: DataFrame) -> DataFrame:
    """b, s, a, n: how often a cluster of characters outside ASCII stands between two neighbour classes. Counted in
    each task before the shuffle; a cluster of more than 64 characters is counted in pieces."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counts = Classes(), Counter()

        def out() -> pa.RecordBatch:
            sums: Counter = Counter()
            for (b, s, a), n in counts.items():
                sums[classes[b], s, classes[a]] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.string()) for i in range(3)), pa.array(list(sums.values()), pa.int64())], ["b", "s", "a", "n"])

        for part in parts:
            for text in part.column(0).to_pylist():
                counts.update(COUNTED.findall(text))
                if len(counts) > HELD:
                    yield out()
        yield out()

    found = documents.select("text").where(F.col("text").rlike(r"[^\x00-\x7F]")).mapInArrow(scan, f"{KEYS}, n bigint")
    return found.groupBy("b", "s", "a").agg(F.sum("n").alias("n"))


def telling_inverses() -> list[Inverse]:
    return [Inverse(p) for p in TELLING]


def suspects(found: DataFrame) -> frozenset[str]:
    """The sequences that are rarer than the character they stand for is outside of sequences: only these are taken for
    garbled from the outset. As many rows reach the driver as there are characters and sequences of them in Unicode."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverses, sums = telling_inverses(), Counter()
        for part in parts:
            for s, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen = sequences(s, inverses)
                inside = {i for at, raw, _ in seen for i in range(at, at + len(raw))}
                for i, c in enumerate(s):
                    if i not in inside:
                        sums[c, ""] += n
                for _, raw, c in seen:
                    sums[raw, c] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["s", "c", "n"])

    rows = found.select("s", "n").mapInArrow(scan, "s string, c string, n bigint").groupBy("s", "c").agg(F.sum("n").alias("n")).collect()
    plain = {r.s: r.n for r in rows if not r.c}
    return frozenset(r.s for r in rows if r.c and plain.get(r.c, 0) > r.n)


def weighed(found: DataFrame, model: Model | None) -> Model:
    """The model of the clusters' characters weighed by their chance to be clean under ``model``; without one, those of
    suspect sequences weigh nothing."""
    shared = found.sparkSession.sparkContext.broadcast((model, suspects(found) if model is None else None))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, held), classes, inverses, sums = shared.value, Classes(), telling_inverses(), Counter()

        def plain(s: str) -> list[float]:
            bad = {i for at, raw, _ in sequences(s, inverses) if raw in held for i in range(at, at + len(raw))}
            return [0.0 if i in bad else 1.0 for i in range(len(s))]

        for part in parts:
            for b, s, a, n in zip(*(part.column(i).to_pylist() for i in range(4))):
                chances = plain(s) if model is None else model.clean_chance(b, s, a).tolist()
                kinds = [b, *(classes[c] for c in s), a]
                for i, (c, chance) in enumerate(zip(s, chances)):
                    if c != LOST and (w := round(chance * UNIT)):
                        sums[kinds[i], c, kinds[i + 2]] += n * w
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.string()) for i in range(3)), pa.array([str(v) for v in sums.values()], pa.string())], ["b", "c", "a", "n"])

    # as many rows as the alphabet in use has contexts, whatever the number of documents
    rows = found.mapInArrow(scan, "b string, c string, a string, n string").groupBy("b", "c", "a").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    return Model([(r.b, r.c, r.a, int(r.n)) for r in rows])


def learn(documents: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of a corpus: first without suspect sequences, then, ``rounds`` times, with every character weighed
    by its chance to be clean under the model before."""
    found = cut(spread(clusters(documents)))
    model = weighed(found, None)
    for _ in range(rounds):
        model = weighed(found, model)
    return model


REPAIRED = "struct<text_repaired:string,spans:array<struct<span_start:int,span_end:int,pair:string,restored:boolean>>>"


def repair(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``documents`` with text_repaired, spans, affected and restored. Texts of ASCII alone don't go to Python."""
    shared = documents.sparkSession.sparkContext.broadcast(model or learn(documents))
    names = [" > ".join(f"{right} as {wrong}" for right, wrong in p) for p in PAIRS]

    @F.arrow_udf(REPAIRED)
    def run(texts: pa.Array) -> pa.Array:
        model, fixed, ends, flat = shared.value, [], [0], []
        for text in texts.to_pylist():
            new, found = (None, []) if text is None else model.repair(text)
            fixed.append(new if found else None)
            flat += found
            ends.append(len(flat))
        columns = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([names[x[2]] if x[2] >= 0 else "lost" for x in flat], pa.string()), pa.array([x[3] for x in flat], pa.bool_())]
        spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["span_start", "span_end", "pair", "restored"]))
        return pa.StructArray.from_arrays([pa.array(fixed, pa.string()), spans], ["text_repaired", "spans"])

    odd = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), F.col("text"))
    seen = documents.withColumn("_r", run(odd))
    return seen.select(
        *[F.col(c) for c in documents.columns], F.coalesce("_r.text_repaired", "text").alias("text_repaired"), F.col("_r.spans").alias("spans"),
        (F.size("_r.spans") > 0).alias("affected"), F.forall("_r.spans", lambda s: s["restored"]).alias("restored"),
    )
