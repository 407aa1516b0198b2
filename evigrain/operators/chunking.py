"""Chunkers. Each turns records (record_id, source fields) into rows of pieces; the shared tail normalises the text,
drops empty pieces, numbers them by their place, names them by content and locates them in the canonical source."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evigrain.functions import headings, text as T
from evigrain.operators.records import body_text, canonical_source, screening_text

PIECES = "array<struct<section:string,text:string>>"


def piece(section: Column, text: Column) -> Column:
    return F.struct(section.alias("section"), text.alias("text"))


def pack(sentences: Column, most: int, section: Column | None = None) -> Column:
    """Sentences packed greedily up to ``most`` words; one longer than that stays whole. A fold over the lengths finds
    where packs begin, so sentences are copied once, however many there are."""
    section = F.lit("unknown") if section is None else section

    def packed(held: Column) -> Column:
        lengths = F.transform(held, lambda s: T.word_count(s))
        start = F.expr("CAST(named_struct('i', 1, 'n', 0, 'cuts', array()) AS struct<i:int,n:int,cuts:array<int>>)")

        def step(a: Column, n: Column) -> Column:
            opens = (a["i"] == 1) | (a["n"] + n > most)
            return F.struct((a["i"] + 1).alias("i"), F.when(opens, n).otherwise(a["n"] + n).alias("n"), F.when(opens, F.array_append(a["cuts"], a["i"])).otherwise(a["cuts"]).alias("cuts"))

        cuts = F.aggregate(lengths, start, step, lambda a: F.array_append(a["cuts"], a["i"]))
        return T.let(cuts, lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda from_, i: piece(section, F.array_join(F.slice(held, from_, at[i + 1] - from_), " "))))

    return T.let(sentences, packed)


def windows(items: Column, size: int, step: int) -> Column:
    """Runs of ``size`` items every ``step``, the last being the first that reaches the end."""
    def cut(v: Column) -> Column:
        count = F.ceil(F.greatest(F.size(v) - size, F.lit(0)) / step).cast("int") + 1
        return F.when(F.size(v) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(v, i * step + 1, F.lit(size)), " ")))

    return T.let(items, cut)


def record_pieces() -> Column:
    return F.array(piece(F.lit("abstract"), screening_text()))


def fixed_pieces(size: int = 200, overlap: int = 40) -> Column:
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return F.transform(windows(T.words(body_text()), size, size - overlap), lambda t: piece(F.lit("unknown"), t))


def sentence_pieces(max_words: int = 180) -> Column:
    return pack(T.sentences(body_text()), max_words)


def sliding_pieces(window: int = 3, stride: int = 1) -> Column:
    if not 1 <= stride <= window:
        raise ValueError("stride must lie between 1 and window")
    return F.transform(windows(T.sentences(body_text()), window, stride), lambda t: piece(F.lit("unknown"), t))


def section_pieces(max_words: int = 180, keep: tuple[str, ...] | None = None) -> Column:
    """The abstract, then each section packed under its resolved label; records without sections by sentence."""
    kept = headings.resolve(F.col("sections"))
    if keep:
        kept = F.filter(kept, lambda s: s["label"].isin(list(keep)))
    packed = F.flatten(F.transform(kept, lambda s: pack(T.sentences(s["body"]), max_words, s["label"])))
    front = F.when((T.text_of("abstract") != "") & F.lit(not keep or "abstract" in (keep or ())), F.array(piece(F.lit("abstract"), F.col("abstract")))).otherwise(F.expr(f"CAST(array() AS {PIECES})"))
    return F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, F.concat(front, packed)).otherwise(sentence_pieces(max_words))


def paragraph_pieces(min_words: int = 30, max_words: int = 250) -> Column:
    """Paragraphs merged up to ``max_words``, flushed where the section changes. ``min_words`` is part of the spec only:
    a paragraph run is closed at the upper bound, never at the lower."""
    if min_words >= max_words:
        raise ValueError("min_words must be below max_words")
    blank = r"\n\s*\n+"
    own = F.flatten(F.transform("sections", lambda s: F.transform(F.filter(F.split(s["body"], blank), lambda p: F.trim(p) != ""), lambda p: piece(headings.classify(headings.normalise_heading(s["heading"]))["label"], p))))
    plain = F.transform(F.filter(F.split(body_text(), blank), lambda p: F.trim(p) != ""), lambda p: piece(F.lit("unknown"), p))
    parts = F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, own).otherwise(plain)
    sized = F.transform(parts, lambda p: F.struct(p["section"].alias("section"), p["text"].alias("text"), T.word_count(p["text"]).alias("n")))
    start = F.expr(f"CAST(named_struct('done', array(), 'section', 'unknown', 'now', array(), 'n', 0) AS struct<done:{PIECES},section:string,now:array<string>,n:int>)")

    def closed(a: Column) -> Column:
        return F.concat(a["done"], F.array(piece(a["section"], F.array_join(a["now"], " "))))

    def step(a: Column, x: Column) -> Column:
        cut = (F.size(a["now"]) > 0) & ((x["section"] != a["section"]) | (a["n"] + x["n"] > max_words))
        done = F.when(cut, closed(a)).otherwise(a["done"])
        now = F.when(cut, F.array(x["text"])).otherwise(F.concat(a["now"], F.array(x["text"])))
        n = F.when(cut, x["n"]).otherwise(a["n"] + x["n"])
        full = n >= max_words
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(full, F.concat(done, F.array(piece(x["section"], F.array_join(now, " "))))).otherwise(done).alias("done"), x["section"].alias("section"),
            F.when(full, none).otherwise(now).alias("now"), F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    return F.aggregate(sized, start, step, lambda a: F.when(F.size(a["now"]) > 0, closed(a)).otherwise(a["done"]))


def recursive_pieces(size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> Column:
    """Split at the coarsest separator that gives parts within ``size``; each piece after the first begins with the
    last ``overlap`` characters of the one before."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def split(text: str, level: int = 0) -> list[str]:
        if len(text) <= size or level == len(separators):
            return [text]
        mark = separators[level]
        out: list[str] = []
        held: str | None = None
        for part in (text.split(mark) if mark else text):
            if held and len(held) + len(mark) + len(part) <= size:
                held = held + mark + part
            elif not held and len(part) <= size:
                held = part
            else:
                if held:
                    out.append(held)
                held = part if len(part) <= size else None
                if held is None:
                    out += split(part, level + 1)
        if held:
            out.append(held)
        return [p for p in out if p.strip()]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parts = split(text or "")
            return parts[:1] + [f"{a[-overlap:]} {b}" if overlap else b for a, b in zip(parts, parts[1:])]

        return texts.map(one)

    return F.transform(run(body_text()), lambda t: piece(F.lit("unknown"), t))


def semantic_pieces(percentile: float = 95.0, min_sentences: int = 2, max_words: int = 400, jitter: float = 0.0, seed: int = 42, embedder: str = "hash") -> Column:
    """Cut where the cosine distance of consecutive sentences' embeddings (by any registered ``embedder``) reaches the
    record's own percentile."""
    import numpy as np

    from evigrain.functions import embedders

    if not 50.0 <= percentile <= 99.9:
        raise ValueError("percentile must lie between 50 and 99.9")
    model = embedders.model(embedder)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        from evigrain.functions.vectors import seeded

        encode = embedders.encoder(embedder, model=model)

        def one(sentences) -> list[str]:
            s = list(sentences) if sentences is not None else []
            if len(s) <= min_sentences:
                return [" ".join(s)] if s else []
            v = encode(s)
            if jitter:
                v = v + seeded(seed, "semantic-jitter", len(s)).normal(scale=jitter, size=v.shape)
            lengths = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(lengths == 0, 1.0, lengths)
            gaps = 1.0 - (v[:-1] * v[1:]).sum(axis=1)
            bar = np.percentile(gaps, percentile)
            out, now, n = [], [], 0
            for i, sentence in enumerate(s):
                size = len(sentence.split())
                if now and (n + size > max_words or gaps[i - 1] >= bar and len(now) >= min_sentences):
                    out.append(" ".join(now))
                    now, n = [], 0
                now.append(sentence)
                n += size
            return out + [" ".join(now)]

        return lists.map(one)

    return F.transform(run(T.sentences(body_text())), lambda t: piece(F.lit("unknown"), t))


def _spec(name: str, **values) -> str:
    return f"{name}/v1({','.join(f'{k}={v}' for k, v in values.items())})"


NAMES = ("record", "fixed", "sentence", "tei-section", "paragraph", "recursive", "sliding-sentence", "semantic")


_OWN: dict[str, Callable[..., tuple[str, Callable[[], Column]]]] = {}


def register(name: str, make: Callable[..., tuple[str, Callable[[], Column]]]) -> None:
    """A chunker of one's own: ``make(**params)`` gives its spec and a function without arguments that returns the column
    of pieces (PIECES) of a record."""
    _OWN[name] = make


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks by record and place, as a whole corpus is read."""
    return chunks.orderBy("record_id", "ordinal", "chunk_id")


def build(name: str, **p) -> tuple[str, Callable[[], Column]]:
    """(spec, pieces) of a chunker by name."""
    if name in _OWN:
        return _OWN[name](**p)
    if name == "record":
        return "record/v1", record_pieces
    if name == "fixed":
        p = {"size": 200, "overlap": 40} | p
        return _spec("fixed", **p), lambda: fixed_pieces(**p)
    if name == "sentence":
        p = {"max_words": 180} | p
        return _spec("sentence", **p), lambda: sentence_pieces(**p)
    if name == "tei-section":
        keep = tuple(sorted(p.pop("keep_sections", None) or ())) or None
        most = p.get("max_words", 180)
        return _spec("tei-section", max_words=most, keep=",".join(keep) if keep else "all"), lambda: section_pieces(most, keep)
    if name == "paragraph":
        p = {"min_words": 30, "max_words": 250} | p
        return _spec("paragraph", min=p["min_words"], max=p["max_words"]), lambda: paragraph_pieces(**p)
    if name == "recursive":
        p = {"size": 1000, "overlap": 200} | p
        return _spec("recursive", **p), lambda: recursive_pieces(**p)
    if name == "sliding-sentence":
        p = {"window": 3, "stride": 1} | p
        return _spec("sliding-sentence", **p), lambda: sliding_pieces(**p)
    if name == "semantic":
        p = {"percentile": 95.0, "min_sentences": 2, "max_words": 400, "jitter": 0.0, "seed": 42} | p
        from evigrain.functions import embedders

        return _spec("semantic", embedder=embedders.fingerprint(p.get("embedder", "hash")), pct=p["percentile"], min=p["min_sentences"], max_words=p["max_words"], jitter=p["jitter"], seed=p["seed"]), lambda: semantic_pieces(**p)
    raise ValueError(f"unknown chunker {name!r}")


def chunk_id(spec: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "record_id", F.lit(spec), F.col("ordinal").cast("string"), "text"), 256), 1, 20)


def located(source: Column, texts: Column) -> Column:
    """Start and end of each text in ``source``, looked for from a cursor that moves on by half a piece, once more from
    the beginning, else (-1, -1)."""
    start = F.expr("CAST(named_struct('at', 0, 'spans', array()) AS struct<at:int,spans:array<struct<a:int,b:int>>>)")

    def step(source: Column, acc: Column, t: Column) -> Column:
        ahead = F.call_function("locate", t, source, acc["at"] + 1)
        found = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", t, source, F.lit(1))) - 1
        hit = found >= 0
        span = F.struct(F.when(hit, found).otherwise(F.lit(-1)).alias("a"), F.when(hit, found + F.length(t)).otherwise(F.lit(-1)).alias("b"))
        on = F.when(hit, found + F.greatest(F.lit(1), F.floor(F.length(t) / 2).cast("int"))).otherwise(acc["at"])
        return F.struct(on.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return T.let(source, lambda src: F.aggregate(texts, start, lambda acc, t: step(src, acc, t), lambda a: a["spans"]))


def chunk(records: DataFrame, name: str = "sentence", nfkc: bool = False, spans: bool = True, **params) -> DataFrame:
    """chunk_id, record_id, ordinal, text, section, span_start, span_end of canonical records.

    Narrow: no shuffle, one output row a piece. A record without text gives none."""
    spec, pieces = build(name, **params)
    cut = records.select("record_id", canonical_source().alias("_source"), F.transform(pieces(), lambda p, i: F.struct(i.alias("ordinal"), p["section"].alias("section"), T.collapse_space(F.coalesce(p["text"], F.lit(""))).alias("text"))).alias("_p"))
    cut = cut.withColumn("_p", F.filter("_p", lambda p: p["text"] != ""))
    places = located(F.col("_source"), F.transform("_p", lambda p: p["text"])) if spans else F.transform("_p", lambda p: F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    flat = cut.withColumn("_s", places).select("record_id", F.explode(F.arrays_zip("_p", "_s")).alias("z"))
    flat = flat.select("record_id", F.col("z._p.ordinal").cast("int").alias("ordinal"), F.col("z._p.section").alias("section"), F.col("z._p.text").alias("text"), F.col("z._s.a").alias("span_start"), F.col("z._s.b").alias("span_end"))
    if nfkc:
        flat = flat.withColumn("text", T.normalise("text"))
    return flat.select(chunk_id(spec).alias("chunk_id"), "record_id", "ordinal", "text", "section", "span_start", "span_end")
