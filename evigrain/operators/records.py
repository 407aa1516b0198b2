"""The record layer: canonical form, identity, collapse of duplicates, statistics, metadata merge."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evigrain.functions import text as T

DDL = "title string, abstract string, doi string, year int, authors array<string>, venue string, full_text string, sections array<struct<heading:string,body:string>>, source string, extra map<string,string>"


def canonical(records: DataFrame, year: str = "year", nfkc: bool = True) -> DataFrame:
    """Normalised fields: texts through text.normalise, DOI, authors sorted without blanks, section headings in lower
    case, sections without a body dropped. Other columns stay."""
    def n(c):
        return T.normalise(c, nfkc)

    authors = F.array_sort(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), T.collapse_space), lambda a: a != ""))
    out = records
    if nfkc:  # one Arrow call a column; arrays go as one text
        joined = n(F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: T.collapse_space(F.coalesce(a, F.lit("")))), "␟"))
        authors = F.array_sort(F.filter(F.transform(F.split(joined, "␟"), lambda a: F.trim(a)), lambda a: a != ""))
    body = F.transform(F.coalesce("sections", F.array().cast("array<struct<heading:string,body:string>>")), lambda s: F.struct(F.lower(T.collapse_space(F.coalesce(s["heading"], F.lit("")))).alias("heading"), T.collapse_space(F.coalesce(s["body"], F.lit(""))).alias("body")))
    return out.withColumns({
        "title": n("title"), "abstract": n("abstract"), "doi": T.normalise_doi("doi"), "venue": n("venue"), "full_text": n("full_text"),
        "authors": authors, "sections": F.filter(body, lambda s: s["body"] != ""), year: F.col(year).cast("int"),
    })


def json_text(c: Column) -> Column:
    """A string as JSON with lower-case escapes, as the identity is defined over."""
    quoted = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    for digit in "ABCDEF":  # Spark writes \\u000E, the identity has \\u000e
        quoted = F.regexp_replace(quoted, r"(?<!\\)((?:\\\\)*\\u00[01])" + digit, "$1" + digit.lower())
    return quoted


def record_id(year: str = "year") -> Column:
    """The first 24 hex digits of the SHA-256 of the canonical fields as compact JSON with sorted keys; source and extra stay
    out, a missing year is null, sections are [heading, body] pairs. Control characters are written \\u00xx in lower case."""
    authors = F.concat(F.lit("["), F.array_join(F.transform("authors", lambda a: json_text(a)), ","), F.lit("]"))
    sections = F.concat(F.lit("["), F.array_join(F.transform("sections", lambda s: F.concat(F.lit("["), json_text(s["heading"]), F.lit(","), json_text(s["body"]), F.lit("]"))), ","), F.lit("]"))
    parts = []
    for name, value in (("abstract", json_text(F.col("abstract"))), ("authors", authors), ("doi", json_text(F.col("doi"))), ("full_text", json_text(F.col("full_text"))), ("sections", sections), ("title", json_text(F.col("title"))), ("venue", json_text(F.col("venue"))), ("year", F.coalesce(F.col(year).cast("string"), F.lit("null")))):
        parts += [F.lit(("," if parts else "") + f'"{name}":'), value]
    return F.substring(F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")), 256), 1, 24)


def content_length() -> Column:
    bodies = F.aggregate(F.coalesce("sections", F.array().cast("array<struct<heading:string,body:string>>")), F.lit(0), lambda n, s: n + F.length(F.coalesce(s["body"], F.lit(""))))
    return F.length(T.text_of("abstract")) + F.length(T.text_of("full_text")) + bodies


def screening_text() -> Column:
    return T.collapse_space(F.concat(T.text_of("title"), F.lit(". "), T.text_of("abstract")))


def body_text() -> Column:
    """Full text, else the section bodies joined, else title and abstract."""
    bodies = F.array_join(F.transform("sections", lambda s: s["body"]), " ")
    return F.when(T.text_of("full_text") != "", F.col("full_text")).when(F.coalesce(F.size("sections"), F.lit(0)) > 0, bodies).otherwise(screening_text())


def canonical_source() -> Column:
    screening, body = screening_text(), body_text()
    return F.when(screening == body, screening).otherwise(F.concat_ws(" ", F.nullif(screening, F.lit("")), F.nullif(body, F.lit(""))))


def winners_and_losers(records: DataFrame, key: str = "dedup_key", rid: str = "record_id", length: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the richest record of each key, ties to the smaller id; winner_id and loser_id of the others).

    The winner is an aggregate (max_by with map-side combine), so a key with a third of all rows doesn't meet in one
    task; losers come from joining the one winner of each key back, skew handled by salting."""
    from evigrain.operators.skew import salted_join

    length = length if length is not None else content_length()
    ranked = records.withColumn("_len", length.cast("long"))
    best = ranked.groupBy(key).agg(F.min(F.struct((-F.col("_len")).alias("l"), F.col(rid).alias("winner_id"))).alias("w"), F.count(F.lit(1)).alias("_w")).select(key, F.col("w.winner_id").alias("winner_id"), "_w")
    tagged = salted_join(ranked, best, [key], "_w", spread_by=[rid])
    winners = tagged.where(F.col(rid) == F.col("winner_id")).drop("_len", "winner_id")
    losers = tagged.where(F.col(rid) != F.col("winner_id")).select("winner_id", F.col(rid).alias("loser_id"))
    return winners, losers


def by_id(records: DataFrame, record_id: str, rid: str = "record_id") -> DataFrame:
    """The record of an id; the filter reaches the scan."""
    return records.where(F.col(rid) == F.lit(record_id))


def corpus_hash(ids: DataFrame, rid: str = "record_id") -> str:
    """SHA-256 over the ids in order. The definition is sequential, so the sorted ids stream through one digest a
    partition at a time; nothing is held. For corpora where a stream of all ids is too slow there is corpus_tree_hash."""
    digest = hashlib.sha256()
    for row in ids.select(rid).where(F.col(rid).isNotNull()).orderBy(rid).toLocalIterator(prefetchPartitions=True):
        digest.update(row[0].encode())
    return digest.hexdigest()


def corpus_tree_hash(ids: DataFrame, rid: str = "record_id", digits: int = 4) -> DataFrame:
    """tree_hash, n: SHA-256 over the digests of the ids that share their first hex digits (65,536 groups at most, so a
    billion ids make groups of some 15,000), each over its ids in order. Equal for equal corpora, wherever computed."""
    groups = ids.where(F.col(rid).isNotNull()).groupBy(F.substring(rid, 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(rid)), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: F.concat(s["p"], s["h"])), ""), 256).alias("tree_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def corpus_statistics(records: DataFrame) -> DataFrame:
    """One row of counts and the chunker they recommend: by section if half of the records have sections, by sentence
    if half have full text, else by record."""
    n = F.count(F.lit(1))
    half = F.greatest(F.lit(1), F.floor(n / 2))
    sections, full = F.count_if(F.coalesce(F.size("sections"), F.lit(0)) > 0), F.count_if(T.text_of("full_text") != "")
    return records.agg(
        n.alias("records"), F.count_if(T.text_of("abstract") != "").alias("with_abstract"), F.count_if(T.text_of("doi") != "").alias("with_doi"), full.alias("with_full_text"), sections.alias("with_sections"),
        F.when(sections >= half, "tei-section").when(full >= half, "sentence").otherwise("record").alias("recommended_chunker"),
    )


def import_counts(records: DataFrame, by: str = "import_id") -> DataFrame:
    """Counters of each import, from its rows before any filter, and its document types."""
    kind = F.coalesce(F.element_at("extra", "document_type"), F.lit(""))
    base = records.groupBy(by).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(T.blank_placeholder(F.col("abstract")) == "").alias("missing_abstract"), F.count_if(T.text_of("doi") == "").alias("missing_doi"))
    kinds = records.where(kind != "").groupBy(by, kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.col("n").cast("string")))), "; ").alias("document_types"))
    return base.join(kinds, by, "left")


def merge_metadata(metadata: DataFrame, texts: DataFrame, payload: list[str]) -> DataFrame:
    """Metadata rows with the ``payload`` columns of the full-text row of the same DOI, else of the same title key; the
    full-text row with the greatest id wins a repeated key; unmatched metadata stays. Adds matched_by.

    ``metadata`` and ``texts`` need record_id, doi and title."""
    def right(key: Column, name: str) -> DataFrame:
        one = texts.withColumn(name, key).where(F.col(name) != "").groupBy(name).agg(F.max_by(F.struct(*payload), "record_id").alias(f"p_{name}"))
        return one

    doi, title = T.normalise_doi("doi"), T.title_key("title")
    keyed = metadata.withColumns({"k_doi": F.nullif(doi, F.lit("")), "k_title": F.nullif(title, F.lit(""))})
    both = keyed.join(right(doi, "k_doi"), "k_doi", "left").join(right(title, "k_title"), "k_title", "left")
    picked = F.coalesce("p_k_doi", "p_k_title")
    return both.select(*[F.col(c) for c in metadata.columns], *[picked[c].alias(f"text_{c}") for c in payload], F.when(F.col("p_k_doi").isNotNull(), "doi").when(F.col("p_k_title").isNotNull(), "title").otherwise("none").alias("matched_by"))
