"""Readers of bibliographic exports and structured full texts, all into one record schema (operators.records.DDL)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evigrain.functions import text as T
from evigrain.operators.records import DDL

#: The column names of two databases' exports, by field.
SCOPUS = {"title": ("Title",), "abstract": ("Abstract",), "doi": ("DOI",), "year": ("Year",), "authors": ("Authors", "Author full names"), "venue": ("Source title", "Abbreviated Source Title"), "document_type": ("Document Type",), "author_keywords": ("Author Keywords",), "index_keywords": ("Index Keywords",), "cited_by": ("Cited by",), "eid": ("EID",)}
WOS = {"title": ("Article Title", "TI"), "abstract": ("Abstract", "AB"), "doi": ("DOI", "DI"), "year": ("Publication Year", "PY"), "authors": ("Authors", "AU", "Author Full Names"), "venue": ("Source Title", "SO"), "document_type": ("Document Type", "DT"), "author_keywords": ("Author Keywords", "DE"), "index_keywords": ("Keywords Plus", "ID"), "cited_by": ("Times Cited, All Databases", "TC"), "eid": ("UT (Unique WOS ID)", "UT")}
#: Entry types that are no articles.
RIS_SKIPPED = ("GEN", "ICOMM", "ECOMM", "SLIDE", "SOUND", "VIDEO")
BIBTEX_SKIPPED = ("misc", "manual", "unpublished")
EXTRA = ("document_type", "author_keywords", "index_keywords", "cited_by", "eid")


def _shape(df: DataFrame, source: str) -> DataFrame:
    return df.select("title", "abstract", "doi", F.col("year").cast("int").alias("year"), "authors", "venue", "full_text", "sections", F.lit(source).alias("source"), "extra")


def wanted(document_type: Column, abstract: Column, keep_types: tuple[str, ...] = (), require_abstract: bool = False) -> Column:
    """Whether a row of an export is kept: its type among ``keep_types`` (any case), its abstract there."""
    keep = F.lower(document_type).isin([k.lower() for k in keep_types]) if keep_types else F.lit(True)
    return keep & (T.blank_placeholder(abstract) != "") if require_abstract else keep


def read_table(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], source: str, sep: str = ",", keep_types: tuple[str, ...] = (), require_abstract: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, report) of a CSV or TSV export. The first filled of a field's column names counts; the report's counters
    are taken before the filters and name the fields without a column."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).csv(path)
    there = {c.strip().lstrip("﻿"): c for c in raw.columns}
    pick = {f: T.first_filled(*[F.col(f"`{there[n]}`") for n in names if n in there]) if any(n in there for n in names) else F.lit("") for f, names in columns.items()}
    unmapped = [f for f, names in columns.items() if not any(n in there for n in names)]
    rows = raw.select(*[c.alias(f) for f, c in pick.items()]).withColumn("abstract", T.blank_placeholder(F.col("abstract")))
    report = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col("abstract") == "").alias("missing_abstract"), F.count_if(F.col("doi") == "").alias("missing_doi"), F.count_if((F.col("title") == "") & (F.col("abstract") == "")).alias("dropped_empty")).withColumn("unmapped_fields", F.array(*[F.lit(u) for u in unmapped]).cast("array<string>"))
    kept = rows.where((F.col("title") != "") | (F.col("abstract") != ""))
    kept = kept.where(wanted(F.col("document_type"), F.col("abstract"), keep_types, require_abstract))
    extra = F.map_filter(F.map_from_arrays(F.array(*[F.lit(e) for e in EXTRA]), F.array(*[F.col(e) for e in EXTRA])), lambda k, v: v != "")
    out = kept.withColumns({"year": T.parse_year(F.col("year")), "authors": T.split_people(F.col("authors")), "full_text": F.lit(""), "sections": F.expr("CAST(array() AS array<struct<heading:string,body:string>>)"), "extra": extra})
    return _shape(out, source), report


RIS_LINE = re.compile(r"^([A-Z][A-Z0-9]) {2}-\s?(.*)$")


def ris_entries(text: str) -> list[dict[str, list[str]]]:
    """Entries as tag -> values. ER ends an entry, a new TY begins one, a line without a tag continues the value."""
    out: list[dict[str, list[str]]] = []
    now: dict[str, list[str]] = {}
    last = ""
    for line in (text or "").lstrip("﻿").splitlines():
        m = RIS_LINE.match(line.rstrip())
        if m is None:
            if last and line.strip():
                now[last][-1] = f"{now[last][-1]} {line.strip()}".strip()
            continue
        tag, value = m.groups()
        if tag in ("ER", "TY") and now:
            out.append(now)
            now = {}
        last = "" if tag == "ER" else tag
        if last:
            now.setdefault(tag, []).append(value.strip())
    return out + [now] if now else out


def ris_record(e: dict[str, list[str]]) -> dict | None:
    def first(*tags):
        return next((v for t in tags for v in e.get(t, []) if v), "")

    if first("TY").upper() in RIS_SKIPPED:
        return None
    return {"title": first("TI", "T1", "BT"), "abstract": first("AB", "N2"), "doi": first("DO"), "year": first("PY", "Y1", "DA"), "authors": [a for a in e.get("AU", []) + e.get("A1", []) if a], "venue": first("JO", "JF", "T2", "J2"), "extra": {k: v for k, v in (("document_type", first("TY")), ("author_keywords", "; ".join(e.get("KW", [])))) if v}}


BIB_ENTRY = re.compile(r"@(\w+)\s*[{(]")


def bibtex_entries(text: str) -> list[tuple[str, dict[str, str]]]:
    """(type, fields). Values in braces (nested), in quotes, or bare; depth is counted, not matched."""
    out = []
    at = 0
    text = text or ""
    while m := BIB_ENTRY.search(text, at):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        body, at = text[m.end() : i - 1], i
        _, _, rest = body.partition(",")
        fields: dict[str, str] = {}
        p = 0
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(rest, p):
            p = f.end()
            if p < len(rest) and rest[p] in '{"':
                close, depth, start = ('"' if rest[p] == '"' else "}"), 0, p + 1
                p += 1
                while p < len(rest) and (depth or rest[p] != close):
                    depth += {"{": 1, "}": -1}.get(rest[p], 0)
                    p += 1
                fields[f.group(1).lower()] = rest[start:p]
                p += 1
            else:
                v = re.compile(r"[^,]*").match(rest, p)
                fields[f.group(1).lower()] = v.group().strip()
                p = v.end()
        out.append((m.group(1).lower(), fields))
    return out


def clean_latex(text: str) -> str:
    for escape, plain in T.LATEX:
        text = text.replace(escape, plain)
    return " ".join(re.sub(r"[{}]", "", text).split())


def bibtex_record(kind: str, f: dict[str, str]) -> dict | None:
    if kind in BIBTEX_SKIPPED or kind in ("comment", "string", "preamble"):
        return None
    g = lambda *names: next((clean_latex(f[n]) for n in names if f.get(n)), "")
    keywords = "; ".join(k.strip() for k in re.split("[;,]", g("keywords")) if k.strip())
    return {"title": g("title"), "abstract": g("abstract"), "doi": g("doi"), "year": g("year", "date"), "authors": [clean_latex(a) for a in re.split(r"\s+and\s+", f.get("author", "")) if a.strip()], "venue": g("journal", "booktitle", "journaltitle"), "extra": {k: v for k, v in (("document_type", kind), ("author_keywords", keywords)) if v}}


TEI = "{http://www.tei-c.org/ns/1.0}"


def tei_record(xml: str) -> dict | None:
    """The record of a TEI document, or None if it isn't well-formed."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError):
        return None
    say = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    head = root.find(f"{TEI}teiHeader")
    find = lambda path: None if head is None else head.find(path)
    analytic = f".//{TEI}sourceDesc//{TEI}biblStruct"
    people = [" ".join(filter(None, [*(say(x) for x in p.findall(f"{TEI}forename")), say(p.find(f"{TEI}surname"))])) for p in (head.findall(f"{analytic}//{TEI}author/{TEI}persName") if head is not None else [])]
    doi = next((say(i) for i in (head.iter(f"{TEI}idno") if head is not None else []) if (i.get("type") or "").upper() == "DOI"), "")
    date = find(f"{analytic}//{TEI}date")
    abstract = find(f".//{TEI}abstract")
    sections = []
    for div in root.findall(f"{TEI}text/{TEI}body/{TEI}div"):
        body = " ".join(filter(None, (say(p) for p in div.findall(f"{TEI}p"))))
        if body:
            sections.append({"heading": say(div.find(f"{TEI}head")) or "other", "body": body})
    return {"title": say(find(f".//{TEI}titleStmt/{TEI}title")), "abstract": " ".join(filter(None, (say(p) for p in abstract.iter(f"{TEI}p")))) if abstract is not None else "", "doi": doi, "year": (date.get("when") or say(date)) if date is not None else "", "authors": [p for p in people if p], "venue": say(find(f"{analytic}/{TEI}monogr/{TEI}title")), "sections": sections, "extra": {}}


def _parsed(spark: SparkSession, path: str, parse, source: str, require_abstract: bool, pattern: str | None = None) -> DataFrame:
    """One task reads whole files and yields their records as they are parsed."""
    names = ["title", "abstract", "doi", "year", "authors", "venue", "full_text", "sections", "extra"]
    schema = DDL.replace("year int", "year string").replace(", source string", "")

    def run(parts):
        for part in parts:
            for text in part["value"]:
                rows = [{"full_text": "", "sections": [], **r} for r in parse(text) if r and (r["title"] or r["abstract"])]
                if rows:
                    yield pd.DataFrame([r | {"extra": [{"k": k, "v": v} for k, v in r["extra"].items()]} for r in rows], columns=names)

    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).mapInPandas(run, schema.replace("map<string,string>", "array<struct<k:string,v:string>>"))
    rows = rows.withColumns({"extra": F.map_from_entries("extra"), "year": T.parse_year(F.col("year"))})
    if require_abstract:
        rows = rows.where("abstract <> ''")
    return _shape(rows, source)


def read_ris(spark: SparkSession, path: str, require_abstract: bool = False) -> DataFrame:
    return _parsed(spark, path, lambda t: (ris_record(e) for e in ris_entries(t)), "ris", require_abstract)


def read_bibtex(spark: SparkSession, path: str, require_abstract: bool = False) -> DataFrame:
    return _parsed(spark, path, lambda t: (bibtex_record(k, f) for k, f in bibtex_entries(t)), "bibtex", require_abstract)


def read_tei(spark: SparkSession, folder: str, require_sections: bool = False) -> DataFrame:
    out = _parsed(spark, folder, lambda t: [tei_record(t)], "grobid", False, "*.xml")
    wanted = ("methods", "results", "introduction", "discussion")
    if require_sections:
        from evigrain.functions.headings import classify, normalise_heading

        out = out.where(F.exists("sections", lambda s: classify(normalise_heading(s["heading"]))["label"].isin(*wanted)))
    return out


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records written by write_jsonl; sections come back from [heading, body] pairs or structs."""
    kind = "array<struct<heading:string,body:string>>"
    raw = spark.read.schema(DDL.replace(f"sections {kind}", "sections string") + ", record_id string").json(path)
    pairs = F.transform(F.from_json("sections", "array<array<string>>"), lambda p: F.struct(F.get(p, 0).alias("heading"), F.get(p, 1).alias("body")))
    sections = F.when(F.col("sections").rlike(r"^\s*\[\s*\["), pairs).otherwise(F.from_json("sections", kind))
    return _shape(raw.withColumn("sections", sections), "jsonl")


def write_jsonl(records: DataFrame, path: str) -> None:
    """Canonical records in the order of their ids, sections as [heading, body] pairs."""
    pairs = F.transform("sections", lambda s: F.array(s["heading"], s["body"]))
    records.withColumn("sections", pairs).orderBy("record_id").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def from_source_files(rows: DataFrame) -> DataFrame:
    """Records of extracted files: extraction_status 'extracted', TEI where it parses, else the flat text; empty ones
    dropped. ``rows``: extraction_status, extracted_text, extracted_metadata map."""
    @F.pandas_udf("struct<ok:boolean,title:string,abstract:string,doi:string,year:string,authors:array<string>,venue:string,sections:array<struct<heading:string,body:string>>>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        blank = {"title": "", "abstract": "", "doi": "", "year": "", "authors": [], "venue": "", "sections": []}
        done = [{"ok": r is not None, **blank, **{k: v for k, v in (r or {}).items() if k in blank}} for r in (tei_record(t) if t and t.lstrip().startswith("<") else None for t in texts)]
        return pd.DataFrame(done, columns=["ok", *blank])

    seen = rows.where("extraction_status = 'extracted' AND trim(coalesce(extracted_text, '')) <> ''").withColumn("p", parse("extracted_text"))
    meta = lambda n: F.coalesce(F.element_at("extracted_metadata", n), F.lit(""))
    out = seen.select(
        T.first_filled(F.col("p.title"), meta("title")).alias("title"), F.col("p.abstract").alias("abstract"), T.first_filled(F.col("p.doi"), meta("doi")).alias("doi"), T.parse_year(T.first_filled(F.col("p.year"), meta("year"))).alias("year"),
        F.col("p.authors").alias("authors"), F.col("p.venue").alias("venue"), F.when(F.col("p.ok"), F.lit("")).otherwise(T.collapse_space(F.col("extracted_text"))).alias("full_text"), F.col("p.sections").alias("sections"), F.expr("CAST(map() AS map<string,string>)").alias("extra"),
    )
    return _shape(out, "source_file")


def scan_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest (SHA-256 of the content) and content of the PDF files under a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(name).endswith(".pdf") & ~name.startswith(".")).select("path", F.sha2("content", 256).alias("digest"), "content")


def extract_pdfs(files: DataFrame, extract, known: DataFrame | None = None) -> DataFrame:
    """digest, tei, error of the files whose digest isn't in ``known`` (digest, tei), by ``extract(bytes) -> str``, run
    in batches; a file that fails gives its error and the rest go on. What is known comes along."""
    new = files.select("digest", "content").dropDuplicates(["digest"])
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")

    def run(parts):
        for part in parts:
            rows = []
            for digest, content in zip(part["digest"], part["content"]):
                try:
                    rows.append((digest, extract(bytes(content)), None))
                except Exception as e:  # noqa: BLE001 - any failure of one file is that file's result
                    rows.append((digest, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["digest", "tei", "error"])

    done = new.mapInPandas(run, "digest string, tei string, error string")
    return done if known is None else done.unionByName(known.select("digest", "tei", F.lit(None).cast("string").alias("error")))


def pdf_records(texts: DataFrame, engine: str = "grobid", require_sections: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, coverage) of extracted files. ``texts``: path, tei, error (one row a file). A text that begins with '<'
    is TEI, another is plain text under its guessed title or file name. Coverage is one row: files_found, processed,
    with_sections, without_sections, failed (no extraction, TEI that doesn't parse, nothing in it), coverage."""
    from evigrain.functions.headings import classify, normalise_heading

    @F.pandas_udf("struct<ok:boolean,title:string,abstract:string,doi:string,year:string,authors:array<string>,venue:string,sections:array<struct<heading:string,body:string>>>")
    def parse(found: pd.Series) -> pd.DataFrame:
        blank = {"title": "", "abstract": "", "doi": "", "year": "", "authors": [], "venue": "", "sections": []}
        done = [{"ok": r is not None, **blank, **{k: v for k, v in (r or {}).items() if k in blank}} for r in (tei_record(t) if t and t.lstrip().startswith("<") else None for t in found)]
        return pd.DataFrame(done, columns=["ok", *blank])

    tei = F.ltrim(T.text_of("tei")).startswith("<")
    name = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), "_", " ")
    seen = texts.select("path", "tei", "error", tei.alias("is_tei"), parse("tei").alias("p"))
    wanted_labels = ("methods", "results", "introduction", "discussion")
    seen = seen.withColumns({
        "full_text": F.when(F.col("is_tei"), F.lit("")).otherwise(T.collapse_space(T.text_of("tei"))),
        "has_sections": F.coalesce(F.exists("p.sections", lambda s: classify(normalise_heading(s["heading"]))["label"].isin(*wanted_labels)), F.lit(False)),
    })
    bad = F.col("error").isNotNull() | F.col("is_tei") & ~F.col("p.ok")
    empty = (F.col("full_text") == "") & (T.text_of("p.abstract") == "") & (F.coalesce(F.size("p.sections"), F.lit(0)) <= 0)
    judged = seen.withColumn("state", F.when(bad | empty, "failed").when(~F.col("has_sections") & F.lit(require_sections), "left out").otherwise("processed"))
    rows = judged.where("state = 'processed'").select(
        F.when(F.col("is_tei"), F.col("p.title")).otherwise(T.first_filled(T.guess_title(F.col("tei")), name)).alias("title"), F.col("p.abstract").alias("abstract"), F.col("p.doi").alias("doi"), T.parse_year(F.col("p.year")).alias("year"),
        F.col("p.authors").alias("authors"), F.col("p.venue").alias("venue"), "full_text", F.col("p.sections").alias("sections"), F.expr("CAST(map() AS map<string,string>)").alias("extra"),
    )
    n = F.count(F.lit(1))
    sound = F.col("state") != "failed"
    coverage = judged.agg(
        n.alias("files_found"), F.count_if(F.col("state") == "processed").alias("processed"), F.count_if(sound & F.col("has_sections")).alias("with_sections"), F.count_if(sound & ~F.col("has_sections")).alias("without_sections"), F.count_if(~sound).alias("failed"),
    ).withColumn("coverage", F.when(F.col("files_found") > 0, F.col("processed") / F.col("files_found")).otherwise(F.lit(0.0)))
    return _shape(rows, engine), coverage


def read_pdfs(spark: SparkSession, folder: str, extract, engine: str = "grobid", limit: int | None = None, require_sections: bool = False, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, coverage) of the PDF files under a folder, the first ``limit`` by path if given, by ``extract(bytes) ->
    str`` (TEI or plain text). Files of equal content are extracted once; what ``known`` (digest, tei) holds isn't."""
    files = scan_pdfs(spark, folder)
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    done = extract_pdfs(files, extract, known)
    return pdf_records(files.select("path", "digest").join(done, "digest", "left"), engine, require_sections)


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Records of a file by its extension or ``kind``."""
    kind = kind or {".ris": "ris", ".bib": "bibtex", ".bibtex": "bibtex", ".csv": "scopus", ".txt": "wos", ".tsv": "wos", ".jsonl": "jsonl"}.get(Path(path).suffix.lower())
    if kind == "scopus":
        return read_table(spark, path, SCOPUS, "scopus", **options)[0]
    if kind == "wos":
        return read_table(spark, path, WOS, "wos", **({"sep": "\t"} | options))[0]
    if kind == "ris":
        return read_ris(spark, path, **options)
    if kind == "bibtex":
        return read_bibtex(spark, path, **options)
    if kind == "jsonl":
        return read_jsonl(spark, path)
    if kind == "tei":
        return read_tei(spark, path, **options)
    raise ValueError(f"unknown format of {path!r}")


def synthetic(spark: SparkSession, n: int, topics: list[str]) -> DataFrame:
    """A made-up corpus: topic i mod len(topics)."""
    i = F.col("id")
    topic = F.element_at(F.array(*[F.lit(t) for t in topics]), (i % len(topics) + 1).cast("int"))
    number = F.lpad(i.cast("string"), 5, "0")
    return spark.range(n).select(
        F.concat(F.lit("Study "), number, F.lit(" on "), topic).alias("title"), F.concat(F.lit("We examine "), topic, F.lit(" in sample "), number, F.lit(". Effects were measured.")).alias("abstract"), F.concat(F.lit("10.9999/made."), number).alias("doi"),
        (F.lit(2005) + i % 20).cast("int").alias("year"), F.array(F.concat(F.lit("Author "), (i % 7).cast("string"))).alias("authors"), F.lit("Made-up Journal").alias("venue"), F.lit("").alias("full_text"),
        F.expr("CAST(array() AS array<struct<heading:string,body:string>>)").alias("sections"), F.lit("made").alias("source"), F.expr("CAST(map() AS map<string,string>)").alias("extra"),
    )
