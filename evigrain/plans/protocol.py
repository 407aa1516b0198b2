"""Review protocols: retrieval queries from their fields, and the request that a web layer passes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrain.functions import text as T
from evigrain.operators import chunking, records as R
from evigrain.plans import retrieval

PROTOCOL = "review_id bigint, title string, population string, intervention string, comparison string, outcome string, extraction_fields array<string>"


def protocol_queries(protocols: DataFrame) -> DataFrame:
    """review_id, query_id, query_text: one query of the filled PICO fields (the title where none is), and one for each
    extraction field."""
    pico = F.concat_ws(" ", *[F.nullif(T.collapse_space(T.text_of(c)), F.lit("")) for c in ("population", "intervention", "comparison", "outcome")])
    main = protocols.select("review_id", F.lit("pico").alias("query_id"), F.when(pico == "", T.collapse_space(T.text_of("title"))).otherwise(pico).alias("query_text"))
    fields = protocols.select("review_id", F.posexplode("extraction_fields").alias("i", "f")).select("review_id", F.concat(F.lit("field-"), F.col("i").cast("string")).alias("query_id"), T.collapse_space(T.text_of("f")).alias("query_text"))
    return main.unionByName(fields).where("query_text <> ''")


def health(version: str | None = None) -> dict:
    """That the library answers, with what makes its results repeatable."""
    from evigrain import __version__

    return {"ok": True, "version": version or __version__, "determinism": {"seed": 42, "vector_precision": 6, "score_precision": 9}}


def backends() -> dict:
    """Chunkers, back ends of search, and which optional packages can be imported here."""
    from importlib.util import find_spec

    from evigrain.operators import search

    names = ("faiss", "sentence_transformers", "qdrant_client", "chromadb", "psycopg", "transformers")
    return {"chunkers": sorted(chunking.NAMES), "search": search.BACKENDS, "unavailable": list(search.UNAVAILABLE), "optional_dependencies": {n: find_spec(n) is not None for n in names}}


def answer(spark: SparkSession, request: dict) -> dict:
    """One retrieval request: {'query', 'records' or 'source_files', 'k', 'mode', 'section', 'chunker', 'index'}. Wrong
    input raises ValueError with what is wrong; the answer holds the evidence and its certificate."""
    query = (request.get("query") or "").strip()
    if not query:
        raise ValueError("query is empty")
    if request.get("source_files"):
        from evigrain.sources.bibliography import from_source_files

        rows = [(r.get("extraction_status"), r.get("extracted_text"), {k: str(v) for k, v in (r.get("extracted_metadata") or {}).items()}) for r in request["source_files"]]
        raw = from_source_files(spark.createDataFrame(rows, "extraction_status string, extracted_text string, extracted_metadata map<string,string>"))
    elif request.get("records"):
        rows = [tuple(r.get(n) for n in ("title", "abstract", "doi", "year", "authors", "venue", "full_text", "sections", "source", "extra")) for r in request["records"]]
        raw = spark.createDataFrame(rows, R.DDL)
    else:
        raise ValueError("neither records nor source_files")
    sections = tuple(request.get("section") or ())
    name = request.get("chunker", "record")
    spec, _ = chunking.build(name, **({"keep_sections": sections} if name == "tei-section" and sections else {}))
    settings = retrieval.Settings(mode=request.get("mode", "hybrid"), k=int(request.get("k", 20)), section_filter=sections, index=request.get("index", "flat"), chunker=spec)
    corpus = R.canonical(raw).withColumn("record_id", R.record_id()).withColumn("dedup_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("year")))
    winners = R.winners_and_losers(corpus)[0]
    chunks = chunking.chunk(winners, name, **({"keep_sections": sections} if name == "tei-section" and sections else {}))
    hits = retrieval.retrieve(chunks, spark.createDataFrame([("q", query)], "query_id string, query_text string"), settings)
    found = hits.join(chunks, "chunk_id").orderBy("rank_no").collect()  # at most k rows
    certificate = retrieval.issue(query, [r.chunk_id for r in found], R.corpus_hash(winners), settings, winners.count())
    return {"evidence": [{"rank": r.rank_no, "chunk_id": r.chunk_id, "record_id": r.record_id, "score": r.score, "section": r.section, "text": r.text, "start": r.span_start, "end": r.span_end} for r in found], "certificate": certificate}
