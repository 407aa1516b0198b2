"""Commands: import, ingest-tei, ingest-pdf, hash, sections, retrieve, verify, stability over record files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _corpus(spark, args):
    from evigrain.functions import text as T
    from evigrain.operators import records as R
    from evigrain.sources import bibliography as B

    raw = B.read_any(spark, args.input, args.format)
    named = R.canonical(raw).withColumn("record_id", R.record_id()).withColumn("dedup_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("year")))
    return R.winners_and_losers(named)


def _retrieve(spark, args, seed=42):
    from evigrain.operators import chunking, records as R
    from evigrain.plans import retrieval

    corpus = _corpus(spark, args)[0]
    name = R.corpus_statistics(corpus).collect()[0].recommended_chunker if args.chunker == "auto" else args.chunker
    params = {"keep_sections": tuple(args.section)} if name == "tei-section" and args.section else {}
    spec, _ = chunking.build(name, **params)
    index = {} if args.index == "flat" else {"seed": seed}
    settings = retrieval.Settings(mode=args.mode, k=args.k, section_filter=tuple(args.section), index=args.index, index_params=index, chunker=spec)
    chunks = chunking.chunk(corpus, name, **params)
    hits = retrieval.retrieve(chunks, spark.createDataFrame([("q", args.query)], "query_id string, query_text string"), settings)
    return corpus, settings, hits.join(chunks, "chunk_id").orderBy("rank_no").collect()


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="evigrain")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "ingest-tei", "ingest-pdf", "hash", "sections", "retrieve", "verify", "stability"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--format")
        if name in ("import", "ingest-tei", "ingest-pdf"):
            s.add_argument("--out", required=True)
        if name in ("ingest-tei", "ingest-pdf"):
            s.add_argument("--require-sections", action="store_true")
        if name == "ingest-pdf":
            s.add_argument("--limit", type=int)
            s.add_argument("--url", help="the service that turns a PDF into TEI; without one the text is read locally")
        if name in ("retrieve", "verify", "stability"):
            s.add_argument("--query", required=name != "verify", default="")
            s.add_argument("--k", type=int, default=20)
            s.add_argument("--mode", default="hybrid")
            s.add_argument("--section", action="append", default=[])
            s.add_argument("--chunker", default="record")
            s.add_argument("--index", default="flat")
            s.add_argument("--certificate")
            s.add_argument("--runs", type=int, default=5)
    args = p.parse_args(argv)
    from evigrain.functions import headings as H
    from evigrain.operators import records as R
    from evigrain.plans import retrieval
    from evigrain.session import local_session

    spark = local_session()
    if args.command in ("ingest-tei", "ingest-pdf"):
        from evigrain.sources import bibliography as B, services

        coverage = None
        if args.command == "ingest-tei":
            raw = B.read_tei(spark, args.input, args.require_sections)
        else:
            raw, coverage = B.read_pdfs(spark, args.input, services.tei_service(args.url) if args.url else services.local_text, engine="grobid" if args.url else "local", limit=args.limit, require_sections=args.require_sections)
        from evigrain.functions import text as T

        named = R.canonical(raw).withColumn("record_id", R.record_id()).withColumn("dedup_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("year")))
        won = R.winners_and_losers(named)[0]
        B.write_jsonl(won.drop("dedup_key"), args.out)
        report = coverage.collect()[0].asDict() if coverage is not None else {}
        print(json.dumps(R.corpus_statistics(won).collect()[0].asDict() | report))
        return 0
    if args.command in ("import", "hash", "sections"):
        won, lost = _corpus(spark, args)
        if args.command == "import":
            from evigrain.sources.bibliography import write_jsonl

            write_jsonl(won.drop("dedup_key"), args.out)
            print(json.dumps(R.corpus_statistics(won).collect()[0].asDict() | {"duplicates_removed": lost.count()}))
        elif args.command == "hash":
            print(R.corpus_hash(won))
        else:
            for r in H.section_report(H.section_rows(won)).orderBy("kind", F.desc("n")).collect():
                print(r.kind, r.name, r.n, sep="\t")
        return 0
    if args.command == "verify":
        held = retrieval.load_certificate(args.certificate)
        args.query, args.k, args.mode, args.section = held["query"], held["k"], held["mode"], held["section_filter"]
    corpus, settings, found = _retrieve(spark, args)
    ids = [r.chunk_id for r in found]
    if args.command == "stability":
        runs = [[r.chunk_id for r in _retrieve(spark, args, 42 + i)[2]] for i in range(args.runs)]
        from evigrain.operators import metrics

        lists = spark.createDataFrame([("q", i, ids) for i, ids in enumerate(runs)], "query_id string, run int, ids array<string>")
        print(json.dumps(metrics.stability(lists, "query_id", "run").collect()[0].asDict()))
        return 0
    if args.command == "verify":
        result = retrieval.verify(held, args.query, ids, R.corpus_hash(corpus), settings, corpus.count())
        print(json.dumps(result))
        return 0 if result["verified"] else 1
    for r in found:
        print(r.rank_no, r.score, r.chunk_id, r.section, r.text[:240].replace("\n", " "), sep="\t")
    if args.certificate:
        retrieval.save_certificate(retrieval.issue(args.query, ids, R.corpus_hash(corpus), settings, corpus.count()), args.certificate)
    return 0


if __name__ == "__main__":
    sys.exit(main())
