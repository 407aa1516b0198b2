"""Identity, canonical form, the golden digest of a made-up corpus, readers."""

import hashlib
import json

from pyspark.sql import functions as F

from evigrain.functions import headings as H, text as T
from evigrain.operators import chunking, metrics, records as R, search
from evigrain.operators.components import components
from evigrain.operators.skew import running_total, salted_join
from evigrain.plans import retrieval
from evigrain.sources import bibliography as B

TOPICS = ("convolutional neural networks for eeg emotion recognition", "transformer models applied to clinical text classification", "systematic review methodology and screening automation", "approximate nearest neighbour search in vector databases", "reproducibility of retrieval augmented generation pipelines")


def row(title="", abstract="", doi="", year=None, authors=(), venue="", full_text="", sections=(), extra=None):
    return title, abstract, doi, year, list(authors), venue, full_text, [list(s) for s in sections], "", extra or {}


def test_golden_digest(spark):
    """500 records, hash embeddings of 256 numbers, exact search, fusion, k = 25: the published prefix."""
    rows = [
        row(f"Study {i:04d} on {TOPICS[i % 5]}", f"This paper investigates {TOPICS[i % 5]}. The sample comprised {100 + i} items. We report precision, recall and discuss limitations of {TOPICS[i % 5]}.", f"10.5555/determinism.{i:04d}", 2010 + i % 16, [f"Author {i % 37}", f"Coauthor {i % 11}"])
        for i in range(500)
    ]
    df = R.canonical(spark.createDataFrame(rows, R.DDL)).withColumn("record_id", R.record_id())
    query = spark.createDataFrame([("q", "approximate nearest neighbour search and evidence set stability")], "query_id string, query_text string")
    hits = retrieval.retrieve(chunking.chunk(df, "record"), query, retrieval.Settings(k=25))
    digest = retrieval.evidence_digest(hits, ["query_id"]).collect()[0].digest
    assert digest.startswith("093b73863e8f24af")
    ids = [r.chunk_id for r in hits.orderBy("rank_no").collect()]
    assert retrieval.digest_of(ids) == digest


def test_record_id_is_the_hash_of_compact_json(spark):
    rows = [
        row('A "quoted" \\ title\x0e/é', "Ünïcode\tabstract", "https://doi.org/10.1/AbC.", 2001, ["B, C", "A B", " "], "V", "full  text", [("2 Heading", "Body one"), ("Empty", "  ")]),
        row(),
        row("ﬁne Ｗide", "soft­hyphen", authors=["Z", "Ä"]),
    ]
    got = R.canonical(spark.createDataFrame(rows, R.DDL)).withColumn("rid", R.record_id()).collect()
    for r in got:
        identity = {"title": r.title, "abstract": r.abstract, "doi": r.doi, "year": r.year, "authors": r.authors, "venue": r.venue, "full_text": r.full_text, "sections": [[s.heading, s.body] for s in r.sections]}
        text = json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.rid == hashlib.sha256(text.encode()).hexdigest()[:24]
    assert got[0].doi == "10.1/abc" and got[0].authors == ["A B", "B, C"] and [s.heading for s in got[0].sections] == ["2 heading"]
    assert got[2].title == "fine Wide" and got[2].abstract == "softhyphen"


def test_winner_is_the_richest_whatever_the_order(spark):
    rows = [("k", "b", 1), ("k", "a", 3), ("k", "c", 3), ("l", "d", 0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "dedup_key string, record_id string, n int").repartition(3)
        won, lost = R.winners_and_losers(df, length=F.col("n"))
        assert {r.record_id for r in won.collect()} == {"a", "d"}
        assert {tuple(r) for r in lost.collect()} == {("a", "b"), ("a", "c")}


def test_sentences(spark):
    cases = {
        "One. Two.": ["One.", "Two."], "See Campbell et al. (2020). When used": ["See Campbell et al. (2020).", "When used"], "e.g. This stays. Fig. 3 too": ["e.g. This stays.", "Fig. 3 too"],
        "": [], "   ": [], "As follows. 385 answered? \"Yes.\" [1] no": ["As follows.", "385 answered?", "\"Yes.\" [1] no"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.sentences("t").alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases


def test_chunks_lie_where_they_say(spark):
    body = " ".join(f"Sentence number {i} of the text ends here." for i in range(40))
    rows = [row("T", "An abstract.", full_text=body), row("Only title", "And abstract."), row("S", "Abs here.", sections=[("1 Introduction", body), ("1.1 Something odd", "Short body."), ("2 Methods", "We did it. Twice.")])]
    df = R.canonical(spark.createDataFrame(rows, R.DDL)).withColumn("record_id", R.record_id())
    for name, p in (("record", {}), ("fixed", {"size": 30, "overlap": 5}), ("sentence", {"max_words": 30}), ("sliding-sentence", {}), ("tei-section", {"max_words": 30}), ("paragraph", {"max_words": 40}), ("semantic", {"max_words": 50})):
        joined = chunking.chunk(df, name, **p).join(df.select("record_id", R.canonical_source().alias("src")), "record_id")
        for r in joined.collect():
            assert r.span_start >= 0 and r.src[r.span_start : r.span_end] == r.text, (name, r)
        ids = [r.chunk_id for r in joined.select("chunk_id").collect()]
        assert len(ids) == len(set(ids)) > 0
    assert chunking.chunk(df, "recursive", size=300, overlap=50).count() > 3
    kept = chunking.chunk(df, "tei-section", keep_sections=("methods",)).where("section <> 'unknown'").collect()
    assert {r.section for r in kept} == {"methods"}


def test_headings_inherit(spark):
    rows = [([("2. Theoretical background", "x"), ("2.1 Non-fungible tokens", "x"), ("Odd words", "x"), ("3.1.2. Data collection", "x"), ("References", "x"), ("Unknown thing", "x"), ("(2) Results and discussion", "x"), ("", "x")],)]
    out = spark.createDataFrame(rows, "sections array<struct<heading:string,body:string>>").select(H.resolve(F.col("sections")).alias("s")).collect()[0].s
    assert [(s.label, s.rule) for s in out] == [("background", "exact"), ("background", "inherited:2"), ("background", "inherited:previous"), ("methods", "contains:data collection"), ("references", "exact"), ("methods", "inherited:previous"), ("results", "contains:results and discussion"), ("other", "empty")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], R.DDL)
    df = R.canonical(none).withColumn("record_id", R.record_id()).withColumn("dedup_key", F.lit("x"))
    assert R.winners_and_losers(df)[0].count() == 0 and chunking.chunk(df, "sentence").count() == 0
    assert R.corpus_hash(df) == hashlib.sha256(b"").hexdigest()
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("z", "z"), (None, "x")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and got["y"] == "x" and got["z"] == "z" and len(got) == 44


def test_salted_join_and_running_total(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    got = salted_join(left, right, ["k"], "n", hot=100, salts=8)
    assert got.columns == ["k", "id", "m"] and got.count() == 1000 and got.where("k = 'hot' AND m <> 0").count() == 0
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), "id", F.lit(2).alias("v"))
    total = running_total(rows, "g", F.xxhash64("id"), "v", "upto", buckets=16)
    for g in range(3):
        ups = sorted(r.upto for r in total.where(f"g = '{g}'").collect())
        assert ups == list(range(2, 2 * len(ups) + 1, 2))


def test_search_contract(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 16))
    x = centres[np.arange(200) % 5] + rng.normal(scale=0.1, size=(200, 16))
    v = spark.createDataFrame([(f"c{i:03d}", row.tolist()) for i, row in enumerate(x)] + [("tie1", [1.0] * 16), ("tie0", [1.0] * 16), ("none", None), ("empty", []), ("nan", [float("nan")] * 16)], "id string, e array<double>")
    v = search.usable(v, "id", "e")
    q = spark.createDataFrame([("q0", x[0].tolist()), ("q1", [1.0] * 16)], "query_id string, q array<double>")
    exact = {r.query_id: r.ids for r in metrics.lists_of(search.exact(v, q, 8), ["query_id"], "id").collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert exact["q0"] == [f"c{i:03d}" for i in np.argsort(-(unit @ unit[0]), kind="stable")[:8]] and exact["q1"][:2] == ["tie0", "tie1"]
    assert search.exact(v, q, 1000).where("query_id = 'q0'").count() == 202
    for name, p in (("lsh", {"bits": 4, "tables": 6}), ("ivf", {"cells": 6, "probes": 3}), ("ivfpq", {"cells": 6, "probes": 3, "parts": 4})):
        extra = {"dimension": 16} if name == "lsh" else {}
        hits = search.build_index(name, **p)(v, q, 8, **extra).collect()
        own = [r.id for r in sorted(hits, key=lambda r: r.rank_no) if r.query_id == "q0"]
        assert len(own) <= 8 and len(set(own)) == len(own) and len(set(own) & set(exact["q0"])) >= 6, name


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Authors,Title,Year,Source title,DOI,Abstract,Author Keywords,Document Type,Cited by,EID\n\"Doe, J.; Roe, R.\",First,2020,J,10.1/A,Text,k,Article,1,e\nX,Second,20x,J,,[No abstract available],,Review,,\n", encoding="utf-8")
    recs, report = B.read_table(spark, str(tmp_path / "a.csv"), B.SCOPUS, "scopus")
    r = report.collect()[0]
    assert (r.rows_read, r.missing_abstract, r.missing_doi, r.unmapped_fields) == (2, 1, 1, ["index_keywords"])
    first = recs.orderBy("title").collect()[0]
    assert first.authors == ["Doe, J.", "Roe, R."] and first.year == 2020 and first.extra["document_type"] == "Article"
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - A title\n   goes on\nAU  - One\nAU  - Two\nPY  - 2019/05\nAB  - Abs\nER  - \nTY  - SOUND\nTI  - No\nER  - \nTY  - CONF\nT1  - Last\n")
    got = {r.title: r for r in B.read_any(spark, str(tmp_path / "a.ris")).collect()}
    assert set(got) == {"A title goes on", "Last"} and got["A title goes on"].year == 2019 and got["A title goes on"].authors == ["One", "Two"]
    (tmp_path / "a.bib").write_text("@article{k, title={A {Nested} Title}, author = \"Doe, J. and Roe, R.\", year = 2018, keywords={a; b, c}}\n@misc{m, title={Skip}}")
    b = B.read_any(spark, str(tmp_path / "a.bib")).collect()
    assert len(b) == 1 and b[0].title == "A Nested Title" and b[0].authors == ["Doe, J.", "Roe, R."] and b[0].extra["author_keywords"] == "a; b; c"
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>TT</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>A</forename><surname>B</surname></persName></author></analytic><monogr><title>MM</title><imprint><date when="2017-01"/></imprint></monogr><idno type="DOI">10.2/x</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>AA</p></abstract></profileDesc></teiHeader><text><body><div><head>Methods</head><p>P1</p><p>P2</p></div></body></text></TEI>'
    (tmp_path / "tei").mkdir()
    (tmp_path / "tei" / "x.tei.xml").write_text(tei)
    (tmp_path / "tei" / "bad.xml").write_text("<nope")
    t = B.read_tei(spark, str(tmp_path / "tei"), require_sections=True).collect()
    assert len(t) == 1 and t[0].year == 2017 and t[0].authors == ["A B"] and t[0].venue == "MM" and t[0].sections[0].body == "P1 P2"
    files = spark.createDataFrame([("extracted", tei, {}), ("extracted", "Plain text", {"title": "P"}), ("failed", "x", {}), (None, "y", {})], "extraction_status string, extracted_text string, extracted_metadata map<string,string>")
    assert {r.title: r.full_text for r in B.from_source_files(files).collect()} == {"TT": "", "P": "Plain text"}
    (tmp_path / "p").mkdir()
    for n in ("a.pdf", "b.PDF", ".hidden.pdf", "c.txt"):
        (tmp_path / "p" / n).write_bytes(b"%PDF " + n.encode())
    pdfs = B.scan_pdfs(spark, str(tmp_path / "p"))
    out = B.extract_pdfs(pdfs, lambda b: (_ for _ in ()).throw(ValueError("no")) if b"b.PDF" in b else tei).collect()
    assert len(out) == 2 and sorted(bool(r.error) for r in out) == [False, True]
    named = R.canonical(recs).withColumn("record_id", R.record_id())
    B.write_jsonl(named, str(tmp_path / "j"))
    back = R.canonical(B.read_jsonl(spark, str(tmp_path / "j"))).withColumn("record_id", R.record_id())
    assert {r.record_id for r in back.collect()} == {r.record_id for r in named.collect()}


def test_certificates(tmp_path):
    s = retrieval.Settings(k=3)
    c = retrieval.issue("q", ["a", "b", "c"], "h", s)
    retrieval.save_certificate(c, str(tmp_path / "c.json"))
    c = retrieval.load_certificate(str(tmp_path / "c.json"))
    assert retrieval.verify(c, "q", ["a", "b", "c"], "h", s)["verified"]
    assert retrieval.verify(c, "q", ["b", "a", "c"], "h", s)["reordered_only"]
    v = retrieval.verify(c, "q", ["a", "b", "d"], "h", retrieval.Settings(k=3, index="lsh"))
    assert set(v["mismatches"]) == {"index", "evidence_digest"} and v["missing"] == ["c"] and v["added"] == ["d"]


def test_streaming_ingest(spark, tmp_path):
    from evigrain.streaming import ingest

    (tmp_path / "in").mkdir()
    line = {"title": "T", "abstract": "An abstract.", "doi": "10.1/x", "year": 2020, "authors": ["A"], "venue": "", "full_text": "", "sections": [], "source": "", "extra": {}, "imported_at": "2024-01-01T00:00:00"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in (line, line | {"doi": "doi:10.1/X"}, line | {"doi": "10.1/y", "title": "U"})))
    q = ingest.ingest(ingest.deduplicated(ingest.record_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
