"""Plug-ins, comparisons, protocols, the request function, commands and network sources against stand-ins."""

import inspect
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain import queries as core
from evigrain.functions import embedders
from evigrain.operators import chunking, comparison, metrics, records as R, search
from evigrain.plans import experiment, protocol
from evigrain.sources import bibliography as B, services


def test_plugged_embedder(spark):
    embedders.register("ones", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, "ones/v1")
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = [r.v for r in df.select(embedders.embed(F.col("t"), "ones").alias("v")).collect()]
    assert got == [[0.894427, 0.447214], [0.0, 1.0]]
    with pytest.raises(NotImplementedError):
        embedders.fingerprint("absent")
    with pytest.raises(NotImplementedError):
        search.build_index("hnsw")
    with pytest.raises(ValueError):
        search.build_index("other")


def test_chunkers_compared(spark):
    df = R.canonical(B.synthetic(spark, 12, ["eeg", "text"])).withColumn("record_id", R.record_id())
    a, b = chunking.chunk(df, "sentence", max_words=6), chunking.chunk(df, "record")
    same = comparison.compare(a, a).collect()
    assert len(same) == 12 and all(r.boundary_jaccard == 1 and r.span_jaccard == 1 and r.same_pieces for r in same)
    assert all(r.boundary_jaccard < 1 and not r.same_pieces for r in comparison.compare(a, b).collect())


def test_judge(spark):
    claims = spark.createDataFrame([("d", 0, "cats purr"), ("d", 1, "dogs fly")], "k string, claim_no int, claim string")
    passages = spark.createDataFrame([("d", "all cats purr")], "k string, text string")
    got = comparison.judged(claims, passages, "k", lambda: lambda p, h: [0.9 if y in x else 0.1 for x, y in zip(p, h)])
    assert {r.claim_no: r.grounded for r in got.collect()} == {0: True, 1: False}


def test_list_measures(spark):
    rows = [("same", list("abc"), list("abc")), ("reversed", list("abc"), list("cba")), ("half", list("abcd"), list("abxy")), ("one", ["a"], ["a"]), ("none", [], []), ("apart", ["a"], ["b"])]
    df = spark.createDataFrame(rows, "n string, exact_ids array<string>, approx_ids array<string>")
    got = {r.n: r for r in metrics.fidelity(df).collect()}
    assert got["same"].esf == got["same"].rbo == got["same"].kendall_tau == 1 and got["reversed"].kendall_tau == -1 and got["half"].esf == 0.5
    assert (got["half"].n_missing, got["half"].n_spurious) == (2, 2) and got["none"].esf == 1 and got["none"].kendall_tau == 0 and got["one"].kendall_tau == 1 and got["apart"].rbo == 0
    lists = spark.createDataFrame([("q", 0, list("abc")), ("q", 1, list("abd")), ("q", 2, list("abe"))], "query_id string, run int, ids array<string>")
    got = metrics.stability(lists, "query_id", "run").collect()[0]
    assert got.ess == 0.5 and got.n_lists == 3 and got.identical_fraction == 0
    assert [r.p for r in spark.createDataFrame([(10,), (34,), (100,)], "n int").select(experiment.power(F.col("n")).alias("p")).collect()] == ["PILOT", "d=0.5", "d=0.3"]


def test_all_pairs_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUNS", 4)
    lists = spark.createDataFrame([("q", i, [str(i % 3), "x"]) for i in range(21)] + [("one", 0, ["a"])], "query_id string, run int, ids array<string>")
    assert metrics.run_pairs(lists, "query_id", "run").select("o1", "o2").distinct().count() == 210 == metrics.run_pairs(lists, "query_id", "run").count()
    assert metrics.stability(lists, "query_id", "run").collect()[0].identical_fraction == 63 / 210


def test_semantic_chunks_by_any_embedder(spark):
    embedders.register("first letter", lambda: lambda texts: np.array([[t.startswith("A"), not t.startswith("A")] for t in texts], float), 2, "first/v1")
    text = "Able men. All is well. An end. But no. Bees hum. By day."
    df = spark.createDataFrame([("r", "", "", text)], "record_id string, title string, abstract string, full_text string").withColumn("sections", F.expr("CAST(array() AS array<struct<heading:string,body:string>>)"))
    got = chunking.chunk(df, "semantic", embedder="first letter")
    assert [r.text for r in got.orderBy("ordinal").collect()] == ["Able men. All is well. An end.", "But no. Bees hum. By day."]
    assert chunking.build("semantic", embedder="first letter")[0].startswith("semantic/v1(embedder=first/v1,")
    assert chunking.chunk(df, "semantic").count() >= 1


def test_jsonl_sections_of_either_form(spark, tmp_path):
    lines = [{"title": "A", "sections": [["Methods", "We did."], ["Results", "It was."]]}, {"title": "B", "sections": [{"heading": "H", "body": "b"}]}, {"title": "C", "sections": []}, {"title": "D", "year": None}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    got = {r.title: r.sections for r in B.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}
    assert [tuple(s) for s in got["A"]] == [("Methods", "We did."), ("Results", "It was.")] and [tuple(s) for s in got["B"]] == [("H", "b")] and got["C"] == [] and got["D"] is None
    named = R.canonical(B.read_jsonl(spark, str(tmp_path / "a.jsonl"))).withColumn("record_id", R.record_id())
    B.write_jsonl(named, str(tmp_path / "out"))
    again = R.canonical(B.read_jsonl(spark, str(tmp_path / "out"))).withColumn("record_id", R.record_id())
    assert {r.record_id for r in named.collect()} == {r.record_id for r in again.collect()}
    assert '[["methods","We did."]' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def small_pdf(lines, deflated):
    import zlib

    text = "BT /F1 12 Tf 72 720 Td " + " ".join(f"({x}) Tj 0 -14 Td" for x in lines) + " [(T) 20 (wo) -300 (words)] TJ ET"
    data = zlib.compress(text.encode("cp1252")) if deflated else text.encode("cp1252")
    return b"%PDF-1.4\n1 0 obj <</Length " + str(len(data)).encode() + b">>\nstream\n" + data + b"\nendstream\nendobj\n%%EOF"


@pytest.mark.parametrize("deflated", [False, True])
def test_local_text_of_a_pdf(deflated):
    assert services.local_text(small_pdf(["A title of a study", "caf\\351 \\(two\\)"], deflated)) == "A title of a study\ncafé (two)\nTwo words"
    for bad in (b"", b"plain", b"%PDF-1.4\n"):
        with pytest.raises(ValueError):
            services.local_text(bad)


def test_reports(spark, tmp_path):
    from evigrain.plans import reports

    path = str(tmp_path / "sets")
    for stamp, digest in (("2024-01-02", "b"), ("2024-01-01", "a")):
        reports.save_evidence(spark.createDataFrame([(1, "screening", "q", digest, stamp), (2, "screening", None, digest, stamp)], "review_id long, stage string, query string, evidence_digest string, saved_at string"), path)
    assert [(r.review_id, r.evidence_digest) for r in reports.evidence_sets(spark, path).orderBy("review_id").collect()] == [(1, "b"), (2, "b")]
    reports.save_verifications(spark.createDataFrame([(1, "s", "h", None, True, ["x"], None, None)], reports.VERIFICATIONS), str(tmp_path / "v"))
    svg = reports.scatter_svg([("lsh <8>", 0.5, 0.25)])
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(svg).findall(".//{http://www.w3.org/2000/svg}circle")) == 2
    claims = spark.createDataFrame([(0, "cats purr loudly"), (1, "dogs bark often")], "claim_no int, claim string")
    sets = {"e": spark.createDataFrame([("cats purr loudly here",), ("nothing",)], "text string"), "a": spark.createDataFrame([("dogs bark often",)], "text string")}
    got = {(r.left_set, r.right_set): (r.n_lost, r.n_gained, r.n_kept, r.divergence) for r in reports.divergence_between(claims, sets, [("e", "e"), ("e", "a")]).collect()}
    assert got == {("e", "e"): (0, 0, 1, 0.0), ("e", "a"): (1, 1, 0, 1.0)}
    assert protocol.health()["ok"] and set(protocol.backends()["chunkers"]) == set(chunking.NAMES)


def test_experiment_grid(spark, tmp_path):
    corpus = R.canonical(B.synthetic(spark, 24, ["eeg", "text", "sleep"])).withColumn("record_id", R.record_id())
    queries = spark.createDataFrame([("q1", "sleep effects"), ("q2", "eeg in sample")], "query_id string, query_text string")
    rows = experiment.run_experiment(corpus, queries, [12, 500], ["record", {"name": "semantic", "params": {"jitter": 0.1}, "seeds": [1, 2]}], [{"backend": "lsh", "params": {"bits": 4, "tables": 2}, "seeds": [0, 1]}], k=4, dimension=64)
    kinds = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"exact": 6, "approx": 12, "chunker": 2, "chunker_stability": 2}
    assert rows.where("kind = 'exact' AND size(chunk_ids) <> 4").count() == 0 and rows.where("span_jaccard < 0 OR span_jaccard > 1 OR corpus_size <> 12").count() == 0
    axes = {r.axis: r.n for r in experiment.variance_decomposition(rows).collect()}
    assert axes == {"index": 6, "chunker choice": 2, "chunker seed": 2}
    experiment.save_rows(rows, str(tmp_path / "grid"))
    assert {p.name for p in (tmp_path / "grid").glob("kind=*")} == {f"kind={k}" for k in kinds}
    assert experiment.run_experiment(corpus, queries, [500], ["record"], []).count() == 0


def test_study(spark):
    from evigrain.plans import reports

    corpus = R.canonical(B.synthetic(spark, 30, ["eeg", "text", "sleep"])).withColumn("record_id", R.record_id())
    out = reports.study(corpus, "effects of sleep", k=5, chunker="record", section="abstract", seeds=2, repeats=1)
    assert out["verification"]["verified"] and out["coverage"]["records"] == 30 and out["latency"]["chunks"] == 30 and 0 <= out["stability"]["ess"] <= 1
    assert R.by_id(corpus, corpus.first().record_id).count() == 1


def test_pdf_folder_to_records(spark, tmp_path):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Methods</head><p>We did.</p></div></body></text></TEI>'
    for name, content in (("a_b.pdf", "plain words of a page"), ("c.pdf", tei), ("d.pdf", "<broken"), ("e.pdf", "boom"), ("f.pdf", " "), ("skip.txt", "x")):
        (tmp_path / name).write_bytes(content.encode())

    def extract(content: bytes) -> str:
        if content == b"boom":
            raise OSError("no service")
        return content.decode()

    records, coverage = B.read_pdfs(spark, str(tmp_path), extract)
    assert {r.title: (r.full_text, len(r.sections or [])) for r in records.collect()} == {"plain words of a page": ("plain words of a page", 0), "T": ("", 1)}
    assert coverage.collect()[0].asDict() == {"files_found": 5, "processed": 2, "with_sections": 1, "without_sections": 1, "failed": 3, "coverage": 0.4}
    records, coverage = B.read_pdfs(spark, str(tmp_path), extract, limit=2, require_sections=True)
    assert [r.title for r in records.collect()] == ["T"] and coverage.collect()[0].processed == 1


def test_protocols_and_requests(spark):
    df = spark.createDataFrame([(1, "Title", "adults", "", None, "recall", ["sample size", ""]), (2, "Only title", None, None, None, None, None)], protocol.PROTOCOL)
    assert {(r.review_id, r.query_id, r.query_text) for r in protocol.protocol_queries(df).collect()} == {(1, "pico", "adults recall"), (1, "field-0", "sample size"), (2, "pico", "Only title")}
    records = [{"title": f"Study {i}", "abstract": f"Effect of topic{i % 3} on sleep.", "doi": f"10.1/{i}", "year": 2000 + i} for i in range(8)]
    out = protocol.answer(spark, {"query": "topic1 sleep", "records": records, "k": 3})
    assert len(out["evidence"]) == 3 and out["certificate"]["corpus_size"] == 8 and "topic1" in out["evidence"][0]["text"]
    for bad in ({"query": " "}, {"query": "x"}):
        with pytest.raises(ValueError):
            protocol.answer(spark, bad)


def test_review_source(spark):
    def fetch(url, headers):
        assert headers["Authorization"] == "Bearer t"
        return json.dumps({"data": [{"extraction_status": "extracted", "extracted_text": f"Text of {url.split('/')[-2]}", "extracted_metadata": {"title": "A"}}]}).encode()

    spark.dataSource.register(services.review_source(fetch))
    df = spark.read.format("review_files").option("url", "http://x").option("token", "t").option("reviews", "4,5").load()
    assert {r.full_text for r in B.from_source_files(df).collect()} == {"Text of 4", "Text of 5"}


def test_review_protocol(spark):
    row = services.review_protocol("http://x/", "7", "t", lambda url, headers: json.dumps({"data": {"title": "T", "protocol": {"population": "adults", "extraction_fields": ["n"]}}}).encode())
    got = protocol.protocol_queries(spark.createDataFrame([row], protocol.PROTOCOL)).collect()
    assert {(r.review_id, r.query_id, r.query_text) for r in got} == {(7, "pico", "adults"), (7, "field-0", "n")}


def test_own_chunker_and_back_end(spark):
    chunking.register("title", lambda **p: ("title/v1", lambda: F.array(chunking.piece(F.lit("title"), F.col("title")))))
    df = R.canonical(B.synthetic(spark, 3, ["eeg"])).withColumn("record_id", R.record_id())
    assert {r.text for r in chunking.chunk(df, "title").collect()} == {f"Study 0000{i} on eeg" for i in range(3)}
    search.register("none", lambda **p: lambda v, q, k, **kw: v.limit(0))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    assert search.build_index("none")(v, v, 1).count() == 0 and search.checked(v) == 2
    for bad, what in (([(1, [1.0]), (2, [0.0, 1.0])], "several lengths"), ([(1, [1.0]), (1, [2.0])], "twice"), ([(None, [1.0])], "missing"), ([(1, [float("nan")])], "finite"), ([], "no vectors")):
        with pytest.raises(ValueError, match=what):
            search.checked(spark.createDataFrame(bad, "id int, v array<double>"))
    with pytest.raises(ValueError, match="not 3"):
        search.checked(v, dimension=3)


def test_commands(spark, tmp_path, capsys):
    from evigrain.__main__ import main

    src = tmp_path / "a.jsonl"
    src.write_text("\n".join(json.dumps({"title": f"Study {i}", "abstract": f"Sleep topic{i % 3}.", "doi": f"10.1/{i}", "year": 2000, "authors": [], "venue": "", "full_text": "", "sections": []}) for i in range(6)))
    assert main(["hash", str(src)]) == 0
    assert main(["retrieve", str(src), "--query", "topic1", "--k", "2", "--certificate", str(tmp_path / "c.json")]) == 0
    assert main(["verify", str(src), "--certificate", str(tmp_path / "c.json")]) == 0
    (tmp_path / "tei").mkdir()
    (tmp_path / "tei" / "a.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader><text><body><div><head>Methods</head><p>We did.</p></div></body></text></TEI>')
    assert main(["ingest-tei", str(tmp_path / "tei"), "--out", str(tmp_path / "tei_out"), "--require-sections"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["with_sections"] == 1
    assert main(["import", str(src), "--out", str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["records"] == 6


@pytest.mark.parametrize("name", ["ivf_topk", "ivfpq_topk", "lsh_topk"])
def test_indexes_find_nine_of_ten(spark, small, name):
    best, got = ({(r.query_id, r.id) for r in core.QUERIES[q](spark, small).collect()} for q in ("flat_cosine_topk", name))
    assert len(best & got) >= 0.9 * len(best)


def test_product_quantisation_loses_nothing(spark):
    """Codes of two parts are far off, and zero vectors lie nearer to any query than most; the rows are those of the plain cells."""
    x = np.random.default_rng(3).normal(size=(1500, 16))
    x[:30] = 0
    x[30:400] = x[400] + 0.01 * x[30:400]
    v = search.usable(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, e array<double>"), "id", "e")
    q = v.where("id % 100 = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    plain, coded = ({tuple(r) for r in search.ivf(v, q, 5, cells=4, probes=3, parts=p).collect()} for p in (0, 2))
    assert plain == coded and len(plain) == 75


def test_bootstrap_draws_ten_thousand(spark, small, monkeypatch):
    real, drawn = metrics.bootstrap_interval, []

    def seen(*args, **named):
        bound = inspect.signature(real).bind(*args, **named)
        bound.apply_defaults()
        drawn.append(bound.arguments["resamples"])
        return real(*args, **named)

    monkeypatch.setattr(metrics, "bootstrap_interval", seen)
    core.QUERIES["bootstrap_ci"](spark, small)
    assert drawn == [10_000]
