"""The operators on small tables: brute force, and nulls, empty and long texts, ties, copies, empty tables, clashing names."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain.llm import copies, encodings, leaks, markup, mixing, names, neighbours, pieces, queries, scans

RECORDS = "record_key bigint, record_id string, title string, abstract string, doi string, pub_year int, authors array<string>, venue string, full_text string, sections array<struct<heading:string,body:string>>, import_id bigint, text string, n int, g string"


def record(key, title=None, abstract=None, doi=None, year=None, authors=None, venue=None, full_text=None, sections=None):
    return key, f"r{key}", title, abstract, doi, year, authors, venue, full_text, sections, 1, "clash", 7, "clash"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        record(3, "A Title", "Abs.", "10.1/x", 2020, ["B", "A"], "V"), record(1, "a title*", "abs", "https://doi.org/10.1/X", 2020, ["A", "b"], "“V”"), record(2, "A Title", "Abs.", "10.1/x", 2020, ["B", "A"], "V"),
        record(4, "A Title", "Abs.", "10.1/x", 2021, ["B", "A"], "V"), record(5), record(6, "", "", None, None, [], ""), record(7, None, None, "", None, [""], None), record(None, "A Title", "Abs.", "10.1/x", 2020, ["A", "B"], "V"),
    ]
    return spark.createDataFrame(rows, RECORDS)


def empty(spark):
    return spark.createDataFrame([], RECORDS)


def test_copies(spark, records):
    assert {tuple(r) for r in copies.copy_pairs(records).collect()} == {(1, 2), (1, 3), (5, 6), (5, 7)}
    classes, _ = copies.collapse(records)
    assert sorted((r.first_key, r.n_copies, r.n_forms) for r in classes.collect()) == [(1, 4, 3), (4, 1, 1), (5, 3, 3)]
    assert copies.copy_pairs(empty(spark)).count() == 0
    reports = spark.createDataFrame([(1, 2, 8), (9, None, 0)], "import_id long, duplicates_removed long, records_built long")
    got = {r.import_id: (r.copies_found, r.difference) for r in copies.import_comparison(records, reports).collect()}
    assert got == {1: (4, 2), 9: (0, None)}


def test_pieces(spark):
    chunk = spark.createDataFrame([("c1", "x. " * 10), ("c2", "Word here. " * 900), ("c3", None), ("c4", ""), ("c5", "y" * 5000)], "chunk_id string, text string")
    recs = spark.createDataFrame([record(1, full_text="A b. " * 1000, sections=[("h", "s" * 3000), ("h", None)]), record(2)], RECORDS)
    out = pieces.split_items(pieces.bibliographic_items(recs, chunk))
    assert {(r.item_kind, r.item_key, r.item_no, r.cut_kind) for r in out.collect()} == {("chunk", "c2", 0, "natural"), ("chunk", "c5", 0, "forced"), ("full_text", "1", 0, "natural"), ("section", "1", 0, "forced")}
    assert out.where("length(piece_text) > 2000 OR length(piece_text) <> piece_end - piece_start").count() == 0
    assert pieces.split_items(pieces.bibliographic_items(empty(spark), chunk.limit(0))).count() == 0


def test_names(spark):
    variants = ["Katherine Lodekewu", "Lodekewu, Katherine", "LODEKEWU Katherine", "K. Lodekewu", "Lodekewu K", "Kathy Lodekewu", "Katherine Lodekweu", "Kahterine Lodekewu", "katherine lodekewu*", "Dr. Katherine Lodekewu, PhD"]
    others = ["Gabriela Lodekewu", "Samuel Pihu-Goce", "Samuel Pihu Goce", "Goce, Tomas", "", None, "???", "Noor"]
    groups = ["Fanileru Study Group on Rural Health", "Fanileru SGRH", "Fanileru Study Grp Rural Hlth"]
    df = spark.createDataFrame([(n,) for n in variants + others + groups + variants], "name string")
    found = names.entities(df)
    by = {}
    for r in found.collect():
        by.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [set(variants), {"Gabriela Lodekewu"}, {"Samuel Pihu-Goce", "Samuel Pihu Goce"}, {"Goce, Tomas"}, {"Noor"}, set(groups)]))
    pairs = names.spelling_pairs(found).collect()
    assert len(pairs) == 45 + 1 + 3 and all(r.name_a < r.name_b for r in pairs)
    assert names.entities(df.limit(0)).count() == 0


def test_initials_that_fit_two_are_left(spark):
    df = spark.createDataFrame([("Eduardo Cihawejo",), ("Elizabeth Cihawejo",), ("E. Cihawejo",)], "name string")
    assert names.entities(df).select("entity").distinct().count() == 3


@pytest.mark.parametrize("settings", [{}, {"per_cell": 40}, {"per_cell": 40, "most_top": 3}])
def test_neighbours_against_brute_force(spark, settings):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    x = centres[np.arange(600) % 30] + rng.normal(scale=0.22, size=(600, 64))
    x[100:130] = x[100]  # one direction many times
    x[200] = 3 * x[100]
    x[300] = 1e200 * x[7]
    rows = [(f"c{i:04d}", v.tolist(), "clash", 1) for i, v in enumerate(x)] + [("n", None, "", 1), ("e", [], "", 1), ("z", [0.0] * 64, "", 1), ("nan", [float("nan")] * 64, "", 1), ("short", [1.0], "", 1), (None, x[0].tolist(), "", 1)]
    df = spark.createDataFrame(rows + rows[5:9], "chunk_id string, embedding array<double>, id string, cell int").repartition(5)
    found = neighbours.nearest(df, **settings)
    got = {tuple(r) for r in neighbours.similar_pairs(found).collect()}
    x[300] = x[7]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(len(u)):
        s = np.round(u @ u[i], 9)
        s[i] = -1
        for j in np.lexsort((np.arange(len(u)), -s))[:10]:
            if s[j] >= 0.9:
                want.add((f"c{min(i, j):04d}", f"c{max(i, j):04d}"))
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    per = found.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("other").alias("d"), F.max("rank_no").alias("r")).collect()
    assert len(per) == 600 and all(r.n == r.d == r.r == 10 for r in per)
    assert neighbours.nearest(df.where("chunk_id IN ('n', 'z')")).count() == 0
    assert neighbours.nearest(df.where("chunk_id = 'c0001'")).count() == 0
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_recall_on_the_test_table(spark):
    """All ten of every vector of sf0.01, in several cells, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/chunk_vectors.parquet").select("chunk_id", "embedding")
    rows = [(r.chunk_id, r.embedding) for r in df.collect() if r.embedding and any(r.embedding)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([c for c, _ in rows])
    got: dict = {}
    for r in neighbours.nearest(df, per_cell=100).collect():
        got.setdefault(r.id, {})[r.other] = r.cosine
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -2)
    order = [np.lexsort((ids, -s))[:10] for s in sims]
    assert sum(len(got[i].keys() & set(ids[o])) for i, o in zip(ids, order)) >= 0.95 * 10 * len(ids)


def test_leaks(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"Intro. {passage.upper()} end"), (2, " ".join(passage.split()[:11])), (3, passage.replace(" ", ",\n- ")), (4, None), (5, ""), (6, "x " * 100_000 + passage), (7, passage.replace("word6 ", "other ").replace("word13 ", "")), (None, passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, passage), (11, "too short"), (12, None), (13, passage)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in leaks.leaked(docs, items).collect()}
    assert {k for k, r in found.items() if r.longest_run >= 12} == {(d, i) for d in (1, 3, 6, 7) for i in (10, 13)}
    assert found[2, 10].edits == 1
    assert leaks.leaked(docs, items.limit(0)).count() == 0 and leaks.leaked(docs.limit(0), items).count() == 0
    # a filter so small that nearly everything passes it gives the same rows
    tiny = leaks.leaked(docs, items, filter_bytes=1)
    assert {(r.doc_id, r.item_id): r for r in tiny.collect()} == found


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "one two three four five six", "a") for i in range(300)] + [(1000 + i, "seven eight nine", "b") for i in range(20)] + [(5000, None, "b"), (5001, "", "a"), (5002, "text", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mixture(mixing.source_tokens(docs), targets)
    p = {r.source: r for r in plan.collect()}
    assert {s for s, r in p.items() if r.starved} == {"b", "c"} and p["b"].quota == 2 * p["b"].tokens and p["c"].quota == 0
    drawn = mixing.draw(docs, plan)
    got = {r.source: r for r in mixing.reached(drawn, plan).collect()}
    assert abs(got["a"].share_of_all - 0.5) < 0.01 and got["b"].drawn_tokens == p["b"].quota and got["b"].most_repeats == 2 and got["c"].drawn_docs == 0
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in mixing.draw(docs.repartition(5), plan).collect()}
    # b twice over, each block an order of its own over all documents; a cut where the rest of its quota ends
    rows = sorted(((r.source, r.block_no, r.token_offset, r.doc_id, r.tokens) for r in drawn.collect()), key=lambda r: (*r[:3], r[4]))
    orders = {(s, b): [r[3] for r in rows if r[:2] == (s, b)] for s, b in {r[:2] for r in rows}}
    assert set(orders) == {("a", 0), ("b", 0), ("b", 1)} and sorted(orders["b", 0]) == sorted(orders["b", 1]) and orders["b", 0] != orders["b", 1]
    assert all(x[2] + x[4] == y[2] for x, y in zip(rows, rows[1:]) if x[:2] == y[:2])
    flat = {r.source: r for r in mixing.tempered_mixture(mixing.source_tokens(docs), targets, target_entropy=0.5).collect()}
    weights = [flat["a"].target_share, flat["b"].target_share]
    assert abs(sum(weights) - 1) < 1e-9 and abs(mixing.entropy(weights) - 0.5) > 0.01 and abs(flat["b"].quota - flat["b"].capacity) <= 1  # the repeat limit binds
    low = {r.source: r for r in mixing.tempered_mixture(mixing.source_tokens(docs), targets, target_entropy=0.18).collect()}
    assert abs(mixing.entropy([low["a"].target_share, low["b"].target_share]) - 0.18) < 1e-6 and not low["a"].starved
    got = {r.source: r for r in mixing.reached(mixing.draw(docs, mixing.tempered_mixture(mixing.source_tokens(docs), targets, target_entropy=0.18)), mixing.tempered_mixture(mixing.source_tokens(docs), targets, target_entropy=0.18)).collect()}
    assert abs(got["a"].share_of_drawn - low["a"].target_share) < 0.01
    none = mixing.plan_mixture(mixing.source_tokens(docs.limit(0)), targets)
    assert mixing.draw(docs.limit(0), none).count() == 0
    assert none.where("starved").count() == 3


def test_encodings(spark):
    clean = ["Le café déjà vu à l’été", "Größe für mögliche Übung", "naïve “text” – 4 °C"] * 40
    bad = ["Le cafÃ© dÃ©jÃ\xa0 vu Ã\xa0 lâ€™Ã©tÃ©", "Gr├Â├ƒe f├╝r m├Âgliche ├£bung", "lost � here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad + [None, "", "plain"])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in encodings.repair(docs).where("affected").collect()}
    assert set(got) == {120, 121, 122} and got[120].text_repaired == clean[0] and got[121].text_repaired == clean[1] and not got[122].restored and got[120].restored
    assert encodings.repair(docs.limit(0)).count() == 0


def test_markup(spark):
    recs = spark.createDataFrame([record(1, "<b>T</b>", "Let a<b and c>d."), record(2, None, ""), record(3, "x" * 200_000 + " [[l]]", "**b**"), record(None, "<i>x</i>")], RECORDS)
    got = {(r.record_key, r.field_name): (r.text_clean[-3:], r.kinds) for r in markup.clean(recs, "record_key", ("title", "abstract")).collect()}
    assert got == {(1, "title"): ("T", ["html"]), (3, "title"): ("x l", ["wiki"]), (3, "abstract"): ("b", ["markdown"]), (None, "title"): ("x", ["html"])}
    assert markup.clean(empty(spark), "record_key", ("title",)).count() == 0


def test_menus_and_footers_around_marked_up_text(spark):
    """The line blocks act on what is left of a page once its markup is off, whatever the markup; headings, lists and
    code inside the text stay."""
    menu, foot = ["Home", "About us", "Journals", "Search", "Login"], ["Contact", "Imprint", "Terms", "Privacy"]
    body = [f"Sentence {i} of the study tells at some length what was measured, how, and in which of the groups it held." for i in range(8)]
    html = "".join(f"<div>{x}</div>" for x in menu) + "<h2>Methods</h2>" + "".join(f"<p>{x}</p>" for x in body[:4]) + "<ul><li>first item</li></ul>" + "".join(f"<p>{x}</p>" for x in body[4:]) + "".join(f"<div>{x}</div>" for x in foot)
    markdown = "\n".join([*menu, "", *body[:4], "", "## **Results**", "", "- first item", "", *body[4:], "", *foot])
    recs = spark.createDataFrame([record(1, "t", html), record(2, "t", markdown)], RECORDS)
    got = {r.record_key: r.text_clean for r in markup.clean(recs, "record_key", ("abstract",)).collect()}
    for key, heading in ((1, "Methods"), (2, "Results")):
        lines = got[key].split("\n")
        assert all(x in lines for x in [*body, "- first item"]) and (key == 1 or heading in lines)
        assert not set(lines) & {*menu[:-2], *foot[2:]}


def test_scans(spark):
    words = "community pharmacists completed questionnaires about estimators and thresholds during well-known sessions"
    sound = [record(100 + i, f"Title {i}", words, full_text=words) for i in range(60)]
    noisy = "Community pharma-\ncists completed questionnaires about estirnators\n12\nJournal of Things   2001\nand thresh0lds during well-\nknown sessions"
    recs = spark.createDataFrame(sound + [record(1, "Some title", "x", venue="Journal of Things", full_text=noisy), record(2, full_text=""), record(3), record(None, full_text=noisy), record(4, "Communify pharmacists", full_text=words.replace(" ", "\n"))], RECORDS)
    want = {(1, "full_text"): ["hyphenation", "misread", "page_number", "running_header"], (4, "title"): ["misread"]}
    for size in (scans.FILTER_BYTES, 1):
        got = {(r.record_key, r.field_name): r for r in scans.repair(recs, filter_bytes=size).collect()}
        assert {k: r.noise_kinds for k, r in got.items()} == want
        assert got[1, "full_text"].text_repaired == "Community pharmacists completed questionnaires about estimators and thresholds during well-known sessions"
    assert scans.repair(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    r = con.execute(queries.SQL[name])
    order = [c[0] for c in r.description]
    assert {tuple(x) for x in r.fetchall()} == {tuple(x) for x in queries.QUERIES[name](spark, small).select(*order).collect()}


def test_short_forms_of_several_languages(spark):
    pairs = "mike michael, tommy thomas, tommy tomas, larry lawrence, jerry gerald, misha mikhail, pepe jose, paco francisco, vova vladimir, harriet henrietta, freddie frederick, nora noora"
    rows = [(f"{g.title()} {3 * chr(65 + i)}ovel{2 * chr(97 + i)}".replace("AAA", "Baa"),) for i, p in enumerate(pairs.split(", ")) for g in p.split()]
    got = names.entities(spark.createDataFrame(rows, "name string"))
    assert got.groupBy("entity").count().where("count = 2").count() == len(rows) // 2
    none = names.entities(spark.createDataFrame([("Lalo Surname",), ("Eduardo Surname",)], "name string"), nicknames={})
    assert none.select("entity").distinct().count() == 2


def test_pairs_that_meet_grow_with_the_names(spark):
    """Given names and initials of a small pool, surnames of a large one, some with an initial only: what meets in the
    index of segments grows as the names, not as their square."""
    rng = np.random.default_rng(4)
    parts = [a + b for a in "bdfgklmnprst" for b in "aeiou"]

    def met(n):
        given = ["".join(rng.choice(parts, 3)) for _ in range(30)]
        rows = [(f"{given[i % 30] if i % 3 else given[i % 30][0] + '.'} {''.join(rng.choice(parts, 4))}".title(),) for i in range(n)]
        nodes = names.parsed_nodes(spark.createDataFrame(rows, "name string"))[1]
        return names.segment_pairs(nodes).count() / nodes.count()

    assert met(4000) <= 2 * met(1000) + 0.2
