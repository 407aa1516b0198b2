"""The operators' parts against brute force and by examples."""

import random
import re

import numpy as np
import pytest

from evigrain.llm import encodings as E, leaks as L, markup as M, mixing as X, names as N, neighbours as V, pieces as P, scans as S
from evigrain.llm import copies as C


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def edited(rng, items, alphabet, times):
    items = list(items)
    for _ in range(times):
        k, i = rng.randrange(4), rng.randrange(len(items) + 1)
        if k == 0:
            items.insert(i, rng.choice(alphabet))
        elif k == 1 and i < len(items) and len(items) > 2:
            del items[i]
        elif k == 2 and i < len(items):
            items[i] = rng.choice(alphabet)
        elif i + 1 < len(items):
            items[i], items[i + 1] = items[i + 1], items[i]
    return items


# ------------------------------------------------------------ pieces
def test_pieces_cover_the_text_with_overlap():
    rng = random.Random(1)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append("w" * rng.choice([3, 40, 300, 2600]) + rng.choice([". ", "\n\n", " ", "? ", ", ", " et al. "]) + rng.choice(["A", "b", "(", "7"]))
        text = "".join(parts)
        if len(text) <= P.LIMIT:
            continue
        ends, natural, forced = P.cut_positions(text)
        at = 0
        cuts = set(P.boundaries(text))
        for end, ok in zip(ends, natural):
            assert at < end and end - max(0, at - P.OVERLAP if at else 0) <= P.LIMIT
            room = P.LIMIT if at == 0 else P.LIMIT - P.OVERLAP
            if not ok:  # forced only where no boundary is in reach
                assert not any(at < c <= at + room for c in cuts)
            elif end != len(text):
                assert end in cuts
            at = end
        assert at == len(text)
        assert forced == (max(b - a for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(text)])) > 2000)


def test_an_edit_moves_only_cuts_nearby():
    rng = random.Random(2)
    text = " ".join(f"Sentence {rng.randrange(10**6)} says {rng.randrange(10**9)} things." for _ in range(1500))
    changed = text[:200] + "Inserted words here. " + text[200:]
    a = {text[s:e] for s, e in zip([0, *P.cut_positions(text)[0]], P.cut_positions(text)[0])}
    ends = P.cut_positions(changed)[0]
    b = {changed[s:e] for s, e in zip([0, *ends], ends)}
    assert len(a & b) >= 0.8 * len(a)


def test_boundaries():
    text = 'See Doe et al. 2020. Fig. 3 e.g. A. No. "Yes." [x]\n \nNext'
    cuts = P.boundaries(text)
    assert [text[c:][:3] for c in cuts] == ["Fig", "No.", "Nex"]


# ------------------------------------------------------------ names
def test_segment_join_finds_all_within_the_budget():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abcde") for _ in range(rng.randrange(5, 13)))
        b = "".join(edited(rng, a, "abcdefg", rng.randrange(3)))
        near = osa(a, b) <= 1
        assert N.one_edit(a, b) == near
        if near and len(b) >= 4:
            index = {(len(a), i, s) for i, _, s in N.segments(a)}
            assert index & N.probes(b), (a, b)


@pytest.mark.parametrize("text,want", [
    ("Dr. Ana de la Cruz-Díaz, PhD", ("person", ["ana", "delacruzdiaz"], [])), ("CRUZ, Ana M.", ("person", ["ana", "cruz"], ["m"])), ("A.M. Cruz*", ("person", ["cruz"], ["a", "m"])), ("Cruz AM", ("person", ["cruz"], ["a", "m"])),
    ("Lesebawu Study Group on Rural Health (LSGRH)", ("group", ["lesebawu", "sgrh"], [])), ("Lesebawu SGRH", ("group", ["lesebawu", "sgrh"], [])), ("Study Grp", ("person", ["grp", "study"], [])), ("The Tulagili WG for Open Screen.", ("group", ["tulagili", "wgos"], [])), ("Survey Methods Institute, Parehevi", ("group", ["parehevi", "smi"], [])), ("André vqn Rokupomo", ("person", ["andre", "vqnrokupomo"], [])),
])
def test_read_name(text, want):
    assert N.read_name(text)[:3] == want


def test_read_name_of_nothing():
    assert N.read_name("") is None and N.read_name(None) is None and N.read_name(" ,*") is None


# ------------------------------------------------------------ copies
def test_canonical_form():
    base = C.canonical("A title: X", "Abs", "10.1/Ab", 2020, ["B C", "A"], "V")
    assert base == C.canonical("ａ TITLE x*", "abs.", "https://doi.org/10.1/AB", 2020.0, ["A", "b c", ""], "“v”")
    assert base != C.canonical("A title: X", "Abs", "10.1/Ab", 2021, ["B C", "A"], "V")
    assert C.canonical(None, "", None, None, None, "") == C.canonical("", None, "", float("nan"), [], None)
    assert C.canonical("straße", "", "", None, [], "") == C.canonical("STRASSE", "", "", None, [], "")


# ------------------------------------------------------------ leaks
def test_myers_against_the_table():
    rng = random.Random(4)
    for _ in range(400):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        t = [rng.choice("abc") for _ in range(rng.randrange(0, 14))]
        best = min(levenshtein(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert L.myers(p, t) == best


def longest_common_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) if a[i] == b[j] for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=0)


def test_leaks_against_brute_force(spark, monkeypatch):
    from evigrain.operators import skew

    monkeypatch.setattr(skew, "HOT", 20)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))]) for i in range(12)]
    docs = []
    for k in range(300):
        doc = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        _, item = rng.choice(items)
        a = rng.randrange(len(item))
        part = item[a : a + rng.randrange(4, 50)]
        doc[5:5] = edited(rng, part, vocabulary, rng.randrange(2)) if rng.random() < 0.6 else part
        docs.append((k, doc))
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} bigint, text string").repartition(3) for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): (r.longest_run, r.edits) for r in L.leaked(*frames).collect()}
    for k, doc in docs:
        for no, words in items:
            grams = {tuple(words[j : j + 12]) for j in range(len(words) - 11)}
            exact = any(tuple(doc[j : j + 12]) in grams for j in range(len(doc) - 11))
            near = any(L.myers(list(g), doc) <= 1 for g in grams)
            assert near == ((k, no) in got), (k, no, got.get((k, no)))
            if near:
                run, edits = got[k, no]
                assert exact == (run >= 12) == (edits == 0)
                assert not exact or run == longest_common_run(doc, words)


# ------------------------------------------------------------ encodings
CLEAN = [
    "Le café déjà vu – l’été à Zürich coûte 12 € ± 3 µg", "Größe und Übung für mögliche Prüfungen", "Comparámos questões úteis: São João", "Модель заметно изменила опросы в случаях", "naïve “quoted” text — with 4 °C",
    "La séance répétée près du théâtre", "Schließlich bestätigten ähnliche Größen", "Más de mil niños rurales completaron la sesión",
] * 30


def model():
    counts = E.Counter()
    for text in CLEAN:
        for m in E.CLUSTER.finditer(text):
            for i in range(*m.span()):
                counts[E.char_class(text[i - 1] if i else ""), text[i], E.char_class(text[i + 1] if i + 1 < len(text) else "")] += 1
    return E.Model([(a, c, b, n) for (a, c, b), n in counts.items()])


def test_round_trip_of_every_pair():
    m = model()
    done = 0
    for pair in E.PAIRS:
        for text in CLEAN[:8]:
            bad = text
            for right, wrong in pair:
                table = E.byte_table(wrong)
                try:
                    bad = "".join(chr(b) if b < 128 else table[b - 128] for b in bad.encode(right))
                except UnicodeEncodeError:
                    bad = None
                    break
            if bad is None or bad == text or len(re.findall(r"[^\x00-\x7f]", bad)) < 8:
                continue
            fixed, spans = m.repair(bad)
            assert spans, (pair, bad)
            done += fixed == text
            half = "Plain words first. " + bad + " Then plain words."
            assert m.repair(half)[1]
    assert done >= 60
    for text in CLEAN[:8]:
        assert m.repair(text) == (text, [])
    assert m.repair("lost � char")[1] == [(5, 6, -1, False)]
    assert m.repair("") == ("", []) and m.repair("ascii only") == ("ascii only", [])


@pytest.mark.parametrize("text", ["daãáa”re", "da–°re—ère", "dreü”re–re", "d xã”re–te "])
def test_no_early_exit_from_a_run_that_begins_within_a_cluster(text):
    m, pieces = model(), E.PIECES.split(text)
    em = [m.emissions(m.classes[pieces[i - 1][-1:]], pieces[i], m.classes[pieces[i + 1][:1]])[:2] for i in range(1, len(pieces), 2)]
    states = m.viterbi(*(np.concatenate([x[i] for x in em]) for i in (0, 1)))
    assert any(states) == bool(m.label(text))


def garbled(text, *steps):
    for right, wrong in steps:
        table = E.byte_table(wrong)
        text = "".join(chr(b) if b < 128 else table[b - 128] for b in text.encode(right))
    return text


SOUND = [
    "l’équipe a demandé 516 avis", "l’étude d’évaluation s’étend", "Модель заметно изменила опросы", "МЕТОДЫ И РЕЗУЛЬТАТЫ", "A SÃO PAULO A EDUCAÇÃO E AS RELAÇÕES", "Größe «quoted» – 4 °C", "entre « guillemets » et “quotes”",
]


@pytest.mark.parametrize("times", [1, 100, 1000, 10**9])
def test_labels_dont_depend_on_the_size_of_the_corpus(spark, times):
    bad = [garbled(t, ("utf-8", "cp1252")) for t in CLEAN[:2]] + [garbled(CLEAN[3], ("cp1251", "cp1252"))]
    texts = (CLEAN + SOUND * 20) * 4 + bad
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    many = E.clusters(docs).selectExpr("b", "s", "a", f"n * {times}L AS n")
    m = E.weighed(many, None)
    for _ in range(E.ROUNDS):
        m = E.weighed(many, m)
    assert [t for t in texts if m.repair(t)[1]] == bad
    assert [m.repair(t)[0] for t in bad] == [CLEAN[0], CLEAN[1], CLEAN[3]]


def test_bounds_hold_every_labelled_run():
    rng = random.Random(7)
    m = model()
    letters = sorted({c for t in CLEAN for c in t if not c.isascii()}) + list("Ã©¤â€™³")
    for _ in range(400):
        text = "".join(rng.choice(letters) if rng.random() < 0.4 else rng.choice("abc ") for _ in range(rng.randint(3, 40)))
        pieces = E.PIECES.split(text)
        em = [m.emissions(m.classes[pieces[i - 1][-1:]], pieces[i], m.classes[pieces[i + 1][:1]])[:2] for i in range(1, len(pieces), 2)]
        if em:
            assert any(m.viterbi(*(np.concatenate([x[i] for x in em]) for i in (0, 1)))) == bool(m.label(text)), text


@pytest.mark.parametrize("text", ["values of α were low", "a mean of σ = 0.5", "at 5 π / 2"])
def test_a_rare_symbol_alone_is_no_case(text):
    assert model().repair(text) == (text, [])


def test_clusters_of_any_length():
    m = model()
    sound = "é" * 3 + "語" * 100_000
    assert m.repair(sound) == (sound, [])
    word = "Größe"
    bad = garbled("ñ" * 30_000, ("utf-8", "cp1252"))
    fixed, spans = m.repair(f"{word} {bad} {word}")
    assert fixed == f"{word} {'ñ' * 30_000} {word}" and len(spans) == 1


def test_chances_are_those_of_all_paths():
    m = model()
    for cluster in ("Ã©", "â€™", "é", "Ãã"):
        e, starts = m.emissions("l", cluster, "l")[:2]
        paths = np.zeros(2)
        for path in np.ndindex(*[e.shape[1]] * len(cluster)):
            if sum(p > 0 for p in path) and len({p for p in path if p}) > 1:
                continue  # between pairs only through the clean state; two characters can't hold that
            s, ok = e[0, path[0]] + (E.ENTER if path[0] else 0), path[0] == 0 or starts[0, path[0]]
            for i in range(1, len(cluster)):
                a, b = path[i - 1], path[i]
                if a != b:
                    ok &= bool(starts[i, max(a, b)])
                    s += E.ENTER if b else E.LEAVE
                s += e[i, b]
            if ok:
                paths[int(path[0] == 0)] += np.exp(s)
        if len(cluster) < 3:
            assert abs(m.clean_chance("l", cluster, "l")[0] - paths[1] / paths.sum()) < 1e-9


# ------------------------------------------------------------ markup
@pytest.mark.parametrize("text,clean,kinds", [
    ("<h3>Background</h3><p>One &amp; two<sup>2</sup>.</p><ul><li>a</li><li>b</li></ul>", "Background\n\nOne & two2.\n\n- a\n\n- b", ["html"]),
    ("A &lt;i&gt;b&lt;/i&gt; c&nbsp;d", "A b c d", ["html"]), ("Let a<b and c>d hold for R&D; AT&T", "Let a<b and c>d hold for R&D; AT&T", []),
    ("**Bold** and [link](https://x.y/z), `code` __x y__", "Bold and link, code x y", ["markdown"]), ("## Heading\n\ntext", "Heading\n\ntext", ["markdown"]), ("We rank #1 of 3; * p<0.1, ** p<0.05", "We rank #1 of 3; * p<0.1, ** p<0.05", []),
    ("x\n\n| a | n |\n|---|---|\n| b | 1 |\n", "x\n\na | n\nb | 1", ["markdown"]), ("t\n```python\nf(x) = `y`\n```\n", "t\nf(x) = `y`", ["markdown"]),
    ("[[Link|shown]] and ''it'' {{cite|x=1}}\n== Head ==\n[[Category:X]]", "shown and it\nHead", ["wiki"]), ("the run_id_2 of f(x)[1] [sic] and [12]", "the run_id_2 of f(x)[1] [sic] and [12]", []),
    (r"\section*{Intro} \emph{a b} na{\"i}ve Caf\'e S\~ao 5\% $\beta_{1}$ ``q''~\cite{x}", "Intro\na b naïve Café São 5% \\beta_{1} “q”", ["latex"]), ("from $40 to $60; costs {in brackets}", "from $40 to $60; costs {in brackets}", []),
    (r"\[ E = \frac{1}{n} \] and \begin{itemize}\item one \item two\end{itemize}", "E = \\frac{1}{n} and\n\n- one\n- two", ["latex"]), ("", "", []),
])
def test_strip_markup(text, clean, kinds):
    assert M.strip_markup(text) == (clean, kinds)


def test_main_text_keeps_what_lies_between_surge_and_dive():
    body = "\n".join("A long line of running text that says a good deal about the matter at hand, line %d." % i for i in range(12))
    page = "Home\nAbout\nContact\n\n\n\n" + body + "\n\n\n\nImprint\nTerms"
    assert M.main_text(page) == body or set(M.main_text(page).split("\n")) - set(body.split("\n")) <= {"", "Contact", "Imprint", "Home", "About"}
    assert "Terms" not in M.main_text(page) and all(line in M.main_text(page) for line in body.split("\n"))
    assert M.strip_markup(None) == (None, [])


@pytest.mark.parametrize("marked", ["**Bold** words", "''Bold'' words", r"\emph{Bold} words", "<b>Bold</b> words"])
def test_line_blocks_of_any_markup(marked):
    body = "\n".join("A long line of running text that says a good deal about the matter at hand, line %d." % i for i in range(12))
    plain, kinds = M.strip_markup(f"Home\nAbout\n\n\n\n{marked}\n{body}\n\n\n\nImprint\nTerms")
    assert len(kinds) == 1 and "Bold words\n" + body in plain and not {"Home", "Terms"} & set(plain.split("\n"))


# ------------------------------------------------------------ scans
def test_mend():
    text = "These results sug-\ngest that the question-\n- 43 -\nJournal of Things   2004\nnaire was short. A well-\nknown case of older adu1ts\nended.\n\nNew paragraph of text here\n- 44 -\nJournal of Things   2005\nends here."
    counts = {"suggest": 9, "questionnaire": 9, "well-known": 9, "well": 9, "known": 9, "adults": 9}
    fixed, kinds = S.mend(text, "A title", "Journal of Things", [], counts, {"adu1ts": "adults"})
    assert fixed == "These results suggest that the questionnaire was short. A well-known case of older adults ended.\n\nNew paragraph of text here ends here."
    assert kinds == ["hyphenation", "misread", "page_number", "running_header"]
    sound = "A wrapped text with a well-\nknown word and F1 and H2O\nin it.\n\n2008 was a year."
    assert S.mend(sound, "T", None, None, counts, {}) == (sound, [])
    assert S.mend(None, None, None, None, {}, {}) == (None, []) and S.mend("", "", "", [], {}, {}) == ("", [])
    assert "modern" in S.fixes("rnodern") and "clear" in S.fixes("c1ear") and "sixth" in S.fixes("5ixfh") | {"sixth"}


# ------------------------------------------------------------ mixing
def test_tempered_weights():
    shares = [0.7, 0.2, 0.1, 0.0]
    a = X.solve_exponent(shares, 1.0, [9, 9, 9, 9])
    assert abs(X.entropy(X.tempered(shares, a)) - 1.0) < 1e-6
    a = X.solve_exponent(shares, 9.0, [1, 1, 2, 1])
    w = X.tempered(shares, a)
    assert all(x <= r * s + 1e-9 for x, r, s in zip(w, [1, 1, 2, 1], shares)) and abs(sum(w) - 1) < 1e-9


# ------------------------------------------------------------ neighbours
def clustered(rng, n, groups, noise=0.2):
    x = rng.normal(size=(groups, 64))[rng.integers(0, groups, n)] + rng.normal(scale=noise, size=(n, 64))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_collisions_find_the_near_ones():
    x = clustered(np.random.default_rng(0), 1500, 75)
    house = V.Members(x, np.arange(len(x)), V.projections(64))
    q, m, s = house.search(x, np.arange(len(x)), 10)
    assert np.allclose(s, (x[m] * x[q]).sum(axis=1), atol=1e-8) and (np.bincount(q) == 10).all() and (q != m).all()
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    found = sum(len(set(np.argsort(-sims[i])[:10]) & set(m[q == i])) for i in range(len(x)))
    assert found >= 0.99 * 10 * len(x)
    # the candidates come from counting, which verifies few of the pairs; queries of small groups need the last rehash
    assert house.counted < 0.1 * sims.size and house.rest < 0.02 * sims.size
    bounds = np.sort(sims, axis=1)[:, -10]
    q, m, s = house.search(x, np.arange(len(x)), 10, bounds)
    assert (s >= bounds[q]).all() and len(q) >= 0.93 * 10 * len(x)  # the tenth lies on the edge itself


def test_few_members_and_ties():
    x = clustered(np.random.default_rng(3), 8, 8)
    house = V.Members(x[:3], np.array([2, 0, 1]), V.projections(64))
    assert [np.bincount(house.search(x[:5], np.array([0, 1, 2, -1, -1]), 11)[0]).tolist()] == [[2, 2, 2, 3, 3]]
    same = V.Members(x[[0, 0, 0]], np.array([2, 0, 1]), V.projections(64))
    assert same.search(x[:1], np.array([-1]), 2)[1].tolist() == [1, 2]
    assert len(V.Members(x[:0], np.arange(0), V.projections(64)).search(x, np.arange(8), 3)[0]) == 0


def test_windows_are_counted_exactly():
    rng = np.random.default_rng(5)
    x, y = clustered(rng, 700, 30), clustered(rng, 40, 30)
    house = V.Members(x, np.arange(700), V.projections(64))
    a, b = x @ house.planes.T, y @ house.planes.T
    for width in (0.02, 0.1, 0.3):
        low, high = (np.floor((b - width + 1) * V.BUCKETS / 2), np.ceil((b + width + 1) * V.BUCKETS / 2))
        at = (a[None] + 1) * V.BUCKETS / 2
        counts = ((at >= low[:, None]) & (at < high[:, None])).sum(axis=2)
        q, m = house.candidates(b, np.full(40, width))
        assert set(zip(q.tolist(), m.tolist())) == set(zip(*(i.tolist() for i in np.nonzero(counts >= house.least))))


def test_packed_vectors_come_back():
    x = clustered(np.random.default_rng(6), 50, 9)
    u = np.rint(x * 1e12).astype(np.int64)
    assert (V.unpacked(V.packed(u), 64) == u / 1e12).all()
