"""Variant spellings of names typed by people.

Each distinct string is read once: case, accents, titles and marks aside, as a set of whole words (hyphened and
particled surnames glued), initials, and, for groups, the first word with the initials of the rest. Spellings are then
linked by equality joins only:

* equal word sets, whatever their order;
* one edit (insertion, deletion, substitution or swap) in one word, the others equal: the pigeonhole segment join. The
  edited word is cut into budget + 1 segments, the other names look up their position-shifted substrings in the inverted
  index of segments, and hits are verified with a banded edit distance;
* a short form of a given name beside the whole one;
* initials beside the names they stand for.

Short forms and initials are attached only where they fit one entity, since no string names two. Entities are the
connected components of the links, found in rounds of joins. No step pairs the names of a block: what is emitted grows
with the number of distinct strings.

Defined results: null and empty names, and those without a letter, are left out; equal strings are one; strings that
differ in case or marks only are linked; names in one word are linked by equality alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evigrain.operators.components import components
from evigrain.session import cut, spread

BUDGET = 1
#: Particles glued to the surname after them, titles and suffixes left out, words that make a group.
PARTICLES = frozenset("van von de der den del della da di du dos das la le el al bin ibn ter ten te zu zum".split())
TITLES = frozenset("dr prof professor mr mrs ms sir phd md msc bsc ma mba dphil jr sr ii iii".split())
COLLECTIVE = frozenset("group consortium network collaboration collaborative committee wg cons team centre center ctr institute inst assoc soc comm initiative investigators association society grp consort netw collab cttee study trialists".split())
SMALL = frozenset("on for of the and in to a an und et de".split())
#: Short forms of given names that no rule below gives, each with the names it is short for, of several
#: languages. ``entities`` takes another relation as a parameter.
SHORT_FORMS = {short: frozenset(wholes.split()) for line in """
bill william/billy william/liam william/bob robert/bobby robert/dick richard/jim james/jimmy james/jack john jackson/ted theodore edward/teddy theodore edward/ned edward edmund
tony anthony antonio antonia antoine/toni anthony antonio antonia/kitty katherine catherine/kit christopher katherine/peg margaret/peggy margaret/maggie margaret magdalena/meg margaret megan/greta margaret margarete
betty elizabeth/betsy elizabeth/liz elizabeth/lizzie elizabeth/libby elizabeth/polly mary/molly mary/sally sarah/sadie sarah/hal henry harold/harry henry harold harrison/hank henry/hetty henrietta/hettie henrietta/hattie henrietta harriet/harriet henrietta
nell eleanor helen/nellie eleanor helen/dolly dorothea dorothy/dot dorothea dorothy/dottie dorothea dorothy/dodie dorothea dorothy/jo josephine joanna/josie josephine/joey joseph josephine/trish patricia/trisha patricia/patsy patricia/patty patricia
sasha alexander alexandra aleksandr/sandy alexander alexandra sandra/lex alexander/shura alexander alexandra/chuck charles/minnie wilhelmina/willa wilhelmina/billie wilhelmina/luz lucia/izzy isabella isabel isidore/belle isabella
fritz friedrich frederick/rik frederick hendrik/klaus nicholas nikolaus/claus nicholas nikolaus/len leonard/lenny leonard/lando yolanda/quin quentin/quinn quentin/pete piotr petr pedro/kris christopher kristina/lalo eduardo
larry lawrence laurence/jerry gerald jerome jeremy gerard/terry terence theresa/jeff geoffrey/jill gillian/becky rebecca/mandy amanda/nan anne nancy/wally walter/sue susan susanna
misha mikhail michael/vova vladimir/volodya vladimir/kolya nikolai nikolay/petya pyotr petr/vanya ivan/alyosha alexei aleksei/grisha grigory grigori/dima dmitry dmitri/zhenya evgeny evgenia/katya ekaterina/masha maria mariya/natasha natalia natalya
nastya anastasia/tanya tatiana tatyana/olya olga/yura yuri yury/kostya konstantin/tolya anatoly/vitya viktor victor/borya boris/seryozha sergei sergey
pepe jose/paco francisco/pancho francisco/nacho ignacio/chema jose/quique enrique/kike enrique/lola dolores/concha concepcion/charo rosario/manolo manuel/memo guillermo/chucho jesus/beto alberto roberto humberto/chelo consuelo/ze jose/zeca jose/chico francisco
hans johannes/heinz heinrich/sepp josef joseph/jupp josef/jochen joachim/uschi ursula/ilse elisabeth/margot marguerite/loulou louis/kasia katarzyna/basia barbara/gosia malgorzata/wojtek wojciech/zosia zofia/kuba jakub/honza jan/beppe giuseppe/pippo filippo
""".replace("\n", "/").split("/") if line.strip() for short, _, wholes in [line.strip().partition(" ")]}


def unaccented(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("đ", "d").replace("æ", "ae"))
    return "".join(c for c in text if not unicodedata.combining(c))


def glued(words: list[str]) -> list[str]:
    """Hyphens and apostrophes taken out, particles joined to the word after them, as is a short word in lower case
    between others that aren't (a particle mistyped)."""
    out, before = [], ""
    mixed = any(not w.islower() for w in words)
    for k, w in enumerate(words):
        if mixed and w.islower() and len(w) <= 4 and k + 1 < len(words) and not words[k + 1].islower():
            before += re.sub(r"[-'’‐‑.]", "", w)
            continue
        w = re.sub(r"[-'’‐‑.]", "", w).lower()
        if not w:
            continue
        if w in PARTICLES:
            before += w
        else:
            out.append(before + w)
            before = ""
    if before:
        out.append(before)
    return out


def read_name(text: str | None) -> tuple[str, list[str], list[str], list[str]] | None:
    """(kind, whole words, initials in the order typed, other nodes it may belong to) of a name, or None without letters.
    For a group the whole words are the first word and the initials of the others."""
    if not text:
        return None
    s = re.sub(r"[*†‡§¶#\d_\"“”]+", " ", unaccented(unicodedata.normalize("NFKC", text)))
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = " ".join(s.split()).strip(" ,;.")
    if not re.search(r"[^\W\d_]", s):
        return None
    plain = re.findall(r"[^\W\d_]+", s)
    low = [w.lower() for w in plain]
    if len(low) > 2 and low[0] == "the":
        plain, low, s = plain[1:], low[1:], s.split(None, 1)[1]
    acronym = len(plain) == 2 and plain[1].isupper() and len(plain[1]) >= 3 and not plain[0].isupper() and not any(c in plain[1] for c in "AEIOU") and "," not in s
    if len(low) > 2 and (COLLECTIVE & set(low) or {"on", "for", "of"} & set(low[1:])) or acronym:
        head, comma, tail = s.rpartition(",")
        if comma and len(tail.split()) == 1:  # the distinguishing name put last
            low = [tail.strip().lower(), *(w.lower() for w in re.findall(r"[^\W\d_]+", head))]
        rest = low[1:]
        letters = rest[0] if acronym else "".join("wg" if w == "wg" else w[0] for w in rest if w not in SMALL)
        return "group", [low[0], letters], [], []
    if "," in s:
        parts = [p.split() for p in s.split(",")]
        parts = [[w for w in p if w.strip(".").lower() not in TITLES] for p in parts]
        parts = [p for p in parts if p]
    else:
        parts = [[w for w in s.split() if w.strip(".").lower() not in TITLES or w.isupper() and len(w) <= 2]]
        parts = [p for p in parts if p]
    if not parts:
        return None
    words: list[str] = []
    initials: list[str] = []
    others: list[str] = []
    comma = len(parts) > 1
    for k, part in enumerate(parts):
        full = []
        for w in part:
            letters = re.sub(r"[^\w]", "", w).lower()
            dotted = re.fullmatch(r"(?:[^\W\d_]\.[-]?){1,4}[^\W\d_]?\.?", w) is not None and len(letters) <= 4
            inner = w.islower() and not s.islower() and w != part[-1] and len(letters) == 2
            if letters and (len(letters) == 1 and not inner or dotted or len(letters) == 2 and letters not in PARTICLES and not inner):
                initials += letters
            elif letters:
                full.append(w)
        g = glued(full)
        if comma and k == 0 and len(g) > 1:  # a surname in several words
            others.append(" ".join(g))
            g = ["".join(g)]
        words += g
    if not words:
        return "person", ["".join(initials)], [], []
    if not comma and len(words) == 3:
        a, b, c = words
        others = [f"{a} {b}{c}", f"{a}{b} {c}", f"{c} {a}{b}", f"{b}{c} {a}"]
    nodes = {f"person|{' '.join(sorted(o.split()))}|" for o in others}
    if len(plain) == 2 and plain[1].isupper() and 3 <= len(plain[1]) <= 5 and not plain[0].isupper():  # may be a group's initials
        nodes.add(f"group|{low[0]} {low[1]}|")
    return "person", sorted(words), initials, sorted(nodes)


def one_edit(a: str, b: str, budget: int = BUDGET) -> bool:
    """Whether two words differ by at most ``budget`` edits, a swap of neighbours being one; only the band of that
    width around the diagonal is computed."""
    if abs(len(a) - len(b)) > budget:
        return False
    big = budget + 1
    before, last = {}, {j: j for j in range(0, budget + 1)}
    for i in range(1, len(a) + 1):
        row = {}
        for j in range(max(0, i - budget), min(len(b), i + budget) + 1):
            if j == 0:
                row[0] = i
                continue
            v = min(last.get(j, big) + 1, row.get(j - 1, big) + 1, last.get(j - 1, big) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before.get(j - 2, big) + 1)
            row[j] = v
        if min(row.values()) > budget:
            return False
        before, last = last, row
    return last.get(len(b), big) <= budget


def segments(word: str, budget: int = BUDGET) -> list[tuple[int, int, str]]:
    """(number, position, text) of the budget + 1 segments of a word."""
    n, k = len(word), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(i, cuts[i], word[cuts[i] : cuts[i + 1]]) for i in range(k)]


def probes(word: str, budget: int = BUDGET) -> set[tuple[int, int, str]]:
    """(length of the other word, segment number, text) that a word within the budget would have as a segment. A swap
    over a segment's border harms two segments, so the border's two characters are also looked up swapped."""
    out = set()
    for n in range(max(1, len(word) - budget), len(word) + budget + 1):
        k = budget + 1
        cuts = [n * i // k for i in range(k + 1)]
        for i in range(k):
            size = cuts[i + 1] - cuts[i]
            for at in range(max(0, cuts[i] - budget), min(len(word) - size, cuts[i] + budget) + 1):
                out.add((n, i, word[at : at + size]))
    for c in (len(word) * i // (budget + 1) for i in range(1, budget + 1)):
        if 0 < c < len(word):
            swapped = word[: c - 1] + word[c] + word[c - 1] + word[c + 1 :]
            out |= {(len(word), i, s) for i, _, s in segments(swapped, budget)}
    return out


def index_rows(kind: str, words: list[str], initials: list[str], probe: bool, least: int = 5) -> list[str]:
    """Keys of the segment join: for each word long enough to be edited, the other words and a segment of the word.
    Names with an initial for the given name are indexed by it; names of two words look there by their initials too."""
    out = set()
    groups: list[tuple[str, str]] = []
    if kind == "group":
        groups.append((words[0], "g:" + words[1]))
    elif len(words) == 1:
        groups += [(words[0], "i:" + i) for i in initials[:1]]
    else:
        for i, w in enumerate(words):
            rest = words[:i] + words[i + 1 :]
            groups.append((w, "w:" + " ".join(rest)))
            if len(rest) == 1 and probe:  # only names whose given name is an initial are looked up by it
                groups.append((w, "i:" + rest[0][0]))
    for word, rest in groups:
        if len(word) < least and rest[:2] == "w:" and len(rest) >= 2 + least:
            out.add(f"{rest}|{word[0]}")  # edits of short words only where the initial stands
        if len(word) >= least - (probe or rest[:2] == "i:"):
            for n, i, s in probes(word) if probe else [(len(word), i, s) for i, _, s in segments(word)]:
                out.add(f"{rest}|{n}|{i}|{s}")
    return sorted(out)


def verified(kind_a: str, a: list[str], ia: list[str], kind_b: str, b: list[str], ib: list[str]) -> str | None:
    """'words' if two names differ by an edit of one word, 'initials' if one of them has its given name as an initial
    and the surname within an edit, else None."""
    if kind_a != kind_b:
        return None
    if kind_a == "group":
        return "words" if a[1] == b[1] and one_edit(a[0], b[0]) else None
    if len(a) == len(b) == 1:
        return "words" if max(len(a[0]), len(b[0])) >= 5 and ia[:1] == ib[:1] and (set(ia) <= set(ib) or set(ib) <= set(ia)) and one_edit(a[0], b[0]) else None
    if len(a) == len(b):
        left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return "words" if len(left) == len(right) == 1 and one_edit(left[0], right[0]) else None
    if len(a) == 1:
        a, ia, b, ib = b, ib, a, ia
    if len(b) == 1 and len(a) == 2 and ib:
        for given, surname in ((a[0], a[1]), (a[1], a[0])):
            if given[0] == ib[0] and max(len(surname), len(b[0])) >= 5 and one_edit(surname, b[0]) and (not ia or set(ib[1:]) <= set(ia)):
                return "initials"
    return None


#: A longer word has no short form (keys would grow with its square).
LONGEST_GIVEN = 40


#: Endings that short forms take.
ENDINGS = ("i", "y", "ie", "a", "k", "o", "e", "ey", "ka", "ek")


def short_forms(given: str, irregular: dict[str, list[str]] | None = None) -> set[str]:
    """Short forms a given name may have: its beginnings and parts of 3 to 6 letters, beginnings with a usual ending or
    with the last letter doubled before it, also with k for c and t for th, and those of ``irregular`` (whole -> short)."""
    if len(given) > LONGEST_GIVEN:
        return set()
    out = {given[i : i + n] for n in (3, 4, 5, 6) for i in range(len(given) - n + 1)} if len(given) > 4 else set()
    for form in {given, given.replace("th", "t"), given.replace("ch", "k"), given.replace("c", "k")}:
        out |= {form[:n] for n in (3, 4, 5, 6)} if len(given) > 4 else set()
        for n in (2, 3, 4, 5):
            if n <= len(form):
                out |= {form[:n] + e for e in ENDINGS if n + len(e) >= 3} | {form[:n] + form[n - 1] + e for e in ("y", "ie", "i", "o")}
    if given[2:3] == "c":
        out |= {given[:3] + "k", given[:2] + "k", given[:2] + "ke", given[:3] + "ky", given[:3] + "kie", given[:3] + "ki"}
    out |= set((irregular or {}).get(given, ()))
    out.discard(given)
    return {f for f in out if len(f) > 1}


def _keys(function, kind: str = "array<string>"):
    @F.pandas_udf(kind)
    def run(kinds: pd.Series, words: pd.Series, initials: pd.Series) -> pd.Series:
        return pd.Series([function(k, list(w), list(i)) for k, w, i in zip(kinds, words, initials)], dtype=object)

    return run


def parsed_nodes(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, node, kind, words, initials, others of each distinct string that is a name; node, kind, words, initials of
    each distinct set of words)."""
    distinct = strings.select("name").where("name IS NOT NULL").distinct()

    @F.pandas_udf("struct<kind:string,words:array<string>,initials:array<string>,others:array<string>>")
    def read(names: pd.Series) -> pd.DataFrame:
        rows = [read_name(n) or (None, [], [], []) for n in names]
        return pd.DataFrame(rows, columns=["kind", "words", "initials", "others"])

    parsed = distinct.select("name", read("name").alias("r")).where("r.kind IS NOT NULL")
    node = F.concat_ws("|", "r.kind", F.array_join("r.words", " "), F.when((F.size("r.words") < 2) & (F.col("r.kind") == "person"), F.array_join("r.initials", "")).otherwise(""))
    parsed = cut(parsed.select("name", node.alias("node"), "r.kind", "r.words", "r.initials", "r.others"))
    # nodes: distinct word sets; initials of all their spellings (letters only, so at most 26)
    nodes = parsed.groupBy("node").agg(F.first("kind").alias("kind"), F.first("words").alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("initials")))).alias("letters"), F.first("initials").alias("typed"))
    # a bare surname's initials in the order typed, the given name's first: its node holds one spelling of them
    nodes = nodes.select("node", "kind", "words", F.when(F.size("words") < 2, F.col("typed")).otherwise(F.col("letters")).alias("initials"))
    nodes = cut(spread(nodes))  # each gives some 50 keys
    return parsed, nodes


def segment_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: the nodes that meet in the inverted index of segments, each pair once. ``nodes``: node, kind, words, initials."""
    keys = lambda probe: F.explode(_keys(lambda k, w, i: index_rows(k, w, i, probe))("kind", "words", "initials")).alias("key")
    index, look = nodes.select("node", keys(False)), nodes.select(F.col("node").alias("other"), keys(True))
    return index.join(look, "key").where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def entities(strings: DataFrame, name: str = "name", nicknames: dict[str, frozenset[str]] = SHORT_FORMS) -> DataFrame:
    """name, entity: each distinct spelling with the entity it names. Spellings linked to no other are entities too.
    ``nicknames``: short forms with the given names they may stand for, beside those that follow by rule."""
    parsed, nodes = parsed_nodes(strings.select(F.col(name).alias("name")))

    # a surname in several words that others write as one, or initials that may be a group's
    glue = parsed.select("node", F.explode("others").alias("other")).distinct()
    links = glue.join(nodes.select(F.col("node").alias("other")), "other").select(F.col("node").alias("a"), F.col("other").alias("b"))

    hits = segment_pairs(nodes)
    left, right = (nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in nodes.columns]) for p in "ab")
    full = hits.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))

    @F.pandas_udf("string")
    def check(ka: pd.Series, wa: pd.Series, ia: pd.Series, kb: pd.Series, wb: pd.Series, ib: pd.Series) -> pd.Series:
        return pd.Series([verified(a, list(b), list(c), d, list(e), list(f)) for a, b, c, d, e, f in zip(ka, wa, ia, kb, wb, ib)], dtype=object)

    checked = cut(full.select("a", "b", check("a_kind", "a_words", "a_initials", "b_kind", "b_words", "b_initials").alias("how")).where("how IS NOT NULL"))
    links = links.unionByName(checked.where("how = 'words'").select("a", "b"))
    every = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    first = cut(components(links.unionByName(every)))

    # short forms and initials: candidates (node, whole node), attached where they lead to one component
    def initial_keys(kind, words, initials):
        return sorted({f"{words[1 - k]}|{words[k][0]}" for k in (0, 1)}) if kind == "person" and len(words) == 2 else []

    def bare_keys(kind, words, initials):
        return [f"{words[0]}|{initials[0]}"] if initials and kind == "person" and len(words) == 1 else []

    def attach(short, whole):
        small = nodes.select("node", F.col("initials").alias("own"), F.explode(_keys(short)("kind", "words", "initials")).alias("key"))
        large = nodes.select(F.col("node").alias("other"), "initials", F.explode(_keys(whole)("kind", "words", "initials")).alias("key"))
        return small.join(large, "key").where("node <> other")

    # the relation of short to whole given names is made once for the distinct names in use, then looked up
    pairs = F.array(F.struct(F.col("words")[0].alias("given"), F.col("words")[1].alias("surname")), F.struct(F.col("words")[1].alias("given"), F.col("words")[0].alias("surname")))
    given = nodes.where((F.col("kind") == "person") & (F.size("words") == 2)).select("node", F.explode(pairs).alias("p")).select("node", "p.given", "p.surname").distinct()
    shorts: dict[str, list[str]] = {}
    for short, wholes in nicknames.items():
        for whole in wholes:
            shorts.setdefault(whole, []).append(short)

    @F.pandas_udf("array<string>")
    def forms(names: pd.Series) -> pd.Series:
        return names.map(lambda g: sorted(short_forms(g, shorts)))

    used = cut(given.select("given").distinct())
    rel = spread(used).select(F.col("given").alias("whole"), F.explode(forms("given")).alias("given")).join(used, "given")
    rel = cut(rel.where(F.col("given") != F.col("whole")))
    whole = given.select(F.col("node").alias("other"), F.col("given").alias("whole"), "surname")
    nick = given.join(rel, "given").join(whole, ["whole", "surname"]).select("node", "other").where("node <> other").distinct()
    fits = (F.size("initials") == 0) | (F.size(F.array_except(F.slice("own", 2, 99), "initials")) == 0)
    rest = F.size("own") > 1
    rank = F.when(rest & (F.size("initials") > 0), 0).when(~rest, 1).otherwise(2)
    bare = attach(bare_keys, initial_keys).where(fits).select("node", "other", rank.alias("rank"))
    near = checked.where("how = 'initials'").select(F.expr("CASE WHEN a LIKE 'person|% %' THEN b ELSE a END").alias("node"), F.expr("CASE WHEN a LIKE 'person|% %' THEN a ELSE b END").alias("other"))
    bare = bare.unionByName(near.withColumn("rank", F.lit(3)))

    def single(candidates: DataFrame, at: DataFrame) -> DataFrame:
        """Links from a node's component to the one other component its best candidates lie in."""
        c = candidates.join(at.select("node", F.col("component").alias("own_c")), "node").join(at.select(F.col("node").alias("other"), F.col("component").alias("other_c")), "other").where("own_c <> other_c")
        best = c.groupBy("own_c").agg(F.min("rank").alias("rank"))
        one = c.join(best, ["own_c", "rank"]).groupBy("own_c").agg(F.min("other_c").alias("low"), F.max("other_c").alias("high")).where("low = high")
        return one.select(F.col("own_c").alias("a"), F.col("low").alias("b"))

    nicked = single(nick.withColumn("rank", F.lit(0)), first)
    second = cut(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(nicked)))
    barely = single(bare, second)
    third = components(second.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(barely))
    return parsed.join(third, "node").select("name", F.col("component").alias("entity"))


def spelling_pairs(found: DataFrame) -> DataFrame:
    """Two different spellings of one entity, smaller first (by UTF-8 bytes, which is by code point)."""
    a, b = found.select("entity", F.col("name").alias("name_a")), found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def bibliographic_names(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The distinct author strings of records (as stored) and of the manifest (split at ; and trimmed)."""
    typed = records.select(F.explode("authors").alias("name"))
    listed = manifest.select(F.explode(F.split("authors", ";")).alias("name")).select(F.regexp_replace("name", r"^\s+|\s+$", "").alias("name"))
    return typed.unionByName(listed).where("name IS NOT NULL AND trim(name) <> ''").distinct()
