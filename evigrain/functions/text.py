"""Column functions over text: normalisation, identifiers, tokens, sentences, claims."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space as the canonical text sees it: Unicode's, and the four ASCII separators.
SPACE = r"[\s\x0b\x1c-\x1f\x85   -     　]"

#: Tokens whose full stop doesn't end a sentence.
ABBREVIATIONS = (
    "et", "al", "e.g", "i.e", "cf", "vs", "etc", "fig", "figs", "tab", "tabs", "eq", "eqs", "no", "nos", "vol", "pp", "ref", "refs",
    "approx", "resp", "dr", "prof", "mr", "mrs", "ms", "st", "ca", "ch", "sec", "min", "max", "jr", "sr", "inc", "ltd",
)
#: Words that hedge a claim, and words that carry no content.
HEDGES = ("may", "might", "could", "possibly", "perhaps", "suggest", "suggests", "appear", "appears", "seem", "seems")
STOPWORDS = (
    "a", "an", "the", "of", "and", "or", "to", "in", "on", "for", "with", "by", "from", "as", "at", "is", "are", "was", "were", "be", "been", "being",
    "this", "that", "these", "those", "it", "its", "we", "our", "their", "there", "here", "than", "then", "so", "such", "but", "not", "no",
    "can", "will", "would", "should", "have", "has", "had", "do", "does", "did", "between", "within", "about", "into", "over",
)
#: LaTeX escapes and what they stand for, in the order they are replaced.
LATEX = ((r"\&", "&"), (r"\%", "%"), (r"\_", "_"), (r"\$", "$"), (r"\#", "#"), ("``", '"'), ("''", '"'), ("--", "-"), ("~", " "))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; an expression that a lambda captures is computed at each call."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def normalise(c: Column | str, nfkc: bool = True) -> Column:
    """NFKC, no soft hyphens, white space collapsed and trimmed; null becomes ''. Only texts with characters outside
    ASCII go to Python."""
    c = text_of(c)
    if nfkc:
        odd = c.rlike(r"[^\x00-\x7F]")
        c = F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)
    return collapse_space(F.regexp_replace(c, "­", ""))


def normalise_doi(c: Column | str) -> Column:
    """Resolver or 'doi:' prefix off, lower case, trailing full stops off; null becomes ''."""
    bare = F.regexp_replace(F.trim(text_of(c)), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(F.lower(F.trim(bare)), r"\.+$", "")


def title_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]", "")


def dedup_key(doi: Column, title: Column, year: Column) -> Column:
    """doi:<doi>, else ty:<letters and digits of the title>:<year or nothing>."""
    d = normalise_doi(doi)
    y = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit("")).otherwise(year.cast("string"))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("ty:"), title_key(title), F.lit(":"), y))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column | str) -> Column:
    """Space-separated words; none for a blank text."""
    return F.filter(F.split(collapse_space(text_of(c)), " "), lambda w: w != "")


def ends_with_abbreviation(fragment: Column) -> Column:
    last = F.regexp_replace(F.lower(F.regexp_extract(F.trim(fragment), r"([A-Za-z.]+)\.$", 1)), r"^\.+|\.+$", "")
    return (last != "") & last.isin(list(ABBREVIATIONS))


#: Stands for the white space after an abbreviation while a text is split; no character of its own.
HELD = "\ufdd0"


def sentences(c: Column | str) -> Column:
    """Sentences of a text: cut after . ! ? before what may begin a sentence, but not after an abbreviation. The white
    space after abbreviations is hidden first, so one split does it, however long the text."""
    opens = r"""(?=[A-Z0-9(\[“"'])"""
    short = "|".join(w.replace(".", r"\.") for w in ABBREVIATIONS)
    hidden = F.regexp_replace(text_of(c), rf"(?<![A-Za-z.])(\.*(?i:{short})\.+)\s+{opens}", f"$1{HELD}")
    parts = F.split(hidden, rf"(?<=[.!?])\s+{opens}")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(HELD), F.lit(" ")))), lambda s: s != "")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_of(c), F.lit(f"[^{SPACE[1:-1]}]+"))


def hedged(c: Column) -> Column:
    return c.rlike(r"(?i)\b(" + "|".join(HEDGES) + r")\b")


def content_words(c: Column | str) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in STOPWORDS]))


def parse_year(c: Column) -> Column:
    """The four digits among the first four characters, else null."""
    digits = F.regexp_replace(F.substring(text_of(c.cast("string")), 1, 4), "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits.cast("int"))


def split_people(c: Column) -> Column:
    """Names split at ';' if there is one, else at ','; blanks dropped."""
    c = text_of(c)
    return F.filter(F.transform(F.split(c, F.when(F.contains(c, F.lit(";")), F.lit(";")).otherwise(F.lit(","))), lambda x: F.trim(x)), lambda x: x != "")


#: What stands where an export has no abstract.
NO_ABSTRACT = ("[no abstract available]", "no abstract available")


def blank_placeholder(c: Column) -> Column:
    """A 'no abstract' placeholder as ''."""
    return F.when(F.lower(F.trim(text_of(c))).isin(*NO_ABSTRACT), F.lit("")).otherwise(text_of(c))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(text_of(c)), F.lit("")) for c in columns], F.lit(""))


def clean_latex(c: Column) -> Column:
    c = text_of(c)
    for escape, plain in LATEX:
        c = F.replace(c, F.lit(escape), F.lit(plain))
    return collapse_space(F.regexp_replace(c, r"[{}]", ""))


def snippet(c: Column, most: int = 240) -> Column:
    """At most ``most`` characters, cut at a word and marked with ' ...'."""
    c = text_of(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r"\s+\S*$", ""), F.lit(" ...")))


def guess_title(text: Column, most_words: int = 30) -> Column:
    """The first line of 3 to ``most_words`` words that isn't front matter."""
    line = F.filter(
        F.transform(F.split(text_of(text), "\n"), collapse_space),
        lambda s: F.size(F.split(s, " ")).between(3, most_words) & ~F.lower(s).rlike(r"^(abstract|keywords|doi|http|downloaded|page )"),
    )
    return F.coalesce(F.try_element_at(line, F.lit(1)), F.lit(""))
