"""Markup residue in text documents.

Residue of HTML, Markdown, wiki and LaTeX is recognised by its own syntax, taken off from the outside in, and turned
into plain text: a heading stands on a line of its own, list items begin with "- ", code and table rows keep their
lines, formulas keep their source without the delimiters. What is left of a text of many lines goes through the
line-block distribution: text lengths are summed over sliding windows of lines, the surge and dive points of the sums
bound the main text, and short lines outside (menus, footers) go, but no line of a heading, list, table or code.

Signs used in their own right are no residue: prices in dollars, comparisons, stars of significance, brackets that the
text speaks about, a number sign before a number.

Defined results: null stays null and has no kinds; an empty text stays empty; texts of any length are read whole; equal
texts give equal results; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Element names of HTML, and prefixes of the XML vocabularies used for abstracts.
BLOCKS = "p div br hr li ul ol dl dt dd table tr td th tbody thead h1 h2 h3 h4 h5 h6 blockquote pre section article header footer nav title sec".split()
INLINES = "a b i u s em strong span sup sub small big tt code font img abbr cite q mark del ins center label input button form script style sc scp italic bold underline html head body meta link inline-formula".split()
ATTRIBUTE = r"""\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+)"""
TAG = re.compile(rf"<(/?)((?:jats|mml|xhtml|ns\d):[\w-]+|(?:{'|'.join(sorted(BLOCKS + INLINES, key=len, reverse=True))}))((?:{ATTRIBUTE})*)\s*/?>", re.I)
DROPPED = re.compile(r"<(script|style|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

MATH = re.compile(r"(?<![\\\w$])\$\$?((?=[^$\n]*[\\^_{}=<>+])(?![\s\d])[^$\n]*?[^\s$]|[A-Za-z])\$\$?(?![\w$])|\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
COMMAND = re.compile(r"(?<![A-Za-z]:)\\(?:[A-Za-z]+\*?)(?![\\/])|\\[&%$#_{}~^'\"`=.,;!\\-]")
QUOTES = re.compile(r"``(?=\S)((?:(?!``|'').)+?)''", re.S)
BRACES = re.compile(r"(?<![\\{$\w^_])\{([^{}\\$|\n]+)\}(?!\})")
ABOUT_SIGNS = re.compile(r"\b(?:brackets?|braces?|curly|parenthes[ie]s)\b", re.I)
ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?")
DROP_WITH_ARGUMENT = re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|label|thanks|footnote|footnotetext|vspace|hspace|bibliography|index)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
HEADING_COMMAND = re.compile(r"[ \t]*\\(?:(?:sub)*section|chapter|paragraph|title)\*?\{([^{}]*)\}[ \t]*")
WITH_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])*\{([^{}]*)\}")
SWITCH = re.compile(r"\{\\(?:em|it|bf|tt|sc|sl|rm|sf|small|large|itshape|bfseries)\b\s*([^{}]*)\}")
#: Accent commands and the combining characters they stand for.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
ACCENT = re.compile(r"""\{?\\(?:(['`^"~=.])\s*\{?\\?([A-Za-z])\}?|([cvuHrk])(?:\{([A-Za-z])\}|\s+([A-Za-z])\b))\}?""")
#: Letters that have commands of their own.
LETTERS = {"o": "ø", "O": "Ø", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı"}
LETTER = re.compile(r"\{\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i)\}|\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L)(?![A-Za-z])\s?")

LINK = re.compile(r"\[\[(?:([^\[\]|]*)\|)?([^\[\]|]+)\]\]")
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
EMPHASIS = re.compile(r"(?<!')('{2,3}|'{5})(?=[^\s'])((?:(?!'').)+?)\1(?!')", re.S)
WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
WIKI_TABLE = re.compile(r"^\{\|.*$|^\|\}[ \t]*$|^\|-.*$", re.M)
REFERENCE = re.compile(r"<ref\b[^>]*>.*?</ref>|<ref\b[^>]*/>|<nowiki>|</nowiki>", re.S | re.I)
WIKI_LIST = re.compile(r"^[*#:;]+[ \t]*(?=\[\[)", re.M)

FENCE = re.compile(r"^[ \t]*(?:```|~~~)[\w+-]*[ \t]*\n?", re.M)
IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
ANCHOR = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:[a-z]+://|/|#|mailto:|\.)[^()\s]*(?:\s+\"[^\"]*\")?\)")
STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])((?:(?!\*\*).)+?)(?<=[^\s*])\*\*(?![\w*])|(?<!\w)__(?=[^\s_])((?:(?!__).)+?)(?<=[^\s_])__(?!\w)", re.S)
STRONGEST = re.compile(r"(?<![\w*])\*\*\*(?=[^\s*])((?:(?!\*\*).)+?)(?<=[^\s*])\*\*\*(?![\w*])", re.S)
LIGHT = re.compile(r"(?<![\w*])\*(?=[A-Za-z])([^*\n]+?)(?<=[\w.,;:!?)])\*(?![\w*])")
STRUCK = re.compile(r"~~(?=\S)(.+?)~~")
CODE = re.compile(r"(?<![`\w])`(?=[^\s`])([^`\n]*[^\s`])`(?![`\w])")
HASH_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)(.*?)[ \t]*#*[ \t]*$", re.M)
QUOTED = re.compile(r"^[ \t]{0,3}>[ \t]+(?=\S)", re.M)
RULED = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", re.M)
ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$", re.M)
ITEM = re.compile(r"^[ \t]*(?:[*+-]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)


def entities(text: str) -> tuple[str, bool]:
    seen = False

    def put(m: re.Match) -> str:
        nonlocal seen
        name = m.group()[1:]
        if name[0] != "#" and name not in html.entities.html5:
            return m.group()
        seen = True
        return html.unescape(m.group()).replace("\u00a0", " ")

    for _ in range(3):
        new = ENTITY.sub(put, text)
        if new == text:
            break
        text = new
    return text, seen


def from_html(text: str) -> tuple[str, bool]:
    """Tags to line breaks, bullets or nothing."""
    text, seen = entities(text)
    text, n = DROPPED.subn(" ", text)
    def put(m: re.Match) -> str:
        name = m.group(2).lower()
        short = name.split(":")[-1]
        if short == "li":
            return "\n" if m.group(1) else "\n- "
        if short in ("td", "th"):
            return " | " if m.group(1) else ""
        if re.fullmatch("h[1-6]|title", short) and not m.group(1):
            return "\n" + HEADING
        if short in BLOCKS:
            return "\n"
        return ""

    text, k = TAG.subn(put, text)
    return text, bool(seen or n or k)


def from_latex(text: str) -> tuple[str, bool]:
    import unicodedata

    seen = 0
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(next(g for g in m.groups() if g is not None).strip())
        return f"\x02{len(kept) - 1}\x03"

    text, n = MATH.subn(keep, text)
    seen += n
    text, n = QUOTES.subn(r"“\1”", text)
    seen += n
    if COMMAND.search(text):
        before = text
        text = DROP_WITH_ARGUMENT.sub("", text)
        text = ENVIRONMENT.sub("\n", text)
        text = HEADING_COMMAND.sub(rf"\n{HEADING}\1\n", text)
        text = ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m.group(2) or m.group(4) or m.group(5)) + ACCENTS[m.group(1) or m.group(3)]), text)
        text = LETTER.sub(lambda m: LETTERS[m.group(1) or m.group(2)], text)
        for _ in range(4):
            new = WITH_ARGUMENT.sub(r"\1", SWITCH.sub(r"\1", text))
            if new == text:
                break
            text = new
        text = re.sub(r"[ \t]*\\item\b[ \t]*", "\n- ", text)
        text = re.sub(r"\\\\(?:\[[^\]]*\])?|\\newline\b", "\n", text)
        text = re.sub(r"\\([&%$#_{}])", r"\1", text)
        text = re.sub(r"(?<![A-Za-z]:)\\[A-Za-z]+\*?[ \t]?", "", text)
        seen += text != before

    def unbrace(m: re.Match) -> str:
        nonlocal seen
        if ABOUT_SIGNS.search(m.group(1)):
            return m.group()
        seen += 1
        return m.group(1)

    text = BRACES.sub(unbrace, text)
    return re.sub(r"\x02(\d+)\x03", lambda m: kept[int(m.group(1))], text), bool(seen)


def from_wiki(text: str) -> tuple[str, bool]:
    before = text
    text = REFERENCE.sub("", text)
    for _ in range(3):
        text = TEMPLATE.sub("", text)
    text = WIKI_LIST.sub("- ", text)
    text = LINK.sub(lambda m: "" if re.match(r"(?:Category|File|Image):", m.group(1) or m.group(2)) else m.group(2), text)
    text = EMPHASIS.sub(r"\2", text)
    text = WIKI_HEADING.sub(rf"{HEADING}\2", text)
    if "{|" in text:
        text = re.sub(r"(?m)^[|!][ \t]*", "", WIKI_TABLE.sub("", text))
    return text, text != before


def from_markdown(text: str) -> tuple[str, bool]:
    before = text
    code: list[str] = []

    def fenced(m: re.Match) -> str:
        code.append(m.group(2))
        return f"\x02{len(code) - 1}\x03\n"

    text = re.sub(r"(?m)^[ \t]*(```|~~~)[^\n`]*\n(.*?)^[ \t]*\1[ \t]*$\n?", fenced, text, flags=re.S)
    text = FENCE.sub("", text)
    text = IMAGE.sub(r"\1", text)
    text = ANCHOR.sub(r"\1", text)
    text = CODE.sub(r"\1", text)
    text = STRONGEST.sub(r"\1", text)
    text = STRONG.sub(lambda m: m.group(1) or m.group(2), text)
    text = STRUCK.sub(r"\1", text)
    text = LIGHT.sub(r"\1", text)
    text = HASH_HEADING.sub(rf"{HEADING}\1", text)
    text = QUOTED.sub("", text)
    if RULED.search(text):
        text = ROW.sub(lambda m: m.group(1).strip(), RULED.sub("", text))
    changed = text != before
    if changed:
        text = ITEM.sub(lambda m: m.group() if m.group().strip()[0].isdigit() else "- ", text)
    return re.sub(r"\x02(\d+)\x03", lambda m: code[int(m.group(1))], text), changed


#: Marks a heading's line until the end, and how many loose lines make a menu or a footer.
#: Lines of a list, a table or code, and lines that end a sentence or hold a number: kept wherever they stand.
HEADING, LOOSE = "\x04", 2
STRUCTURAL = re.compile(rf"^{HEADING}|^\s*(?:- |\d+[.)] )|\|| {{4}}|\d|[.!?;:]\s*$")


def main_text(text: str, window: int = 3, least_lines: int = 12) -> str:
    """Line-block distribution over the lines of a stripped page: a surge is a window of lines whose length passes half
    the mean of all windows, a dive one that falls to a sixth of it. Short lines before the first surge and behind the
    last dive go where there are LOOSE of them on a side (one alone may be a word of a wrapped line); between them
    everything stays, and so do headings (lines that begin with HEADING) anywhere."""
    lines = text.split("\n")
    if len(lines) < least_lines:
        return text
    sizes = [len(re.sub(r"\s+", "", line)) for line in lines]
    sums = [sum(sizes[i : i + window]) for i in range(len(lines))]
    surge = max(80, sum(sums) / len(sums) / 2)
    first = next((i for i, n in enumerate(sums) if n >= surge), None)
    if first is None:
        return text
    last = max(i for i, n in enumerate(sums) if n >= surge)
    last = max(k for k in range(last, min(len(lines), last + window)) if sizes[k] >= surge / 3 or k == last)
    while last + 1 < len(lines) and sums[last + 1] >= surge / 3:
        last += 1
    stays = lambda k: bool(STRUCTURAL.search(lines[k])) or sizes[k] >= surge
    kept = set(range(first, last + 1))
    for side in (range(first), range(last + 1, len(lines))):
        loose = [k for k in side if not stays(k) and any(map(str.isalpha, lines[k]))]
        kept |= {k for k in side if stays(k) or len(loose) < LOOSE}
    return "\n".join(line for k, line in enumerate(lines) if k in kept)


def strip_markup(text: str | None) -> tuple[str | None, list[str]]:
    """(plain text, kinds of residue found)."""
    if not text:
        return text, []
    kinds = []
    plain = text
    for kind, step in (("latex", from_latex), ("wiki", from_wiki), ("markdown", from_markdown)):
        new, seen = step(plain)
        if seen:
            kinds.append(kind)
            plain = new
    escaped, _ = entities(plain)
    plain, seen = from_html(plain)
    if seen:
        kinds.append("html")
        if escaped != plain:  # what stood behind character entities or tags may be residue of its own
            for kind, step in (("latex", from_latex), ("wiki", from_wiki), ("markdown", from_markdown)):
                new, seen = step(plain)
                if seen and kind not in kinds:
                    kinds.append(kind)
                plain = new
    if not kinds:
        return text, []
    plain = main_text(plain).replace(HEADING, "")
    plain = re.sub(r"[ \t\u00a0]+\n", "\n", re.sub(r"[^\S\n]{2,}", " ", plain))
    return re.sub(r"\n{3,}", "\n\n", plain).strip(), [k for k in KINDS if k in kinds]


SIGNS = r"(?m)[<&\\$\[{`*_|~]|''|==|^[ \t]{0,3}[#>]"


def clean(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field_name, text_clean and kinds of the fields that hold residue. Texts without a sign that any markup
    needs don't go to Python."""

    @F.pandas_udf("struct<text_clean:string,kinds:array<string>>")
    def run(texts):
        import pandas as pd

        done = [strip_markup(t) for t in texts]
        return pd.DataFrame({"text_clean": [d[0] for d in done], "kinds": [d[1] for d in done]})

    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("t")) for c in columns])
    fields = records.select(F.col(key), F.explode(F.filter(pairs, lambda p: p["t"].rlike(SIGNS))).alias("f"))
    done = fields.select(key, F.col("f.field_name").alias("field_name"), run(F.col("f.t")).alias("r"))
    return done.select(key, "field_name", "r.text_clean", "r.kinds").where(F.size("kinds") > 0)
