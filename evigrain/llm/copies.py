"""Duplicates hidden by formatting differences.

Three steps: rows that are byte-identical in the compared fields collapse to one with a count (a hash aggregate with
map-side combine, so a group holding a third of all rows reaches the shuffle as one row a task); only the distinct
survivors are canonicalised; survivors are grouped again on their whole canonical text and the counts summed.

Defined results: null and empty fields agree with each other only; a null author list, an empty one and one of empty
names are the same; author order does not matter; a null key is no row to point at and counts as a copy only; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evigrain.operators.skew import salted_join
from evigrain.session import cut

FIELDS = ("title", "abstract", "doi", "pub_year", "authors", "venue")
RESOLVER = re.compile(r"^\s*(?:(?:https?://)?(?:dx\.)?doi\.org/|doi:\s*)+", re.I)
SEP = "\x1f"


def fold(text: str | None) -> str:
    """Letters and digits only, NFKC, without case."""
    if not text:
        return ""
    if text.isascii():
        return "".join(filter(str.isalnum, text)).lower()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(filter(str.isalnum, text))


def canonical(title, abstract, doi, year, authors, venue) -> str:
    """The text two rows share exactly when they differ only in form."""
    names = [] if authors is None else sorted(filter(None, map(fold, authors)))
    doi = RESOLVER.sub("", unicodedata.normalize("NFKC", doi)) if doi else ""
    return SEP.join((fold(title), fold(abstract), fold(doi), "" if year is None or year != year else str(int(year)), "\x1e".join(names), fold(venue)))


def _canonical_column(*columns):
    @F.pandas_udf("string")
    def run(title: pd.Series, abstract: pd.Series, doi: pd.Series, year: pd.Series, authors: pd.Series, venue: pd.Series) -> pd.Series:
        return pd.Series([canonical(*row) for row in zip(title, abstract, doi, year, authors, venue)], dtype=object)

    return run(*columns)


def collapse(records: DataFrame, key: str = "record_key") -> tuple[DataFrame, DataFrame]:
    """(classes, members). classes: class_id, the smallest key, n_copies (all rows of the class) and n_forms (distinct
    raw forms). members: key, class_id, first_key, one row per input row of a class of two or more with a key."""
    raw = F.substring(F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256), 1, 32)
    forms = records.groupBy(*[F.col(c) for c in FIELDS]).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    survivors = forms.select(raw.alias("raw_id"), _canonical_column(*[F.col(c) for c in FIELDS]).alias("canon"), "n", "first_key")
    survivors = cut(survivors.select("raw_id", "n", "first_key", "canon"))
    whole = survivors.groupBy("canon").agg(F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_forms"), F.min("first_key").alias("first_key"))
    classes = whole.select(F.sha2("canon", 256).alias("class_id"), "first_key", "n_copies", "n_forms")
    several = classes.where("n_copies > 1").select("class_id", "first_key", F.col("n_forms").alias("_w"))
    form_class = salted_join(survivors.select("raw_id", "n", F.sha2("canon", 256).alias("class_id")), several, ["class_id"], "_w")
    rows = records.select(F.col(key), raw.alias("raw_id")).where(F.col(key).isNotNull())
    members = salted_join(rows, form_class.withColumnRenamed("n", "_w"), ["raw_id"], "_w").select(key, "class_id", "first_key")
    return classes, members


def copy_pairs(records: DataFrame, key: str = "record_key") -> DataFrame:
    """Each copy beside the smallest key of its class."""
    _, members = collapse(records, key)
    return members.where(F.col(key) != F.col("first_key")).select(F.col("first_key").alias(f"{key}_a"), F.col(key).alias(f"{key}_b")).distinct()


def import_comparison(records: DataFrame, reports: DataFrame) -> DataFrame:
    """Copies found per import (rows that are not the first of their class) against what the importer reported."""
    pairs = copy_pairs(records)
    copies = pairs.select(F.col("record_key_b").alias("record_key")).distinct().join(records.select("record_key", "import_id"), "record_key")
    counted = copies.groupBy("import_id").agg(F.count(F.lit(1)).alias("copies_found"))
    reports = reports.select("import_id", "duplicates_removed", "records_built")
    return reports.join(counted, "import_id", "left").select(
        "import_id", "records_built", "duplicates_removed", F.coalesce("copies_found", F.lit(0).cast("long")).alias("copies_found"),
        (F.coalesce("copies_found", F.lit(0)) - F.col("duplicates_removed")).alias("difference"),
    )
