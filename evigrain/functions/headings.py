"""Section headings: normalisation, labels with the rule that gave them, numbering, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evigrain.functions.text import collapse_space, let, text_of

#: Headings with a label of their own.
EXACT = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "background", "related work": "background",
    "literature review": "background", "theoretical background": "background", "theory": "background", "methods": "methods", "method": "methods",
    "methodology": "methods", "materials and methods": "methods", "research methodology": "methods", "research method": "methods", "research design": "methods",
    "results": "results", "findings": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion",
    "references": "references", "bibliography": "references", "appendix": "appendix",
}
#: Parts of headings and their labels; the first that a heading contains decides.
CONTAINS = (
    *((p, "results") for p in ("analysis of results", "results and discussion", "empirical results", "descriptive statistics", "hypothesis testing", "hypotheses testing", "structural model", "model fit", "path coefficient")),
    *((p, "methods") for p in (
        "data collection", "data gathering", "data analysis", "analytical approach", "analysis strategy", "sample and", "sampling", "sample", "participant", "respondent", "procedure", "protocol",
        "experimental setup", "experimental design", "study design", "research design", "research context", "research approach", "research setting",
        "measurement model", "measurement", "instrument", "questionnaire", "survey design", "scale development", "construct", "operationalis", "operationaliz", "reliability", "validity",
        "common method bias", "method bias", "manipulation check", "pilot study", "pre-test", "pretest",
        "partial least squares", "structural equation", "pls-sem", "regression", "factor analysis", "statistical", "estimation", "simulation setup", "implementation", "algorithm", "dataset", "corpus",
        "evaluation metric", "evaluation protocol", "experiment", "materials", "method",
    )),
    *((p, "background") for p in (
        "literature", "related work", "prior research", "theoretical", "theory", "conceptual framework", "research model", "hypothesis development", "hypotheses development", "hypothes", "propositions", "research question",
    )),
    *((p, "results") for p in ("result", "finding", "evaluation", "performance")),
    *((p, "discussion") for p in ("theoretical implication", "practical implication", "managerial implication", "implication", "limitation", "future research", "future work", "discussion")),
    ("concluding", "conclusion"), ("conclusion", "conclusion"),
    ("abstract", "abstract"), ("introduction", "introduction"), ("motivation", "introduction"), ("overview", "introduction"), ("reference", "references"), ("bibliograph", "references"), ("appendix", "appendix"),
    *((p, "other") for p in ("acknowledg", "funding", "declaration", "conflict of interest", "author contribution")),
)
#: Fixed value: numbering before a heading ("3", "3.1.", "IV.", "A)", "(2)").
NUMBERING = r"^\s*[(\[]?\s*(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z])\s*[.)\]:]?\s+"


def normalise_heading(c: Column | str) -> Column:
    """Lower case, numbering (digits, roman or a letter) taken off up to three times, closing punctuation off."""
    h = F.lower(collapse_space(text_of(c)))
    for _ in range(3):
        h = F.regexp_replace(h, NUMBERING, "")
    return F.trim(F.regexp_replace(h, r"[\s.:;,\-–—]+$", ""))


def classify(normal: Column) -> Column:
    """struct(label, rule) of a normalised heading."""
    def pair(label: str, rule: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule"))

    out = F.when(normal == "", pair("other", "empty"))
    for heading, label in EXACT.items():
        out = out.when(normal == heading, pair(label, "exact"))
    for part, label in CONTAINS:
        out = out.when(F.contains(normal, F.lit(part)), pair(label, f"contains:{part}"))
    return out.otherwise(pair("other", "unmatched"))


def number_of(c: Column | str) -> Column:
    """The section number as an array: '3.1.2 X' gives [3, 1, 2], none gives []."""
    digits = F.regexp_extract(text_of(c), r"^\s*[(\[]?\s*(\d+(?:\.\d+)*)", 1)
    return F.when(digits == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(digits, r"\."), lambda d: F.try_to_number(d, F.lit("9999999999")).cast("int")))


def resolve(sections: Column) -> Column:
    """Sections (struct heading, body) with their resolved labels, as an array of struct(heading, body, normal, label,
    rule). A heading no rule matches takes the label of the nearest earlier heading with its parent's number, else of
    the nearest earlier classified one; a resolved label passes on. One fold over the record's own sections."""
    seen = F.transform(sections, lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body"), normalise_heading(s["heading"]).alias("normal"), number_of(s["heading"]).alias("number")))
    def judge(s: Column) -> Column:
        return let(classify(s["normal"]), lambda c: F.struct(s["heading"].alias("heading"), s["body"].alias("body"), s["normal"].alias("normal"), s["number"].alias("number"), c["label"].alias("label"), c["rule"].alias("rule")))

    judged = F.transform(seen, judge)
    empty = F.expr("CAST(array() AS array<struct<heading:string,body:string,normal:string,number:array<int>,label:string,rule:string>>)")

    def step(acc: Column, s: Column) -> Column:
        parent = F.slice(s["number"], F.lit(1), F.greatest(F.size(s["number"]) - 1, F.lit(0)))
        under = F.try_element_at(F.filter(acc, lambda e: (e["number"] == parent) & (e["label"] != "other")), F.lit(-1))
        before = F.try_element_at(F.filter(acc, lambda e: ~e["label"].isin("other", "references", "appendix")), F.lit(-1))
        by_number = (s["rule"] == "unmatched") & (F.size(s["number"]) > 1) & under.isNotNull()
        by_place = (s["rule"] == "unmatched") & before.isNotNull()
        label = F.when(by_number, under["label"]).when(by_place, before["label"]).otherwise(s["label"])
        rule = F.when(by_number, F.concat(F.lit("inherited:"), F.array_join(F.transform(parent, lambda n: n.cast("string")), "."))).when(by_place, F.lit("inherited:previous")).otherwise(s["rule"])
        return F.concat(acc, F.array(F.struct(s["heading"].alias("heading"), s["body"].alias("body"), s["normal"].alias("normal"), s["number"].alias("number"), label.alias("label"), rule.alias("rule"))))

    return F.when(sections.isNull(), empty).otherwise(F.aggregate(judged, empty, step))


def section_rows(records: DataFrame, key: str = "record_id") -> DataFrame:
    """key, section_no, heading, body, normal, label, rule: the sections of each record with resolved labels."""
    return records.where(F.size("sections") > 0).select(key, F.posexplode(resolve(F.col("sections"))).alias("section_no", "s")).select(key, "section_no", "s.heading", "s.body", "s.normal", "s.label", "s.rule")


def section_report(rows: DataFrame, most: int = 50) -> DataFrame:
    """kind, name, n, share: label counts, rule families, the most frequent headings that fell through (a top-k report),
    and all headings, with those of no label as their share."""
    labels = rows.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rules = rows.groupBy(F.lit("rule").alias("kind"), F.split("rule", ":")[0].alias("name")).agg(F.count(F.lit(1)).alias("n"))
    missed = rows.where("rule = 'unmatched'").groupBy(F.lit("unmatched").alias("kind"), F.col("normal").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
    every = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "other").alias("o")).where("n > 0")
    counted = labels.unionByName(rules).unionByName(missed).withColumn("share", F.lit(None).cast("double"))
    return counted.unionByName(every.select(F.lit("headings").alias("kind"), F.lit("unmatched_fraction").alias("name"), "n", (F.col("o") / F.col("n")).alias("share")))
