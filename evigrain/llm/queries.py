"""The pN_ queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrain.session import table


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import pieces

    return pieces.split_items(pieces.bibliographic_items(table(spark, root, "records"), table(spark, root, "chunks")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_pieces(spark, root).where("piece_no = 0").select("item_kind", "item_key", "item_no", "cut_kind")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import copies

    return copies.copy_pairs(table(spark, root, "records"))


def p3_copies(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import copies

    return copies.collapse(table(spark, root, "records"))[0]


def p3_imports(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import copies

    return copies.import_comparison(table(spark, root, "records"), table(spark, root, "import_reports"))


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import leaks

    return leaks.leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm.leaks import LEAST

    return p7_leaks(spark, root).where(F.col("longest_run") >= LEAST).select("doc_id", "item_id").distinct()


def p8_plan(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import mixing

    return mixing.plan_mixture(mixing.source_tokens(table(spark, root, "documents")), table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_plan(spark, root).where("starved").select("source")


def p8_draw(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import mixing

    return mixing.draw(table(spark, root, "documents"), p8_plan(spark, root))


def p8_reached(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import mixing

    plan = p8_plan(spark, root)
    return mixing.reached(mixing.draw(table(spark, root, "documents"), plan), plan)


def p8_tempered(spark: SparkSession, root: str) -> DataFrame:
    """The shares reached when the tempered weights are drawn, with the entropy of the targets and their repeat limits."""
    from evigrain.llm import mixing

    docs = table(spark, root, "documents")
    plan = mixing.tempered_mixture(mixing.source_tokens(docs), table(spark, root, "mix_targets"))
    return mixing.reached(mixing.draw(docs, plan), plan)


def p9_repaired(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import encodings

    return encodings.repair(table(spark, root, "documents").select("doc_id", "text")).where("affected").select("doc_id", "text_repaired", "restored", F.size("spans").alias("n_spans"), F.array_join(F.array_sort(F.array_distinct("spans.pair")), "; ").alias("pairs"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_repaired(spark, root).select("doc_id")


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import markup

    return markup.clean(table(spark, root, "records"), "record_key", ("title", "abstract"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_clean(spark, root).where("record_key IS NOT NULL").select("record_key", "field_name", F.explode("kinds").alias("markup_kind")).distinct()


def p5_repaired(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import scans

    return scans.repair(table(spark, root, "records"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_repaired(spark, root).select("record_key", "field_name", F.explode("noise_kinds").alias("noise_kind")).distinct()


def p2_entities(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import names

    return names.entities(names.bibliographic_names(table(spark, root, "records"), table(spark, root, "corpus_manifest")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import names

    return names.spelling_pairs(p2_entities(spark, root))


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import neighbours

    return neighbours.nearest(table(spark, root, "chunk_vectors")).select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "cosine", "rank_no")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    from evigrain.llm import neighbours

    return neighbours.similar_pairs(neighbours.nearest(table(spark, root, "chunk_vectors")))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_copies, p3_imports, p7_found, p7_leaks, p8_found, p8_draw, p8_reached, p8_tempered, p9_found, p9_repaired, p6_found, p6_clean, p5_found, p5_repaired, p2_found, p2_entities, p4_found, p4_neighbours)}
_WORDS = "regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT {id}, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {id}, " + _WORDS + " AS w FROM {t}) WHERE len(w) >= 12)"
_SHORT = "et al\\.|e\\.g\\.|i\\.e\\.|cf\\.|vs\\.|Fig\\.|Eq\\.|No\\.|Dr\\.|approx\\."
#: A mark after the white space of each natural boundary; abbreviations' full stops are hidden from the search first.
_HIDE = f"regexp_replace({{x}}, '(^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])({_SHORT})(\\s)', '\\1\\2' || chr(29) || '\\3', 'g')"
_HIDDEN = _HIDE.format(x=_HIDE.format(x="text"))  # twice, as two abbreviations may share the space between them
_MARKED = "regexp_replace(regexp_replace(" + _HIDDEN + """, '([.!?])(\\s+)([A-Z0-9(\\["“''])', '\\1\\2' || chr(30) || '\\3', 'g'), '(\\n[ \\t\\r\\f]*\\n\\s*)', '\\1' || chr(30), 'g')"""


def _compatible(x: str) -> str:
    """SQL for compatibility forms (NFKC) of the blocks that bibliographic text uses: Latin with its supplements, general
    punctuation, letterlike signs, ligatures and full-width forms. The tables follow from the character database."""
    singles, longer = {}, {}
    for low, high in ((0xA0, 0x250), (0x2000, 0x2190), (0xFB00, 0xFB07), (0xFF00, 0xFFEF)):
        for c in map(chr, range(low, high)):
            form = unicodedata.normalize("NFKC", c)
            if form != c:
                (singles if len(form) == 1 else longer)[c] = form
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    x = f"translate({x}, {quote(''.join(singles))}, {quote(''.join(singles.values()))})"
    for c, form in longer.items():
        if any(map(str.isalnum, form)):  # the others are taken off anyway
            x = f"replace({x}, {quote(c)}, {quote(form)})"
    return f"nfc_normalize({x})"


def _folded(x: str) -> str:
    return f"replace(regexp_replace(lower({_compatible(f'coalesce({x}, {chr(39) * 2})')}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'ß', 'ss')"


_CLASSES = f"""CREATE_FORMS AS (SELECT title, abstract, doi, pub_year, authors, venue, count(*) AS n, min(record_key) AS first_key FROM records GROUP BY ALL),
  f AS (SELECT *, {_folded('title')} || chr(31) || {_folded('abstract')} || chr(31) || {_folded("regexp_replace(doi, '^(?i)\\s*((https?://)?(dx\\.)?doi\\.org/|doi:\\s*)+', '')")} || chr(31) || coalesce(pub_year::VARCHAR, '') || chr(31)
    || array_to_string(list_sort(list_filter(list_transform(coalesce(authors, []), lambda a: {_folded('a')}), lambda a: a <> '')), chr(30)) || chr(31) || {_folded('venue')} AS canon FROM forms),
  c AS (SELECT canon, sum(n)::BIGINT AS n_copies, count(*) AS n_forms, min(first_key) AS first_key FROM f GROUP BY 1),
  pairs AS (SELECT DISTINCT c.first_key AS record_key_a, r.record_key AS record_key_b FROM records r JOIN f ON r.title IS NOT DISTINCT FROM f.title AND r.abstract IS NOT DISTINCT FROM f.abstract AND r.doi IS NOT DISTINCT FROM f.doi AND r.pub_year IS NOT DISTINCT FROM f.pub_year
    AND r.authors IS NOT DISTINCT FROM f.authors AND r.venue IS NOT DISTINCT FROM f.venue JOIN c USING (canon) WHERE r.record_key <> c.first_key)""".replace("CREATE_FORMS", "forms")
SQL: dict[str, str] = {
    "p3_found": f"WITH {_CLASSES} SELECT * FROM pairs",
    "p3_copies": f"WITH {_CLASSES} SELECT sha256(canon) AS class_id, first_key, n_copies, n_forms FROM c",
    "p3_imports": f"WITH {_CLASSES}, k AS (SELECT import_id, count(*) AS n FROM (SELECT DISTINCT record_key_b AS record_key FROM pairs) JOIN records USING (record_key) GROUP BY 1) SELECT import_id, records_built, duplicates_removed, coalesce(n, 0) AS copies_found, coalesce(n, 0) - duplicates_removed AS difference FROM import_reports LEFT JOIN k USING (import_id)",
    "p4_found": """WITH w AS (SELECT chunk_id, list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x)) AS e FROM chunk_vectors), v AS (SELECT chunk_id, e FROM w WHERE len(e) = 64 AND list_dot_product(e, e) > 0), u AS (SELECT chunk_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
      r AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round_even(list_dot_product(a.u, b.u), 9) AS s FROM u a JOIN u b ON a.chunk_id <> b.chunk_id QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY s DESC, b.chunk_id) <= 10)
      SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE s >= 0.9""",
    "p1_found": f"""WITH i AS (SELECT 'full_text' AS item_kind, record_key::VARCHAR AS item_key, 0 AS item_no, full_text AS text FROM records UNION ALL SELECT 'section', record_key::VARCHAR, unnest(range(len(sections)))::INT, unnest(sections).body FROM records UNION ALL SELECT 'chunk', chunk_id, 0, text FROM chunks)
      SELECT item_kind, item_key, item_no, CASE WHEN list_max(list_transform(string_split({_MARKED}, chr(30)), lambda p: length(replace(p, chr(29), '')))) > 2000 THEN 'forced' ELSE 'natural' END AS cut_kind FROM i WHERE length(text) > 2000""",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(id='doc_id', t='documents')}) JOIN ({_GRAMS.format(id='item_id', t='eval_items')}) USING (g)",
}
