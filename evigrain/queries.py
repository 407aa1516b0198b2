"""The core queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from evigrain.functions import headings as H, text as T, vectors as V
from evigrain.operators import chunking, metrics, records as R, search
from evigrain.plans import experiment, retrieval
from evigrain.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- SQL parts
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The fixed word lists once more, so that the SQL doesn't rest on the library's own.
SQL_ABBREVIATIONS = "et al e.g i.e cf vs etc fig figs tab tabs eq eqs no nos vol pp ref refs approx resp dr prof mr mrs ms st ca ch sec min max jr sr inc ltd".split()
SQL_HEDGES = "may might could possibly perhaps suggests? appears? seems?".split()
SQL_STOPWORDS = (
    "a an the of and or to in on for with by from as at is are was were be been being this that these those it its we our their there here than then so such but not no "
    "can will would should have has had do does did between within about into over"
).split()
quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
collapse = lambda x: f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"
DOI_SQL = r"regexp_replace(lower(trim(regexp_replace(trim(coalesce(doi, '')), '(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)', ''))), '\.+$', '')"
TITLE_SQL = "regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g')"
TOKENS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
WORDS = lambda x: f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"
MARK = r"""regexp_replace({x}, '([.!?])\s+([A-Z0-9(\["“''])', '\1' || chr(30) || '\2', 'g')"""
ABBREVIATED = rf"regexp_replace(regexp_replace(lower(regexp_extract(trim({{x}}), '([A-Za-z.]+)\.$', 1)), '^\.+', ''), '\.+$', '') IN ({quoted(SQL_ABBREVIATIONS)})"


def sentences_sql(x: str) -> str:
    parts = f"list_transform(list_filter(string_split({MARK.format(x=x)}, chr(30)), lambda p: trim(p) <> ''), lambda p: [p])"
    fold = f"CASE WHEN {ABBREVIATED.format(x='a[-1]')} THEN list_concat(a[1:len(a) - 1], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END"
    return f"(CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_filter(list_transform(list_reduce({parts}, lambda a, b: {fold}), lambda s: trim(s)), lambda s: s <> '') END)"


def chunk_sql(base: str, pieces: str, spec: str) -> str:
    """base: a query with record_id and text; pieces: an expression giving a list of texts."""
    return f"""WITH b AS ({base}), p AS (SELECT record_id, {pieces} AS ps FROM b),
      f AS (SELECT record_id, unnest(range(len(ps)))::INT AS ordinal, unnest(list_transform(ps, lambda t: {collapse('t')})) AS text FROM p)
      SELECT substr(sha256(concat_ws('|', record_id, '{spec}', ordinal::VARCHAR, text)), 1, 20) AS chunk_id, record_id, ordinal, text FROM f WHERE text <> ''"""


DOCS_SQL = "SELECT doc_id::VARCHAR AS record_id, text FROM documents"


def documents_as_records(spark: SparkSession, root: str) -> DataFrame:
    none = F.lit("")
    return table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), none.alias("title"), none.alias("abstract"), F.coalesce("text", none).alias("full_text"), F.expr("CAST(array() AS array<struct<heading:string,body:string>>)").alias("sections")
    )


def chunked(spark: SparkSession, root: str, name: str, **params) -> DataFrame:
    return chunking.chunk(documents_as_records(spark, root), name, spans=False, **params).select("chunk_id", "record_id", "ordinal", "text")


def canonical_records(spark: SparkSession, root: str, nfkc: bool = True) -> DataFrame:
    return R.canonical(table(spark, root, "records").withColumnRenamed("pub_year", "year"), nfkc=nfkc)


# ---------------------------------------------------------------- records
@query(f"SELECT record_key, {DOI_SQL} AS doi_norm FROM records")
def normalise_doi(spark, root):
    return table(spark, root, "records").select("record_key", T.normalise_doi("doi").alias("doi_norm"))


KEY_SQL = f"CASE WHEN {DOI_SQL} <> '' THEN 'doi:' || {DOI_SQL} ELSE 'ty:' || {TITLE_SQL} || ':' || CASE WHEN coalesce(pub_year, 0) = 0 THEN '' ELSE pub_year::VARCHAR END END"


def keyed(spark, root):
    return table(spark, root, "records").withColumn("dedup_key", T.dedup_key(F.col("doi"), F.col("title"), F.col("pub_year")))


@query(f"SELECT {KEY_SQL} AS dedup_key, count(*) AS n, min(record_key) AS first_key FROM records GROUP BY 1")
def dedup_key(spark, root):
    return keyed(spark, root).groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"), F.min("record_key").alias("first_key"))


LENGTH_SQL = "length(coalesce(abstract, '')) + length(coalesce(full_text, '')) + coalesce(list_sum(list_transform(sections, lambda s: length(coalesce(s.body, '')))), 0)"
RANKED_SQL = f"SELECT record_id, dedup_key, first_value(record_id) OVER (PARTITION BY dedup_key ORDER BY len DESC, record_id) AS winner_id FROM (SELECT record_id, {KEY_SQL} AS dedup_key, {LENGTH_SQL} AS len FROM records)"


@query(f"SELECT dedup_key, record_id FROM ({RANKED_SQL}) WHERE record_id = winner_id")
def dedup_winners(spark, root):
    return R.winners_and_losers(keyed(spark, root))[0].select("dedup_key", "record_id")


@query(f"SELECT winner_id, record_id AS loser_id FROM ({RANKED_SQL}) WHERE record_id <> winner_id")
def dedup_losers(spark, root):
    return R.winners_and_losers(keyed(spark, root))[1]


@query()
def record_identity(spark, root):
    return canonical_records(spark, root).select("record_key", R.record_id().alias("content_id"))


@query("SELECT sha256(string_agg(record_id, '' ORDER BY record_id)) AS corpus_hash, count(*) AS n FROM records")
def corpus_hash(spark, root):
    ids = table(spark, root, "records").select("record_id")
    return spark.createDataFrame([(R.corpus_hash(ids), ids.count())], "corpus_hash string, n long")


@query("SELECT sha256(string_agg(p || h, '' ORDER BY p)) AS tree_hash, sum(n)::BIGINT AS n FROM (SELECT substr(record_id, 1, 4) AS p, sha256(string_agg(record_id, '' ORDER BY record_id)) AS h, count(*) AS n FROM records GROUP BY 1)")
def corpus_tree_hash(spark, root):
    return R.corpus_tree_hash(table(spark, root, "records"))


@query("""SELECT count(*) AS records, count_if(coalesce(abstract, '') <> '') AS with_abstract, count_if(coalesce(doi, '') <> '') AS with_doi, count_if(coalesce(full_text, '') <> '') AS with_full_text, count_if(coalesce(len(sections), 0) > 0) AS with_sections,
  CASE WHEN count_if(coalesce(len(sections), 0) > 0) >= greatest(1, count(*) // 2) THEN 'tei-section' WHEN count_if(coalesce(full_text, '') <> '') >= greatest(1, count(*) // 2) THEN 'sentence' ELSE 'record' END AS recommended_chunker FROM records""")
def corpus_stats(spark, root):
    return R.corpus_statistics(table(spark, root, "records"))


@query("""SELECT import_id, sum(n)::BIGINT AS rows_read, sum(ma)::BIGINT AS missing_abstract, sum(md)::BIGINT AS missing_doi, string_agg(CASE WHEN k <> '' THEN k || '=' || n END, '; ' ORDER BY k || '=' || n) AS document_types
  FROM (SELECT import_id, coalesce(element_at(extra, 'document_type')[1], '') AS k, count(*) AS n, count_if(coalesce(abstract, '') = '' OR lower(trim(abstract)) IN ('[no abstract available]', 'no abstract available')) AS ma, count_if(coalesce(doi, '') = '') AS md FROM records GROUP BY 1, 2) GROUP BY 1""".replace("element_at(extra, 'document_type')[1]", "map_extract_value(extra, 'document_type')"))
def import_report(spark, root):
    return R.import_counts(table(spark, root, "records"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM records GROUP BY 1")
def source_partition(spark, root):
    return table(spark, root, "records").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT record_id, nullif({DOI_SQL}, '') AS kd, nullif({TITLE_SQL}, '') AS kt, length(coalesce(full_text, '')) AS n FROM records),
  m AS (SELECT *, nullif({DOI_SQL}, '') AS kd, nullif({TITLE_SQL}, '') AS kt FROM corpus_manifest), d AS (SELECT kd, max_by(n, record_id) AS n FROM r WHERE kd IS NOT NULL GROUP BY 1), t AS (SELECT kt, max_by(n, record_id) AS n FROM r WHERE kt IS NOT NULL GROUP BY 1)
  SELECT m.record_id, coalesce(d.n, t.n) AS text_n_chars, CASE WHEN d.n IS NOT NULL THEN 'doi' WHEN t.n IS NOT NULL THEN 'title' ELSE 'none' END AS matched_by FROM m LEFT JOIN d USING (kd) LEFT JOIN t USING (kt)""")
def merge_metadata(spark, root):
    texts = table(spark, root, "records").withColumn("n_chars", F.length(T.text_of("full_text")).cast("long"))
    return R.merge_metadata(table(spark, root, "corpus_manifest"), texts, ["n_chars"]).select("record_id", "text_n_chars", "matched_by")


# ---------------------------------------------------------------- text
@query(f"SELECT chunk_id, len({TOKENS('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS('text')}))::BIGINT AS n_distinct FROM chunks")
def tokenise(spark, root):
    t = T.tokens("text")
    return table(spark, root, "chunks").select("chunk_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, unnest(range(len(s)))::INT AS sentence_no, unnest(s) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)")
def split_sentences(spark, root):
    return table(spark, root, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("sentence_no", "sentence"))


CLAIMS_SQL = f"SELECT doc_id, record_key, claim_no, claim, regexp_matches(claim, '(?i)\\b({'|'.join(SQL_HEDGES)})\\b') AS hedged FROM (SELECT doc_id, record_key, unnest(range(len(s)))::INT AS claim_no, unnest(s) AS claim FROM (SELECT doc_id, record_key, {sentences_sql('text')} AS s FROM documents)) WHERE len({WORDS('claim')}) BETWEEN 6 AND 60 AND NOT ends_with(claim, '?')"


@query(f"SELECT doc_id, claim_no, claim, hedged FROM ({CLAIMS_SQL})")
def extract_claims(spark, root):
    return metrics.claims(table(spark, root, "documents"), "doc_id")


@query(f"SELECT chunk_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(substr(text, 1, 240), '\\s+\\S*$', '') || ' ...' END AS snippet FROM chunks")
def snippets(spark, root):
    return table(spark, root, "chunks").select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT record_id, list_filter(list_transform(string_split(coalesce(authors, ''), CASE WHEN contains(coalesce(authors, ''), ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> '') AS people FROM corpus_manifest".replace("AS people", "AS p").replace("SELECT record_id,", "SELECT record_id, array_to_string(p, '|') AS people, len(p)::INT AS n_people FROM (SELECT record_id,") + ")")
def split_authors(spark, root):
    p = T.split_people(F.col("authors"))
    return table(spark, root, "corpus_manifest").select("record_id", F.array_join(p, "|").alias("people"), F.size(p).alias("n_people"))


# ---------------------------------------------------------------- sections
def _heading_sql() -> str:
    h = f"lower({collapse('heading')})"
    for _ in range(3):
        h = f"regexp_replace({h}, '{H.NUMBERING}', '')"
    return f"trim(regexp_replace({h}, '[\\s.:;,\\-–—]+$', ''))"


def _label_sql(what: str) -> str:
    cases = [f"WHEN n = '' THEN '{'other' if what == 'label' else 'empty'}'"]
    cases += [f"WHEN n = '{h}' THEN '{label if what == 'label' else 'exact'}'" for h, label in H.EXACT.items()]
    cases += [f"WHEN contains(n, '{p}') THEN '{label if what == 'label' else 'contains:' + p}'" for p, label in H.CONTAINS]
    return f"CASE {' '.join(cases)} ELSE '{'other' if what == 'label' else 'unmatched'}' END"


@query(f"WITH h AS (SELECT coalesce(unnest(sections).heading, '') AS heading FROM records), m AS (SELECT heading, {_heading_sql()} AS n FROM h) SELECT heading, n AS normal, {_label_sql('label')} AS label, {_label_sql('rule')} AS rule, count(*) AS uses FROM m GROUP BY ALL")
def section_classify(spark, root):
    h = table(spark, root, "records").select(F.explode("sections").alias("s")).select(F.coalesce("s.heading", F.lit("")).alias("heading"))
    counted = h.groupBy("heading").agg(F.count(F.lit(1)).alias("uses")).withColumn("normal", H.normalise_heading("heading"))
    return counted.withColumn("c", H.classify(F.col("normal"))).select("heading", "normal", "c.label", "c.rule", "uses")


_JUDGED = f"""SELECT record_id, section_no, heading, n AS normal, num, {_label_sql('label')} AS label, {_label_sql('rule')} AS rule FROM (SELECT record_id, section_no, heading, {_heading_sql().replace('heading', "coalesce(heading, '')")} AS n,
  CASE WHEN digits = '' THEN []::INT[] ELSE list_transform(string_split(digits, '.'), lambda d: d::INT) END AS num FROM (SELECT *, regexp_extract(coalesce(heading, ''), '^\\s*[(\\[]?\\s*(\\d+(?:\\.\\d+)*)', 1) AS digits FROM (SELECT record_id, unnest(range(len(sections)))::INT AS section_no, unnest(sections).heading AS heading FROM records)))"""
_PARENT = "x[1].num[1:len(x[1].num) - 1]"
_UNDER = f"list_filter(a, lambda e: e.num = {_PARENT} AND e.label <> 'other')"
_BEFORE = "list_filter(a, lambda e: e.label NOT IN ('other', 'references', 'appendix'))"
_BY_NUMBER, _BY_PLACE = f"x[1].rule = 'unmatched' AND len(x[1].num) > 1 AND len({_UNDER}) > 0", f"x[1].rule = 'unmatched' AND len({_BEFORE}) > 0"
INHERITED_SQL = f"""SELECT record_id, s.section_no, s.heading, s.normal, s.label, s.rule FROM (SELECT record_id, unnest(list_reduce(l, lambda a, x: list_concat(a, [{{{{'section_no': x[1].section_no, 'heading': x[1].heading, 'normal': x[1].normal, 'num': x[1].num,
  'label': CASE WHEN {_BY_NUMBER} THEN {_UNDER}[-1].label WHEN {_BY_PLACE} THEN {_BEFORE}[-1].label ELSE x[1].label END,
  'rule': CASE WHEN {_BY_NUMBER} THEN 'inherited:' || array_to_string({_PARENT}, '.') WHEN {_BY_PLACE} THEN 'inherited:previous' ELSE x[1].rule END}}}}]))) AS s
  FROM (SELECT record_id, list([{{{{'section_no': section_no, 'heading': heading, 'normal': normal, 'num': num, 'label': label, 'rule': rule}}}}] ORDER BY section_no) AS l FROM ({_JUDGED}) GROUP BY 1))""".replace("{{", "{").replace("}}", "}")


@query(INHERITED_SQL)
def section_inherit(spark, root):
    return H.section_rows(table(spark, root, "records")).select("record_id", "section_no", "heading", "normal", "label", "rule")


@query(f"""WITH r AS ({INHERITED_SQL}) SELECT 'label' AS kind, label AS name, count(*) AS n, NULL::DOUBLE AS share FROM r GROUP BY ALL UNION ALL SELECT 'rule', split_part(rule, ':', 1), count(*), NULL FROM r GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT 'unmatched', normal, count(*) AS n, NULL FROM r WHERE rule = 'unmatched' GROUP BY ALL ORDER BY n DESC, normal LIMIT 50) UNION ALL SELECT 'headings', 'unmatched_fraction', count(*), count_if(label = 'other') / count(*) FROM r HAVING count(*) > 0""")
def section_report(spark, root):
    return H.section_report(H.section_rows(table(spark, root, "records")))


@query("SELECT coalesce(section, 'none') AS section, count(*) AS n, count_if(span_start >= 0 AND span_end > span_start) AS n_located FROM chunks GROUP BY 1")
def section_mix(spark, root):
    return table(spark, root, "chunks").groupBy(F.coalesce("section", F.lit("none")).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("span_start >= 0 AND span_end > span_start")).alias("n_located"))


# ---------------------------------------------------------------- chunkers
WINDOWS_SQL = "list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE (greatest(len(w) - {size}, 0) + {step} - 1) // {step} + 1 END), lambda i: array_to_string(w[i * {step} + 1:i * {step} + {size}], ' '))"


@query(chunk_sql(f"SELECT record_id, {WORDS('text')} AS w FROM ({DOCS_SQL})", WINDOWS_SQL.format(size=200, step=160), "fixed/v1(size=200,overlap=40)"))
def chunk_fixed(spark, root):
    return chunked(spark, root, "fixed")


@query(chunk_sql(f"SELECT record_id, {sentences_sql('text')} AS w FROM ({DOCS_SQL})", WINDOWS_SQL.format(size=3, step=1), "sliding-sentence/v1(window=3,stride=1)"))
def chunk_sliding(spark, root):
    return chunked(spark, root, "sliding-sentence")


PACKED_SQL = f"""CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE (SELECT list_append(r.done, array_to_string(r.now, ' ')) FROM (SELECT list_reduce(list_transform(w, lambda s: {{'done': []::VARCHAR[], 'now': [s], 'n': len({WORDS('s')})}}),
  lambda a, x: CASE WHEN a.n + x.n > 180 THEN {{'done': list_append(a.done, array_to_string(a.now, ' ')), 'now': x.now, 'n': x.n}} ELSE {{'done': a.done, 'now': list_concat(a.now, x.now), 'n': a.n + x.n}} END) AS r)) END"""


@query(chunk_sql(f"SELECT record_id, {sentences_sql('text')} AS w FROM ({DOCS_SQL})", PACKED_SQL, "sentence/v1(max_words=180)"))
def chunk_sentence(spark, root):
    return chunked(spark, root, "sentence")


_OVER = "len(a.now) > 0 AND a.n + x.n > 250"
_N, _DONE, _NOW = f"(CASE WHEN {_OVER} THEN x.n ELSE a.n + x.n END)", f"(CASE WHEN {_OVER} THEN list_append(a.done, array_to_string(a.now, ' ')) ELSE a.done END)", f"(CASE WHEN {_OVER} THEN x.now ELSE list_concat(a.now, x.now) END)"
_PART = "{'done': []::VARCHAR[], 'now': "
MERGED_SQL = f"""(SELECT CASE WHEN len(r.now) > 0 THEN list_append(r.done, array_to_string(r.now, ' ')) ELSE r.done END FROM (SELECT list_reduce(list_prepend({_PART}[]::VARCHAR[], 'n': 0::BIGINT}}, list_transform(w, lambda s: {_PART}[s], 'n': len({WORDS('s')})}})),
  lambda a, x: CASE WHEN {_N} >= 250 THEN {{'done': list_append({_DONE}, array_to_string({_NOW}, ' ')), 'now': []::VARCHAR[], 'n': 0::BIGINT}} ELSE {{'done': {_DONE}, 'now': {_NOW}, 'n': {_N}}} END) AS r))"""


@query(chunk_sql(f"SELECT record_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda p: trim(p) <> '') AS w FROM ({DOCS_SQL})", MERGED_SQL, "paragraph/v1(min=30,max=250)"))
def chunk_paragraph(spark, root):
    return chunked(spark, root, "paragraph")


@query()
def chunk_recursive(spark, root):
    return chunked(spark, root, "recursive")


@query()
def chunk_semantic(spark, root):
    return chunked(spark, root, "semantic")


@query(f"""WITH b AS (SELECT record_id, {collapse("coalesce(title, '') || '. ' || coalesce(abstract, '')")} AS text FROM records)
  SELECT substr(sha256(concat_ws('|', record_id, 'record/v1', '0', text)), 1, 20) AS chunk_id, record_id, 0 AS ordinal, text FROM b WHERE text <> ''""")
def chunk_record(spark, root):
    return chunking.chunk(table(spark, root, "records"), "record", spans=False).select("chunk_id", "record_id", "ordinal", "text")


@query()
def chunk_section(spark, root):
    return chunking.chunk(canonical_records(spark, root), "tei-section").select("chunk_id", "record_id", "ordinal", "section", "span_start", "span_end", "text")


#: The place of each of the texts ``ps`` in ``src``: from a cursor that moves on by half a text, else from the beginning.
_AHEAD = "(CASE WHEN strpos(substr(x.src, a.at + 1), x.t) > 0 THEN strpos(substr(x.src, a.at + 1), x.t) + a.at ELSE strpos(x.src, x.t) END)"
SPANS_SQL = f"""list_reduce(list_prepend({{'at': 0, 'spans': []::STRUCT(a INT, b INT)[], 'src': '', 't': ''}}, list_transform(ps, lambda t: {{'at': 0, 'spans': []::STRUCT(a INT, b INT)[], 'src': src, 't': t}})),
  lambda a, x: {{'at': (CASE WHEN {_AHEAD} > 0 THEN {_AHEAD} - 1 + greatest(1, length(x.t) // 2) ELSE a.at END)::INT, 'spans': list_append(a.spans, {{'a': ({_AHEAD} - 1)::INT, 'b': (CASE WHEN {_AHEAD} > 0 THEN {_AHEAD} - 1 + length(x.t) ELSE -1 END)::INT}}), 'src': x.src, 't': x.t}}).spans"""


@query(f"""WITH b AS (SELECT record_id, '. ' || {collapse('text')} AS src, {WORDS('text')} AS w FROM ({DOCS_SQL})), p AS (SELECT record_id, coalesce(src, '') AS src, list_filter({WINDOWS_SQL.format(size=60, step=48)}, lambda t: t <> '') AS ps FROM b)
  SELECT record_id, ordinal, s.a AS span_start, s.b AS span_end FROM (SELECT record_id, unnest(range(len(ps)))::INT AS ordinal, unnest({SPANS_SQL}) AS s FROM p)""")
def located_chunks(spark, root):
    docs = documents_as_records(spark, root).withColumn("full_text", T.collapse_space(F.col("full_text")))
    return chunking.chunk(docs, "fixed", size=60, overlap=12).select("record_id", "ordinal", "span_start", "span_end")


# ---------------------------------------------------------------- vectors
def hash_sql(source: str, key: str, text: str, dim: int) -> str:
    t = f"rpad(' ' || trim(lower(coalesce({text}, ''))) || ' ', greatest(length(' ' || trim(lower(coalesce({text}, ''))) || ' '), 4)::INT, ' ')"
    return f"""SELECT {key}, bucket, sum(s)::BIGINT AS total FROM (SELECT {key}, ('0x' || substr(d, 1, 8))::BIGINT % {dim} AS bucket, CASE WHEN ('0x' || substr(d, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s
      FROM (SELECT {key}, sha1(g) AS d FROM (SELECT {key}, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS g FROM (SELECT {key}, {t} AS t FROM {source})))) GROUP BY 1, 2 HAVING sum(s) <> 0"""


@query(hash_sql("chunks", "chunk_id", "text", 256))
def hash_embed(spark, root):
    return V.hash_counts(table(spark, root, "chunks"), "chunk_id", "text")


def vec_sides(spark, root):
    v = search.usable(table(spark, root, "embeddings"), "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    return v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


UNIT_SQL = "SELECT vec_id AS id, CASE WHEN list_dot_product(e, e) = 0 THEN e ELSE list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) END AS v, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0)"
TOP = lambda score, k=10: f"SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank_no FROM ({score})) WHERE rank_no <= {k}"
PAIRS = lambda score: f"WITH u AS ({UNIT_SQL}) SELECT q.id AS query_id, u.id, round_even({score}, 9) AS score FROM u, u q WHERE q.id % 20 = 0"


def _flat(metric):
    return lambda spark, root: search.exact(*vec_sides(spark, root), 10, metric)


for _metric, _sql in (("cosine", "list_dot_product(u.v, q.v)"), ("ip", "list_dot_product(u.e, q.e)"), ("l2", "-list_distance(u.e, q.e)")):
    query(TOP(PAIRS(_sql)), f"flat_{_metric}_topk")(_flat(_metric))

#: A coarse index, whose fidelity is measured, and one that finds nine of ten neighbours here: tables and bits to flip.
BITS, TABLES, FINE, FLIPS = 8, 2, 12, 2
NORMALS = search.planes(64, BITS, TABLES, 42)


def codes_sql(tables: int) -> str:
    normals = search.planes(64, BITS, tables, 42)
    planes = ", ".join(f"({t}, {b}, {[float(x) for x in normals[t, b]]}::DOUBLE[])" for t in range(tables) for b in range(BITS))
    return f"SELECT id, t AS table_no, sum(CASE WHEN list_dot_product(v, p) > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM ({UNIT_SQL}), (VALUES {planes}) x(t, b, p) GROUP BY 1, 2"


CODES_SQL = codes_sql(TABLES)


@query(CODES_SQL)
def lsh_signature(spark, root):
    v, _ = vec_sides(spark, root)
    return search.signatures(v.withColumn("v", V.unit(F.col("v"))), NORMALS).select("id", F.col("table_no").cast("int").alias("table_no"), "code")


lsh_sql = lambda tables, radius: TOP(f"WITH c AS ({codes_sql(tables)}), u AS ({UNIT_SQL}), m AS (SELECT DISTINCT q.id AS query_id, c.id FROM c JOIN c q ON q.id % 20 = 0 AND c.table_no = q.table_no AND bit_count(xor(c.code, q.code)) <= {radius}) SELECT query_id, m.id, round_even(list_dot_product(a.v, b.v), 9) AS score FROM m JOIN u a ON a.id = m.id JOIN u b ON b.id = m.query_id")
LSH_SQL = lsh_sql(TABLES, 1)


def _lsh(spark, root):
    return search.lsh(*vec_sides(spark, root), 10, BITS, FINE, FLIPS)


query(lsh_sql(FINE, FLIPS), "lsh_topk")(_lsh)


@query()
def ivf_topk(spark, root):
    return search.ivf(*vec_sides(spark, root), 10, cells=32, probes=24)


@query()
def ivfpq_topk(spark, root):
    return search.ivf(*vec_sides(spark, root), 10, cells=32, probes=24, parts=8)


@query(f"""WITH e AS ({TOP(PAIRS("list_dot_product(u.v, q.v)"))}), l AS ({LSH_SQL}), a AS (SELECT query_id, list(id ORDER BY rank_no) AS e FROM e GROUP BY 1), b AS (SELECT query_id, list(id ORDER BY rank_no) AS l FROM l GROUP BY 1)
  SELECT query_id, round_even(len(list_intersect(e, l)) / len(e), 9) AS esf, (len(e) - len(list_intersect(e, l)))::INT AS n_missing, (len(l) - len(list_intersect(e, l)))::INT AS n_spurious FROM a JOIN b USING (query_id)""")
def evidence_fidelity(spark, root):
    sides = vec_sides(spark, root)
    e = metrics.lists_of(search.exact(*sides, 10), ["query_id"], "id").withColumnRenamed("ids", "exact_ids")
    a = metrics.lists_of(search.lsh(*sides, 10, BITS, TABLES), ["query_id"], "id").withColumnRenamed("ids", "approx_ids")
    return metrics.fidelity(e.join(a, "query_id")).select("query_id", F.bround("esf", 9).alias("esf"), "n_missing", "n_spurious")


@query()
def grid_summary(spark, root):
    v, q = vec_sides(spark, root)
    rows = experiment.run_grid(v.withColumn("id", F.col("id").cast("string")), q, 10, [{"backend": "lsh", "params": {"bits": 8, "tables": 3}, "seeds": [0, 1, 2]}, {"backend": "ivf", "params": {"cells": 32, "probes": 6}, "seeds": [0, 1]}])
    return experiment.summary(rows, ["backend", "params"])


# ---------------------------------------------------------------- lexical and fused retrieval
BM25_SQL = f"""WITH d AS (SELECT chunk_id, {TOKENS('text')} AS t FROM chunks), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), p AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({TOKENS('query_text')}) AS term FROM queries) GROUP BY 1, 2)
  SELECT query_id, chunk_id AS id, round_even(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * (dl / a)))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2"""


@query(f"SELECT count(*) AS n, round_even(avg(len({TOKENS('text')})), 9) AS avgdl FROM chunks")
def bm25_stats(spark, root):
    return search.bm25_statistics(table(spark, root, "chunks")).select("n", F.bround("avgdl", 9).alias("avgdl"))


def bm25_lists(spark, root, k):
    return search.bm25(table(spark, root, "chunks"), table(spark, root, "queries"), k, key="chunk_id")


@query(f"SELECT query_id, id AS chunk_id, round_even(score, 6) AS score, rank_no FROM ({TOP(BM25_SQL)})")
def bm25_topk(spark, root):
    return bm25_lists(spark, root, 10).select("query_id", "chunk_id", F.bround("score", 6).alias("score"), "rank_no")


@query("SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank_no FROM (SELECT query_id, chunk_id, round_even(sum(1.0 / (60 + rank_no)), 9) AS score FROM ranked_hits WHERE chunk_id IS NOT NULL AND rank_no IS NOT NULL GROUP BY 1, 2)")
def rrf_fusion(spark, root):
    hits = table(spark, root, "ranked_hits").where("chunk_id IS NOT NULL AND rank_no IS NOT NULL")
    return search.fuse([hits], key="chunk_id")


def dense_sql(dim: int, where: str = "") -> str:
    vec = lambda source, key, text: f"SELECT k.{key}, bucket, round_even(total / n, 6) AS x FROM ({hash_sql(source, key, text, dim)}) k JOIN (SELECT {key}, sqrt(sum(total * total)) AS n FROM ({hash_sql(source, key, text, dim)}) GROUP BY 1) z ON k.{key} = z.{key}"
    unit = lambda name, key: f"SELECT a.{key}, bucket, x / sqrt(s) AS x FROM {name} a JOIN (SELECT {key}, sum(x * x) AS s FROM {name} GROUP BY 1) b ON a.{key} = b.{key}"
    return f"""WITH cv AS ({vec(f'(SELECT * FROM chunks {where})', 'chunk_id', 'text')}), qv AS ({vec('queries', 'query_id', 'query_text')}), c AS ({unit('cv', 'chunk_id')}), q AS ({unit('qv', 'query_id')})
      SELECT query_id, chunk_id AS id, round_even(sum(c.x * q.x), 9) AS score FROM c JOIN q USING (bucket) GROUP BY 1, 2"""


def retrieved(spark, root, **settings):
    return retrieval.retrieve(table(spark, root, "chunks"), table(spark, root, "queries"), retrieval.Settings(dimension=64, **settings))


@query(f"SELECT query_id, id AS chunk_id, round_even(score, 6) AS score, rank_no FROM ({TOP(dense_sql(64))})")
def retrieve_dense(spark, root):
    return retrieved(spark, root, mode="dense", k=10).select("query_id", "chunk_id", F.bround("score", 6).alias("score"), "rank_no")


@query(f"SELECT query_id, id AS chunk_id, rank_no FROM ({TOP(BM25_SQL)})")
def retrieve_lexical(spark, root):
    return retrieved(spark, root, mode="lexical", k=10).select("query_id", "chunk_id", "rank_no")


FUSED_SQL = f"""WITH d AS ({TOP(dense_sql(64))}), l AS ({TOP(BM25_SQL)}) SELECT query_id, id, round_even(sum(1.0 / (60 + rank_no)), 9) AS score FROM (SELECT query_id, id, rank_no FROM d UNION ALL SELECT query_id, id, rank_no FROM l) GROUP BY 1, 2"""


@query(f"SELECT query_id, id AS chunk_id, score, rank_no FROM ({TOP(FUSED_SQL)})")
def retrieve_hybrid(spark, root):
    return retrieved(spark, root, mode="hybrid", k=10)


@query(f"SELECT query_id, id AS chunk_id, rank_no FROM ({TOP(dense_sql(64, chr(39).join(['WHERE section IN (', 'methods', ', ', 'results', ')'])))})")
def retrieve_section_filter(spark, root):
    return retrieved(spark, root, mode="dense", k=10, section_filter=("methods", "results")).select("query_id", "chunk_id", "rank_no")


# ---------------------------------------------------------------- lists, spans, evidence
LISTS_SQL = "SELECT query_id, run_id, list(chunk_id ORDER BY r, chunk_id) AS ids FROM (SELECT query_id, run_id, chunk_id, min(rank_no) AS r FROM ranked_hits WHERE chunk_id IS NOT NULL GROUP BY ALL) GROUP BY ALL"
NEIGHBOURS_SQL = f"SELECT * FROM (SELECT query_id, run_id, ids, lag(ids) OVER w AS before_ids FROM ({LISTS_SQL}) WINDOW w AS (PARTITION BY query_id ORDER BY run_id)) WHERE before_ids IS NOT NULL"
JACCARD_SQL = "CASE WHEN len(list_distinct(list_concat(ids, before_ids))) = 0 THEN 1.0 ELSE len(list_intersect(ids, before_ids)) / len(list_distinct(list_concat(ids, before_ids))) END"
RBO_SQL = "list_sum(list_transform(range(1, greatest(len(ids), len(before_ids)) + 1), lambda d: len(list_intersect(ids[1:d], before_ids[1:d])) / d * pow(0.9, d - 1))) / ((1 - pow(0.9, greatest(len(ids), len(before_ids)))) / 0.1)"


def run_lists(spark, root):
    return metrics.lists_of(table(spark, root, "ranked_hits"), ["query_id", "run_id"])


PAIRS_OF_RUNS_SQL = f"SELECT a.query_id, a.run_id AS run_a, b.run_id AS run_b, a.ids, b.ids AS before_ids FROM ({LISTS_SQL}) a JOIN ({LISTS_SQL}) b ON a.query_id = b.query_id AND a.run_id < b.run_id"


def run_pairs(spark, root):
    return metrics.run_pairs(run_lists(spark, root), "query_id", "run_id").select("query_id", F.col("o1").alias("run_a"), F.col("o2").alias("run_b"), "i1", "i2")


@query(f"SELECT query_id, run_a, run_b, round_even({JACCARD_SQL}, 9) AS jaccard, round_even({RBO_SQL}, 6) AS rbo FROM ({PAIRS_OF_RUNS_SQL})")
def run_agreement(spark, root):
    a, b = F.col("i1"), F.col("i2")
    return run_pairs(spark, root).select("query_id", "run_a", "run_b", F.bround(metrics.jaccard(a, b), 9).alias("jaccard"), F.bround(metrics.rank_biased_overlap(a, b), 6).alias("rbo"))


@query(f"""WITH n AS ({PAIRS_OF_RUNS_SQL}), c AS (SELECT query_id, run_a, run_b, list_filter(ids, lambda x: list_contains(before_ids, x)) AS c, before_ids AS b FROM n), p AS (SELECT query_id, run_a, run_b, list_transform(c, lambda x: list_position(b, x)) AS p FROM c),
  k AS (SELECT query_id, run_a, run_b, len(p) AS n, list_sum(list_transform(range(1, len(p) + 1), lambda i: len(list_filter(p[i + 1:], lambda x: x > p[i])))) AS s FROM p)
  SELECT query_id, run_a, run_b, round_even(CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 1.0 ELSE (2 * s - n * (n - 1) / 2) / (n * (n - 1) / 2) END, 9) AS tau FROM k""")
def kendall_tau(spark, root):
    return run_pairs(spark, root).select("query_id", "run_a", "run_b", F.bround(metrics.kendall_tau(F.col("i1"), F.col("i2")), 9).alias("tau"))


STABILITY_SQL = f"SELECT query_id, {{n}} AS n_lists, round_even(avg({JACCARD_SQL}), 6) AS ess, round_even(coalesce(stddev_samp({JACCARD_SQL}), 0), 6) AS ess_std, round_even(avg((ids = before_ids)::INT), 6) AS identical_fraction FROM ({{pairs}}) GROUP BY 1"
PAIRED_SQL = f"SELECT a.query_id, a.ids, b.ids AS before_ids, (SELECT count(*) FROM ({LISTS_SQL}) c WHERE c.query_id = a.query_id) AS n FROM ({LISTS_SQL}) a JOIN ({LISTS_SQL}) b ON a.query_id = b.query_id AND a.run_id < b.run_id"
r6 = lambda c: F.bround(c, 6).alias(c)


@query(STABILITY_SQL.format(n="any_value(n)", pairs=PAIRED_SQL))
def evidence_stability(spark, root):
    return metrics.stability(run_lists(spark, root), "query_id", "run_id").select("query_id", "n_lists", r6("ess"), r6("ess_std"), r6("identical_fraction"))


@query(STABILITY_SQL.format(n="count(*) + 1", pairs=NEIGHBOURS_SQL))
def evidence_stability_neighbours(spark, root):
    return metrics.stability_neighbours(run_lists(spark, root), "query_id", "run_id").select("query_id", "n_lists", r6("ess"), r6("ess_std"), r6("identical_fraction"))


@query("""WITH h AS (SELECT DISTINCT query_id, run_id, chunk_id FROM ranked_hits), n AS (SELECT query_id, count(DISTINCT run_id) AS n_runs FROM h GROUP BY 1), c AS (SELECT query_id, chunk_id, count(*) AS k FROM h GROUP BY 1, 2)
  SELECT query_id, n_runs, count_if(k = n_runs) AS n_core, count_if(k < n_runs) AS n_volatile FROM c JOIN n USING (query_id) GROUP BY 1, 2""")
def core_volatile(spark, root):
    return metrics.core_and_volatile(table(spark, root, "ranked_hits"), "query_id", "run_id")


@query("SELECT run_id, query_id, sha256(string_agg(rank_no::VARCHAR || ':' || chunk_id, '' ORDER BY rank_no, chunk_id)) AS digest FROM ranked_hits WHERE rank_no IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2")
def evidence_digest(spark, root):
    return retrieval.evidence_digest(table(spark, root, "ranked_hits").where("rank_no IS NOT NULL AND chunk_id IS NOT NULL"), ["run_id", "query_id"])


@query(f"SELECT query_id, run_id, (len(before_ids) - len(list_intersect(ids, before_ids)))::INT AS n_missing, (len(ids) - len(list_intersect(ids, before_ids)))::INT AS n_added, ids <> before_ids AND list_sort(ids) = list_sort(before_ids) AS reordered_only, ids = before_ids AS verified FROM ({NEIGHBOURS_SQL})")
def certificate_verify(spark, root):
    reruns = metrics.consecutive(run_lists(spark, root), "query_id", "run_id")
    return reruns.select("query_id", "run_id", retrieval.drift(F.col("before_ids"), F.col("ids")).alias("d")).select("query_id", "run_id", "d.*")


@query("SELECT query_id, run_id, count(*) AS n_records, sum(r)::BIGINT AS rank_sum FROM (SELECT query_id, run_id, record_id, min(rank_no) AS r FROM ranked_hits JOIN chunks USING (chunk_id) GROUP BY ALL) GROUP BY 1, 2")
def record_ids(spark, root):
    hits = table(spark, root, "ranked_hits").join(table(spark, root, "chunks").select("chunk_id", "record_id"), "chunk_id")
    return hits.groupBy("query_id", "run_id", "record_id").agg(F.min("rank_no").alias("r")).groupBy("query_id", "run_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("r").alias("rank_sum"))


MERGE_SQL = """SELECT {by}, min(span_start) AS span_start, max(span_end) AS span_end FROM (SELECT *, sum(CASE WHEN far IS NULL OR span_start > far THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY span_start, span_end ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, max(span_end) OVER (PARTITION BY {by} ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ({source}) WHERE span_start >= 0 AND span_end > span_start)) GROUP BY {by}, isle"""


@query(MERGE_SQL.format(by="record_id", source="SELECT record_id, span_start, span_end FROM chunks"))
def span_merge(spark, root):
    return metrics.merged_spans(table(spark, root, "chunks").select("record_id", "span_start", "span_end"), ["record_id"])


END_RUNS_SQL = "SELECT h.query_id, {f}(run_id) AS run_id FROM ranked_hits h GROUP BY 1"
EVIDENCE_SQL = "SELECT DISTINCT h.query_id, c.chunk_id, c.record_id, c.span_start, c.span_end, c.text FROM ranked_hits h JOIN ({e}) e ON h.query_id = e.query_id AND h.run_id = e.run_id JOIN chunks c ON c.chunk_id = h.chunk_id"


def ends(spark, root):
    """The evidence of the first and of the last run of each query."""
    hits = table(spark, root, "ranked_hits")
    chunks = table(spark, root, "chunks").select("chunk_id", "record_id", "span_start", "span_end", "text")
    out = []
    for f in (F.min, F.max):
        run = hits.groupBy("query_id").agg(f("run_id").alias("run_id"))
        out.append(hits.join(run, ["query_id", "run_id"]).select("query_id", "chunk_id").distinct().join(chunks, "chunk_id"))
    return out


A_SQL, B_SQL = (EVIDENCE_SQL.format(e=END_RUNS_SQL.format(f=f)) for f in ("min", "max"))


@query(f"""WITH a AS ({A_SQL}), b AS ({B_SQL}), ma AS ({MERGE_SQL.format(by='query_id, record_id', source='a')}), mb AS ({MERGE_SQL.format(by='query_id, record_id', source='b')}),
  na AS (SELECT query_id, sum(span_end - span_start) AS n FROM ma GROUP BY 1), nb AS (SELECT query_id, sum(span_end - span_start) AS n FROM mb GROUP BY 1),
  x AS (SELECT ma.query_id, sum(least(ma.span_end, mb.span_end) - greatest(ma.span_start, mb.span_start)) AS n FROM ma JOIN mb ON ma.query_id = mb.query_id AND ma.record_id = mb.record_id AND least(ma.span_end, mb.span_end) > greatest(ma.span_start, mb.span_start) GROUP BY 1),
  k AS (SELECT query_id FROM a UNION SELECT query_id FROM b), s AS (SELECT k.query_id, coalesce(x.n, 0)::BIGINT AS both_chars, (coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(x.n, 0))::BIGINT AS union_chars FROM k LEFT JOIN na USING (query_id) LEFT JOIN nb USING (query_id) LEFT JOIN x USING (query_id))
  l AS (SELECT query_id, max(CASE WHEN e = 'a' THEN f END) AS located_a, max(CASE WHEN e = 'b' THEN f END) AS located_b FROM (SELECT query_id, e, avg((span_start >= 0 AND span_end > span_start)::INT) AS f FROM (SELECT *, 'a' AS e FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY 1, 2) GROUP BY 1),
  r AS (SELECT query_id, avg((n = 2)::INT) AS record_jaccard FROM (SELECT query_id, record_id, count(DISTINCT e) AS n FROM (SELECT *, 'a' AS e FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY 1, 2) GROUP BY 1)
  SELECT query_id, both_chars, union_chars, round_even(CASE WHEN union_chars = 0 THEN 1.0 ELSE both_chars / union_chars END, 9) AS agreement, round_even(record_jaccard, 9) AS record_jaccard, round_even(coalesce(located_a, 1), 9) AS located_a, round_even(coalesce(located_b, 1), 9) AS located_b FROM s JOIN l USING (query_id) JOIN r USING (query_id)""".replace("  l AS (", ", l AS (", 1))
def span_agreement(spark, root):
    a, b = ends(spark, root)
    return metrics.span_agreement(a, b, ["query_id"]).withColumns({c: F.bround(c, 9) for c in ("agreement", "record_jaccard", "located_a", "located_b")})


@query(f"""WITH a AS ({A_SQL}), b AS ({B_SQL}), p AS (SELECT a.query_id, a.chunk_id, bool_or(a.chunk_id = b.chunk_id) AS same_id, bool_or(a.text = b.text) AS same_text, bool_or(a.span_start >= 0 AND a.record_id = b.record_id AND a.span_start = b.span_start AND a.span_end = b.span_end) AS same_span,
  bool_or(a.record_id = b.record_id AND a.span_start >= 0 AND b.span_start >= 0 AND a.span_start < b.span_end AND b.span_start < a.span_end) AS any_chars FROM a JOIN b ON a.query_id = b.query_id GROUP BY 1, 2)
  SELECT query_id, count(*) AS n, count_if(same_id) AS by_id, count_if(same_text) AS by_text, count_if(same_span) AS by_span, count_if(any_chars) AS by_chars FROM p GROUP BY 1""")
def overlap_four_ways(spark, root):
    a, b = ends(spark, root)
    # evidence sets hold k chunks, so a query's pairs are at most k x k
    other = b.select("query_id", *[F.col(c).alias(f"b_{c}") for c in ("chunk_id", "record_id", "span_start", "span_end", "text")])
    same_record = F.col("record_id") == F.col("b_record_id")
    met = a.join(other, "query_id").groupBy("query_id", "chunk_id").agg(
        F.bool_or(F.col("chunk_id") == F.col("b_chunk_id")).alias("i"), F.bool_or(F.col("text") == F.col("b_text")).alias("t"),
        F.bool_or((F.col("span_start") >= 0) & same_record & (F.col("span_start") == F.col("b_span_start")) & (F.col("span_end") == F.col("b_span_end"))).alias("s"),
        F.bool_or(same_record & (F.col("span_start") >= 0) & (F.col("b_span_start") >= 0) & (F.col("span_start") < F.col("b_span_end")) & (F.col("b_span_start") < F.col("span_end"))).alias("c"),
    )
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("i").alias("by_id"), F.count_if("t").alias("by_text"), F.count_if("s").alias("by_span"), F.count_if("c").alias("by_chars"))


CONTENT = lambda x: f"list_filter(list_distinct({TOKENS(x)}), lambda w: w NOT IN ({quoted(SQL_STOPWORDS)}))"
GROUNDED_SQL = f"""WITH c AS (SELECT doc_id, record_id, claim_no, hedged, {CONTENT('claim')} AS cw FROM ({CLAIMS_SQL}) JOIN records USING (record_key)), p AS (SELECT record_id, span_start >= 0 AS located, {CONTENT('text')} AS pw FROM chunks)
  SELECT doc_id, claim_no, hedged, count_if(pw IS NOT NULL AND len(cw) > 0 AND len(list_intersect(cw, pw)) >= 0.6 * len(cw)) AS n_supporting, count_if(located AND len(cw) > 0 AND len(list_intersect(cw, pw)) >= 0.6 * len(cw)) AS n_located FROM c LEFT JOIN p USING (record_id) GROUP BY 1, 2, 3"""


def grounded_claims(spark, root):
    """Claims of documents against the chunks of their record: supporting chunks, and supporting located ones."""
    docs = table(spark, root, "documents").where("record_key IS NOT NULL").select("doc_id", "record_key", "text")
    ids = table(spark, root, "records").select("record_key", "record_id")
    c = metrics.claims(docs, "doc_id").join(docs.select("doc_id", "record_key"), "doc_id").join(ids, "record_key").select("doc_id", "record_id", "claim_no", "hedged", T.content_words("claim").alias("cw"))
    p = table(spark, root, "chunks").select("record_id", (F.col("span_start") >= 0).alias("located"), T.content_words("text").alias("pw"))
    g = F.coalesce(metrics.grounded(F.col("cw"), F.col("pw")), F.lit(False))
    return c.join(p, "record_id", "left").groupBy("doc_id", "claim_no", "hedged").agg(F.count_if(g).alias("n_supporting"), F.count_if(g & F.col("located")).alias("n_located"))


@query(f"SELECT doc_id, claim_no, hedged, n_supporting, n_supporting > 0 AS grounded FROM ({GROUNDED_SQL})")
def attribute_claims(spark, root):
    return grounded_claims(spark, root).select("doc_id", "claim_no", "hedged", "n_supporting", (F.col("n_supporting") > 0).alias("grounded"))


@query(f"SELECT doc_id, count_if(e AND NOT a) AS n_lost, count_if(NOT e AND a) AS n_gained, count_if(e AND a) AS n_kept, round_even(count_if(e <> a) / count(*), 9) AS divergence FROM (SELECT doc_id, n_supporting > 0 AS e, n_located > 0 AS a FROM ({GROUNDED_SQL})) GROUP BY 1")
def synthesis_divergence(spark, root):
    flags = grounded_claims(spark, root).select("doc_id", (F.col("n_supporting") > 0).alias("in_exact"), (F.col("n_located") > 0).alias("in_approx"))
    return metrics.divergence(flags, "doc_id").withColumn("divergence", F.bround("divergence", 9))


MEASURED = [(10_000, 40.0, 5.0, 0.9), (5_000_000, 9_000.0, 30.0, 0.995), (9_000_000, 16_000.0, 35.0, 0.8)]


@query(f"""SELECT *, CASE WHEN exact_latency_ms <= 1000 THEN 'exact sufficient' WHEN esf >= 0.99 THEN 'approximate justified' ELSE 'approximate needed but fidelity too low' END AS verdict, exact_latency_ms / approx_latency_ms AS speedup
  FROM (VALUES {', '.join(f'({n}::BIGINT, {a}::DOUBLE, {b}::DOUBLE, {e}::DOUBLE)' for n, a, b, e in MEASURED)}) m(corpus_size, exact_latency_ms, approx_latency_ms, esf)""")
def crossover(spark, root):
    return metrics.crossover(spark.createDataFrame(MEASURED, "corpus_size long, exact_latency_ms double, approx_latency_ms double, esf double"))


@query()
def bootstrap_ci(spark, root):
    hits = table(spark, root, "ranked_hits").where("score IS NOT NULL").groupBy("query_id", "run_id").agg(F.avg("score").alias("m"))
    ci = hits.groupBy("query_id").agg(metrics.bootstrap_interval(F.col("m")).alias("ci"))
    return ci.select("query_id", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


@query("SELECT query_id, count(*) AS n, round_even(median(score), 9) AS median_score, round_even(avg(score), 6) AS mean_score, min(score) AS min_score, round_even(max(score) - min(score), 9) AS spread FROM ranked_hits WHERE score IS NOT NULL GROUP BY 1")
def score_summary(spark, root):
    s = table(spark, root, "ranked_hits").where("score IS NOT NULL")
    return s.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.bround(F.median("score"), 9).alias("median_score"), F.bround(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("min_score"), F.bround(F.max("score") - F.min("score"), 9).alias("spread"))


# ---------------------------------------------------------------- further projections, filters and joins
@query(f"SELECT chunk_id, {collapse('replace(coalesce(text, chr(32)), chr(173), chr(0))').replace('chr(0)', repr(''))} AS text_norm FROM chunks")
def normalise_text(spark, root):
    return table(spark, root, "chunks").select("chunk_id", T.normalise("text", nfkc=False).alias("text_norm"))


@query(f"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {collapse('x')}), lambda s: len(string_split(s, ' ')) BETWEEN 3 AND 30 AND NOT regexp_matches(lower(s), '^(abstract|keywords|doi|http|downloaded|page )'))[1], '') AS title FROM documents""")
def guess_title(spark, root):
    return table(spark, root, "documents").select("doc_id", T.guess_title(F.col("text")).alias("title"))


_TOPICS = ["eeg emotion recognition", "clinical text classification", "screening automation", "vector databases"]


@query(f"SELECT 'Study ' || lpad(i::VARCHAR, 5, '0') || ' on ' || t AS title, '10.9999/made.' || lpad(i::VARCHAR, 5, '0') AS doi, (2005 + i % 20)::INT AS year FROM (SELECT i, {_TOPICS}[i % 4 + 1] AS t FROM range(5000) r(i))")
def synthetic_corpus(spark, root):
    from evigrain.sources.bibliography import synthetic

    return synthetic(spark, 5000, _TOPICS).select("title", "doi", "year")


_SCREEN = collapse("coalesce(title, '') || '. ' || coalesce(abstract, '')")


@query(f"""WITH r AS (SELECT record_key, {_SCREEN} AS s, CASE WHEN coalesce(full_text, '') <> '' THEN full_text WHEN coalesce(len(sections), 0) > 0 THEN array_to_string(list_transform(sections, lambda x: x.body), ' ') ELSE {_SCREEN} END AS b FROM records)
  SELECT record_key, sha256(CASE WHEN s = b THEN s ELSE concat_ws(' ', nullif(s, ''), nullif(b, '')) END) AS source_hash FROM r""")
def canonical_source(spark, root):
    return table(spark, root, "records").select("record_key", F.sha2(R.canonical_source(), 256).alias("source_hash"))


@query(r"WITH h AS (SELECT coalesce(unnest(sections).heading, '') AS heading FROM records) SELECT heading, array_to_string(list_transform(string_split(nullif(regexp_extract(heading, '^\s*[(\[]?\s*(\d+(?:\.\d+)*)', 1), ''), '.'), lambda d: d::INT::VARCHAR), '.') AS number, count(*) AS uses FROM h GROUP BY ALL".replace("array_to_string(", "coalesce(array_to_string(", 1).replace(", '.') AS number", ", '.'), '') AS number"))
def heading_numbers(spark, root):
    h = table(spark, root, "records").select(F.explode("sections").alias("s")).select(F.coalesce("s.heading", F.lit("")).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("uses"))
    return h.select("heading", F.array_join(F.transform(H.number_of("heading"), lambda n: n.cast("string")), ".").alias("number"), "uses")


@query(f"SELECT id, round_even(v[1], 6) AS first, round_even(v[64], 6) AS last, round_even(list_dot_product(v, v), 6) AS square FROM ({UNIT_SQL})")
def unit_vectors(spark, root):
    v, _ = vec_sides(spark, root)
    u = v.select("id", V.unit(F.col("v")).alias("u"))
    return u.select("id", V.quantise(F.col("u"))[0].alias("first"), V.quantise(F.col("u"))[63].alias("last"), F.bround(V.dot(F.col("u"), F.col("u")), 6).alias("square"))


@query(f"SELECT chunk_id, len({CONTENT('text')})::INT AS n_content, array_to_string(list_sort({CONTENT('text')})[1:5], ' ') AS smallest FROM chunks")
def content_words(spark, root):
    w = T.content_words("text")
    return table(spark, root, "chunks").select("chunk_id", F.size(w).alias("n_content"), F.array_join(F.slice(F.array_sort(w), 1, 5), " ").alias("smallest"))


def _latex_sql(x: str) -> str:
    for escape, plain in T.LATEX:
        x = f"replace({x}, '{escape.replace(chr(39), chr(39) * 2)}', '{plain}')"
    return collapse(f"regexp_replace({x}, '[{{}}]', '', 'g')")


@query(f"SELECT record_key, {_latex_sql(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')} AS title_clean FROM records")
def clean_latex(spark, root):
    return table(spark, root, "records").select("record_key", T.clean_latex(F.col("title")).alias("title_clean"))


@query("SELECT h.run_id, h.query_id, h.rank_no, h.chunk_id, coalesce(r.title, '') AS title FROM ranked_hits h LEFT JOIN chunks c USING (chunk_id) LEFT JOIN records r USING (record_id) WHERE h.rank_no <= 3")
def hit_titles(spark, root):
    hits = table(spark, root, "ranked_hits").where("rank_no <= 3").select("run_id", "query_id", "rank_no", "chunk_id")
    chunks, recs = table(spark, root, "chunks").select("chunk_id", "record_id"), table(spark, root, "records").select("record_id", "title")
    return hits.join(chunks, "chunk_id", "left").join(recs, "record_id", "left").select("run_id", "query_id", "rank_no", "chunk_id", F.coalesce("title", F.lit("")).alias("title"))


@query("SELECT query_id, round_even(quantile_cont(score, 0.05), 6) AS p05, round_even(quantile_cont(score, 0.95), 6) AS p95 FROM ranked_hits WHERE score IS NOT NULL GROUP BY 1")
def score_percentiles(spark, root):
    s = table(spark, root, "ranked_hits").where("score IS NOT NULL")
    return s.groupBy("query_id").agg(F.bround(F.percentile("score", 0.05), 6).alias("p05"), F.bround(F.percentile("score", 0.95), 6).alias("p95"))


@query("SELECT record_id FROM records ORDER BY record_id LIMIT 50")
def subsample(spark, root):
    return experiment.subsample(table(spark, root, "records").select("record_id"), 50)


@query("""SELECT record_key, coalesce(map_extract_value(extra, 'document_type'), '') AS document_type FROM records
  WHERE lower(coalesce(map_extract_value(extra, 'document_type'), '')) IN ('article', 'review') AND coalesce(abstract, '') <> '' AND lower(trim(abstract)) NOT IN ('[no abstract available]', 'no abstract available')""")
def filtered_records(spark, root):
    kind = F.coalesce(F.element_at("extra", "document_type"), F.lit(""))
    from evigrain.sources.bibliography import wanted

    return table(spark, root, "records").where(wanted(kind, F.col("abstract"), ("Article", "Review"), True)).select("record_key", kind.alias("document_type"))


@query(f"WITH h AS (SELECT record_key, coalesce(s.heading, '') AS heading FROM (SELECT record_key, unnest(sections) AS s FROM records)), m AS (SELECT record_key, {_heading_sql()} AS n FROM h) SELECT DISTINCT record_key FROM m WHERE {_label_sql('label')} IN ('methods', 'results', 'introduction', 'discussion')")
def has_sections(spark, root):
    wanted = ("methods", "results", "introduction", "discussion")
    return table(spark, root, "records").where(F.exists("sections", lambda s: H.classify(H.normalise_heading(s["heading"]))["label"].isin(*wanted))).select("record_key")


@query("SELECT record_id, to_json({'doi': coalesce(doi, ''), 'title': coalesce(title, ''), 'pub_year': pub_year}) AS payload FROM corpus_manifest")
def record_payload(spark, root):
    return table(spark, root, "corpus_manifest").select("record_id", F.to_json(F.struct(T.text_of("doi").alias("doi"), T.text_of("title").alias("title"), "pub_year"), {"ignoreNullFields": "false"}).alias("payload"))


_PROTOCOLS = [(1, "A review of sleep", "adults", "light therapy", "", "sleep quality", ["sample size", "setting"]), (2, "Screening tools", "", "", "", "", [])]


@query("SELECT * FROM (VALUES (1::BIGINT, 'pico', 'adults light therapy sleep quality'), (1, 'field-0', 'sample size'), (1, 'field-1', 'setting'), (2, 'pico', 'Screening tools')) v(review_id, query_id, query_text)")
def protocol_queries(spark, root):
    from evigrain.plans import protocol

    return protocol.protocol_queries(spark.createDataFrame(_PROTOCOLS, protocol.PROTOCOL))


def _pieces_sql(words: str, pieces: str) -> str:
    return f"(SELECT record_id, src, list_filter(list_transform({pieces}, lambda t: {collapse('t')}), lambda t: t <> '') AS ps FROM (SELECT record_id, '. ' || coalesce(text, '') AS src, {words} AS w FROM ({DOCS_SQL})))"


_PLACED = "SELECT record_id, s.a AS span_start, s.b AS span_end FROM (SELECT record_id, unnest({spans}) AS s FROM {side})"
_CUTS = "SELECT record_id, list_distinct(list_concat(list(span_start), list(span_end))) AS cuts FROM {side} WHERE span_start >= 0 AND span_end > span_start GROUP BY 1"
COMPARED_SQL = f"""WITH pa AS {_pieces_sql(sentences_sql('text'), PACKED_SQL.replace('180', '120'))}, pb AS {_pieces_sql(WORDS('text'), WINDOWS_SQL.format(size=120, step=120))},
  a AS ({_PLACED.format(spans=SPANS_SQL, side='pa')}), b AS ({_PLACED.format(spans=SPANS_SQL, side='pb')}), ca AS ({_CUTS.format(side='a')}), cb AS ({_CUTS.format(side='b')}), ma AS ({MERGE_SQL.format(by='record_id', source='a')}), mb AS ({MERGE_SQL.format(by='record_id', source='b')}),
  na AS (SELECT record_id, sum(span_end - span_start) AS n FROM ma GROUP BY 1), nb AS (SELECT record_id, sum(span_end - span_start) AS n FROM mb GROUP BY 1),
  x AS (SELECT ma.record_id, sum(least(ma.span_end, mb.span_end) - greatest(ma.span_start, mb.span_start)) AS n FROM ma JOIN mb ON ma.record_id = mb.record_id AND least(ma.span_end, mb.span_end) > greatest(ma.span_start, mb.span_start) GROUP BY 1),
  j AS (SELECT coalesce(ca.record_id, cb.record_id) AS record_id, coalesce(ca.cuts, []) AS l, coalesce(cb.cuts, []) AS m FROM ca FULL JOIN cb ON ca.record_id = cb.record_id)
  SELECT record_id, round_even(len(list_intersect(l, m)) / len(list_distinct(list_concat(l, m))), 9) AS boundary_jaccard, round_even(coalesce(x.n, 0) / (coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(x.n, 0)), 9) AS span_jaccard, pa.ps = pb.ps AS same_pieces
  FROM j LEFT JOIN na USING (record_id) LEFT JOIN nb USING (record_id) LEFT JOIN x USING (record_id) JOIN pa USING (record_id) JOIN pb USING (record_id)"""


@query(COMPARED_SQL)
def chunker_comparison(spark, root):
    from evigrain.operators import comparison

    docs = documents_as_records(spark, root)
    out = comparison.compare(chunking.chunk(docs, "sentence", max_words=120), chunking.chunk(docs, "fixed", size=120, overlap=0))
    return out.select("record_id", F.bround("boundary_jaccard", 9).alias("boundary_jaccard"), F.bround("span_jaccard", 9).alias("span_jaccard"), "same_pieces")
