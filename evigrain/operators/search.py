"""Top-k search: exact, random-projection LSH, inverted file with product quantisation; BM25; rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from evigrain.functions import text as T
from evigrain.functions.vectors import dot, seeded, unit
from evigrain.session import cut

#: Query vectors are broadcast while they are at most so many; a larger query set goes through in blocks of that size.
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that have a vector without null, NaN or infinite numbers, as (key, v)."""
    v = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(f"{key} IS NOT NULL AND size(v) > 0")
    return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def ranked(scored: DataFrame, k: int, query: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """The k best of each query, ties to the smaller key. Each partition keeps k a query before the shuffle."""
    w = W.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def rows_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows of that length, their vectors) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    at = np.flatnonzero(lengths == dimension)
    if not len(at):
        return at, np.zeros((0, dimension))
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1][at]
    return at, flat[starts[:, None] + np.arange(dimension)]


def scores_of(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows by queries; the larger the nearer."""
    if metric == "cosine":
        x, q = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n) for m in (x, q))
    if metric == "l2":
        return -np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in q], axis=1) if len(q) else np.zeros((len(x), 0))
    return x @ q.T


def exact(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 9, key: str = "id", query: str = "query_id") -> DataFrame:
    """query_id, id, score, rank_no by a full scan: the queries (a stated set) go in blocks of at most QUERY_BLOCK
    against all vectors. A block goes to the executors as one matrix; each task multiplies batch by batch and keeps the
    k best of each query with the ties at the end, so what is shuffled is at most k rows a query and task (and ties).

    ``vectors``: (key, v), ``queries``: (query, q), both from usable. A length that differs from the query's gives no score."""
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes) | dict(queries.dtypes)
    blocks = -(-max(1, queries.count()) // QUERY_BLOCK)
    schema = f"{query} {kinds[query]}, {key} {kinds[key]}, score double"
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        rows = block.select(query, "q").collect()  # at most about QUERY_BLOCK
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r[1]), []).append(r)
        held = spark.sparkContext.broadcast([(d, [r[0] for r in part], np.array([r[1] for r in part], float)) for d, part in by_size.items()])

        def scan(parts, held=held):
            best: dict = {}
            types = None
            for part in parts:
                types = part.schema.field(0).type
                for d, names, q in held.value:
                    at, x = rows_of(part.column(1), d)
                    if not len(at):
                        continue
                    ids = part.column(0).take(pa.array(at)).to_pylist()
                    s = np.round(scores_of(x, q, metric), digits)
                    for j, name in enumerate(names):
                        c = s[:, j]
                        old = best.get(name)
                        bar = max(np.partition(c, len(c) - k)[len(c) - k] if len(c) > k else -np.inf, old[2] if old else -np.inf)
                        new = np.flatnonzero(c >= bar)
                        if not len(new):
                            continue
                        i = (old[0] if old else []) + [ids[n] for n in new]
                        v = np.concatenate([old[1], c[new]]) if old else c[new]
                        if len(i) > k:
                            bar = np.partition(v, len(v) - k)[len(v) - k]
                            stay = np.flatnonzero(v >= bar)
                            if len(stay) > 4 * k:  # many ties: the smaller keys are enough
                                stay = np.array(sorted(stay, key=lambda n: (-v[n], i[n]))[:k])
                            i, v = [i[n] for n in stay], v[stay]
                        best[name] = i, v, bar if len(i) >= k else -np.inf
            if types is not None:
                flat = [(n, i, float(s)) for n, (ids, v, _) in best.items() for i, s in zip(ids, v)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], name_type), pa.array([f[1] for f in flat], types), pa.array([f[2] for f in flat], pa.float64())], [query, key, "score"])

        name_type = to_arrow_type(queries.schema[query].dataType)
        one = ranked(vectors.select(key, "v").mapInArrow(scan, schema), k, query, key)
        out = one if out is None else out.unionByName(one)
    return out


def planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """Normal planes of each table, from the seed, 'lsh' and the table's number."""
    return np.stack([seeded(seed, "lsh", t).standard_normal((bits, dimension)) for t in range(tables)])


def signatures(vectors: DataFrame, normals: np.ndarray, key: str = "id", vector: str = "v") -> DataFrame:
    """key, table_no, code: bit i of the code is set where the vector lies on the positive side of plane i. Vectors of
    another length than the planes have none."""
    tables, bits, _ = normals.shape
    flat = normals.reshape(tables * bits, -1)
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)

    @F.arrow_udf(ArrayType(LongType()))
    def codes(vs: pa.Array) -> pa.Array:
        at, x = rows_of(vs, flat.shape[1])
        out = np.full((len(vs), tables), -1, np.int64)
        out[at] = ((x @ flat.T > 0).reshape(len(at), tables, bits) * powers).sum(axis=2)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables).cast(pa.list_(pa.int64()))

    return vectors.select(key, F.posexplode(codes(vector)).alias("table_no", "code")).where("code >= 0")


def flips(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits."""
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def lsh(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 16, tables: int = 4, radius: int = 1, seed: int = 42, digits: int = 9, key: str = "id", query: str = "query_id", dimension: int = 64) -> DataFrame:
    """Candidates that share a bucket with the query in some table, or one up to ``radius`` bits away; re-ranked by
    exact cosine. Buckets meet by an equality join."""
    v, q = vectors.withColumn("v", unit(F.col("v"))), queries.withColumn("q", unit(F.col("q")))
    normals = planes(dimension, bits, tables, seed)
    codes = signatures(v, normals, key)
    asked = signatures(q.withColumnRenamed("q", "v"), normals, query).select(query, "table_no", F.explode(F.transform(F.lit(flips(bits, radius)), lambda m: F.col("code").bitwiseXOR(m))).alias("code"))
    pairs = codes.join(asked, ["table_no", "code"]).select(query, key).distinct()
    scored = pairs.join(v, key).join(q, query).select(query, key, F.bround(dot(F.col("v"), F.col("q")), digits).alias("score"))
    return ranked(scored, k, query, key)


def ivf(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 100, probes: int = 8, parts: int = 0, sample: int = 20_000, seed: int = 42, digits: int = 9, key: str = "id", query: str = "query_id") -> DataFrame:
    """Inverted file: the vectors of the ``probes`` cells nearest the query, ranked by exact cosine. With ``parts``,
    product-quantised scores first drop the vectors that can't be among the k: the score of a code is off by at most the
    vector's distance from it, which bounds the true one from both sides, so none of the k is lost. Centroids and codebooks are fitted on a
    seeded sample of at most ``sample`` rows; every row is indexed."""
    spark = vectors.sparkSession
    v, q = vectors.withColumn("v", unit(F.col("v"))), queries.withColumn("q", unit(F.col("q")))
    total = max(1, v.count())
    rate = int(min(1.0, 1.2 * sample / total) * (1 << 40))
    rows = v.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) < rate).select(key, "v").orderBy(key).limit(sample).toPandas()
    x = np.stack(rows["v"].to_numpy()) if len(rows) else np.zeros((1, 1))
    rng = seeded(seed, "ivf")

    def means(data: np.ndarray, n: int) -> np.ndarray:
        c = data[rng.choice(len(data), min(n, len(data)), replace=False)]
        for _ in range(8):
            near = np.argmin((c * c).sum(1)[None] - 2 * data @ c.T, axis=1)
            c = np.stack([data[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        return c

    centroids = means(x, cells)
    probes = min(probes, len(centroids))
    books = [means(x[:, s], 256) for s in np.array_split(np.arange(x.shape[1]), parts)] if parts else []
    shared = spark.sparkContext.broadcast((centroids, books))

    @F.pandas_udf("array<int>")
    def cell(vs: pd.Series, most: pd.Series) -> pd.Series:
        c, _ = shared.value
        if not len(vs):
            return pd.Series([], dtype=object)
        d = (c * c).sum(1)[None] - 2 * np.stack(vs.to_numpy()) @ c.T
        n = int(most.iloc[0])
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    def slices(books: list, dimension: int) -> list:
        return list(zip(np.array_split(np.arange(dimension), len(books)), books))

    @F.pandas_udf("struct<code:array<int>,off:double>")
    def coded(vs: pd.Series) -> pd.DataFrame:
        _, books = shared.value
        if not len(vs):
            return pd.DataFrame({"code": pd.Series([], dtype=object), "off": pd.Series([], dtype=float)})
        a = np.stack(vs.to_numpy())
        codes = np.stack([np.argmin((book * book).sum(1)[None] - 2 * a[:, s] @ book.T, axis=1) for s, book in slices(books, a.shape[1])], axis=1)
        off = sum(((a[:, s] - book[codes[:, i]]) ** 2).sum(1) for i, (s, book) in enumerate(slices(books, a.shape[1])))
        return pd.DataFrame({"code": list(codes.astype(np.int32)), "off": np.sqrt(off)})

    @F.pandas_udf("double")
    def coarse(codes: pd.Series, qs: pd.Series) -> pd.Series:
        _, books = shared.value
        if not len(codes):
            return pd.Series([], dtype=float)
        c, b = np.stack(codes.to_numpy()), np.stack(qs.to_numpy())
        return pd.Series(sum((book[c[:, i]] * b[:, s]).sum(1) for i, (s, book) in enumerate(slices(books, b.shape[1]))))

    lists = v.select(key, "v", cell("v", F.lit(1))[0].alias("cell"), *([coded("v").alias("pq")] if parts else []))
    asked = q.select(query, "q", F.explode(cell("q", F.lit(probes))).alias("cell"))
    met = lists.join(F.broadcast(asked.limit(QUERY_BLOCK * probes)), "cell") if queries.count() <= QUERY_BLOCK else lists.join(asked, "cell")
    if parts:
        met = met.withColumn("near", coarse("pq.code", "q"))
        # k vectors score at least so much, whatever their codes lost; the margin covers scores that rounding makes equal
        sure = ranked(met.select(query, key, (F.col("near") - F.col("pq.off")).alias("score")), k, query, key)
        bars = sure.where(F.col("rank_no") == k).select(query, F.col("score").alias("bar"))
        met = met.join(bars, query, "left").where(F.col("bar").isNull() | (F.col("near") + F.col("pq.off") >= F.col("bar") - 1e-8))
    return ranked(met.select(query, key, F.bround(dot(F.col("v"), F.col("q")), digits).alias("score")), k, query, key)


def postings(texts: DataFrame, key: str, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """term, key, tf, dl: how often a text has a term (of ``terms``, if given), and its length in tokens."""
    toks = texts.select(key, T.tokens(text).alias("_t")).withColumn("dl", F.size("_t"))
    rows = toks.select(key, "dl", F.explode("_t").alias("term"))
    rows = rows if terms is None else rows.join(terms, "term", "left_semi")
    return rows.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: n texts and their mean length."""
    return texts.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.tokens(text))).alias("avgdl"))


def bm25(texts: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 9, key: str = "id", query: str = "query_id", text: str = "text", query_text: str = "query_text") -> DataFrame:
    """query_id, id, score, rank_no. Only the queries' terms are looked up in the texts; a term repeated in a query
    counts each time; only scores above 0 are kept."""
    asked = queries.select(query, F.explode(T.tokens(query_text)).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qf"))
    terms = asked.select("term").distinct()
    # only the queries' terms are grouped; the postings are used for their counts and for the scores
    posts = cut(postings(texts.select(key, F.col(text).alias("text")), key, terms=terms))
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = bm25_statistics(texts, text)
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats)).select(query, "term", "qf", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    length = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.lit(0.0))
    part = F.col("qf") * F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * length))
    scored = posts.join(weights, "term").select(query, key, part.alias("p")).groupBy(query, key).agg(F.bround(F.sum("p"), digits).alias("score")).where("score > 0")
    return ranked(scored, k, query, key)


def fuse(lists: list[DataFrame], k: int | None = None, rrf_k: int = 60, digits: int = 9, key: str = "id", query: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, key, rank_no)."""
    every = lists[0].select(query, key, "rank_no")
    for other in lists[1:]:
        every = every.unionByName(other.select(query, key, "rank_no"))
    summed = every.groupBy(query, key).agg(F.bround(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank_no"))), digits).alias("score"))
    return ranked(summed, k or (1 << 30), query, key)


#: Back ends and whether their results are exact; those that need a service or a native library are named, not faked.
BACKENDS = {"flat": True, "pgvector": True, "lsh": False, "ivf": False, "ivfpq": False}
UNAVAILABLE = ("hnsw", "qdrant", "chroma")


_OWN: dict[str, object] = {}


def register(name: str, make, exact: bool = False) -> None:
    """A back end of one's own: ``make(**params)`` gives a function (vectors, queries, k, **columns) -> ranked rows."""
    _OWN[name] = make
    BACKENDS[name] = exact


def checked(vectors: DataFrame, key: str = "id", vector: str = "v", dimension: int | None = None) -> int:
    """The vectors' common length; ValueError where there is none, an id is missing or there twice, or a vector has
    another length or a number that isn't finite. For callers that want wrong input refused; searches leave it out."""
    v = F.col(vector)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    seen = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("nameless"), F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(v.isNull() | odd).alias("odd"),
    ).collect()[0]
    wrong = [
        ("no vectors", seen.n == 0), ("ids missing", seen.nameless > 0), ("ids there twice", seen.nameless == 0 and seen.ids < seen.n), ("null vectors or numbers that aren't finite", seen.odd > 0),
        ("vectors of several lengths", seen.low != seen.high), (f"vectors of length {seen.high}, not {dimension}", dimension is not None and seen.high != dimension),
    ]
    if found := [what for what, so in wrong if so]:
        raise ValueError("; ".join(found))
    return seen.high


def build_index(name: str, **params):
    """A search function (vectors, queries, k) -> ranked rows, by name."""
    if name in _OWN:
        return _OWN[name](**params)
    if name in ("flat", "pgvector"):  # without an index of its own the latter scans, as the former does
        return lambda v, q, k, **kw: exact(v, q, k, **params, **kw)
    if name == "lsh":
        return lambda v, q, k, **kw: lsh(v, q, k, **params, **kw)
    if name in ("ivf", "ivfpq"):
        params = ({"parts": 8} if name == "ivfpq" else {}) | params
        return lambda v, q, k, **kw: ivf(v, q, k, **params, **kw)
    if name in UNAVAILABLE:
        raise NotImplementedError(f"back end {name!r} needs a service or library that isn't here; 'ivf' and 'ivfpq' are the native ones")
    raise ValueError(f"unknown back end {name!r}")
