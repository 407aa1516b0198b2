"""Retrieval over chunks: dense, lexical or fused, with a section filter below the ranking; evidence and certificates."""

from __future__ import annotations

import hashlib
import json
import platform
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from evigrain.functions import vectors as V
from evigrain.operators import search


@dataclass(frozen=True)
class Settings:
    """What a retrieval depends on besides the corpus."""

    mode: str = "hybrid"
    k: int = 20
    section_filter: tuple[str, ...] = ()
    rrf_k: int = 60
    overfetch: int = 4
    dimension: int = 256
    ngram: int = 4
    index: str = "flat"
    index_params: dict = field(default_factory=dict)
    chunker: str = "sentence/v1(max_words=180)"

    def specs(self) -> dict[str, str]:
        inner = ",".join(f"{k}={v}" for k, v in sorted(self.index_params.items()))
        return {"embedder": f"hash/v1(dim={self.dimension},ngram={self.ngram},prec=6,norm=l2)", "index": f"{self.index}/v1({inner})", "chunker": self.chunker}


def embedded(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """chunk_id, v: the chunks' vectors, to be written once and given to every retrieval with the same settings."""
    return chunks.where("chunk_id IS NOT NULL").select("chunk_id", V.hash_embedding(F.col("text"), settings.dimension, settings.ngram).alias("v"))


def retrieve(chunks: DataFrame, queries: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank_no. ``chunks``: chunk_id, text, section; ``queries``: query_id, query_text. The
    section filter is applied before anything is embedded or ranked, so k results come if the pool has them. ``vectors``:
    what ``embedded`` gave, so that the corpus isn't embedded again."""
    if settings.mode not in ("dense", "lexical", "hybrid"):
        raise ValueError(f"unknown mode {settings.mode!r}")
    pool = chunks.select("chunk_id", "text", "section").where("chunk_id IS NOT NULL")
    if settings.section_filter:
        pool = pool.where(F.col("section").isin(list(settings.section_filter)))
    lists = []
    fetch = settings.k * settings.overfetch if settings.section_filter and settings.mode == "hybrid" else settings.k
    if settings.mode in ("dense", "hybrid"):
        v = embedded(pool, settings) if vectors is None else vectors.join(pool.select("chunk_id"), "chunk_id", "left_semi") if settings.section_filter else vectors
        q = queries.select("query_id", V.hash_embedding(F.col("query_text"), settings.dimension, settings.ngram).alias("q"))
        kwargs = {"dimension": settings.dimension} if settings.index == "lsh" else {}
        lists.append(search.build_index(settings.index, **settings.index_params)(v, q, fetch, key="chunk_id", **kwargs))
    if settings.mode in ("lexical", "hybrid"):
        lists.append(search.bm25(pool, queries, fetch, key="chunk_id"))
    out = search.fuse(lists, settings.k, settings.rrf_k, key="chunk_id") if len(lists) > 1 else lists[0]
    return out.select("query_id", "chunk_id", "score", F.col("rank_no").cast("int").alias("rank_no"))


def evidence_digest(hits: DataFrame, by: list[str]) -> DataFrame:
    """by..., digest: SHA-256 over 'rank:id' in rank order, each list being at most k long."""
    listed = F.array_sort(F.collect_list(F.struct("rank_no", "chunk_id")))
    return hits.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda s: F.concat(s["rank_no"].cast("string"), F.lit(":"), s["chunk_id"])), ""), 256).alias("digest"))


def digest_of(chunk_ids: list[str]) -> str:
    return hashlib.sha256("".join(f"{i}:{c}" for i, c in enumerate(chunk_ids, 1)).encode()).hexdigest()


def _version(name: str) -> str | None:
    from importlib.metadata import PackageNotFoundError, version

    try:
        return version(name)
    except PackageNotFoundError:
        return None


def issue(query: str, chunk_ids: list[str], corpus_hash: str, settings: Settings, corpus_size: int | None = None, notes: dict | None = None) -> dict:
    """The certificate of one evidence set."""
    return {
        "query": query, "mode": settings.mode, "k": settings.k, "section_filter": sorted(settings.section_filter), **settings.specs(), "corpus_hash": corpus_hash, "corpus_size": corpus_size,
        "chunk_ids": list(chunk_ids), "evidence_digest": digest_of(list(chunk_ids)), "determinism": {"seed": 42, "vector_precision": 6, "score_precision": 9},
        "environment": {"python": platform.python_version(), "system": platform.system(), **{name: _version(name) for name in ("pyspark", "numpy", "pandas", "pyarrow")}}, "created_at": datetime.now(timezone.utc).isoformat(), "notes": notes or {},
    }


def verify(certificate: dict, query: str, chunk_ids: list[str], corpus_hash: str, settings: Settings, corpus_size: int | None = None) -> dict:
    """What differs between a certificate and a rerun: the components, ids missing and new, and whether only the order
    changed. The section filter is compared too."""
    now = issue(query, chunk_ids, corpus_hash, settings, corpus_size)
    names = ["corpus_hash", "embedder", "index", "chunker", "query", "mode", "k", "section_filter", "evidence_digest"] + (["corpus_size"] if corpus_size is not None and certificate.get("corpus_size") is not None else [])
    wrong = [n for n in names if certificate.get(n) != now[n]]
    before = list(certificate["chunk_ids"])
    return {"verified": not wrong, "mismatches": wrong, "missing": [c for c in before if c not in set(chunk_ids)], "added": [c for c in chunk_ids if c not in set(before)], "reordered_only": before != list(chunk_ids) and sorted(before) == sorted(chunk_ids)}


def drift(issued: Column, rerun: Column) -> Column:
    """What differs between the ids of an issued evidence set and of its rerun: how many are missing and added, whether
    only the order changed, whether nothing did."""
    return F.struct(
        F.size(F.array_except(issued, rerun)).alias("n_missing"), F.size(F.array_except(rerun, issued)).alias("n_added"),
        ((issued != rerun) & (F.array_sort(issued) == F.array_sort(rerun))).alias("reordered_only"), (issued == rerun).alias("verified"),
    )


def save_certificate(certificate: dict, path: str) -> None:
    Path(path).write_text(json.dumps(certificate, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")


def load_certificate(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def settings_dict(settings: Settings) -> dict:
    return asdict(settings)
