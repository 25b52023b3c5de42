"""Cosine top-k of a stated query set against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skerry.functions.text import tokens

#: Queries that go to every task; more are packed in blocks of BLOCK that meet the vectors, packed alike.
HELD, BLOCK = 8192, 2048


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.asarray(col.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    x = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok] / norm[ok][:, None]


def _top(q: np.ndarray, x: np.ndarray, order: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors of each query; ``order`` decides between equal scores."""
    s = np.round(q @ x.T, 6)
    m = min(k, s.shape[1])
    cut = -np.partition(-s, m - 1, axis=1)[:, m - 1]
    i, j = (s >= np.maximum(cut, threshold)[:, None]).nonzero()
    by = np.lexsort((order[j], -s[i, j], i))
    i, j = i[by], j[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < m
    return i[keep], j[keep], s[i[keep], j[keep]]


def _ranks(ids: pa.Array) -> np.ndarray:
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return order


def _groups(by: pa.Array | None, n: int) -> Iterator[tuple[object, np.ndarray]]:
    if by is None:
        yield None, np.arange(n)
        return
    codes = by.dictionary_encode()
    at = np.asarray(codes.indices.fill_null(-1))
    for g in np.unique(at):
        yield (None if g < 0 else codes.dictionary[int(g)].as_py()), np.flatnonzero(at == g)


def _best(batches: Iterator[pa.RecordBatch], q: np.ndarray, qid: pa.Array, k: int, threshold: float, dim: int, by: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, x = _matrix(b.column("vector"), dim)
        ids = b.column("id").take(pa.array(rows))
        order = _ranks(ids)
        for g, at in _groups(b.column("by").take(pa.array(rows)) if by is not None else None, len(rows)):
            if len(at):
                i, j, s = _top(q, x[at], order[at], k, threshold)
                cols = [qid.take(pa.array(i)), ids.take(pa.array(at[j])), pa.array(s)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([g] * len(i), by)] if by is not None else []), ["query_id", "id", "score"] + (["by"] if by is not None else []))


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(ids, blob[, by]): BLOCK unit vectors a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            rows, x = _matrix(b.column("vector"), dim)
            if len(rows):
                cols = [b.column(c).take(pa.array(rows)) for c in b.schema.names if c != "vector"]
                one = pa.array([0, len(rows)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(one, c) for c in cols), pa.array([x.tobytes()], pa.binary())], [*(c for c in b.schema.names if c != "vector"), "blob"])


def _meet(batches: Iterator[pa.RecordBatch], k: int, threshold: float, dim: int, by: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            q, x = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(-1, dim) for c in ("q_blob", "blob"))
            qid, ids = b.column("query_id")[r].values, b.column("id")[r].values
            order = _ranks(ids)
            for g, at in _groups(b.column("by")[r].values if by is not None else None, len(ids)):
                i, j, s = _top(q, x[at], order[at], k, threshold)
                cols = [qid.take(pa.array(i)), ids.take(pa.array(at[j])), pa.array(s)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([g] * len(i), by)] if by is not None else []), ["query_id", "id", "score"] + (["by"] if by is not None else []))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, dim: int = 384, drop_self: bool = False, by: str | None = None, held: int = HELD) -> DataFrame:
    """``(query_id, id, score, rank)`` of ``vectors(id, vector)`` for ``queries(query_id, vector)``.

    Vectors that are null, of another length, zero or not finite take no part. Scores have six
    decimals; ties go to the smaller id. The filter of the caller (tenant, repository) is applied
    before: a pushed-down predicate on ``vectors``. With ``by``, a column of ``vectors`` (a collection each), the
    k best of each collection are given, and ranked there. Up to ``held`` queries go to all tasks; more stay
    distributed: blocks of queries meet blocks of vectors, a matrix product each.
    """
    spark = vectors.sparkSession
    id_t, q_t = (d.schema[c].dataType.simpleString() for d, c in ((vectors, "id"), (queries, "query_id")))
    cols, ddl, by_type = ["id"], f"query_id {q_t}, id {id_t}, score double", None
    src = vectors.select("id", "vector")
    if by:
        src = vectors.select("id", F.col(by).alias("by"), "vector")
        ddl += f", by {vectors.schema[by].dataType.simpleString()}"
        by_type = to_arrow_type(vectors.schema[by].dataType)
        cols.append("by")
    asked = queries.select("query_id", "vector")
    want = k + (1 if drop_self else 0)
    if queries.count() <= held:
        block = asked.toArrow()
        rows, q = _matrix(block.column("vector").combine_chunks(), dim) if block.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
        if not len(rows):
            return spark.createDataFrame([], f"query_id {q_t}, id {id_t}, score double, rank int" + (f", {by} {vectors.schema[by].dataType.simpleString()}" if by else ""))
        qid = block.column("query_id").combine_chunks().take(pa.array(rows))
        hits = src.mapInArrow(lambda it: _best(it, q, qid, want, threshold, dim, by_type), ddl)
    else:
        mine = asked.mapInArrow(lambda it: _pack(it, dim), f"query_id array<{q_t}>, blob binary").withColumnRenamed("blob", "q_blob")
        theirs = src.mapInArrow(lambda it: _pack(it, dim), f"id array<{id_t}>, " + (f"by array<{vectors.schema[by].dataType.simpleString()}>, " if by else "") + "blob binary")
        hits = theirs.crossJoin(mine).mapInArrow(lambda it: _meet(it, want, threshold, dim, by_type), ddl)
    hits = hits.distinct()
    if drop_self:
        hits = hits.where(F.col("query_id").cast("string") != F.col("id").cast("string"))
    part = ["query_id"] + (["by"] if by else [])
    rank = F.row_number().over(W.partitionBy(*part).orderBy(F.desc("score"), F.asc("id")))
    out = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.withColumnRenamed("by", by) if by else out


def hashed_embedding(docs: DataFrame, id_col: str, text, dim: int = 384) -> DataFrame:
    """``(id, vector)``: a stand-in embedder (hashed token counts, signed); any frame of that shape
    from a real model can take its place."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, dim), np.float32)
            h = b.column("h")
            size = np.asarray(h.value_lengths().fill_null(0))
            flat = h.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            np.add.at(out, (np.repeat(np.arange(b.num_rows), size), (flat % np.uint64(dim)).astype(int)), np.where(flat >> np.uint64(63), 1.0, -1.0))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(out), pa.list_(pa.float32()))], ["id", "vector"])

    src = docs.select(F.col(id_col).alias("id"), F.transform(tokens(text), lambda x: F.xxhash64(x)).alias("h"))
    return src.mapInArrow(embed, f"id {src.schema['id'].dataType.simpleString()}, vector array<float>")
