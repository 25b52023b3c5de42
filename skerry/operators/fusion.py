"""Rank fusion, de-duplication and selection of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ``(query_id, id, rank)`` lists.

    One aggregation over the union instead of a full outer join. Ties: dense rank first, then sparse
    rank. The shown score has four decimals, rounded after ranking.
    """
    both = dense.select("query_id", "id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).unionByName(sparse.select("query_id", "id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("s")))
    g = both.groupBy("query_id", "id").agg(F.min("d").alias("dense_rank"), F.min("s").alias("bm25_rank"))
    score = F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("bm25_rank")), F.lit(0.0))
    g = g.withColumn("raw", score)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    g = g.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        g = g.where(F.col("rank") <= top_k)
    return g.select("query_id", "id", "rank", F.round("raw", 4).alias("score"), "dense_rank", "bm25_rank")


def drop_contained(hits: DataFrame) -> DataFrame:
    """Keep ``hits(query_id, file_path, start_line, end_line, pos, …)`` that no better-placed hit of the
    same file covers. Covering is transitive, so a single anti-join equals the greedy pass."""
    o = hits.select("query_id", "file_path", F.col("start_line").alias("s2"), F.col("end_line").alias("e2"), F.col("pos").alias("p2"))
    cover = (hits.query_id == o.query_id) & (hits.file_path == o.file_path) & (o.p2 < hits.pos) & (o.s2 <= hits.start_line) & (o.e2 >= hits.end_line)
    return hits.join(o, cover, "left_anti")


def first_by_key(parts: list[DataFrame], key: list[str], query: str = "query_id") -> DataFrame:
    """Ordered union: of rows with the same key the one from the earliest part, and there the earliest
    position, stays. Each part needs ``pos``."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    n = F.row_number().over(W.partitionBy(query, *key).orderBy("part", "pos"))
    out = out.withColumn("n", n).where("n = 1").drop("n")
    return out.withColumn("pos", F.row_number().over(W.partitionBy(query).orderBy("part", "pos"))).drop("part")


def diversify(hits: DataFrame) -> DataFrame:
    """Selection by concern: ``hits(query_id, pos, concern, requested array, k)``.

    If a query asks for two or more concerns, the best hit of each comes first, in the order asked
    for, and the rest fills up to k by position; else the first k. Adds ``slot``.
    """
    many = F.size("requested") > 1
    c = W.partitionBy("query_id", "concern").orderBy("pos")
    asked = F.array_position("requested", F.col("concern"))
    lead = many & (asked > 0) & (F.row_number().over(c) == 1)
    h = hits.withColumn("lead", F.coalesce(lead, F.lit(False))).withColumn("asked", asked)
    w = W.partitionBy("query_id")
    h = h.withColumn("leads", F.sum(F.col("lead").cast("int")).over(w))
    h = h.withColumn("slot", F.row_number().over(w.orderBy(F.desc("lead"), F.when(F.col("lead"), F.col("asked")), "pos")))
    return h.where(F.col("lead") | (F.col("slot") <= F.col("k"))).drop("lead", "asked", "leads")


def complement(hits: DataFrame, spare: DataFrame, key: list[str], score: float = 0.85) -> DataFrame:
    """Rows of ``spare`` (with ``pos``) that fill queries whose ``hits(query_id, k, n)`` fall short of k."""
    need = hits.groupBy("query_id").agg(F.count("*").alias("have"))
    open_ = spare.join(hits.select("query_id", *key), ["query_id", *key], "left_anti").join(need, "query_id", "left")
    r = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    return open_.withColumn("r", r).where(F.col("r") + F.coalesce("have", F.lit(0)) <= F.col("k")).drop("r", "have").withColumn("score", F.lit(score))


#: The text forms of hits of both searches, with the header and the notice for no hits.
TEXT_FORMS = {
    "hybrid": ("Hybrid Search", "[Match (RRF Score: %.4f)]"),
    "vector": ("Vector Search", "[Candidate Match (Score: %.2f) | Repo: %s]"),
}


def render(hits: DataFrame, requests: DataFrame, form: str = "hybrid", most: int = 3) -> DataFrame:
    """``(query_id, shown)``: the ``most`` best of ``hits(query_id, rank, score, repo_id, file_path, start_line,
    end_line, name, kind, content)`` as text, for every one of ``requests(query_id, query, dept_id, repo_id)``.

    Rows are cut before they are gathered; null fields are shown as unknown, null queries as empty.
    """
    title, match = TEXT_FORMS[form]
    cell = lambda c, none="unknown": F.coalesce(F.col(c).cast("string"), F.lit(none))
    head = F.format_string("\n" + match + "\n", F.col("score"), *([cell("repo_id")] if form == "vector" else []))
    place = F.concat(F.lit("File: "), cell("file_path"), F.lit(" (Lines "), cell("start_line", "0"), F.lit("-"), cell("end_line", "0"), F.lit(")\n"))
    block = F.concat(F.lit("Block Name: '"), cell("name", "anonymous"), F.lit("' ("), cell("kind"), F.lit(")\nContent:\n"), cell("content", ""), F.lit("\n"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "file_path", "start_line"))
    few = hits.withColumn("r", r).where(F.col("r") <= most).select("query_id", "r", F.concat(head, place, block).alias("x"))
    body = few.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", "x")))["x"], "").alias("body"))
    scope = F.concat(cell("dept_id"), F.lit("/"), cell("repo_id"))
    shown = F.concat(F.lit(f"--- {title} Results for '"), cell("query", ""), F.lit("' ["), scope, F.lit("] ---\n"), F.col("body"))
    none = F.concat(F.lit("[INFO] No relevant code found for query: '"), cell("query", ""), F.lit("' in "), scope)
    return requests.select("query_id", "query", "dept_id", "repo_id").join(body, "query_id", "left").select("query_id", F.when(F.col("body").isNull(), none).otherwise(shown).alias("shown"))
