"""Keeping tables in step with change events, as a batch and as a stream.

``events(path, op, ts, text)``, op in added, modified, removed. Within a batch the last event of a path
decides (at equal times removed comes first, so an add of the same moment wins).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skerry.operators import dense, extract, sparse
from skerry.session import materialize


def last_events(events: DataFrame) -> DataFrame:
    """The deciding event of each path."""
    best = events.where("path is not null").groupBy("path").agg(F.max_by(F.struct("op", "text", "ts"), F.struct("ts", F.expr("if(op = 'removed', 0, 1)"), F.coalesce(F.md5("text"), F.lit("")))).alias("x"))
    return best.select("path", "x.op", "x.ts", "x.text")


def apply_changes(files: DataFrame, events: DataFrame) -> DataFrame:
    """``files(path, text)`` after the events: removed paths go, the others are replaced or added."""
    last = last_events(events)
    kept = files.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("op <> 'removed'").select("path", "text"))


def change_counts(events: DataFrame) -> DataFrame:
    last = last_events(events)
    n = lambda op: F.count_if(F.col("op") == op).alias(op)
    return last.agg(n("added"), n("modified"), n("removed"))


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, op)`` between two listings ``(path, hash)``: the way a poller finds changes, deletions
    included."""
    b, a = before.select("path", F.col("hash").alias("h0")), after.select("path", F.col("hash").alias("h1"))
    j = b.join(a, "path", "full_outer")
    op = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "modified")
    return j.select("path", op.alias("op")).where("op is not null")


def push_events(pushes: DataFrame) -> DataFrame:
    """Events of push messages ``(pushed_at, commits array<struct<added, modified, removed: array<string>>>)``;
    within a push removals come first."""
    c = pushes.select("pushed_at", F.explode("commits").alias("c"))
    parts = [c.select(F.explode(f"c.{op}").alias("path"), F.lit(op).alias("op"), F.col("pushed_at").alias("ts")) for op in ("added", "modified", "removed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def needs_reindex(manifest: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories whose commit differs from the indexed one, or whose index is empty."""
    j = heads.join(manifest, "repo_id", "left")
    return j.where("indexed_sha is null or indexed_sha <> sha or coalesce(blocks, 0) = 0").select("repo_id")


def stream_changes(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of change events to a Parquet table ``(path, text)``.

    Every micro-batch writes a new version next to the table and then names it in ``CURRENT``, so a
    lost executor or a repeated batch leaves readers on a whole version.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = current_version(batch, table_path)
        files = spark.read.parquet(now) if now else spark.createDataFrame([], "path string, text string")
        target = f"{table_path}/v{batch_id}"
        apply_changes(files, batch).write.mode("overwrite").parquet(target)
        spark.createDataFrame([(batch_id, target)], "version long, at string").coalesce(1).write.mode("append").parquet(f"{table_path}/CURRENT")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_version(frame: DataFrame, table_path: str) -> str | None:
    """Folder of the newest version, or None before the first."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/CURRENT")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{table_path}/CURRENT").orderBy(F.desc("version")).first()["at"]


# --- an index kept in step ------------------------------------------------------------------------------


def index_of(files: DataFrame) -> dict[str, DataFrame]:
    """Blocks, edges, postings and vectors of ``files(path, text)``.

    ``blocks(block_id, path, kind, name, start_line, end_line, content)``, ``edges(path, …)``, ``postings(path, id,
    term, tf)``, ``vectors(path, id, vector)``; the id of a block is a hash of its path, place and name. Null paths
    are dropped; null and empty texts give nothing.
    """
    f = files.where("path is not null")
    cols = ["path", "kind", "name", "start_line", "end_line", "content"]
    found = extract.scan_blocks(f, ["path"], path="path")
    whole = extract.module_blocks(f, found, "path", ["path"]).withColumn("name", F.lit(None).cast("string"))
    b = found.select(cols).unionByName(whole.select(cols)).withColumn("block_id", F.xxhash64("path", "start_line", F.coalesce("name", F.lit("")), "kind"))
    # written once: four tables are made of the blocks
    b = materialize(b, "index_blocks")
    edges = extract.import_edges(f, path="path", keep=("path",)).unionByName(extract.call_edges(b.withColumn("file_path", F.col("path")), keep=("path",)))
    edges = materialize(edges, "index_edges").distinct()
    return {"blocks": b, "edges": edges, **_derived(b)}


def _derived(blocks: DataFrame) -> dict[str, DataFrame]:
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("content", F.lit("")))
    of = blocks.select(F.col("block_id").alias("id"), "path")
    return {"postings": sparse.postings(blocks, "block_id", text).join(of, "id").select("path", "id", "term", "tf"), "vectors": embed(blocks)}


def embed(blocks: DataFrame, have: DataFrame | None = None, embedder=dense.hashed_embedding) -> DataFrame:
    """``(path, id, vector)`` of the blocks that ``have(id)`` lacks: what a background job adds to the vectors.
    ``embedder(frame, id column, text)`` may be any model."""
    todo = blocks if have is None else blocks.join(have.select(F.col("id").alias("block_id")).distinct(), "block_id", "left_anti")
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("content", F.lit("")))
    return embedder(todo, "block_id", text).join(todo.select(F.col("block_id").alias("id"), "path"), "id").select("path", "id", "vector")


def refresh(index: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """The index after change events: rows of changed paths go from every table, and those of their new texts
    come in. Only changed texts are read; equals the index of the changed files."""
    last = last_events(events)
    changed = last.select("path")
    new = index_of(last.where("op <> 'removed'").select("path", "text"))
    return {k: materialize(t.join(changed, "path", "left_anti").unionByName(new[k].select(t.columns)), f"index_{k}") for k, t in index.items()}


def stream_deltas(events: DataFrame, table_path: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Apply a stream of change events to a table ``(path, text)`` of a base and deltas.

    A micro-batch writes its deciding events only; every ``compact_every`` batches base and deltas become a new
    base, after which the old ones are deleted. ``read_deltas`` merges on reading. A repeated batch
    overwrites its own folder, so a lost executor costs nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        last_events(batch).write.mode("overwrite").parquet(f"{table_path}/delta-{batch_id:012d}")
        _, deltas = _versions(batch.sparkSession, table_path)
        if len(deltas) >= compact_every:
            read_deltas(batch.sparkSession, table_path).write.mode("overwrite").parquet(f"{table_path}/base-{batch_id:012d}")
            _forget(batch.sparkSession, table_path, batch_id)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _listed(spark, table_path: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if done(s.getPath()))


def _versions(spark, table_path: str) -> tuple[str | None, list[str]]:
    """(newest whole base, deltas after it)."""
    names = _listed(spark, table_path)
    base = max((n for n in names if n.startswith("base-")), default=None)
    after = base[5:] if base else ""
    return base, [n for n in names if n.startswith("delta-") and n[6:] > after]


def _forget(spark, table_path: str, batch_id: int) -> None:
    for n in _listed(spark, table_path):
        kind, _, no = n.partition("-")
        if (kind == "delta" and int(no) <= batch_id) or (kind == "base" and int(no) < batch_id):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_deltas(spark, table_path: str) -> DataFrame:
    """``(path, text)`` of the table now: the newest delta of a path decides, else the base."""
    base, deltas = _versions(spark, table_path)
    files = spark.read.parquet(f"{table_path}/{base}") if base else spark.createDataFrame([], "path string, text string")
    if not deltas:
        return files
    parts = [spark.read.parquet(f"{table_path}/{d}").select("path", "op", "text", F.lit(i).alias("no")) for i, d in enumerate(deltas)]
    last = reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.max_by(F.struct("op", "text"), "no").alias("x")).select("path", "x.op", "x.text")
    return files.join(last.select("path"), "path", "left_anti").unionByName(last.where("op <> 'removed'").select("path", "text"))
