"""The symbol store: upserts, look-ups, listings and statistics on plain frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.session import materialize

#: Symbols up to this many rows are broadcast; beyond, they meet the names in a shuffle join.
BROADCAST_ROWS = 400_000


def latest(rows: DataFrame, key: list[str], at: str, tie: list[str]) -> DataFrame:
    """The newest row of every key (upsert semantics): one aggregation, no window over hot keys."""
    cols = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(at, *tie)).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in cols])


def clear(rows: DataFrame, paths: DataFrame, key: list[str]) -> DataFrame:
    """Rows without those of the given files."""
    return rows.join(paths.select(*key).distinct(), key, "left_anti")


def escape_like(text):
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def find_symbol(blocks: DataFrame, wanted: DataFrame, exact: bool = True, limit: int = 20, scope: str | None = None) -> DataFrame:
    """``(query_id, symbol, block_id, name, file_path, start_line, rank)`` for ``wanted(query_id, symbol)``.

    Exact: equality of lower-cased names, an equi-join. Fuzzy: names that hold the symbol, ASCII case
    aside, exact ones first; wildcards in the symbol are literal.
    ``scope`` names a column of both frames (repository) that must agree.

    Every distinct symbol is answered once. Fuzzy: as the order goes by names first, the ``limit`` first distinct names
    of a symbol, with the ``limit`` first blocks of each, hold all that it can be given; names meet symbols
    on character trigrams before checking, so all names are never paired with all symbols.
    """
    also = [scope] if scope else []
    b = blocks.where("name <> ''").select("block_id", "name", "file_path", "start_line", *also)
    w = wanted.where("symbol <> ''").select("query_id", "symbol", *also, F.lower("symbol").alias("want")).distinct()
    one = w.select("want", *also).distinct()
    first = F.row_number().over(W.partitionBy("name", *also).orderBy("file_path", "start_line", "block_id"))
    b = b.withColumn("r", first).where(F.col("r") <= limit).drop("r").withColumn("low", F.lower("name"))
    if exact:
        hit = b.join(one.withColumn("low", F.col("want")), ["low", *also]).withColumn("same", F.lit(0))
    else:
        b = materialize(b, "symbol_names")
        names = b.select("name", "low", *also).distinct()
        one = materialize(one, "symbols")
        hint = F.broadcast if one.count() <= BROADCAST_ROWS else (lambda d: d)
        grams = lambda n: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substring(F.col("low"), i, F.lit(n)))))
        parts = []
        for n in (1, 2, 3):
            s = one.where(f"length(want) = {n}" if n < 3 else "length(want) >= 3").withColumn("g", F.substring("want", 1, n))
            have = names.where(f"length(low) >= {n}").select("name", "low", *also, grams(n).alias("g"))
            parts.append(have.join(hint(s), ["g", *also]).where("instr(low, want) > 0").select("want", "name", *also, (F.col("low") != F.col("want")).cast("int").alias("same")))
        found = parts[0].unionByName(parts[1]).unionByName(parts[2])
        n = F.row_number().over(W.partitionBy("want", *also).orderBy("same", "name"))
        found = found.withColumn("n", n).where(F.col("n") <= limit).drop("n")
        hit = found.join(b, ["name", *also])
    r = F.row_number().over(W.partitionBy("want", *also).orderBy("same", "name", "file_path", "start_line", "block_id"))
    hit = hit.withColumn("rank", r).where(F.col("rank") <= limit)
    return w.join(hit, ["want", *also]).select("query_id", "symbol", "block_id", "name", "file_path", "start_line", "rank")


def cross_repo(blocks: DataFrame, needle: str, column: str = "name", per_repo: int = 5) -> DataFrame:
    """At most ``per_repo`` blocks of every repository whose column holds the needle (case aside)."""
    hit = blocks.where(F.col(column).ilike("%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))
    r = F.row_number().over(W.partitionBy("repo_id").orderBy("name", "file_path", "start_line", "block_id"))
    return hit.withColumn("rank", r).where(F.col("rank") <= per_repo)


def insert_batch(rows: DataFrame, batch: DataFrame, files: list[str], key: list[str]) -> DataFrame:
    """Rows after a batch of symbols or edges: what the batch's files (columns ``files``) held before goes, and
    of a repeated ``key`` one stays. Null keys are dropped."""
    kept = clear(rows, batch, files)
    return kept.unionByName(batch.select(*rows.columns)).dropna(subset=key).dropDuplicates(key)


def confidence(hits: DataFrame, high: float = 0.8) -> DataFrame:
    """``(query_id, confidence, rating)`` of ``hits(query_id, match_type, score)``."""
    g = hits.groupBy("query_id").agg(F.max(F.col("match_type") == "exact_symbol").alias("e"), F.max(F.col("score") >= high).alias("h"))
    return g.select("query_id", F.when(F.col("e"), 0.96).when(F.col("h"), 0.88).otherwise(0.75).alias("confidence"), F.when(F.col("e"), "VERY_HIGH").when(F.col("h"), "HIGH").otherwise("MEDIUM").alias("rating"))


def usage(log: DataFrame, key: str = "repo_id") -> DataFrame:
    """Tokens in and out and calls per ``key`` of ``log(key, query, out_chars)``; a token is four characters."""
    tok = lambda c: F.greatest(F.lit(1), F.floor(F.coalesce(c, F.lit(0)) / 4))
    u = log.select(key, tok(F.length("query")).alias("tin"), tok(F.col("out_chars")).alias("tout"))
    return u.groupBy(key).agg(F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), F.sum(F.col("tin") + F.col("tout")).alias("total_tokens"), F.count("*").alias("calls"))


def stats(files: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(files, "total_files").crossJoin(one(blocks, "total_symbols")).crossJoin(one(edges, "total_edges"))


def listing(blocks: DataFrame, limit: int = 100) -> DataFrame:
    return blocks.where("name <> ''").orderBy("name", "file_path", "start_line", "block_id").limit(limit)


def ingestion_status(blocks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per repository: blocks, indexed blocks, percent (0..100, one decimal) and state."""
    b = blocks.groupBy("repo_id").agg(F.count_distinct("file_path").alias("total_files"), F.count("*").alias("total_blocks"))
    i = blocks.join(indexed.select("block_id").distinct(), "block_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("indexed_blocks"))
    s = b.join(i, "repo_id", "left").na.fill(0, ["indexed_blocks"])
    pct = F.least(F.greatest(F.round(F.col("indexed_blocks") / F.col("total_blocks") * 100, 1), F.lit(0.0)), F.lit(100.0))
    state = F.when(F.col("total_blocks") == 0, "idle").when(F.col("indexed_blocks") < F.col("total_blocks"), "indexing").otherwise("ready")
    return s.withColumn("percent", pct).withColumn("state", state)


def token_metrics(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Per query: tokens of what was retrieved, of the whole files, tokens saved and percent.

    ``hits(query_id, repo_id, file_path, content)``; ``files(repo_id, file_path, bytes)``. A token is four characters.
    """
    r = hits.groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.sum(F.length("content")) / 4)).alias("retrieved_tokens"))
    f = hits.select("query_id", "repo_id", "file_path").distinct().join(files, ["repo_id", "file_path"], "left").groupBy("query_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    m = r.join(f, "query_id").withColumn("whole_files_tokens", F.greatest("retrieved_tokens", F.floor(F.col("bytes") / 4)))
    saved = F.col("whole_files_tokens") - F.col("retrieved_tokens")
    return m.select("query_id", "retrieved_tokens", "whole_files_tokens", saved.alias("tokens_saved"), F.round(saved / F.col("whole_files_tokens") * 100, 1).alias("savings_percent"))
