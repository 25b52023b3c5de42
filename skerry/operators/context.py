"""The bundled query: one plan answers a whole batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import fusion, graph, sparse, store
from skerry.session import materialize

MAX_CHUNKS = 15
EXACT_SCORE, FALLBACK_SCORE = 1.0, 0.85


def exact_hits(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocks named like a word of the query: ``(query_id, block_id, pos)``, each block once."""
    w = requests.select("query_id", "repo_id", F.posexplode(T.query_symbols(F.col("query"))).alias("word_no", "word")).withColumn("low", F.lower("word"))
    b = blocks.where("name <> ''").select("block_id", "repo_id", "file_path", "start_line", F.lower("name").alias("low"))
    h = w.join(b, ["repo_id", "low"]).groupBy("query_id", "block_id", "file_path", "start_line").agg(F.min("word_no").alias("word_no"))
    return h.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("word_no", "file_path", "start_line", "block_id")))


def _requests(requests: DataFrame) -> DataFrame:
    """Requests with null queries as empty, five hits where no number is given, and a depth."""
    req = requests.withColumn("query", F.coalesce("query", F.lit(""))).withColumn("top_k", F.coalesce("top_k", F.lit(5)))
    return req if "expand_depth" in req.columns else req.withColumn("expand_depth", F.lit(None).cast("int"))


def select(blocks: DataFrame, requests: DataFrame, dense: DataFrame | None = None, post: DataFrame | None = None) -> DataFrame:
    """The chosen hits of each request, in order of ``pos`` and without their contents."""
    req = _requests(requests)
    body = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit("")), F.coalesce("content", F.lit("")))
    ranked = materialize(sparse.search(blocks, "block_id", body, req, top_k=F.col("top_k") * 6, scope="repo_id", post=post), "ctx_ranked")
    empty = ranked.where("false").select("query_id", "id", "rank")
    if dense is not None:
        # the request's own repository only, as for words: the few dense hits meet the blocks, never all of a repository's blocks its requests
        own = dense.select("query_id", "id", F.col("rank").alias("r")).join(req.select("query_id", "repo_id"), "query_id")
        kept = own.join(blocks.select(F.col("block_id").alias("id"), "repo_id"), ["id", "repo_id"], "left_semi").select("query_id", "id", "r").distinct()
        dense = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("r"))).drop("r")
    fused = fusion.rrf(dense if dense is not None else empty, ranked).join(req.select("query_id", "top_k"), "query_id").where(F.col("rank") <= F.col("top_k") * 2)
    exact = exact_hits(blocks, req).select("query_id", "block_id", "pos", F.lit(EXACT_SCORE).alias("score"), F.lit(True).alias("exact"))
    fused = fused.select("query_id", F.col("id").alias("block_id"), F.col("rank").alias("pos"), "score", F.lit(False).alias("exact"))
    fused = materialize(fused, "ctx_fused")
    # fallback: only queries with less than top_k of fused hits look for names that hold their words
    have = fused.groupBy("query_id").agg(F.count("*").alias("have"))
    short = req.join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < F.col("top_k")).select("query_id", "query", "repo_id", "top_k")
    words = short.select("query_id", "repo_id", F.explode(T.query_symbols(F.col("query"))).alias("symbol"))
    near = store.find_symbol(blocks, words, exact=False, limit=20, scope="repo_id")
    near = near.groupBy("query_id", "block_id").agg(F.min(F.struct("rank", "name", "file_path", "start_line", "block_id")).alias("o")).join(short.select("query_id", F.col("top_k").alias("k")), "query_id")
    near = near.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("o"))).drop("o")
    spare = fusion.complement(fused.select("query_id", "block_id"), near, ["block_id"], FALLBACK_SCORE).select("query_id", "block_id", "pos", "score", F.lit(False).alias("exact"))
    place = blocks.select("block_id", "repo_id", "file_path", "start_line", "end_line", "name", "kind")
    hits = fusion.first_by_key([exact, fused, spare], ["block_id"]).join(place, "block_id").join(req.select("query_id", "query", F.col("top_k").alias("k"), "max_chunk_chars"), "query_id")
    hits = hits.withColumn("concern", T.concern(F.col("file_path"), F.col("name"))).withColumn("requested", T.requested_concerns(F.col("query")))
    kind = T.match_type(F.col("query"), F.col("name"), F.col("file_path"), F.lit("hybrid_rrf"), F.col("exact"))
    hits = hits.withColumn("match_type", kind).withColumn("confidence", T.match_confidence(F.col("match_type"), F.col("score")))
    chosen = fusion.diversify(hits)
    order = W.partitionBy("query_id").orderBy(F.desc(F.col("match_type") == "exact_symbol"), F.desc("score"), "slot")
    chosen = materialize(fusion.drop_contained(chosen.withColumn("pos", F.row_number().over(order))), "ctx_hits")
    total = W.partitionBy("query_id")
    chosen = chosen.withColumn("n", F.count("*").over(total)).withColumn("pos", F.row_number().over(total.orderBy("pos")))
    chosen = chosen.withColumn("truncated", F.col("n") > MAX_CHUNKS).where(F.col("pos") <= MAX_CHUNKS)
    return chosen


def dependencies(blocks: DataFrame, files: DataFrame, edges: DataFrame, requests: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(query_id, repo_id, source_file, target_file, label, hop)``: dependencies of the files of the ``chosen`` hits, as
    many hops as each request asks for; hop 0 is an edge between two of these files."""
    req = _requests(requests)
    start = materialize(chosen.select("query_id", "repo_id", "file_path").distinct(), "ctx_files")
    deepest = int(req.agg(F.max("expand_depth")).first()[0] or 1)
    depth = req.select("query_id", F.greatest(F.coalesce("expand_depth", F.lit(1)), F.lit(1)).alias("depth"))
    hops = graph.expand(graph.resolve_targets(edges, files, blocks), start, deepest).join(depth, "query_id").where("hop <= depth")
    # the first hop holds every edge from a chosen file, so those between chosen files are among it
    both = start.withColumnRenamed("file_path", "target_file").withColumn("inner", F.lit(True))
    hop = F.when((F.col("hop") == 1) & F.col("inner"), 0).otherwise(F.col("hop")).alias("hop")
    deps = hops.join(both, ["query_id", "repo_id", "target_file"], "left").select("query_id", "repo_id", "source_file", "target_file", "label", hop)
    return materialize(deps, "ctx_dependencies")


def context(blocks: DataFrame, files: DataFrame, edges: DataFrame, requests: DataFrame, dense: DataFrame | None = None, post: DataFrame | None = None) -> dict[str, DataFrame]:
    """Answer ``requests(query_id, query, top_k, repo_id, max_chunk_chars, expand_depth)``.

    Exact symbols first, then words and vectors fused by rank, then a fallback on names that hold the
    query's words for queries whose fused list is short; repository filters apply before ranking. Selected
    rows get match type, confidence, concern, callers, callees and a summary; their files are expanded along
    dependencies, ``expand_depth`` (at least one) hops, beside the edges among them. ``files(repo_id, file_path,
    bytes)``; without sizes or depths, sizes count as 0 and depths as one. Returns frames ``chunks`` (one row per chunk), ``dependencies`` (one row per request and edge; hop 0:
    between selected files) and ``bundle`` (one row per request, with token metrics). Null queries count as empty;
    requests that match nothing come back with empty lists. ``dense(query_id, id, rank)`` joins the fusion
    where given; ``post`` is a stored index of the blocks.
    """
    req = _requests(requests)
    if "bytes" not in files.columns:
        files = files.withColumn("bytes", F.lit(0))
    none = F.array().cast("array<string>")
    chosen = select(blocks, req, dense, post)
    chosen = materialize(chosen.join(blocks.select("block_id", "content"), "block_id"), "ctx_chosen")
    seeds = chosen.where("name <> '' and name <> 'anonymous'").select(F.col("name").alias("symbol"), "file_path").distinct()
    ins = graph.callers(edges, seeds, 5).groupBy("symbol").agg(F.array_sort(F.collect_list(F.concat("source_symbol", F.lit(" ("), T.basename(F.col("source_file")), F.lit(")")))).alias("callers"))
    outs = graph.callees(edges, seeds).groupBy("file_path", "symbol").agg(F.array_sort(F.collect_set("target_symbol")).alias("callees"))
    c = chosen.join(ins.withColumnRenamed("symbol", "name"), "name", "left").join(outs.withColumnRenamed("symbol", "name"), ["file_path", "name"], "left")
    c = c.withColumn("callers", F.coalesce("callers", none)).withColumn("callees", F.coalesce("callees", none))
    chunks = c.select(
        "query_id", "pos", "block_id", "repo_id", "file_path", "start_line", "end_line", "name", "kind", "score", "match_type", "confidence", "concern", "truncated", "callers", "callees",
        T.match_reason(F.col("match_type"), F.col("name"), F.col("file_path"), F.col("score")).alias("match_reason"), T.truncated(F.col("content"), F.col("max_chunk_chars")).alias("content"),
        T.signature(F.col("content")).alias("signature"), T.docstring(F.col("content")).alias("docstring"),
    )
    g = chunks.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id", "file_path", "name", "score", "match_type", "confidence", "concern", "signature", "callers", "callees"))), lambda x: x).alias("chunks"),
        F.count("*").alias("total_chunks"), F.max("truncated").alias("truncated"), F.greatest(F.lit(1), F.floor(F.sum(F.length("content")) / 4)).alias("estimated_tokens"),
        F.max(F.col("match_type") == "exact_symbol").alias("any_exact"), F.max(F.col("score") >= 0.8).alias("any_high"), F.collect_set("concern").alias("found"),
    )
    flows = graph.flow_diagram(graph.trace(edges, blocks, chunks.where("pos <= 3").select("file_path", F.col("name").alias("symbol"))))
    first = chunks.where("pos = 1").select("query_id", "file_path", F.col("name").alias("symbol")).join(flows, ["file_path", "symbol"]).select("query_id", F.col("flow").alias("flow_diagram"), "fully_traced")
    tests = chunks.select("query_id", "file_path").distinct().join(graph.companion_tests(chunks, files), "file_path").groupBy("query_id").agg(F.array_sort(F.collect_set("test_path")).alias("related_tests"))
    deps = dependencies(blocks, files, edges, req, chosen)
    n_deps = deps.groupBy("query_id").agg(F.count("*").alias("n_dependencies"), F.count(F.when(F.col("hop") == 0, 1)).alias("n_inner"))
    metrics = store.token_metrics(chunks.select("query_id", "repo_id", "file_path", "content"), files)
    wanted = req.select("query_id", "query", T.requested_concerns(F.col("query")).alias("wanted"))
    out = wanted.join(g, "query_id", "left").join(first, "query_id", "left").join(tests, "query_id", "left").join(n_deps, "query_id", "left").join(metrics, "query_id", "left")
    no_tests = F.when(F.array_contains("wanted", "tests") & F.col("related_tests").isNull(), F.array(F.lit("tests"))).otherwise(none)
    omitted = F.when(F.size("wanted") > 1, F.array_except(F.filter("wanted", lambda x: x != "tests"), F.coalesce("found", none))).otherwise(none)
    omitted = F.concat(omitted, no_tests)
    rating = F.when(F.col("any_exact"), "VERY_HIGH").when(F.col("any_high"), "HIGH").otherwise("MEDIUM")
    points = F.when(F.col("any_exact"), 0.96).when(F.col("any_high"), 0.88).otherwise(0.75)
    bundle = out.select(
        "query_id", "query", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("estimated_tokens", F.lit(1)).alias("estimated_tokens"),
        points.alias("confidence_score"), rating.alias("confidence_rating"), F.coalesce("flow_diagram", F.lit("Direct / No AST symbol match")).alias("flow_diagram"), F.coalesce("fully_traced", F.lit(False)).alias("fully_traced"),
        F.coalesce("related_tests", none).alias("related_tests"), omitted.alias("omissions"),
        F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"), F.coalesce("n_inner", F.lit(0)).alias("n_inner_edges"), "retrieved_tokens", "whole_files_tokens", "tokens_saved", "savings_percent", "chunks",
    )
    return {"chunks": chunks, "dependencies": deps, "bundle": bundle}
