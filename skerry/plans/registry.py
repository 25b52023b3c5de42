"""Queries over the driver tables, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import context, dense, extract, fusion, graph, sparse, store
from skerry.plans.sql import SQL
from skerry.session import materialize, stored, table
from skerry.sources import workspace
from skerry.streaming import sync

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- views of the driver tables: a repeated row counts once -----------------------------------------


def blocks(s: SparkSession, d: str, *cols: str) -> DataFrame:
    cols = cols or ("name", "kind", "file_path", "start_line", "end_line", "content", "repo_id")
    return table(s, d, "blocks").select("block_id", *cols).dropDuplicates(["block_id"])


def files(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(s, d, "source_files").select("file_id", *(cols or ("repo_id", "file_path", "hash", "mtime", "lang", "text"))).dropDuplicates(["file_id"])


def current_files(s: SparkSession, d: str) -> DataFrame:
    """The newest revision of every path of a repository."""
    f = table(s, d, "source_files").select("file_id", "repo_id", "file_path", "hash", "mtime", "lang", "text")
    return store.latest(f, ["repo_id", "file_path"], "file_id", [])


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges").distinct()


def requests(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "context_requests").select("request_id", "query", "top_k", "expand_depth", "max_chunk_chars", "overlap_chars", "org_id", "dept_id", "repo_id").dropDuplicates(["request_id"])
    return r.withColumnRenamed("request_id", "query_id")


def hits(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").distinct()
    return c.select(F.col("request_id").alias("query_id"), F.col("hit_rank").alias("pos"), "block_id", "file_path", "start_line", "end_line", "match_type", F.col("relevance_score").alias("score"))


def body():
    """The text that a block is searched by."""
    return F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit("")), F.coalesce("content", F.lit("")))


def _index(s, d):
    """The postings of the blocks: built once per application and state of the table, read by every search."""
    b = table(s, d, "blocks")
    return stored(b, "block_index", lambda _: sparse.index(blocks(s, d), "block_id", body()))


# --- sources -----------------------------------------------------------------------------------------


@query
def src3_accepted(s, d):
    return workspace.accepted(files(s, d, "file_path")).select("file_id", "ext", T.language(F.col("file_path")).alias("language"))


@query
def src4_language(s, d):
    f = files(s, d, "file_path", "lang")
    return f.groupBy(T.language(F.col("file_path")).alias("by_suffix"), T.language_alias(F.col("lang")).alias("by_name")).agg(F.count("*").alias("n_files"))


RULES = [("", "*_pb2.py"), ("", "*.min.js"), ("", "/tools/"), ("src", "generated_reports/"), ("", "vendor/**"), ("", "!vendor/pandoline/**"), ("app", "[!a-m]*.go"), ("", "quer?_*")]


@query
def flt1_ignored(s, d):
    return workspace.ignored(table(s, d, "source_files").select("file_path").distinct(), workspace.compile_rules(RULES))


@query
def src6_tolerant_text(s, d):
    f = files(s, d, "text").where("text is not null")
    raw = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FFFE")))
    return f.select("file_id", F.md5(workspace.tolerant_text(raw)).alias("hash"))


@query
def src7_read_lines(s, d):
    asked = hits(s, d).select("query_id", "file_path", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    f = table(s, d, "source_files").groupBy("file_path").agg(F.max_by("text", "file_id").alias("text"))
    return workspace.read_lines(f, asked)


@query
def src8_resolve_path(s, d):
    f = table(s, d, "source_files").select("file_path").distinct()
    asked = f.select(F.xxhash64("file_path").alias("query_id"), F.concat(F.lit("workspace/"), T.basename(F.col("file_path"))).alias("file_path"))
    return workspace.resolve_paths(asked, f).select("asked", "file_path").distinct()


@query
def src10_repo_parse(s, d):
    org, repo = T.repo_of_url(F.coalesce("repo_url", F.lit("")))
    return table(s, d, "repos").select("repo_id", org.alias("url_org"), repo.alias("url_repo"))


@query
def src14_new_points(s, d):
    return workspace.new_points(table(s, d, "vectors").select("point_id").distinct(), table(s, d, "probe_points"), "point_id")


@query
def src12_snapshot(s, d):
    """Postings written as an index version and read again."""
    from skerry.session import shared_dir

    at = f"{shared_dir(s)}/skerry/index-{uuid.uuid4().hex[:12]}"
    workspace.save_snapshot({"postings": sparse.postings(blocks(s, d), "block_id", body())}, at)
    back = workspace.load_snapshot(s, at, ["postings"])["postings"]
    return back.groupBy(F.col("id").alias("block_id")).agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


# --- extraction --------------------------------------------------------------------------------------


@query
def prj2_scan_blocks(s, d):
    b = extract.scan_blocks(files(s, d, "file_path", "text"), ["file_id"])
    return b.select("file_id", "kind", "name", "start_line", "end_line", F.md5("content").alias("content_hash"))


@query
def prj1_syntax_blocks(s, d):
    return extract.syntax_blocks(files(s, d, "file_path", "text"), "file_id")


@query
def prj3_import_edges(s, d):
    return extract.import_edges(files(s, d, "file_path", "text"), keep=("file_id",)).select("file_id", "source_symbol", "target_symbol", "relation", "confidence")


@query
def prj4_call_edges(s, d):
    e = extract.call_edges(blocks(s, d, "name", "file_path", "content"), keep=("block_id",))
    return e.groupBy("block_id", "target_symbol").agg(F.count("*").alias("n_calls"))


@query
def prj5_module_blocks(s, d):
    f = files(s, d, "file_path", "text")
    b = extract.scan_blocks(f, ["file_id"])
    return extract.module_blocks(f, b, "file_id", ["file_id"]).select("file_id", "kind", "start_line", "end_line", F.md5("content").alias("content_hash"))


@query
def prj6_summary(s, d):
    b = blocks(s, d, "file_path", "start_line", "end_line", "content")
    return b.select("block_id", T.signature(F.col("content")).alias("signature"), T.docstring(F.col("content")).alias("docstring"), F.concat("file_path", F.lit(":"), "start_line", F.lit("-"), "end_line").alias("line_range"))


@query
def prj7_truncate(s, d):
    h = hits(s, d).join(requests(s, d).select("query_id", "max_chunk_chars"), "query_id").join(blocks(s, d, "content"), "block_id")
    cut = T.truncated(F.col("content"), F.col("max_chunk_chars"))
    return h.select("query_id", "block_id", F.md5(cut).alias("snippet_hash"), (cut != F.col("content")).alias("was_cut")).distinct()


@query
def prj8_concern(s, d):
    return blocks(s, d, "file_path", "name").select("block_id", T.concern(F.col("file_path"), F.col("name")).alias("concern"))


@query
def prj9_relationship(s, d):
    e = edges(s, d).select("source_file", "target_symbol").distinct()
    return e.select("source_file", "target_symbol", T.relationship(F.col("source_file"), F.col("target_symbol")).alias("label"))


@query
def prj10_explain(s, d):
    h = hits(s, d).select("query_id", "block_id", "file_path", "score").join(requests(s, d).select("query_id", "query"), "query_id").join(blocks(s, d, "name"), "block_id")
    h = h.withColumn("kind", T.match_type(F.coalesce("query", F.lit("")), F.col("name"), F.col("file_path"), F.lit("hybrid_rrf"), F.lit(False)))
    return h.select("query_id", "block_id", "kind", T.match_confidence(F.col("kind"), F.col("score")).alias("confidence")).distinct()


@query
def prj11_point_id(s, d):
    b = blocks(s, d, "org_id", "dept_id", "repo_id", "file_path", "start_line", "end_line", "name", "content")
    c = [F.col(x) for x in ("org_id", "dept_id", "repo_id", "file_path", "start_line", "end_line", "name", "content")]
    return b.select("block_id", T.point_id(*c).alias("point_id"))


@query
def prj12_hash(s, d):
    return files(s, d, "text").select("file_id", F.md5("text").alias("text_hash"), F.length("text").alias("n_chars"))


@query
def prj13_render(s, d):
    e = graph.outgoing(edges(s, d)).groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("target")), "\n - ").alias("t"))
    return e.select("file_path", F.concat(F.lit("[INFO] Dependencies of "), "file_path", F.lit(":\n - "), "t").alias("shown"))


@query
def prj14_flow(s, d):
    b = blocks(s, d, "name", "file_path", "start_line")
    return graph.flow_diagram(graph.trace(edges(s, d), b, b.select("file_path", F.col("name").alias("symbol"))))


@query
def prj15_collection(s, d):
    return table(s, d, "repos").select("repo_id", T.collection_name(F.concat_ws(" ", F.coalesce("org_id", F.lit("default_org")), F.coalesce("dept_id", F.lit("default_dept")), "repo_id")).alias("collection"))


# --- scoring -----------------------------------------------------------------------------------------


@query
def sco1_tokens(s, d):
    t = requests(s, d).select("query_id", F.explode(T.tokens(F.col("query"))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count("*").alias("n"))


@query
def sco2_bm25(s, d):
    return sparse.search(blocks(s, d), "block_id", body(), requests(s, d).na.fill(5, ["top_k"]), post=_index(s, d)).select("query_id", F.col("id").alias("block_id"), "score", "rank")


@query
def sco2_bm25_documents(s, d):
    """The same operator over prose: every request against all documents."""
    docs = table(s, d, "documents").select("doc_id", "title", "text")
    prose = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return sparse.search(docs, "doc_id", prose, requests(s, d).na.fill(5, ["top_k"])).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query
def flt5_bm25_own_repo(s, d):
    return sparse.search(blocks(s, d), "block_id", body(), requests(s, d).na.fill(5, ["top_k"]), scope="repo_id", post=_index(s, d)).select("query_id", F.col("id").alias("block_id"), "score", "rank")


@query
def agg1_term_freq(s, d):
    return sparse.postings(blocks(s, d), "block_id", body()).withColumnRenamed("id", "block_id")


@query
def agg2_doc_freq(s, d):
    b = blocks(s, d)
    p = sparse.postings(b, "block_id", body())
    return sparse.term_stats(p, sparse.corpus_stats(b, p)).select("term", "df", F.round("idf", 8).alias("idf"))


@query
def agg3_corpus(s, d):
    b = blocks(s, d)
    return sparse.corpus_stats(b, sparse.postings(b, "block_id", body())).select("n", F.round("avgdl", 6).alias("avgdl"))


def _embeddings(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _embedding_queries(s, d):
    return _embeddings(s, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@query
def sco4_dense(s, d):
    return dense.top_k(_embeddings(s, d), _embedding_queries(s, d), 10, dim=64, drop_self=True).select("query_id", "id", "score", "rank")


@query
def flt4_dense_label(s, d):
    """Pre-filtered search: the label plays the repository."""
    return dense.top_k(_embeddings(s, d).where("label in (0, 1, 2)"), _embedding_queries(s, d), 5, dim=64).select("query_id", "id", "score", "rank")


@query
def flt7_threshold(s, d):
    return dense.top_k(_embeddings(s, d), _embedding_queries(s, d), 50, threshold=0.2, dim=64, drop_self=True).select("query_id", "id", "score", "rank")


@query
def sco3_hashed_embedding(s, d):
    v = dense.hashed_embedding(blocks(s, d), "block_id", body())
    return v.select(F.col("id").alias("block_id"), F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("weight"))


def _request_dense(s, d, k: int):
    """Rows like the first hit of a request, for the requests whose id is divisible by 100."""
    p = table(s, d, "vectors").where("point_id is not null and size(vector) = 384 and payload.block_id is not null").select("point_id", "vector", F.col("payload.block_id").alias("block_id"))
    # a repeated row is the same point: the first point of a block, and so one shuffle of the vectors
    first = lambda rows: rows.groupBy("block_id").agg(F.min_by("vector", "point_id").alias("vector"))
    asked = hits(s, d).where("pos = 1 and query_id % 100 = 0").select("query_id", "block_id").distinct()
    seed = asked.join(first(p.join(asked.select("block_id").distinct(), "block_id", "left_semi")), "block_id")
    seed = materialize(seed.groupBy("query_id").agg(F.min_by("vector", "block_id").alias("vector")), "dense_queries")
    return dense.top_k(first(p).withColumnRenamed("block_id", "id"), seed, k)


@query
def sco6_rrf(s, d):
    r = requests(s, d).where("query_id % 100 = 0")
    b = sparse.search(blocks(s, d), "block_id", body(), r, top_k=F.lit(15), post=_index(s, d))
    out = fusion.rrf(_request_dense(s, d, 15), b.select("query_id", "id", "rank"), top_k=10)
    return out.select("query_id", F.col("id").alias("block_id"), "rank", "score", "dense_rank", "bm25_rank")


def _shown(s, d, form):
    h = hits(s, d).select("query_id", F.col("pos").alias("rank"), "score", "block_id").join(blocks(s, d), "block_id").where("content is not null")
    return fusion.render(h, requests(s, d), form)


@query
def sco7_hybrid_text(s, d):
    return _shown(s, d, "hybrid")


@query
def sco5_vector_text(s, d):
    return _shown(s, d, "vector")


@query
def sco9_fallback(s, d):
    h = hits(s, d).select("query_id", "block_id")
    r = requests(s, d)
    words = r.select("query_id", "repo_id", F.col("top_k").alias("k"), F.explode(T.query_symbols(F.col("query"))).alias("symbol"))
    found = store.find_symbol(blocks(s, d, "name", "file_path", "start_line"), words, exact=True, limit=20)
    spare = found.groupBy("query_id", "block_id").agg(F.min(F.struct("file_path", "start_line", "block_id")).alias("o")).join(r.select("query_id", F.col("top_k").alias("k")), "query_id")
    from pyspark.sql import Window as W

    spare = spare.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("o"))).drop("o")
    return fusion.complement(h.distinct(), spare, ["block_id"]).select("query_id", "block_id", "score")


@query
def sco10_diversify(s, d):
    h = hits(s, d).join(blocks(s, d, "name"), "block_id").join(requests(s, d).select("query_id", "query", "top_k"), "query_id")
    h = h.withColumn("k", F.least("top_k", F.lit(3))).withColumn("concern", T.concern(F.col("file_path"), F.col("name")))
    # asks for two concerns of the data's own paths besides those the query names
    h = h.withColumn("requested", F.array_distinct(F.concat(T.requested_concerns(F.coalesce("query", F.lit(""))), F.array(F.lit("events_messaging"), F.lit("frontend_ui")))))
    h = h.groupBy("query_id", "block_id", "concern", "requested", "k").agg(F.min("pos").alias("pos"))
    return fusion.diversify(h).select("query_id", "block_id", "concern", "slot")


@query
def sco11_confidence(s, d):
    return store.confidence(hits(s, d))


@query
def flt9_query_symbols(s, d):
    return requests(s, d).select("query_id", F.posexplode(T.query_symbols(F.coalesce("query", F.lit("")))).alias("word_no", "word"))


# --- symbol store ------------------------------------------------------------------------------------


@query
def gdb1_current_files(s, d):
    return current_files(s, d).select("repo_id", "file_path", "file_id", "hash")


@query
def gdb4_clear(s, d):
    gone = table(s, d, "source_files").where("text = ''").select("repo_id", "file_path")
    return store.clear(blocks(s, d, "repo_id", "file_path"), gone, ["repo_id", "file_path"]).select("block_id")


@query
def gdb5_file_symbols(s, d):
    return blocks(s, d, "name", "kind", "file_path", "start_line", "end_line", "repo_id").groupBy("repo_id", "file_path").agg(F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set(F.coalesce("name", F.lit("")))), ",").alias("names"))


def _words(s, d):
    return requests(s, d).select("query_id", F.explode(T.query_symbols(F.col("query"))).alias("symbol"))


@query
def gdb6_find_exact(s, d):
    return store.find_symbol(blocks(s, d, "name", "file_path", "start_line"), _words(s, d), True, 5).select("query_id", "symbol", "block_id", "rank")


@query
def flt10_find_fuzzy(s, d):
    return store.find_symbol(blocks(s, d, "name", "file_path", "start_line"), _words(s, d), False, 20).select("query_id", "symbol", "block_id", "rank")


def _names(s, d):
    return blocks(s, d, "name").where("name <> ''").select(F.col("name").alias("symbol")).distinct()


@query
def gdb8_callers(s, d):
    return graph.callers(edges(s, d), _names(s, d), 10)


@query
def gdb9_callees(s, d):
    return graph.callees(edges(s, d), blocks(s, d, "file_path", "name").select("file_path", F.col("name").alias("symbol"))).select("file_path", "symbol", "target_symbol")


@query
def gdb10_references(s, d):
    return graph.references(edges(s, d), blocks(s, d, "name", "kind", "file_path"), _names(s, d))


@query
def gdb11_dependencies(s, d):
    return graph.outgoing(edges(s, d))


def _resolved(s, d):
    f = table(s, d, "source_files").select("repo_id", "file_path").distinct()
    return graph.resolve_targets(edges(s, d), f, blocks(s, d, "repo_id", "name", "file_path"))


@query
def joi5_resolve(s, d):
    return _resolved(s, d).select("repo_id", "source_file", "source_symbol", "target_symbol", "relation", "target_file").distinct()


@query
def gdb12_dependents(s, d):
    return graph.dependents(_resolved(s, d))


@query
def gdb13_induced(s, d):
    picked = hits(s, d).select("file_path").distinct().join(table(s, d, "source_files").select("repo_id", "file_path").distinct(), "file_path")
    return graph.induced(_resolved(s, d), picked)


@query
def gdb18_stats(s, d):
    return store.stats(files(s, d, "file_path"), blocks(s, d, "name"), edges(s, d))


@query
def gdb19_listing(s, d):
    return store.listing(blocks(s, d, "name", "file_path", "start_line"), 100).select("block_id", "name", "file_path", "start_line")


@query
def joi1_exact(s, d):
    return context.exact_hits(blocks(s, d, "name", "repo_id", "file_path", "start_line"), requests(s, d)).select("query_id", "block_id", "pos")


@query
def joi4_companions(s, d):
    f = table(s, d, "source_files").select("file_path").distinct()
    # companions of the data: files named after another with a known prefix or suffix are few, so names are derived
    named = f.unionByName(f.select(F.regexp_replace("file_path", r"([^/]*)(\.[^./]*)$", "test_$1$2").alias("file_path")))
    return graph.companion_tests(f, named)


@query
def joi6_unresolved(s, d):
    return graph.calls(edges(s, d)).select("target_symbol").distinct().join(blocks(s, d, "name"), F.col("target_symbol") == F.col("name"), "left_anti")


@query
def joi10_cross_repo(s, d):
    return store.cross_repo(blocks(s, d, "name", "file_path", "start_line", "repo_id"), "ledger").select("repo_id", "block_id", "rank")


@query
def joi11_contract(s, d):
    return store.cross_repo(blocks(s, d), "authorization", "content").select("repo_id", "block_id", "rank")


@query
def joi12_roots(s, d):
    e = graph.calls(edges(s, d))
    return e.where("source_symbol <> ''").select(F.col("source_symbol").alias("symbol")).distinct().join(e.select(F.col("target_symbol").alias("symbol")).distinct(), "symbol", "left_anti")


@query
def flt11_test_files(s, d):
    return table(s, d, "source_files").where(F.col("file_path").rlike(graph.TEST_PATH)).select("file_path").distinct()


@query
def flt12_entry_points(s, d):
    return blocks(s, d, "file_path", "name").where(graph.entry_like(F.coalesce("file_path", F.lit("")), F.coalesce("name", F.lit("")))).select("block_id")


# --- sets and graph ----------------------------------------------------------------------------------


@query
def set1_ordered_union(s, d):
    h = hits(s, d)
    a = h.where("match_type = 'exact_symbol'").select("query_id", "pos", "file_path", "start_line", "block_id")
    b = h.select("query_id", "pos", "file_path", "start_line", "block_id")
    return fusion.first_by_key([a.groupBy("query_id", "file_path", "start_line").agg(F.min(F.struct("pos", "block_id")).alias("x")).select("query_id", "file_path", "start_line", "x.*"), b.groupBy("query_id", "file_path", "start_line").agg(F.min(F.struct("pos", "block_id")).alias("x")).select("query_id", "file_path", "start_line", "x.*")], ["file_path", "start_line"]).select("query_id", "block_id", "pos")


@query
def set3_containment(s, d):
    return fusion.drop_contained(hits(s, d)).select("query_id", "pos", "block_id")


@query
def set5_edge_dedup(s, d):
    return edges(s, d).groupBy("repo_id", "relation").agg(F.count("*").alias("n_edges"))


def _seeds(s, d):
    """The names of the first hits of all requests."""
    return hits(s, d).where("pos = 1").join(blocks(s, d, "name"), "block_id").where("name <> ''").select(F.col("name").alias("symbol")).distinct()


@query
def gra1_blast(s, d):
    return graph.blast_radius(edges(s, d), _seeds(s, d), 2)


@query
def agg9_blast_summary(s, d):
    b = graph.blast_summary(graph.blast_radius(edges(s, d), _seeds(s, d), 2))
    return b.select("symbol", "callers", "files", F.array_join("caller_list", ",").alias("caller_list"), F.array_join("file_list", ",").alias("file_list"), "n_tests")


@query
def gdb15_impact(s, d):
    r = graph.blast_radius(edges(s, d), _names(s, d), 2, fan=1_000_000)
    return r.groupBy("symbol").agg(F.count_distinct("source_symbol").alias("affected_symbols"), F.count_distinct("source_file").alias("affected_files"))


@query
def gra2_trace(s, d):
    b = blocks(s, d, "name", "file_path", "start_line")
    return graph.trace(edges(s, d), b, b.select("file_path", F.col("name").alias("symbol")))


@query
def gra3_call_paths(s, d):
    """From every caller two levels above a first hit down to it."""
    e = edges(s, d)
    r = graph.blast_radius(e, _seeds(s, d), 2)
    p = graph.call_paths(e, r.select(F.col("source_symbol").alias("origin"), F.col("symbol").alias("goal")).distinct(), 3)
    return p.select("origin", "goal", F.array_join("path", ">").alias("path"), "edges")


@query
def gra4_affected_tests(s, d):
    f = table(s, d, "source_files").select("repo_id", "file_path").distinct()
    return graph.affected_tests(_resolved(s, d), f, f)


@query
def gra5_expand(s, d):
    r = requests(s, d).select("query_id", "repo_id")
    start = hits(s, d).where("pos <= 3").select("query_id", "file_path").distinct().join(r, "query_id")
    return graph.expand(_resolved(s, d), start, 2)


# --- aggregates --------------------------------------------------------------------------------------


@query
def agg6_token_metrics(s, d):
    b = blocks(s, d, "content", "repo_id", "file_path").drop("file_path")
    h = hits(s, d).select("query_id", "block_id", "file_path").distinct().join(b, "block_id")
    f = current_files(s, d).select("repo_id", "file_path", F.octet_length("text").alias("bytes"))
    return store.token_metrics(h, f)


@query
def agg7_progress(s, d):
    v = table(s, d, "vectors").select(F.col("payload.block_id").alias("block_id")).where("block_id is not null")
    return store.ingestion_status(blocks(s, d, "repo_id", "file_path"), v)


def _requests_log(s, d):
    return requests(s, d).join(hits(s, d).join(blocks(s, d, "content"), "block_id").groupBy("query_id").agg(F.sum(F.length("content")).alias("out_chars")), "query_id", "left")


@query
def agg11_usage(s, d):
    return store.usage(_requests_log(s, d))


# --- change feed -------------------------------------------------------------------------------------


def _changes(s, d):
    """Deliveries of files as change events: an empty text is a removal."""
    f = table(s, d, "source_files").select(F.concat_ws("/", "repo_id", "file_path").alias("path"), F.when(F.col("text") == "", "removed").otherwise("modified").alias("op"), F.col("synced_at").alias("ts"), "text")
    return f.distinct()


@query
def str2_sync(s, d):
    e = _changes(s, d)
    none = e.where("false").select("path", "text")
    return sync.apply_changes(none, e).select("path", F.md5("text").alias("hash"))


@query
def str3_delta(s, d):
    return sync.change_counts(_changes(s, d))


@query
def str1_listing_diff(s, d):
    f = table(s, d, "source_files").select(F.concat_ws("/", "repo_id", "file_path").alias("path"), "file_id", F.md5("text").alias("hash"))
    first, last = (f.groupBy("path").agg(g("hash", "file_id").alias("hash")) for g in (F.min_by, F.max_by))
    return sync.listing_changes(first, last)


@query
def str7_needs_reindex(s, d):
    heads = table(s, d, "repos").select("repo_id", F.md5("repo_url").alias("sha"))
    n = blocks(s, d, "repo_id").groupBy("repo_id").agg(F.count("*").alias("blocks"))
    manifest = heads.join(n, "repo_id", "left").select("repo_id", F.when(F.col("blocks") > 20, F.col("sha")).alias("indexed_sha"), "blocks")
    return sync.needs_reindex(manifest, heads)


# --- the remaining joins, windows, sets and limits ----------------------------------------------------


@query
def src2_tenant_blocks(s, d):
    """Scanned blocks and module blocks, stamped with their tenant."""
    f = files(s, d, "repo_id", "file_path", "text")
    b = extract.scan_blocks(f, ["file_id", "repo_id"])
    m = extract.module_blocks(f, b, "file_id", ["file_id", "repo_id", "file_path"]).withColumn("name", F.lit(None).cast("string"))
    r = table(s, d, "repos").select("repo_id", F.coalesce("org_id", F.lit("default_org")).alias("org_id"), F.coalesce("dept_id", F.lit("default_dept")).alias("dept_id"))
    every = b.unionByName(m.select(b.columns)).join(F.broadcast(r), "repo_id", "left")  # one row per repository
    return every.groupBy("org_id", "dept_id", "repo_id", "kind").agg(F.count("*").alias("n_blocks"))


@query
def joi3_hit_neighbours(s, d):
    e = edges(s, d)
    h = hits(s, d).select("block_id").distinct().join(blocks(s, d, "name", "file_path"), "block_id").where("name <> '' and name <> 'anonymous'").select("block_id", "file_path", F.col("name").alias("symbol"))
    ins = graph.callers(e, h, 5).groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(F.concat("source_symbol", F.lit(" ("), T.basename(F.col("source_file")), F.lit(")")))), ",").alias("callers"), F.count("*").alias("callers_count"))
    outs = graph.callees(e, h).groupBy("file_path", "symbol").agg(F.count_distinct("target_symbol").alias("callees_count"))
    j = h.join(ins, "symbol", "left").join(outs, ["file_path", "symbol"], "left").na.fill(0, ["callers_count", "callees_count"]).na.fill("", ["callers"])
    return j.select("block_id", "callers", "callers_count", "callees_count")


@query
def sco8_exact_first(s, d):
    e = context.exact_hits(blocks(s, d, "name", "repo_id", "file_path", "start_line"), requests(s, d)).select("query_id", "block_id", "pos")
    h = hits(s, d).groupBy("query_id", "block_id").agg(F.min("pos").alias("pos"))
    return fusion.first_by_key([e, h], ["block_id"]).select("query_id", "block_id", "pos")


@query
def set2_changed_paths(s, d):
    c = sync.last_events(_changes(s, d))
    added = table(s, d, "source_files").groupBy(F.concat_ws("/", "repo_id", "file_path").alias("path")).agg(F.count_distinct("file_id").alias("n")).where("n = 1").select("path")
    return c.where("op = 'modified'").select("path").union(added).distinct()


@query
def set6_federated_dense(s, d):
    """Five hits of every label (a collection each), merged and cut to ten."""
    v = _embeddings(s, d)
    q = _embedding_queries(s, d)
    from pyspark.sql import Window as W

    every = dense.top_k(v, q, 5, dim=64, by="label").select("query_id", "id", "score")
    return every.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 10")


@query
def win2_repo_top5(s, d):
    from pyspark.sql import Window as W

    h = hits(s, d).join(blocks(s, d, "repo_id"), "block_id").groupBy("repo_id", "block_id").agg(F.max("score").alias("score"))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("score"), "block_id"))).where("rank <= 5")


@query
def win4_concern_first(s, d):
    h = hits(s, d).join(blocks(s, d, "name"), "block_id").withColumn("concern", T.concern(F.col("file_path"), F.col("name")))
    return h.groupBy("query_id", "concern").agg(F.min(F.struct("pos", "block_id")).alias("x")).select("query_id", "concern", "x.pos", "x.block_id")


@query
def agg8_ordered_distinct(s, d):
    first = hits(s, d).groupBy("query_id", "file_path").agg(F.min("pos").alias("pos"))
    g = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "file_path"))).alias("x"))
    return g.select("query_id", F.array_join("x.file_path", ",").alias("file_list"))


@query
def top5_cap(s, d):
    g = hits(s, d).groupBy("query_id").agg(F.count("*").alias("n"))
    return g.select("query_id", F.least("n", F.lit(5)).alias("shown"), (F.col("n") > 5).alias("truncated"))


@query
def flt6_repo_scope(s, d):
    """Callers within the request's repository; the default repository means no restriction."""
    e = graph.calls(edges(s, d)).select("repo_id", F.col("target_symbol").alias("symbol"), "source_symbol", "source_file").distinct()
    r = requests(s, d).select("query_id", "repo_id").join(hits(s, d).where("pos = 1").select("query_id", "block_id").distinct(), "query_id").join(blocks(s, d, "name"), "block_id")
    w = r.where("name <> ''").select("query_id", F.coalesce("repo_id", F.lit("default_repo")).alias("scope"), F.col("name").alias("symbol")).distinct()
    return w.join(e, "symbol").where("scope = 'default_repo' or scope = repo_id").groupBy("query_id", "symbol").agg(F.count("*").alias("n_callers"))


@query
def str6_empty_index(s, d):
    """Repositories whose index is empty and has to be built before answering."""
    return table(s, d, "repos").select("repo_id").join(blocks(s, d, "repo_id").where("name is not null").select("repo_id").distinct(), "repo_id", "left_anti")


# --- the bundled query -------------------------------------------------------------------------------


def _context(s, d):
    f = current_files(s, d).select("repo_id", "file_path", F.octet_length("text").alias("bytes"))
    return context.context(blocks(s, d), f, edges(s, d), requests(s, d), _request_dense(s, d, 60), _index(s, d))


@query
def ctx_chunks(s, d):
    c = _context(s, d)["chunks"]
    return c.select("query_id", "pos", "block_id", "score", "match_type", "confidence", "concern")


@query
def ctx_dependencies(s, d):
    """The dependencies of the bundle: contents are read for the index of words only."""
    chosen = context.select(blocks(s, d), requests(s, d), _request_dense(s, d, 60), _index(s, d))
    return context.dependencies(blocks(s, d), current_files(s, d).select("repo_id", "file_path"), edges(s, d), requests(s, d), chosen)


@query
def ctx_bundle(s, d):
    return _context(s, d)["bundle"]


__all__ = ["QUERIES", "SQL"]
