"""Retrieval, graph, workspace and change-feed operators on small hand-made frames."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.operators import context, dense, extract, fusion, graph, sparse, store
from skerry.sources import workspace
from skerry.streaming import sync


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("process_shopping_cart", ["process_shopping_cart", "process", "shopping", "cart", "process", "shopping", "cart"]),
        ("HTTPServer2", ["httpserver2", "http", "server", "2"]),
        ("getAPI_KEY", ["getapi_key", "getapi", "key", "get", "key"]),
        ("__init__", ["__init__", "init"]),
        ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def spec_tokens(text):
    out = []
    for raw in re.findall(r"[a-zA-Z0-9_]+", text):
        out.append(raw.lower())
        if "_" in raw:
            out += [p for p in raw.lower().split("_") if p]
        camel = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\d|\W|$)|\d+", raw)
        if len(camel) > 1:
            out += [c.lower() for c in camel]
    return out


def test_bm25_equals_an_independent_specification(spark):
    docs = [(1, "def loadIndex(path): return open_file(path)"), (2, "class IndexLoader load index index"), (3, "unrelated words"), (4, ""), (5, None)]
    queries = [(10, "load index index", 3), (11, "nothing_here", 3), (12, "", 3), (13, None, 3), (14, "index", 1)]
    df = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(queries, "query_id long, query string, top_k int")
    got = {(r.query_id, r.id): r.score for r in sparse.search(df, "id", F.coalesce("text", F.lit("")), q).collect()}
    toks = {i: spec_tokens(t or "") for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for qid, text, k in queries:
        scores = {}
        for i, d in toks.items():
            s = 0.0
            for t in spec_tokens(text or ""):
                df_ = sum(t in x for x in toks.values())
                if t in d:
                    s += math.log(1 + (len(toks) - df_ + 0.5) / (df_ + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
            if s > 0:
                scores[i] = s
        for i in sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]:
            want[qid, i] = scores[i]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_scope_never_leaves_its_repository(spark):
    df = spark.createDataFrame([(1, "index", "a"), (2, "index", "b")], "id long, text string, repo string")
    q = spark.createDataFrame([(1, "index", 5, "a")], "query_id long, query string, top_k int, repo string")
    assert [r.id for r in sparse.search(df, "id", F.col("text"), q, scope="repo").collect()] == [1]


def ranks(spark, *ids):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")


def test_rank_fusion(spark):
    got = fusion.rrf(ranks(spark, "A", "B", "C"), ranks(spark, "B", "D", "A")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("B", 0.0325), ("A", 0.0323), ("D", 0.0161), ("C", 0.0159)]
    tie = fusion.rrf(ranks(spark, "A"), ranks(spark, "B")).orderBy("rank").collect()
    assert [r.id for r in tie] == ["A", "B"]


def test_containment(spark):
    h = spark.createDataFrame([(1, "f", s, e, p) for p, (s, e) in enumerate([(10, 20), (5, 30), (12, 15), (10, 20)])], "query_id int, file_path string, start_line int, end_line int, pos int")
    assert sorted(r.pos for r in fusion.drop_contained(h).collect()) == [0, 1]


def test_dense_top_k(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0])], "id long, vector array<float>")
    q = v.where("id = 1").select(F.col("id").alias("query_id"), "vector")
    got = dense.top_k(v, q, 2, dim=2, drop_self=True).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(8, 1.0), (3, 0.707107)]
    assert dense.top_k(v, q.where("false"), 2, dim=2).count() == 0


def calls(spark, *pairs):
    rows = [(f"{a}.py", a, "", b, "calls", 0.8, "r") for a, b in pairs]
    return spark.createDataFrame(rows, "source_file string, source_symbol string, target_file string, target_symbol string, relation string, confidence double, repo_id string")


def test_blast_radius_with_a_cycle(spark):
    e = calls(spark, ("b", "a"), ("c", "b"), ("a", "c"), ("b", "a"))
    seed = spark.createDataFrame([("a",)], "symbol string")
    at = lambda d: {r.source_symbol for r in graph.blast_radius(e, seed, d).collect()}
    assert at(2) == {"b", "c"} and at(3) == {"a", "b", "c"}


def test_call_paths(spark):
    e = calls(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"))
    p = graph.call_paths(e, spark.createDataFrame([("a", "d")], "origin string, goal string"), 4)
    assert {tuple(r.path) for r in p.collect()} == {("a", "c", "d"), ("a", "b", "c", "d")}


def test_trace_roles(spark):
    e = calls(spark, ("main_run", "f"), ("x", "f"), ("y", "x"), ("f", "g"), ("f", "print"), ("f", "h"), ("h", "g"))
    b = spark.createDataFrame([(n, f"{n}.py", 1) for n in ("f", "g", "h", "x")], "name string, file_path string, start_line int")
    got = {(r.side, r.step): r.role for r in graph.trace(e, b, spark.createDataFrame([("f.py", "f")], "file_path string, symbol string")).collect()}
    assert got == {("up", "main_run.py:main_run"): "entry", ("up", "x.py:x"): "caller", ("down", "g"): "leaf", ("down", "print"): "unresolved", ("down", "h"): "callee"}


def test_companion_tests(spark):
    f = spark.createDataFrame([("src/pay.py",), ("t/test_pay.py",), ("test_pay.py",), ("t/pay.spec.py",)], "file_path string")
    got = graph.companion_tests(f.where("file_path = 'src/pay.py'"), f)
    assert {r.test_path for r in got.collect()} == {"t/test_pay.py", "t/pay.spec.py"}


def test_resolution_of_imports(spark):
    e = spark.createDataFrame([("a/x.py", "x.py", "", "b.util", "imports", 1.0, "r"), ("a/x.py", "f", "", "g", "calls", 0.8, "r")], calls(spark, ("a", "b")).schema)
    files = spark.createDataFrame([("r", "a/x.py"), ("r", "a/b/util.py"), ("r", "z/util.py"), ("q", "b/util.py")], "repo_id string, file_path string")
    blocks = spark.createDataFrame([("r", "g", "z/util.py")], "repo_id string, name string, file_path string")
    got = {r.relation: r.target_file for r in graph.resolve_targets(e, files, blocks).collect()}
    assert got == {"imports": "a/b/util.py", "calls": "z/util.py"}


@pytest.mark.parametrize("line, want", [("def make_class(x):", ("class", "make_class")), ("export function f() {}", None), ("pub fn g()", None), ("    async def h():", ("function", "h")), ("struct S {", ("class", "S"))])
def test_scanner_lines(spark, line, want):
    got = extract.scan_blocks(spark.createDataFrame([(1, "a.x", line + "\nbody")], "file_id int, file_path string, text string"), ["file_id"]).collect()
    assert [(r.kind, r.name) for r in got] == ([want] if want else [])


def test_scanner_window_and_modules(spark):
    text = "def f():\n" + "\n".join(f"  x{i}" for i in range(60)) + "\n"
    df = spark.createDataFrame([(1, "a.py", text), (2, "b.py", "x = 1\n" * 900), (3, "c.py", ""), (4, "d.py", " \n "), (5, "e.py", None)], "file_id int, file_path string, text string")
    b = extract.scan_blocks(df, ["file_id"])
    r = b.first()
    assert (r.start_line, r.end_line, r.content.count("\n")) == (1, 41, 40)
    m = extract.module_blocks(df, b, "file_id", ["file_id"]).collect()
    assert [(x.file_id, x.end_line, len(x.content)) for x in m] == [(2, 900, 4000)]


def test_syntax_blocks(spark):
    df = spark.createDataFrame([(1, "a.py", "class A:\n    def f(self):\n        pass\n\n@d\nasync def g():\n    pass\n"), (2, "b.py", "def broken(:\n"), (3, "c.go", "func h() {\n}\n"), (4, "d.py", "")], "file_id int, file_path string, text string")
    got = sorted((r.file_id, r.kind, r.name, r.start_line, r.end_line) for r in extract.syntax_blocks(df, "file_id").collect())
    assert got == [(1, "class", "A", 1, 3), (1, "function", "f", 2, 3), (1, "function", "g", 5, 7), (2, "function", "broken", 1, 1), (3, "function", "h", 1, 2)]


def test_edges_from_text(spark):
    df = spark.createDataFrame([("a/b.py", "import os.path\nfrom x import y\nconst z = require('./q/r');\nuse a::b;\n#include <c/d.h>\n")], "file_path string, text string")
    got = sorted(r.target_symbol for r in extract.import_edges(df).collect())
    assert got == sorted(["os.path", "x", "..q.r", "a::b", "c.d.h"])
    b = spark.createDataFrame([("a.py", "f", "def f():\n  g_1(2)\n  if (x): ab(1); print(f(3))\n  g_1 (4)")], "file_path string, name string, content string")
    assert [r.target_symbol for r in extract.call_edges(b).collect()] == ["g_1", "g_1"]


@pytest.mark.parametrize(
    "path, want",
    [("a/x.log", True), ("keep.log", False), (".env.example", True), ("src/build/x.py", True), ("lib/a.py", False), ("lib/deep/only/x.txt", True), ("other/only/x.txt", False), ("q/ab.py", True), ("q/zb.py", False), ("build/keep.log", True)],
)
def test_ignore_rules(spark, path, want):
    rules = workspace.compile_rules([("", "*.log"), ("", "!keep.log"), ("lib", "only/"), ("", "q/[!z]?.py"), ("", "# note"), ("", "  ")])
    got = workspace.ignored(spark.createDataFrame([(path,)], "file_path string"), rules).first()
    assert got.ignored == want


@pytest.mark.parametrize(
    "url, want",
    [("git@github.com:Face-Book/react.js.git", ("face_book", "react_js")), ("https://h.example/Psf/requests", ("psf", "requests")), ("garbage", ("external_org", "git_repo")), ("", ("external_org", "git_repo"))],
)
def test_repo_urls(spark, url, want):
    org, repo = T.repo_of_url(F.col("u"))
    r = spark.createDataFrame([(url,)], "u string").select(org.alias("o"), repo.alias("r")).first()
    assert (r.o, r.r) == want


def test_read_lines(spark):
    f = spark.createDataFrame([("a.py", "l1\nl2\nl3\nl4\nl5\nl6\n")], "file_path string, text string")
    asked = spark.createDataFrame([(1, "a.py", 3, 4), (2, "no.py", 1, 2)], "query_id int, file_path string, first int, last int")
    got = {r.query_id: r.excerpt for r in workspace.read_lines(f, asked).collect()}
    assert got[1].split("\n")[0] == "--- a.py (Lines 1-9) ---" and got[1].split("\n")[1:] == [f"   {i} | l{i}" for i in range(1, 7)]
    assert got[2].startswith("[ERROR]")


def test_path_resolution(spark):
    f = spark.createDataFrame([("src/a.py",), ("lib/src/b.py",)], "file_path string")
    asked = spark.createDataFrame([(1, "src/a.py"), (2, "ws/src/a.py"), (3, "src/b.py"), (4, "zzz.py")], "query_id int, file_path string")
    got = {r.query_id: r.file_path for r in workspace.resolve_paths(asked, f).collect()}
    assert got == {1: "src/a.py", 2: "src/a.py", 3: "lib/src/b.py", 4: None}


def test_workspace_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.GO").write_text("package b\n")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / ".gitignore").write_text("pkg/\n")
    got = {r.file_path: (r.text, r.lang) for r in workspace.scan_workspace(spark, str(tmp_path)).collect()}
    assert got == {"pkg/a.py": ("x = ''\n", "python"), "b.GO": ("package b\n", "go")}
    assert workspace.read_ignore_files(spark, str(tmp_path)) == [("", "pkg/")]


def test_guide_docs(spark, tmp_path):
    (tmp_path / "deploy").mkdir()
    (tmp_path / "deploy" / "GUIDE.md").write_text("---\nname: Deploy\ndescription: \"how to\"\n---\n\nSteps.\n")
    r = workspace.guide_docs(spark, str(tmp_path)).first()
    assert (r["name"], r.description, r.body) == ("Deploy", "how to", "Steps.")


def test_concern_is_a_substring(spark):
    assert one(spark, T.concern(F.lit("src/capital.py"), F.lit("x"))) == "api_controllers"
    assert one(spark, T.concern(F.lit("a"), F.lit(None).cast("string"))) == "general"


def test_token_metrics(spark):
    h = spark.createDataFrame([(1, "r", "f", "ab"), (1, "r", "f", "abcd"), (1, "r", "f", "abcd")], "query_id int, repo_id string, file_path string, content string")
    f = spark.createDataFrame([("r", "f", 100)], "repo_id string, file_path string, bytes int")
    r = store.token_metrics(h, f).first()
    assert (r.retrieved_tokens, r.whole_files_tokens, r.tokens_saved, r.savings_percent) == (2, 25, 23, 92.0)


def test_fuzzy_wildcards_are_literal(spark):
    b = spark.createDataFrame([(1, "a_b", "f", 1), (2, "axb", "f", 2), (3, "A_BC", "f", 3)], "block_id int, name string, file_path string, start_line int")
    w = spark.createDataFrame([(1, "a_b"), (1, "b")], "query_id int, symbol string")
    got = [(r.symbol, r.block_id) for r in store.find_symbol(b, w, False).orderBy("symbol", "rank").collect()]
    assert got == [("a_b", 1), ("a_b", 3), ("b", 3), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("scope", [None, "repo"])
@pytest.mark.parametrize("most", [0, 400_000])
def test_fuzzy_search_answers_each_symbol_once(spark, monkeypatch, most, scope):
    monkeypatch.setattr(store, "BROADCAST_ROWS", most)
    rows = [(i, ["getA", "GETa", "forget", "a_b", "x", "get", "ge", None, ""][i % 9], f"f{i % 4}", i % 5, f"r{i % 2}") for i in range(90)]
    wanted = [(q, x, f"r{q % 2}") for q in range(6) for x in ("get", "GET", "e", "ge", "a_", "", "zzz")]
    b = spark.createDataFrame(rows, "block_id int, name string, file_path string, start_line int, repo string")
    w = spark.createDataFrame(wanted, "query_id int, symbol string, repo string")
    for exact in (False, True):
        want = set()
        for q, x, repo in wanted:
            ok = [r for r in rows if x and r[1] and (x.lower() == r[1].lower() if exact else x.lower() in r[1].lower()) and (scope is None or r[4] == repo)]
            ok.sort(key=lambda r: (r[1].lower() != x.lower(), r[1], r[2], r[3], r[0]))
            want |= {(q, x, r[0], n) for n, r in enumerate(ok[:7], 1)}
        got = store.find_symbol(b, w, exact, 7, scope)
        assert {(r.query_id, r.symbol, r.block_id, r["rank"]) for r in got.collect()} == want
        # matches are cut before queries multiply them
        assert all("query_id" not in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x)



def events(spark, *rows):
    return spark.createDataFrame([(p, o, t, x) for p, o, t, x in rows], "path string, op string, ts long, text string").withColumn("ts", F.timestamp_seconds("ts"))


def test_changes(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, text string")
    e = events(spark, ("a", "modified", 1, "x"), ("a", "modified", 2, "y"), ("b", "removed", 1, None), ("d", "added", 5, "z"), ("d", "removed", 5, None), (None, "added", 1, "q"))
    got = {r.path: r.text for r in sync.apply_changes(files, e).collect()}
    assert got == {"a": "y", "c": "3", "d": "z"}
    first, second = e.where("ts < timestamp_seconds(2)"), e.where("ts >= timestamp_seconds(2)")
    twice = sync.apply_changes(sync.apply_changes(files, first), second)
    assert {r.path: r.text for r in twice.collect()} == got


def test_listing_and_push(spark):
    l = lambda *r: spark.createDataFrame(list(r), "path string, hash string")
    got = {r.path: r.op for r in sync.listing_changes(l(("a", "1"), ("b", "2"), ("c", "3")), l(("a", "1"), ("b", "9"), ("d", "4"))).collect()}
    assert got == {"b": "modified", "c": "removed", "d": "added"}
    p = spark.createDataFrame([(1, [(["x"], [], ["y"]), ([], ["x"], [])])], "pushed_at int, commits array<struct<added: array<string>, modified: array<string>, removed: array<string>>>")
    assert {(r.path, r.op) for r in sync.push_events(p).collect()} == {("x", "added"), ("y", "removed"), ("x", "modified")}


def test_stream_of_changes(spark, tmp_path):
    drop = tmp_path / "drop"
    e = events(spark, ("a", "added", 1, "x"), ("b", "added", 1, "y"))
    e.coalesce(1).write.parquet(str(drop))
    out, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    run = lambda: sync.stream_changes(spark.readStream.schema(e.schema).parquet(str(drop)), out, mark).awaitTermination()
    run()
    events(spark, ("a", "removed", 2, None), ("c", "added", 2, "z")).coalesce(1).write.mode("append").parquet(str(drop))
    run()
    now = sync.current_version(e, out)
    assert {r.path: r.text for r in spark.read.parquet(now).collect()} == {"b": "y", "c": "z"}


def test_context_bundle_on_a_small_corpus(spark):
    blocks = spark.createDataFrame(
        [(1, "loadUser", "function", "src/service.py", 1, 5, "def loadUser():\n    '''Loads.'''\n    fetch()", "r"), (2, "fetch", "function", "src/db.py", 1, 3, "def fetch(): pass", "r"), (3, "loadUser", "function", "x.py", 1, 2, "secret", "other")],
        "block_id long, name string, kind string, file_path string, start_line int, end_line int, content string, repo_id string",
    )
    files = blocks.select("repo_id", "file_path").unionByName(spark.createDataFrame([("r", "t/test_service.py")], "repo_id string, file_path string"))
    req = spark.createDataFrame([(1, "where is loadUser", 3, "r", None), (2, "", 3, "r", None), (3, None, None, "r", 4)], "query_id long, query string, top_k int, repo_id string, max_chunk_chars int")
    out = {r.query_id: r for r in context.context(blocks, files, calls(spark, ("loadUser", "fetch")).withColumn("source_file", F.lit("src/service.py")), req)["bundle"].collect()}
    assert out[1].chunks[0].name == "loadUser" and out[1].confidence_rating == "VERY_HIGH" and list(out[1].related_tests) == ["t/test_service.py"]
    assert all(c.block_id != 3 for c in out[1].chunks) and out[2].total_chunks == 0 and out[3].total_chunks == 0


def test_package_without_training_operators():
    """Nothing outside the optional subpackage imports it."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "skerry")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "skerry.llm" not in open(os.path.join(folder, n)).read(), n


# --- round two: wiring of the bundled query, blocked search, stored tables ------------------------------


def _tiny(spark):
    rows = [(1, "ledgerFold", "function", "src/ledger.py", 1, 5, "def ledgerFold(x):\n    return x\n", "r"), (2, "other", "function", "src/other.py", 1, 3, "def other():\n    return ledgerFold(1)\n", "r"), (3, "ledgerFar", "function", "src/far.py", 1, 3, "def ledgerFar(): pass", "q")]
    blocks = spark.createDataFrame(rows, "block_id long, name string, kind string, file_path string, start_line int, end_line int, content string, repo_id string")
    files = spark.createDataFrame([("r", "src/ledger.py", 400), ("r", "src/other.py", 200), ("r", "src/test_other.py", 10), ("q", "src/far.py", 8)], "repo_id string, file_path string, bytes int")
    edges = spark.createDataFrame([("src/other.py", "other", "", "ledgerFold", "calls", 1.0, "r"), ("src/other.py", "", "", "ledger", "imports", 1.0, "r")], "source_file string, source_symbol string, target_file string, target_symbol string, relation string, confidence double, repo_id string")
    return blocks, files, edges


def test_context_falls_back_expands_and_measures(spark):
    from skerry.operators import context

    blocks, files, edges = _tiny(spark)
    asked = [(1, "edgerfol", 3, "r", 0, 1), (2, "other tests and api", 3, "r", 0, 2), (3, None, None, "r", None, None), (4, "ledgerFold", 2, "r", 0, 1)]
    req = spark.createDataFrame(asked, "query_id long, query string, top_k int, repo_id string, max_chunk_chars int, expand_depth int")
    got = context.context(blocks, files, edges, req)
    chunks = {(r.query_id, r.block_id): r for r in got["chunks"].collect()}
    # no word of the first query stands anywhere; a name of its repository holds it
    assert chunks[1, 1].score == context.FALLBACK_SCORE and (1, 3) not in chunks
    assert chunks[4, 1].match_type == "exact_symbol"
    deps = {(r.query_id, r.source_file, r.target_file, r.hop) for r in got["dependencies"].collect()}
    assert (2, "src/other.py", "src/ledger.py", 1) in deps or (2, "src/other.py", "src/ledger.py", 0) in deps
    bundle = {r.query_id: r for r in got["bundle"].collect()}
    assert bundle[1].confidence_rating == "HIGH" and bundle[1].whole_files_tokens == 100 and bundle[3].total_chunks == 0
    assert bundle[2].related_tests == ["src/test_other.py"] and bundle[2].n_dependencies >= 1
    # vectors of other repositories are not taken in
    dense = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], "query_id long, id long, rank int")
    ids = {r.block_id for r in context.context(blocks, files, edges, req, dense)["chunks"].where("query_id = 1").collect()}
    assert 2 in ids and 3 not in ids


def test_blocked_search_equals_the_held_one(spark):
    import numpy as np

    from skerry.operators import dense

    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (300, 8)).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 1), (902, [1.0], None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    q = v.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    for by in (None, "label"):
        a, b = (dense.top_k(v, q, 5, dim=8, drop_self=True, by=by, held=h) for h in (8192, 0))
        assert key(a) == key(b.select(a.columns)) and a.count() == q.count() * 5 * (3 if by else 1)
    assert dense.top_k(v.where("false"), q, 5, dim=8).count() == 0 and dense.top_k(v, q.where("false"), 5, dim=8).count() == 0


def test_stored_tables_follow_their_files(spark, tmp_path):
    from skerry.session import stored

    path = f"file://{tmp_path}/t"
    made = []

    def build(d):
        made.append(1)
        return d.select((F.col("id") + 1).alias("x"))

    spark.range(5).coalesce(1).write.parquet(path)
    for _ in range(2):
        assert stored(spark.read.parquet(path), "t", build).count() == 5
    assert len(made) == 1
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(path)
    assert stored(spark.read.parquet(path), "t", build).count() == 9 and len(made) == 2


def test_batches_replace_what_their_files_held(spark):
    from skerry.operators import store

    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "file_path string, name string, start_line int")
    batch = spark.createDataFrame([(9, "a", "w"), (9, "a", "w"), (8, "a", None), (7, None, "v")], "start_line int, file_path string, name string")
    got = {tuple(r) for r in store.insert_batch(rows, batch, ["file_path"], ["file_path", "name"]).collect()}
    assert got == {("a", "w", 9), ("b", "z", 3)}
    assert store.insert_batch(rows.where("false"), batch.where("false"), ["file_path"], ["file_path", "name"]).count() == 0


def test_spread_runs_no_shuffle_to_count_partitions(spark):
    from skerry.session import spread

    d = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert spread(d) is d
    one = spark.range(0, 10, 1, 1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_index_follows_changes(spark):
    files = spark.createDataFrame([("a.py", "import os\n\ndef one(x):\n    return two(x)\n"), ("b.py", "def two(x):\n    return 1\n"), ("c.txt", "only words here"), ("d.py", "")], "path string, text string")
    e = events(spark, ("a.py", "removed", 3, None), ("b.py", "modified", 3, "def three(y):\n    return two(y)\n"), ("e.py", "added", 3, "class Four:\n    pass\n"))
    got = sync.refresh(sync.index_of(files), e)
    want = sync.index_of(sync.apply_changes(files, e))
    for name in ("blocks", "edges", "postings", "vectors"):
        rows = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
        assert rows(got[name]) == rows(want[name]) and got[name].count() > 0, name
    # embedding in the background adds what is missing, and nothing twice
    have = want["vectors"].limit(1)
    more = sync.embed(want["blocks"], have)
    assert more.count() == want["vectors"].count() - 1 and more.join(have, "id").count() == 0


def test_deltas_are_merged_on_reading_and_compacted(spark, tmp_path):
    drop, out, mark = tmp_path / "drop", f"file://{tmp_path}/table", str(tmp_path / "mark")
    steps = [[("a", "added", 1, "x"), ("b", "added", 1, "y")], [("a", "removed", 2, None), ("c", "added", 2, "z")], [("b", "modified", 3, "w")], [("a", "added", 4, "v")]]
    want = [{"a": "x", "b": "y"}, {"b": "y", "c": "z"}, {"b": "w", "c": "z"}, {"a": "v", "b": "w", "c": "z"}]
    for rows, now in zip(steps, want):
        e = events(spark, *rows)
        e.coalesce(1).write.mode("append").parquet(str(drop))
        sync.stream_deltas(spark.readStream.schema(e.schema).parquet(str(drop)), out, mark, compact_every=3).awaitTermination()
        assert {r.path: r.text for r in sync.read_deltas(spark, out).collect()} == now
    # three deltas became a base, and went; one came after it
    assert sorted(n for n in os.listdir(tmp_path / "table")) == ["base-000000000002", "delta-000000000003"]
    assert sync.read_deltas(spark, f"file://{tmp_path}/none").count() == 0


def test_bundles_are_whole_or_refused(spark, tmp_path):
    import shutil

    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    with pytest.raises(FileNotFoundError):
        workspace.load_snapshot(spark, a, ["t"])
    workspace.save_snapshot({"t": spark.range(7), "u": spark.range(0)}, a)
    workspace.export_bundle(spark, a, b)
    got = workspace.import_bundle(spark, b)
    assert {k: d.count() for k, d in got.items()} == {"t": 7, "u": 0}
    shutil.rmtree(tmp_path / "b" / "t")
    spark.range(6).write.parquet(f"{b}/t")
    with pytest.raises(ValueError):
        workspace.import_bundle(spark, b)


@pytest.mark.parametrize(
    "glob, yes, no",
    [("[^a].py", ["^.py", "a.py"], ["b.py"]), ("[!^a].py", ["b.py"], ["^.py", "a.py"]), ("[]x].py", ["].py", "x.py"], ["y.py"]), ("[!]x].py", ["y.py"], ["].py", "x.py"]), ("a[b", ["a[b"], ["ab"]), ("[a-c&].py", ["b.py", "&.py"], ["d.py"]),
     ("**/x", ["x", "a/b/x"], ["ax"]), ("a/**", ["a/b/c"], ["a"]), ("?*.md", ["ab.md", "a.md"], [".md", "a/b.md"]), ("a.b", ["a.b"], ["axb"])],
)
def test_glob_pieces(glob, yes, no):
    pattern = re.compile(workspace.glob_regex(glob))
    assert all(pattern.match(x) for x in yes) and not any(pattern.match(x) for x in no)


def test_combined_rules_equal_joined_ones(spark):
    import random

    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "lib", "x.py", "y.log", "keep.log", "build", "[b]", "a.b"])
    paths = spark.createDataFrame([("/".join(part() for _ in range(rng.randrange(1, 5))),) for _ in range(300)] + [(None,), ("",)], "file_path string")
    rules = workspace.compile_rules([("", "*.log"), ("", "!keep.log"), ("lib", "a/"), ("", "b/**"), ("a", "/x.py"), ("", "!a/**/x.py"), ("", "[!a-k]*b"), ("", "l**b"), ("", "build/")])
    key = lambda d: sorted((str(r.file_path), r.ignored) for r in d.collect())
    assert key(workspace.ignored(paths, rules)) == key(workspace.ignored(paths, rules, runs=0))


@pytest.mark.parametrize("scope", [None, "repo"])
@pytest.mark.parametrize("chunk, cells, most", [(4, 16, 5), (4096, 1 << 20, 400_000)])
def test_search_by_bounds_equals_all_scores(spark, monkeypatch, chunk, cells, most, scope):
    import random

    rng = random.Random(5)
    vocab = ["who", "calls"] * 8 + [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12))), f"r{i % 3}") for i in range(150)]
    asked = [(q, " ".join(rng.choices(vocab, k=rng.randint(0, 4))), rng.randint(1, 9), f"r{q % 4}") for q in range(60)]
    df = spark.createDataFrame(docs, "id int, text string, repo string").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, query string, top_k int, repo string")
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", most)
    post = sparse.index(df, "id", F.col("text"))
    tasks = [r.asDict() for r in post.collect()]
    toks = {i: spec_tokens(t) for i, t, _ in docs}
    assert {(r["id"], r["term"], r["tf"], r["dl"]) for r in tasks} == {(i, t, x.count(t), len(x)) for i, x in toks.items() for t in x}
    avg = sum(map(len, toks.values())) / len(docs)
    weight = {(r["id"], r["term"]): math.log1p((len(docs) - df_ + 0.5) / (df_ + 0.5)) * r["tf"] * 2.5 / (r["tf"] + 1.5 * (0.25 + 0.75 * r["dl"] / avg)) for r in tasks for df_ in [sum(x["term"] == r["term"] for x in tasks)]}
    want = set()
    for qid, text, k, repo in asked:
        s = [(-round(sum(weight.get((i, t), 0) for t in spec_tokens(text)), 6), i) for i, _, r in docs if scope is None or r == repo]
        want |= {(qid, i, x, n) for n, (x, i) in enumerate(sorted(x for x in s if x[0] < 0)[:k], 1)}
    # chunks and cells as small as this let bounds decide from the first documents on
    monkeypatch.setattr(sparse, "CHUNK", chunk)
    monkeypatch.setattr(sparse, "CELLS", cells)
    got = sparse.search(df, "id", F.col("text"), q, scope=scope)
    assert {(r.query_id, r.id, -r.score, r["rank"]) for r in got.collect()} == want


def test_dense_hits_never_meet_all_blocks_of_a_repository(spark, monkeypatch):
    plans = {}
    kept = context.materialize

    def watched(df, name="step"):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(context, "materialize", watched)
    blocks, files, edges = _tiny(spark)
    req = spark.createDataFrame([(i, "other", 3, "r" if i < 9 else None, 0, 1) for i in range(1, 10)], "query_id long, query string, top_k int, repo_id string, max_chunk_chars int, expand_depth int")
    dense_hits = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (2, 1, 1), (9, 1, 1)], "query_id long, id long, rank int")
    got = context.context(blocks, files, edges, req, dense_hits)
    assert not re.search(r"Join \w+, \(repo_id#\d+L? = repo_id#\d+L?\)\n", plans["ctx_fused"])
    ids = {(r.query_id, r.block_id) for r in got["chunks"].collect()}
    assert {(1, 2), (2, 1)} <= ids and not {(1, 3), (9, 1)} & ids
    # an edge between two chosen files is the nearest there is, one hop or not
    assert {(r.query_id, r.hop) for r in got["dependencies"].where("query_id = 2").collect()} == {(2, 0)}


def test_search_writes_only_what_queries_ask_for(spark, monkeypatch):
    written = {}
    kept = sparse.materialize

    def watched(df, name="step"):
        written[name] = kept(df, name)
        return written[name]

    own = [chr(97 + i % 20) * (1 + i // 20) for i in range(40)]
    docs = [(i, f"alpha word{x} other{x} " + "beta " * (i % 3)) for i, x in enumerate(own)] + [(7, "alpha wordh otherh beta "), (50, None), (51, "")]
    df = spark.createDataFrame(docs, "id int, text string")
    q = spark.createDataFrame([(1, "beta alpha", 4), (2, "nowhere", 3), (3, "", 3), (4, "wordh nowhere", 9)], "query_id int, query string, top_k int")
    post = sparse.index(df, "id", F.col("text"))
    want = {tuple(r) for r in sparse.search(df, "id", F.col("text"), q, post=post).collect()}
    monkeypatch.setattr(sparse, "materialize", watched)
    assert {tuple(r) for r in sparse.search(df, "id", F.col("text"), q).collect()} == want and len(want) == 5
    # the texts hold 82 terms; alpha, beta and wordh are asked for
    assert "postings" not in written
    assert written["asked_terms"].select(F.explode("t.tid")).distinct().count() == 3
    assert sparse.search(df.where("false"), "id", F.col("text"), q).count() == 0
    assert sparse.search(df, "id", F.col("text"), q.where("false")).count() == 0
