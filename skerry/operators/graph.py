"""Operators over the relation graph: edges keyed by symbol name.

``edges(source_file, source_symbol, target_file, target_symbol, relation, confidence, repo_id)``.
Every per-seed limit is a row_number with a total order, so results are repeatable. Traversals are
level by level: one join per level, rows already seen removed by an anti-join, and each level written
to the shared folder so that lineage stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.functions.text import ENTRY_POINT, basename, relationship, stem
from skerry.session import materialize

TEST_PATH = "(?i)test|spec|mock"


def calls(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'calls'")


def callers(edges: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """``(symbol, source_symbol, source_file, rank)``: at most ``limit`` callers of each ``seeds(symbol)``."""
    e = calls(edges).where("source_symbol <> ''").select(F.col("target_symbol").alias("symbol"), "source_symbol", "source_file").distinct()
    r = F.row_number().over(W.partitionBy("symbol").orderBy("source_symbol", "source_file"))
    return e.join(seeds.select("symbol").distinct(), "symbol", "left_semi").withColumn("rank", r).where(F.col("rank") <= limit)


def callees(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(file_path, symbol, target_symbol, target_file)`` of each ``seeds(file_path, symbol)``."""
    e = calls(edges).select(F.col("source_file").alias("file_path"), F.col("source_symbol").alias("symbol"), "target_symbol", "target_file").distinct()
    return e.join(seeds.select("file_path", "symbol").distinct(), ["file_path", "symbol"], "left_semi")


def references(edges: DataFrame, blocks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Definitions and referencing edges of each symbol: ``(symbol, role, file_path, name)``."""
    s = seeds.select("symbol").distinct()
    defs = blocks.select(F.col("name").alias("symbol"), F.lit("definition").alias("role"), "file_path", F.col("kind").alias("name"))
    refs = edges.select(F.col("target_symbol").alias("symbol"), F.lit("reference").alias("role"), F.col("source_file").alias("file_path"), F.col("source_symbol").alias("name"))
    return defs.unionByName(refs).join(s, "symbol", "left_semi").distinct()


def outgoing(edges: DataFrame) -> DataFrame:
    """``(file_path, target, relation)``: what each file depends on; the symbol stands in for a file
    that is not known."""
    target = F.coalesce(F.when(F.col("target_file") != "", F.col("target_file")), F.col("target_symbol"))
    return edges.select(F.col("source_file").alias("file_path"), target.alias("target"), "relation").distinct()


def resolve_targets(edges: DataFrame, files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges with ``target_file`` filled in where it can be told, else null.

    Imports: the file of the same repository whose path without suffix, slashes as dots, ends with the
    import (longest path first, then by name). Calls: the file of the only definition of that name in
    the repository. Equi-joins on the last part of the module and on the name; no pairwise search.
    """
    module = lambda p: F.regexp_replace(F.regexp_replace(p, r"\.[^./]*$", ""), "/", ".")
    last = lambda m: F.regexp_extract(m, r"([^.:]+)$", 1)
    f = files.select("repo_id", F.col("file_path").alias("found"), module(F.col("file_path")).alias("module")).distinct().withColumn("tail", last(F.col("module")))
    imp = edges.where("relation = 'imports'").select("repo_id", "target_symbol").distinct()
    want = F.regexp_replace(F.regexp_replace("target_symbol", r"::", "."), r"^\.+", "")
    want = F.regexp_replace(want, r"\.(h|hpp|hh|dart|js|ts)$", "")
    imp = imp.withColumn("want", want).withColumn("tail", last(F.col("want"))).where("tail <> ''")
    hit = imp.join(f, ["repo_id", "tail"]).where("module = want or endswith(module, concat('.', want))")
    by_import = hit.groupBy("repo_id", "target_symbol").agg(F.min_by("found", F.struct(F.length("module"), "found")).alias("hit"))
    one = blocks.where("name <> ''").select("repo_id", F.col("name").alias("target_symbol"), "file_path").distinct()
    by_call = one.groupBy("repo_id", "target_symbol").agg(F.count("*").alias("n"), F.min("file_path").alias("hit")).where("n = 1").drop("n")
    known = by_import.withColumn("relation", F.lit("imports")).unionByName(by_call.withColumn("relation", F.lit("calls")))
    out = edges.join(known, ["repo_id", "target_symbol", "relation"], "left")
    return out.withColumn("target_file", F.coalesce(F.when(F.col("target_file") != "", F.col("target_file")), "hit")).drop("hit")


def dependents(resolved: DataFrame) -> DataFrame:
    """``(file_path, dependent)`` per repository: files that import or call into a file."""
    return resolved.where("target_file is not null and target_file <> source_file").select("repo_id", F.col("target_file").alias("file_path"), F.col("source_file").alias("dependent")).distinct()


def induced(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with both ends in ``files(repo_id, file_path)``, labelled."""
    a = files.select("repo_id", F.col("file_path").alias("source_file")).distinct()
    b = files.select("repo_id", F.col("file_path").alias("target_file")).distinct()
    e = resolved.where("target_file is not null").join(a, ["repo_id", "source_file"], "left_semi").join(b, ["repo_id", "target_file"], "left_semi")
    return e.select("repo_id", "source_file", "target_file", "relation", relationship(F.col("source_file"), F.col("target_file")).alias("label")).distinct()


def companion_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_path, test_path)``: files named after a source, in any folder (root-level files never
    match). Six candidate names per source, one equi-join on the file name; the underscore of a name
    pattern stands for any one character, which a second condition checks."""
    s, b, e = sources.select("file_path").distinct(), stem(F.col("file_path")), F.regexp_extract("file_path", r"[^/](\.[^./]*)$", 1)
    every = F.array(F.concat(F.lit("test_"), b, e), F.concat(b, F.lit("_test"), e), F.concat(b, F.lit(".test"), e), F.concat(b, F.lit(".spec"), e), F.concat(b, F.lit("Test"), e), F.concat(F.lit("Test"), b, e))
    cand = s.select("file_path", F.explode(F.array_distinct(every)).alias("test_name"))
    f = files.select(F.col("file_path").alias("test_path")).distinct().where("instr(test_path, '/') > 0")
    f = f.withColumn("test_name", basename(F.col("test_path")))
    return cand.join(f, "test_name").select("file_path", "test_path").distinct()


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 2, fan: int = 50) -> DataFrame:
    """``(symbol, source_symbol, source_file, level)``: callers of callers by name, breadth first.

    The seed is not marked as seen, so a cycle can bring it back. At most ``fan`` callers per symbol
    and level are followed, in a fixed order.
    """
    e = calls(edges).where("source_symbol <> ''").select("target_symbol", "source_symbol", "source_file").distinct()
    r = F.row_number().over(W.partitionBy("target_symbol").orderBy("source_symbol", "source_file"))
    e = materialize(e.withColumn("r", r).where(F.col("r") <= fan).drop("r"), "fan_in")
    front = seeds.select("symbol", F.col("symbol").alias("at")).distinct()
    seen, rows = None, []
    for level in range(1, depth + 1):
        hit = front.join(e, F.col("at") == e.target_symbol).select("symbol", "source_symbol", "source_file").distinct()
        hit = materialize(hit, "blast")
        rows.append(hit.withColumn("level", F.lit(level)))
        new = hit.select("symbol", F.col("source_symbol").alias("at")).distinct()
        if seen is not None:
            new = new.join(seen, ["symbol", "at"], "left_anti")
        front = materialize(new, "front")
        seen = front if seen is None else seen.unionByName(front)
        if front.isEmpty():
            break
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("symbol", "source_symbol", "source_file").agg(F.min("level").alias("level"))


def blast_summary(radius: DataFrame, most: int = 20) -> DataFrame:
    """Counts and sorted lists per symbol. Lists are cut to ``most`` before they are gathered, so a
    symbol with very many callers never fills one task."""

    def cut(column: str, name: str, rows: DataFrame) -> DataFrame:
        one = rows.select("symbol", F.col(column).alias("x")).distinct()
        r = F.row_number().over(W.partitionBy("symbol").orderBy("x"))
        return one.withColumn("r", r).where(F.col("r") <= most).groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias(name))

    tests = radius.where(F.col("source_file").rlike(TEST_PATH))
    n = radius.groupBy("symbol").agg(F.count_distinct("source_symbol").alias("callers"), F.count_distinct("source_file").alias("files"), F.count_distinct(F.when(F.col("source_file").rlike(TEST_PATH), F.col("source_file"))).alias("n_tests"))
    out = n.join(cut("source_symbol", "caller_list", radius), "symbol").join(cut("source_file", "file_list", radius), "symbol").join(cut("source_file", "tests", tests), "symbol", "left")
    return out.withColumn("tests", F.coalesce("tests", F.array().cast("array<string>")))


def call_paths(edges: DataFrame, pairs: DataFrame, depth: int = 4) -> DataFrame:
    """Simple call paths of at most ``depth`` edges between ``pairs(origin, goal)``: arrays of names,
    shorter first. Only steps that can still reach the goal are followed: the goal's own upstream
    levels are found first, which bounds the enumeration."""
    e = materialize(calls(edges).where("source_symbol <> '' and source_symbol <> target_symbol").select("source_symbol", "target_symbol").distinct(), "call_pairs")
    near = pairs.select("goal", F.col("goal").alias("at"), F.lit(0).alias("left"))
    reach = [near]
    for k in range(1, depth):
        near = near.join(e, F.col("at") == e.target_symbol).select("goal", F.col("source_symbol").alias("at"), F.lit(k).alias("left")).distinct()
        near = materialize(near, "reach")
        reach.append(near)
    can = reduce(DataFrame.unionByName, reach).groupBy("goal", "at").agg(F.min("left").alias("left"))
    can = materialize(can, "reach")
    walk = pairs.select("origin", "goal", F.array("origin").alias("path"), F.col("origin").alias("at")).distinct()
    done = []
    for k in range(1, depth + 1):
        step = walk.join(e, F.col("at") == e.source_symbol).drop("at", "source_symbol").withColumnRenamed("target_symbol", "at")
        step = step.where(~F.array_contains("path", F.col("at"))).withColumn("path", F.concat("path", F.array("at")))
        step = materialize(step.join(can, ["goal", "at"]).where(F.col("left") <= depth - k).drop("left"), "walk")
        done.append(step.where("at = goal").select("origin", "goal", "path"))
        walk = step.where("at <> goal")
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("edges", F.size("path") - 1)


def expand(resolved: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """``(query_id, source, target, label, hop)``: dependencies of the files of ``start(query_id, repo_id,
    file_path)``, ``depth`` (at least 1) hops outward."""
    e = materialize(resolved.where("target_file is not null").select("repo_id", "source_file", "target_file").distinct(), "file_edges")
    front = start.select("query_id", "repo_id", "file_path").distinct()
    seen, rows = front, []
    for hop in range(1, max(1, depth) + 1):
        hit = front.join(e, (front.repo_id == e.repo_id) & (front.file_path == e.source_file)).select("query_id", front.repo_id, "source_file", "target_file")
        hit = materialize(hit.distinct(), "expand")
        rows.append(hit.withColumn("hop", F.lit(hop)))
        front = hit.select("query_id", "repo_id", F.col("target_file").alias("file_path")).distinct().join(seen, ["query_id", "repo_id", "file_path"], "left_anti")
        seen = seen.unionByName(front)
    every = reduce(DataFrame.unionByName, rows)
    out = every.groupBy("query_id", "repo_id", "source_file", "target_file").agg(F.min("hop").alias("hop"))
    return out.withColumn("label", relationship(F.col("source_file"), F.col("target_file")))


def entry_like(file: Column, symbol: Column) -> Column:
    return F.concat_ws(" ", file, symbol).rlike(f"(?i){ENTRY_POINT}")


def trace(edges: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """``(file_path, symbol, side, step, role)``: five callers upward and all callees downward.

    role is entry (looks like one, or has no callers), caller, leaf (defined, without callees), callee
    (defined) or unresolved (not defined).
    """
    t = targets.where("symbol <> '' and symbol <> 'anonymous'").select("file_path", "symbol").distinct()
    c = calls(edges)
    has_callers = c.where("source_symbol <> ''").select(F.col("target_symbol").alias("source_symbol")).distinct().withColumn("called", F.lit(True))
    up = t.join(callers(edges, t, 5), "symbol").join(has_callers, "source_symbol", "left")
    up = up.select("file_path", "symbol", F.lit("up").alias("side"), F.concat_ws(":", "source_file", "source_symbol").alias("step"), F.when(entry_like(F.col("source_file"), F.col("source_symbol")) | F.col("called").isNull(), "entry").otherwise("caller").alias("role"))
    first = blocks.where("name <> ''").groupBy(F.col("name").alias("target_symbol")).agg(F.min(F.struct("file_path", "start_line")).alias("d")).select("target_symbol", F.col("d.file_path").alias("def_file"))
    busy = c.select(F.col("source_file").alias("def_file"), F.col("source_symbol").alias("target_symbol")).distinct().withColumn("busy", F.lit(True))
    down = t.join(callees(edges, t), ["file_path", "symbol"]).join(first, "target_symbol", "left").join(busy, ["def_file", "target_symbol"], "left")
    down = down.select("file_path", "symbol", F.lit("down").alias("side"), F.col("target_symbol").alias("step"), F.when(F.col("def_file").isNull(), "unresolved").when(F.col("busy").isNull(), "leaf").otherwise("callee").alias("role"))
    return up.unionByName(down)


def flow_diagram(traced: DataFrame) -> DataFrame:
    """One line per target: entries, the target, leaves."""
    # steps are cut before they are gathered, so a symbol with very many callers never fills one task
    t = traced.withColumn("end", F.when(F.col("role") == "entry", "a").when(F.col("role").isin("leaf", "unresolved"), "z"))
    one = t.where("end is not null").select("file_path", "symbol", "end", "step").distinct()
    r = F.row_number().over(W.partitionBy("file_path", "symbol", "end").orderBy("step"))
    few = one.withColumn("r", r).where("r <= if(end = 'a', 2, 3)").groupBy("file_path", "symbol").agg(*(F.array_sort(F.collect_list(F.when(F.col("end") == x, F.col("step")))).alias(x) for x in "az"))
    none = F.array().cast("array<string>")
    g = traced.groupBy("file_path", "symbol").agg(F.max(F.col("role") == "unresolved").alias("open")).join(few, ["file_path", "symbol"], "left").withColumn("a", F.coalesce("a", none)).withColumn("z", F.coalesce("z", none))
    show = lambda label, xs, none: F.concat(F.lit(f"{label}: ["), F.when(F.size(xs) > 0, F.array_join(xs, ", ")).otherwise(none), F.lit("]"))
    return g.select("file_path", "symbol", F.concat_ws(" --> ", show("Entry", "a", "Direct / API / Test"), F.concat(F.lit("Target: ["), "symbol", F.lit("]")), show("Leaves", "z", "Local Return")).alias("flow"), (~F.col("open")).alias("fully_traced"))


def affected_tests(resolved: DataFrame, files: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """``(file_path, test_path)``: tests that reach a changed file through dependents, its companions,
    and the changed file itself if it is one. ``changed(repo_id, file_path)``."""
    d = materialize(dependents(resolved), "dependents")
    front = changed.select("repo_id", F.col("file_path").alias("origin"), "file_path").distinct()
    seen = front
    for _ in range(depth):
        nxt = front.join(d, ["repo_id", "file_path"]).select("repo_id", "origin", F.col("dependent").alias("file_path")).distinct()
        front = materialize(nxt.join(seen, ["repo_id", "origin", "file_path"], "left_anti"), "affected")
        seen = seen.unionByName(front)
    near = seen.where(F.col("file_path").rlike(TEST_PATH)).select(F.col("origin").alias("file_path"), F.col("file_path").alias("test_path"))
    return near.unionByName(companion_tests(changed, files)).distinct()
