"""Blocks and relation edges from source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import basename
from skerry.session import spread

#: A line that opens a block; its window of lines; calls that are not edges.
OPENS = r"^\s*(?:async\s+)?(?:def|class|function|fn|func|public\s+class|private\s+class|struct|interface|type)\s+([a-zA-Z0-9_]+)"
WINDOW_LINES = 41
MODULE_CHARS = 4000
NOT_CALLS = ("if", "while", "for", "switch", "catch", "return", "print", "len")
#: Imports of Python, require, ES modules, use, include.
IMPORTS = (
    r"(?m)^\s*(?:import|from)\s+([a-zA-Z0-9_\.]+)",
    r"(?m)^\s*const\s+.*?=\s*require\(['\"](.*?)['\"]\)",
    r"(?m)^\s*import\s+.*?from\s+['\"](.*?)['\"]",
    r"(?m)^\s*use\s+([a-zA-Z0-9_:]+);",
    r"(?m)^\s*#include\s+[\"<]([a-zA-Z0-9_\.\/\\]+)[\">]",
)


def scan_blocks(files: DataFrame, keep: list[str], path: str = "file_path", text: str = "text") -> DataFrame:
    """Blocks by line pattern: ``keep``, kind, name, start_line, end_line, content.

    A block is its opening line and up to 40 lines after it; neighbours may overlap. Kind is class if
    the opening line holds class, struct or interface, else function. Null and empty texts give none.
    """
    src = spread(files.where(F.length(text) > 0).select(*keep, F.col(path).alias("__path"), F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n").alias("__lines")))
    b = src.select("*", F.posexplode("__lines").alias("i", "line")).where(F.col("line").rlike(OPENS))
    end = F.least(F.size("__lines"), F.col("i") + WINDOW_LINES)
    return b.select(
        *keep, F.col("__path").alias("file_path"), F.when(F.col("line").rlike("class|struct|interface"), "class").otherwise("function").alias("kind"),
        F.regexp_extract("line", OPENS, 1).alias("name"), (F.col("i") + 1).alias("start_line"), end.alias("end_line"),
        F.array_join(F.slice("__lines", F.col("i") + 1, WINDOW_LINES), "\n").alias("content"),
    )


def module_blocks(files: DataFrame, blocks: DataFrame, key: str, keep: list[str], text: str = "text") -> DataFrame:
    """One ``module`` block for each file that is not blank and has no other: its first characters."""
    rest = files.where(F.trim(F.regexp_replace(text, r"\s", "")) != "").join(blocks.select(key).distinct(), key, "left_anti")
    return rest.select(*keep, F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.size(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")).alias("end_line"), F.substring(text, 1, MODULE_CHARS).alias("content"))


def import_edges(files: DataFrame, path: str = "file_path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Import edges, repeats kept: a line may match several patterns."""
    every = F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in IMPORTS])
    src = spread(files.where(F.length(text) > 0).select(*keep, F.col(path).alias("source_file"), F.col(text)))
    e = src.select(*keep, "source_file", F.explode(every).alias("t"))
    return e.select(*keep, "source_file", basename(F.col("source_file")).alias("source_symbol"), F.lit("").alias("target_file"), F.regexp_replace("t", r"[/\\]", ".").alias("target_symbol"), F.lit("imports").alias("relation"), F.lit(1.0).alias("confidence"))


def call_edges(blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Call edges of ``blocks(file_path, name, content)``, repeats kept; a block's own name and
    control words are no calls."""
    src = spread(blocks.select(*keep, F.col("file_path").alias("source_file"), F.coalesce("name", F.lit("")).alias("source_symbol"), "content"))
    e = src.select(*keep, "source_file", "source_symbol", F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"(?<![a-zA-Z0-9_])([a-zA-Z0-9_]{3,})\s*\("), F.lit(1))).alias("target_symbol"))
    e = e.where((F.col("target_symbol") != F.col("source_symbol")) & ~F.col("target_symbol").isin(*NOT_CALLS))
    return e.select(*keep, "source_file", "source_symbol", F.lit("").alias("target_file"), "target_symbol", F.lit("calls").alias("relation"), F.lit(0.8).alias("confidence"))


def _parsed(batches):
    import ast

    import pyarrow as pa

    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    for b in batches:
        rows, kind, name, first, last, ok = [], [], [], [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            found = []
            try:
                found = [n for n in ast.walk(ast.parse(text.lstrip("\ufeff"))) if type(n) in kinds]
                good = True
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                good = False
            for n in found:
                rows.append(i)
                kind.append(kinds[type(n)])
                name.append(n.name)
                first.append(min([n.lineno, *(d.lineno for d in n.decorator_list)]))
                last.append(n.end_lineno)
                ok.append(True)
            if not good:
                rows.append(i)
                kind.append(None)
                name.append(None)
                first.append(None)
                last.append(None)
                ok.append(False)
        pick = pa.array(rows, pa.int64())
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(pick) for c in keep), pa.array(kind, pa.string()), pa.array(name, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(ok)], [*keep, "kind", "name", "start_line", "end_line", "parsed"]
        )


def syntax_blocks(files: DataFrame, key: str, path: str = "file_path", text: str = "text") -> DataFrame:
    """``(key, kind, name, start_line, end_line)`` with exact ends, nested blocks included.

    Python files are parsed; other files, and Python files that do not parse, go through the line
    scanner. Null and empty texts give no blocks.
    """
    src = files.where(F.length(text) > 0).select(key, F.col(path).alias("file_path"), F.col(text).alias("text"))
    python = src.where(F.lower("file_path").endswith(".py"))
    kind = src.schema[key].dataType.simpleString()
    out = spread(python.select(key, "text")).mapInArrow(_parsed, f"{key} {kind}, kind string, name string, start_line int, end_line int, parsed boolean")
    rest = src.where(~F.lower("file_path").endswith(".py")).unionByName(src.join(out.where("not parsed").select(key).distinct(), key, "left_semi"))
    cols = [key, "kind", "name", "start_line", "end_line"]
    return out.where("parsed").select(cols).unionByName(scan_blocks(rest, [key]).select(cols))
