"""Reading workspaces: files, ignore rules, line ranges, paths, documents, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.functions.text import EXTENSIONS, extension, language

#: Patterns that are always ignored, before any rule of a workspace.
ALWAYS_IGNORED = (
    ".git", ".git/**", "node_modules", "node_modules/**", ".venv", ".venv/**", "venv", "venv/**", "__pycache__", "__pycache__/**", "dist", "dist/**", "build", "build/**", ".pytest_cache", ".pytest_cache/**",
    "storage", "storage/**", ".agents", ".agents/**", ".vscode", ".vscode/**", ".cursor", ".cursor/**", ".env", ".env.*", ".env.local", ".env.production", ".env.development",
    "*.pem", "*.key", "*.crt", "*.cert", "*.pfx", "*.p12", "id_rsa", "id_rsa.pub", "id_ed25519", "id_ed25519.pub", "credentials.json", "service_account*.json", "client_secrets*.json",
    "*.secret", "*.secrets", "*.token", "*.token.*", "*.password", "*.sqlite", "*.sqlite3", "*.db", "*.db3", "*.tar.gz", "*.zip", "*.bin",
)


def tolerant_text(content: Column) -> Column:
    """UTF-8 text of bytes; what can't be decoded is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def scan_workspace(spark: SparkSession, root: str, keep_all: bool = False) -> DataFrame:
    """``(file_path, text, hash, mtime, lang)`` of the registered source files under ``root``, paths
    relative to it. Listing and reading are distributed; the suffix filter runs before the read."""
    any_case = lambda x: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x)
    pattern = "*" if keep_all else "*{" + ",".join(any_case(x) for x in EXTENSIONS) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root if "://" in root else "file:" + root
    path = F.regexp_replace("path", "^" + re.escape(base.rstrip("/")).replace("file:", "file:/*") + "/", "")
    path = F.regexp_replace(path, "^file:/*" + re.escape(root.split("://")[-1].strip("/")) + "/", "")
    text = tolerant_text(F.col("content"))
    return raw.select(path.alias("file_path"), text.alias("text"), F.md5(text).alias("hash"), F.col("modificationTime").alias("mtime"), language(F.col("path")).alias("lang"))


#: What each piece of an ignore pattern stands for; a set closes at the first ``]`` that is not its first member.
_PIECE = re.compile(r"(?P<folders>\*\*/)|(?P<any>\*\*)|(?P<name>\*)|(?P<one>\?)|\[(?P<no>!?)(?P<set>\]?[^\]]*)\]|(?P<plain>.)", re.S)
_MEANS = {"folders": "(?:.+/)?", "any": ".*", "name": "[^/]*", "one": "[^/]"}


def glob_regex(glob: str) -> str:
    """Regular expression of an ignore pattern: ``**/`` any folders, ``**`` anything, ``*`` and ``?``
    within a name, ``[…]`` and ``[!…]`` sets. In a set ``^`` and a first ``]`` are members like any other; a bracket
    that never closes stands for itself."""

    def regex(m: re.Match) -> str:
        if m["set"]:
            return "[" + "^" * len(m["no"]) + re.sub(r"([\\\[\]^&])", r"\\\1", m["set"]) + "]"
        return _MEANS.get(m.lastgroup) or re.escape(m.group())

    return "^" + _PIECE.sub(regex, glob) + "$"


def compile_rules(lines: list[tuple[str, str]], builtin: bool = True) -> list[tuple]:
    """``(rule_idx, base_dir, negation, dir_only, anchored, regex)`` from ``(base_dir, line)`` in order."""
    rules = []
    for base, line in [*(("", p) for p in ALWAYS_IGNORED if builtin), *lines]:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negation = p.startswith("!")
        p = p[1:] if negation else p
        dir_only = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        rules.append((len(rules), base, negation, dir_only, anchored, glob_regex(p.lstrip("/"))))
    return rules


#: Runs of rules of one kind that one expression may hold; beyond, rules are joined.
RUNS = 100


def _runs(rules: list[tuple]) -> list[tuple[bool, bool, str, str]]:
    """(negation, folders only, base folder, regular expression) of neighbouring rules of one kind, in order."""
    runs: list[list] = []
    for _, base, negation, dir_only, anchored, regex in sorted(rules):
        # a rule without a slash holds for the path and for each part of it
        one = regex if anchored else f"(?:{regex}|^(?:.*/)?{regex[1:-1].replace('.*', '[^/]*')}(?:/.*)?$)"
        if runs and runs[-1][:3] == [negation, dir_only, base]:
            runs[-1][3].append(one)
        else:
            runs.append([negation, dir_only, base, [one]])
    return [(n, d, b, "|".join(r)) for n, d, b, r in runs]


def _below(base: Column, p: Column) -> Column:
    """``p`` relative to a base folder, null outside of it."""
    return F.when(base == "", p).when(p == base, "").when(F.startswith(p, F.concat(base, F.lit("/"))), F.substring(p, F.length(base) + 2, F.length(p)))


def ignored(paths: DataFrame, rules: list[tuple], runs: int = RUNS) -> DataFrame:
    """``paths(file_path)`` with ``ignored``: the last matching rule decides for the file and for every
    folder above it; a file under an ignored folder can't be brought back.

    Neighbouring rules of one kind are one literal expression, which is compiled once; each distinct folder is
    tested once. Where rules change their kind more than ``runs`` times, they are joined, as a broadcast (one
    row per line of the ignore files). Null paths are not ignored.
    """
    spark = paths.sparkSession
    every = paths.select("file_path").where("file_path is not null").distinct()
    parts = F.split("file_path", "/")
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("d"))))
    tested = every.select(step.alias("s")).select("s.p", "s.d").distinct()
    grouped = _runs(rules)
    if len(grouped) <= runs:
        out = F.lit(False)
        for negation, dir_only, base, regex in grouped:
            x = _below(F.lit(base), F.col("p")) if base else F.col("p")
            hit = F.coalesce(x.rlike(regex), F.lit(False))
            out = F.when(hit & F.col("d") if dir_only else hit, F.lit(not negation)).otherwise(out)
        verdict = tested.where(out)
    else:
        r = F.broadcast(spark.createDataFrame(rules, "rule_idx int, base_dir string, negation boolean, dir_only boolean, anchored boolean, regex string"))
        hit = tested.crossJoin(r).withColumn("x", _below(F.col("base_dir"), F.col("p"))).where("x is not null and (d or not dir_only)")
        hit = hit.where(F.expr("x rlike regex or (not anchored and exists(split(x, '/'), s -> s rlike regex))"))
        verdict = hit.groupBy("p", "d").agg(F.max_by("negation", "rule_idx").alias("neg")).where("not neg").select("p", "d")
    bad = every.select("file_path", step.alias("s")).select("file_path", "s.p", "s.d").join(verdict, ["p", "d"], "left_semi").select("file_path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(bad, "file_path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def read_ignore_files(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, str]]:
    """``(base_dir, line)`` of the ignore files under ``root``, in path and line order.

    Data sources skip names that begin with a dot, so these few small files are listed and read by
    the file system itself.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    found, it = [], fs.listFiles(top, True)
    while it.hasNext():
        p = it.next().getPath()
        if p.getName() in names:
            found.append(p)
    out = []
    for p in sorted(found, key=lambda p: p.toString()):
        with_stream = fs.open(p)
        text = jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        with_stream.close()
        folder = p.toString()[len(base) :].rpartition("/")[0]
        out += [(folder, line) for line in text.splitlines()]
    return out


def read_lines(files: DataFrame, asked: DataFrame, padding: int = 5) -> DataFrame:
    """``(query_id, file_path, excerpt)`` for ``asked(query_id, file_path, first, last)``: numbered lines
    around a range, under a header that names the (unclipped) range; a missing file says so."""
    lo, hi = F.greatest(F.lit(1), F.coalesce("first", F.lit(1)) - padding), F.coalesce("last", F.lit(50)) + padding
    j = asked.select("query_id", "file_path", lo.alias("lo"), hi.alias("hi")).join(files.select("file_path", "text"), "file_path", "left")
    lines = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    body = F.transform(F.slice(lines, F.col("lo"), F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((i + F.col("lo")).cast("string"), F.greatest(F.lit(4), F.length((i + F.col("lo")).cast("string"))), F.lit(" ")), F.lit(" | "), x))
    ok = F.concat(F.lit("--- "), "file_path", F.lit(" (Lines "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit(") ---\n"), F.array_join(body, "\n"))
    return j.select("query_id", "file_path", F.when(F.col("text").isNull(), F.concat(F.lit("[ERROR] File not found: "), "file_path")).otherwise(ok).alias("excerpt"))


def resolve_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``(query_id, asked, file_path)``: as it is, else without its first part, else the first file (in
    path order) that ends with it. One equi-join per attempt."""
    a = asked.select("query_id", F.col("file_path").alias("asked"), F.regexp_replace(F.regexp_replace(F.trim("file_path"), r"\\", "/"), "^/+", "").alias("p"))
    f = files.select("file_path").distinct()
    same = a.join(f, a.p == f.file_path).select("query_id", "asked", "file_path", F.lit(1).alias("priority"))
    tail = a.withColumn("q", F.regexp_extract("p", r"^[^/]*/(.*)$", 1)).where("q <> ''")
    drop = tail.join(f, tail.q == f.file_path).select("query_id", "asked", "file_path", F.lit(2).alias("priority"))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    ends = a.withColumn("b", last(F.col("p"))).join(f.withColumn("b", last(F.col("file_path"))), "b").where("b <> '' and endswith(file_path, p)").select("query_id", "asked", "file_path", F.lit(3).alias("priority"))
    every = same.unionByName(drop).unionByName(ends)
    best = every.groupBy("query_id", "asked").agg(F.min(F.struct("priority", "file_path")).alias("x"))
    return a.select("query_id", "asked").join(best, ["query_id", "asked"], "left").select("query_id", "asked", F.col("x.file_path").alias("file_path"))


def guide_docs(spark: SparkSession, root: str) -> DataFrame:
    """``(path, name, description, body)`` of markdown guides: front matter and text after it."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("t"))
    head = F.regexp_extract("t", r"(?s)^---\s*\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1), r"^[\"']|[\"']$", ""))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return raw.select("path", F.coalesce(F.when(field("name") != "", field("name")), folder).alias("name"), field("description").alias("description"), F.regexp_replace(F.regexp_replace("t", r"(?s)^---\s*\n.*?\n---\s*", ""), r"^\s+|\s+\z", "").alias("body"))


def save_snapshot(frames: dict[str, DataFrame], path: str, partition: dict[str, list[str]] | None = None) -> None:
    """Write an index version: one table per name, then a marker that names them with their row counts. A
    version without its marker is unfinished, and ``load_snapshot`` refuses it."""
    spark, rows = None, []
    for name, df in frames.items():
        spark = df.sparkSession
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.partitionBy(*partition[name])
        w.parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count()))
    if spark is not None:
        spark.createDataFrame(rows, "name string, n_rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no finished index version at {path}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def export_bundle(spark: SparkSession, path: str, target: str) -> None:
    """Copy a finished index version to another place, its marker last; an older bundle there is replaced."""
    names = [r.name for r in spark.read.parquet(f"{path}/_manifest").collect()]
    save_snapshot(load_snapshot(spark, path, names), target)


def import_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle, checked against the row counts in its marker."""
    told = {r.name: r.n_rows for r in spark.read.parquet(f"{path}/_manifest").collect()}
    frames = load_snapshot(spark, path, list(told))
    for name, df in frames.items():
        if df.count() != told[name]:
            raise ValueError(f"table {name} of the bundle at {path} is damaged")
    return frames


def new_points(points: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Points whose id is not stored yet: what an upsert has to embed."""
    return points.join(stored.select(key).distinct(), key, "left_anti")


def accepted(files: DataFrame) -> DataFrame:
    """Files with a registered suffix."""
    return files.where(language(F.col("file_path")).isNotNull()).withColumn("ext", extension(F.col("file_path")))
