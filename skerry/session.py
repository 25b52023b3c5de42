"""Session helpers: where shared intermediate tables live and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is chosen in local
    mode (tests), and kept for the life of the session; on a cluster a folder of one machine would not do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.conf.get("skerry.shared.dir", None)
    if not made and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="skerry_")
        spark.conf.set("skerry.shared.dir", made)
    return made


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage durably: a lost executor costs no recomputation beyond its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skerry/{name}-{uuid.uuid4().hex[:12]}"
    # the table stands for the plan from here on: shuffle files of the plan go as soon as it is written. A union
    # does not promise its parts' partitioning, as parts that are coalesced at run time may differ in number
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._skerry_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no later step reads. Frames of another origin are left alone."""
    for df in tables:
        path = getattr(df, "_skerry_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, build) -> DataFrame:
    """``build(df)`` as a table, written once per application and state of the input files of ``df``.

    Paths, lengths and times of the files tell the state: when they change, the table is built anew, and the old
    one is deleted.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    state = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        at = path.getFileSystem(conf).getFileStatus(path)
        state.append((f, at.getLen(), at.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(f for f, _, _ in state))
    held = _STORED.get(key)
    if held is None or held[0] != state:
        if held is not None:
            release(held[1])
        held = _STORED[key] = state, materialize(build(df), name)
    return held[1]


_STORED: dict = {}


def slices(spark: SparkSession, rows: int, rows_per_slice: int) -> int:
    """Number of hash slices for a blob shuffle: grows with the data, never below the session's
    shuffle parallelism."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(min(base, 64), -(-rows // rows_per_slice), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wide(plan) -> bool:
    """Whether an optimised plan holds a shuffle, an aggregate or the like: then it is spread already."""
    name = plan.getClass().getSimpleName()
    if any(x in name for x in ("Aggregate", "Join", "Repartition", "Window", "Sort", "Distinct", "Deduplicate", "Limit")):
        return True
    kids = plan.children()
    return any(_wide(kids.apply(i)) for i in range(kids.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out a scan whose file layout gives fewer splits than the cluster has slots.

    A single small file with one row group is read by one task; heavy expressions behind such a
    scan need a round-robin exchange first. Inputs with enough splits are left alone, and so are plans with a
    shuffle of their own, as asking those for their partitions would run it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if _wide(df._jdf.queryExecution().optimizedPlan()) or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def local_session(cpus: int | str = "*", name: str = "skerry") -> SparkSession:
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run. Safe to call often."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_skerry_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    known = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = f"{root}:{known}" if known else str(root)
    if not sc.master.startswith("local["):
        made = Path(tempfile.mkdtemp(prefix="skerry_zip_")) / "skerry.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(Path(__file__).resolve().parent.rglob("*")):
                if p.suffix in {".py", ".txt", ".json"}:
                    z.write(p, p.relative_to(root))
        sc.addPyFile(str(made))
    sc._skerry_shipped = True
