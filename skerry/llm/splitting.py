"""Splitting oversized items at natural boundaries, by ranges and offsets.

A text is cut into ranges of ``RANGE`` characters with a halo (files are read by byte ranges in the first
place), and no later row holds more than a range. Each range reports its boundary table (offsets
after which a cut is natural, and their rank). The tables of a text stream through its planner in
order: lengths are summed up, which places each range, marks seen in halos only are left to the range
they belong to, and cuts are planned on offsets alone. Pieces are then emitted by offset from the
ranges that they touch.

Cut rule: from the previous cut, the furthest line end within the limit; if there is none, the
furthest statement end (``;``, ``{``, ``}``, ``,``); then white space; then the limit itself, though
never inside CRLF. The next piece begins ``overlap`` characters before the cut, so that consecutive
pieces share exactly that many characters and no piece exceeds the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.session import materialize, spread, table

RANGE = 65_536
#: Ids of texts to be cut up to this many are broadcast; beyond, boundaries of all texts are found first.
BROADCAST_ROWS = 400_000
HALO = 2
LINE, STATEMENT, SPACE = 3, 2, 1
_MARKS = re.compile(r"\r\n|\n|\r(?!\n)|[;{},]|[ \t]+")


def marks(text: str) -> tuple[list[int], list[int]]:
    """Offsets after which a cut is natural, and their ranks."""
    at, rank = [], []
    for m in _MARKS.finditer(text):
        c = text[m.start()]
        at.append(m.end())
        rank.append(LINE if c in "\r\n" else STATEMENT if c in ";{}," else SPACE)
    return at, rank


def plan(n: int, at: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) offsets of the pieces of a text of ``n`` characters."""
    overlap = max(0, min(overlap, limit - 1))
    by = {r: at[rank == r] for r in (LINE, STATEMENT, SPACE)}
    pieces, start, done = [], 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n))
            return pieces
        end = 0
        for r in (LINE, STATEMENT, SPACE):
            k = int(np.searchsorted(by[r], start + limit, "right")) - 1
            if k >= 0 and by[r][k] > max(done, start + overlap):
                end = int(by[r][k])
                break
        if not end:
            end = start + limit
        pieces.append((start, end))
        done = end
        start = end - overlap


RANGED = "first_line int, r int, part string, before string, after string"


def _windows(text: str, size: int) -> Iterator[tuple[int, str, str, str]]:
    """(r, part, halo before, halo after) of the ranges of a text."""
    for r, at in enumerate(range(0, max(len(text), 1), size)):
        yield r, text[at : at + size], text[max(at - HALO, 0) : at], text[at + size : at + size + HALO]


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, cols = [], [[], [], [], []]
        held = 0
        for i, text in enumerate(b.column("text").to_pylist()):
            for w in _windows(text, size):
                rows.append(i)
                held += len(w[1])
                for c, v in zip(cols, w):
                    c.append(v)
                if held > 32 * size:
                    yield _ranged(b, rows, cols)
                    rows, cols, held = [], [[], [], [], []], 0
        yield _ranged(b, rows, cols)


def _ranged(b: pa.RecordBatch, rows: list[int], cols: list[list]) -> pa.RecordBatch:
    pick = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([b.column("id").take(pick), b.column("first_line").take(pick), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], ["id", "first_line", "r", "part", "before", "after"])


def ranges_of(df: DataFrame, id_col: str, text_col: str, line_col: str, range_chars: int = RANGE, longer_than: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """``(id, first_line, r, part, before, after)``: the texts longer than ``longer_than`` characters (of
    ``ids(id)`` only, where given) as ranges; from here on no row holds more than a range and its halos.

    Null ids and texts take no part; a null first line counts as 1.
    """
    src = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > longer_than)).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(line_col), F.lit(1)).cast("int").alias("first_line"), F.col(text_col).alias("text")
    )
    if ids is not None and ids.count() <= BROADCAST_ROWS:
        src = src.join(F.broadcast(ids), "id", "left_semi")
    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(lambda it: _cut(it, range_chars), f"id {kind}, {RANGED}")


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Byte ranges of files: a range owns the characters whose first byte lies in it."""
    from pyarrow import fs

    for b in batches:
        out = [[], [], [], []]
        for path, r, n in zip(*(b.column(c).to_pylist() for c in ("id", "r", "n"))):
            where, name = fs.FileSystem.from_uri(path)
            lo, hi = r * size, min((r + 1) * size, n)
            with where.open_input_file(name) as f:
                first = max(lo - 4 * HALO - 3, 0)
                f.seek(first)
                raw = f.read(hi - first + 4 * HALO + 6)
            lead = lambda at: next((k for k in range(at, len(raw)) if raw[k] & 0xC0 != 0x80), len(raw))
            begin, end = lead(lo - first), lead(hi - first) if hi < n else len(raw)
            show = lambda x: x.decode("utf-8", "replace")
            last = max(k for k in range(len(raw) + 1) if k == len(raw) and hi >= n or k < len(raw) and raw[k] & 0xC0 != 0x80) if raw else 0
            for c, v in zip(out, (r, show(raw[begin:end]), show(raw[lead(0) : begin])[-HALO:], show(raw[end : max(last, end)])[:HALO])):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([1] * b.num_rows, pa.int32()), pa.array(out[0], pa.int32()), *(pa.array(c, pa.string()) for c in out[1:])], ["id", "first_line", "r", "part", "before", "after"])


def ranges_of_files(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The same for ``files(path, size)`` in UTF-8, read by byte ranges: no task loads a whole file. Invalid
    bytes become replacement characters; null paths and empty files are left out."""
    r = F.explode(F.expr(f"sequence(0, cast((size - 1) div {range_bytes} as int))"))
    parts = files.where("path is not null and size > 0").select(F.col("path").alias("id"), r.alias("r"), F.col("size").cast("long").alias("n"))
    return parts.repartition(spark.sparkContext.defaultParallelism * 4, "id", "r").mapInArrow(lambda it: _read(it, range_bytes), f"id string, {RANGED}")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends, ranks, size = [], [], []
        for part, before, after in zip(*(b.column(c).to_pylist() for c in ("part", "before", "after"))):
            at, rank = marks(before + part + after)
            a, k = np.array(at, np.int64) - len(before), np.array(rank, np.int8)
            # a mark belongs to the range that holds the character before the cut
            own = (a > 0) & (a <= len(part))
            ends.append(a[own].astype(np.int32))
            ranks.append(k[own])
            size.append(len(part))
        flat = lambda xs, t: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in xs]).astype(np.int32)), pa.array(np.concatenate(xs) if xs else np.zeros(0), t))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("first_line"), b.column("r"), pa.array(size, pa.int32()), flat(ends, pa.int32()), flat(ranks, pa.int8())], ["id", "first_line", "r", "n", "at", "rank"])


def boundary_tables(ranges: DataFrame) -> DataFrame:
    """``(id, first_line, r, n, at, rank)``: length and boundary table of each range, offsets from its start."""
    kind = ranges.schema["id"].dataType.simpleString()
    return ranges.mapInArrow(_tables, f"id {kind}, first_line int, r int, n int, at array<int>, rank array<tinyint>")


class _Text:
    """Plans the pieces of one text for several limits while its ranges come in order.

    Lengths are summed up as they come, which places every range; what lies before the last cut (less the
    overlap) of every job is dropped, so at most a limit and a range of marks are held.
    """

    def __init__(self, first_line: int, jobs: list[tuple[int, int]]):
        self.line0, self.jobs = first_line, [(limit, max(0, min(overlap, limit - 1))) for limit, overlap in jobs]
        self.asked = jobs
        self.state = [[0, 0, 0] for _ in jobs]  # start, last cut, number of the next piece
        self.total, self.dropped = 0, 0
        self.at, self.rank = np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.begins: list[tuple[int, int]] = []
        self.out: list[tuple] = []

    def add(self, r: int, n: int, at: np.ndarray, rank: np.ndarray) -> None:
        self.begins.append((r, self.total))
        self.at, self.rank = np.concatenate([self.at, self.total + at.astype(np.int64)]), np.concatenate([self.rank, rank])
        self.total += n
        self._advance(False)
        low = min((start for start, _, _ in self.state), default=0)
        gone = int(np.searchsorted(self.at, low, "right"))
        self.dropped += int((self.rank[:gone] == LINE).sum())
        self.at, self.rank = self.at[gone:], self.rank[gone:]
        while len(self.begins) > 1 and self.begins[1][1] <= low:
            self.begins.pop(0)

    def _advance(self, ended: bool) -> None:
        by = {k: self.at[self.rank == k] for k in (LINE, STATEMENT, SPACE)}
        for j, (limit, overlap) in enumerate(self.jobs):
            start, done, no = self.state[j]
            while start + limit < self.total or (ended and start + limit >= self.total > limit and done < self.total):
                end = self.total if start + limit >= self.total else 0
                for k in () if end else (LINE, STATEMENT, SPACE):
                    i = int(np.searchsorted(by[k], start + limit, "right")) - 1
                    if i >= 0 and by[k][i] > max(done, start + overlap):
                        end = int(by[k][i])
                        break
                end = end or start + limit
                self._emit(j, no, start, end, by[LINE])
                start, done, no = end - overlap if end < self.total or not ended else end, end, no + 1
            self.state[j] = [start, done, no]

    def _emit(self, j: int, no: int, start: int, end: int, line: np.ndarray) -> None:
        first = self.line0 + self.dropped
        firsts = [b for _, b in self.begins]
        a, z = int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts, end - 1, "right"))
        touched = [{"r": r, "lo": max(start - b, 0), "hi": (end if k + 1 == z else firsts[k + 1]) - b} for k, (r, b) in enumerate(self.begins[a:z], a)]
        self.out.append((*self.asked[j], no, start, end, first + int(np.searchsorted(line, start, "right")), first + int(np.searchsorted(line, max(end - 1, start), "right")), touched))

    def close(self) -> list[tuple]:
        self._advance(True)
        return self.out


PIECES = "limit_chars int, overlap_chars int, piece int, from_char long, to_char long, start_line int, end_line int, slices array<struct<r:int,lo:int,hi:int>>"
_PIECE_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("r", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))]
_PIECE_NAMES = ["id", "limit_chars", "overlap_chars", "piece", "from_char", "to_char", "start_line", "end_line", "slices"]


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts whose ranges come sorted by (id, batch of jobs, r); a repeated range counts once."""
    key, text, last = None, None, -1
    kind = None

    def rows(of: object, made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of] * len(made), kind), *(pa.array([m[k] for m in made], t) for k, t in enumerate(_PIECE_TYPES))], _PIECE_NAMES)

    for b in batches:
        kind = b.schema.field("id").type
        at, rank = b.column("at"), b.column("rank")
        for i, (id_, batch, first, r, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "batch", "first_line", "r", "n")))):
            if (id_, batch) != key:
                if text is not None and (made := text.close()):
                    yield rows(key[0], made)
                key, text, last = (id_, batch), _Text(first, [(x["limit_chars"], x["overlap_chars"]) for x in b.column("jobs")[i].as_py()]), -1
            if r == last:
                continue
            text.add(r, n, at[i].values.to_numpy(zero_copy_only=False), rank[i].values.to_numpy(zero_copy_only=False))
            last = r
            if len(text.out) > 5_000:
                yield rows(id_, text.out)
                text.out = []
    if text is not None and (made := text.close()):
        yield rows(key[0], made)


#: Jobs over one text that one task plans; more are planned in further ones.
BATCH = 64


def plan_pieces(tables: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pieces by offset of each ``jobs(id, limit_chars, overlap_chars)`` whose text is longer than its
    limit, with the slices of ranges they consist of. A null or non-positive limit means none; a null or negative overlap means 0.

    Ranges stream through a task in order; a text in very many ranges never stands in memory as a whole.
    """
    j = jobs.where("limit_chars > 0 and id is not null").select("id", "limit_chars", F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap_chars")).distinct()
    # jobs of one text in batches, by salted counting
    salted = j.withColumn("salt", F.pmod(F.xxhash64("limit_chars", "overlap_chars"), F.lit(16)).cast("int"))
    no = F.row_number().over(W.partitionBy("id", "salt").orderBy("limit_chars", "overlap_chars")) - 1
    few = j.groupBy("id").agg((F.count("*") <= BATCH).alias("few"))
    batch = F.when(F.col("few"), F.lit(0)).otherwise((F.col("no") / BATCH).cast("int") * 16 + F.col("salt"))
    each = salted.withColumn("no", no).join(few, "id").select("id", batch.alias("batch"), F.struct("limit_chars", "overlap_chars").alias("job"))
    each = each.groupBy("id", "batch").agg(F.sort_array(F.collect_list("job")).alias("jobs"))
    kind = tables.schema["id"].dataType.simpleString()
    ready = tables.join(each, "id").repartition("id", "batch").sortWithinPartitions("id", "batch", "r")
    return ready.mapInArrow(_planned, f"id {kind}, {PIECES}")


def emit_pieces(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pieces with their text, assembled from the ranges that each piece touches."""
    key = [c for c in _PIECE_NAMES if c != "slices"]
    want = pieces.select(*key, F.explode("slices").alias("x")).select(*key, "x.r", "x.lo", "x.hi")
    part = ranges.select("id", "r", "part").dropDuplicates(["id", "r"])
    got = want.join(part, ["id", "r"]).select(*key, "r", F.expr("substring(part, lo + 1, hi - lo)").alias("x"))
    return got.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("r", "x")))["x"], "").alias("text"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("request_id", "block_id").distinct()
    limits = table(spark, sf_dir, "context_requests").where("max_chunk_chars > 0").select(
        "request_id", F.col("max_chunk_chars").alias("limit_chars"), F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap_chars")
    ).distinct()
    return chunks.join(limits, "request_id").where("block_id is not null").withColumnRenamed("block_id", "id")


def _cut_blocks(spark: SparkSession, sf_dir: str, range_chars: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, ranges, pieces) of the blocks that requests ask to be cut."""
    jobs = materialize(_jobs(spark, sf_dir), "split_jobs")
    least = jobs.agg(F.min("limit_chars")).first()[0] or 0
    ids = materialize(jobs.select("id").distinct(), "split_ids")
    ranges = ranges_of(table(spark, sf_dir, "blocks"), "block_id", "content", "start_line", range_chars, least, ids)
    return jobs, ranges, plan_pieces(boundary_tables(ranges), jobs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, _, pieces = _cut_blocks(spark, sf_dir)
    cut = pieces.where("piece = 0").select("id", "limit_chars", "overlap_chars")
    return jobs.join(cut, ["id", "limit_chars", "overlap_chars"], "left_semi").select("request_id", F.col("id").alias("block_id")).distinct()


def _pieces(spark: SparkSession, sf_dir: str, range_chars: int = RANGE) -> DataFrame:
    jobs, ranges, pieces = _cut_blocks(spark, sf_dir, range_chars)
    pieces = materialize(pieces, "split_pieces")
    text = emit_pieces(pieces, ranges.join(pieces.select("id").distinct(), "id", "left_semi"))
    return jobs.join(text, ["id", "limit_chars", "overlap_chars"]).select(
        "request_id", F.col("id").alias("block_id"), "piece", "start_line", "end_line", "from_char", "to_char", F.col("text").alias("content")
    )


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of each block that a request has cut, with its text and lines."""
    return _pieces(spark, sf_dir)


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut block put together again from its pieces without the shared characters, by ranges of 1,024
    characters, so that most of these texts span several: number of pieces, characters and a checksum of the text."""
    p = _pieces(spark, sf_dir, 1_024).select("request_id", "block_id", "piece", "from_char", "to_char", "content")
    before = F.lag("to_char").over(W.partitionBy("request_id", "block_id").orderBy("piece"))
    p = p.withColumn("shared", F.coalesce(before - F.col("from_char"), F.lit(0)).cast("int"))
    own = p.select("request_id", "block_id", F.struct("piece", F.expr("substring(content, shared + 1)").alias("x")).alias("part"))
    g = own.groupBy("request_id", "block_id").agg(F.array_join(F.sort_array(F.collect_list("part"))["x"], "").alias("text"))
    return g.select("request_id", "block_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("checksum"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined}
_CUT = """
        FROM (SELECT DISTINCT request_id, block_id FROM chunks) c
        JOIN (SELECT DISTINCT request_id, max_chunk_chars FROM context_requests) q ON q.request_id = c.request_id AND q.max_chunk_chars > 0
        JOIN (SELECT DISTINCT block_id, content FROM blocks) b ON b.block_id = c.block_id
        WHERE length(b.content) > q.max_chunk_chars
"""
SQL = {
    "p5_found": """
        SELECT DISTINCT c.request_id, c.block_id
        FROM chunks c
        JOIN context_requests q ON q.request_id = c.request_id AND q.max_chunk_chars > 0
        JOIN blocks b ON b.block_id = c.block_id
        WHERE length(b.content) > q.max_chunk_chars
    """,
    "p5_rejoined": "SELECT DISTINCT c.request_id, c.block_id, length(b.content) AS chars, md5(b.content) AS checksum" + _CUT,
}
