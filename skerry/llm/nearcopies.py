"""Near-duplicate records with small edits, by covering locality-sensitive hashing.

Every record is reduced to the set of its runs of three words. A sketch of ``7 * GROUPS`` min-wise
hashes is taken from the set; its coordinates form GROUPS groups of seven. In each group the seven
bit masks of the Fano plane keep three coordinates each:

    mask v keeps coordinate i  iff  <bits(i), bits(v)> = 0 over GF(2),  i, v = 1..7.

Whatever two coordinates of a group differ, one mask avoids both, so two sketches that differ in at
most two places of *some* group always meet in a table; by the pigeonhole principle this holds for
every pair that differs in at most ``3 * GROUPS - 1`` of the ``7 * GROUPS`` places. Pairs that meet
are then checked exactly on their whole triple sets, so the result holds no false pair.
A pair of similarity exactly 0.6 fails to meet with probability 0.0003 at seven groups; at 0.65 with
0.00003.

Shuffle layout: a task packs its signatures into one binary block per slice instead of one row per
signature; the reducing side sorts the blocks in numpy. The number of slices grows with the rows.
Signatures made of frequent triples only (boilerplate) would fill huge buckets. A set that has one
emits its prefix instead: of its triples, the rarest first, as many as two sets of the threshold's
similarity cannot both have without sharing one. That is exact, so no pair is lost by it.
Equal sets are one class from the start (the class id is a hash of the set), so copies, even a
third of all rows, cost one entry per task and never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import materialize, slices, spread, table

GROUPS = 7
MIN_WORDS = 30
THRESHOLD = 0.6
#: Copies of one text beyond this many are paired with the class's first member only, unless every pair is asked for.
FULL_CLASS = 64
#: Signatures that more sets than this would share give way to prefixes. A list of frequent triples holds those of at least
#: one set in so many bytes of text, so it does not grow with the input; bytes of text whose triples are counted at once.
BUCKET = 400
SHARE = 5_000_000
PIECE = 24_000_000

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = np.uint64(pow(int(_B), -1, 1 << 64))
    p = np.ones(n + 1, np.uint64)
    q = np.ones(n + 1, np.uint64)
    p[1:] = _B
    q[1:] = inv
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of ASCII letters, digits, underscores; lower-cased) of a byte buffer.

    ``starts``: offsets of the texts (one more than texts). Returns (word hashes, words before each
    text), both from a constant number of passes over the bytes.
    """
    n = len(data)
    mask = _WORD[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    begin[inner] |= mask[inner]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    end[inner - 1] |= mask[inner - 1]
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    pw, inv = _powers(n)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * pw[:n], out=acc[1:])
    h = (acc[e + 1] - acc[b]) * inv[b]
    return _mix(h + (e - b + 1).astype(np.uint64)), np.searchsorted(b, starts)


def triple_sets(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows kept, offsets, sorted distinct triple hashes of each kept row)."""
    texts = texts.cast(pa.large_string())
    buf = texts.buffers()
    off = np.frombuffer(buf[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    w, first = word_hashes(data, off - off[0])
    count = np.diff(first)
    if len(w) < 3:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    t = _mix(w[:-2] * np.uint64(3) + _mix(w[1:-1] * np.uint64(5) + _mix(w[2:])))
    doc = np.repeat(np.arange(len(count)), count)
    ok = (doc[:-2] == doc[2:]) & (count[doc[:-2]] >= max(min_words, 3))
    t, d = t[ok], doc[:-2][ok]
    order = np.lexsort((t, d))
    t, d = t[order], d[order]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    t, d = t[keep], d[keep]
    rows, starts = np.unique(d, return_index=True)
    return rows, np.append(starts, len(t)), t


def _classes(offsets: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    s = np.add.reduceat(_mix(t + np.uint64(77)), offsets[:-1]) + _mix(np.diff(offsets).astype(np.uint64))
    return _mix(s).view(np.int64)


def fano_masks() -> list[list[int]]:
    """Coordinates kept by each of the seven masks."""
    return [[i - 1 for i in range(1, 8) if bin(i & v).count("1") % 2 == 0] for v in range(1, 8)]


def _coordinate(t: np.ndarray, j: int, groups: int) -> np.ndarray:
    """The hash of triples behind sketch coordinate j (one-to-one)."""
    mult = np.random.default_rng(20240607).integers(1, 2**63, 7 * groups, dtype=np.uint64)[j] | np.uint64(1)
    x = t * mult
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def signatures(offsets: np.ndarray, t: np.ndarray, groups: int = GROUPS, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of every set, one per mask of each group, without those whose coordinates all
    fall on ``frequent`` triples; and the rows that have such."""
    n = len(offsets) - 1
    frequent = np.zeros(0, np.uint64) if frequent is None else frequent
    sketch = np.empty((7 * groups, n), np.uint64)
    hot = np.zeros((7 * groups, n), bool)
    for j in range(7 * groups):
        sketch[j] = np.minimum.reduceat(_coordinate(t, j, groups), offsets[:-1])
        if len(frequent):
            f = np.sort(_coordinate(frequent, j, groups))
            hot[j] = f[np.minimum(np.searchsorted(f, sketch[j]), len(f) - 1)] == sketch[j]
    rows, sigs = [], []
    left = np.zeros(n, bool)
    for g in range(groups):
        for v, mask in enumerate(fano_masks()):
            h = np.full(n, np.uint64(g * 7 + v + 1))
            every = np.ones(n, bool)
            for i in mask:
                h = _mix(h * np.uint64(31) + sketch[g * 7 + i])
                every &= hot[g * 7 + i]
            left |= every
            rows.append(np.flatnonzero(~every))
            sigs.append(h[~every])
    return np.concatenate(rows), np.concatenate(sigs), np.flatnonzero(left)


def prefixes(offsets: np.ndarray, t: np.ndarray, rows: np.ndarray, frequent: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the prefix of each of the sets ``rows``: any two of similarity ``threshold`` share a key.

    Sets that share at least ``threshold`` of their union overlap in ``ceil(threshold * size)`` triples of
    either, so what is left of each, and one more, must meet in the common order (rarest first). Keys
    of frequent triples also tell the class of size: similar sets stand in the same or the next one.
    """
    size = np.diff(offsets)[rows]
    at = np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    own, x = np.repeat(np.arange(len(rows)), size), t[at]
    seen = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
    often = np.where(frequent[seen] == x, count[seen], 0)
    order = np.lexsort((x, often, own))
    x, often = x[order], often[order]
    most = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    keep = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) < most[own]
    x, often, own = x[keep], often[keep], own[keep]
    step = (np.log(size) / (np.log(1 / threshold) + 1e-6)).astype(np.int64)[own] + 1
    hot = often > 0
    key = [_mix(x[~hot] + np.uint64(7_919))]
    for nxt in (0, 1):
        key.append(_mix(_mix(x[hot] + np.uint64(7_919)) + (step[hot] + nxt).astype(np.uint64)))
    return rows[np.concatenate([own[~hot], own[hot], own[hot]])], np.concatenate(key)


def _often(batches: Iterator[pa.RecordBatch], min_words: int, least: float, whole: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Triples that may stand in ``least`` sets of the ``whole`` bytes of text: those with their share of it in a piece of
    the texts. What stays below its share in every piece stays below ``least`` in all."""
    held, size = [], 0

    def found() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u[c >= least * size / whole - 1e-6].view(np.int64))], ["t"])

    for batch in batches:
        held.append(triple_sets(batch.column(0), min_words)[2])
        size += pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        if size >= piece:
            yield found()
            held, size = [], 0
    if held:
        yield found()


def _counted(batches: Iterator[pa.RecordBatch], min_words: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The number of sets of a task that hold each of the sorted triples ``often``."""
    n = np.zeros(len(often), np.int64)
    for batch in batches:
        t = triple_sets(batch.column(0), min_words)[2]
        at = np.minimum(np.searchsorted(often, t), len(often) - 1)
        n += np.bincount(at[often[at] == t], minlength=len(often))
    yield pa.RecordBatch.from_arrays([pa.array(often[n > 0].view(np.int64)), pa.array(n[n > 0])], ["t", "c"])


def _sign(batches: Iterator[pa.RecordBatch], n_slices: int, min_words: int, groups: int, frequent: np.ndarray, count: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, off, t = triple_sets(batch.column(0), min_words)
        if not len(rows):
            continue
        cls = _classes(off, t)
        _, once = np.unique(cls, return_index=True)
        row, flat, left = signatures(off, t, groups, frequent)
        if len(left):
            more = prefixes(off, t, left, frequent, count, threshold)
            row, flat = np.concatenate([row, more[0]]), np.concatenate([flat, more[1]])
        first = np.zeros(len(cls), bool)
        first[once] = True
        row, flat = row[first[row]], flat[first[row]]
        part = (flat % np.uint64(n_slices)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        pair = np.stack([flat[order], cls[row[order]].view(np.uint64)], 1)
        cut = np.searchsorted(part[order], np.arange(n_slices + 1))
        blobs = [pair[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_slices, dtype=np.int32)), pa.array(blobs, pa.binary())], ["slice", "blob"])


def _meet(tbl: pa.Table) -> pa.Table:
    """Distinct pairs of classes that share a signature, from one slice."""
    pair = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in tbl.column("blob").to_pylist()] or [np.zeros((0, 2), np.uint64)])
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    sig, cls = pair[:, 0], pair[:, 1].view(np.int64)
    if len(pair):
        keep = np.ones(len(pair), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[keep], cls[keep]
    found: list[np.ndarray] = []
    # the d-th neighbour in the sorted run, for growing d, until no bucket is that long
    live = np.arange(len(sig))
    d = 1
    while True:
        live = live[live + d < len(sig)]
        live = live[sig[live] == sig[live + d]]
        if not len(live):
            break
        a, b = cls[live], cls[live + d]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        if sum(map(len, found)) > 4_000_000 and len(found) > 1:
            found = [_distinct(np.concatenate(found))]
        d += 1
    out = _distinct(np.concatenate(found)) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def _distinct(p: np.ndarray) -> np.ndarray:
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != p[:-1]).any(1)
    return p[keep]


def _members(batches: Iterator[pa.RecordBatch], min_words: int, with_set: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, off, t = triple_sets(batch.column(1), min_words)
        cls = _classes(off, t) if len(rows) else np.zeros(0, np.int64)
        cols = [batch.column(0).take(pa.array(rows)), pa.array(cls)]
        if with_set:
            cols = [cols[1], pa.array([t[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["cls", "bits"] if with_set else ["id", "cls"])


def _judge(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {n: batch.column(n) for n in ("a", "b", "bits_a", "bits_b")}
        ok = []
        for x, y in zip(c["bits_a"], c["bits_b"]):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([c["a"].filter(ok), c["b"].filter(ok)], ["a", "b"])


def frequent_triples(src: DataFrame, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(triples, counts) of those that BUCKET or more of all sets hold, or one set in SHARE bytes of text if that is more.

    Every set is counted: one pass finds what may be frequent, a second counts it. They decide which signatures give
    way to prefixes, never which pairs count: both sets of a pair
    that shares such a signature emit their prefixes, in one order.
    """
    whole = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least, none = max(BUCKET, whole / SHARE), np.zeros(0, np.uint64)
    texts, piece = src.select("text"), PIECE
    may = texts.mapInArrow(lambda it: _often(it, min_words, least, whole, piece), "t long").distinct().toArrow()
    often = np.sort(may.column("t").to_numpy().astype(np.int64).view(np.uint64))
    if not len(often):
        return none, none.astype(np.int64)
    got = texts.mapInArrow(lambda it: _counted(it, min_words, often), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= least).toArrow()
    f, c = (got.column(k).to_numpy().astype(np.int64) for k in ("t", "c"))
    order = np.argsort(f.view(np.uint64))
    return f.view(np.uint64)[order], c[order]


def near_copies(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal triple sets and the linked pairs of classes.

    Returns ``members(id, cls)``, one row per record that takes part, and ``links(a, b)``, the pairs
    of different classes with at least ``threshold`` of their triples in common (``a < b``).

    Nulls: a record whose text is null, or has fewer than ``min_words`` words, takes no part; a null
    id is dropped. Repeated rows (same id) count once. An empty table gives two empty results. Other
    columns of ``df``, whatever their names, are ignored. Texts are used whole.
    """
    spark = df.sparkSession
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    n = src.count()
    cut = slices(spark, n, 20_000)
    frequent, count = frequent_triples(src, min_words)
    blobs = src.select("text").mapInArrow(lambda it: _sign(it, cut, min_words, groups, frequent, count, threshold), "slice int, blob binary")
    found = blobs.groupBy("slice").applyInArrow(_meet, "a long, b long")
    cand = materialize(found.distinct(), "near_candidates")
    sets = src.mapInArrow(lambda it: _members(it, min_words, True), "cls long, bits binary")
    ends = cand.select(F.col("a").alias("cls")).union(cand.select("b")).distinct()
    sets = sets.join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("bits").alias("bits"))
    pairs = (
        cand.join(sets.select(F.col("cls").alias("a"), F.col("bits").alias("bits_a")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("bits").alias("bits_b")), "b")
    )
    links = pairs.mapInArrow(lambda it: _judge(it, threshold), "a long, b long")
    members = src.mapInArrow(lambda it: _members(it, min_words, False), f"id {df.schema[id_col].dataType.simpleString()}, cls long").distinct()
    return members, links


def near_copy_pairs(df: DataFrame, id_col: str, text_col: str, full_class: int | None = FULL_CLASS, **kw) -> DataFrame:
    """``(a, b)`` pairs of ids, smaller first, of records with enough triples in common.

    With ``full_class`` None every pair is given, however large the classes. Else a class of up to that many equal records is expanded into all of its pairs, also across links;
    of a larger class the smallest id stands for it in links, and each other member is paired with
    that id, so that connected groups stay whole while the output stays linear in hot copies.
    """
    members, links = near_copies(df, id_col, text_col, **kw)
    links = materialize(links, "near_links")
    ends = links.select(F.col("a").alias("cls")).union(links.select("b")).distinct()
    size = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    some = size.where("n > 1").select("cls").union(ends).distinct()
    m = materialize(members.join(some, "cls", "left_semi").join(size, "cls"), "near_members")
    full = F.lit(full_class if full_class is not None else (1 << 62))
    shown = m.where((F.col("n") <= full) | (F.col("id") == F.col("rep"))).select("cls", "id")
    across = (
        links.join(shown.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a")
        .join(shown.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
        .select("x", "y")
    )
    small = m.where((F.col("n") > 1) & (F.col("n") <= full)).groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    inside = small.select(F.posexplode("ids").alias("k", "x"), "ids").select("x", F.explode(F.slice("ids", F.col("k") + 2, F.greatest(F.size("ids"), F.lit(1)))).alias("y"))
    hot = m.where((F.col("n") > full) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    both = across.unionByName(inside).unionByName(hot)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "blocks").where(F.col("kind").isin("function", "method"))
    return near_copy_pairs(b, "block_id", "content").select(F.col("a").alias("block_a"), F.col("b").alias("block_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block: its class of equal triple sets and the number of links of that class."""
    b = table(spark, sf_dir, "blocks").where(F.col("kind").isin("function", "method"))
    members, links = near_copies(b, "block_id", "content")
    links = materialize(links, "near_links")
    n = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(n, "cls", "left").select(F.col("id").alias("block_id"), F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked pairs of classes: with the classes of the blocks they give every pair of blocks."""
    b = table(spark, sf_dir, "blocks").where(F.col("kind").isin("function", "method"))
    return near_copies(b, "block_id", "content")[1].select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_links": p3_links}
SQL: dict[str, str] = {}
