"""Keyword-stuffed and link-list pages.

A page is cut into lines, entries and sentences, and three kinds of characters are told apart:

* *List density* - links, badges, anchors and tags that no sentence on their line explains.
* *Entries* - menu, product and keyword entries: short runs between separators or on lines of their own.
* *Key phrases* - sentences made of the page's few dominant terms, with or without filler words.

Lists alone do not tell a menu from a glossary, nor repetition a stuffed page from a dry one. So the
phrases of all documents are exploded and the distinct hosts of each counted: an entry is a phrase (its
shingles of five words if it is longer), and so is each pair of content words of a page. Entries count
as evidence only if at least a quarter of them stand on MIN_HOSTS hosts or more, or half of the pairs that the
page says over and over; key sentences only if half of those pairs do. A page is flagged if more than half of
its characters are evidence. Code fences, logs, stack traces and change lists count as content.
Hosts are repositories (else sources).

Phrases move as 8-byte hashes in binary blocks per slice, one row per task, host group and slice. Pairs of content
words of all documents are first held against a filter of the pairs in question, whose size is fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import materialize, slices, spread, table

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the a an to is was were are be been of in on and or so it its that this has have had not with before after at by for from as if when"
    " you we i my can could should will would do does did than then there which who nobody why how what"
    " der die das den dem ein eine einer wird wurde und oder nicht mit vor nach im zu von wir haben hat ob noch vom statt weil falls bevor ist"
    " le la les un une des du de est que qui et ou nous avons ne pas avec dans sur car il elle plus au ce cette pour si merci"
    " el los las una por se en del al lo ya como antes es son no con para todavía desde porque nadie".split()
)
MIN_HOSTS = 3
SHARE = 0.5
#: Shares of a page's entries, and of its key phrases, that must stand on other hosts.
ENTRIES, KEYS = 0.25, 0.5
#: Times a pair of content words must be said on a page to be one of its key phrases.
OVER = 3
SHINGLE = 5
#: Bits of the filter of pairs in question: 4 MB, whatever the number of documents.
FILTER_BITS = 1 << 25

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LOG = re.compile(r"\s*File \"|\s*\d{4}-\d\d-\d\d[ T]\d|Traceback |\s*at [\w.$]+\(|\s+\S+\(.*\)\s*;?$|\w*(?:Error|Exception)\b:?|\[?\d\d:\d\d:\d\d")
#: No part may hold what opens it, so that an unclosed bracket costs no second look at what follows.
_ANCHOR = re.compile(r"\[[^\[\]\n]*\]\(#[^()\n]*\)")
_LINK = re.compile(
    r"\[!\[[^\[\]\n]*\]\([^()\n]*\)\]\([^()\n]*\)|!?\[[^\[\]\n]*\]\([^()#\n][^()\n]*\)|<a\b[^<>\n]*>(?:[^<\n]|<(?!/?a\b)[^<>\n]*>)*</a>|</?[a-z][^<>\n]*>"
    r"|(?:https?://|www\.)[^\s)>\]]+|(?<![\w&])#[^\W\d]\w{2,}",
    re.I,
)
_WORD = re.compile(r"\w+(?:['’][^\W\d_]+)?")
_PRODUCT = re.compile(r"\b[A-Z]{2,5}-\d{3,}\b|[$€£]\s?\d|\b\d+[.,]\d\d\b(?![\d.])")
_BREAK = re.compile(r"(?<=[.?!])\s+")
_SPLIT = re.compile(r"\s+[|/•·>»-]\s+|\s{3,}|\t+|,\s+|;\s+")
_END = re.compile(r"[.?!:]['\")]*\s*(?:\(#\d+\))?$")
_DIGITS = re.compile(r"\d+")


def _size(s: str) -> int:
    return len("".join(s.split()))


def _without_links(line: str) -> tuple[str, int]:
    """(the line without its links, characters of the links)."""
    if "[" not in line and "<" not in line and "#" not in line and "://" not in line and "www." not in line.lower():
        return line, 0
    rest = _LINK.sub(" ", line)
    links = _size(line) - _size(rest)
    return (_ANCHOR.sub(" ", rest) if "](#" in rest else rest), links


def evidence(text: str) -> tuple[int, int, int, int, int, str, list[str], list[str]]:
    """(all, link, listed, key and doubtful characters, key sentences and listed entries as one text, listed
    entries, doubtful entries) of a page."""
    body = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    # lines as (links, sentences); a sentence as (text, words, number of words that are no function words)
    lines: list[tuple[str, int, list[tuple[str, list[str], list[str]]]]] = []
    told: set[tuple[str, ...]] = set()
    counts: Counter = Counter()
    fw = FUNCTION_WORDS
    for line in body.split("\n"):
        if not line or line.isspace() or _LOG.match(line):
            continue
        rest, links = _without_links(line)
        said = []
        for s in _BREAK.split(rest):
            words = _WORD.findall(s.lower())
            if not words:
                continue
            content = [w for w in words if w not in fw]
            said.append((s, words, content))
            n = len(words)
            # a sentence with function words that is repeated as it stands counts once: that is no key phrase
            if 4 <= n < 25 and n - len(content) >= 0.2 * n:
                t = tuple(words)
                if t in told:
                    continue
                told.add(t)
            counts.update(content)
        lines.append((line, links, said))
    n = sum(k for w, k in counts.items() if not (w.isdigit() and len(w) != 4))
    least = max(4, 0.02 * n)
    dominant = {w for w, k in counts.items() if k >= least and not (w.isdigit() and len(w) != 4)}
    linked = listed = doubt = 0
    maybe: list[tuple[str, bool]] = []
    entries: list[str] = []
    doubtful: list[str] = []
    for line, links, said in lines:
        spoken = False
        short: list[str] = []
        for s, words, content in said:
            nw, nc = len(words), len(content)
            filler = 1 - nc / nw
            ended = bool(_END.search(s.rstrip()))
            if filler < 0.25 and not (ended and nw < 30):
                parts = [p for p in _SPLIT.split(s.strip()) if p]
                if len(parts) >= 6 and nw <= 5 * len(parts):
                    listed += _size(s)
                    entries += parts
                    continue
            if filler < 0.2 and not ended and not line.startswith("#") and _PRODUCT.search(s):
                listed += _size(s)
                entries.append(s)
            elif nc >= 2 and sum([w in dominant for w in content]) >= 0.5 * nc:
                again = len(set(content)) < nc
                maybe.append((s, again))
                if not again and ended and filler > 0.25:
                    spoken = True
            elif (nw >= 4 and ended) or (nw >= 5 and filler >= 0.25):
                spoken = True
            else:
                short.append(s)
        if not spoken:
            linked += links
            for s in short:
                doubt += _size(s)
            doubtful += short
    key: list[str] = []
    if maybe and sum([r for _, r in maybe]) >= 0.3 * len(maybe):
        key = [s for s, _ in maybe]
    return _size(text), linked, listed, sum(map(_size, key)), doubt, "\n".join([*key, *entries]), entries, doubtful


# --- phrases as hashes ---------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, bool)
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of the texts, ASCII case and the values of numbers aside.

    The first and the last eight bytes of a word, its length and a sum over all bytes are hashed, in a
    constant number of passes over the bytes.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = _FOLD[np.frombuffer(b" ".join([*raw, b"        "]), np.uint8)]
    kind = _KIND[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    if len(data) and kind[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]
    digits, sums = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data >= 48) & (data < 58), out=digits[1:])
    np.cumsum(data.astype(np.uint64) ** 2, out=sums[1:])
    size = end - begin
    window = np.lib.stride_tricks.sliding_window_view(data, 8)
    head = np.ascontiguousarray(window[begin]).view(np.uint64).ravel()
    tail = np.ascontiguousarray(window[np.maximum(end - 8, 0)]).view(np.uint64).ravel()
    keep = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
    head = np.where(size >= 8, head, head & ((np.uint64(1) << np.minimum(keep, np.uint64(63))) - np.uint64(1)))
    tail = np.where(size >= 8, tail, np.uint64(0))
    h = _mix(head * _P + _mix(tail + size.astype(np.uint64)) + (sums[end] - sums[begin]) * np.uint64(0xD6E8FEB86659FD93))
    number = digits[end] - digits[begin] == size
    h[number] = np.uint64(7)
    off = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.searchsorted(off, begin, "right") - 1, h


_STOP: list[np.ndarray] = []


def _stop() -> np.ndarray:
    if not _STOP:
        _STOP.append(np.unique(words_of(sorted(FUNCTION_WORDS))[1]))
    return _STOP[0]


def pairs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every pair of neighbouring content words, function words left out."""
    doc, h = words_of(texts)
    stop = _stop()
    said = stop[np.minimum(np.searchsorted(stop, h), len(stop) - 1)] != h
    doc, h = doc[said], h[said]
    same = doc[1:] == doc[:-1]
    return doc[:-1][same], (_mix(h[:-1] * np.uint64(3) + np.uint64(1)) + h[1:] * _P)[same]


def entries_of(entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(entry number, hash) of every entry; of one longer than SHINGLE words, each of its shingles."""
    doc, h = words_of(entries)
    if not len(doc):
        return doc, h
    n = np.bincount(doc, minlength=len(entries))
    first = np.cumsum(n) - n
    at = np.arange(len(doc)) - first[doc]
    begins = at <= np.maximum(n[doc] - SHINGLE, 0)
    b = np.flatnonzero(begins)
    out = np.full(len(b), np.uint64(11))
    for k in range(SHINGLE):
        j = np.minimum(b + k, len(h) - 1)
        inside = (b + k < len(h)) & (doc[j] == doc[b])
        out = np.where(inside, _mix(out * np.uint64(31) + h[j]), out)
    return doc[b], out


def _counted(group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, hash) with their numbers."""
    order = np.lexsort((h, group))
    group, h = group[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (group[1:] != group[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return group[at], h[at], np.diff(np.append(at, len(h)))


PHRASE = np.dtype([("h", "<u8"), ("n", "<i4"), ("kind", "i1")])
KEY, ENTRY, DOUBT = 0, 1, 2


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page with its evidence and, packed, the phrases that the evidence hangs on; a page whose evidence
    could not suffice, were all of it replicated, keeps only its entries (they count for its host)."""
    for b in batches:
        got = [evidence(t) for t in b.column("text").to_pylist()]
        can = np.array([sum(e[1:5]) > SHARE * e[0] for e in got], bool)
        phrases = []
        for kind, at in ((ENTRY, 6), (DOUBT, 7)):
            flat = [x for e in got for x in e[at]]
            own = np.repeat(np.arange(len(got)), [len(e[at]) for e in got])
            i, h = entries_of(flat)
            phrases.append((kind, *_counted(own[i] if len(i) else i, h)))
        phrases.append((KEY, *_counted(*pairs_of([e[5] if c else "" for e, c in zip(got, can)]))))
        doc = np.concatenate([p[1] for p in phrases])
        rec = np.zeros(len(doc), PHRASE)
        rec["h"], rec["n"] = np.concatenate([p[2] for p in phrases]), np.concatenate([p[3] for p in phrases])
        rec["kind"] = np.repeat([p[0] for p in phrases], [len(p[1]) for p in phrases])
        keep = (rec["kind"] != KEY) | (rec["n"] >= OVER)
        doc, rec = doc[keep], rec[keep]
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(len(got) + 1))
        rec = rec[order]
        blobs = [rec[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
        cols = [pa.array([e[k] for e in got], pa.int32()) for k in range(5)]
        doubts = pa.array([len(e[7]) for e in got], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), *cols, doubts, pa.array(can), pa.array(blobs, pa.binary())], ["id", "host", "total", "linked", "listed", "keyed", "doubt", "n_doubt", "can", "phrases"])


_HOSTED = np.dtype([("h", "<u8"), ("host", "<u8")])


def _sliced(rec: np.ndarray, n: int) -> pa.RecordBatch:
    part = (rec["h"] >> np.uint64(8)) % np.uint64(n)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    keep = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array([rec[order[cut[j] : cut[j + 1]]].tobytes() for j in keep], pa.binary())], ["slice", "blob"])


def _filter_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(20)) % np.uint64(FILTER_BITS), (h * _P >> np.uint64(24)) % np.uint64(FILTER_BITS)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words (64 bits) of the filter that the key phrases of a task's pages set."""
    bits = np.zeros(FILTER_BITS, bool)
    for b in batches:
        rec = np.frombuffer(b"".join(b.column("phrases").to_pylist()), PHRASE)
        for at in _filter_bits(rec["h"][rec["kind"] == KEY]):
            bits[at] = True
    packed = np.packbits(bits, bitorder="little").view(np.int64)
    at = np.flatnonzero(packed)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], ["at", "bits"])


def _portions(texts: list[str], most: int = 1_000_000, seam: int = 1_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, texts) of about ``most`` characters each, so that arrays stay small; a longer text comes in
    windows that share ``seam`` characters."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), most):
            w = t[max(at - seam, 0) : at + most]
            rows.append(i)
            held.append(w)
            size += len(w)
            if size >= most:
                yield np.array(rows), held
                rows, held, size = [], [], 0
    if rows:
        yield np.array(rows), held


def _told(batches: Iterator[pa.RecordBatch], n_slices: int, bits: bytes) -> Iterator[pa.RecordBatch]:
    """(phrase, host) of all documents' pairs of content words that pass the filter."""
    held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
    for b in batches:
        hosts = b.column("host").to_numpy().view(np.uint64)
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for rows, texts in _portions(b.column("text").to_pylist()):
            doc, h = pairs_of(texts)
            one, two = _filter_bits(h)
            ok = held[one] & held[two]
            parts.append(_counted(hosts[rows][doc[ok]], h[ok])[:2])
        host, h, _ = _counted(*map(np.concatenate, zip(*parts)))
        rec = np.empty(len(h), _HOSTED)
        rec["h"], rec["host"] = h, host
        yield _sliced(rec, n_slices)


def _standing(batches: Iterator[pa.RecordBatch], n_slices: int) -> Iterator[pa.RecordBatch]:
    """(phrase, host) of all documents' entries."""
    for b in batches:
        blobs = b.column("phrases").to_pylist()
        rec = np.frombuffer(b"".join(blobs), PHRASE)
        own = np.repeat(b.column("host").to_numpy().view(np.uint64), [len(x) // PHRASE.itemsize for x in blobs])
        entry = rec["kind"] != KEY
        host, h, _ = _counted(own[entry], rec["h"][entry])
        out = np.empty(len(h), _HOSTED)
        out["h"], out["host"] = h, host
        yield _sliced(out, n_slices)


def _widespread(tbl: pa.Table, least: int) -> pa.Table:
    """The phrases of a slice that stand on ``least`` hosts or more."""
    rec = np.concatenate([np.frombuffer(b, _HOSTED) for b in tbl.column("blob").to_pylist()])
    h, host, _ = _counted(rec["h"], rec["host"])
    h, hosts = np.unique(h, return_counts=True)
    ok = hosts >= least
    return pa.table({"h": pa.array(h[ok].view(np.int64)), "hosts": pa.array(hosts[ok].astype(np.int32))})


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, phrase, kind, number) of the pages in question."""
    for b in batches:
        blobs = b.column("phrases").to_pylist()
        rec = np.frombuffer(b"".join(blobs), PHRASE)
        own = pa.array(np.repeat(np.arange(len(blobs)), [len(x) // PHRASE.itemsize for x in blobs]))
        yield pa.RecordBatch.from_arrays([b.column("id").take(own), pa.array(rec["h"].view(np.int64)), pa.array(rec["kind"]), pa.array(rec["n"])], ["id", "h", "kind", "n"])


def stuffed_pages(df: DataFrame, id_col: str, text_col: str, host, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """``(id, total, linked, listed, keyed, doubt, key_share, entry_share, doubt_share, flagged)`` of the pages with any
    strong evidence: characters by kind, and the shares of phrases that stand on ``min_hosts`` hosts.

    Null or empty texts and null ids are never flagged; repeated rows count once; an empty table gives
    an empty result; other columns are ignored. Texts are read whole, hosts counted over all documents.
    """
    spark = df.sparkSession
    src = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ints = ", ".join(f"{c} int" for c in ("total", "linked", "listed", "keyed", "doubt", "n_doubt"))
    pages = materialize(spread(src).mapInArrow(_pages, f"id {kind}, host long, {ints}, can boolean, phrases binary"), "pages")
    able = pages.where("can").dropDuplicates(["id"])
    n = slices(spark, pages.count(), 200_000)
    # the filter has a fixed size: what reaches the driver and every task does not grow with the data
    wanted = able.select("phrases").mapInArrow(_wanted, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[wanted.column("at").to_numpy()] = wanted.column("bits").to_numpy()
    bits = words.tobytes()
    told = spread(src).select("host", "text").mapInArrow(lambda it: _told(it, n, bits), "slice int, blob binary")
    told = told.unionByName(pages.select("host", "phrases").mapInArrow(lambda it: _standing(it, n), "slice int, blob binary"))
    wide = told.groupBy("slice").applyInArrow(lambda t: _widespread(t, min_hosts), "h long, hosts int")
    said = able.select("id", "phrases").mapInArrow(_spoken, f"id {kind}, h long, kind tinyint, n int")
    met = said.join(wide, "h", "left").groupBy("id", "kind").agg((F.sum(F.expr("if(hosts is null, 0, n)")) / F.sum("n")).alias("share"))
    share = lambda k, name: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("share"))), F.lit(0.0)).alias(name)
    rep = met.groupBy("id").agg(share(KEY, "key_share"), share(ENTRY, "entry_share"), share(DOUBT, "doubt_share"))
    j = able.drop("host", "can", "phrases").join(rep, "id", "left").na.fill(0.0, ["key_share", "entry_share", "doubt_share"])
    strong = F.expr(f"linked + if(entry_share >= {ENTRIES} or key_share >= {KEYS}, listed, 0) + if(key_share >= {KEYS}, keyed, 0) + if(doubt_share >= {KEYS} and n_doubt >= 8, doubt, 0)")
    return j.withColumn("flagged", strong > SHARE * F.col("total")).drop("n_doubt")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.coalesce(F.col("repo_id"), F.lower(F.trim("source")))
    return stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text", host).where("flagged").select(F.col("id").alias("doc_id"))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind each page that has some."""
    host = F.coalesce(F.col("repo_id"), F.lower(F.trim("source")))
    e = stuffed_pages(table(spark, sf_dir, "documents"), "doc_id", "text", host)
    shares = [F.round(c, 4).alias(c) for c in ("key_share", "entry_share", "doubt_share")]
    return e.select(F.col("id").alias("doc_id"), F.col("total").alias("chars"), "linked", "listed", "keyed", "doubt", *shares, "flagged")


QUERIES = {"p9_found": p9_found, "p9_evidence": p9_evidence}
SQL: dict[str, str] = {}
