"""The k most similar vectors of every vector: NN-descent in blocks, and greedy search over its graph.

1. *Classes.* Vectors move as packed 8-bit codes; vectors of one code are one node of the graph (a hash of
   the code), so copies, even a third of all rows, cost one entry a task.
2. *Index.* A two-level tree of centroids is fitted on a sample that grows with the vectors (at least
   ``SAMPLE``). Every node has a home, its closest leaf, and a second leaf if that is about as close. A leaf
   of more than ``HOT_LEAF`` nodes is split by further centroids on its own nodes; one beyond ``TASK_LEAF``
   is cut into salts, and each salt meets each other salt in a task.
3. *First lists.* Inside a leaf all pairs are compared (one matrix product).
4. *NN-descent.* Every list entry carries the leaves of the neighbour, that is where the neighbour's own
   neighbours stand. In a round, a node goes with its code to the leaves that hold at least ``EVIDENCE`` of its
   neighbours and that it has not been to, and meets the neighbours of its neighbours there, again by a
   matrix product; its list is merged with what it found. Rounds go on until few nodes have a leaf to go to
   (``PENDING``) or few entries change (``CHANGED``).
5. *Search.* A query starts at its own node, or at nodes of the leaf its vector falls in, and expands the
   best nodes it knows that are not expanded yet, until none of its k best is left to expand.

Every vector is indexed; the sample is only for the centroids. Recall against brute force is measured in
the tests and in the README (at least 0.9 is required).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skerry.session import materialize, slices, spread, table

DIM = 384
K = 10
LEAF = 1100
HOT_LEAF = 4000
#: Nodes of a part of a split leaf.
PART = 1000
#: Half of the most nodes of a leaf that one task holds.
TASK_LEAF = 20_000
#: A second leaf is taken if it is at least this share as similar as the first.
SECOND = 0.9
SAMPLE = 12_000
#: Vectors for each one of the sample, where that gives more than SAMPLE.
SAMPLED = 400
#: Neighbours that must stand in a leaf for a node to go there, and leaves that it goes to in a round.
EVIDENCE, VISITS = 2, 2
#: Rounds end once fewer than PENDING of the nodes have a leaf to go to, once fewer than CHANGED of the entries
#: change, or after ROUNDS.
PENDING, CHANGED, ROUNDS = 0.15, 0.03, 7
#: Nodes of a leaf at which a query from outside the graph begins.
ENTRIES = 12
#: Node ids (or pairs of them) and query codes up to these numbers go to every task; beyond, joins are shuffles.
SMALL_IDS, SMALL_CODES = 400_000, 20_000
#: Vectors of one packed row.
PACK = 2_000
#: Points of one code beyond this many are spread over salts when lists are given to points.
HOT_CLASS = 10_000

def _unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their unit vectors) of a list column."""
    size = np.asarray(col.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    whole = col if len(rows) == len(col) else col.take(pa.array(rows))
    x = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1)
    ok = np.isfinite(top) & (top > 0)
    rows, x, top = rows[ok], x[ok], top[ok]
    x = x / top[:, None]
    return rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        order = np.argsort(near, kind="stable")
        ids, first = np.unique(near[order], return_index=True)
        c[ids] = np.add.reduceat(x[order], first)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(x: np.ndarray, n: int, leaf: int = LEAF, seed: int = 7) -> dict:
    """Centroid tree for ``n`` vectors from the sample ``x`` of unit vectors."""
    rng = np.random.default_rng(seed)
    leaves = max(1, min(n // leaf, len(x) // 4))
    upper = max(1, int(np.sqrt(leaves)))
    top = _kmeans(x, upper, rng)
    near = (x @ top.T).argmax(1)
    fine, owner = [], []
    for j in range(len(top)):
        own = x[near == j]
        if len(own):
            c = _kmeans(own, max(1, round(leaves * len(own) / len(x))), rng)
            fine.append(c)
            owner.append(np.full(len(c), j))
    model = {"top": top, "fine": np.concatenate(fine), "owner": np.concatenate(owner)}
    homes = assign(model, x)
    held = np.concatenate([homes[:, 0], homes[homes[:, 1] != homes[:, 0], 1]])
    size = np.bincount(held, minlength=len(model["fine"])) / len(x) * n
    model["salts"] = np.where(size > 2 * TASK_LEAF, np.ceil(size / TASK_LEAF), 1).astype(np.int64)
    return model


def assign(model: dict, x: np.ndarray) -> np.ndarray:
    """The two closest leaves of each vector (the same one twice if the tree has one)."""
    up = x @ model["top"].T
    tops = np.argsort(-up, 1)[:, :2]
    score = np.full((len(x), 2), -2.0, np.float32)
    leaf = np.zeros((len(x), 2), np.int64)
    for j in range(len(model["top"])):
        rows = np.flatnonzero((tops == j).any(1))
        own = np.flatnonzero(model["owner"] == j)
        if not len(rows) or not len(own):
            continue
        s = x[rows] @ model["fine"][own].T
        for _ in range(min(2, len(own))):
            best = s.argmax(1)
            v = s[np.arange(len(rows)), best]
            s[np.arange(len(rows)), best] = -3
            first = v > score[rows, 0]
            second = ~first & (v > score[rows, 1])
            r = rows[first]
            score[r, 1], leaf[r, 1] = score[r, 0], leaf[r, 0]
            score[r, 0], leaf[r, 0] = v[first], own[best[first]]
            r = rows[second]
            score[r, 1], leaf[r, 1] = v[second], own[best[second]]
    # a vector deep inside its leaf needs no second one
    alone = score[:, 1] < SECOND * score[:, 0]
    leaf[alone, 1] = leaf[alone, 0]
    return leaf


def codes(x: np.ndarray) -> np.ndarray:
    return np.round(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)


def decode(c: np.ndarray) -> np.ndarray:
    x = c.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def node_ids(code: np.ndarray) -> np.ndarray:
    """A 64-bit id of every code."""
    wide = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.int8)
    wide[:, : code.shape[1]] = code
    words = wide.view(np.uint64)
    odd = np.random.default_rng(5).integers(1, 2**63, words.shape[1], dtype=np.uint64) | np.uint64(1)
    h = (words * odd + (words >> np.uint64(29)) * odd[::-1]).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))).view(np.int64)


def _record(dim: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("l0", "<i4"), ("l1", "<i4"), ("code", "i1", (dim,))])


#: A node with its list: the leaves it has been to (its own two first), and of each neighbour its two leaves.
BEEN = 2 + VISITS * ROUNDS
NODE = np.dtype([("id", "<i8"), ("been", "<i4", (BEEN,)), ("nbr", "<i8", (K,)), ("sim", "<f4", (K,)), ("at0", "<i4", (K,)), ("at1", "<i4", (K,))])


def _coded(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, unit vectors, codes, node ids) of a batch whose last column is the vector."""
    rows, x = _unit(batch.column(batch.num_columns - 1), dim)
    c = codes(x) if len(rows) else np.zeros((0, dim), np.int8)
    return rows, x, c, node_ids(c)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(keys, ids, codes): PACK vectors a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            b = batch.slice(at, PACK)
            rows, _, c, ids = _coded(b, dim)
            if len(rows):
                keys = b.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([ids.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["keys", "ids", "codes"])


def _unpack(b: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, codes) of each packed row, every node once."""
    for i, c in zip(b.column("ids").to_pylist(), b.column("codes").to_pylist()):
        ids, once = np.unique(np.frombuffer(i, np.int64), return_index=True)
        yield ids, np.frombuffer(c, np.int8).reshape(-1, dim)[once]


def _some(batches: Iterator[pa.RecordBatch], share: float, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, c in _unpack(b, dim):
            pick = (ids.view(np.uint64) >> np.uint64(11)) % np.uint64(1_000_000) < np.uint64(round(share * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array([c[pick].tobytes()], pa.binary())], ["codes"])


def _blocks(key: np.ndarray, rec: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    cut = np.append(first, len(order))
    for k, a, b in zip(keys, cut[:-1], cut[1:]):
        yield int(k), rec[order[a:b]].tobytes()


def _place(batches: Iterator[pa.RecordBatch], model: dict, dim: int, homes_only: bool = False) -> Iterator[pa.RecordBatch]:
    """Nodes by leaf. Key of a leaf's pair of salts (a, b): leaf + leaves * (a * salts + b)."""
    base = len(model["fine"])
    for ids, c in (x for batch in batches for x in _unpack(batch, dim)):
        leaf = assign(model, decode(c))
        rec = np.empty(len(ids), _record(dim))
        rec["id"], rec["l0"], rec["l1"], rec["code"] = ids, leaf[:, 0], leaf[:, 1], c
        two = np.flatnonzero((leaf[:, 1] != leaf[:, 0]) & (not homes_only))
        where = np.concatenate([leaf[:, 0], leaf[two, 1]])
        src = np.concatenate([np.arange(len(ids)), two])
        salts = model["salts"][where]
        if homes_only:
            own = _salt(ids[src], salts)
            where = where + base * (own * salts + own)
        else:
            # a node of a salted leaf goes to every pair of salts that holds its own
            rep = np.repeat(np.arange(len(where)), salts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(salts) - salts, salts)
            src, salts = src[rep], salts[rep]
            own = _salt(ids[src], salts)
            where = where[rep] + base * (np.minimum(own, other) * salts + np.maximum(own, other))
        made = list(_blocks(where, rec[src]))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary())], ["leaf", "blob"])


def _salt(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(7)) % salts.astype(np.uint64)).astype(np.int64)


def _by_slice(rec: np.ndarray, n: int) -> pa.Table:
    part = ((rec["id"].view(np.uint64) >> np.uint64(3)) % np.uint64(n)).astype(np.int32)
    made = list(_blocks(part, rec))
    return pa.table({"slice": pa.array([k for k, _ in made], pa.int32()), "blob": pa.array([b for _, b in made], pa.binary())})


def _unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    rec = np.concatenate([np.frombuffer(b, dtype) for b in blobs] or [np.zeros(0, dtype)])
    return rec[np.unique(rec["id"], return_index=True)[1]]


def _parts(x: np.ndarray, rows: np.ndarray, v: np.ndarray, visitors: np.ndarray, depth: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows`` of ``x`` in overlapping parts by centroids on these vectors, each row in its closest two, with
    the ``visitors`` (rows of ``v``) of each part."""
    if len(rows) <= HOT_LEAF or depth == 0:
        yield rows, visitors
        return
    k = -(-len(rows) // PART)
    rng = np.random.default_rng(7)
    c = _kmeans(x[rng.choice(rows, min(len(rows), 30 * k), replace=False)], k, rng, 5)
    near = lambda y, at: np.concatenate([np.argpartition(-(y[at[a : a + 4096]] @ c.T), 1, axis=1)[:, :2] for a in range(0, len(at), 4096)] or [np.zeros((0, 2), np.int64)])
    m, n = near(x, rows), near(v, visitors)
    own = [rows[(m == j).any(1)] for j in range(k)]
    if max(map(len, own)) == len(rows):
        yield rows, visitors
        return
    for j, r in enumerate(own):
        if len(r):
            yield from _parts(x, r, v, visitors[(n == j).any(1)], depth - 1)


def _closest(x: np.ndarray, xid: np.ndarray, v: np.ndarray, vid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(visitor, member, similarity): the K best members for each visitor, itself apart."""
    us, ms, ss = [], [], []
    for part, visitors in _parts(x, np.arange(len(x)), v, np.arange(len(v))):
        own, k = x[part], min(K + 1, len(part))
        step = max(1, 8_000_000 // max(1, len(part)))
        for a in range(0, len(visitors), step):
            rows = visitors[a : a + step]
            s = v[rows] @ own.T
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(part) else np.broadcast_to(np.arange(k), s.shape)
            us.append(np.repeat(rows, k))
            ms.append(part[best].ravel())
            ss.append(np.take_along_axis(s, best, 1).ravel())
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    u, m, s = np.concatenate(us), np.concatenate(ms), np.concatenate(ss)
    other = vid[u] != xid[m]
    return _best(u[other], m[other], s[other], K)


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct v of every u; equal similarities by v."""
    order = np.lexsort((-s, v, u))
    u, v, s = u[order], v[order], s[order]
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s = u[keep], v[keep], s[keep]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < k
    return u[keep], v[keep], s[keep]


def _lists(rec: np.ndarray, got: tuple[np.ndarray, np.ndarray, np.ndarray], members: np.ndarray, also: int) -> np.ndarray:
    """NODE records of the nodes ``rec`` with the neighbours found among ``members``; ``also``: a leaf been to."""
    out = np.zeros(len(rec), NODE)
    out["been"] = -1
    out["id"], out["been"][:, 0], out["been"][:, 1], out["been"][:, 2] = rec["id"], rec["l0"], rec["l1"], also
    out["sim"] = -9
    u, m, s = got
    at = np.arange(len(u)) - np.searchsorted(u, u)
    out["nbr"][u, at], out["sim"][u, at], out["at0"][u, at], out["at1"][u, at] = members["id"][m], s, members["l0"][m], members["l1"][m]
    return out


def _in_leaf(tbl: pa.Table, dim: int, n_slices: int) -> pa.Table:
    """Exact lists inside one leaf, as node records by slice of the id."""
    rec = _unpacked(tbl.column("blob").to_pylist(), _record(dim))
    x = decode(rec["code"])
    return _by_slice(_lists(rec, _closest(x, rec["id"], x, rec["id"]), rec, -1), n_slices)


def _visited(tbl: pa.Table, dim: int, n_slices: int, leaves: int) -> pa.Table:
    """What the visitors of a leaf find among its members."""
    guest = tbl.column("guest").to_pylist()
    blobs = tbl.column("blob").to_pylist()
    come = _unpacked([b for b, g in zip(blobs, guest) if g], _record(dim))
    rec = _unpacked([b for b, g in zip(blobs, guest) if not g], _record(dim))
    if not len(come) or not len(rec):
        return pa.table({"slice": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    got = _closest(decode(rec["code"]), rec["id"], decode(come["code"]), come["id"])
    return _by_slice(_lists(come, got, rec, tbl.column("leaf")[0].as_py() % leaves), n_slices)


NODE_DDL = "slice int, id long, l0 int, l1 int, go array<int>, entries int, changed int, node binary"


def _merge(tbl: pa.Table, evidence: int) -> pa.Table:
    """One row per node: its lists merged, where it goes next, and how many entries are new.

    A node's record so far (one per slice row, marked ``old``) and what it found come as blobs.
    """
    old_flag = tbl.column("old").to_pylist()
    blobs = tbl.column("blob").to_pylist()
    old = np.concatenate([np.frombuffer(b, NODE) for b, o in zip(blobs, old_flag) if o] or [np.zeros(0, NODE)])
    new = np.concatenate([np.frombuffer(b, NODE) for b, o in zip(blobs, old_flag) if not o] or [np.zeros(0, NODE)])
    rec = np.concatenate([old, new])
    ids, where = np.unique(rec["id"], return_inverse=True)
    u, v, s = np.repeat(where, K), rec["nbr"].ravel(), rec["sim"].ravel()
    a0, a1 = rec["at0"].ravel(), rec["at1"].ravel()
    fresh = np.repeat(np.arange(len(rec)) >= len(old), K)
    ok = np.flatnonzero(s > -5)
    # by node, similarity (to six decimals, so that what was found twice stands together), neighbour
    rank = (u[ok].astype(np.uint64) << np.uint64(32)) + (2_000_000 - np.round(s[ok] * 1e6).astype(np.int64)).astype(np.uint64)
    ok = ok[np.lexsort((fresh[ok], v[ok], rank))]
    u, v = u[ok], v[ok]
    keep = np.ones(len(u), bool)
    keep[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    ok, u = ok[keep], u[keep]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < K
    ok, u = ok[keep], u[keep]
    v, s, a0, a1, fresh = (c[ok] for c in (rec["nbr"].ravel(), s, a0, a1, fresh))
    out = np.zeros(len(ids), NODE)
    out["id"], out["sim"], out["been"] = ids, -9, -1
    at = np.arange(len(u)) - np.searchsorted(u, u)
    out["nbr"][u, at], out["sim"][u, at], out["at0"][u, at], out["at1"][u, at] = v, s, a0, a1
    # leaves been to: those of all records, the node's own two first
    seen = np.stack([np.repeat(where, BEEN), rec["been"].ravel().astype(np.int64)], 1)
    seen = np.unique(seen[seen[:, 1] >= 0], axis=0)
    first = np.unique(where, return_index=True)[1]
    out["been"][:, :2] = rec["been"][first, :2]
    more = seen[(seen[:, 1] != out["been"][seen[:, 0], 0]) & (seen[:, 1] != out["been"][seen[:, 0], 1])]
    slot = 2 + np.arange(len(more)) - np.searchsorted(more[:, 0], more[:, 0])
    fits = slot < BEEN
    out["been"][more[fits, 0], slot[fits]] = more[fits, 1]
    # where neighbours stand, most of them first
    pair = np.concatenate([np.stack([u, a0], 1), np.stack([u, a1], 1)[a0 != a1]])
    place, count = np.unique(pair, axis=0, return_counts=True)
    unseen = ~(out["been"][place[:, 0]] == place[:, 1:2]).any(1) & (count >= evidence)
    place, count = place[unseen], count[unseen]
    order = np.lexsort((place[:, 1], -count, place[:, 0]))
    place = place[order]
    place = place[np.arange(len(place)) - np.searchsorted(place[:, 0], place[:, 0]) < VISITS]
    off = np.searchsorted(place[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
    n = len(ids)
    return pa.table({
        "slice": pa.array(np.full(n, tbl.column("slice")[0].as_py()), pa.int32()), "id": ids, "l0": out["been"][:, 0], "l1": out["been"][:, 1],
        "go": pa.ListArray.from_arrays(pa.array(off), pa.array(place[:, 1].astype(np.int32))),
        "entries": np.bincount(u, minlength=n).astype(np.int32), "changed": np.bincount(u[fresh], minlength=n).astype(np.int32), "node": pa.array([r.tobytes() for r in out], pa.binary()),
    })


def _guests(batches: Iterator[pa.RecordBatch], model: dict, dim: int, going: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Nodes with their codes, by the leaf they go to: all of ``going`` (ids, sorted, and leaves), or rows that come
    with a ``cell``."""
    base = len(model["fine"])

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            if going is None:
                if b.num_rows:
                    yield b.column("id").to_numpy(), b.column("cell").to_numpy().astype(np.int64), np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, dim)
                continue
            for ids, c in _unpack(b, dim):
                lo, hi = np.searchsorted(going[0], ids), np.searchsorted(going[0], ids, "right")
                rep = np.repeat(np.arange(len(ids)), hi - lo)
                at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(rep))
                if len(rep):
                    yield ids[rep], going[1][at].astype(np.int64), c[rep]

    for ids, cell, code in rows():
        rec = np.empty(len(ids), _record(dim))
        leaf = assign(model, decode(code))
        rec["id"], rec["l0"], rec["l1"], rec["code"] = ids, leaf[:, 0], leaf[:, 1], code
        salts = model["salts"][cell]
        rep = np.repeat(np.arange(len(cell)), salts)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(salts) - salts, salts)
        made = list(_blocks(cell[rep] + base * (other * salts[rep] + other), rec[rep]))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], ["leaf", "blob"])


def _codes(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, c in _unpack(b, dim):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in c], pa.binary())], ["id", "code"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in b.column("ids").to_pylist()] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([b.column("keys").flatten(), pa.array(ids)], ["key", "id"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rec = np.frombuffer(b"".join(b.column("node").to_pylist()), NODE)
        ok = rec["sim"].ravel() > -5
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rec["id"], K)[ok]), pa.array(rec["nbr"].ravel()[ok]), pa.array(rec["sim"].ravel()[ok])], ["u", "v", "s"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rec = np.frombuffer(b"".join(b.column("node").to_pylist()), NODE)
        ok = rec["sim"].ravel() > -5
        yield pa.RecordBatch.from_arrays([b.column("u").take(pa.array(np.repeat(np.arange(len(rec)), K)[ok])), pa.array(rec["nbr"].ravel()[ok]), pa.array(rec["sim"].ravel()[ok])], ["u", "v", "s"])


@dataclass
class Graph:
    """``nodes``: one row per distinct code that takes part, with its packed list; ``packed(keys, ids, codes)``: all
    vectors; ``model``: the centroid tree; ``rounds``: share of entries changed in each round of NN-descent."""

    nodes: DataFrame
    packed: DataFrame
    model: dict | None
    dim: int
    rounds: list[float]

    def edges(self) -> DataFrame:
        """``(u, v, s)``: every list entry."""
        return self.nodes.select("node").mapInArrow(_edges, "u long, v long, s float")

    def points(self) -> DataFrame:
        """``(key, id)``: the node of every point; a repeated point comes again."""
        kind = self.packed.schema["keys"].dataType.elementType.simpleString()
        return self.packed.select("keys", "ids").mapInArrow(_points, f"key {kind}, id long")

    def codes(self) -> DataFrame:
        dim = self.dim
        return self.packed.select("ids", "codes").mapInArrow(lambda it: _codes(it, dim), "id long, code binary")


def build_graph(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM, leaf: int = LEAF, rounds: int = ROUNDS, small: int = SMALL_IDS, pending: float = PENDING, evidence: int = EVIDENCE) -> Graph:
    """The neighbour graph of the vectors of ``df``.

    Null, wrongly sized, zero and non-finite vectors take no part; a null key is dropped; repeated rows
    count once; an empty table gives an empty graph; further columns are ignored. Equal similarities are
    broken by the node's hash. ``rounds`` (at most ROUNDS) bounds the rounds of NN-descent; 0 leaves the first lists.
    """
    spark = df.sparkSession
    src = spread(df.select(F.col(id_col).alias("key"), F.col(vec_col).cast("array<float>").alias("vector")).where("key is not null"))
    kind = src.schema["key"].dataType.simpleString()
    packed = materialize(src.mapInArrow(lambda it: _packed(it, dim), f"keys array<{kind}>, ids binary, codes binary"), "knn_codes")
    n = int(packed.agg(F.sum(F.size("keys"))).first()[0] or 0)
    if not n:
        return Graph(spark.createDataFrame([], NODE_DDL), packed, None, dim, [])
    share = min(1.0, max(SAMPLE, n // SAMPLED) / n)
    coded = packed.select("ids", "codes")
    some = coded.mapInArrow(lambda it: _some(it, share, dim), "codes binary").toArrow().column(0).to_pylist()
    x = np.concatenate([np.frombuffer(c, np.int8).reshape(-1, dim) for c in some])
    if len(x) < 2:
        x = np.concatenate([c for b in packed.select("ids", "codes").limit(1).toArrow().to_batches() for _, c in _unpack(b, dim)])
    cut = slices(spark, n, 10_000)
    model = fit(decode(x), n, leaf)
    leaves = len(model["fine"])
    lists = coded.mapInArrow(lambda it: _place(it, model, dim), "leaf long, blob binary").groupBy("leaf").applyInArrow(lambda t: _in_leaf(t, dim, cut), "slice int, blob binary")
    nodes = materialize(lists.withColumn("old", F.lit(False)).groupBy("slice").applyInArrow(lambda t: _merge(t, evidence), NODE_DDL), "knn_graph")
    del lists
    log: list[float] = []
    for _ in range(min(rounds, ROUNDS)):
        entries, all_nodes, visits, goers = nodes.agg(F.sum("entries"), F.count("*"), F.sum(F.size("go")), F.sum((F.size("go") > 0).cast("int"))).first()
        if not goers or goers < pending * all_nodes:
            break
        going = nodes.select("id", F.explode("go").alias("cell"))
        if visits <= small:
            sent = going.toArrow()
            order = np.argsort(sent.column("id").to_numpy(), kind="stable")
            told = sent.column("id").to_numpy()[order], sent.column("cell").to_numpy()[order]
            come = coded.mapInArrow(lambda it, told=told: _guests(it, model, dim, told), "leaf long, blob binary")
        else:
            once = coded.mapInArrow(lambda it: _codes(it, dim), "id long, code binary").join(going, "id").dropDuplicates(["id", "cell"])
            come = once.mapInArrow(lambda it: _guests(it, model, dim, None), "leaf long, blob binary")
        home = coded.mapInArrow(lambda it: _place(it, model, dim, True), "leaf long, blob binary")
        found = come.withColumn("guest", F.lit(True)).unionByName(home.withColumn("guest", F.lit(False))).groupBy("leaf").applyInArrow(lambda t: _visited(t, dim, cut, leaves), "slice int, blob binary")
        # nodes that go nowhere keep their record as it is stored
        away = nodes.where(F.size("go") > 0).select("slice", F.col("node").alias("blob"), F.lit(True).alias("old"))
        merged = materialize(found.withColumn("old", F.lit(False)).unionByName(away).groupBy("slice").applyInArrow(lambda t: _merge(t, evidence), NODE_DDL), "knn_graph")
        nodes = nodes.where(F.size("go") == 0).unionByName(merged)
        log.append(float((merged.agg(F.sum("changed")).first()[0] or 0) / max(entries, 1)))
        del going, come, home, found, away
        if log[-1] < CHANGED:
            break
    return Graph(nodes, packed, model, dim, log)


def _score(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = decode(np.frombuffer(b"".join(b.column("cu").to_pylist()), np.int8).reshape(-1, dim))
        y = decode(np.frombuffer(b"".join(b.column("cv").to_pylist()), np.int8).reshape(-1, dim))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(np.einsum("ij,ij->i", x, y))], ["u", "v", "s"])


def _meet(batches: Iterator[pa.RecordBatch], v: np.ndarray, row: np.ndarray, code: np.ndarray, keys: pa.Array, dim: int) -> Iterator[pa.RecordBatch]:
    """(u, v, s) of the pairs (query row, node v), sorted by v, whose nodes stand in a task's packed rows."""
    for b in batches:
        for ids, c in _unpack(b, dim):
            lo, hi = np.searchsorted(v, ids), np.searchsorted(v, ids, "right")
            own = np.repeat(np.arange(len(ids)), hi - lo)
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(own))
            for k in range(0, len(own), 50_000):
                i, j = own[k : k + 50_000], row[at[k : k + 50_000]]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(j)), pa.array(ids[i]), pa.array(np.einsum("ij,ij->i", decode(code[j]), decode(c[i])))], ["u", "v", "s"])


def _routed(batches: Iterator[pa.RecordBatch], model: dict, dim: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if pa.types.is_binary(b.schema.field(1).type):
            rows, c = np.arange(b.num_rows), np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8).reshape(-1, dim)
            x, ids = decode(c), node_ids(c)
        else:
            rows, x, c, ids = _coded(b, dim)
        leaf = assign(model, x)[:, 0] if len(rows) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ids), pa.array(leaf), pa.array([r.tobytes() for r in c], pa.binary())], ["u", "id", "leaf", "code"])


def search(graph: Graph, queries: DataFrame, k: int = K, small: int = SMALL_IDS, beam: int = K) -> DataFrame:
    """``(u, v, s)``: the k best nodes for each of ``queries(u, vector)``, or ``(u, code)``, by greedy search.

    A query whose code is a node of the graph starts with that node's list and never finds that node itself;
    another starts at ENTRIES nodes of the leaf it falls in. In each step every query expands those of
    its ``beam`` (at least k) best nodes that it has not expanded; the search ends when no query has any. Vectors that
    can't take part in the graph find nothing; of a repeated u the first vector counts.
    """
    spark, dim, model = graph.packed.sparkSession, graph.dim, graph.model
    kind = queries.schema["u"].dataType.simpleString()
    ddl = f"u {kind}, v long, s float"
    if model is None:
        return spark.createDataFrame([], ddl)
    form = F.col("code") if "code" in queries.columns else F.col("vector").cast("array<float>")
    q = queries.where("u is not null").select("u", form.alias("x")).dropDuplicates(["u"])
    q = materialize(q.mapInArrow(lambda it: _routed(it, model, dim), f"u {kind}, id long, leaf long, code binary"), "knn_queries")
    few_queries = q.count() <= min(small // (2 * k), SMALL_CODES)
    if few_queries:
        held = q.select("u", "code").toArrow()
        own_keys = held.column("u").combine_chunks()
        own_row = {u: i for i, u in enumerate(own_keys.to_pylist())}
        own_code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.int8).reshape(-1, dim)

    def hop(front: DataFrame) -> DataFrame:
        """``(u, v, s)``: the lists of the nodes of ``front(u, id)``, with their own similarities."""
        near = graph.nodes.select("id", "node").join(F.broadcast(front) if few_queries else front, "id").select("u", "node")
        return near.mapInArrow(_listed, ddl)

    def scored(pairs: DataFrame) -> DataFrame:
        """``pairs(u, v)`` with similarities. Few pairs go to the codes, in the tasks that hold those."""
        pairs = materialize(pairs, "knn_pairs")
        if few_queries and pairs.count() <= small:
            p = pairs.toArrow()
            order = np.argsort(p.column("v").to_numpy(), kind="stable")
            at = p.column("v").to_numpy()[order], np.array([own_row[u] for u in p.column("u").to_pylist()], np.int64)[order]
            return graph.packed.select("ids", "codes").mapInArrow(lambda it: _meet(it, *at, own_code, own_keys, dim), ddl)
        code = graph.codes().select(F.col("id").alias("v"), F.col("code").alias("cv"))
        mine = q.select("u", F.col("code").alias("cu"))
        return code.join(pairs, "v").join(mine, "u").select("u", "v", "cu", "cv").mapInArrow(lambda it: _score(it, dim), ddl)

    inside = q.join(graph.nodes.select("id"), "id", "left_semi").select("u", "id")
    start = hop(inside)
    gate = graph.nodes.select("id", F.col("l0").cast("long").alias("leaf")).withColumn("r", F.row_number().over(W.partitionBy("leaf").orderBy("id"))).where(F.col("r") <= ENTRIES)
    outside = q.join(graph.nodes.select("id"), "id", "left_anti").join(gate.select("leaf", F.col("id").alias("v")), "leaf").select("u", "v")
    start = start if outside.isEmpty() else start.unionByName(scored(outside))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))

    def top(found: DataFrame) -> DataFrame:
        """The best of each query; one shuffle by query serves the distinct pairs and their ranks."""
        return materialize(found.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"), F.max("done").alias("done")).withColumn("r", rank).where(F.col("r") <= max(beam, k)), "knn_best")

    best = top(start.withColumn("done", F.lit(False)))
    seen = best.select("u", "v").unionByName(inside.select("u", F.col("id").alias("v")))
    while True:
        near = hop(best.where("not done").select("u", F.col("v").alias("id"))).select("u", "v", F.lit(False).alias("old")).unionByName(seen.withColumn("old", F.lit(True)))
        new = materialize(scored(near.repartition("u").groupBy("u", "v").agg(F.max("old").alias("old")).where("not old").select("u", "v")), "knn_scored")
        seen = seen.unionByName(new.select("u", "v"))
        best = top(best.drop("r").withColumn("done", F.lit(True)).unionByName(new.withColumn("done", F.lit(False))))
        if best.where("not done").isEmpty():
            return best.where(F.col("r") <= k).drop("done", "r")


def with_copies(found: DataFrame, points: DataFrame, k: int = K, wanted: DataFrame | None = None) -> DataFrame:
    """``(key, other, s)``: the k best points of every key of ``wanted(key)`` (all points if None), from the best
    nodes ``found(u, v, s)``. Points of the same code come first; of a node with very many points the
    first ones by key are taken. Equal similarities go by key."""
    own = points if wanted is None else points.join(wanted.select("key").distinct(), "key", "left_semi")
    own = materialize(own.distinct(), "knn_own")
    lists = found.select(F.col("u").alias("id"), F.col("v").alias("node"), "s").unionByName(own.select("id").distinct().select("id", F.col("id").alias("node"), F.lit(1.0).cast("float").alias("s")))
    if wanted is not None:
        # few lists: only the points of their nodes take part in what follows
        lists = materialize(lists, "knn_lists")
        named = lists.select(F.col("node").alias("id")).distinct()
        points = points.join(F.broadcast(named) if named.count() <= SMALL_IDS else named, "id", "left_semi")
    first = points.distinct().withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("key"))).where(F.col("r") <= k + 1).select(F.col("id").alias("node"), F.col("key").alias("other"))
    lists = lists.join(first, "node").select("id", "other", "s")
    # a node that very many points share is split over salts
    hot = own.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CLASS).select("id", F.expr("16L").alias("salts"))
    salted = own.join(F.broadcast(hot), "id", "left").select("id", "key", F.pmod(F.xxhash64("key"), F.expr("coalesce(salts, 1L)")).alias("salt"))
    lists = lists.join(F.broadcast(hot), "id", "left").select("id", "other", "s", F.explode(F.expr("sequence(0L, coalesce(salts, 1L) - 1L)")).alias("salt"))
    pairs = salted.join(lists, ["id", "salt"]).where("key <> other").select("key", "other", "s")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("s"), "other"))).where(F.col("rank") <= k)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = build_graph(table(spark, sf_dir, "vectors"), "point_id", "vector")
    wanted = table(spark, sf_dir, "probe_points").select(F.col("point_id").alias("key")).distinct()
    points = materialize(graph.points(), "knn_points")
    # a probe's node is the query: probes of the same code share it
    asked = points.join(wanted, "key", "left_semi").select("id").distinct().join(graph.codes(), "id").select(F.col("id").alias("u"), "code")
    out = with_copies(search(graph, asked), points, wanted=wanted)
    return out.select(F.least("key", "other").alias("point_a"), F.greatest("key", "other").alias("point_b")).distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of every vector in the graph, with the neighbour's payload."""
    v = table(spark, sf_dir, "vectors")
    graph = build_graph(v, "point_id", "vector")
    load = v.where("point_id is not null").groupBy(F.col("point_id").alias("other")).agg(F.min("payload").alias("payload"))
    out = with_copies(graph.edges(), graph.points()).join(load, "other")
    return out.select(F.col("key").alias("point_id"), "rank", F.col("other").alias("neighbour_id"), F.round("s", 4).alias("similarity"), "payload")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL: dict[str, str] = {}
