"""Generated, minified, vendored and data-as-code files: a linear support-vector classifier.

Features of a file: hashed character 5-grams of its whole text behind the leading comment (digits
folded), hashed path components and name parts, hashed word n-grams of the leading comment, and its
layout in buckets (line lengths, comment and blank lines, literals). The classifier is fitted by dual
coordinate descent on a bounded sample of files (``SAMPLE``, an explicit parameter) whose labels come from
giveaways: markers in leading comments, well-known folders and suffixes, lines of a delivered bundle,
literals that outweigh code. Giveaways serve as labels of the sample only; the margin alone decides about a
file. In fitting, every file is shown in three forms - as it is, with its leading comment masked, and with
comment and path masked - so that contents must carry what they can. Repositories are split in three: weights are
fitted on a half of them, the offset is set on a quarter, accuracy is measured on the last quarter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import spread, table

BITS = 16
GRAM = 5
SAMPLE = 6_000
#: Slots of path, layout and comment features beside those of 5-grams.
MARKS = 1 << 15

#: Folders of third-party or generated code.
FOLDERS = frozenset(
    "vendor third_party third-party thirdparty 3rdparty 3rd_party external extern externals node_modules bower_components pods carthage deps"
    " jspm_packages site-packages generated-sources generated_sources __generated__".split()
)
#: Suffixes that tools give to what they write.
SUFFIX = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.g\.\w+|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|\.designer\.cs|outerclass\.java|[.-]min\.\w+|\.bundle\.\w+)$", re.I)
HEADER = re.compile(
    r"^(?:code |this (?:file|code) (?:is|was) |file )?(?:auto(?:matically)?[- ]?)?generated\b(?! names)|auto-?generated|@generated|@license|generated by the .* compiler|do not edit[.!]|do not modify|(?:machine|tool|script)[- ](?:written|made|produced)|edits are overwritten|automatisch erzeugt"
    r"|imported from upstream|this file is part of \S+, version|\(c\) the \S+ (?:contributors|authors)|copyright \(c\) \d+ the \S+ authors|vendored from|copied from \S+ v?\d|bundled (?:by|with)",
    re.I,
)
_LEAD = re.compile(r"^\s*(?:<\?php|//+|#+|/\*+|\*+/?|--|;+|<!--|\"\"\"|''')?\s*")
_DATA = re.compile(r"[\"'][A-Za-z0-9+/=_\\x%-]{40,}[\"']|(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)[ \t\r\n]*[,;][ \t\r\n]*){6,}")
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*)")


def header_lines(text: str) -> int:
    """Number of leading comment lines, licence blocks included, up to the first line of code."""
    n, block = 0, False
    for line in text.split("\n"):
        s = line.strip("﻿ \t\r")
        if block or s.startswith("/*"):
            # a block comment's inner lines need no mark of their own
            block = "*/" not in s
        elif s and not re.match(r"<\?php$|//|#(?!include|define|if|pragma)|/\*|\*|--|;|\"\"\"|'''", s):
            break
        n += 1
    return n


def giveaway(path: str, text: str) -> int:
    """1 leading comment, 2 folder, 4 suffix, 8 delivered in long lines, 16 mainly data."""
    found = 0
    lead = text.split("\n")[: header_lines(text)]
    if any(HEADER.search(_LEAD.sub("", s.strip("﻿"))) for s in lead):
        found |= 1
    parts = path.lower().split("/")
    if any(p in FOLDERS for p in parts[:-1]):
        found |= 2
    if SUFFIX.search(parts[-1]):
        found |= 4
    n = len(text)
    if n >= 400:
        data = sum(m.end() - m.start() for m in _DATA.finditer(text))
        if data >= 0.5 * n:
            found |= 16
        elif max(map(len, text.split("\n", 400))) > 250 and sum(len(s) for s in text.split("\n") if len(s) > 250) >= 0.5 * n:
            found |= 8
    return found


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 13]] = 32
SIZE = (1 << BITS) + MARKS


def _layout(text: str) -> list[str]:
    lines = text.split("\n")
    n = max(1, len(lines))
    long = max(map(len, lines))
    bucket = lambda x: int(np.log2(1 + x))
    blank = sum(not s.strip() for s in lines)
    comment = sum(bool(_COMMENT.match(s)) for s in lines)
    data = sum(m.end() - m.start() for m in _DATA.finditer(text))
    return [f"long{bucket(long)}", f"mean{bucket(len(text) / n)}", f"blank{int(10 * blank / n)}", f"note{int(10 * comment / n)}", f"data{int(10 * data / max(1, len(text)))}", f"white{int(20 * (text.count(' ') + text.count(chr(9))) / max(1, len(text)))}"]


def _path_marks(path: str) -> list[str]:
    parts = path.lower().split("/")
    name = re.split(r"[._-]", parts[-1])
    return ["d:" + p for p in parts[:-1]] + ["n:" + p for p in name[-3:]] + ["s:" + parts[-1][parts[-1].find(".") :]]


def _slot(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (1 << BITS) + (h ^ h >> 15) % MARKS


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all 5-grams of all texts, offsets)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(b) for b in raw], np.int64)
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    off = np.concatenate([[0], np.cumsum(size)])
    if len(data) < GRAM:
        return np.zeros(len(data), np.uint32), off
    h = np.zeros(len(data), np.uint32)
    m = len(data) - GRAM + 1
    for k in range(GRAM):
        h[:m] = h[:m] * np.uint32(0x01000193) + data[k : k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS), off


_TERM = re.compile(r"[^\W\d_]+|\d+|[@<(\"]")


def _lead_marks(lead: str) -> list[str]:
    """Word n-grams, up to three words, of a leading comment."""
    w = ["0" if x[0].isdigit() else x for x in _TERM.findall(lead.lower())]
    return ["c:" + x for x in dict.fromkeys([*w, *map(" ".join, zip(w, w[1:])), *map(" ".join, zip(w, w[1:], w[2:]))])]


def _cut(text: str) -> tuple[str, str]:
    """(leading comment, the rest)."""
    n = header_lines(text)
    if not n:
        return "", text
    lines = text.split("\n", n)
    return "\n".join(lines[:n]), lines[n] if len(lines) > n else ""


#: Weight of a 5-gram's root frequency, of a layout and a path mark, and of all marks of a comment together.
TEXT, MARK, PATH, LEAD = 1.0, 0.35, 0.6, 2.0
#: A comment of fewer marks weighs less than one of so many.
FULL_LEAD = 24


def _slots(words: list[str]) -> list[int]:
    return [_slot(w) for w in words]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        paths, texts = b.column("path").to_pylist(), b.column("text").to_pylist()
        parts = [_cut(t) for t in texts]
        h, off = grams([body for _, body in parts])
        for i, (p, t) in enumerate(zip(paths, texts)):
            u, c = np.unique(h[off[i] : off[i + 1]], return_counts=True)
            for col, v in zip(cols, (giveaway(p, t), u.astype(np.int32).tolist(), (c / max(1, off[i + 1] - off[i])).astype(np.float32).tolist(), _slots(_path_marks(p)), _slots(_layout(parts[i][1])), _slots(_lead_marks(parts[i][0])))):
                col.append(v)
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("repo"), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), ints, pa.list_(pa.float32()), ints, ints, ints)))], ["repo", "label", "idx", "val", "path", "layout", "lead"])


def _form(row: tuple, path: bool, lead: bool) -> tuple[np.ndarray, np.ndarray]:
    """A file's features, with or without its path and leading comment."""
    idx, val, path_marks, layout, lead_marks = row
    ks, vs = [idx, layout], [np.sqrt(val) * np.float32(TEXT), np.full(len(layout), MARK, np.float32)]
    if path:
        ks.append(path_marks)
        vs.append(np.full(len(path_marks), PATH, np.float32))
    if lead and len(lead_marks):
        ks.append(lead_marks)
        vs.append(np.full(len(lead_marks), LEAD / np.sqrt(max(FULL_LEAD, len(lead_marks))), np.float32))
    return np.concatenate(ks), np.concatenate(vs)


def _best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The offset with the best F1, in the middle of the gap it falls in."""
    order = np.argsort(-score)
    hit = np.cumsum(y[order] > 0)
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, (y > 0).sum()))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float((score[order[best[0]]] + score[order[min(best[-1] + 1, len(order) - 1)]]) / 2)


def fit(rows: list[tuple], epochs: int = 20, c: float = 0.5, seed: int = 3) -> dict:
    """Weights, offset and held-out figures from ``(repo, label, idx, val, path, layout, lead)``."""
    rng = np.random.default_rng(seed)
    y = np.array([1.0 if r[1] else -1.0 for r in rows])
    data = [tuple(np.asarray(x, np.float32 if k == 1 else np.int64) for k, x in enumerate(r[2:])) for r in rows]
    part = np.array([_slot("repo " + (r[0] or "")) % 4 for r in rows], np.int64)
    train, tune, test = (np.flatnonzero(np.isin(part, p)) for p in ((0, 1), (2,), (3,)))
    if len(set(y[train])) < 2:
        return {"w": np.zeros(SIZE, np.float32), "b": -0.5, "accuracy": None, "f1": None, "f1_contents": None, "held": 0}
    # a folder, name part or comment term of fewer than three repositories tells nothing about others
    seen = np.array(sorted({(int(k), rows[i][0] or "") for i in train for at in (2, 4) for k in data[i][at]}, key=lambda x: x[0]), dtype=object).reshape(-1, 2)
    known = np.bincount(seen[:, 0].astype(np.int64), minlength=SIZE) >= min(3, len({rows[i][0] for i in train}))
    data = [(idx, val, path[known[path]], layout, lead[known[lead]]) for idx, val, path, layout, lead in data]
    w = np.zeros(SIZE, np.float64)
    b = 0.0
    share = (y[train] > 0).mean()
    cost = {1.0: c * 0.5 / share, -1.0: c * 0.5 / (1 - share)}
    forms = ((False, False), (True, False), (True, True))
    alpha = np.zeros((len(y), len(forms)))
    for _ in range(epochs):
        for i in rng.permutation(train):
            k = int(rng.integers(len(forms)))
            idx, val = _form(data[i], *forms[k])
            q = float(val @ val) + 1.0
            g = y[i] * (w[idx] @ val + b) - 1
            # a form without comment and path can lack what its label came from: it costs less to miss
            new = min(max(alpha[i, k] - g / q, 0.0), cost[y[i]] * (1.0 if forms[k] == (True, True) else 0.1))
            d = (new - alpha[i, k]) * y[i]
            if d:
                alpha[i, k] = new
                np.add.at(w, idx, d * val)
                b += d
    score = lambda at, form: np.array([w[k] @ v + b for k, v in (_form(data[i], *form) for i in at)])

    def f1(s: np.ndarray, at: np.ndarray, cut: float) -> float:
        return float(2 * ((s > cut) & (y[at] > 0)).sum() / max(1, (s > cut).sum() + (y[at] > 0).sum()))

    tune, test = (tune if (y[tune] > 0).any() else train), (test if len(test) else train)
    cut = _best_cut(score(tune, (True, True)), y[tune])
    s = score(test, (True, True))
    bare = f1(score(test, (False, False)), test, _best_cut(score(tune, (False, False)), y[tune]))
    return {"w": w.astype(np.float32), "b": b - cut, "accuracy": float(((s > cut) == (y[test] > 0)).mean()), "f1": f1(s, test, cut), "f1_contents": bare, "held": len(test)}


def _scored(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    w, b = model["w"], model["b"]
    for batch in batches:
        paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
        margin = np.empty(len(texts), np.float32)
        for at in range(0, len(texts), 500):
            parts = [_cut(t) for t in texts[at : at + 500]]
            h, off = grams([body for _, body in parts])
            for i, (lead, body) in enumerate(parts):
                s = 0.0
                if off[i + 1] > off[i]:
                    c = np.bincount(h[off[i] : off[i + 1]], minlength=1 << BITS)
                    k = np.flatnonzero(c)
                    s = TEXT * float(w[k] @ np.sqrt(c[k] / (off[i + 1] - off[i])))
                s += MARK * float(w[_slots(_layout(body))].sum()) + PATH * float(w[_slots(_path_marks(paths[at + i]))].sum())
                marks = _slots(_lead_marks(lead))
                if marks:
                    s += LEAD / np.sqrt(max(FULL_LEAD, len(marks))) * float(w[marks].sum())
                margin[at + i] = s + b
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(margin)], ["id", "margin"])


def classify(df: DataFrame, id_col: str, path_col: str, text_col: str, repo_col: str, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """``(id, margin, flagged)`` of every file, and the fitted model.

    Null ids are dropped; null paths and repositories count as empty; null or empty texts are never
    flagged; repeated rows count once; an empty table gives an empty result; other columns are
    ignored. Texts are read whole.
    """
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(path_col, F.lit("")).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(repo_col, F.lit("")).alias("repo"))
    src = spread(src)
    n = src.count()
    share = min(1.0, sample / max(n, 1))
    some = src.where((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)) & (F.length("text") > 0))
    ddl = "repo string, label int, idx array<int>, val array<float>, path array<int>, layout array<int>, lead array<int>"
    got = some.select("path", "text", "repo").mapInArrow(_sampled, ddl).limit(2 * sample).toArrow()
    names = [got.column(c).to_pylist() for c in ("repo", "label")]
    lists = [got.column(c).combine_chunks() if got.num_rows else [] for c in ("idx", "val", "path", "layout", "lead")]
    model = fit([(r, y, *(c[i].values.to_numpy(zero_copy_only=False) for c in lists)) for i, (r, y) in enumerate(zip(*names))])
    kind = src.schema["id"].dataType.simpleString()
    scored = src.where(F.length("text") > 0).select("id", "path", "text").mapInArrow(lambda it: _scored(it, model), f"id {kind}, margin float").dropDuplicates(["id"])
    return scored.withColumn("flagged", F.col("margin") > 0), model


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = classify(table(spark, sf_dir, "source_files"), "file_id", "file_path", "text", "repo_id")
    return out.where("flagged").select(F.col("id").alias("file_id"))


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin and decision of every file."""
    out, _ = classify(table(spark, sf_dir, "source_files"), "file_id", "file_path", "text", "repo_id")
    return out.select(F.col("id").alias("file_id"), F.round("margin", 4).alias("margin"), "flagged")


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores}
SQL: dict[str, str] = {}
