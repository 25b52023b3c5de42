"""Credentials embedded in source code and settings: found through encodings, and masked in place.

Every literal and settings value of a text is a node. A node is scanned for token formats, addresses
and headers with a password, and private keys; its name (the key or callee beside it) decides about
values without a format of their own. Then its layers are taken off - escapes, percent, hex, base64,
base32, deflate, at most ``DEPTH`` deep - and each result is scanned again; binary results are parsed as key
containers by their grammar (DER sequences of PKCS#1, SEC1, PKCS#8, encrypted PKCS#8 and PKCS#12, read to
their end; the OpenSSH and JKS containers). Encoded runs inside a longer literal or a comment, and arrays of
byte values, are nodes as well. A finding inside a layer is charged to the enclosing encoded run or literal,
which is what gets masked.

Masks keep the length and the delimiters of what they replace, so the code around stays valid.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import spread, table

DEPTH = 4

#: Public formats of access tokens.
TOKEN_FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{30,}",
    r"AIza[0-9A-Za-z_-]{30,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{30,}",
    r"ya29\.[A-Za-z0-9_-]{20,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"dop_v1_[0-9a-f]{40,}",
    r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
)
TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(TOKEN_FORMATS) + r")")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://([^\s:/@\"'`]{0,120}):([^\s@/\"'`]{3,300})@[\w.-]", re.I)
HEADER = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=-]{12,})", re.I)
CONNECTION = re.compile(r"(?:\b|_)(?:password|pwd|passwd|accountkey|sharedaccesskey|secret)\s*=\s*([^\s;\"'&,]{6,})", re.I)

SECRET_NAME = re.compile(r"passw(?:or)?d|passwd|pwd\b|pwd$|passphrase|secret|token|api[_.\-]?key|access[_.\-]?key|signing[_.\-]?key|private[_.\-]?key|encryption[_.\-]?key|credential|auth(?:orization)?\b|\bauth|client[_.\-]?key|webhook[_.\-]?key", re.I)
PASS_NAME = re.compile(r"passw|passwd|pwd|passphrase|secret|login|credential", re.I)
PLAIN_NAME = re.compile(r"checksum|digest|sha\d*|md5|hash|integrity|etag|fingerprint|uuid|commit|revision|public|kind$|type$|_id$|Id$|name$|path$|url$|alphabet|icon|format|pattern|regex|label|ttl$|size$|limit$|mode$", re.I)
PLACEHOLDER = re.compile(
    r"^(?:[*x•.#?-]{3,}|<[^>]*>|\$\{[^}]*\}|\{\{?[^}]*\}?\}|%\w+%|%[sd]|\$[A-Z_]+|\[[^\]]*\])$|change[\-_ ]?me|replace[\-_ ]?me|set[\-_]?me|your[\-_ ]?|placeholder|example|dummy|insert[\-_ ]|redacted|not[\-_ ]?a[\-_ ]?real|todo|fixme|^(?:none|null|nil|true|false|undefined|test|secret|password|token)$",
    re.I,
)
REFERENCE = re.compile(r"^(?:env|vault|secret|secrets|ssm|arn|file|op|keyring|config|aws|gcp|sm)[:/]|^\$|getenv|environ|^[./~]*(?:[\w.-]+/)+[\w.-]*$|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$|^[a-z]+(?:[_.\- ][a-z]+)*$|^[a-z]+(?:[A-Z][a-z]+)*$|^/", re.S)

_LITERAL = re.compile(r"(\"\"\"|'''|`)(.*?)\1|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'", re.S)
_SETTING = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?([\w.\-]+)[ \t]*(?:=|:)[ \t]*([^\s\"'`#][^\n\r]*?)[ \t]*\r?$", re.M)
_COMMENTED = re.compile(r"(?:#|//|/\*|\*|--|;)[^\n\"']{0,200}?\b([\w.\-]{0,40}(?:passw\w*|pwd|passphrase|secret\w*|token|api[_.\- ]?key|key|credentials?))\b[ \t]*(?:=|:|is|was|->)[ \t]*([^\s\"'`,;]{8,})", re.I)
_NAME = re.compile(r"([\w.$\-]+)[\"'\]]?[ \t]*(?::[ \t]*[\w<>\[\]&.]+[ \t]*)?(?::=|=>|=|:|,)[ \t]*(?:[A-Za-z_.]*!?\([ \t]*)*[&*]?[bruf@]?$|\(?[\"']([\w.\-]+)[\"'][ \t]*,[ \t]*$")
_CALLED = re.compile(r"\b(?:login|log_in|signin|sign_in|authenticate|auth|connect|set_?password|with_?credentials?|basic_?auth|set_?token|with_?token|with_?password|bind)\s*\([^()]*,\s*[&*]?$", re.I)
_CONCAT = re.compile(r"concat!?\(\s*$")
_COMMA = re.compile(r"[\"'][ \t]*,\s*[\"']")
_INNER = re.compile(r"[\"']?([\w.-]+)[\"']?\s*[:=]\s*[\"']?([^\"'\s,;&}]{6,})")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{2}){8,}$")
_B64 = re.compile(r"^[A-Za-z0-9+/_-]{12,}={0,2}$")
_BASE32 = re.compile(r"^[A-Z2-7]{16,}={0,6}$")
#: Runs that may be encoded, wherever they stand, and arrays of byte values.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_%\\-])(?:[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])|(?:%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}){8,})")
_BYTES = re.compile(r"(?<![\w.])(?:(?:0[xX][0-9a-fA-F]{1,2}|\d{1,3})\s*,\s*){15,}(?:0[xX][0-9a-fA-F]{1,2}|\d{1,3})(?![\w.])")
#: A PuTTY key: its private lines.
_PUTTY = re.compile(r"PuTTY-User-Key-File-\d.*?Private-Lines:\s*\d+\s*?(?:\\r)?(?:\\n|\n)(.*?)(?=(?:\\r)?(?:\\n|\n)\s*(?:[\"']\s*\n?\s*[\"'])?Private-(?:MAC|Hash))", re.S)
#: Bytes that a compressed layer is opened to.
INFLATED = 1 << 26
_JOIN = re.compile(r"\"[ \t]*(?:\+|\.\.?|<>|\\)?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*\"|'[ \t]*(?:\+|\.\.?)?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*'")


#: Characters beyond which a triple-quoted or backtick literal holds a text rather than a value.
LONG = 400


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def randomish(v: str, password: bool) -> bool:
    """Whether a value without a format of its own reads like a secret rather than a word."""
    if len(v) < 8 or PLACEHOLDER.search(v) or REFERENCE.search(v) or v.isdigit():
        return False
    kinds = sum((any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() and c not in "_-. " for c in v)))
    if " " in v.strip() or "(" in v or re.fullmatch(r"[\d.,:\-/TZ+ ]+", v) or re.match(r"[a-z][a-z0-9+.-]*://|data:", v):
        return False
    if password:
        return kinds >= 3 or (kinds >= 2 and any(c.isdigit() for c in v) and entropy(v) >= 2.8)
    return len(v) >= 12 and any(c.isdigit() for c in v) and (entropy(v) >= 3.3 or kinds >= 3)


def _der(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start of contents, end) of the DER element at ``at``."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return tag, at, at + n


def _elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements from ``at`` to ``end``; None if they don't fill it. The last may miss up to three bytes."""
    found = []
    while at < end:
        e = _der(b, at)
        if not e or e[2] > end + 3:
            return None
        found.append(e)
        at = e[2]
    return found


#: Object ids of password-based encryption (PKCS#5) and of the data of PKCS#7, without their last bytes.
_PBE, _PKCS7 = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d0107")
_PKCS12_PBE = bytes.fromhex("2a864886f70d010c01")


def key_container(b: bytes) -> bool:
    """Whether bytes are a private key: PKCS#1, SEC1, PKCS#8 (plain or encrypted) or PKCS#12 in DER, the
    OpenSSH container or a Java key store."""
    if b.startswith((b"openssh-key-v1\0", b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce\0\0\0\2")):
        return True
    if b[:1] != b"\x30":
        return False
    top = _der(b)
    if not top or top[2] < len(b) - 3 or top[2] > len(b) + 3:
        return False
    parts = _elements(b, top[1], min(top[2], len(b)))
    if not parts or len(parts) < 2:
        return False
    first, second = parts[:2]

    def oid(e: tuple[int, int, int]) -> bytes:
        inner = _der(b, e[1]) if e[0] == 0x30 else None
        return b[inner[1] : inner[2]] if inner and inner[0] == 0x06 else b""

    if first[0] == 0x30:
        # encrypted PKCS#8: algorithm of password-based encryption, octet string
        return second[0] == 0x04 and oid(first).startswith((_PBE, _PKCS12_PBE))
    if first[0] != 0x02 or first[2] - first[1] != 1:
        return False
    version = b[first[1]]
    # PKCS#1: modulus; SEC1: octet string; PKCS#8: algorithm sequence; PKCS#12: version 3, authenticated safe
    if version == 3:
        return oid(second).startswith(_PKCS7)
    return version in (0, 1) and (second[0] in (0x02, 0x04) or bool(oid(second)))


def _printable(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{?([0-9a-fA-F]{4})\}?|([0-7]{3})|(.))", re.S)
#: One-letter escapes.
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}


def unescape(v: str) -> str:
    def one(m: re.Match) -> str:
        h = m[1] or m[2]
        return chr(int(h, 16)) if h else chr(int(m[3], 8)) if m[3] else _SIMPLE.get(m[4], m[4])

    return _ESCAPE.sub(one, v)


def layers(v: str) -> Iterator[tuple[str, str | bytes]]:
    """The contents that ``v`` may encode, with the kind of layer."""
    if "\\" in v:
        u = unescape(v)
        if u != v:
            yield "escape", u
    if v.count("%") >= 3 and re.search(r"%[0-9a-fA-F]{2}", v):
        u = unquote(v)
        if u != v:
            yield "percent", u
    w = re.sub(r"\s+", "", v)
    if w.startswith("0x"):
        w = w[2:]
    if _BASE32.match(w) and len(w) % 8 == 0:
        try:
            yield "base32", base64.b32decode(w)
        except (binascii.Error, ValueError):
            pass
    if _HEX.match(w):
        yield "hex", bytes.fromhex(w)
    elif _B64.match(w) and len(w) >= 16:
        try:
            yield "base64", base64.b64decode(w.replace("-", "+").replace("_", "/") + "=" * (-len(w.rstrip("=")) % 4 - (len(w) - len(w.rstrip("=")))), validate=False)
        except (binascii.Error, ValueError):
            pass


def _inflated(b: bytes) -> bytes:
    """The contents of a gzip or zlib stream, or the bytes themselves."""
    if b[:2] == b"\x1f\x8b" or (b[:1] == b"\x78" and b[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda")):
        try:
            return zlib.decompressobj(47).decompress(b, INFLATED)
        except zlib.error:
            pass
    return b


def _bad(v: str) -> bool:
    return not v or bool(PLACEHOLDER.search(v))


def formats(v: str) -> list[tuple[int, int]]:
    """Spans of a text that are credentials by their own form."""
    found = []
    for m in TOKEN.finditer(v):
        body = m.group()
        if not PLACEHOLDER.search(body) and len(set(body[-16:])) > 4:
            found.append(m.span())
    for m in PEM.finditer(v):
        end = PEM_END.search(v, m.end())
        body = v[m.end() : end.start() if end else len(v)]
        if end:
            if re.search(r"[A-Za-z0-9+/]{16}", body):
                found.append((m.start(), end.end()))
        else:
            cut = re.match(r"(?:\\[nr]|[\s\"'+,.;]|\\)*[A-Za-z0-9+/=]{32,}(?:\\[nr]|[\s\"'+,]|[A-Za-z0-9+/=]{16,})*", body)
            if cut:
                found.append((m.start(), m.end() + cut.end()))
    if "PuTTY-User-Key-File" in v:
        found += [m.span(1) for m in _PUTTY.finditer(v) if re.search(r"[A-Za-z0-9+/]{16}", m[1])]
    for m in URL.finditer(v):
        if not _bad(m[2]) and not re.search(r"^[<{$%*\[]|^\w*(?:passw|pwd)\w*$", m[2], re.I):
            found.append(m.span(2))
    for m in HEADER.finditer(v):
        t = m[2]
        if m[1].lower() == "basic":
            s = next((_printable(x) for k, x in layers(t) if k == "base64" and isinstance(x, bytes)), None)
            if s and ":" in s and not _bad(s.split(":", 1)[1]):
                found.append(m.span(2))
        elif any(c.isdigit() for c in t) and not _bad(t) and entropy(t) > 3:
            found.append(m.span(2))
    for m in CONNECTION.finditer(v):
        if randomish(m[1], True):
            found.append(m.span(1))
    return found


def deep(v: str, named: bool, depth: int = DEPTH) -> bool:
    """Whether any layer of ``v`` holds a credential; ``named``: a secret's name stands beside it."""
    if formats(v):
        return True
    if depth == 0 or len(v) < 8:
        return False
    for kind, x in layers(v):
        if isinstance(x, bytes):
            x = _inflated(x)
            if key_container(x):
                return True
            s = _printable(x)
            if s is None:
                continue
            x = s
        if deep(x, named, depth - 1) or (named and randomish(x.strip(), True)):
            return True
        for m in _INNER.finditer(x):
            if _names_secret(m[1]) and randomish(m[2], True):
                return True
    return False


def encoded(v: str, named: bool, taken: bool = False) -> bool:
    """Whether ``v`` as a whole is an encoding around a credential; ``taken``: a layer is off already."""
    if taken and deep(v, named):
        return True
    for kind, x in layers(v):
        if kind == "escape":
            continue
        if isinstance(x, bytes):
            x = _inflated(x)
            if key_container(x):
                return True
            x = _printable(x) or ""
        if deep(x, named) or (named and randomish(x.strip(), True)):
            return True
    return False


def _name_before(text: str, at: int) -> tuple[str, str]:
    """(name beside a literal whose quote stands at ``at``, the line up to it)."""
    line = text[max(0, at - 120) : at].rsplit("\n", 1)[-1]
    n = _NAME.search(line)
    return ((n[1] or n[2] or "") if n else ""), line


def _tail(name: str) -> list[str]:
    """The last two words of a name."""
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+\d*|\d+", name)[-2:]


def _names_plain(name: str) -> bool:
    t = _tail(name)
    return bool(t) and bool(PLAIN_NAME.search(t[-1]) or t[0].lower() == "public")


def _names_secret(name: str) -> bool:
    t = "_".join(_tail(name))
    return bool(SECRET_NAME.search(t)) and not _names_plain(name)


def scan(text: str, settings: bool) -> list[tuple[int, int, bool]]:
    """(start, end, whether a credential starts here) of the parts of a text to mask, sorted.

    ``settings``: the text is a settings file, whose unquoted values count as literals.
    """
    if not text:
        return []
    spans = [(a, b, True) for a, b in formats(text)]

    def free(a: int, b: int) -> bool:
        return not any(s < b and a < e for s, e, _ in spans)

    def judge(name: str, v: str, a: int, b: int, called: bool) -> None:
        if len(v) < 6 or v.replace(" ", "").isalpha() or not free(a, b):
            return
        named = called or _names_secret(name)
        if named and randomish(v, called or bool(PASS_NAME.search(name))):
            spans.append((a, b, True))
        elif len(v) >= 12 and (named or not _names_plain(name)) and deep(v, named):
            spans.append((a, b, True))

    held: list[tuple[int, int, int, str]] = []
    inside: list[tuple[int, int]] = []
    for m in _LITERAL.finditer(text):
        g = 2 if m[1] else 3 if m[3] is not None else 4
        if m[1] and len(m[g]) > LONG:
            # a long literal is judged as a whole if it is encoded, and else by what stands in it
            a, e = m.span(g)
            name, line = _name_before(text, m.start())
            if not _names_plain(name) and free(a, e) and encoded(m[g], _names_secret(name) or bool(_CALLED.search(line))):
                spans.append((a, e, True))
            else:
                inside.append((a, e))
            continue
        held.append((m.start(), *m.span(g), m[g]))
    for a, e in inside:
        spans += [(a + x, a + y, first) for x, y, first in scan(text[a:e], True) if free(a + x, a + y)]
    # literals in several pieces ("ab" + "cd") are judged as one, and masked piece by piece
    run: list[tuple[int, int, int, str]] = []
    for i, piece in enumerate(held):
        run.append(piece)
        if i + 1 < len(held):
            gap = text[piece[2] : held[i + 1][1]]
            if len(gap) < 80 and (_JOIN.fullmatch(gap) or (_CONCAT.search(text[max(0, run[0][0] - 9) : run[0][0]]) and _COMMA.fullmatch(gap))):
                continue
        if len(run) > 1:
            whole = "".join(x[3] for x in run)
            name, line = _name_before(text, run[0][0])
            named = _names_secret(name) or bool(_CALLED.search(line))
            if (named and randomish(whole, True)) or (not _names_plain(name) and (bool(formats(whole)) or deep(whole, named))):
                spans[:] = [x for x in spans if not any(x[0] < e and a < x[1] for _, a, e, _ in run)]
                spans += [(a, e, k == 0) for k, (_, a, e, _) in enumerate(run)]
        else:
            at, a, e, v = piece
            if len(v) >= 6 and not v.replace(" ", "").isalpha():
                name, line = _name_before(text, at)
                judge(name, v, a, e, bool(_CALLED.search(line)))
        run = []
    if settings:
        for m in _SETTING.finditer(text):
            judge(m[1], m[2], *m.span(2), False)
    for m in _RUN.finditer(text):
        if free(*m.span()) and not m.group().isalpha() and encoded(m.group() if m.group()[0] != "\\" else unescape(m.group()), False, m.group()[0] == "\\"):
            name, _ = _name_before(text, m.start())
            if not _names_plain(name):
                spans.append((*m.span(), True))
    for m in _BYTES.finditer(text):
        n = [int(x, 0) if x[:2] in ("0x", "0X") else int(x) for x in re.split(r"\s*,\s*", m.group())]
        if max(n) < 256 and free(*m.span()):
            raw = _inflated(bytes(n))
            if key_container(raw) or ((v := _printable(raw)) and deep(v, False)):
                spans.append((*m.span(), True))
    for m in _COMMENTED.finditer(text):
        a, b = m.span(2)
        if free(a, b) and not _names_plain(m[1]) and randomish(m[2].rstrip(".)"), True):
            spans.append((a, b, True))
    return sorted(spans)


def mask(text: str, spans: list[tuple[int, int, bool]]) -> str:
    """The text with every span masked, character for character; line ends and the armour of keys stay, and
    arrays of byte values become zeros."""
    out, at = [], 0
    for a, b, _ in spans:
        a = max(a, at)
        out += [text[at:a], _cover(text[a:b])]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _cover(v: str) -> str:
    head, foot = PEM.match(v), PEM_END.search(v)
    if head:
        inner = v[head.end() : foot.start() if foot else len(v)]
        return head.group() + re.sub(r"\\[nr]|[\r\n\"'+\s]|(.)", lambda m: "*" if m[1] else m.group(), inner) + (foot.group() if foot else "")
    if _BYTES.fullmatch(v):
        return re.sub(r"(0[xX])?[0-9a-fA-F]+", lambda m: (m[1] or "") + "0" * (len(m.group()) - len(m[1] or "")), v)
    return re.sub(r"[^\r\n]", "*", v)


#: Suffixes of settings files, whose values need no quotes.
SETTINGS = ("env", "properties", "ini", "cfg", "conf", "toml", "yaml", "yml", "json", "config", "")


def _settings_file(path: str | None) -> bool:
    name = (path or "").rsplit("/", 1)[-1].lower()
    return "." not in name.strip(".") or name.rsplit(".", 1)[-1] in SETTINGS


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, lines, masked = [], [], []
        for i, (text, path) in enumerate(zip(b.column("text").to_pylist(), b.column("path").to_pylist())):
            s = scan(text, _settings_file(path))
            if s:
                rows.append(i)
                lines.append(sorted({text.count("\n", 0, a) + 1 for a, _, first in s if first}))
                masked.append(mask(text, s))
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id").take(pick), pa.array(lines, pa.list_(pa.int32())), pa.array(masked, pa.string())], ["id", "lines", "masked"])


def find_credentials(df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """``(id, lines, masked)`` of each text with a credential: the lines (from 1) on which one starts,
    and the whole text with all of them masked.

    Null ids and texts are left out, a null path counts as code without a suffix; repeated rows count
    once; an empty table gives an empty result; other columns are ignored. Texts are read whole.
    """
    src = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(_find, f"id {kind}, lines array<int>, masked string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_credentials(table(spark, sf_dir, "blocks"), "block_id", "content", "file_path")
    return got.select(F.col("id").alias("block_id"), F.explode("lines").alias("line_in_block")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that held credentials, masked."""
    got = find_credentials(table(spark, sf_dir, "blocks"), "block_id", "content", "file_path")
    return got.dropDuplicates(["id"]).select(F.col("id").alias("block_id"), F.size("lines").alias("credentials"), F.col("masked").alias("content"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
