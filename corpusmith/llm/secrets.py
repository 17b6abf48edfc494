"""Secrets by patterns, and keys and signed tokens that their own structure confirms.

Base spans are assignments of passwords and tokens, access-key ids and long hex runs, by pattern alone. Beside them, runs
of base64 or hex and PEM blocks are candidates only: each is decoded and reported if what it holds parses to its end as
a private key (DER whose nested lengths fill one another: PKCS #1, PKCS #8 plain or encrypted, SEC 1, DSA, PKCS #12; or
OpenSSH's length-prefixed strings), as a signed or encrypted token (a JSON header that names its algorithm, segments and
a signature of the length that the algorithm gives), or as text that holds one of these again. Public keys, certificates,
digests, images and other noise decode too, but do not parse as such, and are left alone.

Every text is read once, whole, where Spark has it: no shuffle, no state between rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, release_worker_cache

KINDS = ("assign", "access", "hex")
#: Kinds that the method adds, in the order of spans that start together.
ADDED = ("pem", "der", "ssh", "jwt")
#: Texts within decoded texts are followed so deep.
DEPTH = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = re.compile("password|passwd|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
_HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")

# Object identifiers of the key algorithms, and bytes of a signature by JSON Web Algorithm.
_ALGORITHMS = {
    "1.2.840.113549.1.1.1": "rsa", "1.2.840.113549.1.1.10": "rsa-pss", "1.2.840.10045.2.1": "ec", "1.2.840.10040.4.1": "dsa",
    "1.2.840.113549.1.3.1": "dh", "1.3.101.110": "x25519", "1.3.101.111": "x448", "1.3.101.112": "ed25519", "1.3.101.113": "ed448",
}
_ENCRYPTION = ("1.2.840.113549.1.5.", "1.2.840.113549.1.12.1.")
_DATA = ("1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2")
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}

INTEGER, BITS, OCTETS, OID, SEQUENCE, SET = 0x02, 0x03, 0x04, 0x06, 0x30, 0x31


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; matches that fail their kind's test are dropped."""
    out = []
    if _ASSIGN_HINT.search(text.lower()):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return _ordered(out)


def _ordered(spans: Iterable[tuple]) -> list[tuple]:
    place = {k: i for i, k in enumerate(KINDS + ADDED)}
    return sorted(spans, key=lambda x: (x[1], place[x[0]], x[2]))


def joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in spans)


# -- DER: a value is its tag and the slice of its content ------------------------------------------------------------


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that lie side by side in data[at:end], or None unless they fill it exactly with definite lengths in
    their shortest form."""
    out = []
    while at < end:
        if at + 2 > end or data[at] & 0x1F == 0x1F:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 8 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or size >> 8 * (n - 1) == 0:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _oid(data: bytes) -> str:
    parts, value = [], 0
    if len(data) > 64:
        return ""
    for byte in data:
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            parts.append(value)
            value = 0
    if not parts:
        return ""
    top = min(parts[0] // 40, 2)
    return ".".join(map(str, [top, parts[0] - 40 * top, *parts[1:]]))


def _small(data: bytes, item: tuple[int, int, int]) -> int:
    """The value of a one-byte INTEGER, else -1."""
    return data[item[1]] if item[0] == INTEGER and item[2] - item[1] == 1 else -1


def _algorithm(data: bytes, item: tuple[int, int, int]) -> str:
    """The OID that leads an AlgorithmIdentifier, else the empty string."""
    inner = der_items(data, item[1], item[2]) if item[0] == SEQUENCE else None
    return _oid(data[inner[0][1] : inner[0][2]]) if inner and inner[0][0] == OID and len(inner) <= 2 else ""


def der_key(data: bytes) -> str:
    """Which private key the bytes encode from the first to the last, else the empty string."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return ""
    items = der_items(data, outer[0][1], outer[0][2])
    if not items or len(items) < 2:
        return ""
    tags, version = [t for t, _, _ in items], _small(data, items[0])
    if len(items) >= 9 and version in (0, 1) and tags[:9] == [INTEGER] * 9 and set(tags[9:]) <= {SEQUENCE}:
        sizes = [e - s for _, s, e in items]
        return "pkcs1 rsa" if sizes[1] >= 32 and abs(sizes[1] - sizes[4] - sizes[5]) <= 2 else ""
    if tags == [INTEGER] * 6 and version == 0 and items[1][2] - items[1][1] >= 64:
        return "dsa"
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        name = _ALGORITHMS.get(_algorithm(data, items[1]), "")
        inner = der_items(data, items[2][1], items[2][2])
        return f"pkcs8 {name}" if name and inner else ""
    if version == 1 and tags[1] == OCTETS and set(tags[2:]) <= {0xA0, 0xA1} and 20 <= items[1][2] - items[1][1] <= 66:
        inner = [der_items(data, s, e) for t, s, e in items[2:]]
        good = all(x and len(x) == 1 and x[0][0] in (OID, BITS, SEQUENCE) for x in inner)
        return "sec1 ec" if good and inner else ""
    if tags == [SEQUENCE, OCTETS] and _algorithm(data, items[0]).startswith(_ENCRYPTION) and items[1][2] > items[1][1]:
        return "pkcs8 encrypted"
    if version == 3 and tags[1] == SEQUENCE and set(tags[2:]) <= {SEQUENCE} and _algorithm(data, items[1]) in _DATA:
        return "pkcs12"
    return ""


def ssh_key(data: bytes) -> str:
    """The kind of key in an OpenSSH private key file's bytes, whose strings must fill them, else the empty string."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return ""

    def string(at: int) -> tuple[bytes, int]:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError
        return data[at + 4 : at + 4 + size], at + 4 + size

    try:
        at, names = len(magic), []
        for _ in range(3):
            part, at = string(at)
            names.append(part)
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= keys <= 16:
            return ""
        public = b""
        for _ in range(keys):
            public, at = string(at)
        private, at = string(at)
    except ValueError:
        return ""
    kind = public[4 : 4 + int.from_bytes(public[:4], "big")]
    if at != len(data) or not private or len(private) % 8 or not kind.isascii():
        return ""
    return f"openssh {kind.decode()}" + (" encrypted" if names[0] != b"none" else "")


def _decoded(run: str) -> bytes:
    """The bytes of a base64 run in either alphabet, padded or not; none if it is not one."""
    body = run.rstrip("=")
    if len(body) % 4 == 1 or (len(run) % 4 and len(run) != len(body)):
        return b""
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return b""


def token_of(run: str) -> str:
    """The algorithm of a signed or encrypted token in compact form, else the empty string."""
    parts = run.split(".")
    try:
        header = json.loads(_decoded(parts[0]))
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or not header["alg"]:
            return ""
        if len(parts) == 5:
            return f"jwe {header['alg']}" if isinstance(header.get("enc"), str) and parts[3] and parts[4] else ""
        if len(parts) != 3 or not parts[1] or (header["alg"].lower() == "none") != (not parts[2]):
            return ""
        if header.get("b64", True) and not isinstance(json.loads(_decoded(parts[1])), dict):
            return ""
    except (ValueError, RecursionError):  # not JSON, or nested without end
        return ""
    size = len(_decoded(parts[2]))
    want = _SIGNATURE.get(header["alg"])
    if parts[2] and (size != want if want else size < 16):
        return ""
    return f"jws {header['alg']}"


def _pem(label: str, body: str) -> str:
    """What a PEM block holds, else the empty string. Line ends may stand as two characters, as in JSON."""
    lines = [x.strip() for x in body.replace("\\r", "\n").replace("\\n", "\n").split("\n")]
    headers = [x for x in lines if ":" in x]
    data = _decoded("".join(x for x in lines if ":" not in x))
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers):
        return f"{label.lower()} encrypted" if len(data) >= 64 and len(data) % 8 == 0 else ""
    return ssh_key(data) if label.startswith("OPENSSH") else der_key(data)


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, what was parsed) of every candidate that its structure confirms."""
    out: list[tuple[str, int, int, str]] = []
    if "PRIVATE KEY-----" in text:
        begin = None
        for m in _MARK.finditer(text):
            if m[1] == "BEGIN":
                begin = m
            elif begin and begin[2] == m[2]:
                if found := _pem(m[2], text[begin.end() : m.start()]):
                    out.append(("pem", begin.start(), m.end(), found))
                begin = None
    taken = [(s, e) for _, s, e, _ in out]
    more = []
    for m in _TOKEN.finditer(text):
        if found := token_of(m[0].rstrip(".") if m[0].count(".") == 3 and m[0].endswith(".") else m[0]):
            more.append(("jwt", m.start(), m.end() - (m[0].count(".") == 3 and m[0].endswith(".")), found))
    for m in _BASE64.finditer(text):
        if data := _decoded(m[0]):
            more += _parsed(data, *m.span(), depth)
    for m in _HEX_BYTES.finditer(text):
        more += _parsed(bytes.fromhex(m[0]), *m.span(), depth)
    at = 0
    for found in sorted(more, key=lambda x: (x[1], -x[2])):
        while at < len(taken) and taken[at][1] <= found[1]:
            at += 1
        if at == len(taken) or found[2] <= taken[at][0]:
            out.append(found)
    return _ordered(dict.fromkeys(out))


def _parsed(data: bytes, start: int, end: int, depth: int) -> Iterator[tuple[str, int, int, str]]:
    if data[0] == SEQUENCE:
        if found := der_key(data):
            yield "der", start, end, found
    elif data.startswith(b"openssh-key-v1"):
        if found := ssh_key(data):
            yield "ssh", start, end, found
    elif depth > 1 and data.isascii() and len(data) >= 32:
        for kind, _, _, found in confirmed(data.decode("ascii"), depth - 1)[:1]:
            yield kind, start, end, found


_SCAN = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_confirmed", pa.int64()), ("base", pa.string()), ("spans", pa.string())]
    + [("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("what", pa.string())])))]
)
_DDL = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base string, spans string, found array<struct<kind: string, start: long, end: long, what: string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex (base spans), n_confirmed, base and spans
    (kind:start:end, comma-joined, by start and then kind), found (the confirmed ones with what was parsed).

    Positions are code points of the whole text, ends exclusive. Null and empty texts have no spans; rows that repeat are
    returned as often as they occur; other columns are not read, whatever their names."""
    bound_batches(docs.sparkSession)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        for frame in frames:
            rows = []
            for doc_id, text in zip(column(frame, "doc_id"), column(frame, "text"), strict=True):
                base, more = base_spans(text or ""), confirmed(text or "")
                count = {f"n_{k}": sum(x[0] == k for x in base) for k in KINDS}
                found = [{"kind": k, "start": s, "end": e, "what": what} for k, s, e, what in more]
                rows.append({"doc_id": doc_id, **count, "n_confirmed": len(more), "base": joined(base), "spans": joined(_ordered([*base, *(x[:3] for x in more)])), "found": found})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets: of spans that overlap, the one that starts first
    and then the longest names the whole run. Null texts stay null; other columns are as they were."""

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end in sorted([*base_spans(text), *(x[:3] for x in confirmed(text))], key=lambda x: (x[1], -x[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    bound_batches(docs.sparkSession)
    return docs.withColumn("text", F.udf(masked, "string", useArrow=True)(F.col("text").cast("string"))).select(docs.columns)
