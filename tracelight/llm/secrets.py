"""Secret scans with structural confirmation.

Three base patterns give spans as they stand. Runs of base64 or hex signs are
decoded and reported only if the bytes parse: a DER private key whose nested
lengths fill their parents exactly (PKCS#1, PKCS#8 plain or encrypted, SEC1, DSA), an
OpenSSH key container, a PEM block around either or with the headers of an encrypted
key, or a signed token whose header is JSON with an algorithm and whose body is JSON.

A key may begin anywhere in a run, and go on over line breaks, be they signs or written as
\\n, quoted, commented or in the parts of a string literal; hex may stand in either case and
with signs between its bytes. How long it is its first bytes tell, so no more is read than
that: a key has at most LONGEST bytes, and the time is linear in the text.

Offsets are code points, ends exclusive. Null text is empty and gives no span.
Rows are independent: repeats, ties and extra columns have no influence.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R

KINDS = ("assign", "access", "hex", "private_key", "signed_token")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Bytes of the longest key there may be; RSA of 16,384 bits takes 10,000.
LONGEST = 1 << 16
_MAGIC = b"openssh-key-v1\0"
#: what may stand in front of a line that goes on: quotes of mails, comments, string literals
_MARGIN = r"(?:[ \t]*(?:>|(?:\#|//|\*|\|)(?=[ \t])))*[ \t]*[\"'`]?"
_LINE = rf"(?:\\+r)?(?:\\+n)?(?:[\"'`][ \t]*[+.,;&]?)?[ \t]*\\?\r?\n{_MARGIN}"


class _Base64:
    """Bytes that are written from a place on, over gaps, read as far as is asked for."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.spans, self.have = text, at, [], 0

    def reaches(self, size: int) -> bool:
        n = -(-size * 4 // 3)
        while self.have < n:
            if n - self.have > len(self.text) - self.at:
                return False
            m = _SIGNS.match(self.text, self.at, min(len(self.text), self.at + n - self.have))
            if m:
                self.spans.append(m.span())
                self.have += m.end() - m.start()
                self.at = m.end()
            elif self.spans and self.spans[-1][1] == self.at and (gap := _GAP.match(self.text, self.at)):
                self.at = gap.end()
            else:
                return False
        return True

    def bytes(self, size: int) -> bytes | None:
        return _b64("".join(self.text[a:b] for a, b in self.spans)[: -(-size * 4 // 3)]) if self.reaches(size) else None

    def end(self, size: int) -> int:
        n = -(-size * 4 // 3)
        pad = -n % 4
        for a, b in self.spans:
            if n <= b - a:
                break
            n -= b - a
        end = a + n
        while pad and self.text[end : end + 1] == "=":
            end, pad = end + 1, pad - 1
        return end


class _Hex:
    """The same in the digits of a stretch, which stand at `places`, runs of (digit, place)."""

    def __init__(self, digits: str, places: list[tuple[int, int]], at: int):
        self.digits, self.places, self.at = digits, places, at

    def reaches(self, size: int) -> bool:
        return self.at + 2 * size <= len(self.digits)

    def bytes(self, size: int) -> bytes | None:
        return bytes.fromhex(self.digits[self.at : self.at + 2 * size]) if self.reaches(size) else None

    def place(self, k: int) -> int:
        first, at = self.places[bisect.bisect_right(self.places, (k, len(self.digits) << 40)) - 1]
        return at + k - first

    def end(self, size: int) -> int:
        return self.place(self.at + 2 * size - 1) + 1


_SIGNS = re.compile(r"[A-Za-z0-9+/_-]+")
_GAP = re.compile(rf"(?:[ \t]*(?:{_LINE}|(?:\\+r)?\\+n[ \t]*))(?=[A-Za-z0-9+/_-])|\\+(?=/)")
#: where a DER sequence or an OpenSSH container can begin
_BASE64_START = re.compile(r"(?=M[A-I][A-Za-z0-9+/_-]{18}|b3BlbnNzaC1rZXktdjEA)")
_BETWEEN = rf"(?:[ \t:,;]|0x|\\+x|\\+[rn]|{_LINE})"
#: the same in hex as it is written, and in digits alone
_HEX_SEEN = re.compile(rf"(?ai)30{_BETWEEN}*(?:[0-7][0-9a-f]|81{_BETWEEN}*[0-9a-f]{{2}}|82(?:{_BETWEEN}*[0-9a-f]{{2}}){{2}}){_BETWEEN}*(?:30|02{_BETWEEN}*01{_BETWEEN}*0[01])|" + f"{_BETWEEN}*".join(f"{c:02x}" for c in _MAGIC))
_HEX_START = re.compile(r"(?ai)30(?:[0-7][0-9a-f]|81..|82....)(?:30|02010[01])|" + _MAGIC.hex())
_STRETCH = re.compile(rf"[0-9A-Fa-f]+(?:{_BETWEEN}+[0-9A-Fa-f]+)*")
_PART = re.compile(rf"{_BETWEEN}+|([0-9A-Fa-f]+)")
_ESCAPED = re.compile(r"\\+[nrt]")
_FIELD = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
#: password-based encryption of PKCS#5 and PKCS#12
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_HEX_SIGNS = bytes(72 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_B64_SIGNS = bytes(66 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 32 for c in range(256))


def _der(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements (tag, start, end) that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    top = _der(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _der(data, *top[0][1:])
    tags = [x[0] for x in inner or []]
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][2] - inner[0][1] == 1:  # PKCS#8
        algorithm = _der(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted
        algorithm = _der(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(_PBE) and inner[1][2] - inner[1][1] >= 8
    if tags == [0x02] * 6:  # DSA: 0, p, q, g, y, x
        return data[inner[0][1] : inner[0][2]] == b"\0" and inner[1][2] - inner[1][1] >= 64 and 20 <= inner[2][2] - inner[2][1] <= 33
    if tags == [0x02] * 9 + [0x30]:  # PKCS#1 of more than two primes
        return data[inner[0][1] : inner[0][2]] == b"\1" and inner[1][2] - inner[1][1] >= 32 and bool(_der(data, *inner[9][1:]))
    if len(tags) == 9 and set(tags) == {0x02}:  # PKCS#1
        return data[inner[0][1] : inner[0][2]] == b"\0" and inner[1][2] - inner[1][1] >= 32
    if tags[:2] == [0x02, 0x04] and len(tags) >= 3 and all(t in (0xA0, 0xA1) for t in tags[2:]):  # SEC1
        return data[inner[0][1] : inner[0][2]] == b"\1" and all(_der(data, *x[1:]) for x in inner[2:])
    return False


def openssh_length(data: bytes) -> tuple[int, bool] | None:
    """Bytes of the container that data begins, and whether data tells: three
    length-prefixed fields, the number of keys, a public part for each and the private part.
    If it does not, so many bytes are needed to go on."""
    if not data.startswith(_MAGIC):
        return None
    at, fields, n_fields = len(_MAGIC), 0, 6
    while fields < n_fields:
        if at + 4 > len(data):
            return at + 4, False
        n = struct.unpack_from(">I", data, at)[0]
        at += 4
        if fields == 3:  # a number, no length
            if n < 1:
                return None
            n_fields = 5 + n
        else:
            at += n
        fields += 1
    return at, True


def is_openssh(data: bytes) -> bool:
    """The container's fields fill it."""
    return openssh_length(data) == (len(data), True)


def _der_length(head: bytes) -> int | None:
    """Bytes of the sequence that begins so, if a version or an algorithm comes first in
    it, and what comes second has room."""
    if head[0] != 0x30:
        return None
    n, k = head[1], 0
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n = int.from_bytes(head[2 : 2 + k], "big")
    inner = head[2 + k :]
    if inner[0] == 0x02:
        if inner[:3] not in (b"\x02\x01\x00", b"\x02\x01\x01") or inner[3] not in (0x02, 0x04, 0x30):
            return None
        inner, more = inner[3:], 3
    elif inner[0] == 0x30:
        more = 0
    else:
        return None
    m, j = inner[1], 0
    if m & 0x80:
        j = m & 0x7F
        if not 1 <= j <= 4:
            return None
        m = int.from_bytes(inner[2 : 2 + j], "big")
    return 2 + k + n if more + 2 + j + m < n else None


def _key(run: _Base64 | _Hex) -> int | None:
    """Bytes of the private key that is written from there on, if one is."""
    data = run.bytes(len(_MAGIC))
    if not data:
        return None
    if data != _MAGIC:
        size = _der_length(data)
        return size if size is not None and len(_MAGIC) < size <= LONGEST and (data := run.bytes(size)) and is_private_der(data) else None
    size, told = len(_MAGIC) + 4, False
    while not told:
        if size > LONGEST or not (data := run.bytes(size)) or (got := openssh_length(data)) is None:
            return None
        size, told = got
        if not told and size < 2 * len(data) and run.reaches(2 * len(data)):
            size = 2 * len(data)  # what is read grows twofold, not by fields
    return size if size <= LONGEST and run.reaches(size) else None


def _pem_key(body: str) -> bool:
    """Between the marks stands a key, or headers of an encrypted one and its bytes."""
    fields, rest, heads = {}, [], True
    for line in _ESCAPED.sub("\n", body).replace("\\", "").split("\n"):
        name, colon, value = line.strip().partition(":")
        if heads and colon and _FIELD.match(name + colon):
            fields[name.lower()] = value.strip()
        elif heads and fields and not name:
            heads = False
        elif name and not (heads and fields and line[:1] in (" ", "\t")):  # else a header goes on
            rest.append(line)
            heads = False
    data = _b64("".join("".join(rest).split()))
    if not data:
        return False
    if "ENCRYPTED" in fields.get("proc-type", ""):
        cipher, _, iv = fields.get("dek-info", "").partition(",")
        return bool(cipher) and re.fullmatch(r"(?:[0-9A-Fa-f]{2}){8,}", iv.strip()) is not None and len(data) % 8 == 0
    return is_private_der(data) or is_openssh(data)


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(s: str):
    try:
        return json.loads(_b64(s) or b"")
    except ValueError:  # also bad UTF-8
        return None
    except RecursionError:
        return None


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out = []
    low = raw.translate(R.LOWER_BYTES)
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"H" * 24 in raw.translate(_HEX_SIGNS):
        out += [(*m.span(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _starts(pattern: re.Pattern, text: str) -> Iterator[int]:
    """Every place that a match begins at; matches may overlap."""
    at = 0
    while m := pattern.search(text, at):
        yield m.start()
        at = m.start() + 1


def _keys(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out, last = [], 0
    if b"B" * 20 in raw.translate(_B64_SIGNS):
        for at in _starts(_BASE64_START, text):
            if at >= last and (size := _key(run := _Base64(text, at))):
                last = run.end(size)
                out.append((at, last, "private_key"))
    if _HEX_SEEN.search(text):
        for stretch in _STRETCH.finditer(text):
            if stretch.end() - stretch.start() <= 2 * len(_MAGIC):
                continue
            parts = [m for m in _PART.finditer(text, *stretch.span()) if m[1]]
            digits, places, last = "".join(m[1] for m in parts), [], 0
            for m in parts:
                places.append((last, m.start()))
                last += len(m[1])
            last = 0
            for at in _starts(_HEX_START, digits):
                if at >= last and (size := _key(run := _Hex(digits, places, at))):
                    last = at + 2 * size
                    out.append((run.place(at), run.end(size), "private_key"))
    return out


def confirmed_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "private_key") for m in _PEM.finditer(text) if _pem_key(m[2])] if b"PRIVATE KEY-----" in raw else []
    blocks, k = list(out), 0
    for a, b, kind in sorted(_keys(text, raw)):
        while k < len(blocks) and blocks[k][1] <= a:
            k += 1
        if k == len(blocks) or a < blocks[k][0]:  # else a block has it already
            out.append((a, b, kind))
    if b"." in raw and b"B" * 10 in raw.translate(_B64_SIGNS):
        for m in _TOKEN.finditer(text):
            head = _json(m[1])
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(m[2]), dict):
                out.append((*m.span(), "signed_token"))
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind."""
    raw = text.encode()
    base = base_spans(text, raw)
    more = confirmed_spans(text, raw)
    return base, sorted({*base, *more}, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind:start:end list as text), spans."""
    R.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = spans_of(text or "")
                kinds = [k for _, _, k in base]
                listed = written(base)
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed.encode()).hexdigest(), written(every)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return R.spread(rows).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def cleaned(text: str, mark: str = "[REDACTED]") -> str:
    """The text with every maximal union of overlapping spans replaced."""
    unions: list[list[int]] = []
    for a, b, _ in spans_of(text)[1]:
        if unions and a < unions[-1][1]:
            unions[-1][1] = max(unions[-1][1], b)
        else:
            unions.append([a, b])
    out, at = [], 0
    for a, b in unions:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with secrets in text replaced and n_chars, if it is there,
    counted anew for changed texts. Null text stays null."""
    R.prepare(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [None if t is None else cleaned(t) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.column(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if x == t else len(x) for n, t, x in zip(b.column(k).to_pylist(), texts, new)], b.column(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(R.table(spark, sf_dir, "documents"))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base patterns alone, which SQL can say."""
    return query(spark, sf_dir).drop("spans")


def _oracle() -> str:
    """Matches and the gaps between them, whose lengths give the places."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    patterns = {"assign": rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    kept = {"assign": f"length(regexp_extract(m, '{patterns['assign']}', 2)) >= 6", "access": "length(m) >= 20", "hex": "length(m) >= 24"}
    found = lambda k, kind: f"SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{patterns[kind]}') AS ms, string_split_regex(text, '{patterns[kind]}')[:-2] AS gs FROM t)"
    tests = " OR ".join(f"kind = '{kind}' AND {test}" for kind, test in kept.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found(k, kind) for k, kind in enumerate(patterns))}),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM f),
s AS (SELECT * FROM p WHERE {tests}),
l AS (SELECT doc_id, string_agg(kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - length(m), k) AS listed, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256 FROM t LEFT JOIN l USING (doc_id)
"""


BASE_ORACLE = _oracle()
