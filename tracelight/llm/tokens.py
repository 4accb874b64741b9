"""Token ids of whole texts, and files of them with Elias-Fano boundaries.

A file holds the ids of its documents one after the other as little-endian
unsigned numbers (16 bits if every id of the tokenizer fits, else 32), then two Elias-Fano lists,
the document ids and the end offsets, and a footer. A list of n numbers below u
takes about 2 + log2(u / n) bits each. select(i) finds the i-th number from a
sample of positions and the set bits of a few words, so no table of 64-bit
offsets is kept or read.

Null text is empty and has the end id alone. Rows with a null doc_id come first,
equal doc_ids stand side by side; every row keeps its place. An empty table gives
no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R

END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words kept per generation of the encoder's memory.
REMEMBERED = 250_000
_MAGIC = b"TLEF0001"
#: Letters for which lower-casing is one to one and NFC changes nothing, then signs that form one piece.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?%&#$*|()\[\]{}<>/\\=+~^\"@-]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Encoded text between blanks: word to ids as uint32 bytes. Full generations
    are kept once as `old`, so frequent words never have to be encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = json.dumps(spec.get("pre_tokenizer"))
        #: the short way holds for lower-casing tokenizers that split letters from signs
        self.short = "Lowercase" in json.dumps(spec.get("normalizer")) and "\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and "ByteLevel" in pre
        self.drops_blanks = self.short
        self.model, self.pieces, self.old = self.tok.model, {}, {}
        self.letters = _byte_letters()
        #: bytes that hold every id, added tokens included
        self.width = 2 if max([END, *self.tok.get_vocab(with_added_tokens=True).values()]) < 65536 else 4

    def piece(self, s: str) -> bytes:
        got = self.pieces.get(s)
        if got is None:
            if len(self.pieces) > REMEMBERED:
                self.pieces = {}
            mapped = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            got = self.pieces[s] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return got

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            m = _PLAIN.match(word) if self.short and len(word) < 200 else None
            if m:
                letters, signs = m.groups()
                got = (self.piece(letters.lower()) if letters else b"") + (self.piece(signs) if signs else b"")
            else:
                got = np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def forget(self) -> None:
        for table in (self, self.old, self.pieces):
            table.clear()

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32. Pieces never reach over blanks."""
        if not self.drops_blanks:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> _Words:
    return _Words(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- Elias-Fano ------------------------------------------------------------

_EVERY = 512


def ef_encode(values) -> bytes:
    """A non-decreasing list of non-negative numbers."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if n and (np.diff(v.astype(np.int64)) < 0).any():
        raise ValueError("values must not decrease")
    u = int(v[-1]) + 1 if n else 1
    low = max(0, (u // max(n, 1)).bit_length() - 1)
    lows = np.packbits(((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") if low else np.empty(0, np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-(int(ones[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little")
    sample = ones[::_EVERY].astype("<u4" if not n or ones[-1] < 2**32 else "<u8")
    return struct.pack("<QBBQQQ", n, low, sample.itemsize, len(lows), len(high), len(sample)) + lows.tobytes() + high.tobytes() + sample.tobytes()


class EliasFano:
    _HEAD = struct.calcsize("<QBBQQQ")

    def __init__(self, data: bytes):
        self.n, self.low, width, n_low, n_high, n_sample = struct.unpack_from("<QBBQQQ", data)
        at = self._HEAD
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.sample = np.frombuffer(data, f"<u{width}", n_sample, at + n_low + n_high)
        self.size = at + n_low + n_high + n_sample * width

    def _low_bits(self, i: int, j: int) -> np.ndarray:
        if not self.low:
            return np.zeros(j - i, np.uint64)
        a, b = i * self.low, j * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))

    def range(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1."""
        if j <= i:
            return np.empty(0, np.uint64)
        first = int(self.sample[i // _EVERY])
        last = int(self.sample[-(-j // _EVERY)]) if -(-j // _EVERY) < len(self.sample) else len(self.high) * 8 - 1
        start = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[start : last // 8 + 1], bitorder="little")) + start * 8
        ones = ones[ones >= first][i - i // _EVERY * _EVERY :][: j - i]
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)) | self._low_bits(i, j)

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.range(i, i + 1)[0])


# --- files -----------------------------------------------------------------


def write_file(path: str, rows, width: int = 2) -> tuple[int, int]:
    """rows: (doc_id or None, ids as uint32 bytes) in ascending order. The ids go
    out as they come, in so many bytes each (2 or 4); only a number per document stays in memory."""
    fs, target = R.local_fs(path)
    fs.create_dir(os.path.dirname(target), recursive=True)
    doc_ids, ends, nulls, total = [], [], 0, 0
    with fs.open_output_stream(target) as out:
        out.write(_MAGIC)
        for doc, ids in rows:
            a = np.frombuffer(ids, "<u4")
            if width == 2 and len(a) and a.max() >= 65536:
                raise ValueError("ids beyond 16 bits need width=4")
            out.write(a.astype(f"<u{width}").tobytes())
            total += len(a)
            ends.append(total)
            if doc is None:
                nulls += 1
            else:
                doc_ids.append(doc)
        base = doc_ids[0] if doc_ids else 0
        parts = [ef_encode([d - base for d in doc_ids]), ef_encode(ends)]
        for p in parts:
            out.write(p)
        out.write(struct.pack("<QQqQQB", len(parts[0]), len(parts[1]), base, nulls, total, width) + _MAGIC)
    return len(ends), total


_FOOT = struct.calcsize("<QQqQQB") + len(_MAGIC)


class TokenFile:
    """Reads one file: two lists at the end, ids by range."""

    def __init__(self, path: str):
        fs, p = R.local_fs(path)
        self.f = fs.open_input_file(p)
        size = self.f.size()
        foot = self.f.read_at(_FOOT, size - _FOOT)
        if foot[-8:] != _MAGIC:
            raise ValueError(f"{path} is no token file")
        a, b, self.base, self.nulls, self.total, self.width = struct.unpack_from("<QQqQQB", foot)
        lists = self.f.read_at(a + b, size - _FOOT - a - b)
        self.docs, self.ends = EliasFano(lists[:a]), EliasFano(lists[a:])
        self.n = self.ends.n

    def doc_ids(self, i: int, j: int) -> list:
        k = max(0, self.nulls - i)
        return [None] * min(k, j - i) + [int(x) + self.base for x in self.docs.range(max(i, self.nulls) - self.nulls, j - self.nulls)]

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Offsets where documents i to j - 1 begin, and the end of the last."""
        first = [0] if i == 0 else []
        return np.concatenate([np.array(first, np.int64), self.ends.range(max(i - 1, 0), j).astype(np.int64)])

    def ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at((b - a) * self.width, len(_MAGIC) + a * self.width), f"<u{self.width}")

    def close(self):
        self.f.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Writes one file per range of doc_ids; returns shard, path, n_docs, n_ids.
    The text crosses the network once, by range of doc_id; rows that repeat an id are told
    apart by a hash of the text, so that one id may take several files. A file is named by
    its attempt: a task that runs twice leaves two whole files, of which the returned list
    holds one."""
    R.prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(R.parts_for(rows), *order).sortWithinPartitions(*order)

    def run(batches):
        shard = TaskContext.get().partitionId()
        enc, end = encoder(path), struct.pack("<I", END)

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield doc, enc.ids(text) + end

        it = rows()
        first = next(it, None)
        if first is None:
            return
        name = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex[:12]}.tok"
        n, total = write_file(name, chain([first], it), enc.width)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": pa.array([name]), "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return rows.mapInArrow(R.forgetting(lambda: encoder(path).forget(), run), "shard long, path string, n_docs long, n_ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files in shard order. The totals of
    the files, one number each, are summed up on the driver."""
    spark = files.sparkSession
    R.prepare(spark)
    rows = sorted(files.select("shard", "path", "n_ids").collect())
    bases, at = [], 0
    for r in rows:
        bases.append((r.path, at))
        at += r.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(bases, "path string, base long").repartition(max(1, len(bases)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = TokenFile(path)
                i = 0
                while i < f.n:
                    j = min(i + 2048, f.n)
                    at = f.bounds(i, j)
                    crcs = [zlib.crc32(f.ids(int(x), int(y)).astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(f.doc_ids(i, j), pa.int64()), "start": pa.array(at[:-1] + base), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crcs, pa.int64())})
                    i = j
                f.close()

    return listed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(R.table(spark, sf_dir, "documents"), R.shared_dir(spark, "token-files"))
    return read_token_files(R.stored(files, "token-list"))
