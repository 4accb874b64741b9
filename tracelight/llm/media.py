"""Telephony audio in media columns.

A stored form is a RIFF/WAVE file: mu-law (format 7), A-law (format 6), IMA
ADPCM (format 17) or 16-bit PCM (format 1). G.711 codes are expanded by lookup
tables of 256 entries; ADPCM blocks of all files of a batch are decoded together,
one numpy step per nibble across blocks; PCM is resampled by a windowed-sinc
polyphase filter in integers, so results are the same on every machine.

Null text counts as empty. Empty text still gives one padded unit. Equal texts
give equal values; rows are independent, so ties, repeats and extra columns have
no influence.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from . import runtime as R

UNIT = 576
RATE = 8000
#: A rate at which PCM takes less room than its mu-law codes; the query takes no such rate.
PCM_RATE = 2000
ADPCM_BLOCK = 36
MULAW, ALAW, ADPCM, PCM = 7, 6, 17, 1


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: code to 16-bit sample."""
    c = ~np.arange(256) & 0xFF
    mag = ((((c & 0x0F) << 3) + 0x84) << ((c >> 4) & 7)) - 0x84
    return np.where(c & 0x80, -mag, mag).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: code to 16-bit sample."""
    c = np.arange(256) ^ 0x55
    exp, man = (c >> 4) & 7, c & 0x0F
    mag = np.where(exp == 0, (man << 4) + 8, ((man << 4) + 0x108) << np.maximum(exp - 1, 0))
    return np.where(c & 0x80, mag, -mag).astype(np.int16)


#: IMA ADPCM step sizes and index changes: fixed values of the format.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

_MU, _A = mulaw_table(), alaw_table()


def nearest_codes(table: np.ndarray) -> np.ndarray:
    """For every 16-bit sample, from -32768 up, the code whose sample is nearest; of two
    the lower sample."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int64)
    middle = (values[1:] + values[:-1]) // 2
    return order[np.searchsorted(middle, np.arange(-32768, 32768), side="left")].astype(np.uint8)


_TO_ALAW = nearest_codes(_A)
_N = np.arange(8)
#: (step index, nibble) to difference and to next index
_DIFF = ((STEPS[:, None] >> 3) + np.where(_N & 4, STEPS[:, None], 0) + np.where(_N & 2, STEPS[:, None] >> 1, 0) + np.where(_N & 1, STEPS[:, None] >> 2, 0)).astype(np.int32)
_DIFF = np.concatenate([_DIFF, -_DIFF], axis=1)
_NEXT = np.clip(np.arange(89)[:, None] + np.concatenate([SHIFT, SHIFT])[None, :], 0, 88).astype(np.int32)


def decode_adpcm(data: np.ndarray, block: int = ADPCM_BLOCK) -> np.ndarray:
    """Mono IMA ADPCM: uint8 of whole blocks to int16, (blocks, samples)."""
    b = data.reshape(-1, block)
    out = np.empty((len(b), 1 + 2 * (block - 4)), np.int16)
    value = b[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(b[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    columns = np.ascontiguousarray(b[:, 4:].T)
    for k, col in enumerate(columns):
        for half, nibble in enumerate((col & 15, col >> 4)):
            value = np.clip(value + _DIFF[index, nibble], -32768, 32767)
            index = _NEXT[index, nibble]
            out[:, 1 + 2 * k + half] = value
    return out


@functools.lru_cache(maxsize=1)
def _nearest_nibbles() -> np.ndarray:
    """Per step index, the three bits whose difference is nearest to a distance from 0 to
    65535; of two the smaller."""
    reach = np.arange(65536)
    return np.concatenate([np.searchsorted((m[1:] + m[:-1]) / 2, reach, side="left") for m in _DIFF[:, :8]]).astype(np.uint8)


def encode_adpcm(samples: np.ndarray, block: int = ADPCM_BLOCK) -> np.ndarray:
    """int16 (blocks, samples) to blocks; the nearest code at every step."""
    out = np.zeros((len(samples), block), np.uint8)
    value, index = samples[:, 0].astype(np.int32), np.zeros(len(samples), np.int32)
    out[:, :2] = samples[:, :1].astype("<i2").view(np.uint8)
    table, diffs, nexts = _nearest_nibbles(), _DIFF.ravel(), _NEXT.ravel()
    columns = np.ascontiguousarray(samples.T)
    codes = np.zeros((2 * (block - 4), len(samples)), np.uint8)
    for k in range(1, samples.shape[1]):
        away = columns[k] - value
        nibble = table[(index << 16) + np.abs(away)] | ((away < 0).astype(np.uint8) << 3)
        # where a code would leave 16 bits, it stops at their border: all are tried there
        edge = np.flatnonzero(np.abs(value) + _DIFF[index, 7] > 32767)
        if len(edge):
            tried = np.clip(value[edge, None] + _DIFF[index[edge]], -32768, 32767)
            nibble[edge] = np.abs(tried - columns[k][edge, None].astype(np.int32)).argmin(axis=1)
        at = index * 16 + nibble
        value, index = np.clip(value + diffs[at], -32768, 32767), nexts[at]
        codes[k - 1] = nibble
    out[:, 4:] = (codes[::2] | codes[1::2] << 4).T
    return out


def wave(kind: int, data: bytes, rate: int = RATE, block: int = ADPCM_BLOCK) -> bytes:
    """A mono RIFF/WAVE file around coded data."""
    if kind == ADPCM:
        per = 1 + 2 * (block - 4)
        fmt = struct.pack("<HHIIHHHH", kind, 1, rate, rate * block // per, block, 4, 2, per)
        n = len(data) // block * per
    else:
        bits = 16 if kind == PCM else 8
        fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * bits // 8, bits // 8, bits) + (b"" if kind == PCM else b"\0\0")
        n = len(data) * 8 // bits
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind != PCM:
        chunks += b"fact" + struct.pack("<II", 4, n)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format, rate, block align, data) of a mono RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    view, at, fmt = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
            if fmt[1] != 1:
                raise ValueError(f"{fmt[1]} channels; only mono is read")
        elif name == b"data":
            if fmt is None or at + 8 + size > len(media):
                raise ValueError("data chunk without format or cut short")
            return fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand_all(files: list[bytes | None]) -> list[tuple[int, np.ndarray] | str]:
    """(rate, int16 samples) of stored files, or why one cannot be read. The ADPCM blocks
    of all files of a block size are decoded together; a short last block is decoded as
    far as it goes."""
    out: list = [None] * len(files)
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    raws: dict[int, list[np.ndarray]] = {}
    for k, media in enumerate(files):
        if media is None:
            out[k] = "null"
            continue
        try:
            kind, rate, block, data = parse_wave(media)
            raw = np.frombuffer(data, np.uint8)
            if kind == ADPCM:
                if block < 5 or (len(raw) % block) in (1, 2, 3):
                    raise ValueError("ADPCM block without its header")
                n = -(-len(raw) // block)
                blocks.setdefault(block, []).append((k, rate, n * (1 + 2 * (block - 4)) - 2 * (n * block - len(raw))))
                raws.setdefault(block, []).append(np.pad(raw, (0, n * block - len(raw))))
            elif kind in (MULAW, ALAW):
                out[k] = rate, (_MU if kind == MULAW else _A)[raw]
            elif kind == PCM and block == 2:
                out[k] = rate, np.frombuffer(data, "<i2")
            else:
                raise ValueError(f"format {kind} with blocks of {block} bytes is not read")
        except (ValueError, struct.error) as e:
            out[k] = str(e)
    for block, mine in blocks.items():
        samples, at = decode_adpcm(np.concatenate(raws[block]), block), 0
        for (k, rate, n), raw in zip(mine, raws[block]):
            out[k] = rate, samples[at : at + len(raw) // block].reshape(-1)[:n]
            at += len(raw) // block
    return out


def expand(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples) of one stored file."""
    got = expand_all([media])[0]
    if isinstance(got, str):
        raise ValueError(got)
    return got


@functools.lru_cache(maxsize=8)
def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Polyphase filter bank in Q15: one row per output phase."""
    n = np.arange(-half, half)
    bank = []
    scale = min(1.0, up / down)
    for p in range(up):
        t = n - (p * down % up) / up
        h = np.sinc(t * scale) * scale * np.cos(np.pi * t / (2 * half + 2)) ** 2
        q = np.round(h / h.sum() * 32768).astype(np.int64)
        q[half] += 32768 - q.sum()
        bank.append(q)
    return np.array(bank)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """int16 PCM at another rate; integer arithmetic, edges held."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    half = 8 * -(-down // up) if down > up else 8  # as many periods of the lower rate, whatever the ratio
    bank = _taps(up, down, half)
    x = np.pad(samples.astype(np.int64), half, mode="edge")
    n = len(samples) * up // down
    out = np.empty(n, np.int64)
    for p in range(min(up, n)):
        first, m = p * down // up, -(-(n - p) // up)
        acc = np.zeros(m, np.int64)
        for j in np.flatnonzero(bank[p]):
            acc += x[first + j :: down][:m] * bank[p, j]
        out[p::up] = acc >> 15
    return np.clip(out, -32768, 32767).astype(np.int16)


def media_pcm(df: DataFrame, column: str = "media", to: int = 16000, pcm: str = "pcm", error: str = "error") -> DataFrame:
    """Adds a 16-bit WAVE file at the asked rate, and the reason where there is none, to a
    table of stored files: a broken or null file, or one that is not mono."""
    R.prepare(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            files, why = [], []
            for got in expand_all(b.column(at).to_pylist()):
                good = not isinstance(got, str)
                files.append(wave(PCM, resample(got[1], got[0], to).astype("<i2").tobytes(), to) if good else None)
                why.append(None if good else got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary()), pa.array(why, pa.string())], names=[*b.schema.names, pcm, error])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(pcm, BinaryType()), StructField(error, StringType())]))


def pack_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes as mu-law codes of a WAVE file,
    filled with 255 (mu-law silence) to whole units."""
    R.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = R.utf8(b.column(1))
            media = [wave(MULAW, t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests and sound features of stored mu-law files (media) and their resampled PCM
    (pcm), both read by their chunks.

    feature holds, as integers: peak, sum of magnitudes and sign changes of the mu-law
    samples; number and sum of magnitudes of the PCM samples; and what is lost, summed
    over the PCM, when it is coded as A-law and when it is coded as ADPCM, whose blocks
    are decoded together for all files of a batch.
    """
    R.prepare(stored.sparkSession)
    per = 1 + 2 * (ADPCM_BLOCK - 4)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n_bytes, media = b.column(1).to_pylist(), b.column(2).to_pylist()
            data = [parse_wave(m)[3] for m in media]
            raw = np.frombuffer(b"".join(data), np.uint8)
            starts = np.cumsum([0, *(len(d) for d in data[:-1])])
            mu = _MU[raw].astype(np.int32)
            mag = np.abs(mu)
            peak, total = np.maximum.reduceat(mag, starts), np.add.reduceat(mag, starts, dtype=np.int64)
            flips = np.concatenate([[0], (mu[1:] < 0) != (mu[:-1] < 0)]).astype(np.int32)
            flips[starts] = 0
            changes = np.add.reduceat(flips, starts, dtype=np.int64)
            # PCM is never empty: a unit gives UNIT samples times the ratio of the rates
            sound = [np.frombuffer(parse_wave(m)[3], "<i2") for m in b.column(3).to_pylist()]
            sizes = np.array([len(x) for x in sound])
            x = np.concatenate(sound).astype(np.int32)
            starts = np.cumsum(sizes) - sizes
            energy = np.add.reduceat(np.abs(x), starts, dtype=np.int64)
            alaw = np.add.reduceat(np.abs(x - _A[_TO_ALAW[x + 32768]]), starts, dtype=np.int64)
            filled = np.concatenate([np.pad(v, (0, -len(v) % per), mode="edge") for v in sound])
            ends = np.cumsum(-(-sizes // per) * per)
            back = decode_adpcm(encode_adpcm(filled.reshape(-1, per)).reshape(-1)).reshape(-1)
            lost = np.abs(filled.astype(np.int32) - back)
            ima = [int(lost[e - -(-n // per) * per :][:n].sum()) for e, n in zip(ends, sizes)]
            rows = [
                (len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"peak={p};sum={s};flips={c};pcm={n};energy={e};alaw={a};ima={i}")
                for d, m, p, s, c, n, e, a, i in zip(data, media, peak, total, changes, sizes, energy, alaw, ima)
            ]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mu-law files are stored and read back; their PCM, at the rate media_pcm has for
    its own, is made of what was read and goes on to the features whole, in memory."""
    docs = R.spread(R.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return features(media_pcm(R.stored(pack_texts(docs), "media")))
