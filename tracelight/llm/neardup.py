"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles and a MinHash signature.
   Texts with equal sets form one class at once, whatever their number.
2. Signatures are cut into bands; classes that share a band are candidates. In a
   bucket each class is first compared with a leader only (several leader orders,
   taken in turn over the bands), so a bucket of n classes costs n pairs, not n * n.
3. Classes of different components that still share a bucket are then compared with
   one another where they stand, block by block; a pair leaves its task only if nothing
   rules it out, so no link between components can be missed for want of a comparison,
   and no table of all pairs is made.
4. A pair is compared batch by batch of its signatures. It is dropped as soon as
   the posterior probability of a similarity at or above the threshold, given the
   matches so far and a uniform prior, is below MISS; survivors are verified on
   their full shingle sets, in integers.
5. Components of the verified links give every document its smallest doc_id.

With 32 bands of 5 rows a pair at exactly 0.8 escapes all bands with probability
3e-6, at 0.85 with 2e-8. Sets hold 64-bit hashes of shingles; of a minimum the
signature keeps 8 bits, so unlike elements agree once in 256, which can only keep a
pair, never drop one.

Null, empty and blank texts have empty sets and stand alone. Rows without doc_id
take part in no link, have null component_id and are not kept. Rows that repeat a
doc_id with another text are grouped by their texts. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime as R
from .graph import components

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
MISS = 1e-7
LEADER_ORDERS = 6
#: Members of a large bucket per leader, and of a block of a bucket.
GROUP, BLOCK = 16, 512
#: Pairs that a task holds at a time.
PAIRS = 8192
#: Elements per set that the positional bound looks at, and counters of holders.
RARE, SLOTS = 64, 1 << 18
#: Bits of the map of a set's elements that bounds what two sets can have in common.
BITS = 4096
_NO_KEY = np.uint64(2**64 - 1)
#: Rows of (doc_id, digest) that are broadcast at most: about 10 MB.
FEW = 250_000
_MUL = np.random.default_rng(20240101).integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_ADD = np.random.default_rng(20240102).integers(0, 2**32, HASHES, dtype=np.uint32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending; fewer words than n make one shingle."""
    words = text.translate(R.LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    m = len(h) - k + 1
    x = np.full(m, k, np.uint64)
    for j in range(k):
        x = _mix(x ^ h[j : j + m]) + np.uint64(j + 1)
    return np.unique(x)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits, of the sets' hashes cut to 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of signatures (n, HASHES)."""
    x = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for r in range(ROWS):
        h = _mix(h ^ x[:, :, r]) + np.uint64(r)
    return h


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches with which a pair goes on: under a
    uniform prior P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
        out.append(m)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, row, n_shingles, digest (128 bits, of the set), bands and sig (8
    bits a minimum); digest, bands and sig are null for empty sets."""
    names = ["doc_id", "text_hash", "row", "n_shingles", "digest", "bands", "sig"]

    def run(batches):
        seen = {}
        for b in batches:
            n, digests, lows, at = [], [], [], []
            for t in R.utf8(b.column(3)):
                s = shingles(t, words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    if (low := seen.get(digests[-1])) is None:
                        if len(seen) >= 4096:
                            seen.clear()
                        low = seen[digests[-1]] = signature(s)
                    at.append(len(n) - 1)
                    lows.append(low)
            bands, sigs = [None] * len(n), [None] * len(n)
            if lows:
                low = np.array(lows)
                for k, x, y in zip(at, bands_of(low), (low >> np.uint32(24)).astype(np.uint8)):
                    bands[k], sigs[k] = x.view(np.int64), y.tobytes()
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip((n, digests, bands, sigs), kinds))], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(R.forgetting(lambda: _hashes().clear(), run), "doc_id long, text_hash long, row long, n_shingles long, digest binary, bands array<bigint>, sig binary")


def _surviving(sig_x: np.ndarray, sig_y: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the pairs (i, j) of signatures that no batch rules out."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, at in enumerate(range(0, HASHES, BATCH)):
        x, y = np.ascontiguousarray(sig_x[:, at : at + BATCH]), np.ascontiguousarray(sig_y[:, at : at + BATCH])
        matches = matches + (x[i[alive]] == y[j[alive]]).sum(axis=1)
        keep = matches >= least[k]
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _pruned(pairs: DataFrame, classes: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and signatures do not rule out."""
    small = classes.select("node", "n_shingles", "sig")
    both = pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
    least = least_matches(threshold)

    def run(batches):
        for b in batches:
            every = np.arange(b.num_rows)
            keep = pa.array(_surviving(*(_matrix(b.column(k), np.uint8, HASHES) for k in (2, 3)), every, every, least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _within_reach(rare_x, rare_y, size_x, size_y, percent: int) -> np.ndarray:
    """Whether pairs can hold enough common elements. Up to the smaller of the two lists'
    last keys both sets are known whole; beyond it the smaller rest may be common. Keys
    that agree by chance can only raise the bound."""
    out = np.zeros(len(size_x), bool)
    for at in range(0, len(out), 4096):
        x, y, n, m = (v[at : at + 4096] for v in (rare_x, rare_y, size_x, size_y))
        end = np.minimum(np.where(n <= RARE, _NO_KEY, x[:, -1]), np.where(m <= RARE, _NO_KEY, y[:, -1]))[:, None]
        known = [((v <= end) & (v != _NO_KEY)).sum(axis=1) for v in (x, y)]
        z = np.sort(np.concatenate([x, y], axis=1), axis=1)
        common = ((z[:, 1:] == z[:, :-1]) & (z[:, 1:] <= end) & (z[:, 1:] != _NO_KEY)).sum(axis=1)
        most = common + np.minimum(n - known[0], m - known[1])
        out[at : at + 4096] = most * (100 + percent) >= percent * (n + m)
    return out


def bit_map(s: np.ndarray) -> np.ndarray:
    """BITS bits, those set that an element falls on, as 64-bit words."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).view(np.uint64)


def _within_maps(map_x, map_y, size_x, size_y, percent: int) -> np.ndarray:
    """Whether pairs can hold enough common elements: a bit that one set alone has stands for
    an element at least that the other does not have."""
    out = np.zeros(len(size_x), bool)
    for at in range(0, len(out), 4096):
        x, y, n, m = (v[at : at + 4096] for v in (map_x, map_y, size_x, size_y))
        most = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        out[at : at + 4096] = most * (100 + percent) >= percent * (n + m)
    return out


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, filled up with the largest long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(column).to_numpy()
    out = np.full((len(n), width), np.iinfo(np.int64).max)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy()
    return out


def _first_met(buckets_x: np.ndarray, buckets_y: np.ndarray, bucket: int) -> np.ndarray:
    """Whether a bucket is the smallest that pairs share; so each pair comes from one."""
    z = np.sort(np.concatenate([buckets_x, buckets_y], axis=1), axis=1)
    return z[np.arange(len(z)), (z[:, 1:] == z[:, :-1]).argmax(axis=1)] == bucket


def _across(open_: DataFrame, classes: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that share a bucket of open_(bucket, node, root)
    and are not ruled out by sizes, signatures, the positional bound or the maps of elements.

    A bucket is cut into blocks of about BLOCK members; a task compares two blocks.
    classes: node, n_shingles, sig, rare, bits."""
    sizes = open_.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    lists = open_.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # BANDS entries at most
    at = open_.join(sizes, "bucket").join(classes.select("node", "n_shingles", "sig", "rare", "bits").join(lists, "node"), "node")
    mine = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))
    at = at.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    at = at.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") < F.col("other")).alias("left"), "node", "root", "n_shingles", "sig", "rare", "buckets", "bits")
    least = least_matches(threshold)

    def pairs(group: pa.Table):
        node, root, size = (group.column(k).to_numpy() for k in (4, 5, 6))
        sig, rare = _matrix(group.column(7), np.uint8, HASHES), _matrix(group.column(8), np.uint64, RARE)
        buckets, bucket = _padded(group.column(9), BANDS), group.column(0)[0].as_py()
        bits = _matrix(group.column(10), np.uint64, BITS // 64)
        if group.column(1)[0].as_py() == group.column(2)[0].as_py():
            left, right = np.arange(len(node)), np.arange(len(node))
        else:
            first = group.column(3).to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
        step = max(1, PAIRS // len(right)) if len(right) else len(left) or 1
        for at in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
            fits = (root[i] != root[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            if len(right) == len(left) and (right == left).all():
                fits &= i < j
            i, j = i[fits], j[fits]
            k = _surviving(sig, sig, i, j, least)
            i, j = i[k], j[k]
            k = _first_met(buckets[i], buckets[j], bucket)
            i, j = i[k], j[k]
            k = _within_reach(rare[i], rare[j], size[i], size[j], percent)
            i, j = i[k], j[k]
            k = _within_maps(bits[i], bits[j], size[i], size[j], percent)
            a, b = node[i[k]], node[j[k]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            key = np.stack([t.column(k).to_numpy() for k in range(3)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for x, y in zip([0, *cut[:-1]], cut):
                yield from pairs(t.slice(x, y - x))
            rest = t.slice(cut[-1]) if len(cut) else t
        if rest is not None:
            yield from pairs(rest)

    dealt = at.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _sets(owners: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, elements (the sorted hashes) of owners(node, doc_id, digest), built again
    from one document of each."""
    named = R.stored(owners.select("doc_id", "digest", "node"), "named", of=(owners,))

    def build(batches):
        done = set()
        for b in batches:
            nodes, sets = [], []
            for t, digest, node in zip(R.utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                # a doc_id may have other texts, and the same text several times
                if node not in done and xxhash.xxh3_128_digest((s := shingles(t, words)).tobytes()) == digest:
                    done.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "elements"])

    # a checked number of ids is sent to the texts; more of them meet the texts in a shuffle
    n = named.count()
    text = docs.join(F.broadcast(named) if n <= FEW else named, "doc_id")
    out = R.stored(text.select("doc_id", "text", "digest", "node").mapInArrow(build, "node long, elements binary"), "sets")
    if out.count() > n:  # rows that repeat doc_id and text lay in several tasks
        once = R.stored(out.dropDuplicates(["node"]), "sets")
        R.discard(out)
        out = once
    R.discard(named)
    return out


def _rare(sets: DataFrame) -> DataFrame:
    """node, rare, bits: the keys of each set's RARE first elements in one order of all shingles,
    those that few of the sets hold first, and the map of all its elements. A key is the number of holders, then bits of the
    element's hash. Holders are counted by slot of SLOTS, so that the counts are a table
    of fixed size; any order keeps the bound exact."""
    spark = sets.sparkSession

    def count(batches):
        held = np.zeros(SLOTS, np.int64)
        for b in batches:
            for e in b.column(0).to_pylist():
                np.add.at(held, np.frombuffer(e, np.uint64) % np.uint64(SLOTS), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["slot", "n"])

    counts = sets.select("elements").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    held = np.zeros(SLOTS, np.int64)
    held[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    sent = spark.sparkContext.broadcast(held.astype(np.int32) if not len(held) or held.max() < 2**31 else held)

    def first(batches):
        for b in batches:
            out, bits = [], []
            for e in b.column(1).to_pylist():
                x = np.frombuffer(e, np.uint64)
                bits.append(bit_map(x).tobytes())
                n = np.minimum(sent.value[x % np.uint64(SLOTS)], (1 << 23) - 1).astype(np.uint64)
                key = np.sort((n << np.uint64(40)) | (x >> np.uint64(24)))[:RARE]
                out.append(np.pad(key, (0, RARE - len(key)), constant_values=_NO_KEY).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(bits, pa.binary())], names=["node", "rare", "bits"])

    return sets.select("node", "elements").mapInArrow(first, "node long, rare binary, bits binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def compare(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return R.stored(both.mapInArrow(compare, "a long, b long"), "links", of=(pairs, sets))


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, digest) and the classes (digest,
    component_id) whose rows may belong to another document than themselves."""
    spark = docs.sparkSession
    R.prepare(spark)
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = R.stored(signatures(R.spread(docs), words), "signatures")
    # one row per class; copies meet where they are before anything is moved
    classes = sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = R.stored(classes, "classes", of=(sigs,))
    rows = R.stored(sigs.select("doc_id", "text_hash", "n_shingles", "digest"), "rows", of=(sigs,))
    R.discard(sigs)
    bands = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = R.stored(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets", of=(classes,))
    # large buckets fall into random groups, others in every band, and each group has a leader
    group = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / GROUP)).alias("group")
    members = R.stored(bands.join(shared, "bucket").select("bucket", group, (F.col("band") % LEADER_ORDERS).alias("part"), "node"), "members", of=(classes,))
    R.discard(shared)
    # from here on only classes that share a bucket
    met = members.select("node").distinct()
    near = R.stored(classes.select("node", "doc_id", "digest", "n_shingles", "sig").join(met, "node", "left_semi"), "near", of=(classes,))
    owners = R.stored(classes.select("node", "digest", "doc_id", "copies"), "owners", of=(classes,))
    R.discard(classes)
    sets = _sets(near, docs, words)
    lead = members.groupBy("bucket", "group").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("node"))).alias("lead"))
    first = members.join(lead, ["bucket", "group"]).where("node <> lead.node").groupBy("node", "part").agg(F.min("lead").alias("lead"))
    first = first.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    tried = R.stored(_pruned(first, near, threshold, percent), "pairs", of=(near, members))
    links = _verified(tried, sets, percent)
    R.discard(tried)
    roots = components(links)
    # buckets in which several components remain: all pairs across components
    at = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = at.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    at = R.stored(at.join(several, "bucket", "left_semi"), "open", of=(members,))
    R.discard(members)
    if at.head(1):
        looked = at.select("node").distinct()
        rare = R.stored(near.join(_rare(sets.join(looked, "node", "left_semi")), "node").select("node", "n_shingles", "sig", "rare", "bits"), "rare", of=(near, sets))
        tried = R.stored(_across(at, rare, threshold, percent), "pairs")
        more = _verified(tried, sets, percent)
        if more.head(1):
            again = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
            R.discard(roots)
            roots = again
        for x in (rare, tried, more):
            R.discard(x)
    for x in (at, sets, near, links):
        R.discard(x)
    # class to smallest doc_id of its component; a class of one document in no other's component needs no entry
    rooted = owners.join(roots, "node", "left").select("digest", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").where("copies > 1 or doc_id <> component_id").select("digest", "component_id")
    named = R.stored(named, "named", of=(owners,))
    R.discard(owners)
    R.discard(roots)
    return rows, named


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, named = _grouped(docs, words, percent)
    out = rows.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of every near-duplicate group: of the smallest doc_id, and if
    that has several texts in the group, of the one with the smallest hash. Rows without
    doc_id or without words belong to no group and stay; other rows that repeat doc_id
    and text are one document, of which one row stays."""
    rows, named = _grouped(docs, words, percent)
    own = rows.where("doc_id is not null and digest is not null").join(named, "digest", "left").select("doc_id", "text_hash", F.coalesce("component_id", "doc_id").alias("component_id"))
    gone = R.stored(own.where("doc_id <> component_id").select("doc_id", "text_hash").distinct(), "gone", of=(rows, named))
    # only rows that repeat a doc_id can leave two heads to a group; hot ids are combined before they are moved
    heads = own.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash")).where("n > 1")
    heads = R.stored(heads.select("doc_id", "text_hash"), "heads", of=(rows, named))
    R.discard(rows)
    key = F.xxhash64(F.col("text").cast("string"))
    sent = lambda df: F.broadcast(df) if df.count() <= FEW else df
    names = ["_doc", "_hash"]
    on = lambda df, c: (F.col("doc_id").cast("long") == df["_doc"]) & (c == df["_hash"])
    left = gone.toDF(*names)
    out = docs.join(sent(left), on(left, key), "left_anti")
    if heads.head(1):
        blank = F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\v\f\r", "     ")) == ""
        ids = heads.select(F.col("doc_id").alias("_doc"))
        twice = out.where(~blank).join(sent(ids), F.col("doc_id").cast("long") == ids["_doc"], "left_semi")
        chosen = heads.toDF(*names)
        best = twice.join(sent(chosen), on(chosen, key), "left_semi").dropDuplicates(["doc_id"])
        rest = out.where(blank).unionByName(out.where(~blank).join(sent(ids), F.col("doc_id").cast("long") == ids["_doc"], "left_anti"))
        out = rest.unionByName(best)
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(R.table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM s GROUP BY doc_id),
r AS (SELECT class, min(doc_id) AS rep, min(n) AS n FROM n GROUP BY class),
t AS (SELECT r.rep, r.n, s.g FROM r JOIN s ON s.doc_id = r.rep),
f AS (SELECT g, count(*) AS c FROM t GROUP BY g HAVING count(*) > 1),
o AS (SELECT t.rep, t.n, t.g, row_number() OVER (PARTITION BY t.rep ORDER BY f.c, t.g) AS k, count(*) OVER (PARTITION BY t.rep) AS shared FROM t JOIN f USING (g)),
p AS (SELECT rep, n, g FROM o WHERE k <= shared - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT c.x, c.y FROM c JOIN t a ON a.rep = c.x JOIN t b ON b.rep = c.y AND a.g = b.g GROUP BY c.x, c.y, c.nx, c.ny HAVING 100 * count(*) >= 80 * (c.nx + c.ny - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.b),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id, coalesce(comp.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.class = n.class LEFT JOIN comp ON comp.rep = r.rep
"""
