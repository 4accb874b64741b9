"""Language-model scores by a probabilistic suffix tree.

The symbols are bytes. A text is its lower-cased words, each closed by a blank, and a
line feed as end; before it stand DEPTH start marks (255, which no UTF-8 holds). The
context of a symbol is the up to DEPTH symbols before it, over word borders and all. A
context is a state of the tree if it occurs at least LEAST times and a likelihood-ratio
test finds its next-symbol distribution to diverge from that of its longest proper
suffix. Distributions are smoothed towards the next shorter state (Witten-Bell), the
root's towards all bytes. A symbol is scored in the longest state that is a suffix of
what came before.

A context and the symbol after it are one integer, the symbol in the lowest byte, so
that the next shorter context is that integer without its highest byte. Tasks count these
integers by sorting; the tree is made of tables, one a length, each tested and smoothed
by a join with the next shorter one. It grows with the corpus and is never collected.
Words, for the base score, are a table likewise. While the texts are read, the most
frequent integers (HOT at most) and words are looked up in broadcast tables; what is
left, rare by choice, meets the tables in a shuffle.

Null and empty texts are the end alone. Repeated rows are scored one by one; rows
without doc_id count as id ''. Extra columns are ignored. Without training texts every
count is 0, and the tree gives each byte 1 in 256.
"""

from __future__ import annotations

import functools
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import runtime as R

#: Symbols of context; 7 at most, as a context and its symbol are 8 bytes.
DEPTH = 5
#: Occurrences from which the chi-squared bound of the test is commonly taken to hold.
LEAST = 5
#: Contexts with symbols that are broadcast at most: 16 MB.
HOT = 1 << 20
#: Share of all tokens from which a word is broadcast; 2^20 words can have it.
HOT_WORD = 2.0**-20
ALPHABET = 256
START = b"\xff" * DEPTH
#: Distinct words, and distinct integers, that a task counts before it hands them on.
HELD, HELD_GRAMS = 200_000, 1 << 21


def words_of(text: bytes) -> list[bytes]:
    return text.translate(R.LOWER_BYTES).split()


def spelled(words: list[bytes]) -> bytes:
    """The symbols of a text, start marks included."""
    return START + b" ".join([*words, b"\n"])


def grams(spelt: list[bytes], step: int = 1 << 20):
    """(context and symbol as one integer, number of the text) for all symbols of texts,
    in pieces of bounded size, whatever the length of a text."""
    a = np.frombuffer(b"".join(spelt), np.uint8)
    sizes = np.array([len(s) for s in spelt], np.int64)
    ends = np.cumsum(sizes)
    for at in range(DEPTH, len(a), step):
        w = a[at - DEPTH : at + step]
        n = len(w) - DEPTH
        key = np.zeros(n, np.int64)
        for j in range(DEPTH + 1):
            key = (key << 8) | w[j : j + n]
        first, last = np.searchsorted(ends, (at, at + n - 1), side="right")
        here = np.arange(first, last + 1)
        text = np.repeat(here, np.minimum(ends[here], at + n) - np.maximum(ends[here] - sizes[here], at))
        symbol = w[DEPTH:] != 0xFF
        yield key[symbol], text[symbol]


def trained_on(doc_id):
    return R.crc_mod(doc_id, 5) != 1


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    if not len(keys):
        return keys, *counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[at], first) for c in counts)


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n_train, n_all: every context of DEPTH symbols with the symbol after it."""

    def run(batches):
        pending, n_pending = [], 0

        def merged():
            return _summed(*(np.concatenate(x) for x in zip(*pending)))

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["gram", "n_train", "n_all"])

        for b in batches:
            spelt = [spelled(words_of(t)) for t in R.utf8(b.column(0))]
            learn = np.array(b.column(1).to_pylist(), bool)
            for key, text in grams(spelt):
                own = learn[text]
                for of, part in ((1, key[own]), (0, key[~own])):
                    k, n = np.unique(part, return_counts=True)
                    pending.append((k, n * of, n))
                    n_pending += len(k)
                if n_pending > 2 * HELD_GRAMS:
                    held = merged()
                    pending, n_pending = [held], len(held[0])
                    if n_pending > HELD_GRAMS:
                        yield out(held)
                        pending, n_pending = [], 0
        if pending:
            yield out(merged())

    found = docs.select("text", "train").mapInArrow(run, "gram long, n_train long, n_all long")
    return found.groupBy("gram").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8, the end token empty), n_all, n_train: all words of all texts."""

    def run(batches):
        every, train = Counter(), Counter()

        def out():
            words = list(every)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "n_all": pa.array([every[w] for w in words], pa.int64()), "n_train": pa.array([train[w] for w in words], pa.int64())})
            every.clear()
            train.clear()

        for b in batches:
            for text, learn in zip(R.utf8(b.column(0)), b.column(1).to_pylist()):
                words = words_of(text)
                words.append(b"")
                every.update(words)
                if learn:
                    train.update(words)
                if len(every) > HELD:
                    yield from out()
        yield from out()

    found = docs.select("text", "train").mapInArrow(run, "word binary, n_all long, n_train long")
    return found.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def learn(counted: DataFrame) -> DataFrame:
    """gram, n_all, log_p (log10) for the grams of a table of gram, n_train, n_all. Only
    the root's sums are collected."""
    # from long to short: what a context's suffix counts is the sum over the contexts that end in it
    tables = [counted.select("gram", F.col("n_train").alias("n"), "n_all")]
    for size in range(DEPTH - 1, -1, -1):
        shorter = tables[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (size + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        tables.append(R.stored(shorter, f"grams-{size}"))
    root = tables.pop()
    total, kinds = root.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    p = (F.col("n") + kinds / ALPHABET) / F.lit(float(total + kinds)) if total else F.lit(1 / ALPHABET)
    level = root.select("gram", "n", F.lit(int(total)).cast("long").alias("total"), p.alias("p"))
    whole = Window.partitionBy("context")
    used = [root]
    for size in range(1, DEPTH + 1):
        table = tables.pop()
        up = level.select(F.col("gram").alias("suffix"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("p").alias("up_p"))
        here = table.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))).join(up, "suffix").withColumn("context", F.shiftright("gram", 8))
        apart = F.when(F.col("n") > 0, F.col("n") * (F.log("n") - F.log("up_n") + F.log("up_total"))).otherwise(0.0)
        of = [c for c in table.columns if c != "n"]
        here = here.select(*of, "n", "up_p", F.sum("n").over(whole).alias("total"), F.count_if(F.col("n") > 0).over(whole).alias("kinds"), F.sum(apart).over(whole).alias("apart"))
        gain = F.col("apart") - F.col("total") * F.log("total")
        state = (F.col("total") >= LEAST) & (2 * gain > F.col("kinds") * F.log(F.col("total") + 1))
        p = F.when(state, (F.col("n") + F.col("kinds") * F.col("up_p")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("up_p"))
        if size < DEPTH:
            level = R.stored(here.select("gram", "n", "total", p.alias("p")), f"contexts-{size}")
            used += [table, level]
        else:
            level = R.stored(here.select("gram", "n_all", F.log10(p).alias("log_p")), "contexts")
    for x in used:
        R.discard(x)
    return level


class Lookup:
    """Values of 64-bit keys by two hash tables without chains; the few keys that find
    no place in either are not held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.tables = []
        for seed, bits in ((0x9E3779B97F4A7C15, bits), (0xC2B2AE3D27D4EB4F, max(4, bits - 2))):
            k, v = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
            at = self._slot(keys, seed, bits)
            k[at], v[at] = keys, values
            mine = k[at] == keys
            v[at[mine]] = values[mine]
            keys, values = keys[~mine], values[~mine]
            self.tables.append((seed, bits, k, v))

    @staticmethod
    def _slot(keys, seed, bits):
        return ((keys.astype(np.uint64) * np.uint64(seed)) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; NaN for those not held."""
        out = np.full(len(keys), np.nan)
        rest = slice(None)
        for seed, bits, k, v in self.tables:
            ask = keys[rest]
            at = self._slot(ask, seed, bits)
            got = np.where(k[at] == ask, v[at], np.nan)
            out[rest] = got
            rest = np.flatnonzero(np.isnan(out))
        return out


@functools.lru_cache(maxsize=1)
def _lookup(sent) -> Lookup:
    keys, values = sent.value
    return Lookup(np.frombuffer(keys, np.int64), np.frombuffer(values, np.float64))


def _most_frequent(tree: DataFrame) -> tuple[bytes, bytes]:
    """Keys and values of the grams above the least power of two that HOT or fewer reach."""
    size = F.floor(F.log2("n_all") + 1e-9).cast("int")
    held, least = 0, None
    for r in sorted(tree.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 64 rows at most
        held += r.n
        if held > HOT:
            break
        least = r["size"]
    if least is None:
        return b"", b""
    t = tree.where(size >= least).select("gram", "log_p").toArrow()  # HOT rows at most
    return t["gram"].to_numpy().tobytes(), t["log_p"].to_numpy().tobytes()


def score(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    spark = docs.sparkSession
    R.prepare(spark)
    docs = R.spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    docs = docs.withColumn("train", trained_on(F.col("doc_id")))
    counted = R.stored(gram_counts(docs), "gram-counts")
    tree = learn(counted)
    R.discard(counted)
    words = R.stored(word_counts(docs), "words")
    n_all, n, v = words.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    base = F.log10((F.col("n_train") + 0.5) / F.lit(float(n + 0.5 * (v + 1))))
    words = words.select("word", "n_all", (F.col("n_train") > 0).cast("long").alias("known"), base.alias("log_base"))
    top = words.where(F.col("n_all") >= HOT_WORD * n_all).toArrow()  # 1 / HOT_WORD rows at most
    hot_words = spark.sparkContext.broadcast(({w: k for k, w in enumerate(top["word"].to_pylist())}, top["known"].to_numpy(), top["log_base"].to_numpy()))
    hot_grams = spark.sparkContext.broadcast(_most_frequent(tree))

    def read(batches):
        names = ["row", "doc_id", "train", "n_tokens", "known", "base", "tree", "words", "grams", "times"]
        numbers, known_of, base_of = hot_words.value
        held = _lookup(hot_grams)
        for b in batches:
            if not b.num_rows:
                continue
            n_tokens, known, bases, rest, spelt = [], [], [], [], []
            for text in R.utf8(b.column(3)):
                words = words_of(text)
                spelt.append(spelled(words))
                words.append(b"")
                at = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
                hot = at[at >= 0]
                n_tokens.append(len(words))
                known.append(int(known_of[hot].sum()))
                bases.append(float(base_of[hot].sum()))
                rest.append([words[k] for k in np.flatnonzero(at < 0)])
            trees, left = np.zeros(len(spelt)), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for key, text in grams(spelt):
                log_p = held.get(key)
                cold = np.isnan(log_p)
                trees += np.bincount(text, np.where(cold, 0.0, log_p), len(spelt))
                left.append((text[cold], key[cold]))
            t, k = (np.concatenate(x) for x in zip(*left))
            order = np.lexsort((k, t))
            t, k = t[order], k[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])) if len(k) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(k)))
            cuts = pa.array(np.searchsorted(t[first], np.arange(len(spelt) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                *b.columns[:3], pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(bases), pa.array(trees), pa.array(rest, pa.list_(pa.binary())),
                pa.ListArray.from_arrays(cuts, pa.array(k[first])), pa.ListArray.from_arrays(cuts, pa.array(times)),
            ], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", "text")
    schema = "row long, doc_id long, train boolean, n_tokens long, known long, base double, tree double, words array<binary>, grams array<bigint>, times array<bigint>"
    part = R.stored(rows.mapInArrow(read, schema), "read")
    # what is left is rare in any table, so no key of these joins is heavy
    of_words = part.select("row", F.explode("words").alias("word")).join(words, "word").groupBy("row").agg(F.sum("known").alias("known"), F.sum("log_base").alias("base"), F.lit(0.0).alias("tree"))
    of_grams = part.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times")).join(tree.select("gram", "log_p"), "gram")
    of_grams = of_grams.groupBy("row").agg(F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.sum(F.col("times") * F.col("log_p")).alias("tree"))
    left = R.stored(of_words.unionByName(of_grams), "rest")
    out = part.select("row", "doc_id", "train", "n_tokens", "known", "base", "tree").unionByName(left.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(0).cast("long").alias("n_tokens"), "known", "base", "tree"))
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "tree")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("tree").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(R.table(spark, sf_dir, "documents"))
