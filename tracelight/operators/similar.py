"""Lines that resemble lines by AI, in files of any length.

The most similar of m lines is looked for among n others in blocks: CHUNK lines against
BLOCK others make a row of a table, dealt over all tasks, and the best of a line's blocks is
kept. Within a block lengths and bags of signs bound a similarity before it is computed.
A file of fewer lines is one such row: files_analysis() leaves it where it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.text import lines, strip, strip_end
from ..schemas import AI, AI_MODIFIED, HUMAN, ORIGINAL
from .attribution import THRESHOLD, Options, by_content, split_lines
from .tables import Scratch

CHUNK, BLOCK = 1_000, 10_000
#: What strip() and strip_end() remove; str.strip() alone removes four signs more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FOUND = "line_number long, text string, similarity double, edit_no long, at long, edit_id string, prompt_index long"
_ROW = [("line_number", "bigint", pa.int64()), ("content", "string", pa.string()), ("source_type", "string", pa.string()), ("edit_id", "string", pa.string()), ("prompt_index", "bigint", pa.int64()), ("similarity", "double", pa.float64()), ("confidence", "double", pa.float64())]


def ai_lines(edits: DataFrame, by: list[str]) -> DataFrame:
    """edits(by, edit_no, edit_id, prompt_index, text): the lines that are not blank, each
    once, with the last edit that wrote it and its last place there."""
    rows = edits.select(*by, F.col("edit_no").cast("long").alias("edit_no"), "edit_id", "prompt_index", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    last = F.struct("edit_no", "at")
    out = rows.where(strip(F.col("line")) != "").groupBy(*by, strip_end(F.col("line")).alias("key")).agg(F.max(last).alias("last"), F.max_by(F.struct("edit_id", "prompt_index"), last).alias("who"))
    return out.select(*by, "key", "last.edit_no", F.col("last.at").cast("long").alias("at"), "who.edit_id", "who.prompt_index")


def similar_lines(unmatched: DataFrame, options: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """unmatched(by, line_number, content), options as of ai_lines(): per line that has one
    the most similar option at the threshold or above, with the line's text without white space
    around it, as files of one name may differ there. Ties go to the latest edit, then to the
    earliest line. Blank lines have none."""
    todo = unmatched.where(strip(F.col("content")) != "").withColumn("chunk", F.floor(F.col("line_number") / CHUNK))
    chunks = todo.groupBy(*by, "chunk").agg(F.collect_list(F.struct("line_number", strip(F.col("content")).alias("text"))).alias("asked"))
    # only files in which something is asked for, and blocks by how many options a file has
    own = options.join(todo.select(*by).distinct(), by, "left_semi")
    n = own.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = own.join(n, by).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    blocks = own.groupBy(*by, "block").agg(F.collect_list(F.struct("edit_no", "at", strip(F.col("key")).alias("text"), "edit_id", "prompt_index")).alias("options"))
    rows = chunks.join(blocks, by).select(*by, "asked", "options", F.xxhash64(*by, "chunk", "block").alias("_deal"))
    rows = rows.repartition("_deal").drop("_deal")  # a large file is many rows
    keys = len(by)

    def run(batches):
        for b in batches:
            at, found = [], []
            for k, (asked, offered) in enumerate(zip(b.column(keys).to_pylist(), b.column(keys + 1).to_pylist())):
                offered.sort(key=lambda o: (-o["edit_no"], o["at"]))
                some = Options([(o["text"], (o["edit_no"], o["at"], o["edit_id"], o["prompt_index"])) for o in offered])
                for a in asked:
                    near, who = some.best(a["text"], threshold)
                    if near is not None:
                        at.append(k)
                        found.append((a["line_number"], a["text"], near, *who))
            cols = list(zip(*found)) if found else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in range(keys)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*by, "line_number", "text", "similarity", "edit_no", "at", "edit_id", "prompt_index"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    each = rows.mapInArrow(run, f"{fields}, {_FOUND}")
    best = F.max_by(F.struct("similarity", "edit_id", "prompt_index"), F.struct("similarity", "edit_no", -F.col("at"))).alias("b")
    return each.groupBy(*by, "line_number", "text").agg(best).select(*by, "line_number", "text", "b.similarity", "b.edit_id", "b.prompt_index")


def set_analysis(originals: DataFrame, edits: DataFrame, finals: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Attribution by content alone: a final line is Original, AI, AIModified if it resembles
    a line by AI, or Human; with similarity and confidence. Tables as of by_content()."""
    rows = Scratch(finals.sparkSession, "analysis").write(by_content(originals, edits, finals, by))  # read by four that follow
    kind = F.col("source_type")
    done = rows.where(kind != "Unmatched").withColumn("similarity", F.lit(None).cast("double")).withColumn("confidence", F.lit(1.0))
    rest = rows.where(kind == "Unmatched").drop("source_type", "edit_id", "prompt_index").withColumn("text", strip(F.col("content")))
    near = similar_lines(rest.drop("text"), ai_lines(edits, by), by, threshold)
    found = F.col("similarity").isNotNull()
    rest = rest.join(near, [*by, "line_number", "text"], "left").withColumn("source_type", F.when(found, AI_MODIFIED).otherwise(HUMAN)).withColumn("confidence", F.coalesce("similarity", F.lit(0.9)))
    columns = [*by, *(n for n, _, _ in _ROW)]
    return done.select(columns).unionByName(rest.select(columns))


def analyse(original: str, edits: list[dict], final: str, threshold: float = THRESHOLD) -> list[tuple]:
    """set_analysis() of one file: a row per final line."""
    known = {s.rstrip(WHITE) for s in split_lines(original)}
    owner: dict[str, tuple] = {}
    for e in sorted(edits, key=lambda e: [(v is not None, v) for v in (e["edit_no"], e["edit_id"], e["prompt_index"])]):
        for at, s in enumerate(split_lines(e["text"] or "")):
            owner[s.rstrip(WHITE)] = (e["edit_no"], at, e["edit_id"], e["prompt_index"])
    options, asked = None, {}
    out = []
    for k, s in enumerate(split_lines(final), 1):
        key, text = s.rstrip(WHITE), s.strip(WHITE)
        if key in known:
            out.append((k, s, ORIGINAL, None, None, None, 1.0))
        elif key in owner:
            out.append((k, s, AI, *owner[key][2:], None, 1.0))
        else:
            if text and text not in asked:
                if options is None:
                    options = Options([(t.strip(WHITE), owner[t]) for t in sorted(owner, key=lambda t: (-owner[t][0], owner[t][1])) if t])
                asked[text] = options.best(text, threshold)
            near, who = asked.get(text, (None, None))
            out.append((k, s, HUMAN, None, None, None, 0.9) if near is None else (k, s, AI_MODIFIED, *who[2:], near, near))
    return out


def _whole(files: DataFrame, by: list[str], threshold: float, parts: int | None) -> DataFrame:
    """Files that are analysed where they stand."""
    schema = StructType([*files.select(*by).schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in _ROW)).fields])
    n_keys = len(by)

    def run(batches):
        for b in batches:
            sizes, cols = [], [[] for _ in _ROW]
            nameless = [any(v is None for v in row) for row in zip(*(b.column(k).to_pylist() for k in range(n_keys)))]
            for null, original, edits, final in zip(nameless, *(b.column(n_keys + k).to_pylist() for k in range(3))):
                # a null in a key equals nothing, as in joins
                got = analyse("" if null else original or "", [] if null else edits or [], final or "", threshold)
                sizes.append(len(got))
                for c, values in zip(cols, zip(*got)):
                    c.extend(values)
            at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(n_keys)), *(pa.array(c, t) for c, (_, _, t) in zip(cols, _ROW))], names=schema.names)

    files = files.select(*by, "original", "edits", "final")
    return (files.repartition(parts) if parts else files).mapInArrow(run, schema)


def files_analysis(files: DataFrame, by: list[str], threshold: float = THRESHOLD, parts: int | None = None) -> DataFrame:
    """files(by, original, edits array<struct<edit_no, edit_id, prompt_index, text>>, final): as
    set_analysis(), whose tables would move each text several times. Here only the lines of files
    that are beyond a block or stand in several rows are moved. parts: the other files are dealt
    out in so many first, for a small table that is read in few."""
    ends = lambda text: F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))
    long_ = (ends(F.col("final")) >= CHUNK) | (F.coalesce(F.aggregate("edits", F.lit(0), lambda n, e: n + ends(e["text"]) + 1), F.lit(0)) > BLOCK)
    sized = files.select(*by, long_.alias("_long")).groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("_long").alias("_long"))
    apart = Scratch(files.sparkSession, "apart").write(sized.where("n > 1 or _long").select(*by))
    if apart.isEmpty():
        return _whole(files, by, threshold, parts)
    whole = _whole(files.join(apart, by, "left_anti"), by, threshold, parts)
    rest = files.join(apart, by, "left_semi")
    tables = rest.select(*by, F.col("original").alias("text")), rest.select(*by, F.inline("edits")), rest.select(*by, F.col("final").alias("text"))
    return whole.unionByName(set_analysis(*tables, by, threshold))
