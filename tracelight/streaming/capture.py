"""Capture as a stateful stream: edits are held per repository until a commit takes
the files that it changed.

The stream is a union of edits, commits and clearings, ordered by seq within a
repository. What is pending is kept as state of its own parts: the session, a map of prompts, a
map of files and a map of edits by file, so that an edit reads and writes its own entries
alone, whatever else is pending. Nothing is evicted by age; age is only reported. Prompts
are redacted, in columns, before they come near the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.redaction import Redactor, redact
from ..operators import history as HI

#: kind 'edit': file_path, prompt, old_content (null: none was given, unless old_content_present), new_content,
#: plan_mode, agent_depth; kind 'commit': commit_id, changed paths, renames of old paths to new ones; kind 'clear'.
EVENT = (
    "repo string, seq bigint, kind string, session_id string, session_explicit boolean, file_path string, prompt string, old_content string, old_content_present boolean, new_content string, "
    "timestamp string, plan_mode boolean, agent_depth bigint, commit_id string, changed array<string>, renames map<string,string>"
)
#: An edit that a commit took, under its path in the commit, or that a new session discarded.
OUT = (
    "repo string, commit_id string, session_id string, path string, committed_path string, edit_no bigint, edit_id string, prompt_index bigint, prompt string, before string, after string, "
    "was_new_file boolean, plan_mode boolean, agent_depth bigint, discarded boolean"
)
_OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: The parts of the state: keys, then values.
STATE = {
    "session": (None, "session_id string, started_at string, next_prompt bigint, last_prompt bigint"),
    "prompts": ("prompt_index bigint", "text string, timestamp string, affected_files string, redactions bigint"),
    "files": ("path string", "edits bigint, lines bigint, original string, was_new boolean"),
    "edits": ("path string, edit_no bigint", "edit_id string, prompt_index bigint, after string, plan_mode boolean, agent_depth bigint"),
}
#: Events that the processor works on, as they leave `prepared`.
_PREPARED = "repo string, seq bigint, kind string, session_id string, session_explicit boolean, file_path string, prompt string, redactions bigint, old string, new string, edit_id string, timestamp string, plan_mode boolean, agent_depth bigint, commit_id string, changed string, renames string"
_NAMES = [c.split()[0] for c in _PREPARED.split(", ")]
_WHOLE, _FLAGS = ({n for n, kind in (c.split() for c in _PREPARED.split(", ")) if kind == k} for k in ("bigint", "boolean"))


def prepared(events: DataFrame, redactor: Redactor | None = None, head: DataFrame | None = None) -> DataFrame:
    """EVENT rows with prompts redacted, ids for edits, and the content that an edit
    started from: the one given, or else the committed one of head(repo, path, content), or null.
    Columns only, for streams and tables alike."""
    out = redact(events, "prompt", redactor or Redactor())
    given = F.when(F.col("old_content_present"), F.coalesce("old_content", F.lit(""))).otherwise(F.col("old_content"))
    if head is not None:
        out = out.join(head.select("repo", F.col("path").alias("file_path"), F.col("content").alias("_head")), ["repo", "file_path"], "left")
        given = F.coalesce(given, F.col("_head"))
    paths = lambda c: F.to_json(c)
    out = out.withColumns({
        "prompt": F.coalesce("redacted", F.lit("")), "redactions": F.coalesce(F.size("events"), F.lit(0)).cast("long"), "old": given, "new": F.coalesce("new_content", F.lit("")),
        "edit_id": HI.edit_id(F.col("repo"), F.coalesce("file_path", F.lit("")), F.col("seq").cast("string")), "changed": paths(F.col("changed")), "renames": paths(F.col("renames")),
    })
    return out.select(*_NAMES)


class Pending:
    """The state of one repository as plain dictionaries, for replays."""

    def __init__(self):
        self.session: tuple | None = None
        self.parts: dict[str, dict] = {"prompts": {}, "files": {}, "edits": {}}

    def get(self, part: str, key: tuple) -> tuple | None:
        return self.parts[part].get(key)

    def put(self, part: str, key: tuple, value: tuple) -> None:
        self.parts[part][key] = value

    def remove(self, part: str, key: tuple) -> None:
        del self.parts[part][key]

    def keys(self, part: str) -> list[tuple]:
        return sorted(self.parts[part])

    def clear(self) -> None:
        self.__init__()


class Kept:
    """The same over the maps of a stateful processor."""

    def __init__(self, handle):
        self.value = handle.getValueState("session", STATE["session"][1])
        self.maps = {p: handle.getMapState(p, *STATE[p]) for p in ("prompts", "files", "edits")}

    @property
    def session(self) -> tuple | None:
        return tuple(self.value.get()) if self.value.exists() else None

    @session.setter
    def session(self, now: tuple) -> None:
        self.value.update(now)

    def get(self, part: str, key: tuple) -> tuple | None:
        m = self.maps[part]
        return tuple(m.getValue(key)) if m.containsKey(key) else None

    def put(self, part: str, key: tuple, value: tuple) -> None:
        self.maps[part].updateValue(key, value)

    def remove(self, part: str, key: tuple) -> None:
        self.maps[part].removeKey(key)

    def keys(self, part: str) -> list[tuple]:
        m = self.maps[part]
        return sorted(map(tuple, m.keys())) if m.exists() else []

    def clear(self) -> None:
        self.value.clear()
        for m in self.maps.values():
            m.clear()


def _taken(state, repo: str, path: str, commit_id: str | None, committed: str | None) -> Iterator[tuple]:
    """A file's edits, which leave the state."""
    count, _, original, was_new = state.get("files", (path,))
    before, session_id = original, state.session[0]
    for n in range(1, count + 1):
        edit_id, index, after, plan, depth = state.get("edits", (path, n))
        yield repo, commit_id, session_id, path, committed, n, edit_id, index, state.get("prompts", (index,))[0], before, after, was_new, plan, depth, commit_id is None
        state.remove("edits", (path, n))
        before = after
    state.remove("files", (path,))


def _committed(state, repo: str, row: dict) -> Iterator[tuple]:
    """What a commit takes: files that it changed, under the name that it gives them. A
    rename counts if either of its names changed. Prompts of files that stay do so as
    well, and numbers go on after the largest of them; without any, the session is over."""
    changed, renames = set(json.loads(row["changed"] or "[]")), json.loads(row["renames"] or "{}")
    kept = False
    for (path,) in state.keys("files"):
        moved = renames.get(path)
        if moved is not None and (moved in changed or path in changed):
            yield from _taken(state, repo, path, row["commit_id"], moved)
        elif path in changed:
            yield from _taken(state, repo, path, row["commit_id"], path)
        else:
            kept = True
    if not kept:
        state.clear()
        return
    used = {state.get("edits", key)[1] for key in state.keys("edits")}
    for key in state.keys("prompts"):
        if key[0] not in used:
            state.remove("prompts", key)
    state.session = (*state.session[:2], max(used) + 1, max(used))


def _lines(text: str) -> int:
    return len(text.splitlines()) if text.isascii() else text.count("\n") + (not text.endswith("\n"))


def _edited(state, row: dict) -> None:
    path, session = row["file_path"], state.session
    if session is None:
        session = (row["session_id"], row["timestamp"], 0, None)
    _, _, following, last = session
    known = None if last is None else state.get("prompts", (last,))
    if known is not None and known[0] == row["prompt"]:
        files = json.loads(known[2])
        state.put("prompts", (last,), (known[0], known[1], json.dumps(files if path in files else [*files, path]), known[3] + row["redactions"]))
    else:
        last, following = following, following + 1
        state.put("prompts", (last,), (row["prompt"], row["timestamp"], json.dumps([path]), row["redactions"]))
    state.session = (*session[:2], following, last)
    count, gained, original, was_new = state.get("files", (path,)) or (0, 0, row["old"] or "", row["old"] is None)
    before = original if not count else state.get("edits", (path, count))[2]
    state.put("edits", (path, count + 1), (row["edit_id"], last, row["new"], bool(row["plan_mode"]), row["agent_depth"] or 0))
    state.put("files", (path,), (count + 1, gained + max(_lines(row["new"]) - _lines(before), 0), original, was_new))


def step(state, repo: str, row: dict) -> Iterator[tuple]:
    """One event. An explicit session that differs drops what is pending, as discarded."""
    if row["kind"] == "clear":
        state.clear()
    elif row["kind"] == "commit":
        if state.session is not None:
            yield from _committed(state, repo, row)
    else:
        if state.session is not None and row["session_explicit"] and row["session_id"] != state.session[0]:
            for (path,) in state.keys("files"):
                yield from _taken(state, repo, path, None, None)
            state.clear()
        _edited(state, row)


def replay(rows: Iterable[dict], repo: str, state: Pending | None = None) -> tuple[list[tuple], Pending]:
    """Prepared events of one repository in seq order: what they emit and what stays."""
    state = state or Pending()
    return [out for row in rows for out in step(state, repo, row)], state


def _clean(pdf: pd.DataFrame) -> list[dict]:
    """Rows without pandas' ways to write a null, and with whole numbers as such."""
    value = lambda k, v: None if v is None or v is pd.NA or v != v else int(v) if k in _WHOLE else bool(v) if k in _FLAGS else v
    return [{k: value(k, v) for k, v in r.items()} for r in pdf.to_dict("records")]


class Capture(StatefulProcessor):
    """A micro-batch of several Arrow batches for one repository goes through a map of
    the state store, by seq, so that no more than one batch is held by the worker."""

    def init(self, handle) -> None:
        self.state = Kept(handle)
        self.inbox = handle.getMapState("inbox", "seq bigint", _PREPARED)

    def handleInputRows(self, key, rows, timerValues):
        first, more = next(rows), next(rows, None)
        if more is None:
            yield from self._out(key[0], sorted(_clean(first), key=lambda r: r["seq"]))
            return
        places = []
        for pdf in (p for part in ([first, more], rows) for p in part):
            for r in _clean(pdf):
                places.append(int(r["seq"]))
                self.inbox.updateValue((int(r["seq"]),), tuple(r[n] for n in _NAMES))
        yield from self._out(key[0], (dict(zip(_NAMES, self.inbox.getValue((at,)))) for at in sorted(set(places))))
        self.inbox.clear()

    def _out(self, repo: str, rows: Iterable[dict]):
        out = []
        for row in rows:
            out += step(self.state, repo, row)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=_OUT_NAMES)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_OUT_NAMES)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for part, entry, value in initialState[["part", "entry", "value"]].itertuples(index=False):
            value = tuple(json.loads(value))
            if part == "session":
                self.state.session = value
            else:
                self.state.put(part, tuple(json.loads(entry)), value)

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Parts of a state are kept by the RocksDB provider alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def capture_stream(events: DataFrame, redactor: Redactor | None = None, head: DataFrame | None = None, restore: DataFrame | None = None) -> DataFrame:
    """A streaming DataFrame of EVENT rows to committed (or discarded) edits. restore: the
    pending state to begin with, as `backup` wrote it."""
    with_state_store(events.sparkSession)
    initial = None if restore is None else restore.select("repo", "part", "entry", "value").groupBy("repo")
    return prepared(events, redactor, head).groupBy("repo").transformWithStateInPandas(Capture(), OUT, "Append", "None", initial)


def capture_batch(events: DataFrame, redactor: Redactor | None = None, head: DataFrame | None = None) -> DataFrame:
    """The same over a bounded table, as a sorted scan: rows of a repository come in the
    order of seq, and only what is pending is held."""

    def run(batches):
        repo, state = None, Pending()
        for pdf in batches:
            out = []
            for row in _clean(pdf):
                if row["repo"] != repo:
                    repo, state = row["repo"], Pending()
                out += step(state, repo, row)
            yield pd.DataFrame(out, columns=_OUT_NAMES)

    return prepared(events, redactor, head).repartition("repo").sortWithinPartitions("repo", "seq").mapInPandas(run, OUT)


# --- what is pending ---------------------------------------------------------


def pending_part(spark: SparkSession, checkpoint: str, part: str) -> DataFrame:
    """One part of the pending state, as of the last finished micro-batch: repo, keys and
    values. The stream may go on meanwhile."""
    got = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", part).load()
    keys, values = STATE[part]
    named = lambda fields: [f.split()[0] for f in fields.split(", ")]
    if keys is None:
        return got.select(F.col("key.repo").alias("repo"), *[F.col(f"value.{n}").alias(n) for n in named(values)])
    return got.select(F.col("key.repo").alias("repo"), *[F.col(f"user_map_key.{n}").alias(n) for n in named(keys)], *[F.col(f"user_map_value.{n}").alias(n) for n in named(values)])


def status(spark: SparkSession, checkpoint: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Per repository with a session: pending files, edits, lines, prompts, age."""
    files = pending_part(spark, checkpoint, "files").groupBy("repo").agg(F.count("*").alias("file_count"), F.sum("edits").alias("edit_count"), F.sum("lines").alias("line_count"))
    prompts = pending_part(spark, checkpoint, "prompts").groupBy("repo").agg(F.count("*").alias("prompt_count"), F.sum("redactions").alias("total_redactions"))
    out = pending_part(spark, checkpoint, "session").join(files, "repo", "left").join(prompts, "repo", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "line_count", "edit_count", "prompt_count", "total_redactions")]
    return out.select("repo", "session_id", (F.coalesce("edit_count", F.lit(0)) > 0).alias("has_pending"), *zero, HI.is_stale(F.col("started_at"), as_of, hours).alias("is_stale"), HI.age_text(F.col("started_at"), as_of).alias("age"), F.lit(hours).alias("max_pending_age_hours"))


def backup(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The whole pending state as rows (repo, part, entry, value), to be written anywhere
    and given to capture_stream as `restore`."""
    out = None
    for part, (keys, values) in STATE.items():
        df = pending_part(spark, checkpoint, part)
        listed = lambda fields: F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(_json(F.col(n), kind), F.lit("null")) for n, kind in (f.split() for f in fields.split(", "))]), F.lit("]"))
        rows = df.select("repo", F.lit(part).alias("part"), (F.lit(None).cast("string") if keys is None else listed(keys)).alias("entry"), listed(values).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _json(value: Column, kind: str) -> Column:
    """A scalar as JSON: text by way of an array of one."""
    return F.regexp_replace(F.to_json(F.when(value.isNotNull(), F.array(value))), r"(?s)^\[(.*)\]$", "$1") if kind == "string" else value.cast("string")


PAIRED = "path string, pre_ts timestamp, post_ts timestamp, old_content string, old_present boolean, new_content string"


def _tool_events(pre: DataFrame, post: DataFrame) -> DataFrame:
    key = F.coalesce("call_id", "path")
    a = pre.select(key.alias("k"), "path", "ts", F.lit(0).alias("turn"), F.col("old_content").alias("content"))
    return a.unionByName(post.select(key.alias("k"), "path", "ts", F.lit(1).alias("turn"), F.col("new_content").alias("content")))


def paired_snapshots(pre: DataFrame, post: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Pre- and post-tool events of streams or tables, by call id, or by path where there
    is none. pre(call_id, path, ts, old_content), post(call_id, path, ts, new_content).

    A pre leaves one state per key, which a later pre overwrites and the next post uses
    up; null old_content is a file that does not exist and leaves none, as does a state
    older than ttl. A post without state starts from nothing. Posts that change nothing are
    left out. Events of the same time: pre before post, then by content."""
    events = _tool_events(pre, post)
    if events.isStreaming:
        return _paired_stream(events, ttl)
    w = W.partitionBy("k").orderBy("ts", "turn", "content")
    rows = events.select("*", F.lag("turn").over(w).alias("before"), F.lag("ts").over(w).alias("pre_ts"), F.lag("content").over(w).alias("old"))
    # the event just before a post is a pre, or it has used up what there was
    held = (F.col("before") == 0) & F.col("old").isNotNull() & (F.col("ts") <= F.col("pre_ts") + F.expr(f"interval {ttl}"))
    out = rows.where("turn = 1").select("path", F.when(held, F.col("pre_ts")).alias("pre_ts"), F.col("ts").alias("post_ts"), F.when(held, F.col("old")).otherwise("").alias("old_content"), F.coalesce(held, F.lit(False)).alias("old_present"), F.col("content").alias("new_content"))
    return out.where(~F.col("old_content").eqNullSafe(F.col("new_content")))


def _paired_stream(events: DataFrame, ttl: str) -> DataFrame:
    life = pd.Timedelta(ttl)

    def run(key, batches, state: GroupState):
        held = (state.get[0], state.get[1]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "turn", "content"])
        out = []
        for path, ts, turn, content in rows[["path", "ts", "turn", "content"]].itertuples(index=False):
            content = None if content is None or content != content else content
            if turn == 0:
                held = None if content is None else (ts, content)
                continue
            if held is not None and ts - held[0] > life:
                held = None
            old = "" if held is None else held[1]
            if old != content:
                out.append((path, None if held is None else held[0], ts, old, held is not None, content))
            held = None
        if held is None:
            state.update((None, None))
        else:
            state.update((held[0].to_pydatetime(), held[1]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIRED.split(", ")])
        frame["pre_ts"] = pd.to_datetime(frame["pre_ts"])
        yield frame

    def known(key, batches, state: GroupState):
        if state.exists and state.get[0] is None:
            state.remove()
        yield from run(key, batches, state)

    return events.groupBy("k").applyInPandasWithState(known, PAIRED, "ts timestamp, content string", "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, source: str, target: str, checkpoint: str, restore: DataFrame | None = None) -> None:
    """Takes all events there are from JSON files to Parquet and stops."""
    stream = spark.readStream.schema(EVENT).json(source)
    q = capture_stream(stream, restore=restore).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
