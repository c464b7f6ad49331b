"""Streams with state for each key. Each has a batch twin that gives the same rows on the same input.

Folds over a key's rows need them in order, but rows come in any order within
the lateness. So rows wait in the state until the watermark has passed them; an
event-time timer then folds those that are due, in the order of (time, seq).
The outcome depends on the rows alone, not on how batches cut them or on
restarts. Rows without a time are left out. A chunk of a batch goes to the state as it comes; what waits is
bounded by what a bucket of keys gets within the lateness, once the stream is caught up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Thresholds
from ..operators import feedback as B

#: Rows later than this are dropped.
LATE = "10 seconds"
#: Keys are dealt into as many buckets, which a checkpoint keeps: it can't be read with another number.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a bucket of keys (ts, none, key, us, seq, ...), each key's folded in the order of (us, seq) when the watermark has passed them.

    A call, its frames and its timers cost the same for one row as for thousands,
    so a bucket of keys shares them; each key has a state of its own. A subclass
    says what waits and what is known, and folds: ``step`` gives the next state
    and output rows for a row, ``due`` when a state expires by itself, ``expire``
    what comes out then. A state of None is forgotten.
    """

    waiting = known = ""
    columns: tuple[str, ...] = ()
    key_type = "long"

    def step(self, state, row) -> tuple:
        raise NotImplementedError

    def due(self, state) -> int | None:
        return None

    def expire(self, state) -> tuple:
        return None, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.longs = handle, [f.split()[0] for f in self.waiting.split(", ") if f.endswith(" long")]
        self.rows = handle.getListState("rows", f"__none boolean, __key {self.key_type}, us long, seq long, {self.waiting}")
        self.marks = handle.getListState("marks", f"none boolean, key {self.key_type}, us long")
        self.states = handle.getMapState("states", f"none boolean, key {self.key_type}", self.known)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            chunk = chunk.drop(columns=[chunk.columns[0], "ts"])
            # pandas makes whole numbers with nulls floating ones
            chunk = chunk.astype({c: "Int64" for c in self.longs if chunk[c].dtype.kind == "f"}).astype(object)
            chunk = chunk.where(chunk.notna(), None)
            self.rows.appendList(list(chunk.itertuples(index=False, name=None)))
            least = int(chunk["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, out, later = {}, [], []
        for row in self.rows.get() if self.rows.exists() else ():
            row = tuple(row)
            ready.setdefault(row[:2], []).append(row[2:]) if row[2] <= now else later.append(row)
        marks = {tuple(m) for m in self.marks.get()} if self.marks.exists() else set()
        left = {m for m in marks if m[2] > now}
        for of in dict.fromkeys([*ready, *(m[:2] for m in marks - left)]):
            before = self.states.getValue(of)
            before = state = None if before is None else tuple(before)
            name = None if of[0] else of[1]
            for row in sorted(ready.pop(of, ()), key=lambda r: r[:2]):
                state, made = self._expired(state, row[0])
                out += ((name, *r) for r in made)
                state, made = self.step(state, row)
                out += ((name, *r) for r in made)
            state, made = self._expired(state, now + 1)
            out += ((name, *r) for r in made)
            if state is None and before is not None:
                self.states.removeKey(of)
            elif state is not None and state != before:
                self.states.updateValue(of, state)
            if state is not None and self.due(state) is not None:
                left.add((*of, self.due(state)))
        for store, was, rest in ((self.rows, None, later), (self.marks, marks, left)):
            if rest != was and (rest or store.exists()):
                store.put(list(rest)) if rest else store.clear()
        for at in (min((r[2] for r in rest), default=None) for rest in (later, left)):
            if at is not None:
                self._wake(at)
        yield pd.DataFrame(out, columns=self.columns)

    def _expired(self, state, now: int) -> tuple:
        """The state and what comes out of it if it has expired before ``now``."""
        if state is not None and self.due(state) is not None and self.due(state) < now:
            return self.expire(state)
        return state, []

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


class Keystrokes(InOrder):
    """Characters gather until white space; backspace removes one, after select-all all; a pause drops the buffer."""

    waiting, known, columns = "ch string, is_backspace boolean, ends boolean, selects boolean", "buffer string, unknown boolean, last long, selected long, seq long", ("user_id", "seq", "token")

    def __init__(self, gap: float):
        self.gap = int(gap * 1e6)

    def step(self, state, row) -> tuple:
        us, _, ch, erases, ends, selects = row
        buffer, unknown, last, selected, seq = state or ("", False, None, None, 0)
        (buffer, unknown), selected, token = B.keystroke(buffer, unknown, last is not None and us - last > self.gap, us, selected, ch, erases, ends, selects)
        seq += token is not None
        return (buffer, unknown, us, selected, seq), [] if token is None else [(seq, token)]


class Rules(InOrder):
    """The rule of each token after every event that is due; look-ups refresh it."""

    waiting, known = "event string, hyp string", "action string, hyp string, reject long, apply long, override long, touched long, touched_seq long"
    columns = ("token", "action", "hyp", "reject", "apply", "override", "touched", "touched_seq")
    key_type = "string"

    def step(self, state, row) -> tuple:
        us, seq, event, named = row
        rule, at = (state[:5], state[5:]) if state else (B.NO_RULE, (None, None))
        rule, touches = B.rule_after(rule, event, named)
        state = (*rule, *((us, seq) if touches else at))
        return state, [state]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for made in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield made.drop_duplicates("token", keep="last")  # one row a token and batch


class ContextBoost(InOrder):
    """One waiting word a stream: the next word of the sentence decides on it, or it expires."""

    waiting, known = "token string, lang string, confidence double, ends boolean", "us long, seq long, token string, lang string, confidence double, ends boolean"
    columns = ("stream_id", "seq", "decision")

    def __init__(self, th: Thresholds, limit: float, pause: float):
        self.limit, self.least, self.boost = limit, th.pending_min, th.context_boost
        self.timeout, self.soon = int(th.pending_timeout * 1e6), int(min(th.pending_timeout, pause) * 1e6)

    def due(self, state) -> int:
        return state[0] + self.timeout

    def expire(self, state) -> tuple:
        return None, [(state[1], None)]

    def step(self, state, row) -> tuple:
        us, seq, token, lang, confidence, ends = row
        sure, out = (confidence or 0.0) > self.limit, []
        if state is not None:
            was, held, text, target, level, ended = state
            soon, decision = us - was <= self.soon and not ended, None
            if soon and (text or "").lower() in B.PREPOSITION_KEYS and lang == "ru":
                decision = "preposition"
            elif soon and level is not None and level >= self.least and sure and lang is not None and lang == target and level + self.boost > self.limit:
                decision = "boosted"
            out.append((held, decision))
        if sure:
            return None, [*out, (seq, "applied")]
        if (token or "").lower() in B.PREPOSITION_KEYS or (confidence is not None and confidence >= self.least):
            return (us, seq, token, lang, confidence, bool(ends)), out
        return None, [*out, (seq, None)]


class Alternation(InOrder):
    """A session of alternation presses: where the choice stands, and what the session teaches when it ends."""

    waiting, known = "automatic boolean, choices long", "start long, last long, automatic boolean, choices long, presses long"
    columns = ("user_id", "start_us", "automatic", "last_index", "presses", "event")

    def __init__(self, gap: float):
        self.gap = int(gap * 1e6)

    def due(self, state) -> int:
        return state[1] + self.gap

    def expire(self, state) -> tuple:
        start, _, automatic, choices, presses = state
        index = B.position_after(presses, automatic, choices)
        return None, [(start, automatic, index, presses, B.lesson(index, automatic))]

    def step(self, state, row) -> tuple:
        us, _, automatic, choices = row
        if state is None:
            return (us, us, bool(automatic), choices, 1), []
        start, _, automatic, most, presses = state
        return (start, us, automatic, max((x for x in (most, choices) if x is not None), default=None), presses + 1), []


def _in_order(stream: DataFrame, key: str, fold: InOrder, schema: str, late: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = [f.split()[0] for f in fold.waiting.split(", ")]
    none = F.lit("" if fold.key_type == "string" else 0)
    of = [F.col(key).isNull().alias("__none"), F.coalesce(F.col(key).cast(fold.key_type), none.cast(fold.key_type)).alias("__key")]
    bucket = F.pmod(F.hash(key), F.lit(BUCKETS)).alias("__bucket")
    rows = stream.where("ts is not null").withWatermark("ts", late).select(bucket, *of, "ts", F.unix_micros("ts").alias("us"), "seq", *names)
    return rows.groupBy("__bucket").transformWithStateInPandas(fold, schema, "Append", "EventTime")


def keystrokes_to_tokens(stream: DataFrame, gap: float = 2.0, late: str = LATE) -> DataFrame:
    """(user_id, seq, token) of a stream of (user_id, ts, seq, ch, is_backspace) and, if there is one, selects_all."""
    selects = F.coalesce("selects_all", F.lit(False)) if "selects_all" in stream.columns else F.lit(False)
    keys = stream.withColumns({"ends": F.coalesce(B.is_space("ch"), F.lit(False)), "selects": selects, "is_backspace": F.coalesce("is_backspace", F.lit(False))})
    return _in_order(keys, "user_id", Keystrokes(gap), "user_id long, seq long, token string", late)


def learn_rules(stream: DataFrame, late: str = LATE) -> DataFrame:
    """(token, action, hyp, reject, apply, override, touched, touched_seq) of a stream of (token string, ts, seq, event, hyp): a row for a token whenever events of it are due."""
    schema = "token string, action string, hyp string, reject long, apply long, override long, touched long, touched_seq long"
    return _in_order(stream, "token", Rules(), schema, late)


def context_boost(stream: DataFrame, th: Thresholds = DEFAULT, limit: float | None = None, pause: float = 2.0, late: str = LATE) -> DataFrame:
    """(stream_id, seq, decision) of a stream of (stream_id, seq, ts, token, lang, confidence, ends).

    A sure word is applied as soon as the watermark has passed it. One that may
    be a preposition or is nearly sure waits for the next word of the sentence,
    ``pending_timeout`` seconds at most.
    """
    fold = ContextBoost(th, th.correction if limit is None else limit, pause)
    return _in_order(stream, "stream_id", fold, "stream_id long, seq long, decision string", late)


def alternation_events(stream: DataFrame, gap: float = 60.0, late: str = LATE) -> DataFrame:
    """(user_id, start_us, automatic, last_index, presses, event) of closed sessions of a stream of (user_id, ts, seq, automatic, choices)."""
    return _in_order(stream, "user_id", Alternation(gap), "user_id long, start_us long, automatic boolean, last_index long, presses long, event string", late)


def stream_profile(stream: DataFrame) -> DataFrame:
    """(prefix3, last_lang, accepted, reverted) kept up to date."""
    return stream.groupBy("prefix3", "last_lang").agg(F.count_if(F.col("outcome").isin("accepted", "manual")).alias("accepted"), F.count_if(F.col("outcome") == "reverted").alias("reverted"))


def typing_sessions(stream: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(user_id, start, last, events) of closed sessions."""
    out = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("w.start").alias("start"), "last", "events")


def _run(stream: DataFrame, folder: str, mode: str, sink) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet table and returns it; each batch replaces itself when it is run again."""
    _run(stream, folder, mode, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_rules(stream: DataFrame, folder: str, most: int = 500) -> DataFrame:
    """Runs a stream of ``learn_rules`` over what is there now; returns the ``most`` rules that were used last.

    Each batch writes a new version of the table from the version before, a row a
    token and ``most`` rules at most, so that a batch that is run again gives the
    same one. The version before stays, older ones go.
    """
    spark, schema = stream.sparkSession, stream.schema

    def version(number: int) -> str:
        return f"{folder}/rules/version={number}"

    def sink(batch: DataFrame, number: int) -> None:
        # written first, since whoever reads a batch twice folds it twice
        batch.write.mode("overwrite").parquet(f"{folder}/changed")
        batch = spark.read.schema(schema).parquet(f"{folder}/changed")
        before = spark.read.schema(schema).parquet(version(number - 1)) if number else spark.createDataFrame([], schema)
        newest = batch.unionByName(before.join(batch.select("token"), "token", "left_anti"))
        kept = newest.where("action is not null").orderBy(F.desc("touched"), F.desc("touched_seq"), "token").limit(most)
        kept.write.mode("overwrite").parquet(version(number))
        _delete(spark, version(number - 2))

    _run(stream, folder, "append", sink)
    last = _latest(spark, f"{folder}/rules")
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(version(last))


def _store(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def _latest(spark, folder: str) -> int | None:
    """The highest N of the folders version=N."""
    store, at = _store(spark, folder)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=None)


def stream_decisions(tokens: DataFrame, decide, folder: str) -> DataFrame:
    """Decides each batch of a stream of (token) by the batch job ``decide`` and appends the outcome; a token is decided once.

    A table holds the tokens of each batch. Tokens that an earlier batch decided
    are left out, so a batch that is run again decides the same ones.
    """
    spark, decided = tokens.sparkSession, f"{folder}/tokens"

    def sink(batch: DataFrame, number: int) -> None:
        new = batch.select("token").where("token is not null").distinct()
        if number:
            before = spark.read.schema("token string, batch long").parquet(decided).where(F.col("batch") < number)
            new = new.join(before.select("token"), "token", "left_anti")
        new.write.mode("overwrite").parquet(f"{decided}/batch={number}")
        decide(spark.read.schema("token string").parquet(f"{decided}/batch={number}")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _run(tokens, folder, "append", sink)
    return spark.read.parquet(f"{folder}/out").drop("batch")
