"""Learning from what users do with corrections: profiles, rules, histories, sessions."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as S


#: No key is this one.
_NOBODY = object()
#: A rule of a token: action, hyp, reject, apply, override.
NO_RULE = (None, None, 0, 0, 0)
#: Keys of one-letter Russian prepositions and conjunctions, as typed on the US layout.
PREPOSITION_KEYS = frozenset("fdrjebz")
#: Backspace so many microseconds after select-all at most erases all.
SELECTED_FOR = 350_000


def rule_after(rule: tuple, event: str | None, named: str | None) -> tuple[tuple, bool]:
    """A token's rule after an event, and whether the event uses the rule, which keeps it among the most recent."""
    action, hyp, reject, apply, override = rule
    if event == "reject":
        hardens = action != "keepAsIs" and reject >= 1
        return ("keepAsIs" if hardens else action, None if hardens else hyp, reject + 1, apply, override), True
    if event == "apply":
        return ((action, hyp) if action == "keepAsIs" else ("preferHypothesis", named)) + (reject, apply + 1, override), True
    if event == "override" and action is not None:
        return (NO_RULE if override >= 1 else (action, hyp, reject, apply, override + 1)), True
    return rule, event == "lookup" and action is not None


def keystroke(buffer: str, unknown: bool, late: bool, us: int | None, selected: int | None, ch: str | None, erases: bool, ends: bool, selects: bool) -> tuple:
    """((buffer, unknown), selected, token) after a key; token is None if none ends or its characters aren't all known.

    ``late``: the pause before was longer than the gap. ``selected`` is when all was selected last.
    """
    if late:
        buffer, unknown = "", False
    if selects:
        return (buffer, unknown), us, None
    if erases:
        if selected is not None and us is not None and us - selected < SELECTED_FOR:
            return ("", False), None, None
        return (buffer[:-1], unknown), selected, None
    if ends:
        return ("", False), selected, None if unknown else buffer or None
    return (("", True) if unknown or ch is None else (buffer + ch, False)), selected, None


def is_space(col: str) -> Column:
    """A white-space character: the six of ASCII, whatever else a platform may count."""
    return F.col(col).rlike(r"^\s$")


def position_after(presses: int, automatic: bool, choices: int | None) -> int:
    """Where the choice stands after so many presses: the closed form of ``alternation_replay``."""
    start, k = int(bool(automatic)), presses - 1
    if choices is None or choices == 2:
        return (k + start + 1) % 2
    if choices < 2:
        return 0
    return k % 3 if start else 1 if k == 0 else (k - 1) % 3


def lesson(index: int, automatic: bool) -> str | None:
    """What a session teaches that ends on a choice."""
    if automatic:
        return "reject" if index == 0 else "apply" if index != 1 else None
    return "apply" if index != 0 else None


def _in_order(df: DataFrame, by: str, order: tuple[str, ...], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``run`` over the rows of each ``by``, which follow each other in order; they are streamed from an external sort, never held together."""
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def _field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def profile_stats(feedback: DataFrame, busiest: int | None = 1000) -> DataFrame:
    """(prefix3, last_lang, accepted, reverted, rate) of the busiest contexts, or of all; manual choices count as accepted, no feedback as 0.5."""
    stats = feedback.groupBy("prefix3", "last_lang").agg(
        F.count_if(F.col("outcome").isin("accepted", "manual")).alias("accepted"), F.count_if(F.col("outcome") == "reverted").alias("reverted")
    )
    total = F.col("accepted") + F.col("reverted")
    ranked = stats.withColumn("rate", F.when(total > 0, F.col("accepted") / total).otherwise(0.5))
    return ranked if busiest is None else ranked.orderBy(F.desc(total), "prefix3", "last_lang").limit(busiest)  # a top n that keeps n rows a task


def adjust_confidence(decisions: DataFrame, profile: DataFrame, least: int = 3, invert_fix: bool = False) -> DataFrame:
    """``decisions`` with ``adjusted`` confidence: often reverted contexts * 1.2, mostly accepted ones * 0.9.

    The factors apply to the confidence; ``invert_fix`` swaps them.
    """
    joined = decisions.join(profile, ["prefix3", "last_lang"], "left")
    c, enough = F.col("confidence"), F.col("accepted") + F.col("reverted") >= least
    raise_, lower = F.least(F.lit(1.0), c * 1.2), F.greatest(F.lit(0.3), c * 0.9)
    if invert_fix:
        raise_, lower = lower, raise_
    out = F.when(enough & (F.col("rate") < 0.3), raise_).when(enough & (F.col("rate") > 0.7), lower).otherwise(c)
    return joined.withColumn("adjusted", out).select(*decisions.columns, "adjusted")


def recent_history(corrections: DataFrame, n: int = 50, by: str = "user_id", order=("ts", "event_id")) -> DataFrame:
    newest = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return corrections.withColumn("at", F.row_number().over(newest)).where(F.col("at") <= n).withColumn("at", F.col("at").cast("long"))


def retain_latest(log: DataFrame, n: int = 10_000, order=("ts", "event_id")) -> DataFrame:
    """The newest n rows: a top-n that keeps n rows a task."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)


def exclude_apps(events: DataFrame, excluded: DataFrame, col: str = "app") -> DataFrame:
    return events.join(excluded, col, "left_anti")


def debounce(events: DataFrame, gap: float = 0.5, by: str = "user_id", parts: int | None = None) -> DataFrame:
    """(by, event_id, ts) of triggers at least ``gap`` seconds after the last one that was let through; those without a time pass.

    A long history is in many tasks: which trigger of a block is let through last
    follows from which is first, and that is one within the first gap of the
    block, or the one after.
    """
    least = int(gap * 1e6)

    def summary(rows):
        times = array("q", (us for *_, us, _ in rows if us is not None))
        last, after = array("q", times), len(times)
        for n in range(len(times) - 1, -1, -1):
            while after > n + 1 and times[after - 1] - times[n] >= least:
                after -= 1
            if after < len(times) and times[after] - times[n] >= least:
                last[n] = last[after]
        upto = bisect_left(times, times[0] + least) + 1 if times else 0
        return list(times[:upto]), list(last[:upto])

    def carry(state, done):
        first, last = done
        at = 0 if state is None or state[0] is None else bisect_left(first, state[0] + least)
        return (last[at],) if at < len(first) else state

    def run(state, rows):
        last = state[0] if state else None
        for of, number, ts, us, *_ in rows:
            if us is None or last is None or us - last >= least:
                last = last if us is None else us
                yield of, number, ts

    rows = events.select(by, "event_id", "ts", F.unix_micros("ts").alias("__us"))
    placed = S.dealt(rows, (by,), ("ts", "event_id"), parts)
    return S.folded(placed, by, ("ts", "event_id"), summary, "first array<bigint>, last array<bigint>", carry, "last bigint", run, events.select(by, "event_id", "ts").schema)


def typing_sessions(events: DataFrame, gap: str = "2 seconds", by: str = "user_id") -> DataFrame:
    """(by, start, end, events): runs of events no further apart than the gap."""
    out = events.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return out.select(by, F.col("w.start").alias("start"), "last", "events")


def learn_rules(feedback: DataFrame, key: str = "token", most: int = 500) -> DataFrame:
    """(key, action, hyp, reject, apply, override, last_touch): the rules that events (event, hyp) in order of (ts, seq) leave.

    Two rejects make a token keepAsIs; applying a hypothesis prefers it, unless
    it is keepAsIs; two overrides of a learned rule remove it and its counters.
    Looking up a rule uses it, as these events do; the rules that were used last
    stay. Other events change nothing.
    """

    def run(batches):
        token, rule, touched, schema = _NOBODY, NO_RULE, None, None
        for batch in batches:
            schema, out = batch.schema, []
            for n, (of, event, named) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
                if of != token:
                    if token is not _NOBODY:
                        out.append((token, *rule, *(x.as_py() for x in touched)))
                    token, rule, touched = of, NO_RULE, (pa.scalar(None), pa.scalar(None))
                rule, touches = rule_after(rule, event, named)
                if touches:
                    touched = batch.column(1)[n], batch.column(2)[n]
            yield made(out, schema)
        if token is not _NOBODY:
            yield made([(token, *rule, *(x.as_py() for x in touched))], schema)

    def made(out, schema):
        kinds = (schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), schema.field(1).type, schema.field(2).type)
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names)

    rows = feedback.select(key, "ts", "seq", "event", "hyp")
    counters = [_field("action", "string"), _field("hyp", "string"), *(_field(c, "bigint") for c in ("reject", "apply", "override"))]
    schema = T.StructType([rows.schema[key], *counters, T.StructField("last_touch", rows.schema["ts"].dataType), T.StructField("__seq", rows.schema["seq"].dataType)])
    names = schema.names
    rules = _in_order(rows, key, ("ts", "seq", "event", "hyp"), run, schema).where("action is not null")
    return rules.orderBy(F.desc("last_touch"), F.desc("__seq")).limit(most).drop("__seq")


def feedback_events(presses: DataFrame, gap: str = "60 seconds", by: str = "user_id") -> DataFrame:
    """(by, start, automatic, last_index, presses, event): what a session of alternation presses teaches.

    After an automatic correction, ending on the original again is a reject, and
    ending beyond the correction is a manual choice; without one, ending anywhere
    but on the original is.
    """
    out = presses.groupBy(by, F.session_window("ts", gap).alias("w")).agg(
        F.max_by("index", F.struct("ts", "seq")).alias("last_index"), F.min_by("automatic", F.struct("ts", "seq")).alias("automatic"), F.count("*").alias("presses")
    )
    event = F.when(F.col("automatic"), F.when(F.col("last_index") == 0, "reject").when(F.col("last_index") != 1, "apply")).when(F.col("last_index") != 0, "apply")
    return out.select(by, F.col("w.start").alias("start"), "automatic", "last_index", "presses", event.alias("event"))


def alternation_events(presses: DataFrame, gap: str = "60 seconds", by: str = "user_id") -> DataFrame:
    """(by, start_us, automatic, last_index, presses, event): sessions of presses (ts, seq, automatic, choices) and what each teaches.

    The batch twin of the stream: positions as ``alternation_replay`` has them, lessons as ``feedback_events``.
    """
    out = presses.groupBy(by, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("presses"), F.coalesce(F.min_by("automatic", F.struct("ts", "seq")), F.lit(False)).alias("automatic"), F.max("choices").alias("n")
    )
    start, k = F.when(F.col("automatic"), 1).otherwise(0), F.col("presses") - 1
    by_three = F.when(start == 1, k % 3).when(k == 0, 1).otherwise((k - 1) % 3)
    index = F.when(F.col("n") > 2, by_three).when(F.col("n") < 2, 0).otherwise((k + start + 1) % 2).cast("long")
    event = F.when(F.col("automatic"), F.when(F.col("last_index") == 0, "reject").when(F.col("last_index") != 1, "apply")).when(F.col("last_index") != 0, "apply")
    return out.withColumn("last_index", index).select(by, F.unix_micros("w.start").alias("start_us"), "automatic", "last_index", "presses", event.alias("event"))


def alternation_replay(presses: DataFrame, by: str = "session_id", choices: str = "choices") -> DataFrame:
    """(by, positions): where the choice stands after each press.

    An automatic correction starts on 1, so its first press goes back to 0.
    Two choices are visible in the first round; when it ends for the second
    time, a third one is, if there is one. So the choice goes round by two at
    most before, and by three after that: it follows from the number of the press.
    """
    counted = presses.groupBy(by).agg(F.count("press_no").alias("presses"), F.first("automatic").alias("automatic"), F.max(choices).alias("n"))
    numbers = F.when(F.col("presses") > 0, F.sequence(F.lit(0), F.col("presses").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    start = F.when(F.col("automatic"), 1).otherwise(0)
    by_two = F.transform(numbers, lambda k: (k + start + 1) % 2)
    by_three = F.transform(numbers, lambda k: F.when(start == 1, k % 3).when(k == 0, 1).otherwise((k - 1) % 3))
    positions = F.when(F.col("n") > 2, by_three).when(F.col("n") < 2, F.transform(numbers, lambda k: k * 0)).otherwise(by_two)
    return counted.select(by, positions.alias("positions"))


def keystrokes_to_tokens(keys: DataFrame, gap: float = 2.0, by: str = "user_id", parts: int | None = None) -> DataFrame:
    """(by, seq, token) of (by, ts, seq, ch, is_backspace) and, if there is one, selects_all: the batch twin of the stream job.

    Characters gather until white space; backspace removes one, or all right after
    select-all; after a pause longer than the gap the buffer is dropped. A token
    with an unknown character is none.

    A long history is in many tasks: what a block leaves behind doesn't depend on
    what came before it, from its first white space on that no select-all before
    it can reach. Only the keys up to there are gone through again.
    """
    limit = int(gap * 1e6)
    fresh = ("", False, None, None)

    def pressed(state: tuple, key: tuple) -> tuple[tuple, str | None]:
        """The state (buffer, unknown, last, selected) after a key, and the token that ends."""
        buffer, unknown, last, selected = state
        us = key[0]
        (buffer, unknown), selected, token = keystroke(buffer, unknown, last is not None and us is not None and us - last > limit, us, selected, *key[1:])
        return (buffer, unknown, us, selected), token

    def summary(rows):
        head, first, state, n = [], None, None, 0
        for _, _, us, _, *key, _ in rows:
            if state is not None:
                state, token = pressed(state, (us, *key))
                n += token is not None
                continue
            head.append((us, *key))
            first = us if first is None else first
            if key[2] and not key[1] and not key[3] and us is not None and us - first >= SELECTED_FOR:
                state = ("", False, us, None)
        return (head, state is not None, *(state or fresh), n)

    def carry(state, done):
        head, known, *after, n = done
        now, seq = (state[:4], state[4]) if state else (fresh, 0)
        for key in head:
            now, token = pressed(now, tuple(key.values()))
            seq += token is not None
        return (*(after if known else now), seq + n)

    def run(state, rows):
        now, seq = (state[:4], state[4]) if state else (fresh, 0)
        for of, _, us, _, *key, _, _ in rows:
            now, token = pressed(now, (us, *key))
            if token is not None:
                seq += 1
                yield of, seq, token

    order = ("ts", "seq", "ch", "is_backspace")
    erases, selects = (F.coalesce(c, F.lit(False)) if c in keys.columns else F.lit(False) for c in ("is_backspace", "selects_all"))
    ends = F.coalesce(is_space("ch"), F.lit(False))
    rows = keys.select(by, "ts", F.unix_micros("ts").alias("__us"), "seq", "ch", erases.alias("is_backspace"), ends.alias("__ends"), selects.alias("__selects"))
    placed = S.dealt(rows, (by,), order, parts)
    kept_state = "buffer string, unknown boolean, last bigint, selected bigint"
    done = f"head array<struct<us:bigint,ch:string,erases:boolean,ends:boolean,selects:boolean>>, known boolean, {kept_state}, n bigint"
    return S.folded(placed, by, order, summary, done, carry, f"{kept_state}, seq bigint", run, T.StructType([rows.schema[by], _field("seq", "bigint"), _field("token", "string")]))
