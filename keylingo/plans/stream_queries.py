"""Streaming queries over the given tables, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decide as D
from ..operators import models as M
from ..sources.scratch import kept, shared_folder
from ..sources.writers import decision_log
from ..streaming import processors as R
from . import context_queries, decide_queries, feedback_queries
from .common import table
from .feedback_queries import SQL as FEEDBACK_SQL


def _stream(spark, d, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def _events(spark, d) -> DataFrame:
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def t1_stream_keystrokes(spark, d):
    ch = F.when(F.col("event_type") == "view", " ").otherwise(F.substring("event_type", 1, 1))
    keys = _events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), ch.alias("ch"), (F.col("event_type") == "error").alias("is_backspace"))
    return R.run_to_table(R.keystrokes_to_tokens(keys, gap=86400.0), shared_folder(spark, "keystrokes"), "append").select("user_id", "seq", "token")


def t2_stream_sessions(spark, d):
    """Closed sessions: those that end, with the gap and the lateness, before the last event of all."""
    out = R.typing_sessions(_events(spark, d).select("user_id", "ts"), "6 hours")
    made = R.run_to_table(out, shared_folder(spark, "sessions"), "append")
    return made.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


def t4_stream_rules(spark, d):
    seen = feedback_queries.rule_events(spark, d, _events(spark, d)).withColumn("token", F.col("token").cast("string"))
    rules = R.run_to_rules(R.learn_rules(seen), shared_folder(spark, "rules"))
    return rules.select(F.col("token").cast("long").alias("user_id"), "action", "hyp", "reject", "apply", "override")


def t6_stream_alternation(spark, d):
    """Closed sessions of alternation presses, and what each teaches."""
    out = R.alternation_events(feedback_queries.presses(_events(spark, d)), gap=21600.0)
    return R.run_to_table(out, shared_folder(spark, "alternation"), "append").drop("batch")


def t7_stream_profile(spark, d):
    kind = F.col("event_type")
    outcome = F.when(kind.isin("click", "signup"), "accepted").when(kind == "view", "manual").when(kind == "error", "reverted")
    seen = _events(spark, d).select(F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0").alias("prefix3"), feedback_queries._lang(F.col("event_id")).alias("last_lang"), outcome.alias("outcome"))
    return R.run_to_table(R.stream_profile(seen), shared_folder(spark, "profile"), "complete").select("prefix3", "last_lang", "accepted", "reverted")


def t3_stream_context_boost(spark, d):
    """The tokens of conversations as a stream; words that the watermark hasn't passed at the end stay undecided."""
    seen = context_queries.tokens(spark, d, _stream(spark, d, "conversations")).withColumn("ends", F.col("token").rlike(r"[.!?][\p{P}]*$"))
    out = R.context_boost(seen.withColumn("ts", F.timestamp_seconds(F.col("ts") + EPOCH)))
    return R.run_to_table(out, shared_folder(spark, "boost"), "append").select("stream_id", "seq", "decision")


def t8_stream_decisions(spark, d):
    """Words of a stream of documents, decided by the batch cascade into a privacy-safe log; models and rules are made once, before the stream."""
    models, rules = decide_queries.models(spark, d), kept(decide_queries.rules(decide_queries.typed_words(spark, d)), "rules")

    docs = _stream(spark, d, "documents").where("text is not null")
    words = docs.select(F.explode(T.words_by_language(F.col("text"), F.col("lang"), M.LANGS)).alias("token"))
    log = R.stream_decisions(words, lambda tokens: decision_log(D.route(tokens, models, rules)), shared_folder(spark, "decisions"))
    return log.groupBy("path", "lang").agg(F.count("*").alias("n"))


#: Seconds that conversations begin after 1970, for time stamps that the first watermark doesn't pass.
EPOCH = 1_000_000_000
#: The watermark at the end: the latest event in whole milliseconds, less the lateness.
EVENTS_WM = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 10000000 FROM events)"

QUERIES = {f.__name__: f for f in (t1_stream_keystrokes, t2_stream_sessions, t3_stream_context_boost, t4_stream_rules, t6_stream_alternation, t7_stream_profile, t8_stream_decisions)}

SQL = {
    # a batch holds the whole table here, so its distinct words are the table's
    "t8_stream_decisions": f"WITH {decide_queries.routed(with_model=False)} SELECT path, lang, count(*) AS n FROM routed WHERE token IN (SELECT word FROM ew) GROUP BY path, lang",
    "t2_stream_sessions": f"WITH s AS ({FEEDBACK_SQL['t2_typing_sessions']}) SELECT * FROM s WHERE last_us + 6 * 3600000000 <= {EVENTS_WM}",
    "t1_stream_keystrokes": FEEDBACK_SQL["t1_keystrokes_to_tokens"] + f" AND epoch_us(last) <= {EVENTS_WM}",
    "t4_stream_rules": FEEDBACK_SQL["t4_learn_rules"].replace("FROM events)", f"FROM events WHERE epoch_us(ts) <= {EVENTS_WM})", 1),
    "t6_stream_alternation": f"SELECT * EXCLUDE last_us FROM ({feedback_queries.ALTERNATION}) WHERE last_us + 6 * 3600000000 <= {EVENTS_WM}",
    "t7_stream_profile": f"WITH {feedback_queries.FEEDBACK} SELECT prefix3, last_lang, accepted, reverted FROM st",
    "t3_stream_context_boost": f"""WITH wm AS (SELECT max(ts) - 10 AS wm FROM ({context_queries.TOKENS_ONLY})), w4 AS ({context_queries.SQL["w4_context_boost"]}), tk AS ({context_queries.TOKENS_ONLY}),
      nx AS (SELECT *, lead(ts) OVER (PARTITION BY stream_id ORDER BY seq) AS next FROM tk)
      SELECT stream_id, seq, decision FROM nx JOIN w4 USING (stream_id, seq), wm
      WHERE ts <= wm AND (decision = 'applied' OR NOT (confidence >= 0.40 OR lower(token) IN ('f', 'd', 'r', 'j', 'e', 'b', 'z')) OR next <= wm OR ts + 5 <= wm)""",
}
