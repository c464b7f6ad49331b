"""Queries of feedback operators over ``events``, with their SQL.

Clicks and signups stand for accepted corrections, views for manual ones, errors
for reverted ones and purchases for overrides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layouts as L
from ..functions.numbers import rounded
from ..operators import conversion as V
from ..operators import feedback as B
from .common import table


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _lang(n) -> Column:
    return F.element_at(F.array(F.lit("en"), F.lit("ru"), F.lit("he")), (n % 3 + 1).cast("int"))


def feedback(spark, d) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind.isin("click", "signup"), "accepted").when(kind == "view", "manual").when(kind == "error", "reverted")
    return events(spark, d).select("event_id", "value", F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0").alias("prefix3"), _lang(F.col("event_id")).alias("last_lang"), outcome.alias("outcome"))


def rule_events(spark, d, seen: DataFrame | None = None) -> DataFrame:
    """Events as what teaches rules: errors reject, views apply, purchases override, clicks look up."""
    kind = F.col("event_type")
    event = F.when(kind == "error", "reject").when(kind == "view", "apply").when(kind == "purchase", "override").when(kind == "click", "lookup").otherwise("none")
    return (events(spark, d) if seen is None else seen).select(F.col("user_id").alias("token"), "ts", F.col("event_id").alias("seq"), event.alias("event"), F.concat(_lang(F.col("event_id")), F.lit("_from_xx")).alias("hyp"))


def a9_profile_stats(spark, d):
    return B.profile_stats(feedback(spark, d)).withColumn("rate", rounded("rate", 6))


def a10_adjust_confidence(spark, d):
    known = feedback(spark, d)
    decisions = known.select("event_id", "prefix3", "last_lang", F.round(F.pmod(F.col("event_id") * 37, F.lit(100)) / 100, 2).alias("confidence"))
    return B.adjust_confidence(decisions, B.profile_stats(known, busiest=None)).withColumn("adjusted", rounded("adjusted", 6))


def j13_exclude_apps(spark, d):
    seen = events(spark, d).withColumnRenamed("event_type", "app")
    lowest = seen.groupBy("app").agg(F.avg("value").alias("v")).orderBy("v", "app").limit(2).select("app")
    return B.exclude_apps(seen, lowest).groupBy("app").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def j15_preferred_layout(spark, d):
    layouts = spark.createDataFrame(list(L.LAYOUTS), "layout_id string, lang string, prior int")
    names = F.array(*(F.lit(x[0]) for x in L.LAYOUTS))
    installed = events(spark, d).select("user_id", F.element_at(names, (F.col("event_id") % len(L.LAYOUTS) + 1).cast("int")).alias("layout_id")).distinct()
    return V.preferred_layout(installed, layouts)


def j15_preferred_layouts(spark, d):
    """All installed layouts of each user, in order."""
    layouts = spark.createDataFrame(list(L.LAYOUTS), "layout_id string, lang string, prior int")
    names = F.array(*(F.lit(x[0]) for x in L.LAYOUTS))
    installed = events(spark, d).select("user_id", F.element_at(names, (F.col("event_id") % len(L.LAYOUTS) + 1).cast("int")).alias("layout_id"))
    return V.preferred_layouts(installed, layouts).withColumn("layouts", F.array_join("layouts", ","))


def s13_retain_latest(spark, d):
    return B.retain_latest(events(spark, d), 500).select("event_id", "user_id", "event_type")


def w5_recent_history(spark, d):
    return B.recent_history(events(spark, d).select("event_id", "ts", "user_id"), 8).drop("ts")


def w6_debounce(spark, d):
    return B.debounce(events(spark, d), gap=3600.0).select("user_id", "event_id")


def t2_typing_sessions(spark, d):
    out = B.typing_sessions(events(spark, d), gap="6 hours")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


def t4_learn_rules(spark, d):
    return B.learn_rules(rule_events(spark, d)).select(F.col("token").alias("user_id"), "action", "hyp", "reject", "apply", "override")


def t5_feedback_events(spark, d):
    presses = events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("index"), (F.col("user_id") % 2 == 0).alias("automatic"))
    out = B.feedback_events(presses, gap="6 hours")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "automatic", "last_index", "presses", "event")


def presses(seen: DataFrame) -> DataFrame:
    """Events as presses of the alternation key, by user."""
    return seen.select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("user_id") % 2 == 0).alias("automatic"), (F.col("user_id") % 3 + 2).alias("choices"))


def t6_alternation_events(spark, d):
    return B.alternation_events(presses(events(spark, d)), gap="6 hours")


def t6_alternation_replay(spark, d):
    """Each user's events of a day are the presses of a session."""
    presses = events(spark, d).select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), F.col("event_id").alias("press_no"), (F.col("user_id") % 2 == 0).alias("automatic"), (F.col("user_id") % 3 + 2).alias("choices")
    )
    return B.alternation_replay(presses).select("session_id", F.array_join("positions", ",").alias("positions"))


def t1_keystrokes_to_tokens(spark, d):
    """Events as keystrokes: the type's first letter, white space for views, backspace for errors."""
    keys = events(spark, d).select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", " ").otherwise(F.substring("event_type", 1, 1)).alias("ch"), (F.col("event_type") == "error").alias("is_backspace"))
    return B.keystrokes_to_tokens(keys, gap=86400.0)


QUERIES = {f.__name__: f for f in (
    a9_profile_stats, a10_adjust_confidence, j13_exclude_apps, j15_preferred_layout, j15_preferred_layouts, s13_retain_latest, w5_recent_history, w6_debounce, t2_typing_sessions, t4_learn_rules, t5_feedback_events,
    t6_alternation_replay, t6_alternation_events, t1_keystrokes_to_tokens)}

LANG = "list_extract(['en', 'ru', 'he'], CAST(event_id % 3 + 1 AS INT))"
FEEDBACK = f"""fb AS (SELECT event_id, lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS prefix3, {LANG} AS last_lang, CASE WHEN event_type IN ('click', 'signup') THEN 'accepted' WHEN event_type = 'view' THEN 'manual' WHEN event_type = 'error' THEN 'reverted' END AS outcome FROM events),
  st AS (SELECT prefix3, last_lang, count(*) FILTER (outcome IN ('accepted', 'manual')) AS accepted, count(*) FILTER (outcome = 'reverted') AS reverted FROM fb GROUP BY prefix3, last_lang),
  rt AS (SELECT *, CASE WHEN accepted + reverted > 0 THEN accepted / (accepted + reverted) ELSE 0.5 END AS rate FROM st)"""


def sessions(seconds: int) -> str:
    return f"""g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {seconds}000000 THEN 0 ELSE 1 END AS new FROM events),
      ss AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)"""


NUMBERED = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
# each press of a session is stepped through
ALTERNATION = f"""WITH RECURSIVE {sessions(21600)}, p AS (SELECT user_id || '/' || sid AS session_id, user_id, epoch_us(ts) AS us, user_id % 2 = 0 AS automatic, CAST(user_id % 3 + 2 AS INT) AS c, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) AS n FROM ss),
  r(session_id, n, i, lim, wraps, c) AS (SELECT DISTINCT session_id, 0::BIGINT, CASE WHEN automatic THEN 1 ELSE 0 END, 2, 0, c FROM p UNION ALL
    SELECT r.session_id, r.n + 1, CASE WHEN r.i + 1 >= least(CASE WHEN r.i + 1 >= least(r.lim, r.c) AND r.wraps >= 1 AND r.lim = 2 AND r.c > 2 THEN 3 ELSE r.lim END, r.c) THEN 0 ELSE r.i + 1 END,
      CASE WHEN r.i + 1 >= least(r.lim, r.c) AND r.wraps >= 1 AND r.lim = 2 AND r.c > 2 THEN 3 ELSE r.lim END, r.wraps + CASE WHEN r.i + 1 >= least(r.lim, r.c) THEN 1 ELSE 0 END, r.c
    FROM r JOIN p ON p.session_id = r.session_id AND p.n = r.n + 1),
  g2 AS (SELECT session_id, any_value(user_id) AS user_id, min(us) AS start_us, max(us) AS last_us, any_value(automatic) AS automatic, max(n) AS presses FROM p GROUP BY session_id)
  SELECT user_id, start_us, automatic, CAST(i AS BIGINT) AS last_index, presses, CASE WHEN automatic THEN CASE WHEN i = 0 THEN 'reject' WHEN i <> 1 THEN 'apply' END WHEN i <> 0 THEN 'apply' END AS event, last_us
  FROM g2 JOIN r ON r.session_id = g2.session_id AND r.n = g2.presses"""
SQL = {
    "t6_alternation_events": f"SELECT * EXCLUDE last_us FROM ({ALTERNATION})",
    "a9_profile_stats": f"WITH {FEEDBACK} SELECT prefix3, last_lang, accepted, reverted, round(rate, 6) AS rate FROM rt ORDER BY accepted + reverted DESC, prefix3, last_lang LIMIT 1000",
    "a10_adjust_confidence": f"""WITH {FEEDBACK}, d AS (SELECT event_id, prefix3, last_lang, round((event_id * 37 % 100) / 100, 2) AS confidence FROM fb)
        SELECT event_id, prefix3, last_lang, confidence, round(CASE WHEN accepted + reverted >= 3 AND rate < 0.3 THEN least(1.0, confidence * 1.2) WHEN accepted + reverted >= 3 AND rate > 0.7 THEN greatest(0.3, confidence * 0.9) ELSE confidence END, 6) AS adjusted FROM d JOIN rt USING (prefix3, last_lang)""",
    "j13_exclude_apps": "WITH r AS (SELECT event_type FROM events GROUP BY event_type ORDER BY avg(value), event_type LIMIT 2) SELECT event_type AS app, count(*) AS n, min(event_id) AS first_id FROM events ANTI JOIN r USING (event_type) GROUP BY event_type",
    "j15_preferred_layout": f"""WITH l(layout_id, lang, prior) AS (VALUES {', '.join(str(x) for x in L.LAYOUTS)}), i AS (SELECT DISTINCT user_id, list_extract([{', '.join(repr(x[0]) for x in L.LAYOUTS)}], CAST(event_id % {len(L.LAYOUTS)} + 1 AS INT)) AS layout_id FROM events)
        SELECT user_id, lang, layout_id FROM i JOIN l USING (layout_id) QUALIFY row_number() OVER (PARTITION BY user_id, lang ORDER BY prior DESC, layout_id DESC) = 1""",
    "j15_preferred_layouts": f"""WITH l(layout_id, lang, prior) AS (VALUES {', '.join(str(x) for x in L.LAYOUTS)}), i AS (SELECT DISTINCT user_id, list_extract([{', '.join(repr(x[0]) for x in L.LAYOUTS)}], CAST(event_id % {len(L.LAYOUTS)} + 1 AS INT)) AS layout_id FROM events)
        SELECT user_id, lang, string_agg(layout_id, ',' ORDER BY prior DESC, layout_id) AS layouts FROM i JOIN l USING (layout_id) GROUP BY user_id, lang""",
    "s13_retain_latest": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "w5_recent_history": 'SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS "at" FROM events QUALIFY "at" <= 8',
    "w6_debounce": f"""WITH RECURSIVE {NUMBERED}, k(user_id, n, event_id, last, kept) AS (SELECT user_id, n, event_id, ts, true FROM ev WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(k.last) >= 3600000000 THEN e.ts ELSE k.last END, epoch_us(e.ts) - epoch_us(k.last) >= 3600000000 FROM k JOIN ev e ON e.user_id = k.user_id AND e.n = k.n + 1)
        SELECT user_id, event_id FROM k WHERE kept""",
    "t2_typing_sessions": f"WITH {sessions(21600)} SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS last_us, count(*) AS events FROM ss GROUP BY user_id, sid",
    "t4_learn_rules": f"""WITH RECURSIVE {NUMBERED}, x AS (SELECT user_id, n, ts, event_id, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'apply' WHEN 'purchase' THEN 'override' WHEN 'click' THEN 'lookup' ELSE 'none' END AS event, {LANG} || '_from_xx' AS hyp FROM ev),
      f(user_id, n, action, hyp, reject, apply, override, used) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM x UNION ALL
        SELECT f.user_id, f.n + 1,
          CASE x.event WHEN 'reject' THEN CASE WHEN f.action IS DISTINCT FROM 'keepAsIs' AND f.reject + 1 >= 2 THEN 'keepAsIs' ELSE f.action END WHEN 'apply' THEN CASE WHEN f.action = 'keepAsIs' THEN f.action ELSE 'preferHypothesis' END
            WHEN 'override' THEN CASE WHEN f.action IS NOT NULL AND f.override + 1 >= 2 THEN NULL ELSE f.action END ELSE f.action END,
          CASE x.event WHEN 'reject' THEN CASE WHEN f.action IS DISTINCT FROM 'keepAsIs' AND f.reject + 1 >= 2 THEN NULL ELSE f.hyp END WHEN 'apply' THEN CASE WHEN f.action = 'keepAsIs' THEN f.hyp ELSE x.hyp END
            WHEN 'override' THEN CASE WHEN f.action IS NOT NULL AND f.override + 1 >= 2 THEN NULL ELSE f.hyp END ELSE f.hyp END,
          CASE WHEN x.event = 'reject' THEN f.reject + 1 WHEN x.event = 'override' AND f.action IS NOT NULL AND f.override + 1 >= 2 THEN 0 ELSE f.reject END,
          CASE WHEN x.event = 'apply' THEN f.apply + 1 WHEN x.event = 'override' AND f.action IS NOT NULL AND f.override + 1 >= 2 THEN 0 ELSE f.apply END,
          CASE WHEN x.event = 'override' AND f.action IS NOT NULL THEN CASE WHEN f.override + 1 >= 2 THEN 0 ELSE f.override + 1 END ELSE f.override END,
          CASE WHEN x.event IN ('reject', 'apply') OR x.event IN ('override', 'lookup') AND f.action IS NOT NULL THEN x.n ELSE f.used END
        FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1),
      m AS (SELECT user_id, max(n) AS n FROM x GROUP BY user_id)
      SELECT f.user_id, f.action, f.hyp, f.reject, f.apply, f.override FROM f JOIN m ON m.user_id = f.user_id AND m.n = f.n JOIN x u ON u.user_id = f.user_id AND u.n = f.used WHERE f.action IS NOT NULL ORDER BY u.ts DESC, u.event_id DESC LIMIT 500""",
    "t5_feedback_events": f"""WITH {sessions(21600)}, s AS (SELECT user_id, min(epoch_us(ts)) AS start_us, user_id % 2 = 0 AS automatic, arg_max(event_id % 3, (ts, event_id)) AS last_index, count(*) AS presses FROM ss GROUP BY user_id, sid)
        SELECT *, CASE WHEN automatic THEN CASE WHEN last_index = 0 THEN 'reject' WHEN last_index <> 1 THEN 'apply' END WHEN last_index <> 0 THEN 'apply' END AS event FROM s""",
    "t6_alternation_replay": """WITH RECURSIVE p AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS session_id, user_id % 2 = 0 AS automatic, CAST(user_id % 3 + 2 AS INT) AS c, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
      r(session_id, n, i, lim, wraps, c) AS (SELECT DISTINCT session_id, 0::BIGINT, CASE WHEN automatic THEN 1 ELSE 0 END, 2, 0, c FROM p UNION ALL
        SELECT r.session_id, r.n + 1, CASE WHEN r.i + 1 >= least(CASE WHEN r.i + 1 >= least(r.lim, r.c) AND r.wraps >= 1 AND r.lim = 2 AND r.c > 2 THEN 3 ELSE r.lim END, r.c) THEN 0 ELSE r.i + 1 END,
          CASE WHEN r.i + 1 >= least(r.lim, r.c) AND r.wraps >= 1 AND r.lim = 2 AND r.c > 2 THEN 3 ELSE r.lim END, r.wraps + CASE WHEN r.i + 1 >= least(r.lim, r.c) THEN 1 ELSE 0 END, r.c
        FROM r JOIN p ON p.session_id = r.session_id AND p.n = r.n + 1)
      SELECT session_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY n) AS positions FROM r WHERE n > 0 GROUP BY session_id""",
    "t1_keystrokes_to_tokens": f"""WITH RECURSIVE {NUMBERED}, x AS (SELECT user_id, n, ts, CASE WHEN event_type = 'view' THEN ' ' ELSE substr(event_type, 1, 1) END AS ch, event_type = 'error' AS bs FROM ev),
      k(user_id, n, buffer, last, out) AS (SELECT DISTINCT user_id, 0::BIGINT, '', NULL::TIMESTAMP, NULL::VARCHAR FROM x UNION ALL
        SELECT h.user_id, h.n, CASE WHEN bs THEN left(held, greatest(0, length(held) - 1)) WHEN ch = ' ' THEN '' ELSE held || ch END, h.ts, CASE WHEN ch = ' ' AND NOT bs AND held <> '' THEN held END
        FROM (SELECT x.*, CASE WHEN k.last IS NOT NULL AND epoch_us(x.ts) - epoch_us(k.last) > 86400000000 THEN '' ELSE k.buffer END AS held FROM k JOIN x ON x.user_id = k.user_id AND x.n = k.n + 1) h)
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS seq, out AS token FROM k WHERE out IS NOT NULL""",
}
