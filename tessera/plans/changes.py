"""Span, flow and incremental queries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import flow as fl
from tessera.operators import incremental as inc
from tessera.operators import spans as sp
from tessera.plans._tables import read
from tessera.streaming import windows as sw


def offset_to_line(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    size = F.octet_length("text")
    offsets = d.select("doc_id", F.explode(F.array(*(x.cast("long") for x in (F.lit(0), F.floor(size / 3), F.floor(size / 2), size - 1)))).alias("offset")).distinct()
    got = sp.offset_to_line(offsets, sp.line_starts(d))
    return got.withColumn("line", F.col("line").cast("long"))


def span_overlap(spark, sf):
    li = read(spark, sf, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("long")
    spans = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("span_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    ranges = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("range_id"), F.lit(15).cast("long").alias("lo"), F.when(F.col("o_orderkey") % 2 == 0, 15).otherwise(25).cast("long").alias("hi"))
    return sp.overlaps(spans, ranges, 64).select("doc_id", "span_id", "lo", "hi")


def dirty_range(spark, sf):
    c = read(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.select("conv_id", "turn", F.lag("text").over(w).alias("old"), F.col("text").alias("new")).where("old is not null")
    got = pairs.select("conv_id", "turn", F.inline(F.array(sp.dirty_range(F.col("old"), F.col("new")))))
    return got.withColumns({c: F.col(c).cast("long") for c in ("start", "old_end", "new_end")})


def _events(spark, sf):
    e = read(spark, sf, "events")
    action = F.when(F.col("event_type") == "click", "declare").when(F.col("event_type") == "view", "read").otherwise("write")
    kind = F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high")
    return e.select(F.col("user_id").alias("scope"), F.concat(F.lit("v"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string")).alias("name"), F.col("event_id").alias("pos"), action.alias("action"), kind.alias("type"))


def first_write_before_read(spark, sf):
    return fl.read_before_write(_events(spark, sf)).withColumn("first_write", F.coalesce("first_write", F.lit(-1)))


def unused_declared(spark, sf):
    return fl.unused(_events(spark, sf))


def undeclared_used(spark, sf):
    return fl.undeclared(_events(spark, sf))


def duplicate_declarations(spark, sf):
    got = fl.repeated(read(spark, sf, "conversations").select("conv_id", "role", "turn"), "conv_id", "role", "turn")
    return got.withColumn("nth", F.col("nth").cast("long"))


def type_change(spark, sf):
    return fl.type_changes(_events(spark, sf))


def _snapshot(spark, sf, first, last):
    e = read(spark, sf, "events").where(F.dayofyear("ts").between(first, last))
    return e.groupBy(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")).agg(F.max("event_id").cast("string").alias("hash"))


def snapshot_diff(spark, sf):
    """The state after the first half of the year's first month against that after all days; snapshot_diff_daily takes day by day."""
    return inc.snapshot_diff(_snapshot(spark, sf, 1, 15), _snapshot(spark, sf, 1, 366))


def snapshot_diff_daily(spark, sf):
    """The snapshot of every day against that of the day before; before the first day there is nothing."""
    e = read(spark, sf, "events").select(F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), "event_id")
    new = e.groupBy("day", "path").agg(F.max("event_id").cast("string").alias("hash"))
    last = e.agg(F.max("day").alias("last"))
    old = new.withColumn("day", F.col("day") + 1).join(F.broadcast(last), F.col("day") <= F.col("last"))
    return inc.snapshot_diff(old, new, "day")


def impact_rank(spark, sf):
    end = F.when(F.col("event_type") == "error", "/Configuration.xml").when(F.col("event_type") == "click", "/a.xml").when(F.col("event_type") == "view", "/m.bsl").otherwise("/n.txt")
    e = read(spark, sf, "events").select("user_id", inc.impact(end).alias("rank"))
    return e.groupBy("user_id").agg(F.max("rank").cast("long").alias("rank"), F.count(F.lit(1)).alias("changes"))


def upsert_latest(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return inc.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def delete_rows(spark, sf):
    o = read(spark, sf, "orders")
    return inc.delete(o.select("o_orderkey", "o_orderstatus"), o.where("o_orderpriority = '1-URGENT'"), ["o_orderkey"])


def merkle_levels(spark, sf):
    s = read(spark, sf, "supplier").select("s_nationkey", F.sha2("s_name", 256).alias("d"))
    nations = inc.merkle_level(s, "s_nationkey", "d").withColumnRenamed("digest", "d").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return inc.merkle_level(nations, "n_regionkey", "d")


def callers_expand(spark, sf):
    n = read(spark, sf, "nation")
    calls = n.select(F.col("n_nationkey").cast("long").alias("caller"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("callee"))
    touched = n.where("n_regionkey = 2 and n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("routine"))
    return inc.expand_callers(touched, calls).withColumn("depth", F.col("depth").cast("long"))


def plan_fallback(spark, sf):
    e = read(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "view").alias("touched"), F.count(F.lit(1)).alias("total"))
    return inc.rebuild_plan(e)


def tumbling_window_counts(spark, sf):
    got = sw.tumbling(read(spark, sf, "events"), "1 hour")
    return got.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_windows(spark, sf):
    got = sw.sessions(read(spark, sf, "events"), 1800)
    return got.select("user_id", F.col("session").cast("long").alias("session"), "n", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"))


QUERIES = {
    f.__name__: f
    for f in (offset_to_line, span_overlap, dirty_range, first_write_before_read, unused_declared, undeclared_used, duplicate_declarations, type_change, snapshot_diff, snapshot_diff_daily, impact_rank)
    + (upsert_latest, delete_rows, merkle_levels, callers_expand, plan_fallback, tumbling_window_counts, session_windows)
}

_EVENTS = """e AS (SELECT user_id AS scope, 'v' || ((props::JSON ->> '$.k')::INT % 7) AS name, event_id AS pos, CASE event_type WHEN 'click' THEN 'declare' WHEN 'view' THEN 'read' ELSE 'write' END AS action,
  CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS type FROM events)"""
_SNAP = "(SELECT 'f' || user_id AS path, max(event_id)::VARCHAR AS hash FROM events WHERE dayofyear(ts) BETWEEN {} AND {} GROUP BY user_id)"
ORACLE_SQL = {
    "dirty_range": """WITH p AS (SELECT conv_id, turn, hex(encode(lag(text) OVER (PARTITION BY conv_id ORDER BY turn))) AS a, hex(encode(text)) AS b FROM conversations),
      q AS (SELECT *, length(a) // 2 AS n, length(b) // 2 AS m FROM p WHERE a IS NOT NULL),
      s AS (SELECT *, coalesce(list_min(list_filter(range(least(n, m)), lambda i: a[2*i+1:2*i+2] <> b[2*i+1:2*i+2])), least(n, m)) AS pre FROM q),
      t AS (SELECT *, coalesce(list_min(list_filter(range(least(n, m) - pre), lambda i: a[2*(n-i)-1:2*(n-i)] <> b[2*(m-i)-1:2*(m-i)])), least(n, m) - pre) AS suf FROM s)
      SELECT conv_id, turn, pre AS start, n - suf AS old_end, m - suf AS new_end FROM t""",
    "offset_to_line": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
      s AS (SELECT doc_id, line, coalesce(sum(octet_length(encode(body)) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
      o AS (SELECT DISTINCT doc_id, unnest([0, n // 3, n // 2, n - 1]) AS "offset" FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents))
      SELECT o.doc_id, o."offset", arg_max(line, start) AS line, o."offset" - max(start) AS column_no FROM o JOIN s ON o.doc_id = s.doc_id AND start <= o."offset" GROUP BY o.doc_id, o."offset" """,
    "span_overlap": """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS span_id, l_linenumber * 10 AS a, l_linenumber * 10 + trunc(l_quantity)::BIGINT AS b FROM lineitem), r AS (SELECT o_orderkey AS doc_id, 15::BIGINT AS lo, CASE WHEN o_orderkey % 2 = 0 THEN 15 ELSE 25 END::BIGINT AS hi FROM orders)
      SELECT s.doc_id, span_id, lo, hi FROM s JOIN r ON s.doc_id = r.doc_id WHERE CASE WHEN lo = hi THEN a <= lo AND b >= lo ELSE a < hi AND b > lo END""",
    "first_write_before_read": f"""WITH {_EVENTS}, f AS (SELECT scope, name, min(pos) FILTER (action = 'read') AS first_read, min(pos) FILTER (action = 'write') AS first_write FROM e GROUP BY scope, name)
      SELECT scope, name, first_read, coalesce(first_write, -1) AS first_write FROM f WHERE first_read IS NOT NULL AND (first_write IS NULL OR first_read < first_write)""",
    "unused_declared": f"WITH {_EVENTS} SELECT DISTINCT scope, name FROM e WHERE action = 'declare' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.scope = e.scope AND r.name = e.name AND r.action = 'read')",
    "undeclared_used": f"WITH {_EVENTS} SELECT DISTINCT scope, name FROM e WHERE action <> 'declare' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.scope = e.scope AND r.name = e.name AND r.action = 'declare')",
    "duplicate_declarations": "SELECT conv_id, role, turn, nth FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations) WHERE nth > 1",
    "type_change": f"WITH {_EVENTS}, w AS (SELECT scope, name, pos, type, lag(type) OVER (PARTITION BY scope, name ORDER BY pos) AS was FROM e WHERE action = 'write') SELECT scope, name, pos, was, type FROM w WHERE was <> type",
    "snapshot_diff": f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM {_SNAP.format(1, 15)} a FULL JOIN {_SNAP.format(1, 366)} b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash""",
    "snapshot_diff_daily": """WITH s AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS day, 'f' || user_id AS path, max(event_id)::VARCHAR AS hash FROM events GROUP BY ALL),
      o AS (SELECT day + 1 AS day, path, hash FROM s WHERE day < (SELECT max(day) FROM s))
      SELECT coalesce(a.day, b.day) AS day, coalesce(a.path, b.path) AS path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM o a FULL JOIN s b ON a.path = b.path AND a.day = b.day WHERE a.hash IS DISTINCT FROM b.hash""",
    "impact_rank": "SELECT user_id, max(CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END)::BIGINT AS rank, count(*) AS changes FROM events GROUP BY user_id",
    "upsert_latest": "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "delete_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "merkle_levels": """WITH n AS (SELECT s_nationkey AS k, sha256(string_agg(sha256(s_name), '' ORDER BY sha256(s_name))) AS d FROM supplier GROUP BY s_nationkey)
      SELECT n_regionkey, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM n JOIN nation ON k = n_nationkey GROUP BY n_regionkey""",
    "callers_expand": """WITH RECURSIVE c AS (SELECT n_nationkey::BIGINT AS caller, (n_nationkey * 3 + 1) % 25 AS callee FROM nation),
      r AS (SELECT n_nationkey::BIGINT AS routine, 0::BIGINT AS depth FROM nation WHERE n_regionkey = 2 AND n_nationkey < 8 UNION ALL SELECT c.caller, depth + 1 FROM r JOIN c ON r.routine = c.callee WHERE depth < 25)
      SELECT routine, min(depth) AS depth FROM r GROUP BY routine""",
    "plan_fallback": """SELECT *, CASE WHEN total = 0 THEN 'module' WHEN touched > 0.5 * total THEN 'fraction' WHEN touched > 25 THEN 'absolute' ELSE 'partial' END AS plan
      FROM (SELECT user_id AS doc_id, count(*) FILTER (event_type = 'view') AS touched, count(*) AS total FROM events GROUP BY user_id)""",
    "tumbling_window_counts": "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
      SELECT user_id, session::BIGINT AS session, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT AS "end" FROM s GROUP BY user_id, session""",
}
