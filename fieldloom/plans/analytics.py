"""Queries over windows and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import aggregates as agg
from fieldloom.operators import windows as win
from fieldloom.plans.tables import points, read, track

FLAG_PRIORITY = {"R": 100, "A": 90, "N": 70}


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("l_returnflag") == "R", 100).when(F.col("l_returnflag") == "A", 90).otherwise(70)
    rows = read(spark, d, "lineitem").withColumn("priority", priority)
    source = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return win.resolve_priority(rows, ["l_partkey"], F.col("priority"), F.when(F.col("l_discount") > 0, F.col("l_discount")), F.col("l_quantity"), source)


def priority_per_part(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).filter("rank = 1").select("l_partkey", "l_orderkey", "l_linenumber", "priority")


def priority_conflicts(spark: SparkSession, d: str) -> DataFrame:
    found = win.conflicts(_candidates(spark, d), ["l_partkey"], "l_extendedprice", 5000.0)
    return found.groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("highest"))


def duplicate_numbering(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("same"))
    n = win.number_occurrences(docs, ["same"], ["doc_id"])
    return n.select("doc_id", F.when(F.col("occurrence") > 1, F.concat("same", F.lit("#duplicate-"), F.col("occurrence").cast("string"))).otherwise(F.col("same")).alias("id"))


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return win.first_wins(read(spark, d, "documents").select("doc_id", F.md5("text").alias("same")), ["same"], ["doc_id"])


def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return win.newest(read(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return win.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def state_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    runs = win.runs_of_equal(rows, ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return win.transitions(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "before", "event_type")


def interaction_intervals(spark: SparkSession, d: str) -> DataFrame:
    clearance = F.col("value") - 50
    status = F.when(clearance >= 2, "elevated").when(clearance >= -0.75, "near-grade").when(clearance <= -1.5, "tunnel").otherwise("cutting")
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", status.alias("status"))
    runs = win.runs_of_equal(rows, ["user_id"], ["ts", "event_id"], "status")
    return runs.groupBy("user_id", "run", "status").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n")).filter("t1 > t0").select("user_id", "run", "status", "n")


def span_runs(spark: SparkSession, d: str) -> DataFrame:
    cells = points(spark, d).select("kind", F.floor(F.col("x") / 10).cast("bigint").alias("cx")).distinct()
    return win.spans(cells, ["kind"], "cx")


def short_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    done = win.fill_gaps(track(spark, d), ["track_id"], "measure", "elevation", 60.0)
    return done.select("track_id", "seq", half_up(F.col("filled"), 4).alias("filled"), "evidence")


def lead_pair_segments(spark: SparkSession, d: str) -> DataFrame:
    return win.segments(track(spark, d), ["track_id"], "measure", "elevation", 40.0)


def value_at_measure(spark: SparkSession, d: str) -> DataFrame:
    known = win.segments(track(spark, d), ["track_id"], "measure", "elevation", 40.0).filter("status = 'supported'")
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), (F.pmod(F.col("o_custkey"), F.lit(60)) + 0.5).alias("asked_at"))
    return win.value_at(asked, known, ["track_id"], "asked_at").select("track_id", "asked_at", half_up(F.col("value"), 4).alias("value"))


def resampled(spark: SparkSession, d: str) -> DataFrame:
    lines = track(spark, d).groupBy("track_id").agg(F.min("measure").alias("low"), F.max("measure").alias("high"))
    return win.resample(lines, ["track_id"], "low", "high", 25.0)


def tunnel_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = track(spark, d).withColumn("covered", F.coalesce(F.col("elevation") < 20000, F.lit(False)))
    return win.fill_between_flags(rows, ["track_id"], "seq", "covered").select("track_id", "seq", "inside")


def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return agg.counts_by(read(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") > 5, F.col("p_brand"))), "p_brand")


def grouping_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    return rows.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


def weighted_coverage(spark: SparkSession, d: str) -> DataFrame:
    return agg.coverage(read(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_returnflag") == "R")


def height_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return agg.height_statistics(read(spark, d, "lineitem").withColumn("h", F.col("l_extendedprice") / 1000), ["l_suppkey"], "h")


def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = agg.plane(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount", "l_extendedprice")
    return fit.select("l_suppkey", "n", *(F.round(c, 3).alias(c) for c in "abc"), F.round("r2", 5).alias("r2"))


def height_bins(spark: SparkSession, d: str) -> DataFrame:
    bins = agg.binned(read(spark, d, "lineitem").withColumn("h", F.col("l_extendedprice") / 100), ["l_suppkey"], "h", 50.0)
    return win.top_per_group(bins, ["l_suppkey"], [F.desc("n"), F.asc("bin")], 8)


def dominant_evidence(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return agg.dominant(read(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", rank)


def accuracy_grades(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    seen = read(spark, d, "orders").groupBy("o_custkey").agg(
        share(F.col("o_orderstatus") == "F").alias("boundary"), share(F.col("o_totalprice") > 100000).alias("planimetry"),
        share(F.col("o_orderpriority") < "3").alias("rides"), share(F.col("o_orderstatus") != "P").alias("structures"),
        share(F.col("o_totalprice") < 400000).alias("terrain"), agg.freshness(F.datediff(F.lit("1998-08-01"), F.max("o_orderdate"))).alias("freshness"),
    )
    score, grade = agg.graded({k: F.col(k) for k in agg.WEIGHTS}, F.col("boundary") == 0)
    return seen.select("o_custkey", score.alias("score"), grade.alias("grade"))


QUERIES = {f.__name__: f for f in (priority_per_part, priority_conflicts, duplicate_numbering, first_wins, newest_per_key, top_orders, state_runs, state_transitions, interaction_intervals, span_runs, short_gap_fill, lead_pair_segments, value_at_measure, resampled, tunnel_fill, count_by_kind, grouping_summary, weighted_coverage, height_percentiles, plane_fit, height_bins, dominant_evidence, accuracy_grades)}

_RANKED = """SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY priority DESC, coalesce(CASE WHEN l_discount > 0 THEN l_discount END, -1) DESC, l_quantity, l_orderkey || ':' || l_linenumber) AS rank
FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 100 WHEN 'A' THEN 90 ELSE 70 END AS priority FROM lineitem)"""
_TRACK = """(SELECT l_orderkey AS track_id, CAST(row_number() OVER w AS INT) AS seq, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS measure, CASE WHEN l_discount <> 0.05 THEN l_extendedprice END AS elevation
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""
_SEGMENTS = f"""SELECT track_id, measure AS start_measure, end_measure, elevation AS start_value, end_value, floor((end_value - elevation) / (end_measure - measure) * 1e6 + 0.5) / 1e6 AS gradient,
 CASE WHEN end_measure - measure > 40 THEN 'unsupported-gap' ELSE 'supported' END AS status
FROM (SELECT *, lead(measure) OVER w AS end_measure, lead(elevation) OVER w AS end_value FROM {_TRACK} WHERE elevation IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY measure)) WHERE end_measure > measure"""
_RUNS = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT *, CASE WHEN lag({s}) OVER w IS NOT DISTINCT FROM {s} AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

ORACLE_SQL = {
    "priority_per_part": f"SELECT l_partkey, l_orderkey, l_linenumber, priority FROM ({_RANKED}) WHERE rank = 1",
    "priority_conflicts": f"SELECT l_partkey, count(*) AS n, max(l_extendedprice) AS highest FROM (SELECT *, max(CASE WHEN rank = 1 THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS won FROM ({_RANKED})) WHERE rank > 1 AND abs(l_extendedprice - won) > 5000 GROUP BY l_partkey",
    "duplicate_numbering": "SELECT doc_id, CASE WHEN n > 1 THEN same || '#duplicate-' || n ELSE same END AS id FROM (SELECT doc_id, md5(text) AS same, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)",
    "first_wins": "SELECT min(doc_id) AS doc_id, md5(text) AS same FROM documents GROUP BY text",
    "newest_per_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER w AS INT) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY place <= 3",
    "state_runs": f"SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM ({_RUNS.format(s='event_type', src='events')}) GROUP BY ALL",
    "state_transitions": "SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR before <> event_type",
    "interaction_intervals": "SELECT user_id, CAST(run AS BIGINT) AS run, status, n FROM (SELECT user_id, run, status, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM (" + _RUNS.format(s="status", src="(SELECT user_id, ts, event_id, CASE WHEN value - 50 >= 2 THEN 'elevated' WHEN value - 50 >= -0.75 THEN 'near-grade' WHEN value - 50 <= -1.5 THEN 'tunnel' ELSE 'cutting' END AS status FROM events)") + ") GROUP BY ALL) WHERE t1 > t0",
    "span_runs": "SELECT kind, min(cx) AS first, max(cx) AS last, count(*) AS n FROM (SELECT *, cx - row_number() OVER (PARTITION BY kind ORDER BY cx) AS island FROM (SELECT DISTINCT label AS kind, CAST(floor(floor(CAST(embedding[1] AS DOUBLE) * 1000) / 10) AS BIGINT) AS cx FROM embeddings)) GROUP BY kind, island",
    "short_gap_fill": f"""
WITH t AS (SELECT *, last_value(CASE WHEN elevation IS NOT NULL THEN measure END IGNORE NULLS) OVER a AS am, last_value(elevation IGNORE NULLS) OVER a AS av,
 first_value(CASE WHEN elevation IS NOT NULL THEN measure END IGNORE NULLS) OVER b AS bm, first_value(elevation IGNORE NULLS) OVER b AS bv FROM {_TRACK}
 WINDOW a AS (PARTITION BY track_id ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY track_id ORDER BY measure ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, CASE WHEN bm - am <= 60 THEN av + (bv - av) * (measure - am) / nullif(bm - am, 0) END AS inner_v FROM t)
SELECT track_id, seq, floor(coalesce(elevation, inner_v) * 10000 + 0.5) / 10000 AS filled, CASE WHEN elevation IS NOT NULL THEN 'observed' WHEN inner_v IS NOT NULL THEN 'interpolated' ELSE 'unresolved' END AS evidence FROM u""",
    "lead_pair_segments": _SEGMENTS,
    "value_at_measure": f"""
WITH s AS (SELECT * FROM ({_SEGMENTS}) WHERE status = 'supported'), q AS (SELECT o_orderkey AS track_id, o_custkey % 60 + 0.5::DOUBLE AS asked_at FROM orders)
SELECT q.track_id, q.asked_at, floor(arg_min(start_value + (end_value - start_value) * (asked_at - start_measure) / (end_measure - start_measure), start_measure) * 10000 + 0.5) / 10000 AS value
FROM q LEFT JOIN s ON s.track_id = q.track_id AND q.asked_at BETWEEN start_measure AND end_measure GROUP BY q.track_id, q.asked_at""",
    "resampled": f"SELECT DISTINCT track_id, unnest(list_append([low + 25.0::DOUBLE * i FOR i IN range(0, CAST(floor((high - low) / 25) AS BIGINT) + 1)], high)) AS measure FROM (SELECT track_id, min(measure) AS low, max(measure) AS high FROM {_TRACK} GROUP BY track_id)",
    "tunnel_fill": f"SELECT track_id, seq, coalesce(seq BETWEEN min(CASE WHEN elevation < 20000 THEN seq END) OVER w AND max(CASE WHEN elevation < 20000 THEN seq END) OVER w, false) AS inside FROM {_TRACK} WINDOW w AS (PARTITION BY track_id)",
    "count_by_kind": "SELECT coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'unknown') AS p_brand, count(*) AS n FROM part GROUP BY 1",
    "grouping_summary": "SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS level, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "weighted_coverage": "SELECT l_suppkey, CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 1000 + 0.5) / 1000 END AS coverage FROM lineitem GROUP BY 1",
    "height_percentiles": """
SELECT l_suppkey, n, height, spread, CASE WHEN n >= 4 THEN least(0.99::DOUBLE, floor((0.7::DOUBLE + 0.2 * least(1.0, log2(n + 1) / 7) + 0.1 * greatest(0.0, 1 - spread / greatest(6.0, height))) * 1000 + 0.5) / 1000) ELSE 0.99 END AS confidence FROM (
SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) >= 4 THEN floor(quantile_cont(l_extendedprice / 1000, 0.65) * 10 + 0.5) / 10 END AS height,
 CASE WHEN count(*) >= 4 THEN floor((quantile_cont(l_extendedprice / 1000, 0.9) - quantile_cont(l_extendedprice / 1000, 0.1)) * 10 + 0.5) / 10 END AS spread FROM lineitem GROUP BY 1)""",
    "plane_fit": """
WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, n, mx, my, mz, sum((l_quantity-mx)*(l_quantity-mx)) AS xx, sum((l_quantity-mx)*(l_discount-my)) AS xy, sum((l_discount-my)*(l_discount-my)) AS yy,
 sum((l_quantity-mx)*(l_extendedprice-mz)) AS xz, sum((l_discount-my)*(l_extendedprice-mz)) AS yz, sum((l_extendedprice-mz)*(l_extendedprice-mz)) AS zz FROM lineitem JOIN m USING (l_suppkey) GROUP BY ALL),
f AS (SELECT *, CASE WHEN xx*yy-xy*xy > 1e-9*xx*yy THEN (xz*yy-yz*xy)/(xx*yy-xy*xy) END AS a, CASE WHEN xx*yy-xy*xy > 1e-9*xx*yy THEN (yz*xx-xz*xy)/(xx*yy-xy*xy) END AS b FROM s)
SELECT l_suppkey, n, round(a, 3) AS a, round(b, 3) AS b, round(mz - a*mx - b*my, 3) AS c, round(CASE WHEN zz > 0 THEN (a*xz + b*yz) / zz END, 5) AS r2 FROM f""",
    "height_bins": "SELECT l_suppkey, bin, n, median, CAST(row_number() OVER w AS INT) AS place FROM (SELECT l_suppkey, CAST(floor(l_extendedprice / 100 / 50 + 0.5) AS BIGINT) AS bin, count(*) AS n, quantile_cont(l_extendedprice / 100, 0.5) AS median FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_suppkey ORDER BY n DESC, bin) QUALIFY place <= 8",
    "dominant_evidence": "SELECT l_partkey, l_returnflag AS dominant, n FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END DESC) = 1",
    "accuracy_grades": """
WITH c AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS boundary, avg(CASE WHEN o_totalprice > 100000 THEN 1.0::DOUBLE ELSE 0 END) AS planimetry, avg(CASE WHEN o_orderpriority < '3' THEN 1.0::DOUBLE ELSE 0 END) AS rides,
 avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0::DOUBLE ELSE 0 END) AS structures, avg(CASE WHEN o_totalprice < 400000 THEN 1.0::DOUBLE ELSE 0 END) AS terrain, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-01') AS age FROM orders GROUP BY 1),
s AS (SELECT *, floor((0.0::DOUBLE + 0.18::DOUBLE*boundary + 0.24::DOUBLE*planimetry + 0.22::DOUBLE*rides + 0.16::DOUBLE*structures + 0.14::DOUBLE*terrain + 0.06::DOUBLE * (CASE WHEN age <= 180 THEN 1.0 WHEN age <= 730 THEN 0.75 WHEN age <= 1825 THEN 0.5 ELSE 0.2 END)::DOUBLE) * 1000 + 0.5) / 1000 AS score FROM c)
SELECT o_custkey, score, CASE WHEN score >= 0.9 AND boundary > 0 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.65 THEN 'C' WHEN score >= 0.5 THEN 'D' ELSE 'E' END AS grade FROM s""",
}
