"""Interval algebra and range joins on the driver tables: users, customers and dates stand for chromosomes and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import intervals as I  # noqa: E741
from lociflow.sources.tables import table


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    """An interval per event: from its second on, one to seven hours long by its type."""
    start = F.unix_seconds("ts")
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 3600 * (1 + F.col("event_id") % 7)).alias("end"))


def _day(c: str):
    return F.floor(F.unix_seconds(c) / 86400)


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge(_visits(spark, sf), ["user_id"])


def interval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return I.gaps(_visits(spark, sf), ["user_id"])


def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    v = _visits(spark, sf)
    return I.subtract(v.where("event_type <> 'purchase' AND event_id % 3 <> 0"), v.where("event_id % 3 = 0"), ["user_id"])


def exclusion_zones(spark: SparkSession, sf: str) -> DataFrame:
    return I.exclusion_zones(_visits(spark, sf), ["user_id"], 1800)


def interval_available(spark: SparkSession, sf: str) -> DataFrame:
    v = _visits(spark, sf)
    return I.available(v.where("event_id % 3 <> 0"), I.exclusion_zones(v.where("event_id % 3 = 0"), ["user_id"], 600), ["user_id"], 5400)


def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.total_length(_visits(spark, sf), ["event_type", "user_id"]).groupBy("event_type").agg(F.sum("intervals").alias("intervals"), F.sum("bases").alias("bases"), F.count(F.lit(1)).alias("users"))


def _shipments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("region"), "l_orderkey", "l_linenumber", _day("l_shipdate").alias("start2"), (_day("l_shipdate") + 7).alias("end2"))


def _order_days(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    """The day of each order, dealt over every supplier or over the first ten."""
    suppliers = F.col("o_custkey") % (table(spark, sf, "supplier").count() if every else 10) + 1
    return table(spark, sf, "orders").select("o_orderkey", suppliers.alias("k"), _day("o_orderdate").alias("pos"))


def point_in_interval(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    """Shipping weeks of a supplier that hold an order's day: their number and earliest start per order."""
    found = I.point_in_interval(_order_days(spark, sf, every), _shipments(spark, sf), ["k"], 14)
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("start2").alias("first_start"))


def interval_overlap(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    left = _order_days(spark, sf, every).withColumnRenamed("pos", "start").withColumn("end", F.col("start") + 3)
    found = I.overlap_join(left, _shipments(spark, sf), ["k"], 14)
    return found.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("end", "end2") - F.greatest("start", "start2")).alias("days"))


def covered_semi(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    """Closed on the right: a shipment that starts on the day when the order's interval ends also covers it."""
    left = _order_days(spark, sf, every).select("o_orderkey", "k", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"), F.col("o_orderkey").alias("_left"))
    return I.overlap_join(left, _shipments(spark, sf).where("region = 'R'"), ["k"], 14, closed=True, how="left_semi").select("o_orderkey")


def proximity_anti(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    """Orders without a returned shipment within two days."""
    left = _order_days(spark, sf, every).select("o_orderkey", "k", F.col("pos").alias("start"), F.col("pos").alias("end"), F.col("o_orderkey").alias("_left"))
    targets = _shipments(spark, sf).where("region = 'R'").select("k", "start2", F.col("start2").alias("end2"))
    near = I.too_close(left, targets, ["k"], 2, 14)
    return left.join(near.select("_left"), "_left", "left_anti").select("o_orderkey")


def classify_priority(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    found = I.classify(_order_days(spark, sf, every), _shipments(spark, sf).drop("l_orderkey", "l_linenumber"), ["k"], 14, ["o_orderkey"], ["R", "A", "N"])
    return found.select("o_orderkey", "region")


def region_bases(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    left = _order_days(spark, sf, every).withColumnRenamed("pos", "start").withColumn("end", F.col("start") + 5)
    regions = I.merge(_shipments(spark, sf).select("k", "region", F.col("start2").alias("start"), F.col("end2").alias("end")), ["k", "region"])
    return I.overlap_bases(left, regions.withColumnsRenamed({"start": "start2", "end": "end2"}), ["k"], 64, ["o_orderkey"])


def smallest_interval(spark: SparkSession, sf: str) -> DataFrame:
    v = _visits(spark, sf)
    points = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.unix_seconds("ts").alias("pos"))
    held = v.select("user_id", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("event_id").alias("visit"))
    return I.smallest_containing(points, held, ["user_id"], 4 * 3600, ["event_id"], "visit")


def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """The purchase at or before each view of the same user."""
    e = table(spark, sf, "events").withColumn("pos", F.unix_micros("ts"))
    right = e.where("event_type = 'purchase'").groupBy("user_id", "pos").agg(F.max("event_id").alias("purchase"))
    return I.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "pos"), right, ["user_id"], "pos", ["purchase"]).select("event_id", "purchase")


def nearest_interval(spark: SparkSession, sf: str, every: bool = True) -> DataFrame:
    targets = _shipments(spark, sf).select("k", "start2", "end2", F.col("region").alias("strand2"))
    return I.nearest(_order_days(spark, sf, every), targets, ["k"]).select("o_orderkey", "distance", "strand")


def cross_fold_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Share of orders with another order of the same supplier key within a day in another fold."""
    df = _order_days(spark, sf).withColumn("fold", F.col("o_orderkey") % 5)
    flagged = df.select("fold", I.neighbours_within(df, ["k"], "pos", 1, "fold").cast("int").alias("near"))
    return flagged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("near"), 9).alias("share"))


def overlap_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the intervals of one event type that touch one of another type, for all pairs of types."""
    v = _visits(spark, sf).withColumn("_left", F.col("event_id"))
    n = v.groupBy(F.col("event_type").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    right = v.select("user_id", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("event_type").alias("b"))
    hit = I.overlap_join(v, right, ["user_id"], 8 * 3600, closed=True).where("event_type <> b").groupBy(F.col("event_type").alias("a"), "b").agg(F.count_distinct("event_id").alias("hits"))
    return hit.join(n, "a").select("a", "b", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("share"))


def tumbling_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per fixed block of the coordinate."""
    blocks = table(spark, sf, "events").select(F.floor(F.unix_seconds("ts") / 21600).alias("block"), "event_type", "value")
    return blocks.groupBy("block", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_merge, interval_gaps, interval_subtract, exclusion_zones, interval_available, region_stats, point_in_interval, interval_overlap, covered_semi, proximity_anti,
        classify_priority, region_bases, smallest_interval, as_of_join, nearest_interval, cross_fold_neighbours, overlap_matrix, tumbling_blocks,
    )
}
_V = """v AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 7) AS e FROM events)"""


def _merged(name: str, source: str, by: str) -> str:
    return f"""{name}_m AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {source}),
        {name}_i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {name}_m),
        {name} AS (SELECT {by}, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY {by}, i)"""


_SHIP = "sh AS (SELECT l_suppkey AS k, l_returnflag AS region, epoch_us(l_shipdate) // 86400000000 AS s2, epoch_us(l_shipdate) // 86400000000 + 7 AS e2 FROM lineitem)"
_ORD = "od AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) + 1 AS k, epoch_us(o_orderdate) // 86400000000 AS pos FROM orders)"


def _difference(left: str, right: str) -> str:
    """Unit-free difference of two merged interval tables a and b, by cutting at all of their ends."""
    return f"""cuts AS (SELECT user_id, s AS p FROM {left} UNION SELECT user_id, e FROM {left} UNION SELECT user_id, s FROM {right} UNION SELECT user_id, e FROM {right}),
        seg AS (SELECT user_id, p AS s, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS e FROM cuts),
        kept AS (SELECT * FROM seg WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM {left} a WHERE a.user_id = seg.user_id AND a.s <= seg.s AND seg.e <= a.e)
            AND NOT EXISTS (SELECT 1 FROM {right} b WHERE b.user_id = seg.user_id AND b.s <= seg.s AND seg.e <= b.e))"""


ORACLES = {
    "interval_merge": f"WITH {_V}, {_merged('m', 'v', 'user_id')} SELECT user_id, s AS start, e AS \"end\" FROM m",
    "interval_gaps": f"WITH {_V}, {_merged('m', 'v', 'user_id')}, g AS (SELECT user_id, e AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS \"end\" FROM m) SELECT * FROM g WHERE \"end\" IS NOT NULL",
    "interval_subtract": f"""
        WITH {_V}, a0 AS (SELECT * FROM v WHERE event_type <> 'purchase' AND event_id % 3 <> 0), b0 AS (SELECT * FROM v WHERE event_id % 3 = 0),
        {_merged('a', 'a0', 'user_id')}, {_merged('b', 'b0', 'user_id')}, {_difference('a', 'b')}, {_merged('f', 'kept', 'user_id')}
        SELECT user_id, s AS start, e AS "end" FROM f""",
    "exclusion_zones": f"WITH {_V}, z AS (SELECT user_id, greatest(0, s - 1800) AS s, e + 1800 AS e FROM v), {_merged('m', 'z', 'user_id')} SELECT user_id, s AS start, e AS \"end\" FROM m",
    "interval_available": f"""
        WITH {_V}, a0 AS (SELECT * FROM v WHERE event_id % 3 <> 0 AND e - s >= 5400), b0 AS (SELECT user_id, greatest(0, s - 600) AS s, e + 600 AS e FROM v WHERE event_id % 3 = 0),
        {_merged('a', 'a0', 'user_id')}, {_merged('b', 'b0', 'user_id')}, {_difference('a', 'b')}, {_merged('f', 'kept', 'user_id')}
        SELECT user_id, s AS start, e AS "end" FROM f WHERE e - s >= 5400""",
    "region_stats": f"WITH {_V}, {_merged('m', 'v', 'event_type, user_id')} SELECT event_type, count(*) AS intervals, sum(e - s)::BIGINT AS bases, count(DISTINCT user_id) AS users FROM m GROUP BY 1",
    "point_in_interval": f"WITH {_SHIP}, {_ORD} SELECT o_orderkey, count(*) AS n, min(s2) AS first_start FROM od JOIN sh ON od.k = sh.k AND s2 <= pos AND pos < e2 GROUP BY 1",
    "interval_overlap": f"WITH {_SHIP}, {_ORD} SELECT o_orderkey, count(*) AS n, sum(least(pos + 3, e2) - greatest(pos, s2))::BIGINT AS days FROM od JOIN sh ON od.k = sh.k AND s2 < pos + 3 AND e2 > pos GROUP BY 1",
    "covered_semi": f"WITH {_SHIP}, {_ORD} SELECT o_orderkey FROM od WHERE EXISTS (SELECT 1 FROM sh WHERE sh.k = od.k AND region = 'R' AND s2 <= pos + 2 AND e2 > pos)",
    "proximity_anti": f"WITH {_SHIP}, {_ORD} SELECT o_orderkey FROM od WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.k = od.k AND region = 'R' AND abs(s2 - pos) <= 2)",
    "classify_priority": f"""
        WITH {_SHIP}, {_ORD}, c AS (SELECT o_orderkey, min(CASE region WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS r FROM od JOIN sh ON od.k = sh.k AND s2 <= pos AND pos < e2 GROUP BY 1)
        SELECT o_orderkey, CASE r WHEN 1 THEN 'R' WHEN 2 THEN 'A' WHEN 3 THEN 'N' END AS region FROM orders LEFT JOIN c USING (o_orderkey)""",
    "region_bases": f"""
        WITH {_SHIP}, {_ORD}, x AS (SELECT k, region, s2 AS s, e2 AS e FROM sh), {_merged('m', 'x', 'k, region')}
        SELECT o_orderkey, region, sum(least(pos + 5, e) - greatest(pos, s))::BIGINT AS bases FROM od JOIN m ON m.k = od.k AND s < pos + 5 AND e > pos GROUP BY 1, 2""",
    "smallest_interval": f"""
        WITH {_V}, p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS pos FROM events WHERE event_type = 'purchase'),
        j AS (SELECT p.event_id, v.event_id AS visit, row_number() OVER (PARTITION BY p.event_id ORDER BY e - s, v.event_id) AS r FROM p JOIN v ON p.user_id = v.user_id AND s <= pos AND pos < e)
        SELECT event_id, visit FROM j WHERE r = 1""",
    "as_of_join": """
        WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
        SELECT v.event_id, p.purchase FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts""",
    "nearest_interval": f"""
        WITH {_SHIP}, {_ORD}, u AS (SELECT k, s2, max(e2) AS e2, arg_max(region, (e2, region)) AS region FROM sh GROUP BY 1, 2),
        b AS (SELECT od.*, u.s2 AS s1, u.e2 AS e1, u.region AS t1 FROM od ASOF LEFT JOIN u ON od.k = u.k AND od.pos >= u.s2),
        f AS (SELECT b.*, u.s2, u.e2, u.region AS t2 FROM b ASOF LEFT JOIN u ON b.k = u.k AND b.pos <= u.s2),
        d AS (SELECT *, CASE WHEN s1 IS NOT NULL THEN greatest(s1 - pos, pos - e1 + 1, 0) END AS d1, CASE WHEN s2 IS NOT NULL THEN greatest(s2 - pos, pos - e2 + 1, 0) END AS d2 FROM f)
        SELECT o_orderkey, CASE WHEN d1 IS NOT NULL AND (d2 IS NULL OR d1 <= d2) THEN d1 ELSE d2 END AS distance, CASE WHEN d1 IS NOT NULL AND (d2 IS NULL OR d1 <= d2) THEN t1 ELSE t2 END AS strand FROM d""",
    "cross_fold_neighbours": f"""
        WITH {_ORD}, f AS (SELECT *, o_orderkey % 5 AS fold FROM od)
        SELECT fold, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.k = f.k AND abs(g.pos - f.pos) <= 1 AND g.fold <> f.fold) THEN 1 ELSE 0 END), 9) AS share FROM f GROUP BY 1""",
    "overlap_matrix": f"""
        WITH {_V}, h AS (SELECT x.event_type AS a, y.event_type AS b, count(DISTINCT x.event_id) AS hits FROM v x JOIN v y ON x.user_id = y.user_id AND y.s <= x.e AND y.e > x.s AND x.event_type <> y.event_type GROUP BY 1, 2)
        SELECT a, b, hits, round(hits / n::DOUBLE, 9) AS share FROM h JOIN (SELECT event_type AS a, count(*) AS n FROM events GROUP BY 1) USING (a)""",
    "tumbling_blocks": "SELECT epoch_us(ts) // 21600000000 AS block, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
