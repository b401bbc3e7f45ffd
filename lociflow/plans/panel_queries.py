"""Panels, window builders and nested models on the driver tables: flags, brands and suppliers stand for datasets and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators import contribution, folds, panels, windows
from lociflow.plans.sequence_queries import _SEQ, _rna
from lociflow.sources.tables import table

#: Motifs of the enrichment query.
MOTIFS = ("an", "er", "st", "zq")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as windows: the flag is the dataset, the order the pair and the fold, odd lines the positives."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") % 2).alias("label"), folds.role(F.col("l_orderkey") % 5, 4, 5).alias("role"),
        F.col("l_discount").alias("gc"), F.concat(F.lit("r"), F.col("l_suppkey") % 4).alias("region"), "l_quantity", "l_extendedprice", "l_linestatus",
    )


def panel_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = panels.panel_summary(_panel(spark, sf), "dataset", "pair", "label", "role", "gc", "region")
    return _rounded(found, 6, "share_train", "share_val", "share_test", "mean_pos", "mean_neg", "gap_mean", "gap_p95", "top_share")


def motif_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id").where("text IS NOT NULL")
    return _rounded(panels.motif_enrichment(docs, ["lang"], "quality", "text", MOTIFS), 9, "pos", "neg", "ratio")


def split_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(panels.split_shift(_panel(spark, sf), "dataset", "role", "gc", "region"), 6, "value_shift", "region_shift")


def peak_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = panels.peak_stats(_panel(spark, sf), "dataset", F.col("l_quantity"), 25, "l_extendedprice", F.col("l_linestatus") == "O")
    return _rounded(found, 6, "above", "signal_median", "signal_p90", "plus_share")


def draw_variance(spark: SparkSession, sf: str) -> DataFrame:
    found = panels.draw_variance(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice", 10, 5, "draw")
    return _rounded(found, 3, "between_draws", "between_groups")


def fold_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Shared five-word grams of all folds at once, and what cutting at 0 and a half would remove, pairs included."""
    words = F.filter(F.split(F.lower("text"), r"[^\pL\pN]+"), lambda x: x != "")
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5).alias("fold"), words.alias("w"))
    spots = F.when(F.size("w") >= 5, F.sequence(F.lit(1), F.size("w") - 4))
    docs = docs.select("doc_id", "fold", F.transform(spots, lambda i: F.array_join(F.slice("w", i, 5), " ")).alias("grams"))
    profile = panels.shared_across_folds(docs, "doc_id", "fold", "grams").withColumn("pair", F.floor(F.col("doc_id") / 10))
    return _rounded(panels.filter_effect(profile, "fold", "pair", (0.0, 0.5)), 9, "mean_share")


def positive_windows(spark: SparkSession, sf: str) -> DataFrame:
    peaks = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("region")
    )
    limits = table(spark, sf, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("unit"), (100 + F.col("s_suppkey") * 20).alias("limit"))
    found = windows.positive_windows(peaks, limits, "unit", 101, "region", ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.col("w0").cast("long").alias("w0"), "reason")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("p_partkey") * 1000
    return table(spark, sf, "part").select("p_brand", at.alias("start"), (at + F.col("p_size") * 15).alias("end"))


def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    return windows.candidate_pool(_places(spark, sf), "p_brand", 101, 50, 200, "pool")


def sample_negative(spark: SparkSession, sf: str) -> DataFrame:
    """Forty hashed tries for each order, compared in a share between 0 and 1."""
    tries = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("attempt"))
    gap = F.abs(windows.hash_number(F.lit("try"), F.col("o_orderkey"), F.col("attempt")) % 10000 - F.col("o_custkey") * 7 % 10000) / 10000
    return windows.accepted(tries.withColumn("gap", gap), "o_orderkey", "attempt", "gap", 0.02, 25)


def mono_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    shuffled = windows.letters_shuffled(F.col("seq"), F.col("item_id"), "mono")
    return _rna(spark, sf, whole=True).select(F.col("item_id").alias("doc_id"), F.md5(shuffled.cast("binary")).alias("shuffled_md5"), F.length("seq").cast("long").alias("n"))


def overlapping_features(spark: SparkSession, sf: str) -> DataFrame:
    """Shipping weeks that each order's first five days overlap, at the supplier that its customer is dealt to."""
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    shipped = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_returnflag", day("l_shipdate").alias("start2"), (day("l_shipdate") + 7).alias("end2"))
    supplier = F.col("o_custkey") % table(spark, sf, "supplier").count() + 1
    orders = table(spark, sf, "orders").select("o_orderkey", supplier.alias("k"), day("o_orderdate").alias("start"), (day("o_orderdate") + 5).alias("end"))
    found = windows.overlapping(orders, shipped, ["k"], 32, ["o_orderkey"], "l_returnflag")
    return found.select("o_orderkey", "n", F.concat_ws(",", "names").alias("names"), (F.size("names") == 1).alias("one_kind"))


_WEIGHTS = {a + b: float((3 * i + 5 * j) % 7) for i, a in enumerate("ACGU") for j, b in enumerate("ACGU")}


def saturation_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = windows.saturation_profile(_rna(spark, sf), "item_id", F.col("seq"), _WEIGHTS, "ACGU")
    return _rounded(windows.locality(profile, "item_id", "effect"), 6, "mean_effect", "top_share")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    scale = {"qty": F.col("l_quantity") / 50, "disc": F.col("l_discount") * 10, "price": F.col("l_extendedprice") / 100_000}
    label = ((F.col("l_quantity") + F.col("l_partkey") % 60 + F.col("l_discount") * 100) > 55).cast("int")
    return table(spark, sf, "lineitem").select(*[v.alias(c) for c, v in scale.items()], (F.col("l_orderkey") % 5).cast("int").alias("fold"), label.alias("y"))


def nested_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return contribution.nested_contribution(_labelled(spark, sf), ["qty"], ["disc"], "y", "fold", 5)


def likelihood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return contribution.likelihood_ratio(_labelled(spark, sf), ["qty"], ["disc", "price"], "y")


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return contribution.all_pairs(_labelled(spark, sf), ["qty", "disc", "price"], "y")


QUERIES = {
    f.__name__: f
    for f in (
        panel_summary, motif_enrichment, split_shift, peak_stats, draw_variance, fold_leakage, positive_windows, candidate_pool, sample_negative, mono_shuffle, overlapping_features, saturation_profile,
        nested_contribution, likelihood_ratio, all_pairs,
    )
}

_PANEL = """(SELECT l_returnflag AS dataset, l_orderkey AS pair, l_linenumber % 2 AS label, CASE l_orderkey % 5 WHEN 4 THEN 'test' WHEN 0 THEN 'val' ELSE 'train' END AS role,
    l_discount AS gc, 'r' || l_suppkey % 4 AS region, l_quantity, l_extendedprice, l_linestatus FROM lineitem)"""
_HASH = "('0x' || substr(md5({x}), 1, 12))::BIGINT"
_FIVE = "SELECT doc_id, doc_id % 5 AS fold, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM documents"
_MOTIFS = "(VALUES " + ", ".join(f"('{m}')" for m in MOTIFS) + ") AS m(motif)"

ORACLES = {
    "panel_summary": f"""
        WITH p AS (SELECT * FROM {_PANEL}), g AS (SELECT dataset, pair, abs(avg(gc) FILTER (label = 1) - avg(gc) FILTER (label = 0)) AS gap FROM p GROUP BY 1, 2),
        a AS (SELECT dataset, count(*) AS n_rows, avg((role = 'train')::INT) AS st, avg((role = 'val')::INT) AS sv, avg((role = 'test')::INT) AS se, avg(gc) FILTER (label = 1) AS mp, avg(gc) FILTER (label = 0) AS mn FROM p GROUP BY 1),
        b AS (SELECT dataset, count(*) AS n_pairs, avg(gap) AS ga, quantile_cont(gap, 0.95) AS gp FROM g GROUP BY 1),
        r AS (SELECT dataset, region, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY dataset) AS share FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, region) = 1)
        SELECT dataset, n_rows, n_pairs, round(st, 6) AS share_train, round(sv, 6) AS share_val, round(se, 6) AS share_test, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg,
            round(ga, 6) AS gap_mean, round(gp, 6) AS gap_p95, region AS top_region, round(share, 6) AS top_share FROM a JOIN b USING (dataset) JOIN r USING (dataset)""",
    "motif_enrichment": f"""
        WITH s AS (SELECT lang, motif, avg(contains(text, motif)::INT) FILTER (quality = 1) AS pos, avg(contains(text, motif)::INT) FILTER (quality <> 1) AS neg
            FROM documents JOIN labels USING (doc_id) CROSS JOIN {_MOTIFS} WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)
        SELECT lang, motif, round(pos, 9) AS pos, round(neg, 9) AS neg, round(CASE WHEN neg = 0 THEN 'inf'::DOUBLE ELSE pos / neg END, 9) AS ratio FROM s""",
    "split_shift": f"""
        WITH p AS (SELECT * FROM {_PANEL}), c AS (SELECT dataset, region, count(*) FILTER (role = 'train') AS a, count(*) FILTER (role = 'test') AS b FROM p GROUP BY 1, 2),
        d AS (SELECT dataset, sum(abs(s)) / 2 AS shift FROM (SELECT dataset, a::DOUBLE / sum(a) OVER w - b::DOUBLE / sum(b) OVER w AS s FROM c WINDOW w AS (PARTITION BY dataset)) GROUP BY 1)
        SELECT dataset, round(avg(gc) FILTER (role = 'train') - avg(gc) FILTER (role = 'test'), 6) AS value_shift, round(any_value(shift), 6) AS region_shift FROM p JOIN d USING (dataset) GROUP BY 1""",
    "peak_stats": f"""
        SELECT dataset, count(*) AS n, trunc(quantile_cont(l_quantity, 0.5))::BIGINT AS width_median, trunc(quantile_cont(l_quantity, 0.1))::BIGINT AS width_p10, trunc(quantile_cont(l_quantity, 0.9))::BIGINT AS width_p90,
            trunc(max(l_quantity))::BIGINT AS width_max, round(avg((l_quantity > 25)::INT), 6) AS above, round(quantile_cont(l_extendedprice, 0.5), 6) AS signal_median, round(quantile_cont(l_extendedprice, 0.9), 6) AS signal_p90,
            round(avg((l_linestatus = 'O')::INT), 6) AS plus_share FROM {_PANEL} GROUP BY 1""",
    "draw_variance": f"""
        WITH d AS (SELECT o_orderpriority AS g, o_orderkey AS k, o_totalprice AS v, unnest(range(10)) AS draw FROM orders),
        m AS (SELECT g, draw, avg(v) AS m FROM d WHERE {_HASH.format(x="'draw|' || draw || '|' || k")} % 5 = 0 GROUP BY 1, 2),
        s AS (SELECT g, var_samp(m) AS within, avg(m) AS m FROM m GROUP BY 1)
        SELECT count(*) AS groups, round(avg(within), 3) AS between_draws, round(var_samp(m), 3) AS between_groups FROM s""",
    "fold_leakage": f"""
        WITH w AS ({_FIVE}), g AS (SELECT DISTINCT doc_id, fold, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
        x AS (SELECT g FROM g GROUP BY g HAVING min(fold) <> max(fold)), s AS (SELECT doc_id, avg((x.g IS NOT NULL)::INT) AS share FROM g LEFT JOIN x USING (g) GROUP BY 1),
        p AS (SELECT doc_id, doc_id % 5 AS fold, doc_id // 10 AS pair, coalesce(share, 0) AS share FROM documents LEFT JOIN s USING (doc_id)),
        q AS (SELECT fold, pair, count(*) AS n, sum(share) AS s, max(share) AS m, count(*) FILTER (share > 0) AS r0, count(*) FILTER (share > 0.5) AS r5 FROM p GROUP BY 1, 2)
        SELECT fold, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 9) AS mean_share, sum(r0)::BIGINT AS rows_above_0, count(*) FILTER (m > 0) AS pairs_above_0, sum(r5)::BIGINT AS rows_above_50, count(*) FILTER (m > 0.5) AS pairs_above_50 FROM q GROUP BY 1""",
    "positive_windows": """
        WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey AS unit, (2 * l_partkey + l_quantity::BIGINT) // 2 - 50 AS w0, CASE WHEN l_tax > 0 THEN l_returnflag END AS region FROM lineitem),
        l AS (SELECT s_suppkey AS unit, 100 + s_suppkey * 20 AS lim FROM supplier WHERE s_suppkey % 10 <> 0),
        r AS (SELECT p.*, CASE WHEN lim IS NULL THEN 'unit' WHEN w0 < 0 OR w0 + 101 > lim THEN 'bounds' WHEN region IS NULL THEN 'region' END AS reason FROM p LEFT JOIN l USING (unit))
        SELECT l_orderkey, l_linenumber, w0, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY unit, w0, reason ORDER BY l_orderkey, l_linenumber) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r""",
    "candidate_pool": f"""
        WITH i AS (SELECT p_brand, p_partkey * 1000 AS start, p_size * 15 - 100 AS span FROM part WHERE p_size * 15 > 100),
        r AS (SELECT *, (sum(span) OVER (PARTITION BY p_brand ORDER BY start) - span)::BIGINT AS lo FROM i), t AS (SELECT p_brand, sum(span)::BIGINT AS total FROM i GROUP BY 1),
        d AS (SELECT p_brand, draw, {_HASH.format(x="'pool|' || p_brand || '|' || draw")} % total AS at_ FROM (SELECT *, unnest(range(200)) AS draw FROM t)),
        f AS (SELECT d.p_brand, r.start + d.at_ - r.lo AS start, min(draw) AS draw FROM d JOIN r ON d.p_brand = r.p_brand AND d.at_ >= r.lo AND d.at_ < r.lo + r.span GROUP BY 1, 2)
        SELECT p_brand, start, draw FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY draw) <= 50""",
    "sample_negative": f"""
        WITH t AS (SELECT o_orderkey, o_custkey, unnest(range(40)) AS attempt FROM orders),
        g AS (SELECT o_orderkey, attempt, abs({_HASH.format(x="'try|' || o_orderkey || '|' || attempt")} % 10000 - o_custkey * 7 % 10000) / 10000::DOUBLE AS gap FROM t),
        a AS (SELECT *, gap > CASE WHEN attempt < 25 THEN 0.02::DOUBLE ELSE 0.04::DOUBLE END AS missed FROM g WHERE gap <= 3 * 0.02::DOUBLE)
        SELECT o_orderkey, attempt, gap, missed AS fallback FROM a QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY missed, CASE WHEN missed THEN gap ELSE 0 END, attempt) = 1""",
    "mono_shuffle": f"""
        WITH s AS (SELECT doc_id, {_SEQ} AS seq FROM documents), l AS (SELECT doc_id, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS i FROM s WHERE seq <> ''),
        j AS (SELECT doc_id, string_agg(c, '' ORDER BY md5('mono|' || doc_id || '|' || i), c) AS x FROM l GROUP BY 1)
        SELECT doc_id, CASE WHEN seq IS NOT NULL THEN md5(coalesce(x, '')) END AS shuffled_md5, length(seq)::BIGINT AS n FROM s LEFT JOIN j USING (doc_id)""",
    "overlapping_features": """
        WITH s AS (SELECT l_suppkey AS k, l_returnflag AS f, epoch(l_shipdate)::BIGINT // 86400 AS s2 FROM lineitem),
        o AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) + 1 AS k, epoch(o_orderdate)::BIGINT // 86400 AS s FROM orders),
        m AS (SELECT o_orderkey, count(*) AS n, string_agg(DISTINCT f, ',' ORDER BY f) AS names, count(DISTINCT f) AS kinds FROM o JOIN s ON o.k = s.k AND s2 < o.s + 5 AND s2 + 7 > o.s GROUP BY 1)
        SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(names, '') AS names, coalesce(kinds, 0) = 1 AS one_kind FROM o LEFT JOIN m USING (o_orderkey)""",
    "saturation_profile": f"""
        WITH b AS (SELECT item_id, {_SEQ} AS seq FROM benchmark), l AS (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM b WHERE seq <> ''),
        n AS (SELECT item_id, i, length(seq) AS n, strpos('ACGU', substr(seq, i, 1)) - 1 AS c, CASE WHEN i > 1 THEN strpos('ACGU', substr(seq, i - 1, 1)) - 1 END AS a, CASE WHEN i < length(seq) THEN strpos('ACGU', substr(seq, i + 1, 1)) - 1 END AS z FROM l),
        e AS (SELECT item_id, n, i, sum(abs(coalesce((3 * a + 5 * x) % 7, 0) + coalesce((3 * x + 5 * z) % 7, 0) - coalesce((3 * a + 5 * c) % 7, 0) - coalesce((3 * c + 5 * z) % 7, 0))) / 3::DOUBLE AS effect
            FROM n CROSS JOIN (SELECT unnest(range(4)) AS x) GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY effect DESC) AS r FROM e)
        SELECT item_id, count(*) AS positions, round(avg(effect), 6) AS mean_effect, round(coalesce(sum(effect) FILTER (r <= ceil(0.1 * n)), 0) / nullif(sum(effect), 0), 6) AS top_share FROM r GROUP BY 1""",
}
