"""Aggregates, ranks, statistics, models, samples, folds and audits on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.operators import aggregates as A
from lociflow.operators import audit, folds, graphs, models, ordinals, rankstats, sampling, stats
from lociflow.sources.tables import table


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def gini(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.gini(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), 9, "gini")


def category_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.shares(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority"), 9, "share")


def shares_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = A.shares_wide(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", ["R", "A", "N"])
    return _round(wide, 9, "share_R", "share_A", "share_N")


def mean_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return _round(wide.withColumnsRenamed({"F": "mean_f", "O": "mean_o"}), 9, "mean_f", "mean_o")


def redundancy(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("t", F.md5(F.col("text").cast("binary")))
    return _round(A.redundancy(docs, "t", ["lang"], F.col("doc_id") % 2 == 0), 9, "redundancy", "redundancy_pos")


def effect_size(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return _round(A.effect_size(joined, "n_chars", "quality", ["lang"]), 6, "d", "smd")


def trimmed_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.trimmed_mean(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]), 4, "trimmed_mean")


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.quantiles(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"], [0.1, 0.5, 0.9]), 6, "q10", "q50", "q90")


def group_spread(spark: SparkSession, sf: str) -> DataFrame:
    """n, mean and sample deviation per group."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean"), F.stddev_samp("l_discount").alias("sd"))
    return _round(g, 9, "mean", "sd")


def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("v"))
    return _round(A.leave_one_out(df, "v", ["o_custkey"]).select("o_orderkey", "rate"), 6, "rate")


def largest_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") - 25).alias("delta"))
    return A.largest_magnitude(df, ["l_partkey"], "delta", "ord")


def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.mutual_information(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"), 9, "mi")


def top3_share(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.top_share(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"], 3), 9, "share")


def with_all(spark: SparkSession, sf: str) -> DataFrame:
    return _round(A.with_all(table(spark, sf, "customer"), "c_mktsegment", [F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")]), 6, "mean")


def mass_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by segment and region over the chain of dimensions."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = table(spark, sf, "customer").join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), F.col("c_nationkey") == n["n_nationkey"])  # 25 nations
    return joined.groupBy("c_mktsegment", "r_name").agg(F.count(F.lit(1)).alias("n"))


def midrank(spark: SparkSession, sf: str) -> DataFrame:
    return ordinals.midranks(table(spark, sf, "part"), "p_size", ["p_brand"]).select("p_partkey", "rank")


def rank_within(spark: SparkSession, sf: str) -> DataFrame:
    """Rank scaled to [0, 1] inside each group, one half for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy("p_brand"))
    scaled = F.when(n == 1, F.lit(0.5)).otherwise((rankstats.midrank(F.col("p_size"), ["p_brand"]) - 1) / (n - 1))
    return table(spark, sf, "part").select("p_partkey", F.round(scaled, 9).alias("rank"))


def fdr(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 7919 % 1000 + 1) / 1001).alias("p"))
    return _round(ordinals.benjamini_hochberg(df, "p", ["event_type"]).select("event_id", "q"), 9, "q")


def decile_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC per bucket of quantile edges, equal edges taken once."""
    df = table(spark, sf, "orders").select("o_totalprice", (F.col("o_orderkey") % 97).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    edges = df.agg(F.percentile("o_totalprice", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e"))
    bucket = F.size(F.filter(F.array_distinct("e"), lambda e: e < F.col("o_totalprice")))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bucket", bucket.cast("long"))  # one row
    return _round(rankstats.auroc(placed, "s", "y", ["bucket"]), 9, "auroc")


def delong_test(spark: SparkSession, sf: str) -> DataFrame:
    return _delong(table(spark, sf, "lineitem"))


def auroc_interval(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC of the extended price for the line status, per return flag, with its 95% interval."""
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return _round(stats.auroc_interval(df, "x", "y", ["l_returnflag"]), 7, "auc", "se", "low", "high")


def _delong(lines: DataFrame) -> DataFrame:
    df = lines.select("l_returnflag", "l_quantity", "l_discount", (F.col("l_linestatus") == "F").cast("int").alias("y"))
    found = stats.delong(df, "l_quantity", "l_discount", "y", ["l_returnflag"]).drop("p")
    return _round(found, 7, "auc1", "auc2", "diff", "se", "z")


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]), 8, "rho")


def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return _round(stats.partial_correlation(df, "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"]), 7, "partial")


def ols(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 3, "slope", "intercept").select("l_returnflag", "slope", "intercept")


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return _round(stats.average_precision(df, "n_chars", "quality", ["lang"]), 8, "average_precision")


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    draws = sampling.bootstrap_means(table(spark, sf, "orders"), "o_totalprice", "o_custkey", 200)
    return stats.percentile_interval(draws, "mean")


def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.every_nth(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], ["o_orderpriority"], 7).select("o_orderkey")


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf, "orders"), "s1", ["o_orderkey"], ["o_orderpriority"], 20).select("o_orderkey", "o_orderpriority")


def stratified_pick(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    wanted = orders.groupBy("o_orderstatus").agg((F.count(F.lit(1)) / 3).cast("long").alias("n"))
    return sampling.stratified_pick(orders.where("o_orderkey % 2 = 0"), wanted, ["o_orderstatus"], "s2", "o_orderkey")


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("v"))
    return sampling.match_nearest(parts.where("p_partkey % 3 = 0"), parts.where("p_partkey % 3 <> 0"), ["p_brand"], "v", "p_partkey", 50.0)


def dinucleotide_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffle_dinucleotides(table(spark, sf, "benchmark"), "text", 7).select("item_id", "shuffled")


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Of every 50th vector, the three nearest others of its label by L1, ties by id. The queries are the broadcast side
    of a block join only while they are few; each vector is read once."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"), "label")
    d = F.round(F.aggregate(F.zip_with("x", "embedding", lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v), 6)
    pairs = e.join(q, "label").where("q <> vec_id").select("q", "vec_id", d.alias("d"))
    w = Window.partitionBy("q").orderBy("d", "vec_id")
    return pairs.withColumn("r", F.row_number().over(w)).where("r <= 3").select("q", "vec_id", F.col("r").cast("long").alias("r"))


def out_of_fold_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC of a ridge logistic model whose rows are scored by the model that did not see their fold."""
    scale = {"qty": F.col("l_quantity") / 50, "disc": F.col("l_discount") * 10, "price": F.col("l_extendedprice") / 100_000}
    df = table(spark, sf, "lineitem").withColumns(scale).select(*scale, (F.col("l_orderkey") % 5).cast("int").alias("fold"), ((F.col("l_quantity") + F.col("l_partkey") % 60) > 50).cast("int").alias("y"))
    scored = models.out_of_fold(df, list(scale), "y", "fold", 5)
    return _round(rankstats.auroc(scored, "oof", "y", ["fold"]), 6, "auroc")


def fold_roles(spark: SparkSession, sf: str) -> DataFrame:
    fold = F.col("o_custkey") % 5
    return table(spark, sf, "orders").groupBy(folds.role(fold, 4, 5).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def fold_checks(spark: SparkSession, sf: str) -> DataFrame:
    return folds.straddling(table(spark, sf, "orders").withColumn("fold", F.col("o_orderkey") % 5), "o_custkey", "fold")


def pair_filter(spark: SparkSession, sf: str) -> DataFrame:
    return folds.drop_pairs(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") < 45).select("l_orderkey", "l_linenumber")


def leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of each document's distinct word 6-grams in the benchmark, by threshold."""
    def grams(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.array_remove(F.split(F.lower("text"), r"[^\pL\pN]+"), "").alias("w"))
        spots = F.when(F.size("w") >= 6, F.sequence(F.lit(1), F.size("w") - 5)).otherwise(F.array().cast("array<int>"))
        return words.withColumn("g", F.transform(spots, lambda i: F.xxhash64(*[F.get("w", i + (o - 1)) for o in range(6)]))).select(key, "g")

    shares = audit.containment(grams(table(spark, sf, "documents"), "doc_id"), grams(table(spark, sf, "benchmark"), "item_id"), "doc_id", "g")
    return _round(audit.thresholds(shares, "share"), 9, "mean", "median", "p95", "above_0", "above_25", "above_50", "above_90")


def duplicate_scan(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    return audit.duplicates(df, ["l_partkey"], ["l_partkey", "l_suppkey"], "fold", "l_returnflag")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audit.profile(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")).drop("type")


def table_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 10 <> 3").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return audit.compare(c.where("c_custkey % 10 <> 4"), new, "c_custkey", "c_acctbal", 1e-9).select("c_custkey", "status")


def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return audit.digest(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return audit.first_wins(df, ["l_partkey", "l_suppkey"], "ord").select("l_partkey", "l_suppkey", "ord")


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return audit.carry_forward(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


def integrity(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        audit.invariant("bad_quantity", F.col("l_quantity").between(1, 50)),
        audit.invariant("bad_flag", F.col("l_returnflag").isin("R", "A")),
        audit.invariant("bad_discount", F.col("l_discount") < 0.1),
    )


def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard and shared share of the part sets of two return flags: union, intersection and difference of keys."""
    keys = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct()
    sides = keys.groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    total = sides.agg(F.sum(F.col("r") * F.col("a")).alias("both"), F.sum(F.greatest("r", "a")).alias("either"), F.sum(F.col("r") * (1 - F.col("a"))).alias("only_r"))
    return total.withColumn("jaccard", F.round(F.col("both") / F.col("either"), 9))


def gram_components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents connected by a shared word 12-gram."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\pL\pN]+"), "")
    docs = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    spots = F.when(F.size("w") >= 12, F.sequence(F.lit(1), F.size("w") - 11)).otherwise(F.array().cast("array<int>"))
    grams = docs.select("doc_id", F.transform(spots, lambda i: F.array_join(F.slice("w", i, 12), " ")).alias("g"))
    return graphs.components(graphs.sharing(grams, "doc_id", "g"), "first", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        gini, category_shares, shares_pivot, mean_pivot, redundancy, effect_size, trimmed_mean, quantiles, group_spread, leave_one_out, largest_magnitude, mutual_information, top3_share,
        with_all, mass_matrix, midrank, rank_within, fdr, decile_auroc, delong_test, auroc_interval, spearman, partial_correlation, ols, average_precision, bootstrap_interval, systematic_sample,
        hash_sample, stratified_pick, top_k, greedy_match, dinucleotide_shuffle, nearest_vectors, out_of_fold_auroc, fold_roles, fold_checks, pair_filter, leakage, duplicate_scan,
        column_profile, table_diff, content_digest, first_wins, carry_forward, integrity, key_overlap, gram_components,
    )
}

_GRAMS = "SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM {t})"
_MID = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"

ORACLES = {
    "gini": """WITH r AS (SELECT l_returnflag, abs(l_extendedprice) AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_extendedprice)) AS i FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 9) AS gini FROM r GROUP BY 1""",
    "category_shares": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders GROUP BY 1, 2",
    "shares_pivot": 'SELECT l_linestatus, round(avg((l_returnflag = \'R\')::INT), 9) AS "share_R", round(avg((l_returnflag = \'A\')::INT), 9) AS "share_A", round(avg((l_returnflag = \'N\')::INT), 9) AS "share_N" FROM lineitem GROUP BY 1',
    "mean_pivot": "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 9) AS mean_f, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 9) AS mean_o FROM lineitem GROUP BY 1",
    "redundancy": """SELECT lang, count(*) AS n, round(1 - count(DISTINCT md5(text)) / count(*)::DOUBLE, 9) AS redundancy,
        round(1 - count(DISTINCT md5(text)) FILTER (doc_id % 2 = 0) / nullif(count(*) FILTER (doc_id % 2 = 0), 0)::DOUBLE, 9) AS redundancy_pos FROM documents GROUP BY 1""",
    "effect_size": """WITH g AS (SELECT lang, count(*) FILTER (quality = 0) AS n0, count(*) FILTER (quality = 1) AS n1, avg(n_chars) FILTER (quality = 0) AS m0, avg(n_chars) FILTER (quality = 1) AS m1,
            var_samp(n_chars) FILTER (quality = 0) AS v0, var_samp(n_chars) FILTER (quality = 1) AS v1 FROM documents JOIN labels USING (doc_id) GROUP BY 1)
        SELECT lang, n0, n1, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS d, round((m1 - m0) / sqrt((v0 + v1) / 2), 6) AS smd FROM g""",
    "trimmed_mean": """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
        SELECT o_orderpriority, round(avg(o_totalprice), 4) AS trimmed_mean FROM r WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1""",
    "quantiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 6) AS q10, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.9), 6) AS q90 FROM orders GROUP BY 1",
    "group_spread": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 9) AS mean, round(stddev_samp(l_discount), 9) AS sd FROM lineitem GROUP BY 1, 2",
    "leave_one_out": """SELECT o_orderkey, round((sum(v) OVER (PARTITION BY o_custkey) - v) / nullif(count(*) OVER (PARTITION BY o_custkey) - 1, 0)::DOUBLE, 6) AS rate
        FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice)::BIGINT AS v FROM orders)""",
    "largest_magnitude": """SELECT l_partkey, delta FROM (SELECT l_partkey, l_quantity - 25 AS delta, row_number() OVER (PARTITION BY l_partkey ORDER BY abs(l_quantity - 25) DESC, l_orderkey * 8 + l_linenumber) AS r FROM lineitem) WHERE r = 1""",
    "mutual_information": """WITH j AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)
        SELECT round(greatest(0, sum(n / t * log2(n * t / (nx * ny)))), 9) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM j)""",
    "top3_share": """WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer WHERE c_acctbal > 0)
        SELECT c_mktsegment, round(sum(c_acctbal) FILTER (r <= 3) / sum(c_acctbal), 9) AS share FROM r GROUP BY 1""",
    "with_all": "SELECT coalesce(c_mktsegment, 'ALL') AS c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())",
    "mass_matrix": "SELECT c_mktsegment, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "midrank": f"SELECT p_partkey, {_MID.format(by='p_brand', x='p_size')} AS rank FROM part",
    "rank_within": f"SELECT p_partkey, round(CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN 0.5 ELSE ({_MID.format(by='p_brand', x='p_size')} - 1) / (count(*) OVER (PARTITION BY p_brand) - 1)::DOUBLE END, 9) AS rank FROM part",
    "fdr": """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 11 <> 0 THEN (event_id * 7919 % 1000 + 1) / 1001.0::DOUBLE END AS p FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS i, count(*) OVER (PARTITION BY event_type) AS m FROM e WHERE p IS NOT NULL),
        q AS (SELECT event_id, least(1, min(p * m / i) OVER (PARTITION BY event_type ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
        SELECT event_id, round(q, 9) AS q FROM e LEFT JOIN q USING (event_id)""",
    "decile_auroc": f"""WITH o AS (SELECT o_totalprice AS t, o_orderkey % 97 AS s, (o_orderstatus = 'F')::INT AS y FROM orders),
        e AS (SELECT list_distinct(quantile_cont(t, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM o),
        b AS (SELECT s, y, len(list_filter(e, lambda x: x < t))::BIGINT AS bucket FROM o, e), r AS (SELECT bucket, y, {_MID.format(by='bucket', x='s')} AS mid FROM b)
        SELECT bucket, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(mid) FILTER (y = 1) - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 9) AS auroc FROM r GROUP BY 1""",
    "delong_test": f"""WITH d AS (SELECT l_returnflag, l_quantity AS a, l_discount AS b, (l_linestatus = 'F')::INT AS y FROM lineitem),
        r AS (SELECT *, sum(y) OVER (PARTITION BY l_returnflag) AS np, count(*) OVER (PARTITION BY l_returnflag) AS n,
            {_MID.format(by='l_returnflag', x='a')} AS ra, {_MID.format(by='l_returnflag', x='b')} AS rb, {_MID.format(by='l_returnflag, y', x='a')} AS oa, {_MID.format(by='l_returnflag, y', x='b')} AS ob FROM d),
        v AS (SELECT l_returnflag, y, CASE WHEN y = 1 THEN (ra - oa) / (n - np) ELSE 1 - (ra - oa) / np END AS va, CASE WHEN y = 1 THEN (rb - ob) / (n - np) ELSE 1 - (rb - ob) / np END AS vb FROM r),
        g AS (SELECT l_returnflag, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, avg(va) FILTER (y = 1) AS auc1, avg(vb) FILTER (y = 1) AS auc2,
            sqrt(var_samp(va - vb) FILTER (y = 1) / sum(y) + var_samp(va - vb) FILTER (y = 0) / sum(1 - y)) AS se FROM v GROUP BY 1)
        SELECT l_returnflag, n_pos, n_neg, round(auc1, 7) AS auc1, round(auc2, 7) AS auc2, round(auc1 - auc2, 7) AS diff, round(se, 7) AS se, round(CASE WHEN se > 0 THEN (auc1 - auc2) / se ELSE 0 END, 7) AS z FROM g""",
    "spearman": f"SELECT p_brand, count(*) AS n, round(corr(a, b), 8) AS rho FROM (SELECT p_brand, {_MID.format(by='p_brand', x='p_size')} AS a, {_MID.format(by='p_brand', x='p_retailprice')} AS b FROM part) GROUP BY 1",
    "partial_correlation": """WITH c AS (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY 1)
        SELECT l_returnflag, n, round(CASE WHEN n >= 10 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END, 7) AS partial FROM c""",
    "ols": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1",
    "average_precision": """WITH s AS (SELECT lang, n_chars, sum((quality = 1)::INT) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
        c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING))
        SELECT lang, round(sum(p * tp / a::DOUBLE) / nullif(sum(p), 0), 8) AS average_precision FROM c GROUP BY 1""",
    "systematic_sample": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE (r - 1) % 7 = 0",
    "hash_sample": "SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('s1|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 20",
    "stratified_pick": """WITH w AS (SELECT o_orderstatus, (count(*) // 3) AS n FROM orders GROUP BY 1),
        p AS (SELECT o_orderkey, o_orderstatus, sha256('s2|' || o_orderkey) AS h FROM orders WHERE o_orderkey % 2 = 0),
        r AS (SELECT p.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY p.o_orderstatus ORDER BY h, o_orderkey) AS r FROM p LEFT JOIN w USING (o_orderstatus)),
        lack AS (SELECT (SELECT sum(n) FROM w) - count(*) AS k FROM r WHERE r <= n),
        f AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS i FROM r WHERE r > n)
        SELECT o_orderkey, o_orderstatus FROM r WHERE r <= n UNION ALL SELECT o_orderkey, o_orderstatus FROM f, lack WHERE i <= k""",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "nearest_vectors": """WITH q AS (SELECT vec_id AS q, embedding AS x, label FROM embeddings WHERE vec_id % 50 = 0),
        d AS (SELECT q, vec_id, round(list_sum(list_transform(list_zip(x, embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS d FROM q JOIN embeddings e USING (label) WHERE q <> vec_id)
        SELECT q, vec_id, r FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS r FROM d) WHERE r <= 3""",
    "fold_roles": "SELECT CASE o_custkey % 5 WHEN 4 THEN 'test' WHEN 0 THEN 'val' ELSE 'train' END AS role, count(*) AS n FROM orders GROUP BY 1",
    "fold_checks": "SELECT o_custkey, count(DISTINCT o_orderkey % 5) AS folds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) > 1",
    "pair_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)",
    "leakage": f"""WITH d AS ({_GRAMS.format(k='doc_id', t='documents')}), b AS (SELECT DISTINCT g FROM ({_GRAMS.format(k='item_id', t='benchmark')})),
        s AS (SELECT doc_id, coalesce(avg((b.g IS NOT NULL)::INT) FILTER (d.g IS NOT NULL), 0) AS share FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN b USING (g) GROUP BY 1)
        SELECT round(avg(share), 9) AS mean, round(median(share), 9) AS median, round(quantile_cont(share, 0.95), 9) AS p95, round(avg((share > 0)::INT), 9) AS above_0,
            round(avg((share > 0.25)::INT), 9) AS above_25, round(avg((share > 0.5)::INT), 9) AS above_50, round(avg((share > 0.9)::INT), 9) AS above_90 FROM s""",
    "duplicate_scan": """WITH f AS (SELECT l_partkey, l_suppkey, count(*) AS n, count(DISTINCT l_orderkey % 5) AS f, count(DISTINCT l_returnflag) AS l FROM lineitem GROUP BY 1, 2)
        SELECT (SELECT count(*) - count(DISTINCT l_partkey) FROM lineitem) AS coarse_surplus, sum(n - 1)::BIGINT AS full_surplus, sum((f > 1)::INT)::BIGINT AS cross_fold, sum((l > 1)::INT)::BIGINT AS mixed_label FROM f""",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS smallest, max({c})::VARCHAR AS largest FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")),
    "table_diff": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 4 THEN 'added' WHEN c_custkey % 10 = 3 THEN 'dropped' ELSE 'changed' END AS status FROM customer
        WHERE c_custkey % 10 IN (3, 4) OR c_custkey % 7 = 0""",
    "content_digest": "SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 12))::HUGEINT)::VARCHAR AS digest FROM orders",
    "first_wins": "SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2",
    "carry_forward": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "integrity": """SELECT count(*) AS n, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS bad_quantity, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS bad_flag, count(*) FILTER (NOT l_discount < 0.1) AS bad_discount FROM lineitem""",
    "gram_components": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM w),
        f AS (SELECT g, min(doc_id) AS a FROM g GROUP BY 1 HAVING count(*) > 1), l AS (SELECT DISTINCT a, doc_id AS b FROM g JOIN f USING (g) WHERE doc_id <> a),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT node, min(root) AS component FROM r GROUP BY 1""",
    "key_overlap": """WITH k AS (SELECT l_partkey, max((l_returnflag = 'R')::INT) AS r, max((l_returnflag = 'A')::INT) AS a FROM lineitem GROUP BY 1)
        SELECT sum(r * a)::BIGINT AS both, sum(greatest(r, a))::BIGINT AS either, sum(r * (1 - a))::BIGINT AS only_r, round(sum(r * a) / sum(greatest(r, a))::DOUBLE, 9) AS jaccard FROM k""",
}
ORACLES["auroc_interval"] = f"""WITH d AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS a, (l_linestatus = 'F')::INT AS y FROM lineitem),
    r AS (SELECT *, sum(y) OVER (PARTITION BY l_returnflag) AS np, count(*) OVER (PARTITION BY l_returnflag) AS n, {_MID.format(by='l_returnflag', x='a')} AS ra, {_MID.format(by='l_returnflag, y', x='a')} AS oa FROM d),
    v AS (SELECT l_returnflag, y, CASE WHEN y = 1 THEN (ra - oa) / nullif(n - np, 0) ELSE 1 - (ra - oa) / nullif(np, 0) END AS va FROM r),
    g AS (SELECT l_returnflag, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, avg(va) FILTER (y = 1) AS auc, sqrt(var_samp(va) FILTER (y = 1) / sum(y) + var_samp(va) FILTER (y = 0) / sum(1 - y)) AS se FROM v GROUP BY 1)
    SELECT l_returnflag, n_pos, n_neg, round(auc, 7) AS auc, round(se, 7) AS se, CASE WHEN se IS NOT NULL THEN round(greatest(auc - 1.959963984540054 * se, 0), 7) END AS low,
        CASE WHEN se IS NOT NULL THEN round(least(auc + 1.959963984540054 * se, 1), 7) END AS high FROM g"""
