"""Models, matched sets, resampling, tracks and ordinals on the driver tables: suppliers stand for genes, languages for regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import sequences as S
from lociflow.operators import anova, coverage, crossfit, grouped_fits, matching, ordinals, resampling, sampling, sparse_models, stats, tracks
from lociflow.sources.scratch import Scratch, bounded
from lociflow.sources.tables import table


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = bounded(table(spark, sf, "labels").select("doc_id", "quality"), 32)  # so that texts stay where they are
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text").join(labels, "doc_id").withColumn("fold", (F.col("doc_id") % 5).cast("int"))


def kmer_oof_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC for the quality label of k-mer models with k of 3 to 5, each document scored by the model that did not see its fold;
    k-mers count as in a window of 101 letters. With the 95% interval on the logit scale."""
    _, margins = sparse_models.kmer_models(_labelled(spark, sf), "doc_id", "text", "quality", "fold", 5, [3, 4, 5], per=101.0, tolerance=1e-3)
    found = stats.auroc_interval(sparse_models.out_of_fold(margins), "score", "label", ["group"], scale="logit")
    return _rounded(found.withColumnRenamed("group", "k"), 3, "auc", "se", "low", "high")


def cross_fitted_gain(spark: SparkSession, sf: str) -> DataFrame:
    """What 2-mer models add to the letters' composition, with scores that saw the outer fold and with cross-fitted ones."""
    docs = _labelled(spark, sf)
    _, margins = sparse_models.kmer_models(docs, "doc_id", "text", "quality", "fold", 5, [2], together=2, per=101.0, tolerance=1e-3)
    letters = F.translate(F.lower(F.coalesce("text", F.lit(""))), "aeiotnshrdlu", "ACGUACGUACGU")
    base = docs.select(F.col("doc_id").alias("row"), *[(F.regexp_count(letters, F.lit(b)) / (F.length(letters) + 1)).alias(b) for b in "ACG"])
    found = crossfit.contributions(margins, base, list("ACG"), 5).withColumnRenamed("group", "k")
    return _rounded(found, 2, "auroc_base", "gain_published", "gain_crossfit")


def dinucleotide_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each labelled good document an unused other one of its language with the nearest counts of letter pairs."""
    # in either case; of all other letters that alone has one of these in lower case
    pairs = S.kmer_counts(F.replace("text", F.lit("\u0130"), F.lit("i")), 2, written=("aeiotnshrdluAEIOTNSHRDLU", "ACGU" * 6))
    scratch = Scratch(spark)
    docs = scratch.keep(table(spark, sf, "documents").select("doc_id", "lang", pairs.alias("v")), "pairs")  # both sides are of these
    good = bounded(table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct(), 16)
    found = matching.match_vectors(docs.join(good, "doc_id", "left_semi"), docs.join(good, "doc_id", "left_anti"), ["lang"], "v", "doc_id", scratch=scratch)
    return found.select("lang", F.col("k").alias("doc_id"), F.col("match").alias("matched"), F.col("gap").cast("long").alias("l1"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_linestatus") == "F").cast("int").alias("y"), F.col("l_discount").cast("double").alias("discount"),
        (F.col("l_quantity").cast("double") - 25).alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), "l_shipdate",
    )


def effect_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier and score: does its size predict the line status, alone and beside the price, with both corrections?"""
    found = grouped_fits.effect_tests(_lines(spark, sf), ["l_suppkey"], ["discount", "quantity"], "y", "price")
    return _rounded(found, 5, *[c for c, t in found.dtypes if t == "double"])


def penalised_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier the profile penalised likelihood-ratio test of the discount beside quantity and price."""
    lines = _lines(spark, sf).withColumns({"quantity": F.col("quantity") / 25, "price": F.col("price") / 50_000, "discount": F.col("discount") * 10})
    found = grouped_fits.likelihood_ratio(lines, ["l_suppkey"], ["quantity", "price"], ["discount"], "y")
    return _rounded(found, 5, "ratio", "p", "coef", "se")


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two scores' AUROC over all lines: 200 draws of whole orders, and its spread over that of the paired test."""
    found = resampling.paired_bootstrap(_lines(spark, sf), "quantity", "discount", "y", ["l_orderkey"], draws=200)
    return _rounded(found, 8, *[c for c, t in found.dtypes if t == "double"])


def window_tops(spark: SparkSession, sf: str) -> DataFrame:
    """For each order the largest price of a line of its supplier key that ships within its window, in bins of four days."""
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    lines = _lines(spark, sf).select(F.col("l_suppkey").alias("k"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_linenumber") * 5).alias("end"), "price")
    suppliers = table(spark, sf, "supplier").count()
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % suppliers + 1).alias("k"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 40).alias("end"))
    return tracks.window_tops(orders, lines, ["k"], "price", 4).select("o_orderkey", "top")


def paired_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th returned line of a supplier beside the n-th accepted one."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).select("l_suppkey", F.col("line").alias(name))
    return ordinals.paired(side("R", "returned"), side("A", "accepted"), ["l_suppkey"], ["returned"], ["accepted"])


def score_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents have a label, counted by the job that writes them joined."""
    scratch = Scratch(spark)
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    seen = coverage.Coverage(joined, "quality", {"odd": F.col("doc_id") % 2 == 1})
    scratch.keep(seen.table, "joined")
    found = seen.counts()
    return spark.createDataFrame([(found["n"], found["missing"], found["dropped_odd"])], "n long, missing long, odd long")


def region_matched(spark: SparkSession, sf: str) -> DataFrame:
    """All lines with status F, and per fold those others that repeat their shares of ship modes, as many as there are."""
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), (F.col("l_orderkey") % 5).alias("fold"), (F.col("l_suppkey") % 7).alias("region"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return sampling.share_matched(lines, "fold", "region", "y", "line", "s3").select("line", "fold")


def auroc_logit(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC of the extended price for the line status, per return flag, with its interval on the logit scale."""
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return _rounded(stats.auroc_interval(df, "price", "y", ["l_returnflag"], scale="logit"), 7, "auc", "se", "low", "high")


def variance_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What suppliers, flags and line numbers explain of the lines' prices beside one another."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    return _rounded(anova.variance_shares(lines, "price", ["l_suppkey", "l_returnflag", "l_linenumber"]), 6, "share")


QUERIES = {f.__name__: f for f in (variance_shares, kmer_oof_auroc, cross_fitted_gain, dinucleotide_match, effect_tests, penalised_ratio, paired_bootstrap, window_tops, paired_positions, score_coverage, region_matched, auroc_logit)}

_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
ORACLES = {
    "window_tops": """WITH l AS (SELECT l_suppkey AS k, epoch_us(l_shipdate) // 86400000000 AS s, epoch_us(l_shipdate) // 86400000000 + l_linenumber * 5 AS e, l_extendedprice::DOUBLE AS price FROM lineitem),
        o AS (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) + 1 AS k, epoch_us(o_orderdate) // 86400000000 AS s, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 40 AS e FROM orders)
        SELECT o_orderkey, coalesce(max(price), 0) AS top FROM o LEFT JOIN l ON l.k = o.k AND l.s // 4 <= o.e // 4 AND o.s // 4 <= l.e // 4 GROUP BY 1""",
    "paired_positions": """WITH n AS (SELECT l_suppkey, l_returnflag, l_orderkey * 8 + l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS i FROM lineitem)
        SELECT r.l_suppkey, r.line AS returned, a.line AS accepted FROM n r JOIN n a ON r.l_suppkey = a.l_suppkey AND r.i = a.i AND r.l_returnflag = 'R' AND a.l_returnflag = 'A'""",
    "score_coverage": """SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (doc_id % 2 = 1) AS odd
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""",
    "region_matched": """WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS line, l_orderkey % 5 AS fold, l_suppkey % 7 AS region, (l_linestatus = 'F')::INT AS y FROM lineitem),
        p AS (SELECT fold, region, count(*) AS n FROM l WHERE y = 1 GROUP BY 1, 2), a AS (SELECT fold, region, count(*) AS n FROM l WHERE y = 0 GROUP BY 1, 2),
        s AS (SELECT p.fold, p.region, p.n, sum(p.n) OVER (PARTITION BY p.fold) AS total, coalesce(a.n, 0) AS free FROM p LEFT JOIN a USING (fold, region) WHERE p.fold IN (SELECT fold FROM a)),
        q AS (SELECT *, min(free * total // n) OVER (PARTITION BY fold) AS take FROM s),
        k AS (SELECT fold, region, least(free, round_even(take * n / total::DOUBLE, 0))::BIGINT AS quota FROM q),
        r AS (SELECT line, fold, region, row_number() OVER (PARTITION BY fold, region ORDER BY sha256('s3|' || line), line) AS i FROM l WHERE y = 0)
        SELECT line, fold FROM l WHERE y = 1 AND fold IN (SELECT fold FROM s) UNION ALL SELECT r.line, r.fold FROM r JOIN k USING (fold, region) WHERE i <= quota""",
    "auroc_logit": f"""WITH d AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS a, (l_linestatus = 'F')::INT AS y FROM lineitem),
        r AS (SELECT *, sum(y) OVER (PARTITION BY l_returnflag) AS np, count(*) OVER (PARTITION BY l_returnflag) AS n, {_RANK.format(by='l_returnflag', x='a')} AS ra, {_RANK.format(by='l_returnflag, y', x='a')} AS oa FROM d),
        v AS (SELECT l_returnflag, y, CASE WHEN y = 1 THEN (ra - oa) / nullif(n - np, 0) ELSE 1 - (ra - oa) / nullif(np, 0) END AS va FROM r),
        g AS (SELECT l_returnflag, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, avg(va) FILTER (y = 1) AS auc, sqrt(var_samp(va) FILTER (y = 1) / sum(y) + var_samp(va) FILTER (y = 0) / sum(1 - y)) AS se FROM v GROUP BY 1),
        h AS (SELECT *, 1.959963984540054 * se / (auc * (1 - auc)) AS w, ln(auc / (1 - auc)) AS eta, se = 0 OR auc <= 0 OR auc >= 1 AS flat FROM g)
        SELECT l_returnflag, n_pos, n_neg, round(auc, 7) AS auc, round(se, 7) AS se, round(CASE WHEN flat THEN greatest(auc - 1.959963984540054 * se, 0) ELSE 1 / (1 + exp(w - eta)) END, 7) AS low,
            round(CASE WHEN flat THEN least(auc + 1.959963984540054 * se, 1) ELSE 1 / (1 + exp(-w - eta)) END, 7) AS high FROM h""",
}
