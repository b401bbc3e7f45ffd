"""Sequence functions over whole texts: letters stand for bases by a fixed translation."""

from __future__ import annotations

import re
from functools import partial
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.functions import sequences as S
from lociflow.sources.tables import table


def _rna(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """item_id and seq of the benchmark items, or of all documents."""
    seq = F.regexp_replace(F.translate(F.lower("text"), "aeiotnshrdlu", "ACGUACGUACGU"), "[^ACGU]+", "")
    rows = table(spark, sf, "documents").withColumnRenamed("doc_id", "item_id") if whole else table(spark, sf, "benchmark")
    return rows.select("item_id", seq.alias("seq"))


_SEQ = "regexp_replace(translate(lower(text), 'aeiotnshrdlu', 'ACGUACGUACGU'), '[^ACGU]', '', 'g')"


def seq_scalars(spark: SparkSession, sf: str) -> DataFrame:
    df = _rna(spark, sf, whole=True).withColumnRenamed("item_id", "doc_id")
    strand = F.when(F.col("doc_id") % 2 == 0, F.lit("-")).otherwise(F.lit("+"))

    def scalars(seq: Column) -> Column:
        dna = F.translate(seq, "U", "T")
        return F.struct(
            F.md5(S.reverse_complement(dna).cast("binary")).alias("revcomp_md5"),
            F.md5(S.to_rna(dna, strand).cast("binary")).alias("rna_md5"),
            F.round(S.gc_content(seq), 9).alias("gc"),
            F.round(S.entropy(seq), 9).alias("entropy"),
            F.length(seq).cast("long").alias("n"),
        )

    # bound to a lambda, so that the sequence is made once
    return df.select("doc_id", F.transform(F.array("seq"), scalars)[0].alias("x")).select("doc_id", "x.*")


def seq_runs(spark: SparkSession, sf: str) -> DataFrame:
    df = _rna(spark, sf)
    return df.select("item_id", F.round(S.low_complexity(F.col("seq")), 9).alias("low_complexity"), S.longest_run(F.col("seq")).cast("long").alias("longest_run"))


def seq_period(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", S.minimal_period(F.col("word")).cast("long").alias("period"), F.round(S.repeat_score(F.col("word")), 9).alias("repeat_score"))


def _kmer_sums(df: DataFrame, k: int, **sums: Column) -> DataFrame:
    """kmer and sums over all rows of what each has of it (``n``): a row's k-mers are counted before they are laid out."""
    names = F.array(*[F.lit("".join(p)) for p in product("ACGU", repeat=k)])
    rows = df.select("*", F.posexplode(S.kmer_counts(F.col("seq"), k)).alias("_at", "n")).where("n > 0")
    return rows.groupBy("_at").agg(*[F.sum(v).cast("long").alias(c) for c, v in sums.items()]).select(F.get(names, F.col("_at")).alias("kmer"), *sums)


def kmer_counts(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    found = _kmer_sums(_rna(spark, sf, whole), 3, n=F.col("n"))
    return found.where("n > 0")


def dinucleotide_vector(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    df = _rna(spark, sf, whole).withColumn("c", S.dinucleotide_counts(F.col("seq")))
    return df.select("item_id", F.posexplode("c").alias("pos", "n")).select("item_id", F.col("pos").cast("long").alias("pair_no"), F.col("n").cast("long").alias("n"))


def pair_l1(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """L1 distance of dinucleotide frequencies between each item and the next by id."""
    df = _rna(spark, sf, whole).withColumn("f", S.frequencies(S.dinucleotide_counts(F.col("seq"))))
    other = df.select((F.col("item_id") - 1).alias("item_id"), F.col("f").alias("g"))
    return df.join(other, "item_id").select("item_id", F.round(S.l1(F.col("f"), F.col("g")), 9).alias("l1"))


def motif_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _rna(spark, sf).select("item_id", F.explode(S.occurrences(F.col("seq"), "ACA")).alias("start")).select("item_id", F.col("start").cast("long").alias("start"))


def composition_z(spark: SparkSession, sf: str) -> DataFrame:
    """Base shares and entropy, z-scored over the whole table from one aggregate row."""
    df = _rna(spark, sf).select("item_id", *[(F.regexp_count("seq", F.lit(b)) / F.length("seq")).alias(b) for b in "ACG"], S.entropy(F.col("seq")).alias("H"))
    names = ["A", "C", "G", "H"]
    stats = df.agg(*[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names])
    z = lambda c: F.round(F.when(F.col(f"s{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")), 6).alias(f"z_{c.lower()}")
    return df.crossJoin(F.broadcast(stats)).select("item_id", *[z(c) for c in names])  # one row


def links_and_clips(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(S.logit(p), 9).alias("logit"),
        F.round(S.logistic(p * 8 - 4), 9).alias("expit"),
        F.round(S.hanley_se(S.clip(p, 0.5, 0.99), F.col("l_quantity") + 1, F.col("l_quantity") + 2), 9).alias("se"),
        S.window_bounds(F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_linenumber"), 101)["start"].alias("w0"),
        S.genomic_position(F.col("l_orderkey"), F.col("l_orderkey") + 101, F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col("l_linenumber")).alias("position"),
        S.window_id("l_orderkey", "l_linenumber", "l_returnflag").alias("id"),
    )


def d_prime(spark: SparkSession, sf: str) -> DataFrame:
    p = F.round(F.col("l_discount") * 10, 2)
    return table(spark, sf, "lineitem").select(p.alias("p")).distinct().select("p", F.round(S.d_prime(F.col("p")), 6).alias("d"))


def page_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute extraction from raw pages, the scan of annotation fields."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select(
        "page_id",
        F.nullif(F.regexp_extract(html, 'lang="([^"]*)"', 1), F.lit("")).alias("lang"),
        F.size(links).cast("long").alias("n_links"),
        F.size(F.array_distinct(links)).cast("long").alias("n_distinct_links"),
        F.nullif(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.lit("")).alias("host"),
    )


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text to a map, exploded and aggregated by key."""
    props = F.from_json("props", "map<string,string>")
    keys = table(spark, sf, "events").select(F.explode(props).alias("k", "v"))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("values"))


def positional_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Motif starts over the relative position in 21 bins, the last one closed, as shares."""
    df = _rna(spark, sf).select(F.length("seq").alias("n"), F.explode(S.occurrences(F.col("seq"), "AC")).alias("at"))
    bins = df.select(F.least(F.lit(20), F.floor(F.col("at") * 21 / (F.col("n") - 1))).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    return bins.crossJoin(F.broadcast(total)).select("bin", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))


def base_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each base at each position, and the gap between even and odd items summed over bases."""
    df = _rna(spark, sf).select((F.col("item_id") % 2).alias("label"), F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    n = df.groupBy("pos", "label", "base").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("pos", "label")))
    wide = share.groupBy("pos", "base").agg(F.sum(F.when(F.col("label") == 0, F.col("share"))).alias("s0"), F.sum(F.when(F.col("label") == 1, F.col("share"))).alias("s1"))
    return wide.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.abs(F.coalesce("s0", F.lit(0.0)) - F.coalesce("s1", F.lit(0.0)))), 6).alias("signal"))


def kmer_enrichment(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """log2 ratio of pseudo-counted 2-mer frequencies, even against odd items, absent 2-mers included."""
    side = lambda label: F.when(F.col("item_id") % 2 == label, F.col("n")).otherwise(0)
    counts = _kmer_sums(_rna(spark, sf, whole), 2, a=side(0), b=side(1))
    letters = spark.createDataFrame([(b,) for b in "ACGU"], "x string")
    every = letters.crossJoin(letters.withColumnRenamed("x", "y")).select(F.concat("x", "y").alias("kmer"))  # the alphabet, 16 rows
    full = every.join(counts, "kmer", "left").fillna(0)
    total = lambda c: F.sum(F.col(c) + 1).over(Window.partitionBy())  # noqa: E731  16 rows
    full = full.withColumns({"ta": total("a"), "tb": total("b")})
    return full.select("kmer", "a", "b", F.round(F.log2(((F.col("a") + 1) / F.col("ta")) / ((F.col("b") + 1) / F.col("tb"))), 6).alias("log2_ratio"))


QUERIES = {
    f.__name__: f
    for f in (seq_scalars, seq_runs, seq_period, kmer_counts, dinucleotide_vector, pair_l1, motif_hits, composition_z, links_and_clips, d_prime, page_attributes, json_props, positional_profile, base_profile, kmer_enrichment)
}

#: The queries that are also registered over all documents.
_WHOLE = (kmer_counts, kmer_enrichment, dinucleotide_vector, pair_l1)
QUERIES |= {f"{f.__name__}_documents": partial(f, whole=True) for f in _WHOLE}

_B = f"(SELECT item_id, {_SEQ} AS seq FROM benchmark)"
_ENT = "(-CASE WHEN {c} > 0 THEN {c} / {n} * log2({c} / {n}) ELSE 0 END)"


def _count(b: str) -> str:
    return f"(length(seq) - length(replace(seq, '{b}', '')))::DOUBLE"


_ENTROPY = " + ".join(_ENT.format(c=_count(b), n="length(seq)") for b in "ACGU")
_PAIRS = [a + b for a in "ACGU" for b in "ACGU"]
_KM = "list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, i, {k}))"

ORACLES = {
    "seq_scalars": f"""
        SELECT doc_id, md5(reverse(translate(dna, 'ACGT', 'TGCA'))) AS revcomp_md5,
            md5(translate(CASE WHEN doc_id % 2 = 0 THEN reverse(translate(dna, 'ACGT', 'TGCA')) ELSE dna END, 'T', 'U')) AS rna_md5,
            round(CASE WHEN length(seq) = 0 THEN 0 ELSE ({_count('G')} + {_count('C')}) / length(seq) END, 9) AS gc,
            round(CASE WHEN length(seq) = 0 THEN 0 ELSE {_ENTROPY} END, 9) AS entropy, length(seq)::BIGINT AS n
        FROM (SELECT doc_id, seq, translate(seq, 'U', 'T') AS dna FROM (SELECT doc_id, {_SEQ} AS seq FROM documents))""",
    "seq_runs": f"""
        WITH r AS (SELECT item_id, length(seq) AS n, list_concat(regexp_extract_all(seq, 'A+'), regexp_extract_all(seq, 'C+'), regexp_extract_all(seq, 'G+'), regexp_extract_all(seq, 'U+')) AS rs FROM {_B})
        SELECT item_id, round(coalesce(list_sum(list_transform(rs, lambda x: CASE WHEN length(x) >= 3 THEN length(x) ELSE 0 END)), 0) / n::DOUBLE, 9) AS low_complexity,
            list_max(list_transform(rs, lambda x: length(x)))::BIGINT AS longest_run FROM r""",
    "seq_period": """
        WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark),
        p AS (SELECT word, coalesce(list_min(list_filter(range(1, length(word)), lambda p: substr(word, 1, length(word) - p) = substr(word, p + 1))), length(word)) AS period FROM w WHERE word <> '')
        SELECT word, period::BIGINT AS period, round(CASE WHEN length(word) < 2 THEN 0 ELSE 1 - (period - 1) / (length(word) - 1)::DOUBLE END, 9) AS repeat_score FROM p""",
    "kmer_counts": f"SELECT kmer, count(*) AS n FROM (SELECT unnest({_KM.format(k=3)}) AS kmer FROM {_B}) GROUP BY kmer",
    "dinucleotide_vector": f"""
        WITH e AS (SELECT item_id, unnest({_KM.format(k=2)}) AS k FROM {_B}), p AS (SELECT unnest({_PAIRS}) AS k, unnest(range(16)) AS pair_no)
        SELECT b.item_id, p.pair_no, count(e.k) AS n FROM benchmark b CROSS JOIN p LEFT JOIN e ON e.item_id = b.item_id AND e.k = p.k GROUP BY 1, 2""",
    "pair_l1": f"""
        WITH e AS (SELECT item_id, unnest({_KM.format(k=2)}) AS k FROM {_B}),
        f AS (SELECT item_id, k, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY item_id) AS f FROM e GROUP BY 1, 2),
        g AS (SELECT b.item_id, p.k, coalesce(f.f, 0) AS f FROM benchmark b CROSS JOIN (SELECT unnest({_PAIRS}) AS k) p LEFT JOIN f ON f.item_id = b.item_id AND f.k = p.k)
        SELECT x.item_id, round(sum(abs(x.f - y.f)), 9) AS l1 FROM g x JOIN g y ON y.item_id = x.item_id + 1 AND x.k = y.k GROUP BY 1""",
    "motif_hits": f"SELECT item_id, unnest(list_filter(range(0, length(seq) - 2), lambda i: substr(seq, i + 1, 3) = 'ACA')) AS start FROM {_B}",
    "composition_z": f"""
        WITH f AS (SELECT item_id, {_count('A')} / length(seq) AS a, {_count('C')} / length(seq) AS c, {_count('G')} / length(seq) AS g, {_ENTROPY} AS h FROM {_B})
        SELECT item_id, {', '.join(f"round(CASE WHEN stddev_pop({x}) OVER () = 0 THEN 0 ELSE ({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () END, 6) AS z_{x}" for x in 'acgh')} FROM f""",
    "links_and_clips": """
        WITH q AS (SELECT *, l_discount * 10 AS p, greatest(1e-6, least(1 - 1e-6, l_discount * 10)) AS c, greatest(0.5, least(0.99, l_discount * 10)) AS a FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(ln(c / (1 - c)), 9) AS logit, round(1 / (1 + exp(-greatest(-30, least(30, p * 8 - 4)))), 9) AS expit,
            round(sqrt((a * (1 - a) + l_quantity * (a / (2 - a) - a * a) + (l_quantity + 1) * (2 * a * a / (1 + a) - a * a)) / ((l_quantity + 1) * (l_quantity + 2))), 9) AS se,
            (l_orderkey + l_orderkey + l_linenumber) // 2 - 50 AS w0,
            CASE WHEN l_returnflag = 'R' THEN l_orderkey + 100 - l_linenumber ELSE l_orderkey + l_linenumber END + 1 AS position,
            concat_ws(':', l_orderkey, l_linenumber, l_returnflag) AS id FROM q""",
    "page_attributes": """
        SELECT page_id, nullif(regexp_extract(html, 'lang="([^"]*)"', 1), '') AS lang, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n_links,
            len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::BIGINT AS n_distinct_links, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host FROM pages""",
    "json_props": """
        WITH k AS (SELECT props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)
        SELECT k, count(*) AS n, count(DISTINCT props ->> ('$."' || k || '"')) AS "values" FROM k GROUP BY k""",
    "positional_profile": f"""
        WITH h AS (SELECT length(seq) AS n, unnest(list_filter(range(0, length(seq) - 1), lambda i: substr(seq, i + 1, 2) = 'AC')) AS loc FROM {_B}),
        b AS (SELECT least(20, floor(loc * 21 / (n - 1)::DOUBLE))::BIGINT AS bin, count(*) AS n FROM h GROUP BY 1)
        SELECT bin, n, round(n / sum(n) OVER ()::DOUBLE, 9) AS share FROM b""",
    "base_profile": f"""
        WITH l AS (SELECT item_id % 2 AS label, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS base FROM {_B}),
        s AS (SELECT pos, label, base, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pos, label) AS share FROM l GROUP BY 1, 2, 3),
        w AS (SELECT pos, base, coalesce(sum(share) FILTER (label = 0), 0) AS s0, coalesce(sum(share) FILTER (label = 1), 0) AS s1 FROM s GROUP BY 1, 2)
        SELECT pos, round(sum(abs(s0 - s1)), 6) AS signal FROM w GROUP BY pos""",
    "kmer_enrichment": f"""
        WITH e AS (SELECT item_id % 2 AS label, unnest({_KM.format(k=2)}) AS kmer FROM {_B}),
        c AS (SELECT p.kmer, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM (SELECT unnest({_PAIRS}) AS kmer) p LEFT JOIN e USING (kmer) GROUP BY 1)
        SELECT kmer, a, b, round(log2(((a + 1) / sum(a + 1) OVER ()::DOUBLE) / ((b + 1) / sum(b + 1) OVER ()::DOUBLE)), 6) AS log2_ratio FROM c""",
}
ORACLES |= {f"{f.__name__}_documents": re.sub(r"FROM benchmark\b", "FROM (SELECT doc_id AS item_id, text FROM documents)", ORACLES[f.__name__]) for f in _WHOLE}
