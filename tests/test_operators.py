"""Hand cases with known answers."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import sequences as S
from lociflow.operators import annotation, audit, folds, graphs, intervals, models, rankstats, sampling, stats, variants
from lociflow.sources import genomic
from lociflow.streaming import blocks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_sequence_functions(spark):
    lit = F.lit
    assert one(spark, S.reverse_complement(lit("ACGTN"))) == "NACGT"
    assert one(spark, S.to_rna(lit("ACGT"), lit("-"))) == "ACGU"
    assert tuple(one(spark, S.window_bounds(lit(10), lit(20), 101))) == (-35, 66)
    assert [one(spark, S.minimal_period(lit(s))) for s in ("UUUUU", "UGUGU", "GCAUG", "A", "")] == [1, 2, 4, 1, 0]
    assert one(spark, S.low_complexity(lit("AUUUA"))) == 0.6
    assert [one(spark, S.entropy(lit(s))) for s in ("ACGU", "AAAA", "AUAU")] == [2, 0, 1]
    assert one(spark, S.l1(F.array(lit(1), lit(2)), F.array(lit(3), lit(0)))) == 4
    assert one(spark, S.occurrences(lit("AAAA"), "AA")) == [0, 1, 2] and one(spark, S.occurrences(lit("A"), "AA")) == []
    assert one(spark, S.consequences(lit("X=1;MC=SO:1|intron_variant,SO:2|X"))) == ["intron_variant", "x"]
    assert [one(spark, S.normalise_chromosome(lit(c))) for c in ("1", "chrX", "MT", "chrM")] == ["chr1", "chrX", "chrM", "chrM"]
    assert one(spark, S.attribute(lit('gene_id "g1"; transcript_id "t1";'), "transcript_id")) == "t1"
    assert one(spark, S.one_hot(lit("AN"))) == [[1, 0, 0, 0], [0, 0, 0, 0]]
    assert one(spark, S.longest_run(lit("AACCCA"))) == 3 and one(spark, S.gc_content(lit(""))) == 0
    assert one(spark, S.d_prime(lit(0.5))) == pytest.approx(0) and one(spark, S.normal_tail(lit(1.959963985))) == pytest.approx(0.05)


def iv(spark, rows, names="start long, end long"):
    return spark.createDataFrame([("c", *r) for r in rows], f"k string, {names}")


def test_interval_algebra(spark):
    got = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert got(intervals.merge(iv(spark, [(1, 5), (5, 8), (10, 12), (11, 20)]), ["k"])) == [(1, 8), (10, 20)]
    assert got(intervals.subtract(iv(spark, [(0, 10)]), iv(spark, [(3, 5), (8, 12)]), ["k"])) == [(0, 3), (5, 8)]
    assert got(intervals.gaps(iv(spark, [(0, 10), (20, 30), (25, 40), (50, 60)]), ["k"])) == [(10, 20), (40, 50)]
    assert intervals.merge(iv(spark, []), ["k"]).collect() == []


def test_touching_query_is_covered_and_margin_is_inclusive(spark):
    q = iv(spark, [(5, 10)]).withColumn("_left", F.lit(1))
    t = iv(spark, [(10, 12)], "start2 long, end2 long")
    assert intervals.overlap_join(q, t, ["k"], 4).count() == 0
    assert intervals.overlap_join(q, t, ["k"], 4, closed=True, how="left_semi").count() == 1
    p = iv(spark, [(0, 0), (1, 1)]).withColumn("_left", F.col("start"))
    near = intervals.too_close(p, iv(spark, [(3, 3)], "start2 long, end2 long"), ["k"], 2, 4)
    assert [r.start for r in near.collect()] == [1]


def test_nearest_takes_the_earlier_of_equals(spark):
    t = spark.createDataFrame([("c", 1000, 1100, "+"), ("c", 2000, 2050, "-"), ("c", 500, 600, "+")], "k string, start2 long, end2 long, strand2 string")
    p = spark.createDataFrame([("c", 1500), ("c", 1050), ("d", 1)], "k string, pos long")
    assert {(r.k, r.pos): (r.distance, r.strand) for r in intervals.nearest(p, t, ["k"]).collect()} == {("c", 1500): (401, "+"), ("c", 1050): (0, "+"), ("d", 1): (None, None)}


def test_rank_statistics(spark):
    df = spark.createDataFrame([(2.0, 1), (3.0, 1), (1.0, 0), (2.0, 0)], "s double, y int")
    assert rankstats.auroc(df, "s", "y").first().auroc == 0.875
    q = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None])], "i int, p double")
    assert [r.q and round(r.q, 5) for r in rankstats.benjamini_hochberg(q, "p").orderBy("i").collect()] == [0.04, 0.05333, 0.05333, 0.5, None]
    tied = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int").select(rankstats.midrank(F.col("x")).alias("r"))
    assert sorted(r.r for r in tied.collect()) == [1, 2.5, 2.5, 4]


def test_delong_equals_the_double_loop(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 60)
    a, b = np.round(rng.normal(size=60) + y, 1), np.round(rng.normal(size=60), 1)
    r = stats.delong(spark.createDataFrame([(float(i), float(j), int(k)) for i, j, k in zip(a, b, y)], "a double, b double, y int"), "a", "b", "y").first()
    psi = lambda s: (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    d10 = psi(a).mean(1) - psi(b).mean(1)
    d01 = psi(a).mean(0) - psi(b).mean(0)
    assert r.diff == pytest.approx(psi(a).mean() - psi(b).mean())
    assert r.se == pytest.approx(math.sqrt(d10.var(ddof=1) / len(d10) + d01.var(ddof=1) / len(d01)))


def test_models_and_separation(spark):
    x, y = [-2, -1, -0.5, 0.5, 1, 2], [0, 0, 0, 1, 1, 1]
    rows = [(float(a), b, f) for f in (0, 1) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x double, y int, fold int")
    firth = models.fit_complements(df, ["x"], "y", "fold", 2, firth=True)
    ridge = models.fit_complements(df, ["x"], "y", "fold", 2)
    assert all(np.isfinite(b).all() and 0 < b[1] < 20 for b in [*firth.values(), *ridge.values()])
    p = 1 / (1 + np.exp(-ridge[0][0] - ridge[0][1] * np.array(x)))
    assert abs((np.array(y) - p) @ np.array(x) - ridge[0][1]) < 1e-6  # stationary point of the ridge
    assert models.out_of_fold(df, ["x"], "y", "fold", 2).where("oof IS NULL").count() == 0


def test_folds(spark):
    f = spark.createDataFrame([(i,) for i in range(5)], "f int")
    assert [r.r for r in f.select(folds.role(F.col("f"), 4, 5).alias("r")).collect()] == ["val", "train", "train", "train", "test"]
    assert folds.balanced_folds([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        folds.balanced_folds([("a", 1)], 2)


def test_shuffle_keeps_pairs(spark):
    from collections import Counter

    texts = ["ACGUACGGUUACGAUC" * 4, "AA", "", None, "ABAB"]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    for r in sampling.shuffle_dinucleotides(df, "seq", 3).collect():
        if r.seq is None:
            assert r.shuffled is None
        else:
            assert Counter(zip(r.seq, r.seq[1:])) == Counter(zip(r.shuffled, r.shuffled[1:])) and len(r.seq) == len(r.shuffled)
    assert sampling.shuffle_dinucleotides(df, "seq", 3).first().shuffled != texts[0]


def test_matches_are_unused_and_near(spark):
    pos = spark.createDataFrame([("b", i, float(i)) for i in range(5)], "g string, id long, v double")
    pool = spark.createDataFrame([("b", 100 + i, i / 2) for i in range(8)], "g string, id long, v double")
    m = sampling.match_nearest(pos, pool, ["g"], "v", "id", 0.6).collect()
    assert len({r.match for r in m}) == len(m) and all(r.gap <= 0.6 for r in m) and len(m) >= 4


def test_audit(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    new = spark.createDataFrame([(1, 1.0 + 1e-12), (3, None), (4, 5.0)], "k int, v double")
    assert {(r.k, r.status) for r in audit.compare(old, new, "k", "v", 1e-9).collect()} == {(2, "dropped"), (4, "added")}
    dup = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, v string, o int")
    assert audit.first_wins(dup, ["k"], "o").first().v == "a"


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "PROT.K562.bed.gz", "wt") as f:
        f.write("track x\n\n#c\nchr1\t10\t20\tpk\t0\t+\t3.5\t7\nchr1\tbad\t20\tpk\t0\t+\nchr1\t5\n")
    r = genomic.peaks(spark, str(tmp_path / "*.bed.gz")).collect()
    assert [(x.protein, x.start, x.end, x.signal, x.mid) for x in r] == [("PROT", 10, 20, 3.5, 15)]
    (tmp_path / "a.gtf").write_text('#h\nchr1\ts\texon\t11\t20\t.\t-\t.\tgene_id "g"; transcript_id "t";\nchr1\ts\tgene\t1\t9\t.\t-\t.\tgene_id "g";\n')
    g = genomic.annotation(spark, str(tmp_path / "a.gtf")).collect()
    assert [(x.start, x.end, x.transcript_id, x.gene_name) for x in g] == [(10, 20, "t", None)]
    (tmp_path / "v.vcf").write_text("##x\n1\t100\trs1\tA\tG\t.\t.\tCLNSIG=Pathogenic;MC=SO:1|intron_variant;GENEINFO=AB:1\n1\t101\trs2\tA\tAT\t.\t.\tCLNSIG=Benign\n1\t102\trs3\tC\tT\t.\t.\tCLNSIG=Benign;CLNVC=Deletion\n")
    v = genomic.variants(spark, str(tmp_path / "v.vcf"), ("Pathogenic",), ("Benign",)).collect()
    assert [(x.vid, x.chrom, x.pos, x.label, x.consequence, x.gene) for x in v] == [("rs1", "chr1", 99, 1, "intron_variant", "AB")]
    genome = "ACGTTGCA" * 5
    t = genomic.tiles(spark.createDataFrame([("chr1", genome)], "chrom string, seq string"), 7)
    w = spark.createDataFrame([(1, "chr1", 3, 25), (2, "chr1", 35, 45), (3, "chr1", -2, 5), (4, "chr9", 0, 5)], "id int, chrom string, start long, end long")
    assert {x.id: x.seq for x in genomic.fetch(w, t, 7).collect()} == {1: genome[3:25], 2: None, 3: None, 4: None}
    (tmp_path / "e.json").write_text(json.dumps({"@graph": [{"name": "x", "files": [{"accession": "B", "biological_replicates": [1, 2]}, {"accession": "A", "biological_replicates": [1], "preferred_default": True}]}]}))
    assert genomic.best_file(genomic.experiments(spark, str(tmp_path / "e.json")), "name").first().accession == "B"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = blocks.block_counts(blocks.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("blocks").agg(F.sum("n")).first()[0] == e.count()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in graphs.components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_regions_of_transcripts(spark):
    rows = [("c", "exon", 0, 100, "-", "t"), ("c", "exon", 200, 300, "-", "t"), ("c", "CDS", 50, 100, "-", "t"), ("c", "CDS", 200, 250, "-", "t"), ("c", "UTR", 0, 50, "-", "t"), ("c", "UTR", 250, 300, "-", "t"), ("c", "exon", 500, 600, "+", "n")]
    f = spark.createDataFrame(rows, "chrom string, feature string, start long, end long, strand string, transcript_id string")
    got = {(r.region, r.start, r.end) for r in annotation.region_index(f).collect()}
    assert got == {("utr3", 0, 50), ("utr5", 250, 300), ("cds", 50, 100), ("cds", 200, 250), ("intron", 100, 200), ("exon_nc", 500, 600)}


def test_variant_windows(spark):
    genome = "ACGTN" + "ACGTTGCAAC" * 4
    t = genomic.tiles(spark.createDataFrame([("chr1", genome)], "chrom string, seq string"), 7)
    v = spark.createDataFrame([("a", "chr1", 20, genome[20], "G"), ("b", "chr1", 21, "N", "G"), ("c", "chr1", 1, genome[1], "T"), ("d", "chr2", 20, "A", "C")], "vid string, chrom string, pos long, ref string, alt string")
    peaks = spark.createDataFrame([("chr1", 18, 22, "-"), ("chr2", 900, 905, "+")], "chrom string, start long, end long, strand string")
    folds_ = spark.createDataFrame([("chr1", 2)], "chrom string, fold int")
    rows = variants.windows_for(variants.assign(v, peaks, folds_, 50), t, 5, [0, 1], 7).collect()
    assert {(r.vid, r.shift_idx) for r in rows} == {("a", 0), ("a", 1)}
    first = next(r for r in rows if r.shift_idx == 0)
    rna = lambda s: s[::-1].translate(str.maketrans("ACGT", "UGCA"))
    assert first.seq_ref == rna(genome[18:23]) and first.seq_alt == rna(genome[18:20] + "G" + genome[21:23]) and first.peak_distance == 0
    d = spark.createDataFrame([("x", 0, 1.0), ("x", 1, -3.0), ("x", 2, float("nan")), ("y", 0, float("nan"))], "vid string, shift_idx int, delta double")
    assert {r.vid: r.delta for r in variants.collapse(d, "delta").collect()} == {"x": -3.0, "y": None}


def test_delong_ranks_distinct_scores_not_rows(spark):
    rows = spark.range(4000).selectExpr("id % 3 AS g", "cast(id % 7 AS double) AS a", "cast(id * 31 % 5 AS double) AS b", "cast(id % 2 AS int) AS y")
    counts = rows.selectExpr("g", "a", "cast(y AS long) AS _p", "cast(1 - y AS long) AS _n")
    assert stats.placements(counts, "a", ["g"]).count() == 21
    assert stats.delong(rows, "a", "b", "y", ["g"]).count() == 3


def test_kmers_of_long_and_missing_texts(spark):
    """Time in proportion to the length: 400,000 letters took minutes when each k-mer was sought from the start."""
    import random
    import time
    from collections import Counter

    letters = "".join(random.Random(5).choices("ACGUxé", k=400_000))
    df = spark.createDataFrame([(1, letters), (2, None), (3, ""), (4, "AA"), (5, "AAAA")], "k int, s string").repartition(2)
    began = time.perf_counter()
    got = {r.k: r for r in df.select("k", S.kmer_counts(F.col("s"), 3).alias("n"), F.size(S.kmers(F.col("s"), 3)).alias("m")).collect()}
    assert time.perf_counter() - began < 30
    names = [a + b + c for a in "ACGU" for b in "ACGU" for c in "ACGU"]
    want = Counter(letters[i : i + 3] for i in range(len(letters) - 2))
    assert got[1].n == [want[x] for x in names] and got[1].m == len(letters) - 2
    assert [sum(got[i].n) for i in (2, 3, 4, 5)] == [0, 0, 0, 2] and [got[i].m for i in (2, 3, 4, 5)] == [0, 0, 0, 2] and got[5].n[0] == 2
    assert spark.range(1).select(S.kmers(F.lit("aé😀b"), 2).alias("x")).first().x == ["aé", "é😀", "😀b"]


def test_missing_texts_have_no_pairs(spark):
    df = spark.createDataFrame([(1, None), (2, "ACACA")], "k int, s string")
    got = {r.k: r.c for r in df.select("k", S.dinucleotide_counts(F.col("s")).alias("c")).collect()}
    assert got[1] == [0] * 16 and got[2] == [0, 2, 0, 0, 2] + [0] * 11


def test_frequencies_make_their_counts_once(spark):
    df = spark.createDataFrame([("ACAC",), ("A",)], "s string")
    got = df.select(S.frequencies(F.array(*[F.regexp_count("s", F.lit(b)) for b in "ACG"])).alias("f"))
    assert [r.f for r in got.collect()] == [[0.5, 0.5, 0], [1, 0, 0]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") <= 3


def test_sharing_shuffles_hashes_once(spark):
    df = spark.createDataFrame([(1, ["a b", "c"]), (2, ["a b"]), (3, ["c", None]), (4, [None, "d"]), (5, None)], "k int, g array<string>")
    found = graphs.sharing(df, "k", "g")
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_pairs_of_letters_that_stand_for_others(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rows = [(i, t) for i, t in enumerate([None, "", "a", "The eİrAő uL, K-t!", "xyz", "aaaEEEi.iooo" * 3])]
    df = spark.createDataFrame(rows, "k int, s string")
    seq = F.regexp_replace(F.translate(F.lower("s"), "aeiotnshrdlu", "ACGUACGUACGU"), "[^ACGU]", "")
    own = S.kmer_counts(F.replace("s", F.lit("İ"), F.lit("i")), 2, written=("aeiotnshrdluAEIOTNSHRDLU", "ACGU" * 6))
    got = df.select(own.alias("a"), S.dinucleotide_counts(F.coalesce(seq, F.lit(""))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(got[3].a) == 9
