import gzip

from pyspark.sql import functions as F

from lociflow.sources import panels


def test_panels_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("B", "K", 300), ("A", "K", 20), ("A", "H", 500), ("C", "K", None)], panels.PANEL)
    panels.write_panel(df, F.col("pairs") >= 100, F.when(F.col("pairs").isNull(), "no pairs").otherwise("few"), str(tmp_path))
    read = lambda name, **o: [tuple(r) for r in panels.panel(spark, str(tmp_path / name), **o).collect()]
    assert sorted(read("panel")) == [("A", "H", 500), ("B", "K", 300)] and read("panel", least_pairs=400) == [("A", "H", 500)]
    assert read("excluded") == [("A", "K", 20)]
    (tmp_path / "odd.tsv").write_text("protein\tcell_line\tpairs\nX\tK\tmany\nY\tK\t 7\n")
    assert read("odd.tsv") == [("Y", "K", 7)]


def test_scores_are_unpacked_by_their_bytes(spark, tmp_path):
    text = "id\tlabel\tfold\tscore\na\t1\t0\t0.5\nb\t0\t1\t\nc\tx\t2\tbad\n"
    (tmp_path / "one.scores.tsv.gz").write_bytes(text.encode())
    (tmp_path / "two.scores.tsv").write_bytes(gzip.compress(text.replace("a\t", "d\t").encode()))
    (tmp_path / "none.scores.tsv").write_bytes(b"")
    (tmp_path / "less.scores.tsv").write_text("score\tid\n1.5\te\n")
    got = {(r.id, r.label, r.fold, r.score) for r in panels.scores(spark, str(tmp_path / "*.scores.tsv*")).collect()}
    assert got == {("a", 1, 0, 0.5), ("d", 1, 0, 0.5), ("b", 0, 1, None), ("c", None, 2, None), ("e", None, None, 1.5)}


def test_genes_with_their_largest_expression(spark, tmp_path):
    line = lambda chrom, kind, a, b, strand, gid: f'{chrom}\tx\t{kind}\t{a}\t{b}\t.\t{strand}\t.\tgene_id "{gid}"; gene_name "n";'
    rows = [line("chr1", "gene", 11, 20, "+", "ENSG1.4"), line("chr1", "exon", 11, 20, "+", "ENSG1.4"), line("chrM", "gene", 1, 5, "+", "ENSG9.1"), line("chrX", "gene", 1, 5, "-", "ENSG2.1")]
    (tmp_path / "a.gtf").write_text("#h\n" + "\n".join(rows) + "\n")
    for name, tpm in (("q1", 3.5), ("q2", 7.25)):
        (tmp_path / f"{name}.tsv").write_text(f"gene_id\tlength\tTPM\nENSG1.2\t5\t{tpm}\nspike\t1\t99\n")
    got = {tuple(r) for r in panels.genes(spark, str(tmp_path / "a.gtf"), {"K": [str(tmp_path / "q1.tsv"), str(tmp_path / "q2.tsv")]}).collect()}
    assert got == {("chr1", 10, 20, "+", "ENSG1", 7.25), ("chrX", 0, 5, "-", "ENSG2", None)}


def test_positive_windows_count_once(spark):
    rows = [("b", 1, "chr1", 5, 9, "+"), ("a", 1, "chr1", 5, 9, "+"), ("c", 0, "chr1", 5, 9, "+"), ("d", 1, "chr1", 5, 9, "-")]
    df = spark.createDataFrame(rows, "id string, label int, chrom string, start long, end long, strand string")
    assert {tuple(r) for r in panels.positives(df).collect()} == {rows[1], rows[3]}
