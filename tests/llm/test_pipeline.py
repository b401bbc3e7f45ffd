import re

import public_tokenizers
from test_jaccard import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lociflow.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = common.read(spark, SF, "documents")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 !!", "en", "s", 8)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    folder, seen = common.shared_dir(spark), {}
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), folder, name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = {r.doc_id: r.text for r in seen["language_id"]}
    assert kept == {i: t for i, t in before.items() if i < 10**6}
    ids = sorted(kept)
    roots = {ids[c] for _, _, c in brute([kept[i] for i in ids], 5, 80)}
    assert {r.doc_id for r in seen["near_duplicates"]} == roots and len(roots) < len(ids)
    items = [re.findall(r"\w+", r.text.lower()) for r in common.read(spark, SF, "benchmark").collect()]
    leaks = lambda t: any(f" {' '.join(w)} " in f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " for w in items)
    clean = {r.doc_id for r in seen["decontamination"]}
    assert clean == {i for i in roots if not leaks(kept[i])} and len(clean) < len(roots)
    private = re.compile(r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)|\S+@\S+|(?<!\d)\d{16}(?!\d)|[0-9a-fA-F]{40}|\(\d{3}\) \d{3}-\d{4}")
    after = {r.doc_id: r.text for r in seen["personal_data"]}
    assert set(after) == clean
    for i, t in after.items():
        assert not set(private.findall(kept[i])) & set(private.findall(t)) and private.sub("", kept[i]) == private.sub("", t)
    tokenizer, found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in sorted(seen["packing"], key=lambda r: (r.doc_id, r.start)):
        found[r.doc_id] = found.get(r.doc_id, b"") + r.ids
    assert found == {i: b"".join(x.to_bytes(4, "little") for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in after.items()}


def test_run_on_clashing_columns(spark, tmp_path):
    docs = common.read(spark, SF, "documents").limit(20).selectExpr("*", "1 AS node", "'x' AS words", "2 AS _text_key2", "3 AS _language")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), common.shared_dir(spark), name)
        assert docs.columns[-4:] == ["node", "words", "_text_key2", "_language"]


def test_run_on_empty_documents_and_on_a_very_long_text(spark, tmp_path):
    docs, benchmark = (common.read(spark, SF, n) for n in ("documents", "benchmark"))
    benchmark.write.parquet(str(tmp_path / "none/benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    long = " ".join(f"{w} number {i}" for i, w in enumerate(["the house and the river are far from the old town"] * 20_000))
    benchmark.write.parquet(str(tmp_path / "long/benchmark.parquet"))
    rows = spark.createDataFrame([(10**7, long, "en", "s", len(long)), (10**7 + 1, long + " end", "en", "s", len(long) + 4)], docs.schema)
    docs.unionByName(rows).write.parquet(str(tmp_path / "long/documents.parquet"))
    out = {r.doc_id: r.n for r in corpus_pipeline.run(spark, str(tmp_path / "long")).where(f"doc_id >= {10**7}").groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    tokens = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(long, add_special_tokens=False).ids) + 1
    assert out == {10**7: tokens}  # the copy goes, and the rest is whole
