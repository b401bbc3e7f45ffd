import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lociflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(spark, texts, limit=64):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return packing.pack(docs, PATH, limit=limit).collect()


def test_round_trip_of_odd_texts(spark):
    rng = random.Random(3)
    alphabet = "abc ABC\n\t'sStTd  .,!#1٣é É ÇñßİΣς中文   ́\u0085<|endoftext|>Ǆﬁ"
    texts = [None, "", " \n", "It's the dogs' day, I'll say: don't!", "l'été C'EST fini..", "x" * 5000, *("".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(400))]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    found = {}
    for r in sorted(rows(spark, texts), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(found.setdefault(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4 == 1 << r.bucket <= 64 and r.offset == 0
        found[r.doc_id] += r.ids
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert found[i] == b"".join(x.to_bytes(4, "little") for x in want), t


def test_pieces_are_binary_digits():
    assert packing.decompose(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
    assert all(sum(packing.decompose(n, 16)) == n for n in range(100))
    with pytest.raises(ValueError):
        packing.pack(None, PATH, limit=3)


def test_ids_are_unique_and_empty_table_is_empty(spark):
    found = rows(spark, ["a b c d e"] * 9)
    assert len({r.sequence_id for r in found}) == len(found)
    assert rows(spark, []) == []
    assert zlib.crc32(b"") == 0
