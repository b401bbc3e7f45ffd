import random
import re
from collections import Counter, defaultdict

import numpy as np

from lociflow.llm import divergence


def brute(rows, least_docs, ranks):
    """All rows of the audit of (lang, source, text)."""
    terms = lambda t: [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = terms(text)
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted({r[1] for r in rows if r[0] == lang})
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))
        p = {s: {t: share(count[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            far = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:ranks]
            out |= {(lang, s, part, i.decode(), -v, r) for part, found in (("pair", far), ("term", more)) for r, (v, i) in enumerate(found, 1)}
    return out


def random_rows(rng, n):
    vocab = ["the", "The", "ÉTÉ", "Été", "naïve", "x1y", "日本", "ﬀ", "a_b", "don't"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(None, None, None), ("en", "s1", None), ("en", "empty", ""), ("", "s1", "the"), ("xx", "alone", "never often"), ("xx", "other", None)]
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", None, "s3"])
        words = rng.choices(vocab, weights=[1 / (i + 1) for i in range(len(vocab))], k=rng.choice([0, 1, 5, 60]))
        rows.append((lang, source, rng.choice([" ", "\n", "--", "\x00"]).join(words) + rng.choice(["", ".", " Ω"])))
    return rows


def test_terms_are_those_of_the_expression_across_documents_without_separator():
    texts = ["abc", "DEF ghi", "", "é", "É1x", "9", "z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, doc = divergence.bounds(data, offsets)
    found = [(d, data[a:b].tobytes().decode()) for a, b, d in zip(starts, ends, doc)]
    assert found == [(0, "abc"), (1, "DEF"), (1, "ghi"), (3, "é"), (4, "É"), (4, "x"), (6, "z")]
    assert [len(x) for x in divergence.bounds(np.zeros(0, np.uint8), np.array([0, 0]))] == [0, 0, 0]


def test_equal_hashes_of_unequal_bytes_are_told_apart():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 4))).encode() for _ in range(500)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = divergence.bounds(data, np.array([0, len(data)]))
    for digest in (lambda x: 7, len, lambda x: x[0]):
        number, names = divergence.grouped(data, starts, ends, digest)
        assert [names[i] for i in number] == words and len(set(names)) == len(names)


def test_audit_equals_brute_force_with_few_and_many_blocks_and_tiles(spark, monkeypatch):
    rng = random.Random(2)
    rows = random_rows(rng, 400)
    docs = spark.createDataFrame([(l, s, t, 1, "x") for l, s, t in rows + rows[50:90]], "lang string, source string, text string, n int, term string").repartition(5)
    want = brute(rows + rows[50:90], 4, 7)
    assert {r[2] for r in want} == {"pair", "term"} and len({r[0] for r in want}) == 4
    for buffer, block, tile in ((4_000_000, 1024, 256), (50, 9, 2)):
        monkeypatch.setattr(divergence, "BUFFER", buffer)
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "TILE", tile)
        out = [tuple(r) for r in divergence.audit(docs, least_docs=4, ranks=7).collect()]
        assert len(out) == len(set(out)) and set(out) == want


def test_audit_of_no_rows_and_of_a_very_long_text(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    long = "alpha beta " * 300_000
    rows = [("en", "a", long)] + [("en", "b", "alpha beta gamma")] * 30
    out = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()}
    assert out == brute(rows, 30, 50)
