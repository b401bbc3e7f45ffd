import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lociflow.llm import simhash


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """For each position the smallest position that links reach."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def noisy(rng, n):
    """Fingerprints in dense groups, in chains of three bits and alone."""
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 40])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            out.append(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), 3):
                centre ^= 1 << b
            out.append(centre)
    return out[:n]


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One two", "É a b", "A É b c", "x " * 70_000, "a b c " * 3]
    texts += [" ".join(rng.choices("abc dé F gh".split(), k=rng.randint(1, 400))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(simhash.shingle_hashes(t, 3)) == brute_fingerprint(t)


def test_links_connect_what_brute_force_connects_at_any_lead_and_memory():
    for seed, radius, t, held in ((1, 3, 0, 10**9), (2, 3, 4, 3000), (3, 3, 9, 10**9), (4, 2, 3, 500), (5, 1, 5, 200), (6, 4, 2, 10**9), (7, 0, 3, 100)):
        rng = random.Random(seed)
        fps = sorted(set(noisy(rng, 250)) | {0, 1, 2**64 - 1})
        found = []
        for lead in range(1 << t):
            found += [p for some in simhash.links_below(np.array(fps, np.uint64), lead, t, radius, held) for p in some.tolist()]
        assert all((a ^ b).bit_count() <= radius and a != b for a, b in found)
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            root[find(b)] = find(a)
        groups = {}
        for x, r in zip(fps, brute_components(fps, radius)):
            groups.setdefault(r, set()).add(find(x))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_a_dense_group_gives_few_links():
    rng = random.Random(9)
    fps = {0}
    while len(fps) < 1500:
        fps.add(sum(1 << b for b in rng.sample(range(64), 2)))
    found = [p for some in simhash.links_below(np.array(sorted(fps), np.uint64), 0, 0, 3) for p in some.tolist()]
    assert len({tuple(p) for p in found}) < 40 * len(fps) < len(fps) ** 2 / 10


def test_spark_hash_leads_hold_all_variants(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    rows = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    for t, radius in ((3, 3), (11, 3), (6, 2)):
        for r in rows.select("fp", simhash.leads(F.col("fp"), t, radius).alias("l")).collect():
            x = r.fp % 2**64
            n = radius // 2 + (radius % 2) * (x.bit_count() % 2)
            assert set(r.l) == {p for p in range(1 << t) if (p ^ (x >> (64 - t))).bit_count() <= n} and len(set(r.l)) == len(r.l)


def test_classes_equal_brute_force_on_any_rows(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "one", "One  two", "one two"]
    while len(texts) < 300:
        base = rng.choices(vocab, k=rng.choice([3, 30, 300, 1500]))
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[40:60] + [(None, "alone with no id at all", "x", 1, 2)], "doc_id long, text string, fp string, lead int, root int").repartition(7)
    out = simhash.classes(docs).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, 3)
    assert len(out) == len(texts) + 21 and len(set(want)) < len(set(fps)) < len(texts)
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id]) for r in out if r.doc_id is not None)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash.classes(docs.limit(0)).collect() == []
