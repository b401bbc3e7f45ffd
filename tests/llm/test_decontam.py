import itertools
import math
import random

from lociflow.llm import decontam


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string")


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_substitutions_shifts_and_short_items(spark):
    rng = random.Random(6)
    item = [f"q{i}" for i in range(40)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    swapped = list(item)
    for i in range(4, 40, 7):
        swapped[i] = "other"
    docs = {
        0: noise(30) + item + noise(20),
        1: noise(11) + swapped + noise(5),
        2: noise(9) + item[10:26] + noise(9),
        3: noise(200),
        4: noise(5) + item[:6] + noise(6) + item[20:26],
        5: ["Tiny", "short", "ITEM!"],
        6: noise(3) + ["short", "item"],
    }
    rows = [(i, " ".join(w).upper() if i == 1 else " ".join(w), "x") for i, w in docs.items()] + [(7, None, "x"), (8, "", "x"), (0, " ".join(docs[0]), "x")]
    items = [(10, " ".join(item)), (11, "tiny short item"), (12, None), (13, ""), (9, " ".join(item)), (14, "a")]
    got = sorted((r.doc_id, r.item_id, r.matched, r.item_tokens) for r in decontam.contaminated(frame(spark, rows), bench(spark, items)).collect())
    assert got == [(0, 9, 40, 40), (0, 9, 40, 40), (1, 9, 34, 40), (2, 9, 16, 40), (5, 11, 3, 3)]
    clean = decontam.clean(frame(spark, rows), bench(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 6, 7, 8] and clean.columns == ["doc_id", "text", "item_id"]


def test_empty_tables(spark):
    some = frame(spark, [(1, "a b c", "x")])
    assert decontam.contaminated(some, bench(spark, [])).collect() == []
    assert decontam.contaminated(some.limit(0), bench(spark, [(1, "a b c")])).collect() == []
    assert decontam.clean(some, bench(spark, [])).count() == 1


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    text = " ".join(f"w{i}" for i in range(20))
    assert decontam.contaminated(frame(spark, [(1, text, "x")]), bench(spark, [(5, text)])).first().item_id == 5


def test_masks_hit_every_accepted_placement():
    for n in range(1, 14):
        wrong = n - math.ceil(0.8 * n)
        for bad in itertools.combinations(range(n), wrong):
            assert any(not {at + p for p in m} & set(bad) for m in decontam.masks_of(n, 0.8) for at in range(n - max(m))), (n, bad)


def test_equals_alignment_without_seeds(spark):
    rng = random.Random(8)
    items = [[f"i{n}x{j}" for j in range(n)] for n in range(1, 21)]
    texts = []
    for w in items:
        for _ in range(12):
            t = list(w)
            for i in rng.sample(range(len(t)), min(len(t), rng.randint(0, 4))):
                t[i] = "other"
            texts.append(["n"] * rng.randint(0, 3) + t[rng.choice([0, 0, 1]) : len(t) - rng.choice([0, 0, 1])] + ["n"] * rng.randint(0, 3))

    def overlap(t, w):
        width, best = min(13, len(w)), 0
        for shift in range(-len(w), len(t)):
            same = [0 <= j + shift < len(t) and t[j + shift] == x for j, x in enumerate(w)]
            if max(sum(same[i : i + width]) for i in range(len(w) - width + 1)) >= math.ceil(0.8 * width):
                best = max(best, sum(same))
        return best

    want = sorted((i, k, m, len(w)) for i, t in enumerate(texts) for k, w in enumerate(items) if (m := overlap(t, w)))
    docs = frame(spark, [(i, " ".join(t), "x") for i, t in enumerate(texts)])
    got = decontam.contaminated(docs, bench(spark, [(k, " ".join(w)) for k, w in enumerate(items)])).collect()
    assert sorted((r.doc_id, r.item_id, r.matched, r.item_tokens) for r in got) == want and len(want) > 60
