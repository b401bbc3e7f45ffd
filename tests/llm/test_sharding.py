import math
import zlib

import xxhash
from pyspark.sql import functions as F

from lociflow.llm import sharding


def weight(node):
    return sum(map(weight, node.values())) if isinstance(node, dict) else node


def place(tree, key):
    path, node = "", tree
    while isinstance(node, dict):
        draws = {c: -math.log(((xxhash.xxh64_intdigest(f"{path}/{c}|{key}".encode(), seed=42) >> 12) + 0.5) / 2**52) / weight(n) for c, n in node.items() if weight(n) > 0}
        best = min(draws, key=lambda c: (draws[c], str(c)))
        path, node = f"{path}/{best}", node[best]
    return best


def test_one_more_shard_takes_rows_only_into_itself():
    keys = [str(i) for i in range(300)]
    for first in (1, 16):
        tree = sharding.tree_of(first)
        before, moved = [place(tree, k) for k in keys], 0
        for shard in range(first, 64):
            tree = sharding.grown(tree, shard)
            now = [place(tree, k) for k in keys]
            moved += sum(a != b for a, b in zip(before, now))
            assert all(b in (a, shard) for a, b in zip(before, now))
            before = now
        assert moved > 200


def test_hashes_grow_with_the_children_on_the_way_not_with_the_shards():
    tree = {f"g{g}": {f"k{k}": {g * 100 + k * 10 + s: 1.0 for s in range(10)} for k in range(10)} for g in range(10)}
    levels = sharding._levels(tree)
    assert [len(v) for v in levels] == [1, 10, 100] and all(len(c) == 10 for v in levels for c in v.values())


def test_equals_descent_by_hand_and_moves_only_where_weights_change(spark):
    tree = sharding.tree_of(16)
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    at = lambda t: {r.doc_id: r.s for r in sharding.place(ids, F.col("doc_id"), t, "s").collect()}
    old = at(tree)
    assert old == {i: place(tree, str(i)) for i in old}
    assert len(set(old.values())) == 16 and max(list(old.values()).count(s) for s in range(16)) < 300
    new = at(sharding.grown(tree, 16))
    assert 100 < sum(new[i] != old[i] for i in old) < 260 and all(new[i] == 16 for i in old if new[i] != old[i])
    region = {s: g for g, racks in tree.items() for shards in racks.values() for s in shards}
    rack = {s: (g, k) for g, racks in tree.items() for k, shards in racks.items() for s in shards}
    tree["g1"]["k0"][4] = 3.0
    heavy = at(tree)
    for i in old:
        if heavy[i] != old[i]:
            assert region[heavy[i]] == "g1"  # from another region into this one
            assert region[old[i]] != "g1" or rack[heavy[i]] == ("g1", "k0")  # inside it, into the rack
            assert rack[old[i]] != ("g1", "k0") or heavy[i] == 4  # inside that, into the shard
    assert 150 < sum(heavy[i] != old[i] for i in old) < 900
    tree["g1"]["k0"][4] = 0.0
    light = at(tree)
    assert 4 not in light.values() and all(region[old[i]] == "g1" for i in old if light[i] != old[i])


def test_slots_are_gapless_and_texts_measured(spark):
    rows = [(i % 40, f"té{i}", "z") for i in range(200)] + [(None, None, "z")] * 5 + [(7, "", "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    out = sharding.assign(docs, sharding.tree_of(16), sharding.grown(sharding.tree_of(16), 16)).collect()
    assert len(out) == len(rows)
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.size == 1 and r.text_crc32 == 0 for r in out if r.doc_id is None)
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 3} == {(len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t, _ in rows if d == 3}
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert sharding.assign(docs.limit(0), sharding.tree_of(16)).collect() == []
