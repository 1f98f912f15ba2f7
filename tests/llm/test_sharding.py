from __future__ import annotations

import math
import zlib
from collections import Counter
from hashlib import md5

from attestra.llm import sharding

TREE = sharding.regular_tree(16)


def place(spark, ids, tree, grown=None):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in ids], "doc_id long, text string, shard string")
    return sharding.shards(docs, tree, grown)


def brute_shard(key, tree):
    def draw(node, weight):
        u = (int(md5(f"{key}/{node}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weight

    def pick(nodes):  # number -> (name, weight)
        return min(nodes, key=lambda n: (draw(*nodes[n]), n))

    of = lambda keep: [x for x in tree if keep(x)]
    regions = {x.region for x in tree}
    r = pick({r: (f"r{r}", sum(x.weight for x in of(lambda x: x.region == r))) for r in regions})
    racks = {x.rack for x in of(lambda x: x.region == r)}
    k = pick({k: (f"r{r}/k{k}", sum(x.weight for x in of(lambda x: (x.region, x.rack) == (r, k)))) for k in racks})
    return pick({x.shard: (f"r{r}/k{k}/s{x.shard}", x.weight) for x in of(lambda x: (x.region, x.rack) == (r, k))})


def test_placement_equals_brute_force(spark):
    tree = sharding.reweigh(TREE, {3: 4.0, 7: 0.5})
    got = {r.doc_id: (r.shard, r.grown_shard) for r in place(spark, range(300), tree, sharding.grow(tree, 2.0)).collect()}
    assert got == {i: (brute_shard(i, tree), brute_shard(i, sharding.grow(tree, 2.0))) for i in range(300)}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    grown = sharding.grow(sharding.grow(TREE))
    rows = place(spark, range(3000), sharding.grow(TREE), grown).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and {r.grown_shard for r in moved} == {17}
    assert 0.6 < len(moved) / (3000 / 18) < 1.4


def test_other_weights_move_rows_only_where_a_subtree_changed(spark):
    rows = place(spark, range(3000), TREE, sharding.reweigh(TREE, {5: 3.0})).collect()
    region = {x.shard: x.region for x in TREE}
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(region[r.grown_shard] == region[5] for r in moved)
    assert max(Counter(r.grown_shard for r in rows).items(), key=lambda x: x[1])[0] == 5


def test_slots_sizes_and_odd_rows(spark):
    rows = [(i % 50, "é" * (i % 4), None) for i in range(400)] + [(7, None, 1)] * 300 + [(None, "a", 2)] * 5 + [(1, "x" * 100000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int")
    got = sharding.shards(docs, TREE, sharding.grow(TREE)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        ids = [r.doc_id for r in part]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    assert len({(r.doc_id, r.shard) for r in got}) == 51
    assert sharding.shards(docs.limit(0), TREE).collect() == []
