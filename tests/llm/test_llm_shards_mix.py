"""Sharding and mixing against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clickloom.llm.mixing import MixOptions, mix_sources, source_targets, take_mix
from clickloom.llm.sharding import KEY_BITS, ShardOptions, assign_shards, find_cuts
from llm_texts import sentence


def least_capacity(sizes, shards):
    def fits(capacity):
        used, room = 0, 0
        for size in sizes:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("groups, bits", [(1, 3), (5, 3), (300, 2), (300, 12)])
def test_cuts_have_least_capacity(spark, groups, bits):
    rng = random.Random(groups + bits)
    rows = sorted((rng.randrange(1 << KEY_BITS), rng.choice([1, 5, 30, 400]), 1) for _ in range(groups))
    options = ShardOptions(shards=7, first_bits=bits, more_bits=2, margin=1)
    cuts, count = find_cuts(spark.createDataFrame(rows, "key long, size long, rows long"), options)
    assert count == groups and cuts == sorted(cuts) and len(cuts) == 6
    sums = Counter()
    for key, size, _ in rows:
        sums[sum(key >= c for c in cuts)] += size
    assert max(sums.values()) == least_capacity([s for _, s, _ in rows], 7)


def test_shards_keep_groups_and_slots(make_docs, odd_texts):
    rng = random.Random(2)
    texts = odd_texts[:4] + odd_texts[5:] + [sentence(rng, rng.randint(1, 40)) for _ in range(300)] + ["copy"] * 150 + [None] * 5
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "twice")]).withColumn("shard", F.lit("x"))
    rows = assign_shards(docs).collect()
    assert len(rows) == len(texts) + 2
    by_text, slots, sizes = {}, defaultdict(list), Counter()
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert by_text.setdefault(r["text"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < mean + 900
    again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in assign_shards(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows}


def test_shards_of_nothing(make_docs):
    assert assign_shards(make_docs([])).count() == 0
    assert [tuple(r) for r in assign_shards(make_docs([(1, None)])).select("size", "slot").collect()] == [(1, 0)]


def targets(sizes, options=MixOptions()):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: options.weights[i % len(options.weights)] for i, s in enumerate(names)}
    left, open_, found = options.share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > options.most * sizes[s]}
        if not over:
            return found | {s: weight[s] * level for s in open_}
        for s in over:
            found[s] = options.most * sizes[s]
            left -= found[s]
        open_ -= over


def test_targets_are_shared_again(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 1, 50, 1000, 9000]) for i in range(rng.randint(1, 9))} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def mixed_docs(make_docs, odd_texts):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.choice([1, 4, 30, 200])), "en", rng.choice(["a", "a", "a", "b", "c", None, "ü"])) for i in range(400)]
    return rows + [(1000 + i, t, None, "d") for i, t in enumerate(odd_texts[:4] + odd_texts[5:])] + [(7, "x y", None, "b")] * 3


def test_mix_meets_targets(make_docs, odd_texts):
    rows = mixed_docs(make_docs, odd_texts)
    docs = make_docs(rows).withColumn("rate", F.lit(1)).withColumn("size", F.lit("old"))
    found = mix_sources(docs).collect()
    assert len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert target == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * 200 for s in sizes)
    again = {(r["doc_id"], r["copies"]) for r in mix_sources(docs.repartition(5)).collect() if r["doc_id"] != 7}
    assert again == {(r["doc_id"], r["copies"]) for r in found if r["doc_id"] != 7}


def test_mix_of_nothing_and_repeats(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    assert [r["copies"] for r in mix_sources(make_docs([(1, None, None, "a")])).collect()] == [0]
    docs = make_docs([(i, "a b c", None, "s") for i in range(20)]).withColumn("size", F.lit("own"))
    repeated = take_mix(docs)
    assert repeated.columns == docs.columns and [r["size"] for r in repeated.collect()] == ["own"] * 30
