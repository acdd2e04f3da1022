"""Jaccard join against all pairs, with every option that only changes the work."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from clickloom.llm import jaccard_join
from clickloom.llm.components import connected_components
from clickloom.llm.jaccard_join import JoinOptions, jaccard_components, keep_representatives, linked_labels
from llm_texts import sentence


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def all_pairs(rows, options):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, options.shingle)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= options.percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {(i, len(s), root(i)) for i, s in sets}


def near_copies(seed, groups=6, copies=6):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(groups):
        words = sentence(rng, rng.choice([3, 12, 40, 90, 200])).split()
        for _ in range(rng.randint(1, copies)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "W7", "zz"])
            rows.append((number, " ".join(copy)))
            number += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "options",
    [
        JoinOptions(),
        JoinOptions(shingle=3, percent=90),
        JoinOptions(shingle=2, percent=60, common=2, common_limit=20, shared_part=1000),
        JoinOptions(shingle=2, percent=70, region_shingles=50, leaf_documents=2, pivots=2, shared_part=5),
    ],
)
def test_against_all_pairs(make_docs, odd_texts, options):
    rows = near_copies(options.percent) + [(1000 + i, t) for i, t in enumerate(odd_texts)]
    got = {tuple(r) for r in jaccard_components(make_docs(rows), options).collect()}
    assert got == all_pairs(rows, options)


def test_chains_of_links(make_docs):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(20):  # each is near the next only
        rows.append((50 - i, " ".join(words)))
        words[3 * i] = f"new{i}"
    options = JoinOptions(shingle=1, percent=95, region_shingles=200, pivots=2)
    assert {r[2] for r in jaccard_components(make_docs(rows), options).collect()} == {31}


@pytest.mark.parametrize("options", [JoinOptions(shingle=3, percent=90), JoinOptions()])
def test_regions_are_split_level_by_level(make_docs, monkeypatch, options):
    rng = random.Random(9)
    words, rows, at = [f"w{i}" for i in range(4000)], [], 0
    for number in range(400):  # a long band of texts, each near the next ones only, with gaps
        rows.append((number, " ".join(words[at : at + 120])))
        at += 40 if number % 200 == 99 else rng.choice([1, 2, 3])
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    levels = []
    split = jaccard_join._voronoi_cells
    monkeypatch.setattr(jaccard_join, "_voronoi_cells", lambda big, level, o: levels.append(level) or split(big, level, o))
    got = {tuple(r) for r in jaccard_components(make_docs(rows), options).collect()}
    assert got == all_pairs(rows, options)
    assert len({c for _, _, c in got}) > 1 and max(levels) >= (1 if options.percent == 90 else 0)  # at 80 windows are wide: blocks follow


def test_long_unrelated_documents_are_in_no_region(make_docs, monkeypatch):
    rng = random.Random(3)
    passages = [sentence(rng, 800, 10**6) for _ in range(31)]
    rows = [(i, f"{passages[i]} {sentence(rng, 1400, 10**6)} {passages[i + 1]}") for i in range(30)]  # each shares with the next
    rows.append((100, rows[0][1] + " more"))
    found, join = [], jaccard_join._join_regions
    monkeypatch.setattr(jaccard_join, "_join_regions", lambda texts, regions, o: found.extend(regions.collect()) or join(texts, regions, o))
    got = {tuple(r) for r in jaccard_components(make_docs(rows)).collect()}
    assert got == all_pairs(rows, JoinOptions())
    assert {(r["rep"], r["region"]) for r in found} == {(0, 0), (100, 0)}


def test_vectors_of_unlike_widths_bound_the_distance():
    rng = np.random.default_rng(5)
    sets = [rng.choice(2**40, n, replace=False).astype(np.uint64) for n in (300, 500, 520, 1000, 1100, 5000)]
    sets += [np.concatenate((x[: len(x) * 9 // 10], rng.choice(2**40, len(x) // 5, replace=False).astype(np.uint64))) for x in sets]
    widths = [jaccard_join._classes(len(x)) for x in sets]
    rows = [np.minimum(np.bincount((x & np.uint64(w - 1)).astype(np.int64), minlength=w), 255).astype(np.uint8).tobytes() for x, w in zip(sets, widths)]
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = jaccard_join._Vectors(np.array(rows, object)).apart(a, b)
    assert len(set(widths)) > 3
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(apart, a, b))


@pytest.mark.parametrize("round_", [1, 3])
def test_blocks_meet_some_at_a_time(make_docs, monkeypatch, round_):
    rng = random.Random(4)
    words, rows, at = [f"w{i}" for i in range(2000)], [], 0
    for number in range(120):  # a band, which pivots do not divide at 80 %
        rows.append((number, " ".join(words[at : at + 100])))
        at += 30 if number == 70 else rng.choice([1, 2, 3])
    options = JoinOptions(region_shingles=4000, block_round=round_)
    made, leaves = [], jaccard_join._join_leaves
    monkeypatch.setattr(jaccard_join, "_join_leaves", lambda members, o: made.append(members.count()) or leaves(members, o))
    got = {tuple(r) for r in jaccard_components(make_docs(rows), options).collect()}
    assert got == all_pairs(rows, options)
    assert max(made) <= round_ * len(rows) < sum(made)


def test_large_intermediate_results_go(spark, make_docs, monkeypatch):
    tables, save = [], jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df: tables.append(save(df)) or tables[-1])
    rows = near_copies(7, groups=4, copies=30)
    found = jaccard_components(make_docs(rows), JoinOptions(leaf_documents=2, region_shingles=100))
    assert {tuple(r) for r in found.collect()} == all_pairs(rows, JoinOptions())
    wide = [t for t in tables if {"cells", "cell", "text", "shingles"} & set(t.columns)]
    assert len(wide) > 4 and not any(Path(t._saved_path.removeprefix("file:")).exists() for t in wide)


def test_saved_leaves_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {f.name for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before = files()
    jaccard_join.saved(spark.range(1000).selectExpr("id % 7 as k").distinct())
    for _ in range(50):  # they are deleted in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_filter_lets_all_asked_for_through(spark):
    rows = spark.range(20_000).selectExpr("if(id = 0, null, id) as id", "'x' as text")
    ids = spark.range(0, 20_000, 40).where("id > 0").selectExpr("id as rep")
    for options in (JoinOptions(), JoinOptions(filter_words=4)):  # one too small for so many ids
        got = [r["id"] for r in jaccard_join._may_be_among(rows, "id", ids, options).collect()]
        assert len(got) == len(set(got)) and set(range(40, 20_000, 40)) <= set(got)
        assert options.filter_words == 4 or len(got) < 2000


def test_dense_class_costs_no_pairs():
    base = np.arange(200, dtype=np.uint64)
    sets = [np.sort(np.append(base, np.uint64(1000 + i))) for i in range(500)] + [np.array([5], np.uint64)]
    assert linked_labels(sets, JoinOptions()).tolist() == [0] * 500 + [500]


def test_empty_table_null_ids_and_other_columns(make_docs):
    assert jaccard_components(make_docs([])).count() == 0
    docs = make_docs([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])
    clashing = docs.withColumn("cell", docs.text).withColumn("n_shingles", docs.doc_id)
    assert sorted(map(tuple, jaccard_components(clashing).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    kept = keep_representatives(clashing)
    assert kept.columns == clashing.columns
    nulls = make_docs([(None, "a b"), (None, "a b"), (None, None), (None, None), (4, "c d"), (4, "c d")])
    assert keep_representatives(nulls).count() == 5
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, None]


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (141, 140), (141, 140)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(50), 0), **dict.fromkeys(range(100, 142), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
