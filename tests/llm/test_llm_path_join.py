"""Chosen-path join against all pairs, in small nodes and large ones."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm.path_join import PathOptions, joining_links, minwise_tokens, near_classes, plausible_labels
from llm_texts import sentence


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def all_pairs(rows, options):
    sets = [(i, shingles(t, options.shingle)) for i, t in rows]
    lowest = {i: i for i, _ in rows}
    linked = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and 100 * len(a & b) >= options.percent * len(a | b)]
    while True:
        before = dict(lowest)
        for i, j in linked:
            lowest[i] = lowest[j] = min(lowest[i], lowest[j])
        if lowest == before:
            return {(i, len(s), lowest[i]) for i, s in sets}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
    return words


def corpus(seed):
    """Groups of near copies, one of many at about the threshold, and documents that share a passage."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = sentence(rng, rng.choice([3, 15, 60, 150]), 3000).split()
        rows += [changed(rng, base, rng.randrange(4)) for _ in range(rng.randint(1, 5))]
    dense = sentence(rng, 120, 3000).split()
    rows += [changed(rng, dense, rng.randrange(1, 7)) for _ in range(90)]
    passage = sentence(rng, 60, 3000).split()
    rows += [passage + sentence(rng, 60, 3000).split() for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("options", [PathOptions(), PathOptions(shingle=2, percent=70, leaf=12, leaf_shingles=800), PathOptions(leaf=20, levels=1, hashes=48)])
def test_against_all_pairs(make_docs, odd_texts, options):
    rows = corpus(options.percent) + [(1000 + i, t) for i, t in enumerate(odd_texts)]
    docs = make_docs(rows).withColumn("rep", F.lit(3)).withColumn("tokens", F.lit("x"))
    found = {tuple(r) for r in near_classes(docs, options).collect()}
    assert found == all_pairs(rows, options)


def test_copies_repeated_ids_null_ids_and_no_rows(make_docs):
    assert near_classes(make_docs([])).count() == 0
    text = "a b c d e f g h"
    rows = [(i, text) for i in range(300, 0, -1)] + [(None, text), (None, text), (7, "of its own, quite"), (400, "of its own, quite")]
    found = near_classes(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["doc_id"] is not None} == {1}  # id 7 joins its two texts
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]


def test_recall_sets_the_number_of_trees():
    options = PathOptions()
    assert 0.99 < options.tree_recall < 0.995 and options.trees == 3
    assert PathOptions(recall=0.9).trees == 1
    with pytest.raises(ValueError):
        PathOptions(hashes=12).branches(1)


def test_tokens_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    both, left, right = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate(x)) for x in ((both, left), (both, right), (left,))]
    tokens = minwise_tokens([*sets, np.zeros(0, np.uint64)], np.array([*map(len, sets), 0]), 2048)
    assert abs((tokens[0] == tokens[1]).mean() - 0.6) < 0.04 and abs((tokens[0] == tokens[2]).mean() - 0.25) < 0.04
    assert not tokens[3].any()


def test_classes_and_settled_pairs_are_not_compared_again():
    options = PathOptions(hashes=4)
    tokens, n = np.ones((4, 4), np.uint32), np.full(4, 9)
    classes, met = np.array([1, 1, 2, 3]), np.array([5, 6, 5, 7])
    assert plausible_labels(tokens, classes, met, n, options).tolist() == [0, 0, 0, 0]  # through the last one
    assert plausible_labels(tokens[:3], classes[:3], met[:3], n[:3], options).tolist() == [0, 1, 1]
    sets = [np.arange(20, dtype=np.uint64)] * 3
    assert [x.tolist() for x in joining_links(sets, classes[:3], met[:3], options)] == [[1], [2]]
