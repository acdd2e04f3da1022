"""Product codes against Lloyd's rounds over all points, and the balls of the trees."""

from __future__ import annotations

import numpy as np
import pytest

from clickloom.llm.topk import whole_components
from clickloom.llm.vector_codes import CodeOptions, build_tree, entries_of, owned_balls, square_distances, sums_of, train_and_encode, with_group_error
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, options):
    """(codebooks, {row: (entries, error)}) by comparing every part with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max(len(v) for _, _, v in rows) // options.parts)
    points = np.zeros((len(rows), options.parts * width), np.int64)
    for i, (_, _, v) in enumerate(rows):
        points[i, : len(v)] = v
    points = points.reshape(len(rows), options.parts, width)
    books = [points[: options.entries, p].copy() for p in range(options.parts)]
    for turn in range(options.rounds + 1):
        found = np.stack([square_distances(points[:, p], books[p]).argmin(axis=1) for p in range(options.parts)], axis=1)
        if turn < options.rounds:
            for p, book in enumerate(books):
                for e in range(len(book)):
                    own = points[found[:, p] == e, p]
                    if len(own):
                        book[e] = own.sum(axis=0) // len(own)
    error = sum(((points[:, p] - books[p][found[:, p]]) ** 2).sum(axis=1) for p in range(options.parts))
    return np.stack(books), sorted(((r[0], r[1], found[i].tolist(), int(error[i])) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [CodeOptions(parts=4, entries=8, block=50, leaf=4), CodeOptions(parts=2, entries=3, rounds=3), CodeOptions(parts=3, entries=400)])
def test_against_all_distances(spark, options):
    rng = np.random.default_rng(options.parts)
    vectors = rng.integers(-6, 7, (300, 12)).tolist()  # many ties and equal parts
    rows = [(i, int(i % 3) or None, v) for i, v in enumerate(vectors)]
    rows += [(7, 1, vectors[3]), (None, 2, vectors[0]), (400, None, [1, 2]), (401, 1, []), (402, 1, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("id", F.lit(1)).repartition(3)
    codes, books = train_and_encode(df, options)
    want_books, want = plain(rows, options)
    assert (books == want_books).all()
    got = sorted(((r["id"], r["label"], r["entries"], r["error"]) for r in codes.collect()), key=str)
    assert got == want


def test_odd_rows_and_group_errors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.1] * 16), (2, None, [0.2] * 16), (3, None, [0.3] * 16), (4, 1, None), (5, 1, [None] + [0.1] * 15), (6, 1, [nan] * 16), (7, 1, [-inf] * 16)]
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", "label", whole_components(F.col("embedding")).alias("vector"))
    codes, books = train_and_encode(df, CodeOptions(entries=1, rounds=1))
    found = {r["id"]: r for r in with_group_error(codes).collect()}
    assert sorted(found) == [1, 2, 3] and books.ravel().tolist() == [(25 + 51 + 76) // 3] * 16
    assert found[2]["label_error"] == found[3]["label_error"] == found[2]["error"] + found[3]["error"]
    codes, books = train_and_encode(df.where("vector is null"))
    assert codes.count() == 0 and not books.size


def test_balls_hold_their_points_and_whole_balls_are_owned():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (8, 4))
    points = (centres[rng.integers(0, 8, 3000)] + rng.integers(-40, 41, (3000, 4))).astype(np.int64)
    tree = build_tree(points, 20)
    assert sorted(tree.order) == list(range(3000)) and tree.depth.max() > 3
    for ball in range(len(tree.first)):
        own = points[tree.order[tree.first[ball] : tree.end[ball]]]
        assert np.sqrt(square_distances(own, tree.pivot[ball][None])).max() <= tree.radius[ball] + 1e-6
        assert (own.sum(axis=0) == tree.sums[ball]).all()
    balls, owners, loose, _ = owned_balls(tree, points, centres)
    assert len(loose) < 300 and (tree.end - tree.first)[balls].sum() == 3000 - len(loose) and len(balls) < 200
    found = entries_of(tree, points, centres)
    assert (found == square_distances(points, centres).argmin(axis=1)).all()
    sums, counts = sums_of(tree, points, centres)
    assert (counts == np.bincount(found, minlength=8)).all() and (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_equal_points_and_equal_entries():
    points = np.array([[3, 3]] * 50 + [[9, 9]], np.int64)
    book = np.array([[9, 3], [3, 9], [9, 3]], np.int64)  # as far from both points
    assert entries_of(build_tree(points, 4), points, book).tolist() == [0] * 51
