"""Filter audit against applying the filters one after the other in every order."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from clickloom.llm.filter_audit import audit_orders, removal_intervals, text_failures, with_lost
from llm_texts import sentence


def failing(rows):
    """(id, part, set of failed filters) by the plainest reading of the five conditions."""
    found = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        copies = [j for j, other, _ in rows if j is not None and (other or "") == text]
        fails |= {"E"} if i is not None and min(copies) < i else set()
        found.append((i, part or "", fails))
    return found


def one_after_the_other(rows, good, toxic, filters="ABCDE"):
    found = {}
    documents = failing(rows)
    for part in {p for _, p, _ in documents}:
        own = [(i, f) for i, p, f in documents if p == part]
        shapley = dict.fromkeys(filters, 0)
        for order in permutations(filters):
            left, before = own, []
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                found[part, "".join(order), step] = (
                    len(left),
                    len(gone),
                    sum(f in x[1] for x in before),
                    sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in gone),
                    sum(x[0] in toxic for x in gone),
                )
                before = before + gone
        for part_, order, step in list(found):
            if part_ == part:
                found[part, order, step] += (shapley[order[step - 1]],)
    return found


def documents(odd_texts):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = sentence(rng, rng.choice([5, 49, 50, 80]), rng.choice([8, 4000]))
        text += rng.choice(["", " 5 % off", " LOUD" * 30])
        rows.append((i, text, rng.choice(["a", "b", None, ""])))
    rows += [(100 + i, rows[i][1], "b") for i in range(9)] + [(5, rows[5][1], "a"), (5, "another text", "c"), (None, rows[7][1], "a")]
    return rows + [(200 + i, t, "odd") for i, t in enumerate(odd_texts)]


def test_against_every_order(spark, make_docs, odd_texts):
    rows = documents(odd_texts)
    docs = make_docs([(i, t, None, s) for i, t, s in rows]).withColumn("words", F.lit(1)).withColumn("part", F.lit("x"))
    ratings = [(i, i % 3, i % 2) for i in range(120)] + [(4, 1, None), (4, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(ratings, "doc_id long, quality int, toxic int")
    lost = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    audited = audit_orders(with_lost(text_failures(docs), labels, lost), lost=list(lost))
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in measures) for r in audited.collect()}
    good, toxic = ({r[0] for r in ratings if r[0] is not None and r[k] == 1} for k in (1, 2))
    assert got == one_after_the_other(rows, good, toxic)


def test_empty_tables_and_no_labels(spark, make_docs):
    assert audit_orders(text_failures(make_docs([]))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = audit_orders(with_lost(text_failures(make_docs([(1, None)])), labels, {"good": F.col("quality") == 1}), lost=["good"])
    assert found.count() == 600 and found.agg(F.sum("good")).first()[0] == 0


@pytest.mark.parametrize("filters", [1, 2, 4])
def test_intervals_cover_each_order_once(filters):
    orders = list(permutations(range(filters)))
    for mask in range(1, 1 << filters):
        steps = [None] * len(orders)
        for m, step, first, end in removal_intervals(filters):
            for rank in range(first, end) if m == mask else ():
                assert steps[rank] is None
                steps[rank] = step
        assert steps == [1 + min(i for i, f in enumerate(o) if mask >> f & 1) for o in orders]


def test_other_filters_and_names(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("q", False, True)], "team string, short boolean, dull boolean")
    found = audit_orders(rows, ["short", "dull"], part="team")
    got = {(r["team"], r["filter_order"], r["step"]): (r["filter"], r["kept"], r["removed"], r["redundant"]) for r in found.collect()}
    assert got["p", "dullshort", 1] == ("dull", 1, 1, 0)
    assert got["p", "dullshort", 2] == ("short", 0, 1, 1)
    assert got["q", "shortdull", 2] == ("dull", 0, 1, 0)
    with pytest.raises(ValueError):
        audit_orders(rows, ["short"] * 8)
