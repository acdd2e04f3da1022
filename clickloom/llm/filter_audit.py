"""How filters interact, over every order in which they can be applied.

A document enters as the mask of the filters it fails; a filter removes it where
it is the first of the mask in the order. Orders are numbered by their Lehmer
rank, that is lexicographically, so all orders that begin alike are an interval
of ranks: a mask is removed at step s by the interval of every beginning whose
s-th filter is its first one in the mask. Counts of a mask are added where such an
interval begins and taken off where it ends; the running sum over the ranks is
what each order removes at that step. The work after counting the masks depends on
the number of filters and of parts, not of documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.storage import saved

WORD_GAPS = r"[\x20\x09-\x0D]+"
TEXT_FILTERS = ("A", "B", "C", "D", "E")
MOST_FILTERS = 7


def text_failures(docs: DataFrame, id_column: str = "doc_id", part_column: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E) of each row: the filters that its whole text fails.

    A: under 50 words. B: under 65 distinct words in a hundred, with regard to
    case. C: more than 5 of a hundred characters are A-Z. D: one of ``#$%&*|``.
    E: a smaller id has the same text; texts are compared by SHA-256. A null text
    is an empty one and equals it. A row without an id fails E neither itself nor
    for others; rows that repeat an id do not fail it through each other. Words are
    runs without ASCII white space. The part is a text, empty for null. Other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_GAPS), ""))
    judged = saved(
        rows.select(
            "id",
            "part",
            (F.size("words") < 50).alias("A"),
            (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
            (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 5 * F.length("text")).alias("C"),
            F.col("text").rlike("[#$%&*|]").alias("D"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
        )
    )
    firsts = judged.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E")
    return judged.join(firsts, "digest", "left").select("id", "part", "A", "B", "C", "D", copy)


def with_lost(failures: DataFrame, labels: DataFrame, lost: dict[str, Column], id_column: str = "doc_id") -> DataFrame:
    """``failures`` with a boolean for each condition on ``labels``: some label row of the id meets it."""
    met = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in lost.items()])
    return failures.join(met, "id", "left").fillna(False, list(lost))


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): orders of these ranks, end exclusive, remove the mask at that step."""

    def walk(mask: int, left: tuple[int, ...], first: int) -> Iterator[tuple[int, int, int]]:
        block = factorial(len(left) - 1)
        for digit, f in enumerate(left):
            begin = first + digit * block
            if mask >> f & 1:
                yield filters - len(left) + 1, begin, begin + block
            else:
                yield from walk(mask, left[:digit] + left[digit + 1 :], begin)

    found = []
    for mask in range(1, 1 << filters):
        ends: dict[int, int] = {}
        for step, begin, end in sorted(walk(mask, tuple(range(filters)), 0)):
            if ends.get(step) == begin:  # neighbours are one interval
                begin = found.pop()[2]
            found.append((mask, step, begin, end))
            ends[step] = end
    return found


def audit_orders(
    failures: DataFrame, filters: Sequence[str] = TEXT_FILTERS, lost: Sequence[str] = (), part: str = "part"
) -> DataFrame:
    """One row per part, order of the filters and step, with counts of rows of the part.

    ``failures`` has a boolean column for each filter, in the order that ranks
    follow, and for each name in ``lost``; null counts as false. Columns: the part,
    ``filter_order`` (names put together), ``step`` from 1, ``filter`` at the step,
    ``kept`` after it, ``removed`` at it, ``redundant`` (fail it, removed earlier),
    ``unique_fails`` (fail it only), one column for each of ``lost`` (removed at it
    and true), ``shapley`` (removed by the filter, over all orders). No rows give
    no parts. At most ``MOST_FILTERS`` filters, as there are factorial many orders.
    """
    count = len(filters)
    if not 0 < count <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters are audited")
    spark = failures.sparkSession
    fails = [F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    mask = sum(fails[1:], fails[0])
    measures = ["rows", *(f"lost_{i}" for i in range(len(lost)))]
    masks = saved(
        failures.select(F.col(part).alias("part"), mask.alias("mask"), *[F.col(n).cast("long").alias(m) for n, m in zip(lost, measures[1:])])
        .groupBy("part", "mask")
        .agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures[1:]])
    )
    intervals = spark.createDataFrame(removal_intervals(count), "mask int, step int, first int, end int")
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    deltas = masks.join(intervals, "mask").select("part", "step", ends.alias("at"), *measures)
    deltas = deltas.groupBy("part", "step", "at.rank").agg(*[F.sum(F.col(m) * F.col("at.sign")).alias(m) for m in measures])

    bit = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(count)]
    alone = [F.col("mask") == (1 << i) for i in range(count)]
    parts = masks.groupBy("part").agg(
        F.sum("rows").alias("total"),
        F.array(*[F.sum(F.when(b, F.col("rows")).otherwise(0)) for b in bit]).alias("failing"),
        F.array(*[F.sum(F.when(a, F.col("rows")).otherwise(0)) for a in alone]).alias("alone"),
    )
    named = [(rank, "".join(filters[i] for i in order), list(order)) for rank, order in enumerate(permutations(range(count)))]
    orders = spark.createDataFrame(named, "rank int, filter_order string, letters array<int>")
    grid = orders.select("rank", "filter_order", F.posexplode("letters").alias("before", "f")).withColumn("step", F.col("before") + 1)
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(named) - 1))).alias("rank")).join(grid, "rank")

    ranks = Window.partitionBy("part", "step").orderBy("rank")
    steps = Window.partitionBy("part", "rank").orderBy("step")
    summed = grid.join(deltas, ["part", "step", "rank"], "left").repartition("part")
    summed = summed.select("part", "rank", "filter_order", "step", "f", *[F.coalesce(F.sum(m).over(ranks), F.lit(0)).alias(m) for m in measures])
    summed = summed.withColumn("gone", F.sum("rows").over(steps)).withColumn("shapley", F.sum("rows").over(Window.partitionBy("part", "f")))
    name = F.element_at(F.array(*map(F.lit, filters)), F.col("f") + 1)
    return summed.join(parts, "part").select(
        F.col("part").alias(part),
        "filter_order",
        "step",
        name.alias("filter"),
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("rows").alias("removed"),
        (F.get("failing", F.col("f")) - F.col("rows")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"),
        *[F.col(m).alias(n) for n, m in zip(lost, measures[1:])],
        "shapley",
    )
