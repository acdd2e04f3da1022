"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.storage import saved, set_aside


@dataclass(frozen=True)
class MixOptions:
    """Sources in code-point order, null last, weigh ``weights`` in turn and share ``share``
    times all words; none may have over ``most`` times its own. ``strata``: steps of size
    within a doubling. ``rows_per_part``: documents that one task numbers."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    strata: int = 16
    rows_per_part: int = 100_000
    seed: int = 11


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``.

    A target that is above its cap stops there and the excess goes to the others
    by weight. In the order of cap by weight the capped sources come first: a
    source is capped if what is left, shared by the weights of it and all after
    it, would exceed its cap. One row per source is sorted, not documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in options.weights])
    weighed = totals.select(
        "source",
        "source_size",
        F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(options.weights)))).alias("weight"),
        (F.sum("source_size").over(every) * options.share).alias("total"),
        (F.col("source_size") * options.most).alias("cap"),
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    # the level at the first source without a cap holds for all after it
    shared = F.min(F.when(~capped, F.struct(F.col("rank"), F.col("level"))) ).over(every)["level"]
    ranked = weighed.withColumn("level", level).withColumn("rank", F.row_number().over(by_cap))
    return ranked.withColumn("shared", shared).select(
        "source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target")
    )


def mix_sources(docs: DataFrame, options: MixOptions = MixOptions(), id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    All documents of a source expect the same number of copies, its target by
    its size. They are laid in a row by size stratum, then by the hash of their
    id; the expected copies are summed along the row, one offset per source is
    added, and a document is emitted once for each integer its part of the sum
    crosses. Ordered so, the words taken differ from the target by little more
    than one document's. The outcome depends on ids, sizes and the seed alone.

    Null and empty texts have size 0 and are sampled like the others; a null
    source is a source of its own, sorted last; rows that are equal are numbered
    in any order. Columns called like a new one are replaced; names that begin
    with ``_mix_`` are reserved.
    """
    new = ("size", "source_size", "target", "copies")
    kept = [c for c in docs.columns if c not in new]
    source = F.col("source").cast("string")
    size = word_count(F.col("text").cast("string"))
    sized = saved(docs.select(F.col(id_column).alias("id"), source.alias("source"), size.alias("size")))
    # of a part of a stratum of a source, one task numbers the documents
    parts = 64 + sized.count() // options.rows_per_part
    place = ["_mix_source", "_mix_stratum", "_mix_part"]

    def placed(rows: DataFrame, id_: str, source: Column, size: str) -> DataFrame:
        order = F.xxhash64(F.col(id_), F.lit(options.seed))
        stratum = F.coalesce(F.when(F.col(size) > 0, F.floor(F.log2(size) * options.strata)), F.lit(-1))
        return rows.withColumns(
            {
                "_mix_source": _source_key(source),
                "_mix_stratum": stratum,
                "_mix_part": F.coalesce(F.pmod(order, F.lit(parts)), F.lit(0)),
                "_mix_order": order,
            }
        )

    # how many documents of the source lie before each part
    counts = placed(sized, "id", F.col("source"), "size").groupBy(*place).agg(F.count("*").alias("_mix_count"))
    before = Window.partitionBy("_mix_source").orderBy("_mix_stratum", "_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*place, F.coalesce(F.sum("_mix_count").over(before), F.lit(0)).alias("_mix_before"))
    # a multiple of 2**-20, so that sums of whole rates stay exact
    offset = F.pmod(F.xxhash64("source", F.lit(options.seed)), F.lit(1 << 20)) / (1 << 20)
    targets = source_targets(sized, options).select(
        _source_key(F.col("source")).alias("_mix_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_mix_rate"),
        offset.alias("_mix_offset"),
    )
    rows = placed(docs.select(*kept).withColumn("size", size), id_column, source, "size")
    within = Window.partitionBy(*place).orderBy("_mix_order", id_column, "size")
    numbered = rows.withColumn("_mix_number", F.row_number().over(within))
    joined = numbered.join(starts.join(targets, "_mix_source"), place)
    end = F.floor(F.col("_mix_offset") + F.col("_mix_rate") * (F.col("_mix_before") + F.col("_mix_number")))
    start = F.floor(F.col("_mix_offset") + F.col("_mix_rate") * (F.col("_mix_before") + F.col("_mix_number") - 1))
    return joined.select(*kept, "size", "source_size", "target", (end - start).cast("long").alias("copies"))


def take_mix(docs: DataFrame, options: MixOptions = MixOptions(), id_column: str = "doc_id") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    hidden, own = set_aside(docs, ("size", "source_size", "target", "copies"))
    mixed = mix_sources(hidden, options, id_column)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_mix_copy")
    return mixed.select("*", copies).select(*own)


def _source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))
