"""Context columns holding Python literal text, rewritten as JSON text."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.contexts import is_json
from clickloom.schema import CONTEXT_COLUMNS


# Fixed value: the literal form of one id of plain characters, which JSON writes alike.
_LONE_ID = r"^\[\{'id': '([\x20\x21\x23-\x26\x28-\x5B\x5D-\x7E]*)'\}\]\z"


def _literal_to_json():
    """Arrow UDF; built on demand so that workers need not import this package."""

    @F.pandas_udf("string")
    def literal_to_json(texts: pd.Series) -> pd.Series:
        from ast import literal_eval
        from json import dumps

        fixed = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for at, text in texts[texts.notna()].items():
            try:  # a literal may hold infinity, sets or bytes, which JSON cannot
                fixed[at] = dumps(literal_eval(text), allow_nan=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        return fixed

    return literal_to_json


def repaired(column: Column | str, strict: bool = False) -> Column:
    """JSON text for Python literal text, NULL where it is neither.

    Text that is JSON already is passed through, unless ``strict``: then all
    text has to be a Python literal. A literal of one plain id, as nearly every
    context is, is rewritten by a pattern; only other text reaches Python.
    """
    text = F.col(column) if isinstance(column, str) else column
    convert = _literal_to_json()
    lone_id = F.regexp_replace(F.when(text.rlike(_LONE_ID), text), _LONE_ID, '[{"id": "$1"}]')
    passed = F.lit(None).cast("string") if strict else F.when(is_json(text), text)
    by_pattern = F.coalesce(passed, lone_id)
    return F.coalesce(by_pattern, convert(F.when(by_pattern.isNull(), text)))


def _present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    wanted = {c.lower() for c in columns}
    return [c for c in df.columns if c.lower() in wanted]


def repair_contexts(
    df: DataFrame, columns: Iterable[str] = CONTEXT_COLUMNS, strict: bool = False
) -> DataFrame:
    """Repair those of ``columns`` that ``df`` has, whatever their case; the rest is untouched."""
    return df.withColumns({c: repaired(F.col(c), strict) for c in _present(df, columns)})


def repair_counts(
    before: DataFrame, columns: Iterable[str] = CONTEXT_COLUMNS, strict: bool = False
) -> DataFrame:
    """One row per column: texts, texts rewritten, texts that became NULL."""
    present = _present(before, columns)
    after = before.select(
        *[F.col(c).alias(f"old_{i}") for i, c in enumerate(present)],
        *[repaired(F.col(c), strict).alias(f"new_{i}") for i, c in enumerate(present)],
    )
    totals = after.agg(*_count_columns(present, "old_{}", "new_{}"))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{kind}_{i}").alias(kind) for kind in ("texts", "repaired", "nulled")],
        )
        for i, c in enumerate(present)
    ]
    return totals.select(F.inline(F.array(*entries)))


def _count_columns(present: list[str], old: str, new: str) -> list[Column]:
    return [
        aggregate
        for i in range(len(present))
        for before, after in [(F.col(old.format(i)), F.col(new.format(i)))]
        for aggregate in (
            F.count(before).alias(f"texts_{i}"),
            F.count_if(before != after).alias(f"repaired_{i}"),
            F.count_if(before.isNotNull() & after.isNull()).alias(f"nulled_{i}"),
        )
    ]


def repair_files(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Iterable[str] = CONTEXT_COLUMNS,
    strict: bool = False,
) -> dict[str, int]:
    """Rewrite Parquet at ``source`` to the new path ``target`` (Snappy, same columns).

    The counts are taken while the data is written: one pass over the source.
    """
    df = spark.read.parquet(source)
    present = _present(df, columns)
    kept = df.columns
    old = {f"_old_{i}": F.col(c) for i, c in enumerate(present)}
    new = {f"_new_{i}": F.col(c) for i, c in enumerate(present)}
    progress = Observation()
    (
        repair_contexts(df.withColumns(old) if old else df, present, strict)
        .withColumns(new)
        .observe(progress, F.count("*").alias("rows"), *_count_columns(present, "_old_{}", "_new_{}"))
        .select(*kept)
        .write.option("compression", "snappy")
        .mode("errorifexists")
        .parquet(target)
    )
    counts = progress.get
    named = {"rows": counts["rows"]}
    for i, c in enumerate(present):
        named.update({f"{c}.{kind}": counts[f"{kind}_{i}"] for kind in ("texts", "repaired", "nulled")})
    return named
