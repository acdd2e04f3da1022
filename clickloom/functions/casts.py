"""Casts that reconcile source types with the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.contexts import nested_to_json
from clickloom.functions.times import strip_zone, text_to_ntz
from clickloom.schema import CONTEXT_COLUMNS


def safe_int(text: Column) -> Column:
    """Integer from text, NULL for anything else."""
    return text.try_cast("int")


def typed_null(data_type: T.DataType | str) -> Column:
    return F.lit(None).cast(data_type)


def to_contract_type(column: Column, source: T.DataType, field: T.StructField) -> Column:
    """``column`` of type ``source`` as the contract's ``field``."""
    nested = isinstance(source, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
    if nested and field.name in CONTEXT_COLUMNS:
        return nested_to_json(column)
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(source, T.TimestampType):
        return strip_zone(column)
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(source, T.StringType):
        return text_to_ntz(column)
    if field.name == "br_colordepth" and isinstance(source, T.StringType):
        return safe_int(column)
    return column.cast(field.dataType)
