"""Reading and rewriting JSON context columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schema import WEB_PAGE

# What counts as an id inside context text.
JSON_ID_PATTERN = r'("id"\s*:\s*")([^"]+)(")'


# Text is parsed as the first of two elements; only if the second one is found again
# has the parser seen all of the text as one value.
_END = "\u2403end"


def _with_end(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))


def is_json(text: Column) -> Column:
    """Whether text is one JSON value and nothing else; NULL for NULL.

    Strict whatever the session's settings: no single quotes, no NaN. Keys may repeat.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    parsed = F.from_json(_with_end(text), "array<string>", strict)
    whole = F.coalesce((F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == _END), F.lit(False))
    return F.when(text.isNotNull(), whole)


def context_value(context: Column | str, path: str, data_type: str = "string") -> Column:
    """Value at ``path`` of JSON text; NULL where the text is no valid JSON.

    The first of repeated keys counts.
    """
    text = F.col(context) if isinstance(context, str) else context
    parsed = F.try_parse_json(_with_end(text))
    whole = F.try_variant_get(parsed, "$[1]", "string") == _END
    value = F.try_variant_get(parsed, "$[0]" + path.removeprefix("$"), data_type)
    # what the variant parser refuses and is JSON nevertheless has repeated keys
    repeated = F.when(parsed.isNull() & is_json(text), F.get_json_object(text, path).try_cast(data_type))
    return F.when(whole, value).otherwise(repeated)


# A context of one id and nothing else. Such text is valid JSON as it stands.
_ONLY_ID = r'^\[\{"id": ?"([^"\\\x00-\x1f]*)"\}\]$'


def page_view_id(context: str = WEB_PAGE) -> Column:
    """``$[0].id`` of the web page context.

    Nearly every context is a lone id, which a pattern finds in a fraction of
    the time that parsing takes; any other text is parsed.
    """
    text = F.col(context)
    lone_id = F.regexp_extract(text, _ONLY_ID, 1)
    return F.when(lone_id != "", lone_id).otherwise(context_value(text, "$[0].id", "string"))


def nested_to_json(column: Column | str) -> Column:
    """JSON text of a struct, array or map, null fields kept."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def suffix_json_ids(context: Column, suffix: Column) -> Column:
    """Append ``suffix`` to every string ``"id"`` in JSON text, nested ones too."""
    return F.regexp_replace(context, F.lit(JSON_ID_PATTERN), F.concat(F.lit("$1$2"), suffix, F.lit("$3")))


def suffix_id(column: Column, suffix: Column) -> Column:
    return F.concat(column, suffix)


def extract_contexts(
    df: DataFrame,
    fields: Mapping[str, Mapping[str, tuple[str, str]]],
    enabled: Iterable[str] = (),
) -> DataFrame:
    """Add one column per ``{context: {alias: (path, type)}}``.

    The web page context is always read. Any other context that is not enabled,
    or is missing from ``df``, gives typed NULL columns, so that the output
    schema does not depend on the flags.
    """
    active = {WEB_PAGE, *enabled} & set(df.columns)
    columns = {
        alias: context_value(context, path, data_type) if context in active else F.lit(None).cast(data_type)
        for context, aliases in fields.items()
        for alias, (path, data_type) in aliases.items()
    }
    return df.withColumns(columns)
