"""Secrets in texts, told apart by how many owners share them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.storage import saved

#: Fixed patterns of the kinds that are always reported, with the group whose length
#: counts and its least length. Letters of keywords are spelt out in both cases.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
#: What the method adds: long runs that mix letters and digits, of which those of one owner alone are live.
BARE = ("bare", "[A-Za-z0-9+/_-]+", 0, 20)

SPAN = "struct<start:int,kind:int,end:int,value:string>"


@dataclass(frozen=True)
class SecretOptions:
    """A value of more than ``live_owners`` owners is a copied example; so is one of more than
    ``live_repositories`` repositories, in a table that has a column of repositories."""

    live_owners: int = 1
    live_repositories: int = 3


def find_spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """(start, kind, end, value) of the leftmost non-overlapping matches whose group is long enough.

    The text is taken in pieces that each end with a match, whatever lies before
    it; the last piece has no match and takes all that is left, so the text is gone
    through once. Lengths of pieces add up to places in code points.
    """
    lazy = f"(?s).*?(?:({pattern})|\\z)"
    pieces = F.regexp_extract_all(text, F.lit(lazy), F.lit(0))
    matches = F.regexp_extract_all(text, F.lit(lazy), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(lazy), F.lit(1 + group)) if group else matches
    state = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("found"))

    def step(s: Column, m: Column) -> Column:
        end = s["at"] + F.length(m["0"])
        span = F.struct(
            (end - F.length(m["1"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["2"].alias("value")
        )
        return F.struct(end.alias("at"), F.when(F.length(m["2"]) >= least, F.concat(s["found"], F.array(span))).otherwise(s["found"]).alias("found"))

    spans = F.aggregate(F.arrays_zip(pieces, matches, values), state, step, lambda s: s["found"])
    # a text without any long enough match is not taken apart
    return F.when(text.rlike(_long_enough(pattern, least)), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _long_enough(pattern: str, least: int) -> str:
    """A pattern found in every text that has a match of sufficient length."""
    return f"{pattern[:-1]}{{{least - (4 if pattern.startswith('AKIA') else 0)},}}" if pattern[-1] == "+" else f"{pattern[:-2]}{{{least},}})"


def scan_secrets(
    docs: DataFrame,
    options: SecretOptions = SecretOptions(),
    id_column: str = "doc_id",
    owner_column: str = "source",
    repository_column: str | None = None,
) -> DataFrame:
    """``id_column`` and ``found``: the spans of each row with what the corpus says about their values.

    ``found`` is an array of (start, kind, end, value_hash, owners, repositories,
    live), ordered by start and kind; places count code points, ends are
    exclusive. Kinds ``assign``, ``access`` and ``hex`` are always there; ``bare``
    where no other span covers it, live or not. Values are known by their SHA-256
    alone. A value is live if few owners of the whole corpus have it, in however
    many documents and copies of them, and few repositories if ``repository_column``
    is given. Without it, documents are counted as ``repositories``, and nothing is
    judged by them. Null texts are empty; null owners or repositories count as one
    each; repeated rows are scanned like others and belong to one repository. Every
    row of ``docs`` has one row in the result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = F.concat(*[find_spans(F.col("text"), p, g, n, k) for k, (_, p, g, n) in enumerate((*KINDS, BARE))])
    mixed = lambda s: (s["kind"] < len(KINDS)) | (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(owner_column).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository_column or id_column).cast("string"), F.lit("")).alias("repository"),
        text.alias("text"),
    ).select("id", "owner", "repository", F.filter(every, mixed).alias("spans"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    spans = rows.select("row", "owner", "repository", F.explode("spans").alias("s")).select(
        "row", "owner", "repository", "s.start", "s.kind", "s.end", F.sha2("s.value", 256).alias("value_hash")
    )
    # pairs first: a value that a third of the corpus copies is combined before it is shuffled
    shared = spans.groupBy("value_hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    live = F.col("owners") <= options.live_owners
    if repository_column is not None:
        live &= F.col("repositories") <= options.live_repositories
    known = spans.select("row", "start", "kind", "end", "value_hash").join(shared, "value_hash").withColumn("live", live)
    span = F.struct("start", "kind", "end", "value_hash", "owners", "repositories", "live")
    found = known.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    covered = F.filter(
        "found",
        lambda s: (s["kind"] < len(KINDS))
        | ~F.exists("found", lambda o: (o["kind"] < len(KINDS)) & (o["start"] <= s["start"]) & (o["end"] >= s["end"])),
    )
    names = F.array(*[F.lit(k) for k, *_ in (*KINDS, BARE)])
    with_names = F.transform(covered, lambda s: s.withField("kind", F.get(names, s["kind"])))
    empty = F.expr("cast(array() as array<struct<start:int,kind:string,end:int,value_hash:string,owners:bigint,repositories:bigint,live:boolean>>)")
    return rows.select(F.col("id").alias(id_column), "row").join(found, "row", "left").select(
        id_column, F.coalesce(with_names, empty).alias("found")
    )
