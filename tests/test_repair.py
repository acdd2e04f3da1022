from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.operators.repair import repair_contexts, repair_counts, repair_files, repaired
from clickloom.schema import UA, WEB_PAGE

# text, expected by default, expected in strict mode
CASES = [
    (None, None, None),
    ("[{'id':'a'}]", '[{"id": "a"}]', '[{"id": "a"}]'),
    ("[{'a':None,'b':True, 'c': False}]", *['[{"a": null, "b": true, "c": false}]'] * 2),
    ("{1,2}", None, None),
    ("b'x'", None, None),
    ("nan", None, None),
    ("", None, None),
    ("[{'id': 'é'}]", '[{"id": "\\u00e9"}]', '[{"id": "\\u00e9"}]'),
    ('{"a":null}', '{"a":null}', None),
    ('[{"id":"j"}]', '[{"id":"j"}]', '[{"id": "j"}]'),
    ("{'a': 1, 'a': 2}", '{"a": 2}', '{"a": 2}'),
    ("{(1, 2): 3}", None, None),
    ("{[1]: 3}", None, None),
    ("[{'q': \"it's\"}]", '[{"q": "it\'s"}]', '[{"q": "it\'s"}]'),
    ("__import__('os')", None, None),
    ("[" * 5000, None, None),
    ("{'a': 1e999}", None, None),
    ('{"a":1,"a":true}', '{"a":1,"a":true}', None),
    ('[{"id":"x","id":"y"}]', '[{"id":"x","id":"y"}]', '[{"id": "y"}]'),
    ('[{"id":"x"}] garbage', None, None),
    ("[{'id': 'a\"b'}]", '[{"id": "a\\"b"}]', '[{"id": "a\\"b"}]'),
    ("[{'id': 'x y'}]\n", '[{"id": "x y"}]', '[{"id": "x y"}]'),
    ("[{'id': 'a\\\\b'}]", '[{"id": "a\\\\b"}]', '[{"id": "a\\\\b"}]'),
    ("{'a': 'x', 'b': ',', 'c': ': '}", *['{"a": "x", "b": ",", "c": ": "}'] * 2),
]


@pytest.mark.parametrize("strict", [False, True])
def test_edge_texts(spark, strict):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    got = dict(df.select("i", repaired("c", strict)).collect())
    for i, (text, default, strictly) in enumerate(CASES):
        assert got[i] == (strictly if strict else default), text


def test_other_columns_and_missing_ones(spark):
    df = spark.createDataFrame([("{'a': 1}", "{'a': 1}")], f"{UA.upper()} string, other string")
    assert repair_contexts(df).first() == ('{"a": 1}', "{'a': 1}")
    assert repair_contexts(df.select("other")).first() == ("{'a': 1}",)


def test_counts_in_one_row_per_column(spark):
    df = spark.createDataFrame([("{'a': 1}", "x"), ("{}", None), ("{1}", "2")], f"{WEB_PAGE} string, {UA} string")
    counts = {r["column"]: (r.texts, r.repaired, r.nulled) for r in repair_counts(df).collect()}
    assert counts == {WEB_PAGE: (3, 1, 1), UA: (2, 0, 1)}


def test_files_are_rewritten_with_counts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(100).select(
        "id", F.when(F.col("id") < 60, "{'a': 1}").when(F.col("id") < 90, "{").alias(WEB_PAGE)
    ).write.parquet(source)
    counts = repair_files(spark, source, target)
    assert counts["rows"] == 100
    assert [counts[f"{WEB_PAGE}.{k}"] for k in ("texts", "repaired", "nulled")] == [90, 60, 30]
    out = spark.read.parquet(target)
    assert out.schema == spark.read.parquet(source).schema
    assert out.where(F.col(WEB_PAGE) == '{"a": 1}').count() == 60
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        repair_files(spark, source, target)
