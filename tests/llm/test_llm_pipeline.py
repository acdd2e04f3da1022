"""The whole pipeline on a small corpus, stage by stage against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from clickloom.llm.jaccard_join import JoinOptions
from clickloom.llm.queries import QUERIES
from llm_texts import sentence
from test_llm_decontaminate import scanned
from test_llm_join import all_pairs

LANGUAGES = {"en": "th", "de": "sch", "es": "ción"}


def corpus():
    rng = random.Random(9)
    rows, items = [], [(i, sentence(rng, 30)) for i in range(4)]
    for i in range(240):
        lang = rng.choice(list(LANGUAGES))
        text = " ".join(LANGUAGES[lang] + w for w in sentence(rng, rng.choice([3, 40, 120])).split())
        if i % 10 == 0:
            text += " " + items[i % 4][1]
        if i % 7 == 0 and rows:
            text, lang = rng.choice(rows)[1:3]
            text = f"{text} more" if len(text or "") > 400 else text
        rows.append((i, text, lang, f"s{i % 3}" if i % 5 else None))
    return rows + [(500, None, None, "s0"), (501, "", "en", "s1"), (502, "12 !!", "de", None), (3, rows[3][1], rows[3][2], rows[3][3])], items


def test_stages_do_what_they_say(spark, make_docs, tmp_path):
    rows, items = corpus()
    docs = make_docs(rows)
    sf_dir = str(tmp_path)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_free", "mix", "shards"]

    kept, texts = {}, {i: t for i, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES:
        before = kept or None
        docs = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept = Counter(r["doc_id"] for r in docs.collect())
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert set(kept) == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
        elif name == "near_duplicates":
            found = all_pairs([(i, texts[i]) for i in before], JoinOptions())
            assert kept == Counter({i for i, _, low in found if i == low})
        elif name == "benchmark_free":
            hit = scanned([(i, texts[i]) for i in before], items, 10)
            assert kept == Counter({i: n for i, n in before.items() if not hit[i][1]})
        elif name == "mix":
            assert set(kept) <= set(before) and max(kept.values()) <= 2
            words = lambda ids: sum(n * len(texts[i].split()) for i, n in ids.items())
            assert words(kept) == pytest.approx(1.5 * words(before), rel=0.1)
        else:
            assert kept == before
            sizes, slots = Counter(), Counter()
            for r in docs.collect():
                sizes[r["shard"]] += r["size"]
                slots[r["shard"], r["slot"]] += 1
            assert set(slots.values()) == {1} and max(sizes.values()) < sum(sizes.values()) / 16 + 2 * 1500


def test_run_applies_all_stages(spark, make_docs, tmp_path):
    rows, items = corpus()
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "shard", "slot"] and found.count() > 100


def test_an_empty_corpus(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
