"""Suffix-array search against scanning every window."""

from __future__ import annotations

import random
import re

import numpy as np

from clickloom.llm.decontaminate import DecontaminationOptions, decontaminate, find_contamination, longest_matches, suffix_array
from llm_texts import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scanned(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    found = {}
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= owners
        found[doc] = (len(w), len(hit), sorted(names))
    return found


def sample(odd_texts):
    rng = random.Random(4)
    items = [(i, sentence(rng, n, 60)) for i, n in enumerate([30, 12, 4, 1, 60])] + [(10, None), (11, "!!"), (12, "One, two")]
    docs = [(i, t) for i, t in enumerate(odd_texts)]
    for i in range(60):
        item = words(rng.choice(items)[1]) or ["x"]
        start = rng.randrange(len(item))
        docs.append((100 + i, f"{sentence(rng, 8, 60)}. {'-'.join(item[start : start + rng.randint(1, 25)]).upper()}\n{sentence(rng, 5, 60)}"))
    return docs, items


def got(spark, docs, items, options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = find_contamination(docs, bench, options).collect()
    return {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in rows}


def test_against_scan(spark, make_docs, odd_texts):
    docs, items = sample(odd_texts)
    for options in (DecontaminationOptions(), DecontaminationOptions(window=5, block_words=20, shard_bytes=200)):
        assert got(spark, make_docs(docs), items, options) == scanned(docs, items, options.window)


def common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def test_longest_match_of_every_document(spark, make_docs, odd_texts):
    docs, items = sample(odd_texts)
    items += [(20, items[0][1]), (21, items[0][1] + " and more of it")]  # an item that repeats another and one that goes on
    docs = [(i, t) for i, t in docs if len(t or "") < 10_000] + [(900, items[-1][1]), (901, f"x {items[0][1]} {items[0][1]}")]
    texts = {str(i): words(t) for i, t in items}
    places = [(t, j) for t in texts.values() for j in range(len(t))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in (DecontaminationOptions(), DecontaminationOptions(window=5, block_words=20, shard_bytes=200)):
        rows = {r["doc_id"]: r for r in find_contamination(make_docs(docs), bench, options).collect()}
        for doc, text in docs:
            w, found = words(text), rows[doc]["longest"]
            lengths = []
            for p in range(len(w)):
                matches = [(common(w[p:], t[j:]), t, j) for t, j in places]
                begun = any(n >= min(options.window, len(t)) and (j == 0 or len(t) - j >= options.window) for n, t, j in matches)
                lengths.append(max(n for n, _, _ in matches) if begun else 0)
            if not rows[doc]["items"]:
                assert found is None and not any(lengths)
                continue
            assert (found["length"], found["word"]) == (max(lengths), lengths.index(max(lengths)))
            end = found["item_word"] + found["length"]
            assert texts[found["item"]][found["item_word"] : end] == w[found["word"] : found["word"] + found["length"]]


def test_spans_and_removal(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "x y z")], "item_id long, text string")
    docs = make_docs([(1, "z a b c d e a b c d"), (2, "x y z"), (3, None), (3, None)]).withColumnRenamed("n_chars", "items").withColumnRenamed("lang", "longest")
    options = DecontaminationOptions(window=3)
    found = {r["doc_id"]: r for r in find_contamination(docs, bench, options).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1, 5), (6, 10)]
    kept = decontaminate(docs, bench, options)
    assert [r["items"] for r in kept.where("doc_id = 2").collect()] == [5]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 3]
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == 4


def test_longest_matches(spark, make_docs, odd_texts):
    docs, items = sample(odd_texts)
    docs = [d for d in docs if len(d[1] or "") < 10_000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in (DecontaminationOptions(), DecontaminationOptions(shard_bytes=300, block_words=30)):
        rows = longest_matches(make_docs(docs), bench, options).collect()
        texts = {d: words(t) for d, t in docs}
        found = {(r["item_id"], r["item_word"]): r for r in rows}
        for item, text in items:
            w = words(text)
            for i in range(len(w)):
                best = 0
                for t in texts.values():
                    for j in range(len(t)):
                        n = 0
                        while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                            n += 1
                        best = max(best, n)
                r = found.get((str(item), i))
                assert (r["length"] if r else 0) == best
                if r:
                    assert texts[r["doc_id"]][r["doc_word"] : r["doc_word"] + best] == w[i : i + best]


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    w = np.append(rng.integers(0, 3, 200), 0)
    order = suffix_array(w, 16)

    def key(i):
        out = []
        for x in w[i : i + 16]:
            out.append(int(x))
            if x == 0:
                break
        return out

    assert sorted(order) == np.flatnonzero(w).tolist()
    keys = [key(i) for i in order]
    assert keys == sorted(keys)
