import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from lodequery.llm import lexical_search, queries, registry, top_k
from tests.conftest import SF
from tests.oracle import assert_same

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("rank", StringType()), StructField("item", StringType())])
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("doc", StringType())])
VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("row", StringType())])


def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    has = [(d, Counter(t), len(t)) for d, t in ((r[0], found_terms(r[1])) for r in docs) if t]
    n, length = len(has), sum(h[2] for h in has)
    in_docs = Counter(t for _, c, _ in has for t in c)
    asked = {}
    for i, text, *_ in items:
        asked.setdefault(i, []).extend(found_terms(text))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, c, size in has:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * in_docs[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        scores.sort(key=lambda s: s[:3])
        out += [(i, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    df = lexical_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), "doc_id", "text", "item_id", "text", k)
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)] + ["Über", "über", "A1", "a1", "ß", "日本", "it's"]
    weights = [1 / (1 + i) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(0, 40))) for _ in range(n)]


def test_search_equals_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", 64)
    docs = [(i * 1_000_003 - 7, t, "r", "i") for i, t in enumerate(texts(300, 3))]
    docs += [(9, None, None, None), (10, "", "", ""), (None, docs[5][1], "x", "y"), (None, docs[6][1], "x", "y")] + [docs[7]] * 70
    docs.append((11, "word1 Word2 " * 40_000, "", ""))
    items = [(i, t, "d") for i, t in enumerate(texts(25, 4))] + [(100, None, ""), (101, "", ""), (102, "nowhere", ""), (3, "word9 word9 word9", ""), (-4, "WORD1 A1 日本", "")]
    assert searched(spark, docs, items) == brute_search(docs, items)


def test_items_in_blocks_change_nothing(spark, monkeypatch):
    docs, items = [(i, t, "", "") for i, t in enumerate(texts(80, 5))], [(i, t, "") for i, t in enumerate(texts(12, 6))]
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    assert searched(spark, docs, items, 3) == brute_search(docs, items, 3)


def test_a_window_of_equal_scores_keeps_the_smaller_ids():
    best = lexical_search.Best(3)
    best.take(np.array([5, 5, 7, 5, 5]), np.array([1, 2, 3, 4, 5], object))
    best.take(np.array([5, 7, 1]), np.array([6, 7, 8], object))
    assert sorted(((s, d) for s, _, d in best.heap), key=lambda x: (-x[0], x[1])) == [(7, 3), (7, 7), (5, 1)]


def test_search_of_empty_tables(spark):
    some = [(1, "a b", "", "")]
    assert searched(spark, [], [(1, "a", "")]) == [] and searched(spark, some, []) == [] and searched(spark, [(1, None, "", "")], [(1, "a", "")]) == []


def test_search_query_equals_sql(spark):
    assert_same(queries.op12_lexical_search(spark, SF), registry.ORACLE["op12_lexical_search"], SF)


def brute_top(rows, every=100, k=10):
    use = [(i, [math.floor(1024 * float(x)) for x in v], n) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, own in use:
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, n) for j, v, n in use if n != own and len(v) == len(q))
        ids = {n: j for j, _, n in use}
        out += [(i, r, ids[s[3]], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def top(spark, rows, every=100, k=10):
    df = top_k.search(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", every, k)
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return (spread * rng.standard_normal((n, dims))).astype(np.float32).tolist()


def test_top_k_equals_brute_force_with_odd_rows(spark):
    rows = [(i, v, "r") for i, v in enumerate(vectors(700, 19, 1))]
    inf, nan = float("inf"), float("nan")
    rows += [(200, None, ""), (300, [None] * 19, ""), (400, [inf] * 19, ""), (-100, [nan] + [0.0] * 18, ""), (900, [], ""), (901, [], ""), (None, rows[4][1], ""), (None, rows[100][1], "")]
    rows += [rows[100]] * 15 + [(1000 + i, [0.25] * 19, "") for i in range(20)] + [(2000 + i, v, "") for i, v in enumerate(vectors(30, 3, 2))] + [(1200, [0.0] * 19, ""), (-300, [1.5] * 19, "")]
    assert top(spark, rows) == brute_top(rows)


def test_fewer_than_k_and_empty_tables(spark):
    assert top(spark, []) == []
    rows = [(0, [1.0], ""), (1, [2.0], "")]
    assert top(spark, rows) == [(0, 1, 1, 1024 * 2048)]
    assert top(spark, rows[:1]) == []


@pytest.mark.parametrize("dims, spread, skew", [(1, 1, 0), (8, 1, 0), (9, 0.01, 0), (64, 1, 0), (70, 1, 0), (64, 1, 4)])
def test_a_shard_finds_the_best_of_all(dims, spread, skew):
    rng = np.random.default_rng(dims)
    x = np.floor(1024 * spread * rng.standard_normal((3000, dims)) * np.exp(-skew * np.arange(dims) / 8)).astype(np.int64)
    ids = rng.permutation(3000) // 2
    shard, rows = top_k.Shard(ids, np.arange(3000), x), np.arange(3000)
    for own in range(0, 3000, 300):
        at, scores = shard.best(x[own], own, 10)
        want = sorted((-int(x[i] @ x[own]), int(ids[i])) for i in rows if i != own)[:10]
        assert [(-s, i) for s, i in zip(scores.tolist(), shard.ids[at].tolist(), strict=True)] == want


def test_reading_stops_before_the_lists_end_where_few_components_tell():
    rng = np.random.default_rng(0)
    x = np.floor(1024 * rng.standard_normal((20_000, 16)) * 0.3 ** np.arange(16)).astype(np.int64)
    shard = top_k.Shard(np.arange(20_000), np.arange(20_000), x)
    assert all(len(shard._left(x[i], 11)) <= top_k.RESOLVE for i in range(0, 20_000, 2000))


def test_scores_beyond_64_bits_raise():
    x = np.full((200, 4), 1 << 31, np.int64)
    with pytest.raises(OverflowError):
        top_k.Shard(np.arange(200), np.arange(200), x).best(x[0], 0, 10)


def test_top_k_query_equals_sql(spark):
    assert_same(queries.op13_exact_top_k(spark, SF), registry.ORACLE["op13_exact_top_k"], SF)
