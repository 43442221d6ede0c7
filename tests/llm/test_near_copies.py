import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodequery.llm import simhash
from tests.conftest import SF


def least_of_components(sets):
    part = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b] or sets[a] and 5 * both >= 4 * len(sets[a] | sets[b])) and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {d: low if p == high else p for d, p in part.items()}
    return sorted(set(part.values()))


def kept_and_wanted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in simhash.drop_near_copies(df, "doc_id", "text").collect())
    return got, least_of_components({d: set(simhash.shingles(simhash.words(t), 5)) for d, t in enumerate(texts)})


def fresh(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def block_edited(r, kind, base):
    """The base with an edit of one block, at a similarity about the limit: from 0.7 to 0.9."""
    n = len(base)
    if kind == "appended":
        return base + fresh(r, int(n * r.uniform(0.12, 0.4)))
    if kind == "cut":
        return base[: int(n * r.uniform(0.7, 0.9))]
    cut = int(n * r.uniform(0.05, 0.17))
    return base[:-cut] + fresh(r, cut) if kind == "replaced" else base[: n // 3] + fresh(r, cut) + base[n // 3 + cut :]


@pytest.mark.parametrize("kind", ["appended", "cut", "replaced", "middle"])
def test_block_edits_against_exact_components(spark, kind):
    r = random.Random(kind)
    texts = []
    for _ in range(120):
        base = fresh(r, int(40 * 50 ** r.random()))
        texts += [" ".join(base), " ".join(block_edited(r, kind, base))]
    got, want = kept_and_wanted(spark, texts)
    assert 120 < len(want) < 230
    assert got == want


def test_limit_itself_and_shared_passages(spark):
    r = random.Random(4)
    # 100 words have 96 shingles; 24 more words make 120 of them: exactly 0.8. One word more is below.
    base = fresh(r, 100)
    texts = [" ".join(base), " ".join(base + fresh(r, 24)), " ".join(fresh(r, 1) + base + fresh(r, 24))]
    passage = fresh(r, 60)
    texts += [" ".join(passage + fresh(r, n)) for n in range(0, 120)]
    texts += ["", " \t", "lone", "lone", "a b c d e", "a b c d e f"]
    got, want = kept_and_wanted(spark, texts)
    assert got == want and 0 in got and 1 not in got


def test_stage_against_exact_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect())
    assert got == least_of_components({r.doc_id: set(simhash.shingles(simhash.words(r.text), 5)) for r in docs.collect()})


@pytest.mark.parametrize("chunk, pairs", [(simhash.CHUNK, simhash.HUB_PAIRS), (8, 4)])
def test_a_family_without_its_base(spark, monkeypatch, chunk, pairs):
    """Copies with up to four changed words each, near to some of the others only; a few share so many shingles that they make crowds."""
    for name, value in (("CROWD", 5), ("CHUNK", chunk), ("HUB_PAIRS", pairs)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(12)
    base, texts = fresh(r, 150), []
    for _ in range(150):
        text = list(base)
        for i in r.sample(range(150), r.randint(1, 4)):
            text[i] = f"v{r.randrange(60)}"
        texts.append(" ".join(text))
    got, want = kept_and_wanted(spark, texts + [" ".join(base[:50] + fresh(r, n)) for n in range(10, 60)])
    assert 2 < len(want) < 190
    assert got == want


def test_a_crowd_of_20000_is_spread_over_tasks(spark):
    r, n = np.random.default_rng(3), 20_000
    parity, size = r.integers(0, 2**64, (n, simhash.BITS // 64), np.uint64), r.integers(300, 330, n)
    planted = [(2 * i, 2 * i + 1) for i in range(0, n // 2, 50)]
    for a, b in planted:  # alike but for a few bits
        parity[b] = parity[a] ^ np.uint64(1 << int(r.integers(0, 60)))
    prefixes = spark.createDataFrame([(i, int(size[i]), parity[i].tobytes()) for i in range(n)], "node long, size long, parity binary")
    crowds = spark.createDataFrame([(i, 77, i if i != 100 else 101) for i in range(n)], "node long, shingle long, component long").repartition(4)
    got = sorted(map(tuple, simhash._crowded(crowds, prefixes, Fraction(4, 5)).collect()))
    assert got == sorted(p for p in planted if p != (100, 101))  # those two are of one component already
    dealt = simhash.dealt_crowds(crowds, simhash.CHUNK)
    counts = [x["count"] for x in dealt.groupBy("group").count().collect()]
    assert len(counts) == 55 and max(counts) < 2.3 * simhash.CHUNK and dealt.filter("side = 2").count() == n
    tasks = dealt.repartition(16, "group").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10


def test_common_numbers_of_sorted_sets():
    r = random.Random(1)
    for _ in range(200):
        s, t = (sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(2))
        assert simhash._common_of(np.array(s, np.uint64), np.array(t, np.uint64)) == len(set(s) & set(t))


def test_columns_named_as_those_within(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 2, "x", 3), (2, "a b c d e f", 2, "y", 4)], "doc_id long, text string, _uid long, _lane0 string, c0 long")
    got = simhash.drop_near_copies(df, "doc_id", "text")
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c d e f", 2, "x", 3)]


def test_pairs_across_components_leave_out_joined_copies():
    r = np.random.default_rng(8)
    group = np.repeat(np.arange(40), r.integers(1, 60, 40))
    # From groups of one component to groups in which all differ.
    component = r.integers(0, 10**6, len(group)) * (r.random(len(group)) < group / 39)
    size = r.integers(0, 30, len(group))
    order = np.lexsort((size, group))
    component, size = component[order], size[order]
    got = [(int(a), int(b)) for x, y in simhash._across(group, component, size, Fraction(4, 5)) for a, b in zip(x, y, strict=True)]
    want = [(a, b) for a, b in combinations(range(len(group)), 2) if group[a] == group[b] and component[a] != component[b] and 5 * size[a] >= 4 * size[b]]
    assert want and sorted(got) == want
    assert not list(simhash._across(group[:0], component[:0], size[:0], Fraction(4, 5)))
    # 20,000 joined copies and one other: a few rounds, not one for each of the copies.
    component = np.zeros(20_000, np.int64)
    component[700] = 1
    rounds = list(simhash._across(np.zeros(20_000, np.int64), component, np.full(20_000, 9), Fraction(4, 5)))
    assert len(rounds) < 5 and sum(len(x) for x, _ in rounds) == 19_999


def test_crowds_of_one_component_are_not_dealt(spark, monkeypatch):
    dealt, deal = [], simhash.dealt_crowds
    monkeypatch.setattr(simhash, "dealt_crowds", lambda crowds, chunk: dealt.append(crowds.count()) or deal(crowds, chunk))
    prefixes = spark.range(100).selectExpr("id AS node", "10L AS size", f"unhex(repeat('00', {simhash.BITS // 8})) AS parity")
    crowds = spark.range(200).selectExpr("id % 100 AS node", "id DIV 100 AS shingle", "CASE WHEN id = 150 THEN 50L ELSE 0L END AS component")
    got = sorted(map(tuple, simhash._crowded(crowds, prefixes, Fraction(4, 5)).collect()))
    assert dealt == [100]
    assert got == sorted((min(50, n), max(50, n)) for n in range(100) if n != 50)


def test_links_of_a_joined_group_end_early(monkeypatch):
    """The same links as without leaving out what is joined, in fewer rounds."""
    rows = np.repeat([1, 2], [300, 40]), np.arange(340), np.r_[np.zeros(300), np.arange(40)].astype(np.uint64).reshape(-1, 1)
    looked_at, left = [], simhash._still_apart
    monkeypatch.setattr(simhash, "_still_apart", lambda here, *a: looked_at.append(len(here)) or left(here, *a))
    got = simhash._linked(rows, (0, 1, 2)).to_pylist()
    monkeypatch.setattr(simhash, "_still_apart", lambda here, *a: here)
    assert got == simhash._linked(rows, (0, 1, 2)).to_pylist() and len(got) >= 299
    here = np.arange(5)
    assert left(here, np.array([0, 0, 2, 2, 4]), np.array([0, 2]), np.array([2, 3])).tolist() == [2, 3, 4]
    assert looked_at
