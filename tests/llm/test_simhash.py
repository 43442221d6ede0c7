import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lodequery.llm import queries, simhash
from lodequery.llm.components import components
from tests.conftest import SF


@pytest.mark.parametrize("radius, width", [(1, 64), (2, 64), (2, 20), (3, 17)])
def test_tables_cover_every_pair_within_the_radius(radius, width):
    found = simhash.masks(radius, width)
    for spots in combinations(range(width), radius):
        differ = sum(1 << i for i in spots)
        assert any(m & differ == 0 for m in found)


def brute_fingerprint(text):
    w, seen = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            w += [seen] if seen else []
            seen = ""
        else:
            seen += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2 and part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    least = {}
    for p, (d, _) in zip(part, fps, strict=True):
        if d is not None:
            least[p] = min(least.get(p, d), d)
    return sorted(((d, f"{f:016x}", least.get(p)) for p, (d, f) in zip(part, fps, strict=True)), key=repr)


def test_op4_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op4_simhash(spark, SF).collect()), key=repr) == brute(docs)


def test_op4_cases(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(7, None, 1), (3, "", 1), (9, " \t\n", 1), (None, "lone text here", 1), (4, "One TWO", 1), (2, "one two", 1), (8, "x " * 20000, 1), (8, "x " * 20000, 1), (None, "", 1), (11, "É é", 1), (12, "é é", 1)]
    for i in range(60):
        text = list(base)
        for _ in range(r.randint(0, 2)):
            text[r.randrange(400)] = f"v{i}"
        rows.append((100 + i, " ".join(text), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.near_duplicates(df, "doc_id", "text").collect()), key=repr) == brute([x[:2] for x in rows])
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").collect() == []


def test_chunks_of_a_large_bucket_find_the_same(spark):
    r = np.random.default_rng(5)
    fps = [0]
    for _ in range(150):
        fps.append(fps[r.integers(len(fps))] ^ (1 << int(r.integers(24))) ^ (1 << int(r.integers(24))))
    fps = sorted({f | 1 << 40 for f in fps})
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    rows = simhash.table_rows(df, [df.fp], 2)
    few, all_at_once = (sorted(map(tuple, components(simhash.links(rows, df, ["fp"], 2, chunk=c)).collect())) for c in (7, 2048))
    assert few == all_at_once and len(few) > 100


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(1, 1), (7, 5), (7, 5)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in range(5, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited(base, n, r):
    out = list(base)
    for i in r.sample(range(len(base)), n):
        out[i] = f"new{r.randrange(10**9)}"
    return " ".join(out)


def test_near_copies_leave_one(spark):
    r = random.Random(8)
    rows, least = [], {}
    for g in range(40):
        base = [f"g{g}w{r.randrange(10**6)}" if r.random() < 0.6 else r.choice(["the", "of", "and", "in", "to"]) for _ in range(300)]
        ids = [g * 10 + i for i in range(4)]
        rows += [(ids[0], " ".join(base))] + [(i, edited(base, 4, r)) for i in ids[1:3]] + [(ids[3], edited(base, 120, r))]
        least[g] = ids
    rows += [(900, rows[0][1]), (None, rows[0][1]), (901, None), (902, ""), (903, "lone " * 20000), (903, "lone " * 20000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, node string").repartition(5)
    got = simhash.drop_near_copies(df, "doc_id", "text")
    ids = sorted(x.doc_id for x in got.collect())
    kept = sum(ids.count(i[0]) for i in least.values())
    near = sum(ids.count(i) for g in least.values() for i in g[1:3])
    apart = sum(ids.count(g[3]) for g in least.values())
    assert got.columns == df.columns and kept == 40 and near <= 4 and apart == 40
    assert [i for i in ids if i >= 900] == [901, 903]
    assert simhash.drop_near_copies(df.limit(0), "doc_id", "text").collect() == []
