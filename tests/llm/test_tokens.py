import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from lodequery.llm import byte_bpe, packing, queries, simple8b
from lodequery.llm.queries import TOKENIZERS
from lodequery.llm.shared import new_folder
from lodequery.llm.token_ids import token_ids
from tests.conftest import SF

ODD = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "'s", "1", "!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\x1c", "\xa0", "　", "Σ", "İ", "日本", "́", "#", "\x85", "​", "don't", "ß", "Ÿ", "ª", ".", ",", "½"]
RANKS, JSON, WORDS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


def odd_texts(n, k, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(ODD, k=r.randint(0, k))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(5, None, "x"), (1, "", "x"), (3, "word " * 9000, None), (3, "word " * 9000, None), (None, "no id", "x"), (9, "<|endoftext|> é\n\n  x", "x"), (2, "a" * 5000, "x"), (4, " " * 3000 + "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path, kind", [(JSON, "byte"), (WORDS, "word")])
def test_ids_are_the_librarys(path, kind, docs):
    texts = [r.text for r in docs.select("text").collect()] + odd_texts(3000, 14) + ["x" * 3000, " " * 3000, None, "<|endoftext|>", "hello <|endoftext|> world", "<|startoftext|><|endoftext|>a", "b<|endoftext|>", "w " * 40000 + "<|endoftext|>" + " é" * 40000]
    whole = library(path)
    assert token_ids(path, kind).encode_many(texts) == [whole(t) for t in texts]


def whole_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cuts_are_safe(monkeypatch):
    e = whole_encoding()
    texts = [*odd_texts(3000, 40), "a" + " " * 50 + "b", " " * 50 + "b", "\n" * 30 + "x y " * 30, " " * 9, "\u3000\u2028" * 5 + "\x1c  ", "b\x85\x85\x85\x1f"]
    for longest in (2, 3, 6, 1000):
        monkeypatch.setattr(byte_bpe, "_RUN", re.compile(f"[{byte_bpe.SPACE}]{{{longest},}}+"))
        monkeypatch.setattr(byte_bpe, "LONGEST_RUN", longest)
        for text in texts:
            for limit in (2, 7):
                parts = list(byte_bpe.split_safely(text, limit))
                ids = [i for p, one in parts for i in (e._encode_single_piece(p) if one else e.encode_ordinary(p))]
                assert "".join(p for p, _ in parts) == text and ids == e.encode_ordinary(text)


#: Runs of two million characters: alone, leading, trailing and in the midst.
RUNS = {"space": " ", "no-break": "\u00a0", "newline": "\n", "mixed": " \n\t\u3000"}


def with_runs(unit, n):
    run = unit * (n // len(unit))
    return [run, run + "x", "x" + run, "Some words" + run + "and more."]


@pytest.mark.parametrize("kind", RUNS)
def test_long_white_space_has_the_librarys_ids(kind):
    whole = library(JSON)
    texts = with_runs(RUNS[kind], 1_100_000)
    assert token_ids(JSON, "byte").encode_many(texts) == [whole(t) for t in texts]


def test_long_white_space_in_the_queries(spark):
    texts = [t for unit in RUNS.values() for t in with_runs(unit, 2_000_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ids = byte_bpe.encode_texts(df, "doc_id", "text", RANKS, byte_bpe.PATTERN)
    back = {r.doc_id: (r.n_tokens, r.sha) for r in byte_bpe.decode_ids(ids, "doc_id", RANKS, byte_bpe.PATTERN).selectExpr("doc_id", "n_tokens", "sha2(decoded, 256) AS sha").collect()}
    assert {d: s for d, (_, s) in back.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    pieces = corpus_pipeline.sequences(spark, df, SF).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r[1] for r in pieces} == {d: n + 1 for d, (n, _) in back.items()}


def test_op2_round_trip(spark, docs):
    e, texts = whole_encoding(), {r.doc_id: r.text for r in docs.collect()}
    got = queries.op2_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = e.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op2_cases(spark, cases):
    ids = byte_bpe.encode_texts(cases, "doc_id", "text", RANKS, byte_bpe.PATTERN)
    back = byte_bpe.decode_ids(ids, "doc_id", RANKS, byte_bpe.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in cases.collect())
    assert byte_bpe.encode_texts(cases.limit(0), "doc_id", "text", RANKS, byte_bpe.PATTERN).collect() == []


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=150, deadline=None)
def test_block_round_trip(values):
    ids = np.array(values, np.uint64)
    words, escapes = simple8b.encode_block(ids)
    assert (simple8b.decode_block(words, escapes, len(ids)) == ids).all()


def test_small_ids_share_words():
    assert len(simple8b.encode_block(np.zeros(120, np.uint64))[0]) == 2
    assert len(simple8b.encode_block(np.full(8, 30000, np.uint64))[0]) == 2


def test_file_has_random_access(tmp_path):
    r = np.random.default_rng(1)
    docs = [(k, r.integers(0, 50000, n).astype(np.uint64)) for k, n in enumerate([0, 5, 70000, 1, 140000, 0, 3])]
    with open(tmp_path / "f", "wb") as f:
        w = simple8b.Writer(f)
        for k, ids in docs:
            w.add(k, ids)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        reader = simple8b.Reader(f)
        for (k, ids), (key, _, got) in zip(docs, reader.documents(), strict=True):
            assert k == key and (ids == got).all()
        flat = np.concatenate([i for _, i in docs])
        assert (reader.ids(65000, 80000) == flat[65000:145000]).all() and len(reader.ids(7, 0)) == 0


def test_footer_is_listed_in_chunks(tmp_path, monkeypatch):
    monkeypatch.setattr(simple8b, "FOOTER_DOCS", 4)
    docs = [(None if k < 5 else k, np.arange(k % 3, dtype=np.uint64)) for k in range(50)]
    with open(tmp_path / "f", "wb") as f:
        w = simple8b.Writer(f)
        for k, ids in docs:
            w.add(k, ids)
            assert len(w._keys) < 4
        w.close()
    with open(tmp_path / "f", "rb") as f:
        got = list(simple8b.Reader(f).documents())
    starts = np.cumsum([0, *(len(i) for _, i in docs)])
    assert [(k, at, i.tolist()) for k, at, i in got] == [(k, at, i.tolist()) for (k, i), at in zip(docs, starts.tolist())]


def test_cut_short_file_is_refused(tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 40)
    with open(tmp_path / "f", "rb") as f, pytest.raises(ValueError):
        simple8b.Reader(f)


def expected_ids(texts, path, end):
    whole, start, out = library(path), 0, []
    for key, text in texts:
        ids = whole(text) + np.array([end], "<u4").tobytes()
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_op10(spark, docs):
    got = [tuple(r) for r in queries.op10_simple8b(spark, SF).orderBy("doc_id").collect()]
    assert got == expected_ids(sorted((r.doc_id, r.text) for r in docs.collect()), WORDS, 1)


def test_op10_cases(spark, cases):
    got = [tuple(r) for r in simple8b.round_trip(cases, "doc_id", "text", WORDS, "word", 1).orderBy("start").collect()]
    rows = sorted(((r.doc_id, r.text) for r in cases.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert got == expected_ids(rows, WORDS, 1)
    assert simple8b.round_trip(cases.limit(0), "doc_id", "text", WORDS, "word", 1).collect() == []


def test_files_end_after_so_many_documents_or_ids(spark, cases, monkeypatch):
    monkeypatch.setattr(simple8b, "FILE_DOCS", 3)
    monkeypatch.setattr(simple8b, "FILE_IDS", 500)
    rows = [(r.doc_id, r.text) for r in cases.collect()] + [(100 + i, f"some text {i} " * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = simple8b.write_ids(df, "doc_id", "text", WORDS, "word", 1, new_folder(spark, "t"))
    assert sum(n for _, n, _ in files) == len(rows) and max(n for _, n, _ in files) == 3 and len(files) > 20
    got = [tuple(r) for r in simple8b.round_trip(df, "doc_id", "text", WORDS, "word", 1).orderBy("start").collect()]
    assert got == expected_ids(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), WORDS, 1)


def test_rows_of_one_key_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "TASK_BYTES", 2000)
    rows = [(None, f"{i * 7919 % 1000:03d} one of many") for i in range(1000)] + [(None, None)] * 30 + [(4, "last"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = simple8b.write_ids(df, "doc_id", "text", WORDS, "word", 1, new_folder(spark, "t"))
    assert len(files) >= 5 and max(n for _, n, _ in files) < 500
    got = [tuple(r) for r in simple8b.round_trip(df, "doc_id", "text", WORDS, "word", 1).orderBy("start").collect()]
    assert got == expected_ids(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), WORDS, 1)


@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_best_fit_takes_the_fullest_bin_that_fits(lengths, most):
    bins, free, order = packing.BestFit(50, most), {}, 0
    for n in lengths:
        b, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[b] == min(fits) and offset == 50 - free[b]
        else:
            assert b not in free and offset == 0
            if len(free) == most and n < 50:
                gone = (set(free) - {k for k, _ in bins.left()}).pop()
                assert free[gone] == min(free.values())
                del free[gone]
        free[b] = 50 - offset - n
        if not free[b]:
            del free[b]
        assert dict(bins.left()) == {k: 50 - f for k, f in free.items()}


def check_packing(rows, lengths, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == capacity for _, _, n in pieces[1:])
        assert [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, _, n in pieces) == lengths[key]
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("parts, fan", [(1, 64), (7, 2)])
def test_op3_places(spark, docs, parts, fan):
    whole = library(JSON)
    ids = {r.doc_id: whole(r.text) + bytes(4) for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(parts), "doc_id", "text", JSON, "byte", 0, fan=fan, with_ids=True).collect()
    n = check_packing(rows, {k: len(v) // 4 for k, v in ids.items()}, 2048)
    least = -(-sum(len(v) // 4 for v in ids.values()) // 2048)
    assert n <= least * 1.02 + 1
    for r in rows:
        assert ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) and zlib.crc32(r.ids) == r.ids_crc32


def test_op3_cases(spark, cases):
    unique = cases.dropDuplicates(["doc_id"]).drop("n_tokens").withColumnRenamed("text", "text")
    rows = packing.pack_documents(unique, "doc_id", "text", JSON, "byte", 0, capacity=64).collect()
    whole = library(JSON)
    check_packing(rows, {r.doc_id: len(whole(r.text)) // 4 + 1 for r in unique.collect()}, 64)
    assert packing.pack_documents(cases.limit(0), "doc_id", "text", JSON, "byte", 0).collect() == []
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packing.pack_documents(cases, "doc_id", "text", JSON, "byte", 0).collect()}) == sum(-(-(len(whole(r.text)) // 4 + 1) // 2048) for r in cases.collect())
