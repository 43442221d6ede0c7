"""Odds of the words and neighbouring pairs of a text: how much oftener labelled good documents have them than bad ones.

Words are cut at ASCII white space and lower-cased there; each word and each pair falls into one of SLOTS slots by a hash. The odds of a slot are the logarithm of
its smoothed share of good documents over that of bad ones, 0 for a slot that no labelled document has. A text has two figures, the means over its words and over its pairs.

Odds that are applied to the documents they come from look better than they are, so documents are dealt to FOLDS folds and a labelled one is measured by the other folds' odds.

Defined results: null and empty texts have 0 and 0, a single word has no pair and 0 for it; a very long text is read whole, eight bytes a word in memory;
repeated rows count each. What is gathered is a row a slot at most, whatever the number of documents.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, FOLDS = 18, 2
SLOTS = 1 << BITS
#: Documents that a slot is taken to have had already, shared between the labels as all of its kind are.
PRIOR = 4.0
#: Odd multipliers of the hash.
_FIRST, _SECOND, _LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def slots(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words and of the pairs of a text, in order, repeats included."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    mixed = h * _FIRST
    pairs = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * _SECOND + mixed[1:]
    return tuple(((x ^ (x >> np.uint64(32))) * _LAST >> np.uint64(64 - BITS)).astype(np.int64) for x in (mixed, pairs))


def means(texts: list[str | None], odds: np.ndarray) -> np.ndarray:
    """Two columns: the mean odds of the words and of the pairs of each text."""
    return np.array([[odds[s].mean(dtype=np.float64) if len(s) else 0.0 for s in slots(t)] for t in texts], np.float64).reshape(-1, 2)


def documents_with(rows: DataFrame, text_col: str, label_col: str, fold_col: str) -> np.ndarray:
    """[fold, label, slot]: the documents that have a slot."""
    kinds = FOLDS * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((kinds, SLOTS), np.int64)
        for b in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[2 * fold + label, np.unique(np.concatenate(slots(text)))] += 1
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(k[used]) for k in seen)], ["slot", *(f"k{i}" for i in range(kinds))])

    names = [f"k{i}" for i in range(kinds)]
    part = rows.select(text_col, F.col(label_col).cast("int"), F.col(fold_col).cast("int")).mapInArrow(run, ", ".join(f"{n} long" for n in ("slot", *names)))
    found = part.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # SLOTS rows at most
    total = np.zeros((kinds, SLOTS), np.int64)
    for i, n in enumerate(names):
        total[i, found["slot"].to_numpy()] = found[n].to_numpy()
    return total.reshape(FOLDS, 2, SLOTS)


def odds_of(with_slot: np.ndarray) -> np.ndarray:
    """Odds by slot from [label, slot] counts of documents."""
    bad, good = with_slot.astype(np.float64)
    share = (good.sum() + 1) / (good.sum() + bad.sum() + 2)
    return (np.log((good + PRIOR * share) / (bad + PRIOR * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)
