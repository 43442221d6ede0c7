"""Encoding whole texts with the vocabularies of the tokenizers library, at speed.

* WordIds, for BPE with word ends that drops white space and folds case. A text is cut at spaces and
  newlines, where the pre-tokenizer always cuts, too, so the text's ids are the chunks' ids one after the
  other. Ids of chunks met before come from a bounded dictionary. New chunks of plain Latin letters, digits and marks are cut as the
  pre-tokenizer does, and each new piece goes straight to the library's BPE model; others go through its whole pipeline, in one batch.
* ByteIds, for byte-level BPE. The JSON file's vocabulary lists its merges in the order of their ids, so
  that ids are ranks; the tiktoken engine runs the same merges at three times the speed. The tests hold
  the ids against the tokenizers library's.

Strings of added tokens (as <|endoftext|>) in a text become their ids, as the library does unless told otherwise; what stands between them is encoded by itself.
"""
from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken

from lodequery.llm.byte_bpe import PATTERN, split_safely

#: One match of the word tokenizer's pattern: letters of Latin-1 that its normalizer leaves alone.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Matches of that pattern in chunks without an apostrophe: such letters, a digit, a run of other visible ASCII characters.
_PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Beyond these, case folding and composition are left to the library.
_NOT_LATIN = re.compile("[^\\0-\u012f\u0131-\u017f]")
#: Chunks that the dictionary holds before it is emptied: bounds a worker's memory.
MOST_CHUNKS = 600_000
LONGEST_CHUNK = 256


def _byte_chars() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._file = json.load(f)
        added = self._file.get("added_tokens", [])
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens of this kind aren't supported")
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def encode(self, text: str | None) -> bytes:
        """A null text is an empty one."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if t and any(a in t for a in self._added)]
        if not odd:
            return self._ordinary(texts)
        cut = [self._cut.split(t) if i in set(odd) else [t] for i, t in enumerate(texts)]  # texts and added tokens in turn
        found = iter(self._ordinary([t for parts in cut for t in parts[::2]]))
        return [b"".join(next(found) if k % 2 == 0 else self._added[t] for k, t in enumerate(parts)) for parts in cut]

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        raise NotImplementedError


class ByteIds(Ids):
    def __init__(self, path: str):
        super().__init__(path)
        model, of = self._file["model"], {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("ids of this vocabulary aren't the ranks of its merges")
        self._engine = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t.decode("latin-1") not in self._added}, special_tokens={})
        del self._file

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(self._part(*p) for p in (split_safely(t) if t else ())) for t in texts]

    def _part(self, text: str, one_match: bool) -> bytes:
        ids = self._engine._encode_single_piece(text) if one_match else self._engine.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, "<u4").tobytes()


class WordIds(Ids):
    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.encode_special_tokens = True  # chunks that look like added tokens only after folding are ordinary
        self._known: dict[str, bytes] = {}
        self._shown = _byte_chars()
        del self._file

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        """The new chunks of all these texts are looked up together."""
        known = self._known
        if len(known) > MOST_CHUNKS:
            known.clear()
        cut = [self._words(t) if t else [] for t in texts]
        new = set().union(*cut).difference(known)
        self._learn(new)
        found = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > LONGEST_CHUNK:
                del known[c]
        return found

    def _learn(self, new: set[str]) -> None:
        known, words, made, other = self._known, set(), [], []
        for c in new:
            if _LETTERS.fullmatch(c):
                words.add(c)
            elif sum(map(len, pieces := _PIECES.findall(c))) == len(c):
                made.append((c, pieces))
                words.update(pieces)
            else:
                other.append(c)
        fresh = list(words.difference(known))
        known.update(zip(fresh, self._pieces_ids(fresh), strict=True))
        for c, pieces in made:
            known[c] = b"".join(map(known.__getitem__, pieces))
        for w in fresh:
            if len(w) > LONGEST_CHUNK and w not in new:
                del known[w]
        known.update(zip(other, self._whole(other), strict=True))

    def _pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Of matches of the pre-tokenizer's pattern, straight from the BPE model."""
        tokenize, shown = self._lib.model.tokenize, self._shown
        return _dealt([[t.id for t in tokenize(p.encode().decode("latin-1").translate(shown))] for p in pieces])

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Through the whole pipeline of the library."""
        return _dealt([e.ids for e in self._lib.encode_batch_fast(texts, add_special_tokens=False)])

    @staticmethod
    def _words(text: str) -> list[str]:
        if not _NOT_LATIN.search(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")


def _dealt(found: list[list[int]]) -> list[bytes]:
    raw, ends = np.fromiter(chain.from_iterable(found), "<u4").tobytes(), np.cumsum([4 * len(f) for f in found]).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=4)
def token_ids(path: str, kind: str) -> WordIds | ByteIds:
    """One encoder for a worker process; kind: word or byte. The file must be at the same path on every executor."""
    return {"word": WordIds, "byte": ByteIds}[kind](path)
