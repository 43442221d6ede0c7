"""Personal data and secrets replaced by surrogates of the same type, keyed and consistent over the whole corpus.

Detection. E-mail addresses, phone, card (with a valid check digit) and social-security numbers, IPv4 addresses, secrets that are
assigned to a telling name, and names of persons after a title, with later mentions of their parts in the same document.

Surrogates. An entity's variable characters are digits of a mixed-radix number: each is replaced within its own alphabet
(case, digits, script), so length, punctuation and format stay. The number goes through a keyed permutation without
fixed points, E(E^-1(x) + 1) with E a Feistel network, so equal entities get equal surrogates everywhere, different
entities of one shape get different ones, and none keeps its value. Card numbers get a valid check digit, addresses valid octets,
known given names another given name of their gender and script.

Names. The gender of a name is settled once for the corpus: that of the titles it stands after anywhere, if they agree, or else of the list that has it. So
the same name has one surrogate, whatever title a document gives it.

Collision checks. Surrogates of all distinct entities are compared over the corpus: one that another entity
has too, or that is itself an entity of the corpus (names aside: given names are few), is drawn again under the next tweak, until
none collides. Where more than a quarter of the values that a shape has stand in the corpus, its surrogates are longer by as many characters as bring that below a quarter
(cards and addresses, whose length is fixed and whose values are many, stay as long as they are). Only a shape all of whose values are there keeps them: its surrogates are distinct, but values of others
(crowded() counts both). Only entities so changed travel back to the documents; commonly there is none.

Defined results: a null text stays null and has no entities; an entity without variable characters stays as it is; repeated rows get the same
text; an empty table gives no rows; a very long text is searched whole, one at a time. Columns other than those named are never read, and the columns kept come through unchanged.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lodequery.llm.shared import small_batches, written

#: Rounds of the permutation, and times that a surrogate is drawn again: each time half of those left, or more, find a free value.
ROUNDS, TWEAKS = 6, 64
#: A shape with more than this part of its values in the corpus is crowded.
CROWDED = 0.25
#: The tweak under which a name's surrogate holds all of the name's own letters, permuted, so that no two names share it.
LAST = -1

# The patterns of entities.
_EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-]|\.\d)")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")
_IP = re.compile(r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)")
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|auth[_ -]?key)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_+/=.-]{8,})")
#: Titles and the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Dr": "", "Prof": "",
}
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carlos Daniel Erik Felix George Henry Ivan Jacob Karl Lucas Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("f", "latin"): "Alice Berta Clara Diana Emma Fiona Greta Helen Ines Julia Karin Laura Maria Nora Olga Paula Rosa Sarah Teresa Vera".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Григорий Дмитрий Иван Кирилл Михаил Николай Сергей".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Татьяна".split(),
}
_OF_GIVEN = {n: (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?[  ]((?:[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?)(?:[  ][^\W\d_a-zа-яß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?){0,2})")


def _range(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: What a character may be replaced by: the alphabet that it is in.
ALPHABETS = [
    "0123456789", _range("a", "z"), _range("A", "Z"), _range("ß", "ö") + _range("ø", "ÿ"), _range("À", "Ö") + _range("Ø", "Þ"),
    _range("а", "я"), _range("А", "Я"), _range("α", "ρ") + _range("σ", "ω"), _range("Α", "Ρ") + _range("Σ", "Ω"),
]
_ALPHABET = {c: a for a in ALPHABETS for c in a}
_LATIN = frozenset("".join(ALPHABETS[1:5]))


def _luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    return -sum(d if i % 2 else d // 5 + 2 * d % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""

    def __init__(self, n: int, key: bytes, tweak: str):
        self._n, self._half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self._mask, self._key, self._tweak = (1 << self._half) - 1, hashlib.blake2b(key).digest(), tweak.encode()

    def _f(self, r: int, x: int) -> int:
        size = (self._half + 7) // 8
        data = b"%d:%d:" % (r, self._n) + self._tweak + x.to_bytes(size, "big")
        return int.from_bytes(hashlib.shake_256(self._key + data).digest(size), "big") & self._mask

    def _walk(self, x: int, rounds: list[int], swap: bool) -> int:
        while True:
            a, b = x >> self._half, x & self._mask
            for r in rounds:
                if swap:
                    a, b = b ^ self._f(r, a), a
                else:
                    a, b = b, a ^ self._f(r, b)
            x = a << self._half | b
            if x < self._n:
                return x

    def __call__(self, x: int) -> int:
        there, back = list(range(ROUNDS)), list(range(ROUNDS - 1, -1, -1))
        return self._walk((self._walk(x, back, True) + 1) % self._n, there, False) if self._n > 1 else x


def _mixed(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    n, x = 1, 0
    for v, s in zip(values, sizes, strict=True):
        n, x = n * s, x * s + v
    x, out = Permutation(n, key, tweak + ":" + ",".join(map(str, sizes)))(x), []
    for s in reversed(sizes):
        x, v = divmod(x, s)
        out.append(v)
    return out[::-1]


def _spots(kind: str, entity: str) -> list[tuple[int, str]]:
    """The places of an entity that vary, each with its alphabet; an address has none but its four numbers."""
    if kind == "ip":
        return []
    first, end, alphabet = 0, len(entity), _ALPHABET
    if kind == "card":
        end = max(i for i, c in enumerate(entity) if c.isdigit())  # the check digit follows from the others
    elif kind == "email":
        end = entity.rindex(".")
    elif kind == "phone" and entity[0] == "+":
        first = re.match(r"\+\d{1,3}(?=\D)|\+\d", entity).end()
    elif kind == "secret" and len(entity) >= 16 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity):
        digits = "0123456789ABCDEF" if entity == entity.upper() else "0123456789abcdef"
        alphabet = dict.fromkeys(digits, digits)
    return [(i, alphabet[entity[i]]) for i in range(first, end) if entity[i] in alphabet]


def _by_alphabet(text: str, spots: list[tuple[int, str]], key: bytes, tweak: str, more: int = 0) -> str:
    """Characters at the spots replaced within their alphabets, and ``more`` added after the last of them; others stay."""
    values, sizes = [a.index(text[i]) for i, a in spots], [len(a) for _, a in spots]
    found = _mixed(values + [0] * more, sizes + sizes[-1:] * more, key, tweak)
    out = list(text)
    for (i, a), v in zip(spots, found, strict=False):
        out[i] = a[v]
    if more:
        last, a = spots[-1]
        out[last] += "".join(a[v] for v in found[len(spots) :])
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def surrogate(kind: str, entity: str, key: bytes, tweak: int = 0, more: int = 0) -> str:
    """The replacement of an entity; another one under each tweak; longer by ``more`` characters."""
    name = f"{kind}:{tweak}:{more}" if more else f"{kind}:{tweak}"
    if kind == "ip":
        return ".".join(map(str, _mixed([int(o) for o in entity.split(".")], [256] * 4, key, name)))
    if kind.startswith("name") and (given := _given(kind, entity, key, tweak)):
        return given
    spots = _spots(kind, entity)
    done = _by_alphabet(entity, spots, key, name, more)
    if kind == "card":
        digits = [i for i, c in enumerate(done) if c.isdigit()]
        done = done[: digits[-1]] + str(_luhn("".join(done[i] for i in digits[:-1]))) + done[digits[-1] + 1 :]
    return done


def _given(kind: str, entity: str, key: bytes, tweak: int) -> str | None:
    """A given name of the gender that the kind tells, or else the listed name has; None if neither does. Each tweak adds a part to it."""
    plain = entity[:1] + entity[1:].lower() if entity.isupper() else entity
    group, i = _OF_GIVEN.get(plain, (None, 0))
    told = kind.partition(":")[2]
    if told and (group is None or group[0] != told):
        group, i = (told, "cyrillic" if "Ѐ" <= entity[0] <= "ӿ" else "latin"), None
        if group[1] == "latin" and entity[0] not in _LATIN:
            return None
    if group is None:
        return None
    names, n = GIVEN[group], len(GIVEN[group])
    if i is None or tweak:
        digest = hashlib.blake2b(f"{kind}:{plain}:{tweak}".encode(), key=hashlib.blake2b(key).digest()).digest()
        parts = [names[int.from_bytes(digest[4 * k : 4 * k + 4], "big") % n] for k in range(1 + min(max(tweak, 0), 7))]
        if tweak == LAST:
            parts.append(_by_alphabet(plain, _spots("name", plain), key, f"{kind}:last"))
        found = "-".join(parts)
        found = found if found != plain else f"{found}-{names[digest[-1] % n]}"
    else:
        found = names[_mixed([i], [n], key, f"name:0:{group}")[0]]
    return found.upper() if entity.isupper() and len(entity) > 1 else found


def shape(kind: str, entity: str) -> tuple[str, float, int]:
    """(what a surrogate keeps of its entity, how many values there are of it, how many characters the last place has to choose from, 0 for a fixed length).

    Entities of one shape have distinct surrogates under one tweak."""
    if kind == "ip":
        return kind, 256.0**4, 0
    spots = _spots(kind, entity)
    vary, n = dict(spots), 1.0
    for _, a in spots:
        n = min(n * len(a), 1e300)
    kept = "".join(f"[{vary[i][0]}{len(vary[i])}]" if i in vary else "#" if kind == "card" and c.isdigit() else f"={c}" for i, c in enumerate(entity))
    return f"{kind}:{kept}", n, len(spots[-1][1]) if spots and kind != "card" else 0


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if _luhn(digits[:-1]) == int(digits[-1]) and digits.strip("0"):
            yield m.start(), m.end(), "card"
    for kind, pattern in (("phone", _PHONE), ("ssn", _SSN)):
        yield from ((m.start(), m.end(), kind) for m in pattern.finditer(text))
    for m in _IP.finditer(text):
        if all(int(o) < 256 and o == str(int(o)) for o in m[0].split(".")):
            yield m.start(), m.end(), "ip"


_DIGIT, _TITLE = re.compile(r"\d"), re.compile("|".join(TITLES))


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlaps; where some overlap, the one that starts first and is longest stays."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += _numbers(text)
    if ":" in text or "=" in text:
        found += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    if _TITLE.search(text):
        parts: dict[str, str] = {}
        for m in _NAME.finditer(text):
            first, *more = re.split("[ \u00a0]", m[2])
            if more and TITLES[m[1]]:  # a title and one word: a surname, without a gender
                parts[first] = f"name:{TITLES[m[1]]}"
            for w in (first, *more):
                parts.setdefault(w, "name")
        if parts:
            again = re.compile(r"(?<![\w-])(?:" + "|".join(map(re.escape, sorted(parts, key=len, reverse=True))) + r")(?![\w-])")
            found += [(*m.span(), parts[m[0]]) for m in again.finditer(text)]
    kept, at = [], 0
    for a, b, kind in sorted(found, key=lambda e: (e[0], -e[1])):
        if a >= at:
            kept.append((a, b, kind))
            at = b
    return kept


def replaced(text: str | None, key: bytes, drawn_again: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans of the entities in the text as it was."""
    spans = entities(text)
    if not spans:
        return text, spans
    out, at = [], 0
    for a, b, kind in spans:
        e = text[a:b]
        out += [text[at:a], (drawn_again or {}).get((kind, e)) or surrogate(kind, e, key)]
        at = b
    return "".join([*out, text[at:]]), spans


def collisions(found: DataFrame, key: bytes, draw=surrogate) -> DataFrame | None:
    """kind, entity and surrogate of the distinct entities (kind, entity) that don't keep their first surrogate; None if all do."""

    def drawn(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "tweak", "more")), strict=True)
                made = [draw(k, e, key, t, more) if more else draw(k, e, key, t) for k, e, t, more in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, "surrogate"])

        return df.select("kind", "entity", "tweak", "more", "full").mapInArrow(run, "kind string, entity string, tweak int, more int, full boolean, surrogate string")

    kind_of = F.substring_index("kind", ":", 1).alias("type")
    first = found.select("kind", "entity", F.lit(0).alias("tweak"), F.lit(0).alias("more"), F.lit(False).alias("full"))
    crowds = written(crowded(found), "crowded")
    if not crowds.isEmpty():
        of = _shapes(found.filter("kind NOT LIKE 'name%'")).join(crowds, "shape").select("kind", "entity", F.lit(0).alias("tweak"), "more", "full")
        first = written(first.join(of, ["kind", "entity"], "left_anti").unionByName(of), "first")
    now = drawn(first)
    for tweak in range(1, TWEAKS + 1):
        bad = written(_colliding(now, found, kind_of), "collisions")
        if bad.isEmpty():
            break
        redrawn = drawn(now.join(bad, ["kind", "entity"], "left_semi").withColumn("tweak", F.lit(tweak)))
        now = written(now.join(bad, ["kind", "entity"], "left_anti").unionByName(redrawn), "surrogates")
    else:
        bad = written(_colliding(now, found, kind_of), "collisions")
        if not bad.isEmpty():
            # Shapes of fixed length that are nearly full go back to the first tweak, under which they are distinct; names get their own letters.
            stuck = _shapes(bad.filter("kind NOT LIKE 'name%'")).select("shape").distinct()
            back = _shapes(now.filter("kind NOT LIKE 'name%'")).join(stuck, "shape", "left_semi").select("kind", "entity", F.lit(0).alias("tweak"))
            back = back.unionByName(bad.filter("kind LIKE 'name%'").select("kind", "entity", F.lit(LAST).alias("tweak")))
            back = written(back.withColumns({"more": F.lit(0), "full": F.lit(True)}), "stuck")
            now = written(now.join(back, ["kind", "entity"], "left_anti").unionByName(drawn(back)), "surrogates")
    again = now.filter("tweak != 0 OR more != 0")
    return None if again.isEmpty() else again.select("kind", "entity", "surrogate")


def crowded(found: DataFrame) -> DataFrame:
    """shape, ``entities`` (how many of it are in the corpus), ``possible`` (its values), ``full`` (all are there) and ``more`` (characters that its surrogates have besides) of crowded shapes."""
    sizes = _shapes(found.filter("kind NOT LIKE 'name%'")).groupBy("shape").agg(F.count(F.lit(1)).alias("entities"), F.first("possible").alias("possible"), F.first("choices").alias("choices"))
    sizes = sizes.filter(F.col("entities") > CROWDED * F.col("possible")).withColumn("full", F.col("entities") >= F.col("possible"))
    more = F.ceil(F.log(F.col("entities") / (CROWDED * F.col("possible"))) / F.log("choices")).cast("int")
    return sizes.select("shape", "entities", "possible", "full", F.when(F.col("full") | (F.col("choices") < 2), 0).otherwise(more).alias("more"))


def _colliding(now: DataFrame, found: DataFrame, kind_of) -> DataFrame:
    """kind and entity of those whose surrogate another one has, or that is an entity itself; of those that share one, the first keeps it, one of a full shape before others."""
    first = now.groupBy(kind_of, "surrogate").agg(F.min(F.struct((~F.col("full")).alias("free"), "tweak", "kind", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
    real = found.filter("kind NOT LIKE 'name%'").select(kind_of, F.col("entity").alias("surrogate")).distinct()
    taken = first.filter("n > 1").select("type", "surrogate", F.struct("first.kind", "first.entity").alias("owner"))
    none = F.lit(None).cast("struct<kind:string,entity:string>")
    taken = taken.unionByName(first.join(real, ["type", "surrogate"], "left_semi").select("type", "surrogate", none.alias("owner")))
    met = now.filter("NOT full").withColumn("type", kind_of).join(taken, ["type", "surrogate"])
    return met.filter(~F.struct("kind", "entity").eqNullSafe(F.col("owner")) & (F.col("entity") != F.col("surrogate"))).select("kind", "entity").distinct()


def _shapes(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shape(k, e) for k, e in zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], ["kind", "entity", "shape", "possible", "choices"])

    return df.select("kind", "entity").mapInArrow(run, "kind string, entity string, shape string, possible double, choices int")


def settled(found: DataFrame) -> DataFrame:
    """kind and entity with ``as_kind``: for names the kind that the corpus tells, one for each name; otherwise the kind."""
    told = found.filter("kind LIKE 'name%'").groupBy("entity").agg(F.min(F.when(F.col("kind") != "name", F.col("kind"))).alias("one"), F.max(F.when(F.col("kind") != "name", F.col("kind"))).alias("other"))
    told = told.select(F.col("entity"), F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.lit("name")).alias("as_name"))
    names = found.filter("kind LIKE 'name%'").join(told, "entity").select("kind", "entity", F.col("as_name").alias("as_kind"))
    return names.unionByName(found.filter("kind NOT LIKE 'name%'").select("kind", "entity", F.col("kind").alias("as_kind")))


def drawn_again(found: DataFrame, key: bytes, draw=surrogate) -> DataFrame | None:
    """kind, entity and surrogate of the distinct entities of the texts that get another surrogate than their kind and value alone give; None if there is none."""
    kinds = written(settled(found), "settled")
    # One to one for all but names.
    again = collisions(kinds.select(F.col("as_kind").alias("kind"), "entity").distinct(), key, draw)
    changed = kinds.filter("kind != as_kind")
    if again is None and changed.isEmpty():
        return None
    again = again if again is not None else kinds.select(F.col("as_kind").alias("kind"), "entity", F.lit(None).cast("string").alias("surrogate")).limit(0)
    both = kinds.join(again.withColumnRenamed("kind", "as_kind"), ["as_kind", "entity"], "left").filter("surrogate IS NOT NULL OR kind != as_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("as_kind", "entity", "surrogate")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array([s or draw(k, e, key, 0) for k, e, s in rows], pa.string())], ["kind", "entity", "surrogate"])

    return both.select("kind", "entity", "as_kind", "surrogate").mapInArrow(run, "kind string, entity string, surrogate string")


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))


def distinct_entities(df: DataFrame, text_col: str) -> DataFrame:
    """kind and entity of all texts, each once: repeated ones go before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(kind, t[a:z]) for t in b.column(0).to_pylist() for a, z, kind in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["kind", "entity"])

    return df.select(text_col).mapInArrow(run, "kind string, entity string").distinct()


def replace_entities(df: DataFrame, text_col: str, key: str, keep: list[str], draw=surrogate) -> DataFrame:
    """The columns in keep (text_col among them or not), ``text_col`` with surrogates, and ``entities``: start, end and kind of what was replaced, in the old text.

    Columns come in this order: text_col, the others in keep, entities.
    """
    small_batches(df.sparkSession)
    secret, spans_col, shown = key.encode(), "entities", text_col
    others_shown = [c for c in keep if c != text_col]
    while spans_col in (text_col, *keep):
        spans_col += "_"
    # Names of the caller's columns can't clash with those needed here.
    text_col, others = "text", [f"c{i}" for i in range(len(others_shown))]
    rows = df.select(F.col(f"`{shown}`").alias(text_col), *(F.col(f"`{c}`").alias(o) for c, o in zip(others_shown, others, strict=True)))
    again = drawn_again(written(distinct_entities(rows, text_col), "entities"), secret, draw)
    fields = StructType([*rows.schema, StructField("entities", _SPANS)])
    redrawn_too = again is not None
    if redrawn_too:
        # Texts that have a redrawn entity get its new surrogates; texts are matched by their hash and their value.
        def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(hashlib.sha256(t.encode()).hexdigest(), kind, t[a:z]) for t in b.column(0).to_pylist() for a, z, kind in entities(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], ["_sha", "kind", "entity"])

        uses = rows.select(text_col).mapInArrow(having, "_sha string, kind string, entity string").distinct()
        maps = uses.join(again, ["kind", "entity"]).groupBy("_sha").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("_again"))
        rows = rows.withColumn("_sha", F.sha2(text_col, 256)).join(maps, "_sha", "left").select(text_col, *others, "_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            redrawn = b.column(b.num_columns - 1).to_pylist() if redrawn_too else [None] * b.num_rows
            done = [replaced(t, secret, {(x["kind"], x["entity"]): x["surrogate"] for x in r or ()}) for t, r in zip(b.column(0).to_pylist(), redrawn, strict=True)]
            spans = [[{"start": a, "end": z, "kind": k} for a, z, k in s] for _, s in done]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in done], pa.string()), *b.columns[1 : 1 + len(others)], pa.array(spans, kind)], [text_col, *others, "entities"])

    return rows.mapInArrow(run, fields).toDF(shown, *others_shown, spans_col)
