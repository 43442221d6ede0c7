import random
import re

import pytest

from lodequery.llm import pii, queries
from tests.conftest import SF

KEY = b"test"
SAMPLES = [
    ("email", "und.34@mail7.example.com"), ("email", "éque.92@mail6.example.com"), ("phone", "+1 (017) 555-7713"), ("phone", "(555) 123-4567"), ("card", "4111 1111 1111 1111"),
    ("card", "4111111111111111"), ("ip", "97.51.17.173"), ("ssn", "123-45-6789"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("secret", "9233A8ECF7C5B09FE5949719B6B82BC4"),
    ("name", "Alice"), ("name", "Борис"), ("name", "Müller"), ("name", "Иванов"),
]


def shape(kind, text):
    if kind == "ip":
        return "ip" if all(0 <= int(o) < 256 for o in text.split(".")) else text
    if kind == "secret":
        return len(text), text.isupper(), bool(re.fullmatch("[0-9a-fA-F]+", text))
    return [next((i for i, a in enumerate(pii.ALPHABETS) if c in a), c) for c in text] if text not in pii._OF_GIVEN else pii._OF_GIVEN[text][0]


@pytest.mark.parametrize("kind, entity", SAMPLES)
def test_surrogates_keep_type_and_format(kind, entity):
    s = pii.surrogate(kind, entity, KEY)
    assert s != entity and shape(kind, s) == shape(kind, entity) and s == pii.surrogate(kind, entity, KEY)
    assert s != pii.surrogate(kind, entity, b"another key") or entity in pii._OF_GIVEN
    if kind not in ("name", "secret"):
        assert [k for _, _, k in pii.entities(f"so {s} it is")] == [kind]


@pytest.mark.parametrize("n", [2, 3, 7, 64, 1000])
def test_permutation_has_no_fixed_point(n):
    p = pii.Permutation(n, KEY, "t")
    found = [p(i) for i in range(n)]
    assert sorted(found) == list(range(n)) and all(i != x for i, x in enumerate(found))


def test_distinct_entities_stay_distinct():
    r = random.Random(1)
    cards = {f"{x}{pii._luhn(x)}" for x in ("".join(r.choices("0123456789", k=15)) for _ in range(3000))}
    assert len({pii.surrogate("card", c, KEY) for c in cards}) == len(cards)
    assert len({pii.surrogate("name", n, KEY) for n in pii._OF_GIVEN}) == len(pii._OF_GIVEN)


@pytest.mark.parametrize("text", [
    None, "", "plain words, nothing else.", "version 1.2.3.4.5", "999.1.1.1", "4111111111111112", "0000000000000000", "CC BY-NC 4.0", "a@b", "12345678", "x = 5: y", "the token was lost", "1-2-3",
    "Mr. lower case", "2024-01-31", "v3.",
])
def test_clean_texts_are_left_alone(text):
    assert pii.replaced(text, KEY) == (text, [])


def test_coreference_within_a_document():
    text, spans = pii.replaced("Mr. Adam Smith met Frau Müller. Smith left; Adam and Müller stayed. Smithson too.", KEY)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+)\. (\w+) left; (\w+) and (\w+) stayed\. Smithson too\.", text)
    assert m[2] == m[4] and m[1] == m[5] and m[3] == m[6] and len(set(m.groups())) == 3 and m[1] in pii.GIVEN["m", "latin"]
    assert len(spans) == 6


@pytest.mark.parametrize("text, group", [
    ("Mrs Jane Smith", ("f", "latin")), ("Mr Alice Brown", ("m", "latin")), ("Frau Jasmin Weber", ("f", "latin")), ("Miss Zoë Ray", ("f", "latin")), ("Господин Ждан Петров", ("m", "cyrillic")),
    ("Dr Clara Brown", ("f", "latin")),
])
def test_given_names_match_gender_and_script(text, group):
    done = pii.replaced(text, KEY)[0].split()
    assert done[0] == text.split()[0] and done[1] in pii.GIVEN[group] and done[1] != text.split()[1] and done[2] != text.split()[2]


def test_no_free_values_left(spark):
    """All values of a shape, more given names than the lists have, and columns with the names used inside."""
    secrets = [f"--------{i}" for i in range(10)]
    names = [f"Mrs J{c}ne{d}a Xu" for c in "abcdefghijkl" for d in "abcdefghijkl"]
    rows = [(i, f"password: {x}", "e", "s") for i, x in enumerate(secrets)] + [(100 + i, x, "e", "s") for i, x in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string, _sha string")
    got = pii.replace_entities(df, "text", "test", df.columns)
    assert got.columns == ["text", "doc_id", "entities", "_sha", "entities_"]
    texts = {r.doc_id: r.text for r in got.collect()}
    new = {i: texts[i].removeprefix("password: ") for i in range(10)}
    assert sorted(new.values()) == secrets and all(new[i] != x for i, x in enumerate(secrets))
    given = [texts[100 + i].split()[1] for i in range(len(names))]
    assert len(set(given)) == len(names) and all(g.split("-")[0] in pii.GIVEN["f", "latin"] for g in given)


def test_marks_around_entities():
    text = 'A.34@mail7.example.com### token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"%%% 1.2.3.4!! +1 (017) 555-7713*** TOKEN = "9233A8ECF7C5B09FE5949719"!!'
    done, spans = pii.replaced(text, KEY)
    assert [k for _, _, k in spans] == ["email", "secret", "ip", "phone", "secret"] and all(text[a:b] not in done for a, b, _ in spans)


def test_op8_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, of = queries.op8_surrogates(spark, SF).collect(), {}
    assert len(got) == len(texts) and sum(r.n_entities for r in got) > 0
    for r in got:
        t, at, out = texts[r.doc_id], 0, 0
        for a, b, kind in pii.entities(t):
            assert r.text[out : out + a - at] == t[at:a]
            out += a - at
            s = pii.surrogate(kind, t[a:b], queries.SURROGATE_KEY.encode())
            assert r.text[out : out + len(s)] == s and of.setdefault((kind, t[a:b]), s) == s
            at, out = b, out + len(s)
        assert r.text[out:] == t[at:] and r.n_entities == len(pii.entities(t))
    assert len(set(of.values())) == len(of)


def few(kind, entity, key, tweak):
    """Surrogates of which two collide at first, and one is a real entity."""
    first = {"1.1.1.1": "9.9.9.9", "2.2.2.2": "9.9.9.9", "3.3.3.3": "1.1.1.1"}
    return first[entity] if tweak == 0 and entity in first else pii.surrogate(kind, entity, key, tweak)


def test_collisions_are_drawn_again(spark):
    rows = [(1, "a 1.1.1.1 b 2.2.2.2", "x"), (2, "2.2.2.2 and 3.3.3.3", "y"), (3, "nothing", "z"), (3, "a 1.1.1.1 b 2.2.2.2", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string").select("doc_id", "text")
    got = {(r.doc_id, len(r.text or "")): r for r in pii.replace_entities(df, "text", "test", ["doc_id"], few).collect()}
    assert len(got) == 5
    texts = {r.doc_id: r.text for r in got.values()}
    one, two = re.fullmatch(r"a (\S+) b (\S+)", next(r.text for r in got.values() if r.doc_id == 1)).groups()
    again, three = re.fullmatch(r"(\S+) and (\S+)", texts[2]).groups()
    assert two == again and len({one, two, three}) == 3 and not {one, two, three} & {"1.1.1.1", "2.2.2.2", "3.3.3.3"} and texts[None] is None


def test_op8_cases(spark):
    rows = [(1, None, "k"), (None, "a.b@c.example.com", "k"), (2, "a.b@c.example.com", "k"), (2, "a.b@c.example.com", "k"), (3, "", "k"), (4, "x 4111111111111111 " * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = pii.replace_entities(df, "text", "test", ["doc_id", "kinds"]).collect()
    assert sorted((r.doc_id or 0, len(r.entities)) for r in got) == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 0), (4, 3000)]
    assert len({r.text for r in got if r.doc_id in (None, 2)}) == 1 and all(r.kinds == "k" for r in got)
    assert pii.replace_entities(df.limit(0), "text", "test", ["doc_id"]).collect() == []


def assigned(spark, secrets):
    """The surrogates of secrets, from texts that have one each."""
    df = spark.createDataFrame([(i, f"password: {x}") for i, x in enumerate(secrets)], "doc_id long, text string").repartition(3)
    return [r.text.removeprefix("password: ") for r in sorted(pii.replace_entities(df, "text", "test", ["doc_id"]).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("share", [100, 260, 400, 600, 999])
def test_crowded_shapes_have_no_real_surrogates(spark, share):
    real = random.Random(share).sample([f"--------{i:03}" for i in range(1000)], share)
    new = assigned(spark, real)
    assert len(set(new)) == share and not set(new) & set(real)
    assert all(re.fullmatch(r"-{8}\d+", x) and len(x) == 11 + (share > 250) for x in new)


def test_a_full_shape_is_distinct_and_counted(spark):
    real = [f"--------{i:03}" for i in range(1000)]
    new = assigned(spark, real)
    assert sorted(new) == real and all(a != b for a, b in zip(real, new, strict=True))
    found = spark.createDataFrame([("secret", x) for x in real] + [("secret", f"--------{i}") for i in range(5)] + [("ip", "1.2.3.4"), ("name", "Adam"), ("name:m", "Bob")], "kind string, entity string")
    got = {(r.entities, r.possible, r.full, r.more) for r in pii.crowded(found).collect()}
    assert got == {(1000, 1000.0, True, 0), (5, 10.0, False, 1)}


def test_longer_surrogates_of_mail_stay_mail(spark):
    real = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    df = spark.createDataFrame([(i, f"to {x} now") for i, x in enumerate(real)], "doc_id long, text string")
    new = [r.text.split()[1] for r in pii.replace_entities(df, "text", "test", ["doc_id"]).collect()]
    assert len(set(new)) == len(real) and not set(new) & set(real) and all([k for _, _, k in pii.entities(f"to {x} now")] == ["email"] for x in new)


def test_a_name_has_one_surrogate_whatever_title_it_has(spark):
    rows = [(1, "Frau Jasmin Miller came."), (2, "Dr Jasmin Miller left; Jasmin stayed."), (3, "Ms Jane Roe"), (4, "Dr Jane Roe"), (5, "Mr Kim Roe"), (6, "Ms Kim Roe"), (7, "Prof Kim Roe"), (8, "Mrs JANE ROE"), (9, "Dr Xyz Roe")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text.replace(".", "").replace(";", "").split() for r in pii.replace_entities(df, "text", "test", ["doc_id"]).collect()}
    assert got[1][1] == got[2][1] == got[2][4] and got[1][1] in pii.GIVEN["f", "latin"] and got[1][2] == got[2][2]
    assert got[3][1] == got[4][1] and got[3][1] in pii.GIVEN["f", "latin"] and got[5][1] == got[6][1] == got[7][1]
    assert len({got[i][2] for i in (3, 4, 5, 6, 7, 9)}) == 1 and got[8][1].isupper() and got[9][1] not in ("Xyz", got[3][1])
