import random
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratawave.llm import skeleton as k

SAME = [
    ("abc", "аbс"), ("Kilo", "Kilo"), ("ＡＢ１", "AB1"), ("é", "é"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"),
    ("ab", "a﻿b"), ("ab", "a‎b"), ("ab", "a‍b"), ("fine", "ﬁne"), ("ガ", "ｶﾞ"), ("a-b", "a‑b"), ("ё", "ë"), ("ab", "a᠎b"),
    ("puik", "ρυικ"), ("vVw", "ѵѴѡ"), ("A", "Ꭺ"), ("BO", "ꓐꓳ"), ("oczs", "ᴏᴄᴢꜱ"), ("Æ", "Ӕ"), ("O", "Ⲟ"),
    ("ﾀ", "タ"), ("x", "‌x"), ("a　b", "a b"), ("XII", "Ⅻ"), ("a b", "a b"), ("ab", "a⁠b"), ("c", "ϲ"), ("j", "ϳ"), ("g", "ɡ"),
]
DIFFER = [
    ("a", "A"), ("e", "é"), ("m2", "m²"), ("a b", "a  b"), ("a\nb", "a b"), ("a.", "a"), ("\U0001f468‍\U0001f373", "\U0001f468\U0001f373"), ("ß", "ss"), ("1", "l"), ("0", "O"),
    ("п", "n"), ("ä", "a"), ("½", "1/2"), ("б", "6"), ("क्‍ष", "क्ष"), ("и", "й"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_looks_the_same(a, b):
    assert k.skeleton(a) == k.skeleton(b)


@pytest.mark.parametrize("a, b", DIFFER)
def test_looks_different(a, b):
    assert k.skeleton(a) != k.skeleton(b)


@given(st.text())
def test_stable_and_independent_of_normal_form(text):
    s = k.skeleton(text)
    assert k.skeleton(s) == s
    for form in ("NFC", "NFD"):
        assert k.skeleton(unicodedata.normalize(form, text)) == s


def test_pairs(spark):
    rng = random.Random(8)
    base = ["Some text " + str(i) for i in range(30)]
    texts = base + [t.replace("e", "е") for t in base[:5]] + [t.replace(" ", " ") for t in base[:3]] + base[:10] + ["", None, " ", " ", "​", "‌", "z" * 100_000, "z" * 99_999 + "ｚ"]
    rng.shuffle(texts)
    rows = [(i + 1, t, "s", True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, "Some text 1", "s", True)], "doc_id long, text string, skeleton string, seen boolean")
    got = sorted((r.doc_id_a, r.doc_id_b) for r in k.look_alike_pairs(df).collect())
    want = sorted(
        (a, b) for a, s, *_ in rows for b, t, *_ in rows
        if a < b and s is not None and t is not None and s != t and k.skeleton(s) == k.skeleton(t) and k.visible(k.skeleton(s))
    )
    assert got == want and len(want) >= 20
    assert k.look_alike_pairs(df.limit(0)).count() == 0


def test_classes_count_the_pairs(spark):
    rng = random.Random(9)
    base = ["Text " + str(i % 7) for i in range(40)] + ["Tеxt 1", "Text 2", "Ｔext 2", "", None, " ", "one"]
    rng.shuffle(base)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(base)] + [(None, "Text 1", 1)], "doc_id long, text string, links int")
    got = {r.doc_id: r for r in k.look_alike_classes(df).collect()}
    seen = {i: t for i, t in enumerate(base) if t is not None and k.visible(k.skeleton(t))}
    group = {i: [j for j, u in seen.items() if k.skeleton(u) == k.skeleton(t)] for i, t in seen.items()}
    assert {i: (r.class_id, r.texts, r.documents, r.links) for i, r in got.items()} == {
        i: (min(g), len({seen[j] for j in g}), len(g), sum(seen[j] != seen[i] for j in g)) for i, g in group.items()
    }
    assert sum(r.links for r in got.values()) == 2 * k.look_alike_pairs(df).count() > 0
    assert k.look_alike_classes(df.limit(0)).count() == 0


def test_many_copies_make_no_pairs(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'the same text' AS text")
    assert k.look_alike_pairs(df).count() == 0
    hot = df.unionByName(spark.createDataFrame([(20_000, "the same tеxt"), (20_001, "the same text.")], "doc_id long, text string"))
    assert k.look_alike_pairs(hot).count() == 20_000


def test_canonical_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("аbс",), (None,), ("",)], "text string")
    assert [r.t for r in df.select(k.canonical(F.col("text")).alias("t")).collect()] == ["abc", None, ""]
