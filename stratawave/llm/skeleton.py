"""One form for texts that look the same: skeletons of look-alike prototypes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.session import cut

#: Letters of other scripts that are drawn as a Latin letter, each string beside its Latin one.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮӀԀѴ", "ABESIJKMHOPCTYXGQWYIDV"),  # Cyrillic capitals
    ("аеѕіјорсухһԁԛԝӏүԍѵѡҽ", "aesijopcyxhdqwlygvwe"),  # Cyrillic small letters
    ("ӔӘӠӕәӡ", "ÆƏƷæəʒ"),  # Cyrillic letters drawn as a Latin letter beyond A to Z
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺ", "ABEZHIKMNOPTYXCJM"),  # Greek capitals
    ("οϲϳναγικρσυ", "ocjvayikpou"),  # Greek small letters
    ("օսոհցզաԼՍՏՕ", "ounhgqwLUSO"),  # Armenian
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),  # Coptic
    ("𐐄𐐬𐐕𐐽𐑈", "OoCcs"),  # Deseret
    ("ɡɑıȷ", "gaij"),  # Latin letters of phonetics and without dots
)
#: Letters whose small and capital forms are drawn alike but for their height: their small capitals are drawn as the small letter.
ALIKE_IN_HEIGHT = "COSUVWZ"
#: Other characters drawn alike: hyphens, apostrophes of modifier letters, marks, signs.
SIGNS = (("‐‑˗", "---"), ("ʼʹ", "''"), (";·․", ";·."), ("⁄∕", "//"), ("ǃ", "!"), ("∶꞉", "::"), ("∣", "|"), ("∼", "~"))
#: Decompositions that keep the look of a character but for its width; ranges whose compatibility decomposition keeps it as well (digraphs, Roman numerals, ligatures).
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
SAME_LOOK_RANGES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB06))
#: Characters without a look of their own outside the categories below, and those that shape their neighbours.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F}
JOINERS, SELECTORS = ("‌", "‍"), range(0xFE00, 0xFE10)
#: First and last character of scripts in which joiners change the letters' shape.
JOINING = ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF), (0xA840, 0xA87F))


@lru_cache(maxsize=1)
def listed() -> dict[str, str]:
    """Prototypes of look-alikes, decomposed."""
    small = {unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {c}"): c.lower() for c in ALIKE_IN_HEIGHT}
    return small | {a: unicodedata.normalize("NFD", b) for pair in (*LOOK_ALIKES, *SIGNS) for a, b in zip(*pair, strict=True)}


@lru_cache(maxsize=65536)
def prototype(c: str) -> str:
    """What a decomposed character looks like: itself, its prototype, or nothing where it is invisible."""
    if c in listed():
        return listed()[c]
    code, kind = ord(c), unicodedata.category(c)
    if kind == "Zs":
        return " "
    if (kind == "Cf" and c not in JOINERS and not 0x0600 <= code <= 0x0605 and not 0xE0020 <= code <= 0xE007F) or code in INVISIBLE:
        return ""
    parts = unicodedata.decomposition(c).split()
    if parts and (parts[0] in SAME_LOOK or (parts[0] == "<compat>" and any(a <= code <= b for a, b in SAME_LOOK_RANGES))):
        return "".join(map(prototype, unicodedata.normalize("NFD", "".join(chr(int(p, 16)) for p in parts[1:]))))
    return c


def shapes(before: str, after: str) -> bool:
    """True where a joiner between the two characters changes what is drawn."""

    def joining(c: str) -> bool:
        return bool(c) and any(a <= ord(c) <= b for a, b in JOINING)

    def pictured(c: str) -> bool:
        return bool(c) and (unicodedata.category(c) in ("So", "Sk") and ord(c) > 0x2000 or ord(c) in SELECTORS)

    return (joining(before) and joining(after)) or (pictured(before) and pictured(after))


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again.

    Two texts have the same skeleton when they are drawn the same but for the width of
    characters. Case, accents, raised figures, punctuation, line breaks and the number of
    spaces stay. Invisible characters vanish; joiners stay where they change the shape of
    letters or join pictures, and a variation selector stays behind a picture.
    """
    if text.isascii():
        if text.isprintable():
            return text
        return "".join(map(prototype, text))
    out: list[str] = []
    decomposed = unicodedata.normalize("NFD", text)
    for i, c in enumerate(decomposed):
        if c in JOINERS:
            if shapes(out[-1][-1] if out else "", decomposed[i + 1 : i + 2]):
                out.append(c)
        elif ord(c) in SELECTORS:
            if out and unicodedata.category(out[-1][-1]) == "So":
                out.append(c)
        elif p := prototype(c):
            out.append(p)
    return unicodedata.normalize("NFD", "".join(out))


def visible(text: str) -> bool:
    """True if a skeleton has a character that leaves ink."""
    return any(not c.isspace() and unicodedata.category(c) not in ("Cc", "Cf", "Cn", "Cs") for c in text)


def canonical(column: Column) -> Column:
    """The skeleton of a text column; null stays null and the empty text empty."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(skeleton, na_action="ignore")

    return run(column)


def classes(documents: DataFrame) -> DataFrame:
    """Each document with a text: doc_id, skeleton, seen (it has a visible character).

    Texts are handled whole. Rows with a null text are left out.
    """
    schema = "doc_id long, text string, skeleton string, seen boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [skeleton(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "skeleton": forms, "seen": [visible(f) for f in forms]})

    return documents.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, schema)


def look_alike_pairs(documents: DataFrame) -> DataFrame:
    """Pairs of documents whose texts look the same but differ: doc_id_a < doc_id_b, each pair once.

    Originals are grouped by skeleton. Groups of one text only, however many copies it
    has, yield no pair and are left before any pair is made; so are texts without a
    visible character. In the other groups different texts meet once, and their copies
    come in where the pairs are written: the work is that of the result, not of all pairs
    of a group. Rows without doc_id are in no pair, and doc_id is unique. Skeletons and
    texts are compared whole, behind 64-bit hashes that carry the shuffle.
    """
    named = documents.filter(F.col("doc_id").isNotNull())
    # every text is moved as two hashes; texts meet only where one skeleton has several of them
    hashes = cut(classes(named).filter("seen").select("doc_id", F.xxhash64("skeleton").alias("form"), F.xxhash64("text").alias("own")))
    mixed = hashes.groupBy("form").agg(F.min("own").alias("least"), F.max("own").alias("largest")).filter("least <> largest").select("form")
    concerned = hashes.join(mixed, "form", "left_semi").select("doc_id")
    few = cut(classes(named.join(concerned, "doc_id", "left_semi")).withColumn("form", F.xxhash64("skeleton")))
    # copies of one text are one here; only different texts of a skeleton meet
    texts = few.groupBy("form", "skeleton", "text").agg(F.min("doc_id").alias("first_id"))
    f, t = few.alias("f"), texts.alias("t")
    members = f.join(t, (F.col("f.form") == F.col("t.form")) & (F.col("f.text") == F.col("t.text"))).select(F.col("t.first_id").alias("first_id"), F.col("f.doc_id").alias("doc_id"))
    a, b = texts.alias("a"), texts.alias("b")
    differ = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.skeleton") == F.col("b.skeleton")) & (F.col("a.first_id") < F.col("b.first_id")))
    pairs = differ.select(F.col("a.first_id").alias("one"), F.col("b.first_id").alias("other")).alias("p")
    m, n = members.alias("m"), members.alias("n")
    expanded = pairs.join(m, F.col("p.one") == F.col("m.first_id")).join(n, F.col("p.other") == F.col("n.first_id"))
    return expanded.select(F.least("m.doc_id", "n.doc_id").alias("doc_id_a"), F.greatest("m.doc_id", "n.doc_id").alias("doc_id_b"))


#: A class is common from this share of all documents on, so there are at most 1 / COMMON common ones.
COMMON = 0.001


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """One row for each document with a visible text: doc_id, class_id, texts, documents, links.

    A class holds all documents whose texts look the same and is named by its smallest
    doc_id. texts and documents count its different texts and its members; links counts the
    members whose text differs from the document's own, so that the sum of links is twice
    the number of pairs, which are never made. Rows without doc_id or with a null text are
    left out. Skeletons and texts are told apart by their SHA-256. Classes with many
    documents are joined from a broadcast list of at most 1 / COMMON, others by shuffle.
    """
    named = documents.filter(F.col("doc_id").isNotNull())
    digest = lambda c: F.unhex(F.sha2(c, 256))
    forms = cut(classes(named).filter("seen").select("doc_id", digest("skeleton").alias("form"), digest("text").alias("own")))
    texts = forms.groupBy("form", "own").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    whole = texts.groupBy("form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("documents"))
    t, w = texts.alias("t"), whole.alias("w")
    links = cut(t.join(w, F.col("t.form") == F.col("w.form")).select("t.form", "t.own", "t.copies", "w.class_id", "w.texts", "w.documents", (F.col("w.documents") - F.col("t.copies")).alias("links")))
    least = (forms.count() or 0) * COMMON
    columns = ["doc_id", "class_id", "texts", "documents", "links"]
    common = F.broadcast(links.filter(F.col("copies") > least))
    marked = forms.join(common, ["form", "own"], "left")
    rest = marked.filter("class_id IS NULL").select("doc_id", "form", "own").join(links.filter(F.col("copies") <= least), ["form", "own"])
    return marked.filter("class_id IS NOT NULL").select(columns).unionByName(rest.select(columns))
