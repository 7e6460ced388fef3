import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratawave.llm import encode as e
from stratawave.llm.tokenizer import default_path, encoding, pieces

WORDS = ["the", " the", "'re", "'", "r", "e", "  ", "\n\n", "\t", "ll", "'ll", "é", "日本", "<|endoftext|>", "123", "!?", " ", "x" * 30, "😀", "é", " "]


@lru_cache
def tools():
    return pieces(default_path()), encoding(default_path())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=40).map("".join), st.lists(st.integers(0, 200), max_size=12))
def test_joins_are_repaired_wherever_the_cuts_are(text, cuts):
    tokens, whole = tools()
    at = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    chunks = []
    for a, b in zip(at, at[1:]):
        chunks.append((text[a:b], *e.encode_chunk(tokens, text[a:b])))
    if chunks:
        assert e.joined(tokens, chunks).tolist() == whole.encode_ordinary(text)


@given(st.text(max_size=3000))
def test_borders_partition_and_keep_characters(text):
    data = text.encode("utf-8", "surrogatepass")
    cuts = e.borders(data)
    assert (cuts[-1] == len(data) if data else not cuts) and cuts == sorted(set(cuts))
    assert "".join(data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *cuts], cuts)) == text


@pytest.mark.parametrize("piece", ["abcdefghij", "日本語の長い文", "ab cd, 12 ", " "])
def test_time_is_linear_in_a_piece(piece):
    import time

    tokens, whole = tools()
    text = piece * (1_000_000 // len(piece))

    def run(n: int) -> float:
        data, last, chunks = text[:n].encode(), 0, []
        began = time.process_time()
        for end in e.borders(data):
            chunk = data[last:end].decode()
            chunks.append((chunk, *e.encode_chunk(tokens, chunk)))
            last = end
        ids = e.joined(tokens, chunks).tolist()
        took = time.process_time() - began
        assert len(chunks) > 1 and ids == (tokens.flat(text[:n]) if n > 400_000 else whole.encode_ordinary(text[:n]))
        return took

    small, large = run(len(text) // 8), run(len(text))
    assert large < 24 * max(small, 0.1)


def test_far_agreement_is_found():
    tokens, whole = tools()
    text = " " * 9 + "a" + "1a" * 40
    chunks = [(t, *e.encode_chunk(tokens, t)) for t in (text[:3], text[3:])]
    assert e.joined(tokens, chunks).tolist() == whole.encode_ordinary(text)


def test_borders_move_with_the_text():
    rng = random.Random(4)
    text = " ".join(str(rng.random()) for _ in range(8000)).encode()
    a, b = e.borders(text), [x - 37 for x in e.borders(b"y" * 37 + text)]
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_corpus(spark):
    rng = random.Random(5)
    common = "Terms and conditions apply to every order; see the notes that came with the box, please. " * 3
    texts = ["", None, " ", "one", common, common, "x" * 5000, "".join(rng.choice(WORDS) for _ in range(20000)), "<|endoftext|>"]
    texts += [common[: rng.randint(0, 200)] + "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80))) + common for _ in range(60)]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)] + [(None, "lost", "c", 0)], "doc_id long, text string, chunk string, pos int")
    got = {r.doc_id: list(r.ids) for r in e.encode_corpus(df).collect()}
    assert got == {i: tools()[1].encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert e.encode_corpus(df.limit(0)).count() == 0
    counts = {r.doc_id: r.tokens for r in e.count_tokens(df, keep=("doc_id",)).collect()}
    assert counts == {i: len(tools()[1].encode_ordinary(t or "")) for i, t in enumerate(texts)} | {None: 1}


def test_same_ids_as_the_json_file():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(6)
    for _ in range(50):
        text = "".join(rng.choice(WORDS) for _ in range(50))
        assert t.encode(text, add_special_tokens=False).ids == tools()[1].encode_ordinary(text)
