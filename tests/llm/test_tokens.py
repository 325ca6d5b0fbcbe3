import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapoint.llm import tokens

pytest.importorskip("tiktoken")
ENC, WORDS = tokens.encoder(tokens.RANKS)
ENCODE = ENC.encode_ordinary
alphabet = st.sampled_from(list("aZ bé9.,'\n\t\r 中語ไทยक्ा🙂́") + ["'s", "  ", "\n\n", "don't", "1234", chr(0x3000), chr(0xA0)])


@settings(max_examples=400, deadline=None)
@given(st.lists(alphabet, max_size=40), st.data())
def test_joined_pieces_equal_the_whole(parts, data):
    text = "".join(parts)
    cut = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6)))
    whole = []
    for a, b in zip([0, *cut], [*cut, len(text)], strict=True):
        tokens.join_codes(whole, ENCODE(text[a:b]), ENCODE, WORDS)
    assert whole == ENCODE(text)


def test_long_runs_without_boundaries():
    for text in ("a" * 3000, "中" * 2500, " " * 500 + "x", "!" * 900 + "'s", "\n" * 40 + "y"):
        whole = []
        for k in range(0, len(text), 97):
            tokens.join_codes(whole, ENCODE(text[k : k + 97]), ENCODE, WORDS)
        assert whole == ENCODE(text)


def test_cuts_follow_content():
    import numpy as np

    body = (" ".join(f"word{k * 7919 % 1000}" for k in range(2000))).encode()
    a = {body[c:][:20] for c in tokens.cuts(np.frombuffer(body, np.uint8)).tolist()}
    moved = b"something in front " + body
    b = {moved[c:][:20] for c in tokens.cuts(np.frombuffer(moved, np.uint8)).tolist()}
    assert len(a) > 5 and len(a - b) <= 1


def test_corpus(spark):
    shared = " ".join(f"passage{k}" for k in range(400))
    texts = [None, "", " \n", shared, "x " + shared, shared + " 中文字符" * 300, "<|endoftext|> it's", "a" * 100_000] + [shared] * 200
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert got == {k: ENCODE(t or "") for k, t in enumerate(texts)}


def test_empty_table(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []
