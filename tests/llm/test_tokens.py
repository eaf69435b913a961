import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwire.llm import tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.rank_file()), reason="no vocabulary files here")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sdl 1,.!\n\t我é’𝓐", max_size=80), st.integers(1, 9))
def test_parts_do_not_change_ids(text, size):
    enc = tokens.encoding(tokens.rank_file())
    whole = enc.encode_ordinary(text)
    assert [i for p in tokens.parts(text, size) for i in enc.encode_ordinary(p)] == whole


def test_corpus(spark):
    long = "word don't 我们 " * 20_000
    given = [(1, "Hello world"), (2, ""), (3, None), (4, " "), (5, long), (5, long), (6, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, "clash") for r in given], "doc_id bigint, text string, n_tokens string")
    ids = tokens.encode_corpus(df)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    enc = tokens.encoding(tokens.rank_file())
    assert got[1] == enc.encode_ordinary("Hello world") and got[2] == got[3] == [] and got[4] == enc.encode_ordinary(" ") and got[5] == enc.encode_ordinary(long)
    assert 50256 not in got[6] and ids.count() == 7
    back = {r.doc_id: r.text for r in tokens.decode_corpus(ids).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: " ", 5: long, 6: "<|endoftext|>"}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df.drop("n_tokens")).collect()} == {k: len(v) for k, v in got.items()}


def test_empty_and_clash(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, ids string")
    assert tokens.encode_corpus(none).count() == 0
    with pytest.raises(ValueError, match="ids"):
        tokens.encode_corpus(none, keep=("doc_id", "ids"))
