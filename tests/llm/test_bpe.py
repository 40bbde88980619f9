import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return bpe.load(bpe.tokenizer_path("byte_bpe_50k.json")), lambda x: t.encode(x, add_special_tokens=False).ids


@given(st.lists(st.text(st.one_of(st.sampled_from(list("aaab the'sing 123\n\t <|endoftext|>中文。é😀")), st.characters(exclude_categories=("Cs",))), max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_equals_the_library(both, texts):
    own, library = both
    assert [x.tolist() for x in own.encode(texts)] == [library(t) for t in texts]


def test_runs_and_long_words(both):
    own, library = both
    texts = ["a" * n for n in range(40)] + ["ab" * 3000, " " * 500, "中" * 2000, "<|endoftext|>", "", None]
    assert [x.tolist() for x in own.encode(texts)] == [library(t or "") for t in texts]


def test_operator(spark, both, monkeypatch):
    data = [(1, "Net weight 净含量", 5), (2, None, 5), (3, "", 5), (4, "  ", 5), (None, "x", 5), (5, "长文" * 4000, 5), (1, "Net weight 净含量", 5)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids int")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1000)
    out = {r.doc_id: r.ids for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert out == {d: both[1](t or "") for d, t, _ in data if d is not None}
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0
