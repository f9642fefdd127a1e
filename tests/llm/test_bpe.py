import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm import bpe

FILES = os.path.dirname(bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
TEXTS = ["", " ", "  a", "a  ", "a   b", "\n\n x", "x \n y", "x\x85y  z", "it's <|endoftext|> I'LL don't", "\x1c\x1d a", "日本語 テスト🙂", "¼½ ² ٣", "aa" * 400, "R$ 1.234,56 ação\r\n\r\n fim "]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks())


@pytest.fixture(scope="module")
def truth():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FILES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_against_the_library(encoder, truth):
    assert encoder.column(pa.array(TEXTS)).to_pylist() == truth(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60), min_size=1, max_size=4))
def test_any_text(encoder, truth, texts):
    assert encoder.column(pa.array(texts, pa.string())).to_pylist() == truth(texts)


def test_perfect_hash(encoder):
    assert sorted(encoder.hash.slot) == list(range(len(encoder.keys)))
    assert all(encoder.keys[encoder.hash.index(k)] == k for k in encoder.keys[::97])


def test_table(spark, truth):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3], "palavra " * 50_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(spark, df).collect()}
    assert got == {i: truth([t or ""])[0] for i, t, _ in rows}
    assert bpe.encode_corpus(spark, df.where("false")).collect() == []
    assert bpe.encode_corpus(spark, df).schema["ids"].dataType.simpleString() == "array<int>"
