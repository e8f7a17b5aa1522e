import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = ["", "a", "aaaaaaaaaaaaaaaaaaa", "hahahahaha ahahah", "Hello  world\n\n  x'll don't", "naïve 😀 日本語", "x<|endoftext|>y<|endoftext|><|endoftext|>", "0123456789 3.14", "   tab\t\t", "zz" * 500, " " * 300]


def test_counts_equal_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (99, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id < 99 else ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text
        assert r.n_bytes == len(text.encode())


def test_documents_and_small_memory(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [r.text for r in docs]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Counter(PATH).count(texts) == want
    small = Counter(PATH, remember=100)
    assert [n for t in texts for n in small.count([t])] == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert token_counts(docs, PATH).count() == 0
