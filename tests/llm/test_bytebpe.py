"""op13: ids as the tiktoken library gives them, and back."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanworks.llm import bytebpe


@pytest.fixture(scope="module")
def reference():
    ranks = bytebpe.read_ranks(bytebpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.ByteBpe(bytebpe.vocabulary_path())


def ids(coder, texts):
    return [np.frombuffer(b, "<i4").tolist() for b in coder.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_is_encoded_as_the_library_does(coder, reference, texts):
    assert ids(coder, texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst", min_size=1, max_size=90))
def test_the_query_and_the_heap_contract_alike(coder, reference, word):
    coder.known.clear()
    wanted = reference.encode_ordinary(word)
    made = np.frombuffer(coder.contract([word.encode()])[0], "<i4").tolist()
    assert made == bytebpe.heap_contract([int(coder.single[b]) for b in word.encode()], coder.merges())
    assert wanted == ([coder.ranks[word.encode()]] if word.encode() in coder.ranks else made)


def test_long_words_long_texts_and_a_full_cache(coder, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bytebpe, "WORDS", 7)
    monkeypatch.setattr(bytebpe, "ROWS", 300)
    monkeypatch.setattr(bytebpe, "TOKENS", 3)
    texts = ["\x1c a\x85b", "x" * 20_000, "the quick brown fox " * 40, "日本語テスト" * 300, "ACGTTGCA" * 70, " \n\t " * 50, "", "<|endoftext|> it's 12345"]
    assert ids(coder, texts) == [reference.encode_ordinary(t) for t in texts]
    assert coder.decode([np.array(i, np.int32) for i in ids(coder, texts)]) == [t.encode() for t in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        coder.decode([np.array([99_999_999])])


def test_odd_rows_through_spark(spark, odd_docs, no_docs, reference):
    made = bytebpe.decode(bytebpe.encode(odd_docs))
    assert made.columns == [*odd_docs.columns, "ids", "decoded"]
    for row in made.collect():
        assert row.ids == reference.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert bytebpe.decode(bytebpe.encode(no_docs)).count() == 0 and bytebpe.round_trip(no_docs).count() == 0
    assert sorted(map(str, bytebpe.round_trip(odd_docs).collect())) == sorted(map(str, made.collect()))
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bytebpe.decode(nulls).collect()] == [b"", b""]
    with pytest.raises(ValueError, match="ids"):
        bytebpe.encode(nulls, "doc_id")


def test_the_query_on_the_documents(spark, odd_docs, reference, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    wanted = []
    for row in odd_docs.collect():
        tokens = reference.encode_ordinary(row.text or "")
        wanted.append((row.doc_id, len(tokens), sha(",".join(map(str, tokens)).encode()), sha((row.text or "").encode())))
    assert sorted(map(tuple, bytebpe.op13_bytes(spark, str(tmp_path)).collect()), key=str) == sorted(wanted, key=str)
