"""op12: measures against a plain computation over whole texts with the libraries themselves."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanworks.llm import alignment

PATH_A, PATH_B = (alignment.vocabulary_path(n) for n in (alignment.VOCABULARY_A, alignment.VOCABULARY_B))
OF = alignment.byte_characters()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def whole(tokenizers, text):
    """(id, start, end) of both sides, or None where bytes differ."""
    a, b = tokenizers
    encoded = a.encode(" " + text, add_special_tokens=False)
    sides = [[(i, bytes(OF[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens, strict=True)]]
    sides.append([(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]])
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
        return None
    out = []
    for side in sides:
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def described(tokenizers, text):
    """n_a, n_b, n_groups, hash, Counter of links."""
    both = whole(tokenizers, text) if text else None
    if both is None:
        return None
    a, b = both
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, low = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= end) for side in both))
        low = end
    links = Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute(tokenizers, rows):
    each = [(i, described(tokenizers, t)) for i, t in rows]
    counts = Counter()
    for _, d in each:
        counts.update(d[4] if d else {})
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for i, d in each:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(n for pair, n in d[4].items() if counts[pair] == most[pair[1]])
            out.append((i, d[0], d[1], d[2], sum(d[4].values()), best, sum(n * counts[pair] for pair, n in d[4].items()), d[3]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(PATH_A, PATH_B)


ODD = "ab's é日\u00a0\u2003\n\t  ▁<0x41>\x00\x1c\u0301"


@settings(max_examples=250, deadline=None)
@given(st.one_of(st.text(min_size=1, max_size=40), st.text(alphabet=ODD, min_size=1, max_size=40)))
def test_stretches_align_as_the_whole_text_does(aligner, tokenizers, text):
    made, wanted = aligner.align([text])[0], described(tokenizers, text)
    assert (made is None) == (wanted is None)
    if made:
        numbers, digest, pairs, times = made
        assert (*numbers[:3].tolist(), digest) == wanted[:4]
        assert numbers[3] == sum(wanted[4].values())
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(pairs.tolist(), times.tolist(), strict=True)} == wanted[4]


def test_blocks_and_a_full_cache_change_nothing(aligner, monkeypatch):
    texts = ["the cat sat  on the mat.\n And it's  warm " * 30, "x" * 5000, " a"]
    wanted = [(m[0].tolist(), m[1], m[2].tolist(), m[3].tolist()) for m in aligner.align(texts)]
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "KEPT", 3)
    assert [(m[0].tolist(), m[1], m[2].tolist(), m[3].tolist()) for m in aligner.align(texts)] == wanted


TEXTS = ["the lake and the house", "The lake  and\nthe houses' door", "naïve café — 日本語", "▁ mark", "the lake and the house", "it's <|endoftext|> here", "x" * 300, " ", "the lake and the house"]


@pytest.mark.parametrize("pairs_at_once", [alignment.PAIRS, 20])
def test_measures_equal_a_plain_computation(spark, tokenizers, monkeypatch, pairs_at_once):
    monkeypatch.setattr(alignment, "HOT", 3)  # texts of over a third of the rows are broadcast
    rows = [*enumerate(TEXTS), (None, "the lake"), (50, None), (51, ""), (1, "a repeated id"), *((k, TEXTS[0]) for k in range(60, 80))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pair string, n_rows int")
    made = alignment.align(df, pairs_at_once=pairs_at_once)
    assert sorted((tuple(r) for r in made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == brute(tokenizers, rows)


def test_no_rows_and_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none).count() == 0
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_the_query_on_the_odd_documents(spark, odd_docs, tokenizers, tmp_path):
    rows = [(r.doc_id, r.text and r.text[:3000]) for r in odd_docs.collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = alignment.op12_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in made.collect()), key=str) == brute(tokenizers, rows)
