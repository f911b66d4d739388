import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gleanworks.llm import langid, mixing, packing, queries, toxicity
from tests.llm.test_pairs import components, shingle_set
from tests.llm.test_text_operators import brute_sequences, brute_toxicity, numpy_rake

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages_take_odd_rows(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (9, 0, 0), (None, None, None)], "doc_id long, toxic int, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == odd_docs.columns
            made.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            again = stage(spark, docs.where("false"), str(tmp_path))
            assert again.count() == 0
    kept = [r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()]
    assert kept.count(9) == 1 and not {1, 2} <= set(kept)
    assert made.count() > 0


@there
def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(r.length for r in rows) <= 4096
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= docs


@there
def test_every_stage_equals_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against the plain way of doing the same."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs if not k else spark.read.parquet(f"{tmp_path}/{k - 1}"), SF).write.parquet(f"{tmp_path}/{k}")
        stages.append(spark.read.parquet(f"{tmp_path}/{k}").collect())
    texts = {r.doc_id: r for r in docs.collect()}

    model = langid.fit_languages(docs)
    known = [r for r in texts.values() if r.text and any(c.isalpha() for c in r.text)]
    sure = model.probabilities([r.text.encode() for r in known]).max(axis=1) >= model.level
    assert sorted(r.doc_id for r in stages[0]) == sorted(r.doc_id for r, s in zip(known, sure, strict=True) if s)
    assert len(stages[0]) >= 0.95 * len(known)

    marks = toxicity.fit_toxicity(spark.createDataFrame(stages[0], docs.schema), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in stages[0] if brute_toxicity(r.text, marks) < 0.5)

    sets = {r.doc_id: shingle_set(r.text, 5) for r in stages[1]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for i, c in components(sets, links).items() if i == c)

    described = {r.row.doc_id: r for r in mixing.describe(spark.createDataFrame(stages[2], docs.schema)).collect()}
    cells = Counter()
    for r in described.values():
        if r.tokens:
            cells[r.source, r.lang, r.topic] += r.tokens
    weight = numpy_rake(cells, mixing.Settings().temperature, 15)
    want = {}
    for i, r in described.items():
        p = mixing.Settings().fraction * weight[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic] if r.tokens else 1.0
        if abs(r.draw - p % 1) > 1e-3:  # what the tolerance of raking may decide is left out
            want[i] = int(p) + (r.draw < p % 1)
    got = Counter(r.doc_id for r in stages[3])
    assert len(want) > 0.9 * len(described) and all(got[i] == n for i, n in want.items())
    assert all(tuple(r) == tuple(texts[r.doc_id]) for r in stages[3])

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    pieces, held = Counter(), defaultdict(list)
    for r in stages[3]:
        own = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.update((r.doc_id, k, s, len(own[s : s + 4096]), zlib.crc32(own[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(own), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4]) == pieces
    for r in stages[4]:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(own)[k][0] == sum(n for _, n in sorted(own)[:k]) for own in held.values() for k in range(len(own)))
    assert all(sum(n for _, n in own) <= 4096 for own in held.values())
    assert len(held) == brute_sequences([r.length for r in stages[4]], 4096)


@there
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    kind = {"op3_vector_join": "embeddings", "op11_centroids": "embeddings", "op5_html": "pages"}.get(name, "documents")
    table = spark.read.parquet(f"{SF}/{kind}.parquet")
    rows = queries.QUERIES[name](spark, SF)
    key = {"embeddings": "vec_id", "pages": "page_id"}.get(kind, "doc_id")
    assert {r[0] for r in rows.select(key).collect()} == {r[0] for r in table.select(key).collect()}
    if name == "op1_language_id":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.collect())


def test_of_rows_with_one_id_and_text_the_first_in_order_stays(spark):
    text = "the lake lies behind the old house on the hill near the river"
    rows = [(1, text, "en", "b", 5), (1, text, "en", "a", 9), (1, text, None, "z", 1), (1, "quite another text of the same id that tells of ships and grain", "en", "c", 2), (2, text + " and on", "de", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = corpus_pipeline.distinct_texts(spark, docs, "")
    assert made.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in made.collect()) == [(1, "c"), (1, "z")]
