"""Batch retrieval: many questions against many passages, by words, by vectors, and by both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.functions.stem import stem
from gleanworks.functions.text import lexemes, words
from gleanworks.operators.tally import first_places, from_number, number, word_counts
from gleanworks.session import ship_package, small, staged, staged_count

CANDIDATES, TOP_K, RRF_K, RERANK_POOL = 20, 5, 60, 20
#: Lexemes, or pairs of question and lexeme, that are broadcast; beyond, they are joined.
ASKED = 200_000
#: Questions, as vectors, that one pass over the vectors answers.
QUESTION_BLOCK = 16_384
#: Pairs of question and place from which a first pass over one vector in ``SAMPLE`` pays.
SAMPLE_FROM, SAMPLE = 20_000, 16
#: Pivots of a block of questions; questions and vectors of one product; entries kept before they are narrowed.
PIVOTS, TILE, KEPT = 32, 1024, 1_000_000
#: Texts, by key and hash, that are broadcast where rows are looked for; beyond, they are joined.
NAMED = 200_000
#: Bytes of texts that are broadcast for prompts.
SHARED_BYTES = 48_000_000
#: What rounding may add to an angle or a cosine.
SLACK = 1e-6
#: What one matching position adds to a lexical score.
POSITION_WEIGHT = 0.1


def ranked(rows: DataFrame, by: str, order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rows with their rank from 1 within ``by``; only the first ``limit``."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


def stemmed_lexemes(rows: DataFrame) -> DataFrame:
    """form, stem: the English stem of every distinct lexeme of (lexeme) rows."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], ["form", "stem"])

    return rows.select(F.col("lexeme").alias("form")).distinct().mapInArrow(run, "form string, stem string")


def stemmed(rows: DataFrame) -> DataFrame:
    """(…, lexeme) rows with English stems for lexemes: every distinct lexeme is stemmed once."""
    return rows.join(stemmed_lexemes(rows).withColumnRenamed("form", "lexeme"), "lexeme").withColumn("lexeme", F.col("stem")).drop("stem")


def asked_lexemes(questions: DataFrame) -> DataFrame:
    """qid, lexeme: the distinct lexemes of each question."""
    return questions.select("qid", F.explode(F.array_distinct(lexemes(F.col("question")))).alias("lexeme"))


def lexical_search(questions: DataFrame, passages: DataFrame, limit: int = CANDIDATES, key: str = "doc_id", stems: bool = False) -> DataFrame:
    """qid, key, score, rank: any lexeme of the question matches; every matching position counts.

    ``questions`` has qid and question, ``passages`` key and text; qid and key are whole numbers. A
    question of stop words only finds nothing. With ``stems``, words match that have the same English stem.
    """
    asked = asked_lexemes(questions)
    asked = stemmed(asked) if stems else asked
    return by_words(questions, asked, lambda words: word_counts(passages, words, key, stems=stems), limit, key, dict(passages.dtypes)[key])


def by_words(questions: DataFrame, asked: DataFrame, counts_of: Callable[[pa.Array], DataFrame], limit: int, key: str, kind: str) -> DataFrame:
    """The first passages of (qid, lexeme) rows by counts of words (see ``tally``), scored and named as a ranking."""
    pairs = asked.select(number(F.col("qid")).alias("qid"), F.col("lexeme").alias("word")).distinct()
    found = first_places(pairs, counts_of, limit).withColumnRenamed("key", key)
    return found.select(from_number("qid", dict(questions.dtypes)["qid"]), from_number(key, kind), (F.col("n") * POSITION_WEIGHT).alias("score"), "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _valid(vectors: DataFrame, key: str) -> DataFrame:
    """k, v: the vectors that can have a cosine, not null or zero, without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(key).cast("long").alias("k"), v.alias("v")).where(F.coalesce(finite & F.col("k").isNotNull(), F.lit(False)))


def _units(column: pa.ListArray, length: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_length(keys: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, unit vectors) of each length in a batch."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(sizes).tolist():
        at = pa.array(np.flatnonzero(sizes == length))
        yield int(length), keys.take(at).to_numpy(), _units(vectors.take(at), int(length))


def vector_search(questions: DataFrame, vectors: DataFrame, limit: int = CANDIDATES, key: str = "vec_id", block: int = QUESTION_BLOCK) -> DataFrame:
    """qid, key, score, rank: the nearest vectors of equal length by exact cosine, ties by key.

    Questions (qid, embedding) and vectors (key, embedding) that are null, zero or hold null
    or non-finite components find nothing and are not found. The stated questions go in
    blocks of ``block``, which are broadcast; vectors pass by where they are read. Many
    questions first meet one vector in ``SAMPLE``: what their ``limit``-th best scores there, it scores at
    least among all, so tasks send on nothing below it. There is a pass, and such a first one, for each block.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    (asked, n), held = staged_count(_valid(questions, "qid"), "asked"), _valid(vectors, key)
    blocks = max(1, -(-n // block))
    order = [F.desc(F.round("score", 9)), F.col(key)]
    found = None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == k) if blocks > 1 else asked
        part = own.toArrow().combine_chunks()  # about ``block`` vectors
        by_length = {m: Asked(ids, x) for m, ids, x in _by_length(part.column(0).combine_chunks(), part.column(1).combine_chunks())} if part.num_rows else {}
        schema = f"qid bigint, {key} bigint, score double"
        if part.num_rows * limit > SAMPLE_FROM:
            first = spark.sparkContext.broadcast(by_length)
            some = held.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(SAMPLE)) == 0).mapInArrow(_nearest(first, limit), schema)
            last = ranked(some, "qid", order, limit).where(F.col("rank") == limit).select("qid", "score").toArrow()  # one number for each question
            least = dict(zip(last.column(0).to_pylist(), last.column(1).to_pylist(), strict=True))
            by_length = {m: Asked(a.ids, a.units, np.array([np.round(least.get(q, -np.inf), 9) for q in a.ids.tolist()])) for m, a in by_length.items()}
            first.destroy()
        shared = spark.sparkContext.broadcast(by_length)
        best = held.mapInArrow(_nearest(shared, limit), schema)
        if blocks > 1:  # one block is held at a time
            best = staged(ranked(best, "qid", order, limit).drop("rank"), "nearest")
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    return ranked(found, "qid", order, limit)


class Asked:
    """Questions of one length: ids, unit vectors and, for each, a score that its first places have at least."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, least: np.ndarray | None = None):
        self.ids, self.units = ids, units
        self.least = np.full(len(ids), -np.inf) if least is None else least
        self.pivots = self._far_apart()

    def _far_apart(self) -> np.ndarray:
        """Unit vectors of questions, each the one farthest from those before."""
        at, nearest = [0], np.full(len(self.units), -np.inf)
        while len(at) < min(PIVOTS, len(self.units)):
            nearest = np.maximum(nearest, self.units @ self.units[at[-1]])
            at.append(int(nearest.argmin()))
        return self.units[at]


class Best:
    """The first ``limit`` vectors of each question, as vectors pass by.

    Vectors are taken by their nearest pivot. By the triangle inequality for angles, a vector
    within angle r of a pivot is at least a - r from a question at angle a; questions whose
    least score is out of that reach are not compared with the pivot's vectors.
    """

    def __init__(self, asked: Asked, limit: int):
        self.asked, self.limit = asked, limit
        self.least = asked.least.copy()
        self.angles = _angle(asked.units @ asked.pivots.T)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.compared = 0

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        near = units @ self.asked.pivots.T
        pivot = near.argmax(axis=1)
        apart = _angle(near[np.arange(len(units)), pivot])
        for p in np.unique(pivot).tolist():
            own = np.flatnonzero(pivot == p)
            reach = np.cos(np.maximum(0.0, self.angles[:, p] - apart[own].max() - SLACK)) + SLACK
            alive = np.flatnonzero(reach >= self.least)
            for low in range(0, len(own), TILE):
                vectors = own[low : low + TILE]
                for at in range(0, len(alive), TILE):
                    questions = alive[at : at + TILE]
                    scores = self.asked.units[questions] @ units[vectors].T
                    self.compared += scores.size
                    rounded = np.round(scores, 9)
                    q, v = np.nonzero(rounded >= self.least[questions][:, None])
                    self.parts.append((questions[q], ids[vectors[v]], scores[q, v]))
                    self.held += len(q)
                    if self.held > KEPT:
                        self.narrow()

    def narrow(self) -> None:
        """Keeps the first places of what was met, and raises the least scores to the last of them."""
        if not self.parts:
            return
        q, ids, scores = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        rounded = np.round(scores, 9)
        order = np.lexsort((ids, -rounded, q))
        q, ids, scores, rounded = q[order], ids[order], scores[order], rounded[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        last = place == self.limit - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], rounded[last])
        kept = place < self.limit
        self.parts = [(q[kept], ids[kept], scores[kept])]
        self.held = int(kept.sum()) if kept.sum() < KEPT // 2 else 0  # a full table is no reason to narrow it at once


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _nearest(shared, limit: int):
    """Over the batches of a task: the best ``limit`` vectors of each question, and none below its least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Best] = {}
        for batch in batches:
            for length, ids, x in _by_length(batch.column(0), batch.column(1)):
                if length in shared.value:
                    if length not in kept:
                        kept[length] = Best(shared.value[length], limit)
                    kept[length].add(ids, x)
        for best in kept.values():
            best.narrow()
            for q, ids, scores in best.parts:
                for at in range(0, len(q), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000]) for c in (best.asked.ids[q], ids, scores)], ["qid", "key", "score"])

    return run


def fuse(rankings: list[DataFrame], k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """qid, key, fused, fused_rank: reciprocal rank fusion of (qid, key, rank) rankings."""
    rows = [r.select("qid", key, "rank") for r in rankings]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    fused = union.groupBy("qid", key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 12).alias("fused"))
    return ranked(fused, "qid", [F.desc("fused"), F.col(key)], name="fused_rank")


def candidates(lexical: DataFrame, vector: DataFrame, bodies: DataFrame, mode: str = "hybrid", k: int = RRF_K, key: str = "doc_id") -> DataFrame:
    """The pool of each question with the ranks it came by; passages without a body drop out and ranks close up.

    Texts stay where they are: ``body`` (a hash of the text) tells rows of one key apart.
    """
    if mode not in ("hybrid", "lexical", "vector"):
        raise ValueError(f"no such mode: {mode}")
    lex = lexical.select("qid", key, F.col("rank").alias("lexical_rank"))
    vec = vector.select("qid", key, F.col("rank").alias("vector_rank"))
    if mode == "hybrid":
        pool = lex.join(vec, ["qid", key], "full_outer")
        one = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
        pool = pool.withColumn("score", F.round(one("lexical_rank") + one("vector_rank"), 12))
    elif mode == "lexical":
        pool = lex.join(lexical.select("qid", key, "score"), ["qid", key]).withColumn("vector_rank", F.lit(None).cast("int"))
    else:
        pool = vec.join(vector.select("qid", key, "score"), ["qid", key]).withColumn("lexical_rank", F.lit(None).cast("int"))
    kept = ranked(pool.join(bodies.select(key, F.xxhash64("text").alias("body")), key), "qid", [F.desc("score"), F.col(key), F.col("body")])
    return kept.withColumn("fused_rank", F.col("rank") if mode == "hybrid" else F.lit(None).cast("int"))


def texts_of(rows: DataFrame, bodies: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body, text: each text that (key, body) rows name, once."""
    named = small(rows.select(key, "body").distinct(), NAMED, "named")
    return bodies.select(key, F.xxhash64("text").alias("body"), "text").join(named, [key, "body"], "left_semi").dropDuplicates([key, "body"])


def word_set(text: Column) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def rerank(pool: DataFrame, questions: DataFrame, bodies: DataFrame, score: Column | None = None, shortlist: int = RERANK_POOL, key: str = "doc_id") -> DataFrame:
    """The shortlist of each question in the order of ``score``, ties by fused rank; the rest follows as it was.

    ``score`` is of question and text. Without one, it is the number of distinct words that they share, a stand-in
    for a re-ranking model. A null score (the model failed) leaves the fused order. Only texts of shortlists are read,
    and each is shuffled once.
    """
    pool = staged(pool, "pool")
    short, rest = pool.where(F.col("fused_rank") <= shortlist), pool.where(F.col("fused_rank") > shortlist)
    asked, texts = questions.select("qid", "question"), texts_of(short, bodies, key)
    if score is None:
        texts = texts.select(key, "body", word_set(F.col("text")).alias("words"))
        told = short.join(asked.withColumn("asked", word_set(F.col("question"))), "qid").join(texts, [key, "body"])
        scored = told.withColumn("rerank_score", F.size(F.array_intersect("asked", "words")).cast("double")).drop("asked", "words")
    else:
        scored = short.join(asked, "qid").join(texts, [key, "body"]).withColumn("rerank_score", score.cast("double")).drop("text")
    rows = scored.unionByName(rest.join(asked, "qid").withColumn("rerank_score", F.lit(None).cast("double")))
    order = [F.when(F.col("fused_rank") <= shortlist, 0).otherwise(1), F.desc_nulls_last("rerank_score"), F.col("fused_rank")]
    return ranked(rows, "qid", order)


def hits(questions: DataFrame, lexical: DataFrame, vector: DataFrame, bodies: DataFrame, mode: str = "hybrid", reranked: bool = True, top_k: int = TOP_K, key: str = "doc_id") -> DataFrame:
    """The first ``top_k`` passages of each question, without their texts; re-ranked only in hybrid mode."""
    if not 1 <= top_k <= 20:
        raise ValueError("top_k goes from 1 to 20")
    pool = candidates(lexical, vector, bodies, mode, key=key)
    if mode == "hybrid" and reranked:
        pool = rerank(pool, questions, bodies, shortlist=max(RERANK_POOL, top_k), key=key)
    else:
        pool = pool.withColumn("rerank_score", F.lit(None).cast("double"))
    return pool.where(F.col("rank") <= top_k)


def search(questions: DataFrame, lexical: DataFrame, vector: DataFrame, bodies: DataFrame, mode: str = "hybrid", reranked: bool = True, top_k: int = TOP_K, key: str = "doc_id") -> DataFrame:
    """``hits`` with their texts."""
    found = staged(hits(questions, lexical, vector, bodies, mode, reranked, top_k, key), "hits")
    return found.join(texts_of(found, bodies, key), [key, "body"]).drop("body")


def prompt(hits: DataFrame, bodies: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, prompt: the passages of each question in rank order; a line of its own when there are none.

    ``hits`` have qid, rank, key and body. Texts that most prompts hold are broadcast, ``SHARED_BYTES`` in all; only the
    others go through a shuffle, once for each prompt.
    """
    hits = staged(hits.select("qid", "rank", key, "body"), "hits")
    part = F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] "), F.col("text"))
    uses = hits.groupBy(key, "body").agg(F.count("*").alias("uses"))
    parts = staged(texts_of(hits, bodies, key).join(uses, [key, "body"]).select(key, "body", part.alias("part"), "uses"), "parts")
    sizes = parts.groupBy("uses").agg(F.sum(F.coalesce(F.octet_length("part"), F.lit(0)) + 64).alias("n")).orderBy(F.desc("uses"))
    # how often a text must be used to be broadcast; a number for each number of uses: no more than the root of ten times the questions
    total, often = 0, None
    for r in sizes.toLocalIterator():
        total += r.n
        if total > SHARED_BYTES:
            break
        often = r.uses
    else:
        often = 0
    shared = F.broadcast(parts.where(F.col("uses") >= often)) if often is not None else None
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", key, "body"))).alias("places"))
    most = hits.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    own = []
    for j in range(most if shared is not None else 0):
        place = F.get("places", F.lit(j))
        at = shared.select(F.col(key).alias(f"key{j}"), F.col("body").alias(f"body{j}"), F.col("part").alias(f"part{j}"))
        rows = rows.join(at, (place[key] == F.col(f"key{j}")) & (place["body"] == F.col(f"body{j}")), "left").drop(f"key{j}", f"body{j}")
        own.append(F.struct(place["rank"].alias("rank"), F.col(f"part{j}").alias("part")))
    told = F.array(*own) if own else F.array().cast("array<struct<rank:int,part:string>>")
    if often != 0:
        rare = parts if often is None else parts.where(F.col("uses") < often)
        rest = hits.join(rare, [key, "body"]).groupBy("qid").agg(F.collect_list(F.struct("rank", "part")).alias("rest"))
        rows = rows.join(rest, "qid", "left")
        told = F.concat(told, F.coalesce("rest", F.array().cast("array<struct<rank:int,part:string>>")))
    lines = F.transform(F.array_sort(F.filter(told, lambda p: p["part"].isNotNull())), lambda p: p["part"])
    return rows.select("qid", F.coalesce(F.nullif(F.array_join(lines, "\n\n"), F.lit("")), F.lit("(no passages)")).alias("prompt"))


def question_words(docs: DataFrame, every: int, n: int, key: str = "doc_id") -> DataFrame:
    """qid, question: the first words of every so-manieth document, as a question."""
    return docs.where(F.col(key) % every == 0).select(F.col(key).alias("qid"), F.array_join(F.slice(words(F.col("text")), 1, n), " ").alias("question"))
