"""Alignment of two tokenizers over a corpus.

Texts are made distinct by a shuffle on the full text; every distinct text is tokenised and
aligned once, and its table of linked pairs is written with its number of rows. Corpus-wide
counts of pairs are sums of those tables, weighted by the rows. The measures of a text are
sums over its table of what the counts say, and reach the documents by a join.

Within a text, neither tokenizer has a token across the place before a space that stands
between two other characters: the byte-level pattern cuts there, and no piece of the other
vocabulary has its space mark behind another character (this is verified when it is read).
So texts are aligned by the stretches between such places, and a worker keeps the stretches
it has met.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.llm.arrow import map_batches
from gleanworks.session import staged, table

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches a worker keeps; beyond that it starts anew.
KEPT = 400_000
#: Texts whose new stretches are learned together, and stretches given to the tokenizer as one text.
TEXTS, TOGETHER = 256, 256
#: Characters of a text aligned at a time; it bounds memory, never what is read.
BLOCK = 1 << 20
#: Rows of pair counts broadcast at a time, about 100 MB as a hash table; more pairs take more passes.
PAIRS = 2_000_000
#: Texts with over a 10,000th of all rows each: at most so many, so they are broadcast.
HOT = 10_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_IRREGULAR = re.compile(r"^ | \s| $|\s ")
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def vocabulary_path(name: str) -> str:
    """Where the public tokenizers' file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Two tokenizers and the stretches met so far; a stretch is named without its leading space."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        of = byte_characters()
        by_id = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(of.get(c, 0) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} has a space behind another character")
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers = np.zeros((1024, 4), np.int64)  # of each stretch: A tokens (-1: bytes differ), B tokens, groups, links
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []

    def ids_a(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The A ids of all stretches in one run, and how many each has.

        Stretches that neither start nor end with white space are tokenised together, some at a
        time: there is a cut between any two of them.
        """
        plain = [k for k, s in enumerate(stretches) if s and not s[0].isspace() and not s[-1].isspace()]
        blocks = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        rest = sorted(set(range(len(stretches))) - set(plain))
        asked = ["".join([" " + stretches[k] for k in block]) for block in blocks] + [" " + stretches[k] for k in rest]
        made = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(asked, add_special_tokens=False)]
        parts: list[np.ndarray] = [made[0]] * len(stretches) if made else []
        for block, ids in zip(blocks, made, strict=False):
            ends = np.cumsum([len(stretches[k].encode()) + 1 for k in block])
            stops = np.searchsorted(np.cumsum(self.sizes_a[ids]), ends, "right").tolist()
            for k, low, high in zip(block, [0, *stops], stops, strict=False):
                parts[k] = ids[low:high]
        for k, ids in zip(rest, made[len(blocks) :], strict=True):
            parts[k] = ids
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def learn(self, stretches: list[str]) -> None:
        """Tokenises and aligns stretches that are not known."""
        if not stretches:
            return
        flat_a, counts_a = self.ids_a(stretches)
        ids_b = self.b.encode(stretches, num_threads=1)
        counts_b = np.fromiter(map(len, ids_b), np.int64, len(ids_b))
        flat_b = np.fromiter(chain.from_iterable(ids_b), np.int64, counts_b.sum())
        same = self._same(stretches, flat_a, counts_a, flat_b, counts_b)
        if not same.all():  # such stretches have no tokens
            flat_a, flat_b = flat_a[np.repeat(same, counts_a)], flat_b[np.repeat(same, counts_b)]
            counts_a, counts_b = counts_a * same, counts_b * same
        # all stretches as one run of bytes: tokens overlap in it only within a stretch
        end_a, end_b = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b])
        start_a, start_b = end_a - self.sizes_a[flat_a], end_b - self.sizes_b[flat_b]
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        links = last - first
        of_a = np.repeat(np.arange(len(flat_a)), links)
        of_b = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
        codes = (flat_a[of_a] << 32) | flat_b[of_b]
        # both have the same cuts, in the same order
        cut_a, cut_b = np.flatnonzero(np.isin(end_a, end_b)) + 1, np.flatnonzero(np.isin(end_b, end_a)) + 1
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        lists = (cut_a.tolist(), cut_b.tolist())
        groups = [f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip([0, *lists[0]], lists[0], [0, *lists[1]], lists[1], strict=False)]
        to_a = np.cumsum(counts_a)
        to_group = np.searchsorted(cut_a, to_a, "right")
        to_link = np.concatenate([[0], np.cumsum(links)])[to_a]
        numbers = np.stack([np.where(same, counts_a, -1), counts_b, np.diff(to_group, prepend=0), np.diff(to_link, prepend=0)], axis=1)
        size = len(self.groups)
        while len(self.numbers) < size + len(stretches):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[size : size + len(stretches)] = numbers
        self.known.update(zip(stretches, range(size, size + len(stretches)), strict=True))
        ends, stops = to_group.tolist(), to_link.tolist()
        self.groups += [";".join(groups[p:q]) for p, q in zip([0, *ends], ends, strict=False)]
        self.pairs += [codes[p:q] for p, q in zip([0, *stops], stops, strict=False)]

    def _same(self, stretches: list[str], flat_a: np.ndarray, counts_a: np.ndarray, flat_b: np.ndarray, counts_b: np.ndarray) -> np.ndarray:
        """Of which stretches both sides' bytes are its own."""
        whole = [b" " + s.encode() for s in stretches]
        sizes, data, out = np.fromiter(map(len, whole), np.int64, len(whole)), b"".join(whole), np.ones(len(whole), bool)
        for flat, counts, texts, lengths in ((flat_a, counts_a, self.bytes_a, self.sizes_a), (flat_b, counts_b, self.bytes_b, self.sizes_b)):
            own = np.add.reduceat(np.append(lengths[flat], 0), np.cumsum(counts) - counts) * (counts > 0)
            pieces = list(map(texts.__getitem__, flat.tolist()))
            if (own == sizes).all() and b"".join(pieces) == data:
                continue
            ends = np.cumsum(counts).tolist()
            out &= [b"".join(pieces[p:q]) == w for p, q, w in zip([0, *ends], ends, whole, strict=False)]
        return out

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray] | None]:
        """Of each text the four numbers, the hash of its groups, its pairs and how many links hold each; None where bytes differ."""
        made = []
        for at in range(0, len(texts), TEXTS):
            made += self._aligned(texts[at : at + TEXTS])
        return made

    def _aligned(self, texts: list[str]) -> list:
        if len(self.known) > KEPT:
            self.forget()
        known = self.known
        first = [next(stretches(t), []) for t in texts]  # all of a text, but for very long ones
        self.learn(list({w for words in first for w in words if w not in known}))
        made = []
        for text, words in zip(texts, first, strict=True):
            parts = [words] if len(text) <= BLOCK else stretches(text)
            total, digest, codes, weights = np.zeros(4, np.int64), hashlib.sha256(), [], []
            for n, words in enumerate(parts):
                if n:
                    self.learn([w for w in dict.fromkeys(words) if w not in known])
                at = list(map(known.__getitem__, words))
                numbers = self.numbers[at]
                if numbers[:, 0].min() < 0:
                    break
                total += numbers.sum(axis=0)
                digest.update(((";" if n else "") + ";".join(map(self.groups.__getitem__, at))).encode())
                times = Counter(at)
                codes += map(self.pairs.__getitem__, times)
                weights.append(np.repeat(np.fromiter(times.values(), np.int64, len(times)), self.numbers[list(times), 3]))
            else:
                pairs, weight = np.concatenate(codes), np.concatenate(weights)
                order = np.argsort(pairs)
                pairs, weight = pairs[order], weight[order]
                edges = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
                made.append((total, digest.hexdigest(), pairs[edges], np.add.reduceat(weight, edges)))
                continue
            made.append(None)
        return made


def stretches(text: str) -> Iterator[list[str]]:
    """The stretches of a text that is not empty, some at a time."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        part = text[at : found.start()] if found else text[at:]
        yield part.split(" ") if not _IRREGULAR.search(part) else [s[1:] for s in _CUT.split(" " + part)]
        at += len(part) + 1


_LOADED: dict[tuple[str, str], Aligner] = {}


def _loaded(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def aligned_texts(docs: DataFrame, text_column: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row for each distinct text with tokens: text_sha256, n_rows, the numbers, groups_sha256 and links (pair, times).

    ``pair`` is the A id times 2**32 plus the B id. Written in the shared folder, so that texts
    are tokenised once. Null and empty texts have no row, nor have texts whose bytes differ.
    """
    path_a, path_b = path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)
    texts = docs.select(F.col(text_column).cast("string").alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n_rows"))
    link = pa.struct([("pair", pa.int64()), ("times", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        made = _loaded(path_a, path_b).align(batch.column(0).to_pylist())
        kept = [k for k, m in enumerate(made) if m is not None]
        if not kept:
            return None
        rows = [made[k] for k in kept]
        ends = np.cumsum([0, *(len(r[2]) for r in rows)])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in (2, 3)], fields=list(link))
        numbers = np.stack([r[0] for r in rows])
        columns = [batch.column(1).take(kept), batch.column(2).take(kept), *(pa.array(numbers[:, k]) for k in range(4)), pa.array([r[1] for r in rows]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
        return pa.RecordBatch.from_arrays(columns, ["text_sha256", "n_rows", *MEASURES, "groups_sha256", "links"])

    schema = f"text_sha256 string, n_rows bigint, {', '.join(f'{m} bigint' for m in MEASURES)}, groups_sha256 string, links array<struct<pair: bigint, times: bigint>>"
    made = map_batches(texts.select("text", F.sha2("text", 256).alias("text_sha256"), "n_rows"), run, schema, rows=256)
    return staged(made.withColumn("text_no", F.monotonically_increasing_id()), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """pair, links (how many corpus-wide hold it) and best (no pair of that B id has more)."""
    each = texts.select("n_rows", F.inline("links"))
    counts = each.groupBy("pair").agg(F.sum(F.col("times") * F.col("n_rows")).alias("links"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return staged(counts.withColumn("best", F.col("links") == F.max("links").over(of_b)), "pairs")


def measured(texts: DataFrame, counts: DataFrame, pairs_at_once: int = PAIRS) -> DataFrame:
    """``texts`` without links, with n_best and count_sum.

    The counts are broadcast, ``pairs_at_once`` rows at most at a time: measures are sums over
    pairs, so with more of them the texts pass by once for each part of the counts. Each text's
    links lie together, so they are added up before anything is shuffled.
    """
    parts = max(1, -(-counts.count() // pairs_at_once))
    number = F.pmod(F.xxhash64("pair"), F.lit(2 * parts)) if parts > 1 else F.lit(0)
    sums = None
    for part in range(2 * parts if parts > 1 else 1):
        some = F.broadcast(counts.where(number == part))
        added = texts.select("text_no", F.inline("links")).join(some, "pair").groupBy("text_no").agg(F.sum(F.col("times") * F.col("links")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
        sums = added if sums is None else sums.unionByName(added)
    if parts > 1:
        sums = sums.groupBy("text_no").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return texts.drop("links").join(sums, "text_no").drop("text_no")


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_a: str | None = None, path_b: str | None = None, pairs_at_once: int = PAIRS) -> DataFrame:
    """The id and the alignment measures of every row of ``docs``.

    Rows without tokens (text null or empty, or whose joined bytes of A or B differ from space
    and text) have zeros and an empty ``groups_sha256``. Repeated rows and equal texts have
    equal measures, each row counted; rows without an id take part; other columns play no part.
    """
    texts = aligned_texts(docs, text_column, path_a, path_b)
    measures = staged(measured(texts, pair_counts(texts), pairs_at_once), "measures")
    rows = texts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    values = [*MEASURES, "n_best", "count_sum", "groups_sha256"]
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    some = keyed.where("text <> ''").drop("text")
    none = keyed.where("coalesce(text, '') = ''").select("doc_id", *(F.lit(None).alias(v) for v in values))
    is_hot = F.col("n_rows") * HOT > F.lit(rows)
    hot = measures.where(is_hot).select("text_sha256", *values)
    often = some.join(F.broadcast(hot), "text_sha256")
    rest = some.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(measures.where(~is_hot).select("text_sha256", *values), "text_sha256", "left")
    both = often.select("doc_id", *values).unionByName(rest.select("doc_id", *values)).unionByName(none)
    zeros = [F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values[:-1]]
    return both.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment measures of all documents between the byte-level and the piece vocabulary."""
    return align(table(spark, sf_dir, "documents"))
