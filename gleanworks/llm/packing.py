"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Best fit looks at nothing but a piece's length and the room left in the open sequences, so
pieces of one length are interchangeable. The plan is therefore made from the number of
pieces of each length (one number per possible length, whatever the size of the corpus):
lengths go down, a segment tree over the remaining capacities finds the tightest open
capacity that still takes the length, and as many pieces as there are sequences of that
capacity are placed at once. Pieces find their place in the plan by their rank among the
pieces of their length; ranks come from counts per input partition.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.llm.arrow import map_batches, utf8
from gleanworks.session import staged, table

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Words whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 600_000
#: Bytes of the longest word that a worker keeps.
LONGEST_KEPT = 64
#: Bytes of text worked on at a time; it bounds memory, never what is read.
BLOCK = 8 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 13) else c for c in range(256))
#: Marks that may end a word; not the apostrophe, which may start a token of its own with letters.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts as little-endian 32-bit numbers, for a tokenizer that drops case and white space.

    No token of such a vocabulary spans a space, and a run of letters or digits ends where a
    run of marks begins; so a text's ids are those of its words, without their last marks,
    and of those marks. Either is asked of the tokenizer once and kept. Lower-casing A-Z
    first changes nothing but the spelling of special tokens; texts that may hold one are
    given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(g.ids, "<u4").tobytes() for g in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; longer ones are cut at spaces into blocks and put together again."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (k, _), ids in zip(held, self._words([part for _, part in held]), strict=True):
                out[k].append(ids)
            held.clear()

        for k, text in enumerate(texts):
            if b"<|" in text:
                out[k] = self._ask([text.decode()])
                continue
            at = 0
            while at < len(text):
                cut = text.rfind(b" ", at, at + BLOCK) if at + BLOCK < len(text) else -1
                end = cut + 1 if cut > at else text.find(b" ", at + BLOCK) + 1 or len(text) if at + BLOCK < len(text) else len(text)
                held.append((k, text[at:end]))
                size, at = size + end - at, end
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def _words(self, texts: list[bytes]) -> list[bytes]:
        split = [t.translate(_FOLD).split(b" ") for t in texts]
        forms: dict[bytes, bytes] = dict.fromkeys(w for words in split for w in words)
        known, get = self.known, self.known.get
        cut, whole, missing = [], [], set()
        for w in forms:
            ids = get(w)
            if ids is not None:
                forms[w] = ids
                continue
            core = w.rstrip(_MARKS)
            n = len(core)
            if n and n < len(w) and core[-1] in _PLAIN:
                tail = w[n:]
                first, second = get(core), get(tail)
                if first is not None and second is not None:
                    forms[w] = first + second
                    continue
                cut.append((w, core, tail))
                if first is None:
                    missing.add(core)
                if second is None:
                    missing.add(tail)
            else:
                whole.append(w)
                missing.add(w)
        if missing:
            asked = list(missing)
            ids = dict(zip(asked, self._ask([w.decode() for w in asked]), strict=True))
            for w in whole:
                forms[w] = ids[w]
            for w, core, tail in cut:
                forms[w] = (ids.get(core) or known[core]) + (ids.get(tail) or known[tail])
            if len(known) + len(ids) > KEPT_WORDS:
                known.clear()
            known.update((w, i) for w, i in ids.items() if len(w) <= LONGEST_KEPT)
        return [b"".join(map(forms.__getitem__, words)) for words in split]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document is its ids and the end id; only one longer than ``capacity`` is cut.
    """
    path = vocabulary or vocabulary_path()
    end = END.to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(path)
        rows: list[tuple[int, int, int, int, int]] = []
        texts = [t or b"" for t in utf8(batch.column(1))]
        for doc_id, own in zip(batch.column(0).to_pylist(), tokenizer.encode(texts), strict=True):
            ids = own + end
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                stop = min(n, start + capacity)
                rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
        kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", rows=4096)


class CapacityTree:
    """A segment tree over capacities 0..most: which have open sequences."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: what lies right of it is right of its parent
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Returns runs (length, first rank, pieces, first sequence, offset): pieces of that rank
    on go to sequences from the first one on, one each, at that offset.
    """
    tree = CapacityTree(capacity)
    room: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # by capacity left: (first sequence, sequences)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            tight = tree.tightest(length)
            if tight is None:
                # a new sequence takes pieces of this length until it is full, as best fit would have it
                each = capacity // length
                full, rest = divmod(left, each)
                for new, taken in ((full, each), (1 if rest else 0, rest)):
                    if new:
                        for k in range(taken):
                            runs.append((length, rank, new, sequences, k * length))
                            rank += new
                        if capacity - taken * length:
                            room[capacity - taken * length].append((sequences, new))
                            tree.mark(capacity - taken * length, True)
                        sequences += new
                left = 0
                continue
            first, n = room[tight].popleft()
            took = min(n, left)
            if took < n:
                room[tight].appendleft((first + took, n - took))
            if not room[tight]:
                tree.mark(tight, False)
            runs.append((length, rank, took, first, capacity - tight))
            rank, left = rank + took, left - took
            if tight - length:
                room[tight - length].append((first, took))
                tree.mark(tight - length, True)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Columns sequence_id and offset for rows with a ``length`` from 1 to ``capacity``.

    Every row gets one place; ties and repeated rows take any of the places of their length;
    an empty table gives an empty result. At most ``capacity`` counts reach the driver. An
    input with columns of the names that packing adds is refused: nothing is overwritten.
    """
    spark = pieces.sparkSession
    if clash := {"__part", "__within", "__rank", "before", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns of the input have names that packing adds: {sorted(clash)}")
    keep = pieces.columns
    rows = staged(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    by_part = rows.groupBy("length", "__part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(counts, capacity)
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*[c for c in keep if c != "length"])) - 1
    ranked = rows.withColumn("__within", within).join(starts, ["length", "__part"]).select(*keep, (F.col("before") + F.col("__within")).alias("__rank"))
    # a run for each length and capacity that met: bounded by the capacity, not by the rows
    plan = np.array(runs, np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(((plan[:, 0] << 48) + plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4]))
    length_at, rank_at = ranked.columns.index("length"), len(keep)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ranks, sequences, offsets = shared.value
        rank = batch.column(rank_at).to_numpy()
        run = np.searchsorted(keys, (batch.column(length_at).to_numpy() << 48) + rank, side="right") - 1
        made = [pa.array(sequences[run] + rank - ranks[run], pa.int64()), pa.array(offsets[run], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:rank_at], *made], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(lambda batches: map(place, batches), f"{schema}, sequence_id bigint, offset bigint")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(pieces_of(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
