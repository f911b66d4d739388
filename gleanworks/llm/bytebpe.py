"""Byte-level BPE encoding and decoding of whole texts.

A text is cut by the vocabulary's pattern, and every match is encoded by itself. Each worker
has a DuckDB connection with a table of merges: all pairs of tokens whose bytes together are
a token, with that token's rank. The distinct words of a batch that are no tokens become
rows (word, position, token) of single bytes; a recursive query unnests each word's tokens by
position, joins neighbours with the merges and contracts the leftmost pair of least rank of each
word, until no word has a pair left. Decoding joins positions with the vocabulary and concatenates in order, in the
same connection. Words met before are kept by the worker, in bounded number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.arrow import lists_of
from gleanworks.session import ship_package, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a worker keeps; beyond that it starts anew.
KEPT_WORDS = 500_000
#: Rows of all rounds of one recursive query, at most: a word of n bytes has under n * n / 2.
ROWS = 2_000_000
#: Bytes of a word from which one contraction a round would cost too much: a heap contracts it, in the same order.
LONG = 512
#: Rows encoded together.
ROWS_AT_ONCE = 1024
#: Words of a text taken at a time, and tokens decoded at a time; they bound memory, never what is read.
WORDS, TOKENS = 500_000, 500_000

CONTRACT = """
WITH RECURSIVE state(word, tokens, round) AS (
  SELECT word, list(token ORDER BY place), 0 FROM bytes_of_words GROUP BY word
  UNION ALL
  (WITH pairs AS (SELECT word, unnest(range(1, len(tokens))) AS place, unnest(tokens[:len(tokens) - 1]) AS first, unnest(tokens[2:]) AS second FROM state),
   least AS (SELECT word, min((rank::BIGINT << 32) + place) AS choice FROM pairs JOIN merges ON pair = (first::BIGINT << 32) + second GROUP BY word),
   met AS (SELECT word, choice >> 32 AS rank, choice & 4294967295 AS place FROM least)
   SELECT word, tokens[:place - 1] || [rank::INT] || tokens[place + 2:], round + 1 FROM state JOIN met USING (word)))
SELECT arg_max(tokens, round) AS tokens FROM state GROUP BY word ORDER BY word"""

DECODE = "SELECT text, string_agg(piece, '' ORDER BY place) AS whole FROM tokens JOIN vocabulary USING (token) GROUP BY text ORDER BY text"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by the bytes of each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def heap_contract(tokens: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The same contractions by a heap of (rank, place): for very long words, in n log n steps."""
    n = len(tokens)
    token, after, before = list(tokens), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(m, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := merges.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if token[i] != left or j < 0 or token[j] != right:
            continue  # one of the two has been contracted since
        token[i], token[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) >= 0 and (m := merges.get((token[a], token[b]))) is not None:
                heapq.heappush(heap, (m, a, token[a], token[b]))
    return [t for t in token if t >= 0]


class ByteBpe:
    """A vocabulary in a DuckDB connection of one thread."""

    def __init__(self, path: str, pattern: str | None = None):
        import duckdb
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.split = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        # bytes as the characters of the same numbers: character text can be aggregated in order
        self.con.register("given", pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS FROM given")

    def merges(self) -> dict[tuple[int, int], int]:
        """The rank of every pair of tokens that makes a token; read into the connection the first time."""
        if not self.pairs:
            get = self.ranks.get
            self.pairs = {(a, b): rank for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None}
            self.con.register("given", pa.table({"pair": [(a << 32) + b for a, b in self.pairs], "rank": pa.array(self.pairs.values(), pa.int32())}))
            self.con.execute("CREATE TABLE merges AS FROM given")
        return self.pairs

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word that is not empty, as 32-bit numbers, by the recursive query."""
        self.merges()
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        place = (np.arange(len(number)) - np.repeat(starts, sizes)).astype(np.int32)
        self.con.register("bytes_of_words", pa.table({"word": number, "place": place, "token": self.single[np.frombuffer(b"".join(words), np.uint8)]}))
        made = self.con.sql(CONTRACT).to_arrow_table()["tokens"]
        return [np.ascontiguousarray(ids, "<i4").tobytes() for ids in lists_of(made)]

    def learn(self, missing: Iterable[str]) -> dict[str, bytes]:
        """The ids of words; all but long ones are kept."""
        found: dict[str, bytes] = {}
        block: list[tuple[str, bytes]] = []
        rows = 0

        def flush() -> None:
            found.update(zip([w for w, _ in block], self.contract([b for _, b in block]), strict=True))
            block.clear()

        for word in sorted(missing, key=len):
            data = word.encode()
            rank = self.ranks.get(data)
            if rank is not None:  # a word that is a token is that token, whatever the merges give
                found[word] = rank.to_bytes(4, "little")
            elif len(data) > LONG:
                found[word] = np.array(heap_contract([int(self.single[b]) for b in data], self.merges()), "<i4").tobytes()
            else:
                block.append((word, data))
                rows += len(data) * len(data) // 2 + 1
                if rows > ROWS:
                    flush()
                    rows = 0
        if block:
            flush()
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= LONG)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            ids = self.known
            if missing := {w for _, words in held for w in words if w not in ids}:
                if len(ids) + len(missing) > KEPT_WORDS:
                    ids, self.known = dict(ids), {}
                found = self.learn(missing)
                if ids is not self.known or any(len(w) > LONG for w in found):
                    ids = ids | found
            for k, words in held:
                out[k].append(b"".join(map(ids.__getitem__, words)))
            held.clear()

        for k, text in enumerate(texts):
            matches = (m.group() for m in self.split.finditer(text)) if len(text) > 4 * WORDS else iter(self.split.findall(text))
            while words := list(islice(matches, WORDS)):
                held.append((k, words))
                size += len(words)
                if size >= WORDS:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; an unknown id raises."""
        out: list[list[bytes]] = [[] for _ in ids]
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            sizes = np.array([len(part) for _, part in held])
            flat = np.concatenate([part for _, part in held]).astype(np.int32)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(self.ranks)):
                raise ValueError("an id is not in the vocabulary")
            self.con.register("tokens", pa.table({"text": np.repeat(np.arange(len(held), dtype=np.int32), sizes), "place": np.arange(len(flat), dtype=np.int32), "token": flat}))
            for at, whole in self.con.execute(DECODE).fetchall():
                out[held[at][0]].append(whole.encode("latin-1"))
            held.clear()

        for k, part in enumerate(ids):
            for at in range(0, len(part), TOKENS):
                held.append((k, part[at : at + TOKENS]))
                size += len(held[-1][1])
                if size >= TOKENS:
                    flush()
                    size = 0
        if held:
            flush()
        return [b"".join(parts) for parts in out]


_LOADED: dict[tuple[str, str | None], ByteBpe] = {}


def _loaded(path: str, pattern: str | None) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def _append(df: DataFrame, from_column: str, made: dict[str, str], work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` and the columns that ``work`` makes of one column, for each slice of a batch."""
    if clash := set(made) & set(df.columns):
        raise ValueError(f"the input has columns {sorted(clash)}")
    ship_package(df.sparkSession)
    given = df.withColumn("__of", F.col(f"`{from_column}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *work(part.column(part.num_columns - 1))], [*part.schema.names[:-1], *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{name}` {kind}" for name, kind in made.items())])
    return given.mapInArrow(run, schema)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(df: DataFrame, text_column: str = "text", name: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the ids of every text as an array column ``name``.

    Null and empty texts have no ids; special tokens' strings are plain text; texts of any
    length are encoded whole; other columns pass through, whatever their names. An input
    that has a column ``name`` is refused. No rows give no rows.
    """
    path = vocabulary or vocabulary_path()
    return _append(df, text_column, {name: "array<int>"}, lambda texts: [_lists(_loaded(path, pattern).encode([t or "" for t in texts.to_pylist()]))])


def decode(df: DataFrame, ids_column: str = "ids", name: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the bytes of every list of ids as a binary column ``name``; null or empty lists give no bytes."""
    path = vocabulary or vocabulary_path()

    def work(lists: pa.Array) -> list[pa.Array]:
        whole = pa.array([v or [] for v in lists.to_pylist()], pa.list_(pa.int32())) if lists.null_count else lists
        return [pa.array(_loaded(path, None).decode(lists_of(pa.chunked_array([whole]))), pa.binary())]

    return _append(df, ids_column, {name: "binary"}, work)


def round_trip(df: DataFrame, text_column: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``ids`` and ``decoded``: what ``decode`` makes of what ``encode`` makes, by one worker."""
    path = vocabulary or vocabulary_path()

    def work(texts: pa.Array) -> list[pa.Array]:
        coder = _loaded(path, pattern)
        ids = coder.encode([t or "" for t in texts.to_pylist()])
        return [_lists(ids), pa.array(coder.decode([np.frombuffer(i, "<i4") for i in ids]), pa.binary())]

    return _append(df, text_column, {"ids": "array<int>", "decoded": "binary"}, work)


def op13_bytes(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
