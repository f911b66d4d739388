"""Model calls as Arrow functions, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.functions.text import whole_sentences
from gleanworks.operators.ledger import fan_out
from gleanworks.session import ship_package

Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(dims: int = 64) -> Embedder:
    """Unit vectors seeded by the SHA-256 of each text: equal texts, equal vectors."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dims), np.float32)
        for k, text in enumerate(texts):
            x = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")).normal(size=dims)
            out[k] = x / np.linalg.norm(x)
        return out

    return embed


def embed(rows: DataFrame, embedder: Embedder, key: str = "doc_id", text: str = "text", batch: int = 64, workers: int = 1, per_second: float | None = None) -> DataFrame:
    """key, embedding: ``batch`` texts a call; a count that differs from the texts' fails the task.

    A task has ``workers`` calls under way at a time, ``per_second`` of them begun at most; vectors keep their rows' order.
    """
    ship_package(rows.sparkSession)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        vectors = embedder(part[text].tolist())
        if len(vectors) != len(part):
            raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
        return pd.DataFrame({key: part[key], "embedding": [v.tolist() for v in vectors]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fan_out(one, (frame.iloc[at : at + batch] for frame in frames for at in range(0, len(frame), batch)), workers, per_second)

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def call_model(rows: DataFrame, model: Callable[[dict], str], key: str, columns: list[str], fallback: Callable[[dict], str] | None = None, check: Callable[[str], str | None] | None = None, workers: int = 1, per_second: float | None = None) -> DataFrame:
    """key, value, error, fallback: one call a row; a row's failure stays in its row.

    A task has ``workers`` calls under way at a time. For calls that are paid for, see ``ledger``.

    A time-out or a connection that fails goes to ``fallback``; any other error is recorded.
    ``check`` says what is wrong with a reply: the model is asked once more, with that as
    ``problem`` in its row, and a second wrong reply is the row's error.
    """
    ship_package(rows.sparkSession)

    def asked(model: Callable[[dict], str], row: dict) -> str:
        value = model(row)
        problem = check(value) if check else None
        if problem:
            value = model(row | {"problem": problem})
            if again := check(value):
                raise ValueError(f"two replies that don't fit: {again}")
        return value

    def one(row: dict) -> tuple:
        try:
            return asked(model, row), None, False
        except (TimeoutError, ConnectionError) as e:
            if fallback is None:
                return None, f"{type(e).__name__}: {e}".split("\n")[0], False
            try:
                return asked(fallback, row), None, True
            except Exception as second:  # noqa: BLE001  a row's failure is data
                return None, f"{type(second).__name__}: {second}".split("\n")[0], True
        except Exception as e:  # noqa: BLE001  a row's failure is data
            return None, f"{type(e).__name__}: {e}".split("\n")[0], False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = fan_out(lambda row: (row[key], *one(row)), (row for frame in frames for row in frame.to_dict("records")), workers, per_second)
        while block := list(islice(made, 1024)):
            yield pd.DataFrame(block, columns=[key, "value", "error", "fallback"])

    return rows.select(key, *columns).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, value string, error string, fallback boolean")


def extractive_answer(row: dict) -> str:
    """A stand-in for a chat model: of the passage's ``sentences``, the first that shares most words with the question."""
    asked = set(re.findall(r"\w+", (row["question"] or "").lower()))
    best = max(row["sentences"], key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default="")
    if not best:
        raise ValueError("no passage to answer from")
    return best


def answer_sentences(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_no (from 1), sentence; null and blank texts have none."""
    cut = rows.select(key, F.posexplode(whole_sentences(F.col(text))).alias("at", "sentence"))
    return cut.select(key, (F.col("at") + 1).alias("sentence_no"), "sentence")


# ------------------------------------------------------------------ agent loop

ToolCall = tuple[str, dict]


def agent_answers(rows: DataFrame, turn: Callable[[dict, list[dict], bool], tuple[list[ToolCall], str | None]], tools: dict[str, Callable[[dict], str]], key: str = "qid", columns: tuple[str, ...] = ("question",), most_turns: int = 4, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """key, answer, turns, calls, error: a loop of model turns and tool calls for each question.

    ``turn(row, results, forced)`` returns tool calls, an answer, or both. A tool's error is its
    result. An answer beside tool calls came before their results and is sent back. After
    ``most_turns`` turns of tools the answer is forced, and calls beside it are not run; no
    answer then is an error. ``check`` says what is wrong with an answer: one correction is
    asked for, and a second wrong answer is an error. What is sent back stands among the
    results as ``answer``.
    """
    ship_package(rows.sparkSession)
    call = "struct<name:string,output:string,error:string>"

    def one(row: dict) -> tuple:
        results: list[dict] = []
        turns = tool_turns = 0
        correcting = False

        def sent_back(why: str) -> None:
            results.append({"name": "answer", "output": None, "error": why})

        while True:
            forced, turns = correcting or tool_turns >= most_turns, turns + 1
            try:
                wanted, answer = turn(row, results, forced)
            except Exception as e:  # noqa: BLE001  a question's failure is data
                return None, turns, results, f"{type(e).__name__}: {e}"
            if forced or not wanted:
                if answer is None:
                    return None, turns, results, "no answer when one was asked for"
                problem = check(answer) if check else None
                if problem is None:
                    return answer, turns, results, None
                if correcting:
                    return None, turns, results, f"two answers that don't fit: {problem}"
                correcting = True
                sent_back(problem)
                continue
            tool_turns += 1
            if answer is not None:
                sent_back("answered before the results of its tool calls")
            for name, arguments in wanted:
                try:
                    results.append({"name": name, "output": tools[name](arguments), "error": None})
                except KeyError:
                    results.append({"name": name, "output": None, "error": f"no such tool: {name}"})
                except ValueError as e:
                    results.append({"name": name, "output": None, "error": str(e)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(row[key], *one(row)) for row in frame.to_dict("records")]
            yield pd.DataFrame(made, columns=[key, "answer", "turns", "calls", "error"])

    return rows.select(key, *columns).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, answer string, turns int, calls array<{call}>, error string")
