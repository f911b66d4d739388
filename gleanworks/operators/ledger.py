"""Paid calls made once: a ledger of responses in a shared folder.

A request is named by a hash of what is asked and of whom. A task saves every response under
that name before anything uses it, and looks up what is saved before it asks. So a task that
is lost and run again, or a pass that is stopped and started again, asks only what has no response
yet. What a pass returns is read from the ledger, never from the tasks.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.session import ship_package

#: Folders of a ledger: one task asks the requests of a folder, and reads no other's responses.
BUCKETS = 256
RESPONSES = "request_id string, value string, error string, saved double"


def request_id(name: str, columns: list[str]) -> Column:
    """The name of a request: the same for equal columns asked of the same ``name`` (a model with its prompt and version)."""
    return F.sha2(F.concat(F.lit(f"{name}\n"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256)


class Pace:
    """At most so many calls a second, whoever waits."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = (1.0 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(self.next, time.monotonic())
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def fan_out(call: Callable, rows: Iterable, workers: int = 1, per_second: float | None = None, ahead: int | None = None) -> Iterator:
    """``call`` of each row, ``workers`` at a time, in the order of the rows.

    No more than ``ahead`` rows (twice the workers) are taken before results are: a long input is not held.
    The rate is that of one task. An exception is raised where its row's result would stand.
    """
    pace = Pace(per_second)

    def paced(row):
        pace.wait()
        return call(row)

    rows, held = iter(rows), []
    if workers <= 1:
        yield from map(paced, rows)
        return
    with ThreadPoolExecutor(workers) as pool:
        try:
            for row in islice(rows, ahead or 2 * workers):
                held.append(pool.submit(paced, row))
            while held:
                done = held.pop(0).result()
                held += [pool.submit(paced, row) for row in islice(rows, 1)]
                yield done
        finally:
            for waiting in held:
                waiting.cancel()


class Folder:
    """The saved responses of one bucket."""

    def __init__(self, root: str, bucket: int):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(root)
        self.path, self.selector = f"{path.rstrip('/')}/bucket={bucket}", fs.FileSelector
        self.files.create_dir(self.path, recursive=True)

    def answered(self) -> set[str]:
        """The ids of requests that have a response; a failure is none."""
        out: set[str] = set()
        for info in self.files.get_file_info(self.selector(self.path)):
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as stream:
                    lines = [json.loads(line) for line in stream.read().decode().splitlines()]
                out.update(line["request_id"] for line in lines if line["error"] is None)
        return out

    def save(self, lines: list[dict]) -> None:
        """A file that is whole as soon as it has its name."""
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.path}/.{name}") as stream:
            stream.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        self.files.move(f"{self.path}/.{name}", f"{self.path}/{name}.json")


def responses(spark: SparkSession, ledger: str) -> DataFrame:
    """request_id, value, error, saved, times: the response of every request, or its last failure where it has none."""
    saved = spark.read.schema(RESPONSES).json(f"{ledger}/bucket=*/*.json") if _any(spark, ledger) else spark.createDataFrame([], RESPONSES)
    order = F.struct(F.col("error").isNull(), "saved")
    return saved.groupBy("request_id").agg(F.max_by(F.struct("value", "error", "saved"), order).alias("r"), F.count("*").alias("times")).select("request_id", "r.*", "times")


def _any(spark: SparkSession, ledger: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{ledger}/bucket=*/*.json")
    return len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []) > 0


def ask_once(rows: DataFrame, model: Callable[[dict], str], ledger: str, name: str, columns: list[str], workers: int = 1, per_second: float | None = None, saved_together: int = 1) -> DataFrame:
    """``rows`` with value and error: each different request is asked once, over all passes with this ledger.

    ``ledger`` is a folder that driver and executors share, by a path that pyarrow opens (file, HDFS, S3,
    GCS); it outlives the session. A task saves ``saved_together`` responses at a time, each
    time before it asks on, so that a lost task asks no more than that again. A failure is saved, too, as the
    row's error; the next pass asks it anew. Equal rows are one request; nulls are values.
    Runs at once. Speculative tasks would ask twice, so a session with them is refused.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks ask twice: set spark.speculation to false")
    ship_package(spark)
    named = rows.withColumn("request_id", request_id(name, columns))
    asked = named.select("request_id", *columns).dropDuplicates(["request_id"]).join(responses(spark, ledger).where("error is null").select("request_id"), "request_id", "left_anti")
    dealt = asked.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(BUCKETS)).cast("int"))

    def one(row: dict) -> dict:
        try:
            value, error = model({c: row[c] for c in columns}), None
        except Exception as e:  # noqa: BLE001  a request's failure is data
            value, error = None, f"{type(e).__name__}: {e}".split("\n")[0]
        return {"request_id": row["request_id"], "value": value, "error": error, "saved": time.time()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending = (row for frame in frames for row in frame.astype(object).where(frame.notna(), None).to_dict("records"))
        for bucket, own in groupby(pending, key=lambda row: row["bucket"]):
            folder = Folder(ledger, bucket)
            known = folder.answered()  # by a task that was lost
            made = fan_out(one, (row for row in own if row["request_id"] not in known), workers, per_second, ahead=max(workers, saved_together))
            n = 0
            while lines := list(islice(made, saved_together)):
                folder.save(lines)
                n += len(lines)
            yield pd.DataFrame({"bucket": [bucket], "n": [n]})

    dealt.repartition("bucket").sortWithinPartitions("bucket", "request_id").mapInPandas(run, "bucket int, n long").agg(F.sum("n")).collect()
    return named.join(responses(spark, ledger).select("request_id", "value", "error"), "request_id", "left").drop("request_id")
