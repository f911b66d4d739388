"""Calls made once: lost tasks, stopped passes, failures, order and rate."""

import os
import threading
import time

import pytest

from gleanworks.operators import judging, ledger, models


def asked_of(path):
    return [line for name in sorted(os.listdir(path)) for line in open(f"{path}/{name}").read().splitlines()]


def recording(folder, fail=(), die=None):
    """A model that writes down what it is asked; it fails for some questions, and kills its worker once for one."""

    def model(row):
        question = row["question"]
        if question == die and not os.path.exists(f"{folder}-died"):
            open(f"{folder}-died", "w").close()
            os._exit(1)
        with open(f"{folder}/{os.getpid()}", "a") as out:
            out.write(f"{question}\n")
        if question in fail:
            raise ValueError("no reply\nand more")
        return f"answer to {question}"

    return model


def test_a_lost_task_asks_nothing_twice(spark, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    rows = spark.createDataFrame([(i, f"q{i % 30}") for i in range(40)] + [(99, None)], "qid int, question string")
    path, model = str(tmp_path / "ledger"), recording(folder, fail={"q3"}, die="q11")
    with pytest.raises(Exception, match="crashed|EOF|exit"):
        ledger.ask_once(rows, model, path, "judge 1", ["question"])
    before = asked_of(folder)
    made = {r.qid: (r.value, r.error) for r in ledger.ask_once(rows, model, path, "judge 1", ["question"], workers=3).collect()}
    after = asked_of(folder)
    assert sorted(x for x in after if x != "q3") == sorted({f"q{i}" for i in range(30) if i != 3} | {"None"}) and len(before) < len(after)
    assert made == {i: ((f"answer to q{i % 30}", None) if i % 30 != 3 else (None, "ValueError: no reply")) for i in range(40)} | {99: ("answer to None", None)}
    # the next pass asks only what failed; another scorer asks anew
    again = ledger.ask_once(rows, recording(folder), path, "judge 1", ["question"])
    assert {r.qid: r.value for r in again.collect() if r.qid == 3} == {3: "answer to q3"} and len(asked_of(folder)) == len(after) + 1
    other = judging.scoring_pass(rows.where("qid < 2"), recording(folder), path, {"judge": "2"}, ["question"])
    assert other.count() == 2 and len(asked_of(folder)) == len(after) + 3
    assert ledger.responses(spark, path).where("error is not null").count() == 0
    assert ledger.ask_once(rows.where("false"), model, path, "judge 1", ["question"]).count() == 0


def test_speculation_is_refused(spark, tmp_path, monkeypatch):
    conf = spark.sparkContext.getConf().set("spark.speculation", "true")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: conf)
    with pytest.raises(ValueError, match="peculat"):
        ledger.ask_once(spark.range(1).selectExpr("cast(id as string) question"), str, str(tmp_path), "x", ["question"])


def test_fan_out_keeps_order_bounds_what_is_under_way_and_is_faster():
    under_way, most, lock = 0, 0, threading.Lock()

    def slow(x):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.02 * (1 + x % 3))
        with lock:
            under_way -= 1
        return x * x

    began = time.monotonic()
    assert list(ledger.fan_out(slow, range(40), workers=8)) == [x * x for x in range(40)]
    assert time.monotonic() - began < 0.8 and 1 < most <= 8  # one by one it takes 1.6 s
    taken = []
    first = next(ledger.fan_out(lambda x: x, (taken.append(i) or i for i in range(1000)), workers=2))
    assert first == 0 and len(taken) <= 6
    with pytest.raises(ZeroDivisionError):
        list(ledger.fan_out(lambda x: 1 // x, [1, 0, 2], workers=2))


def test_the_rate_holds_for_all_workers():
    began = time.monotonic()
    assert list(ledger.fan_out(lambda x: x, range(9), workers=4, per_second=40)) == list(range(9))
    assert time.monotonic() - began >= 8 / 40 - 0.01


def test_concurrent_models_give_the_same_rows(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "doc_id int, text string")
    one, many = (sorted(map(tuple, models.embed(rows, models.hash_embedder(8), batch=4, workers=w).collect())) for w in (1, 5))
    assert one == many and len(one) == 70
    ask = lambda w: sorted(map(tuple, models.call_model(rows, lambda row: row["text"].upper(), "doc_id", ["text"], workers=w).collect()))
    assert ask(1) == ask(4)
