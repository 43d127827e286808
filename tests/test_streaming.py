"""Streamed aggregates end with the rows that a batch over the same files gives; budgets are kept in keyed state."""

import collections
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulelens.functions.lineage import new_folder
from rulelens.streaming import budget as B, scoring as SS

FEATURES, EDGES = ["qty"], {"qty": [2.0, 5.0]}


def test_updates_equal_the_batch(spark):
    folder = new_folder(spark, "stream-test")
    days = [1, 2, 31, 32, 33, 200]
    rows = spark.createDataFrame([(d, None if d == 2 else float(d % 7)) for d in days], "d int, qty double").select(F.timestamp_seconds(F.col("d") * 86400).alias("ts"), "qty")
    for i in range(3):  # in event-time order, so that no row is late
        rows.orderBy("ts").offset(2 * i).limit(2).coalesce(1).write.mode("append").parquet(folder)
    stream = SS.open_stream(spark, folder, files_per_trigger=1)
    found = SS.run_updates(SS.windowed_bins(stream, "ts", FEATURES, EDGES, "30 days", "1000 days"), ["window_start", "feature", "bin"], "t")
    place = F.when(F.col("qty") > 5, 2).when(F.col("qty") > 2, 1).otherwise(0)
    want = rows.filter("qty IS NOT NULL").groupBy(F.window("ts", "30 days")["start"].alias("window_start"), F.lit("qty").alias("feature"), place.alias("bin")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_without_rows_gives_none(spark):
    folder = new_folder(spark, "stream-empty")
    spark.createDataFrame([], "ts timestamp, qty double").write.parquet(folder)
    stream = SS.open_stream(spark, folder)
    assert SS.run_updates(SS.windowed_bins(stream, "ts", FEATURES, EDGES, "30 days", "1 day"), ["window_start", "feature", "bin"], "t").count() == 0


BUDGET = 7


@pytest.fixture(scope="module")
def asked():
    """20 batches of questions: entity 1 asks a third of all, many are repeated, some parts are missing."""
    rng = np.random.default_rng(3)
    return [[(1 if rng.random() < 0.33 else None if rng.random() < 0.1 else int(rng.integers(2, 9)), str(rng.choice(["a", "b", "c"])), None if rng.random() < 0.1 else int(rng.integers(6))) for _ in range(30)] for _ in range(20)]


def append(spark, folder, batches):
    for rows in batches:  # one file a batch, oldest first
        spark.createDataFrame(rows, "e long, kind string, n int").coalesce(1).write.mode("append").parquet(folder)


def decided(batches, budget):
    """The same decisions by one loop over the batches."""
    seen, spent, out = set(), collections.Counter(), {}
    for rows in batches:
        new = collections.defaultdict(set)
        for e, kind, n in rows:
            if (e, kind, n) not in seen:
                new[e].add((kind, n))
        for e, questions in new.items():
            for q in sorted(questions, key=lambda q: B._rank(json.dumps(dict(zip(("kind", "n"), q)), separators=(",", ":")))):
                out[e, *q] = spent[e] < budget
                spent[e] += spent[e] < budget
                seen.add((e, *q))
    return out


def run(spark, source, folder):
    stream = SS.open_stream(spark, source, files_per_trigger=1)
    return {(r["e"], r["kind"], r["n"]): r["granted"] for r in B.budgeted_queries(stream, "e", ["kind", "n"], BUDGET, folder=folder, shards=3).collect()}


def test_budgets_over_twenty_batches_and_a_restart(spark, asked):
    source, folder = new_folder(spark, "questions"), new_folder(spark, "budget-test")
    before = spark.conf.get(B.PROVIDER, None)
    append(spark, source, asked[:12])
    assert run(spark, source, folder) == decided(asked[:12], BUDGET)
    append(spark, source, asked[12:])
    assert run(spark, source, folder) == decided(asked, BUDGET)  # goes on from the state, batch by batch
    assert len(os.listdir(f"{folder}/state/commits")) >= 20 and sorted(os.listdir(folder)) == ["out", "state"]  # no ledger anywhere
    assert run(spark, source, folder) == decided(asked, BUDGET) and spark.conf.get(B.PROVIDER, None) == before  # nothing new, nothing more


def test_a_batch_reads_its_own_rows_only(spark, asked):
    source, folder = new_folder(spark, "questions"), new_folder(spark, "budget-progress")
    append(spark, source, asked[:4])
    with B.keyed_state(spark):
        stream = B.budgeted(SS.open_stream(spark, source, files_per_trigger=1), "e", ["kind", "n"], BUDGET, shards=3)
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [30] * 4 and all(len(p["stateOperators"]) == 2 for p in batches)


class Cell:
    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    clear = lambda self: self.update(None)

    def update(self, value):
        self.value = value


class Book(dict):
    containsKey = dict.__contains__
    updateValue = dict.__setitem__


class Handle:
    def __init__(self):
        self.timers, self.ttl = [], {}

    def getMapState(self, name, key, value, ttl=None):
        self.ttl[name] = ttl
        return Book()

    def getValueState(self, name, kind, ttl=None):
        self.ttl[name] = ttl
        return Cell()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_budgets_renew_by_timer_and_questions_expire():
    handle = Handle()
    step = B.Granted(2, 1000)
    step.init(handle)
    ask = lambda texts, now: pd.concat(list(step.handleInputRows(("5", 0), iter([pd.DataFrame({"entity": "5", "question": texts})]), Clock(now))))["granted"].tolist()
    assert ask(["a", "b", "c"], 50) == [True, True, False] and ask(["d"], 60) == [False] and handle.timers == [1050]
    assert list(step.handleExpiredTimer(("5", 0), Clock(1050), None)) == []
    assert ask(["e"], 1100) == [True] and handle.timers == [1050, 2100]
    assert list(step.handleInputRows(("5", 3), iter([pd.DataFrame({"entity": ["5"], "question": ["a"]})]), Clock(0)))[0]["granted"].tolist() == [False]

    first = B.Asked(2, 60_000)
    first.init(handle)
    assert handle.ttl == {"spent": None, "seen": 60_000, "sent": 60_000}
    send = lambda *parts: pd.concat(list(first.handleInputRows(("5", 1), iter([pd.DataFrame({"question": p}) for p in parts]), Clock(0))))
    out = send(["a", "b", "b"], ["c", "d", "a"])
    assert sorted(out["question"]) == list("abcd") and sorted(out["slot"]) == [0, 0, 2, 2]  # the budget could grant two of the four
    assert sorted(out[out["slot"] == 0]["question"]) == sorted(sorted("abcd", key=B._rank)[:2])
    assert send(["a", "z"]).values.tolist() == [["5", "z", 2]]


def test_questions_that_never_expire_are_known_to_spark(spark, asked, monkeypatch):
    """Without a time to forget no question costs a call from Python, and the decisions are the same."""
    def never(*_):
        raise AssertionError("a map in Python")

    monkeypatch.setattr(B, "Asked", never)
    monkeypatch.setattr(B, "PENDING", 1)
    source, folder = new_folder(spark, "questions"), new_folder(spark, "budget-spark")
    append(spark, source, asked[:5])
    assert run(spark, source, folder) == decided(asked[:5], BUDGET)


def test_first_questions_of_each_entity_with_equal_hashes():
    rows = pd.DataFrame({"entity": list("aabab"), "question": list("zxyyw"), "code": [1, 1, 7, 1, 2], "slot": [4, 5, 6, 7, 8]})
    out = pd.concat(list(B._first_of_each(2)(iter([rows[:2], rows[2:]]))))
    assert sorted(map(tuple, out.values.tolist())) == [("a", "x", 0), ("a", "y", 0), ("a", "z", 4), ("b", "w", 0), ("b", "y", 0)]
