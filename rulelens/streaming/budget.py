"""Query budgets per entity as keyed state of a stream: what was asked before is looked up by key, never read as a whole."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rulelens.streaming.scoring import run_to_end

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 16  # parts of an entity's questions, so that a busy entity is spread over as many tasks
SLOTS = 16  # places for each shard in which questions are refused


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


AS_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _rank(question: str) -> tuple[int, str]:
    """Questions of a micro-batch are granted in the order of a hash, whatever the order of their rows."""
    return zlib.crc32(question.encode()), question


class Asked(StatefulProcessor):
    """Key (entity, shard): passes on each question once.

    The state is a map of the shard's questions, which may be forgotten after ``ttl_ms``, and the number that went on to the
    entity's budget. Once that is as large as the budget, the budget is surely spent, so later questions get a slot of their shard
    and never meet in one place. Of a batch's new questions only as many go on as the budget could still grant.
    """

    def __init__(self, budget: int, ttl_ms: int | None):
        self.budget, self.ttl_ms = budget, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "question string", "yes boolean", self.ttl_ms)
        self.sent = handle.getValueState("sent", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sent = self.sent.get()[0] if self.sent.exists() else 0
        room, held, over, met = max(0, self.budget - sent), [], [], set()
        for pdf in rows:
            for question in pdf["question"]:
                if question in met or self.seen.containsKey((question,)):
                    continue
                met.add(question)
                self.seen.updateValue((question,), (True,))
                code, text = _rank(question)
                heapq.heappush(held, (-code, _Backwards(text)))
                if len(held) > room:
                    over.append(str(heapq.heappop(held)[1]))
        if held:
            self.sent.update((sent + len(held),))
        # not a generator: the state is that of this key only until this returns
        parts = ((over, key[1] + 1), ([str(q) for _, q in held], 0))
        return iter([pd.DataFrame({"entity": key[0], "question": some, "slot": slot}) for some, slot in parts if some])

    def close(self) -> None:
        pass


class _Backwards(str):
    """Text in falling order."""

    def __lt__(self, other):
        return str.__gt__(self, other)


class Granted(StatefulProcessor):
    """Key (entity, 0): grants questions in hash order until the entity's budget is spent. Key (null, slot): refuses what is there.

    Of an entity at most budget questions of each shard or of each task of a batch reach slot 0. With ``period_ms`` a timer gives the entity its whole
    budget again that long after the first grant.
    """

    def __init__(self, budget: int, period_ms: int | None):
        self.budget, self.period_ms = budget, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] > 0:
            return (pdf[["entity", "question"]].assign(granted=False) for pdf in rows)
        questions = sorted((q for pdf in rows for q in pdf["question"]), key=_rank)
        spent = self.spent.get()[0] if self.spent.exists() else 0
        more = min(len(questions), max(0, self.budget - spent))
        if more:
            if self.period_ms and not spent:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.period_ms)
            self.spent.update((spent + more,))
        return iter([pd.DataFrame({"entity": key[0], "question": questions, "granted": [i < more for i in range(len(questions))]})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        return iter([])

    def close(self) -> None:
        pass


PENDING = 100_000  # least rows that wait before the first of each entity are taken again


def _split(rows: pd.DataFrame, budget: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Each entity's first ``budget`` rows in the order of their hash, and the others."""
    rows = rows.assign(who=pd.factorize(rows["entity"])[0]).sort_values(["who", "code"], ignore_index=True)
    if rows.duplicated(["who", "code"]).any():
        rows = rows.sort_values(["who", "code", "question"], ignore_index=True)
    first = rows.groupby("who", sort=False).cumcount() < budget
    rows = rows.drop(columns="who")
    return rows[first], rows[~first]


def _first_of_each(budget: int):
    """A task's new questions, slot 0 for the ``budget`` first of each entity; none of the others could be granted in this batch."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pending, waiting = None, [], 0
        for pdf in parts:
            pending.append(pdf)
            waiting += len(pdf)
            if waiting >= max(PENDING, 0 if held is None else len(held)):  # merged when as much is new as is held
                held, over = _split(pd.concat([held, *pending]), budget)
                pending, waiting = [], 0
                yield over[["entity", "question", "slot"]]
        if waiting:
            held, over = _split(pd.concat([held, *pending]), budget)
            yield over[["entity", "question", "slot"]]
        if held is not None:
            yield held[["entity", "question"]].assign(slot=0)

    return step


def _new_questions(text: DataFrame, budget: int, shards: int) -> DataFrame:
    """(entity, question, slot) of questions never asked before; Spark's own state holds those that were."""
    new = text.dropDuplicates(["entity", "question"])
    slot = (F.pmod(F.xxhash64("entity", "question"), F.lit(SLOTS * shards)) + 1).cast("int")  # where it is refused
    return new.select("entity", "question", F.crc32(F.encode("question", "UTF-8")).alias("code"), slot.alias("slot")).mapInPandas(_first_of_each(budget), "entity string, question string, slot int")


def budgeted(stream: DataFrame, entity: str, query: Sequence[str], budget: int, shards: int = SHARDS, ttl_ms: int | None = None, period_ms: int | None = None) -> DataFrame:
    """The stream of (entity, query columns, granted): each distinct question once, within a budget for each entity.

    Two keyed steps: what was asked before is in the state of Spark's ``dropDuplicates``, or with ``ttl_ms`` in a map in the state of
    (entity, shard of the question); what is spent is a number in the state of the entity. A micro-batch touches the state of its own questions only. ``ttl_ms``: time after which a question
    is forgotten and may be asked anew, which bounds the state; ``period_ms``: time after which a budget renews itself. A null
    entity is an entity; a null part of a question is a value. With either time the stream looks at its clock for ever, so it needs
    a trigger that does not wait for its end. Entities and questions pass the state as text, since pandas has no missing whole
    numbers.
    """
    rows, mode = stream.select(entity, *query), "ProcessingTime" if ttl_ms or period_ms else "None"
    who, what = T.StructType([rows.schema[entity]]), T.StructType([rows.schema[c] for c in query])
    text = rows.select(F.to_json(F.struct(entity), AS_TEXT).alias("entity"), F.to_json(F.struct(*query), AS_TEXT).alias("question"))
    if ttl_ms:
        first = text.withColumn("shard", F.pmod(F.xxhash64("question"), F.lit(shards)).cast("int")).groupBy("entity", "shard")
        asked = first.transformWithStateInPandas(Asked(budget, ttl_ms), "entity string, question string, slot int", "Append", mode)
    else:
        asked = _new_questions(text, budget, shards)
    keyed = asked.withColumn("who", F.when(F.col("slot") == 0, F.col("entity")))  # refused rows meet in a few places
    granted = keyed.groupBy("who", "slot").transformWithStateInPandas(Granted(budget, period_ms), "entity string, question string, granted boolean", "Append", mode)
    parsed = granted.select(F.from_json("entity", who, AS_TEXT).alias("__e"), F.from_json("question", what, AS_TEXT).alias("__q"), "granted")
    return parsed.select(F.col("__e")[entity].alias(entity), *[F.col("__q")[c].alias(c) for c in query], "granted")


def budgeted_queries(stream: DataFrame, entity: str, query: Sequence[str], budget: int, label: str = "budget", folder: str | None = None, shards: int = SHARDS) -> DataFrame:
    """What ``budgeted`` decides on all that is available; a run that names an earlier one's ``folder`` goes on from its state."""
    with keyed_state(stream.sparkSession):
        return run_to_end(budgeted(stream, entity, query, budget, shards), label, folder)
