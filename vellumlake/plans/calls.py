"""Model calls as rows of a log: one row a call, committed a slice at a time, paced over tasks, retries and runs.

A queue of calls is numbered and cut into slices. A slice is one job, which appends its answers to the log as it commits; so
what a lost executor or a killed driver costs is the open slice's calls at most, and a run that starts again asks only for
calls that the log lacks.

The limit of requests is divided among lanes. A call has a lane, and a lane's requests are at least so far apart that all
lanes together keep the limit in any window. Where a lane may go on is handed from slice to slice by the log's times. A task
that Spark runs again asks nothing, as nobody knows what its first attempt asked: its calls stay open, and the next slice
waits until whatever was asked has left the window.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions.numbering import checkpointed, numbered
from vellumlake.operators.analysis import ERRORS, PROMPTS, ModelError, Provider, ask, complete
from vellumlake.operators.analysis import SCHEMA as RESULT
from vellumlake.operators.chunking import chunks
from vellumlake.operators.library import KEY, with_cache

#: The log: call, its slice and lane, when its last request went out (seconds), its requests, and the answer or an error.
LOG = "call string, slice long, lane int, asked double, requests int, result string, code string, retryable boolean"
#: Calls of a lane in one slice, with a limit of requests and without one; how often a call may be left open before it counts as
#: failed.
EACH, EACH_FREE, ATTEMPTS = 8, 512, 3
#: Partial results in one merge.
FAN_IN = 64


class Pace:
    """Lets requests of one lane through, `spacing` seconds apart and none before `free`."""

    def __init__(self, spacing: float, free: float = 0.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.spacing, self.free, self.clock, self.sleep = spacing, free, clock, sleep
        self.last, self.requests = 0.0, 0

    def wait(self) -> None:
        while (now := self.clock()) < self.free:
            self.sleep(self.free - now)
        self.last, self.free, self.requests = now, now + self.spacing, self.requests + 1


class Paced:
    """A provider whose requests, repeated ones too, wait for a lane."""

    def __init__(self, provider: Provider, pace: Pace):
        self.provider, self.pace = provider, pace

    def generate(self, system: str, user: str) -> Any:
        self.pace.wait()
        return self.provider.generate(system, user)


class CallLog:
    """The answers at path, an append-only table of Parquet files that one driver writes; and where its lanes may go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.free: dict[int, float] | None = None
        self.number = 0

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path)

    def answers(self) -> DataFrame:
        """One row a call; an answer before an error, the first before later ones."""
        return self.read().groupBy("call").agg(F.min_by(F.struct("result", "code", "retryable"), F.struct(F.col("result").isNull(), "asked")).alias("r")).select("call", "r.*")


def ask_all(
    queue: DataFrame, make: Callable[[], Provider], log: CallLog, lanes: int = 8, per_window: int | None = None, each: int | None = None, window: float = 60.0, again: bool = False
) -> None:
    """Asks for every call of queue (call, kind, user; kind names the prompt) that the log has no answer to; again: also for those whose error may go by.

    per_window: requests that all lanes together may make in any `window` seconds (None: no limit); there are at most as many
    lanes. The same call twice in the queue is asked once. A slice has `each` calls a lane.
    """
    spark = log.spark
    if per_window is not None:
        lanes = max(1, min(lanes, per_window))
    spacing = window / (per_window // lanes) if per_window is not None else 0.0
    each = each or (EACH_FREE if per_window is None else EACH)
    if log.free is None or set(log.free) != set(range(lanes)):
        # whoever wrote before may have asked, until now, what isn't logged
        last = log.read().agg(F.max("asked").alias("asked"), F.max("slice").alias("slice")).first()
        wait = per_window is not None and last.asked is not None
        log.free, log.number = dict.fromkeys(range(lanes), time.time() + window if wait else 0.0), max(log.number, (last.slice or 0) + 1)
    known = log.answers()
    open_ = queue.select("call", "kind", "user").dropDuplicates(["call"]).join(known.where("result is not null or not retryable") if again else known, "call", "left_anti")
    open_ = checkpointed(open_)
    todo = checkpointed(open_.join(numbered(open_.select("call"), [], ["call"], "n"), "call"))
    total, at, size, tries = todo.count(), 0, lanes * each, {}
    while at < total or tries:
        if tries:  # what the slice before left open, at most its size
            batch = todo.join(F.broadcast(spark.createDataFrame([(c,) for c in tries], "call string")), "call", "left_semi")
        else:
            batch, at = todo.where((F.col("n") >= at) & (F.col("n") < at + size)), at + size
        dealt = batch.withColumn("lane", F.pmod("n", F.lit(lanes)).cast("int")).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "n")
        dealt = checkpointed(dealt)  # so that the calls' stage reads files and is never run again for a lost shuffle
        dealt.mapInPandas(_asking(make, spacing, dict(log.free), log.number), LOG).write.mode("append").parquet(log.path)
        done = log.read().where(F.col("slice") == log.number)
        missing = [r.call for r in dealt.join(done, "call", "left_anti").select("call").collect()]  # at most a slice
        if missing and per_window is not None:
            log.free = dict.fromkeys(range(lanes), time.time() + window)
        else:
            log.free |= {r.lane: r.asked + spacing for r in done.groupBy("lane").agg(F.max("asked").alias("asked")).collect()}  # a row a lane
        log.number += 1
        tries = {c: tries.get(c, 0) + 1 for c in missing}
        lost = [(c, log.number, 0, time.time(), 0, None, "MODEL_UNAVAILABLE", True) for c, n in tries.items() if n >= ATTEMPTS]
        if lost:
            spark.createDataFrame(lost, LOG).write.mode("append").parquet(log.path)
            log.number += 1
            tries = {c: n for c, n in tries.items() if n < ATTEMPTS}


def _asking(make: Callable[[], Provider], spacing: float, free: dict[int, float], number: int):
    """The task of lanes: one answer a row, put out as it comes."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        if TaskContext.get().attemptNumber() > 0:
            for _ in batches:
                pass
            return
        provider, paces = make(), {}
        columns = [f.split()[0] for f in LOG.split(", ")]
        for df in batches:
            for call, kind, user, lane in zip(df["call"], df["kind"], df["user"], df["lane"], strict=True):
                pace = paces.setdefault(lane, Pace(spacing, free.get(lane, 0.0)))
                before = pace.requests
                try:
                    row = (json.dumps(ask(Paced(provider, pace), PROMPTS[kind], user), ensure_ascii=False), None, None)
                except ModelError as e:
                    row = (None, e.code, e.retryable)
                yield pd.DataFrame([(call, number, lane, pace.last, pace.requests - before, *row)], columns=columns).astype({"lane": "int32", "requests": "int32", "retryable": "boolean"})

    return run


def call_id(level: int, number, user):
    """A call's name: what it asks, and its place in the tree."""
    return F.sha2(F.concat_ws("\n", F.lit(str(level)), number.cast("string"), user), 256)


def first_calls(chapters: DataFrame, most: int = 24_000) -> DataFrame:
    """chapters (KEY, input_fingerprint, title, content) in a row for each chunk: number (from 0), count, call and user. A
    chapter of one chunk is asked for as a whole."""
    own = chapters.select(*KEY, "input_fingerprint", "title", "content")
    parts = chunks(own, "content", most)
    empty = own.where("content = ''").select(*KEY, "input_fingerprint", "title", F.lit(1).alias("count"), F.lit(1).alias("number"), F.lit("").alias("chunk"))
    parts = parts.unionByName(empty)
    whole = F.to_json(F.struct(F.col("chunk").alias("content"), "title"))
    part = F.to_json(F.struct(F.col("number").alias("chunk"), F.col("count").alias("chunks"), F.col("chunk").alias("content")))
    kind = F.when(F.col("count") == 1, "whole").otherwise("chunk").alias("kind")
    parts = parts.withColumn("user", F.when(F.col("count") == 1, whole).otherwise(part)).withColumn("number", F.col("number") - 1)
    return parts.select(*KEY, "input_fingerprint", "title", "number", "count", call_id(0, F.col("number"), F.col("user")).alias("call"), kind, "user")


def merge_calls(parts: DataFrame, level: int, fan_in: int = FAN_IN) -> DataFrame:
    """Of partial results (KEY, input_fingerprint, title, number, count, result) the calls that merge them, up to fan_in in the
    order of their numbers; number and count are those of the merges."""
    groups = parts.groupBy(*KEY, "input_fingerprint", "title", F.floor(F.col("number") / fan_in).cast("int").alias("number"), F.ceil(F.col("count") / fan_in).cast("int").alias("count"))
    held = groups.agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("k"), "result"))).alias("parts"))  # at most fan_in
    results = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda x: x["result"]), ","), F.lit("]"))
    user = F.concat(F.lit('{"partial_results":'), results, F.lit(',"title":'), F.substring_index(F.to_json(F.struct("title")), '{"title":', -1))
    out = held.withColumn("user", F.when(F.col("title").isNull(), F.concat(F.lit('{"partial_results":'), results, F.lit("}"))).otherwise(user))
    return out.select(*KEY, "input_fingerprint", "title", "number", "count", call_id(level, F.col("number"), F.col("user")).alias("call"), F.lit("merge").alias("kind"), "user")


def analyses(
    misses: DataFrame, make: Callable[[], Provider], log: CallLog, most: int = 24_000, fan_in: int = FAN_IN, lanes: int = 8, per_window: int | None = None, window: float = 60.0, each: int | None = None
) -> DataFrame:
    """misses (KEY, input_fingerprint, title, content) with analysis, and error (code, message, retryable) where it failed.

    A call a chunk, then rounds of merges until a chapter has one result. A chapter that occurs twice is asked for once; one of
    whose calls fails has the error of the first that did, and isn't merged. Errors that may go by are asked for again, all else
    is taken from the log.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    own = misses.dropDuplicates([*KEY, "input_fingerprint"])
    calls, done, level = checkpointed(first_calls(own, most)), None, 0
    while True:
        ask_all(calls, make, log, lanes, per_window, each, window, again=True)
        found = checkpointed(calls.drop("user", "kind").join(log.answers(), "call", "left"))
        failed = found.where("code is not null").groupBy(*KEY, "input_fingerprint").agg(F.min_by(F.struct("code", "retryable"), "number").alias("e"))
        ended = found.where("count = 1 and result is not null").select(*KEY, "input_fingerprint", "result", F.lit(None).cast("struct<code:string,retryable:boolean>").alias("e"))
        ended = ended.unionByName(failed.select(*KEY, "input_fingerprint", F.lit(None).cast("string").alias("result"), "e"))
        done = ended if done is None else done.unionByName(ended)
        rest = found.where("count > 1").join(failed, [*KEY, "input_fingerprint"], "left_anti")
        level += 1
        calls = checkpointed(merge_calls(rest, level, fan_in))
        if calls.isEmpty():
            break
    message = F.lit(None).cast("string")
    for code, (text, _) in ERRORS.items():
        message = F.when(F.col("e.code") == code, text).otherwise(message)
    error = F.when(F.col("e").isNotNull(), F.struct(F.col("e.code"), message.alias("message"), F.col("e.retryable")))
    return done.select(*KEY, "input_fingerprint", complete(F.from_json("result", RESULT)).alias("analysis"), error.alias("error"))


def analyze(snapshots: DataFrame, cache: DataFrame, make: Callable[[], Provider], log: CallLog, force: bool = False, **limits) -> tuple[DataFrame, DataFrame]:
    """(hits, generated): cached analyses, and new ones for the rest. force asks for all of them anew; give it a log of its own."""
    joined = with_cache(snapshots, cache)
    hits = joined.where("false") if force else joined.where("cache_hit")
    misses = joined if force else joined.where("not cache_hit")
    return hits, analyses(misses.drop("analysis", "cache_hit"), make, log, **limits)
