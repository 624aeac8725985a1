"""Calls as rows: their number, the tree of merges, slices that survive a killed task, and the limit of requests."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from vellumlake.operators.analysis import LocalProvider, ModelError
from vellumlake.plans import calls

SCHEMA = "source_system string, external_book_id string, chapter_index int, input_fingerprint string, title string, content string"


def asked(path, kill=None):
    """Makes providers; a class within a function goes to workers as it is."""

    class Asked(LocalProvider):
        """Keeps a line for each request: the time, the worker's process, and what it says of itself."""

        def __init__(self, path, kill=None):
            self.path, self.kill = path, kill

        def generate(self, system, user):
            with open(self.path, "a") as f:
                f.write(json.dumps([time.time(), os.getpid(), user]) + "\n")
            if self.kill and self.kill in user and not os.path.exists(self.path + ".killed"):
                open(self.path + ".killed", "w").close()
                os._exit(1)
            if "never" in user:
                raise ModelError("MODEL_AUTH_FAILED")
            got = json.loads(user)
            if "partial_results" in got:
                return {"core_idea": got["title"] or "-", "key_takeaways": [t for p in got["partial_results"] for t in p["key_takeaways"]]}
            return {"core_idea": "x", "key_takeaways": [got["content"][:4]]}

    return lambda: Asked(path, kill)


def said(path):
    return [json.loads(x) for x in open(path)]


def chapter(i, content, title="T"):
    return ("s", "b", i, f"f{i}", title, content)


def test_tree_of_merges(spark, tmp_path):
    path = str(tmp_path / "asked")
    long = "".join(f"{k:03d} " * 5 for k in range(23))  # 23 chunks of 20 characters
    rows = [chapter(0, long), chapter(1, "short"), chapter(2, ""), chapter(3, long.replace("007", "never"), None), chapter(1, "short")]
    log = calls.CallLog(spark, str(tmp_path / "log"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.chapter_index: r for r in calls.analyses(df, asked(path), log, most=20, fan_in=4, lanes=3, each=5).collect()}
    assert got[0].analysis.key_takeaways == [f"{k:03d} " for k in range(23)] and got[0].analysis.core_idea == "T"
    assert got[1].analysis.key_takeaways == ["shor"] and got[2].analysis.key_takeaways == [""]
    assert got[3].analysis is None and got[3].error.code == "MODEL_AUTH_FAILED" and len(got) == 4
    seen = said(path)
    merges = [json.loads(u)["partial_results"] for _, _, u in seen if "partial_results" in u]
    assert sorted(map(len, merges)) == [2, 2, 3, 4, 4, 4, 4, 4, 4]  # 23 to 6 to 2 to 1
    own, other = calls.chunks(df.where("chapter_index = 0"), "content", 20).count(), calls.chunks(df.where("chapter_index = 3"), "content", 20).count()
    assert own == 23 and len(seen) == own + other + 2 + len(merges)
    # nothing is asked twice
    again = calls.analyses(df, asked(path), log, most=20, fan_in=4).collect()
    assert len(again) == 4 and len(said(path)) == len(seen)
    assert calls.analyses(df.limit(0), asked(path), log).count() == 0


def test_a_killed_task_costs_its_slice(spark, tmp_path):
    path = str(tmp_path / "asked")
    queue = spark.range(60).select(F.concat(F.lit("c"), "id").alias("call"), F.lit("whole").alias("kind"), F.concat(F.lit('{"title":"t","content":"<'), "id", F.lit('>"}')).alias("user"))
    log = calls.CallLog(spark, str(tmp_path / "log"))
    with pytest.raises(Exception):  # noqa: B017 a local master runs no task again
        calls.ask_all(queue, asked(path, "<40>"), log, lanes=2, each=5)
    assert 0 < log.answers().count() < 60
    calls.ask_all(queue, asked(path, "<40>"), log, lanes=2, each=5)
    assert log.answers().where("result is not null").count() == 60 and log.read().count() == 60
    times = {}
    for _, _, user in said(path):
        times[user] = times.get(user, 0) + 1
    twice = [u for u, n in times.items() if n > 1]
    assert len(times) == 60 and 1 <= len(twice) <= 10 and max(times.values()) == 2  # of one slice
    assert log.read().groupBy("slice").count().agg(F.max("count")).first()[0] == 10


def test_a_task_that_is_run_again_asks_nothing(spark, tmp_path, monkeypatch):
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", lambda: type("Context", (), {"attemptNumber": lambda self: 1})())
    task = calls._asking(asked(str(tmp_path / "asked")), 0.0, {}, 0)
    assert list(task(iter([]))) == [] and not (tmp_path / "asked").exists()


@pytest.mark.parametrize("kill", [None, "<9>"])
def test_no_window_holds_more_requests_than_it_may(spark, tmp_path, kill):
    path, window, most = str(tmp_path / "asked"), 4.0, 8
    queue = spark.range(26).select(F.concat(F.lit("c"), "id").alias("call"), F.lit("whole").alias("kind"), F.concat(F.lit('{"title":"t","content":"<'), "id", F.lit('>"}')).alias("user"))
    log = calls.CallLog(spark, str(tmp_path / "log"))
    limits = {"lanes": 3, "per_window": most, "each": 3, "window": window}
    if kill:
        with pytest.raises(Exception):  # noqa: B017
            calls.ask_all(queue.where("id < 20"), asked(path, kill), log, **limits)
        log = calls.CallLog(spark, log.path)
    calls.ask_all(queue.where("id < 20"), asked(path, kill), log, **limits)
    calls.ask_all(queue, asked(path, kill), calls.CallLog(spark, log.path), **limits)  # another run goes on
    at = sorted(t for t, _, _ in said(path))
    assert len(at) >= 26 and log.answers().count() == 26
    for i, t in enumerate(at):
        # the provider notes its time a little after the lane let it through
        assert sum(t - window + 0.25 < x <= t for x in at[: i + 1]) <= most


def test_pace():
    now, slept = [100.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = calls.Pace(3.0, 105.0, lambda: now[0], sleep)
    at = []
    for took in (0, 10, 0):
        pace.wait()
        at.append(now[0])
        now[0] += took
    assert at == [105.0, 108.0, 118.0] and pace.requests == 3
