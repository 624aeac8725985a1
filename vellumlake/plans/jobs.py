"""Whole-book jobs: start, run in steps with a checkpoint after each, pause, resume, cancel, and recovery after a crash.

The journal is one small versioned table; its driver is its only writer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.operators.library import Table

# The states of a job.
RUNNING = ("QUEUED", "RUNNING")
DONE = ("COMPLETED", "CANCELLED")
FIELDS = "job_id string, book_id string, target string, idempotency_key string, status string, control string, total int, created_at timestamp, expires_at timestamp"


class JobError(Exception):
    pass


class Jobs:
    """The journal at path: jobs, and the chapters that each has done."""

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], datetime] = datetime.now):
        self.spark, self.now = spark, now
        self.jobs, self.done = Table(spark, f"{path}/jobs"), Table(spark, f"{path}/checkpoints")
        if self.jobs.version() is None:
            self.jobs.write(spark.createDataFrame([], FIELDS))
            self.done.write(spark.createDataFrame([], "job_id string, chapter int"))
        # what ran when the process ended was interrupted
        self._put(self.jobs.read().withColumn("status", F.when(F.col("status").isin(*RUNNING), "INTERRUPTED").otherwise(F.col("status"))))

    def _put(self, df: DataFrame) -> None:
        was = self.jobs.version()
        self.jobs.write(df, owner=was)

    def get(self, job_id: str):
        row = self.jobs.read().where(F.col("job_id") == job_id).first()
        if row is None:
            raise JobError("JOB_NOT_FOUND")
        return row

    def _set(self, job_id: str, **values) -> None:
        df = self.jobs.read()
        for k, v in values.items():
            df = df.withColumn(k, F.when(F.col("job_id") == job_id, F.lit(v)).otherwise(F.col(k)))
        self._put(df)

    def start(self, book_id: str, target: str, idempotency_key: str, total: int, planned_at: datetime, ttl_minutes: int = 30) -> str:
        """A new job, or the one that has this key. Another job of the book and target that hasn't ended is a conflict; so
        is a plan that has run out."""
        jobs = self.jobs.read().where((F.col("book_id") == book_id) & (F.col("target") == target)).collect()
        for j in jobs:
            if j.idempotency_key == idempotency_key:
                if j.status not in DONE:
                    self._set(j.job_id, status="QUEUED")
                return j.job_id
        if planned_at + timedelta(minutes=ttl_minutes) <= self.now():
            raise JobError("PLAN_EXPIRED")
        if any(j.status not in DONE for j in jobs):
            raise JobError("JOB_CONFLICT")
        job_id = f"{book_id}-{target}-{idempotency_key}"
        row = self.spark.createDataFrame([(job_id, book_id, target, idempotency_key, "QUEUED", None, total, self.now(), planned_at + timedelta(minutes=ttl_minutes))], FIELDS)
        self._put(self.jobs.read().unionByName(row))
        return job_id

    def control(self, job_id: str, action: str) -> None:
        """PAUSE and CANCEL take effect between steps; RESUME queues a job that was paused, interrupted or failed."""
        status = self.get(job_id).status
        if status in DONE:
            raise JobError("INVALID_JOB_STATE")
        if action == "RESUME":
            if status not in ("PAUSED", "INTERRUPTED", "FAILED"):
                raise JobError("INVALID_JOB_STATE")
            self._set(job_id, status="QUEUED", control=None)
        elif action == "CANCEL" and status not in RUNNING:
            self._set(job_id, status="CANCELLED", control=None)
        else:
            self._set(job_id, control=action)

    def remaining(self, job_id: str, chapters: DataFrame) -> DataFrame:
        """The chapters (chapter, …) without a checkpoint."""
        return chapters.join(self.done.read().where(F.col("job_id") == job_id).select("chapter"), "chapter", "left_anti")

    def run(self, job_id: str, chapters: DataFrame, step: Callable[[DataFrame], None], batch: int = 100) -> str:
        """Steps through the remaining chapters, `batch` at a time; each step's commit is followed by its checkpoint, so a
        chapter that was committed isn't done again."""
        self._set(job_id, status="RUNNING")
        while True:
            want = self.get(job_id).control
            if want in ("PAUSE", "CANCEL"):
                self._set(job_id, status="PAUSED" if want == "PAUSE" else "CANCELLED", control=None)
                break
            ids = [r.chapter for r in self.remaining(job_id, chapters).select("chapter").orderBy("chapter").limit(batch).collect()]
            if not ids:
                self._set(job_id, status="COMPLETED")
                break
            try:
                step(chapters.where(F.col("chapter").isin(ids)))
            except Exception:
                self._set(job_id, status="FAILED")
                raise
            new = self.spark.createDataFrame([(job_id, i) for i in ids], "job_id string, chapter int")
            self.done.write(self.done.read().unionByName(new).dropDuplicates(), owner=self.done.version())
        return self.get(job_id).status

    def progress(self, job_id: str) -> float:
        n = self.done.read().where(F.col("job_id") == job_id).count()
        total = self.get(job_id).total
        return min(1.0, n / total) if total else 0.0
