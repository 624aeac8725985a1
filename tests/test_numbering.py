"""Numbers by prefix sums, and the audit of rates in stretches of time, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellumlake.functions.numbering import numbered
from vellumlake.operators import aggregate


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_numbered(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in rng.sample(range(10_000), 400)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, id int").repartition(5)
        got = {r.id: r.k for r in numbered(df, ["g"], ["id"], "k").collect()}
        whole = {r.id: r.k for r in numbered(df, [], ["id"], "k").collect()}
        none = numbered(df.limit(0), ["g"], ["id"], "k").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: sum(h == g and j < i for h, j in rows) for g, i in rows}
    assert whole == {i: k for k, i in enumerate(sorted(i for _, i in rows))}
    assert none == 0


def test_rate_audit_in_stretches(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(["x", "x", "y", None]), start + timedelta(seconds=rng.choice([0, 1, 30, 59, 60, 61, 119, 120, 600]), microseconds=rng.randrange(2))) for i in range(150)]
    rows += [(200 + i, "x", None) for i in range(3)]
    got = {r.i: (r.in_window, r.over) for r in aggregate.rate_audit(spark.createDataFrame(rows, "i int, route string, at timestamp"), "route", "at", most=20).collect()}
    want = {}
    for i, route, at in rows:
        if at is None:
            n = sum(r == route and t is None for _, r, t in rows)
        else:
            n = sum(r == route and t is not None and at - timedelta(seconds=60) < t <= at for _, r, t in rows)
        want[i] = (n, n > 20)
    assert got == want
    plan = aggregate.rate_audit(spark.range(5).select(F.col("id").alias("route"), F.current_timestamp().alias("at")), "route", "at")
    assert plan.columns == ["route", "at", "in_window", "over"]
