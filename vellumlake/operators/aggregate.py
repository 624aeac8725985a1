"""Book-level indexes: budgeted round-robin lists, sorted sets, missing chapters, budgets and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of an index, missing chapters shown, frameworks shown.
MOST_ITEMS, MOST_MISSING, MOST_FRAMEWORKS = 128, 100, 12


def round_robin(items: DataFrame, current: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(book, position, chapter, value): the values of a book's index.

    items: book, chapter, pos (from 0 in the chapter), value, reserved (is it one of those that the current chapter puts
    first). current: book, chapter. The current chapter's reserved values come first. Then rounds visit the chapters after
    the current one, in a circle, the current last; round r takes each chapter's value r - 1, the current's value r. A
    value counts once for a book; the list ends at `most` values or after the first round that adds none.

    A value's place is its first (round, turn), so one aggregation finds it; rounds that add nothing show as gaps.
    """
    cur = current.select("book", F.col("chapter").alias("cur"))
    chapters = items.select("book", "chapter").distinct().join(cur, "book")
    turn = F.when(F.col("chapter") == F.col("cur"), 2).when(F.col("chapter") > F.col("cur"), 0).otherwise(1)
    chapters = chapters.select("book", "chapter", (F.col("chapter") == F.col("cur")).alias("own"), F.struct(turn.alias("lap"), F.col("chapter").alias("chapter")).alias("turn"))
    rows = items.join(chapters, ["book", "chapter"])
    round_ = F.when(F.col("own"), F.col("pos")).otherwise(F.col("pos") + 1)
    visit = rows.select("book", "value", F.struct(round_.alias("round"), "turn", "pos").alias("at")).where("at.round >= 1")
    first = rows.where("own and reserved").select("book", "value", F.struct(F.lit(0).alias("round"), "turn", "pos").alias("at"))
    places = visit.unionByName(first).groupBy("book", "value").agg(F.min("at").alias("at"))
    # the rounds that add something are 1, 2, ... without a gap up to the last that counts
    rounds = places.where("at.round > 0").select("book", F.col("at.round").alias("round")).distinct()
    dense = rounds.withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy("round"))).where("n = round").select("book", "round")
    kept = places.where("at.round = 0").unionByName(places.withColumn("round", F.col("at.round")).join(dense, ["book", "round"]).drop("round"))
    position = F.row_number().over(Window.partitionBy("book").orderBy("at"))
    return kept.withColumn("position", position).where(F.col("position") <= most).select("book", "position", F.col("at.turn.chapter").alias("chapter"), "value")


def sorted_set(rows: DataFrame, book: str, values: str, most: int | None = None) -> DataFrame:
    """(book, values): the distinct elements of arrays, sorted; at most `most`, the first."""
    each = rows.select(book, F.explode(values).alias("v")).distinct()
    out = F.array_sort(F.collect_list("v"))
    return each.groupBy(book).agg((F.slice(out, 1, most) if most else out).alias(values))


def missing_chapters(rendered: DataFrame, totals: DataFrame) -> DataFrame:
    """(book, missing): the first hundred numbers (from 1, two digits) of chapters not rendered, and how many more.
    rendered: book, chapter; totals: book, total."""
    have = rendered.groupBy("book").agg(F.collect_set(F.col("chapter").cast("long")).alias("have"))
    gone = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1), F.coalesce("have", F.array().cast("array<bigint>")))
    gone = F.when(F.col("total") > 0, F.array_sort(gone)).otherwise(F.array().cast("array<bigint>"))
    shown = F.transform(F.slice("gone", 1, MOST_MISSING), lambda x: F.format_string("%02d", x + 1))
    more = F.concat(F.format_number(F.size("gone") - MOST_MISSING, 0), F.lit(" additional unprocessed chapters."))
    out = F.when(F.size("gone") > MOST_MISSING, F.concat(shown, F.array(more))).otherwise(shown)
    return totals.join(have, "book", "left").withColumn("gone", gone).select("book", out.alias("missing"))


def over_budget(files: DataFrame, most_files: int = 5011, most_bytes: int = 64 << 20, most_each: int = 8 << 20) -> DataFrame:
    """(book, files, bytes, over): does a bundle break a budget? files: book, path, content (binary)."""
    size = F.octet_length("content")
    out = files.groupBy("book").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))
    return out.select("book", "files", "bytes", ((F.col("files") > most_files) | (F.col("bytes") > most_bytes) | (F.col("largest") > most_each)).alias("over"))


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Token sums of a call log (input_tokens, output_tokens); every call counts as a request."""
    out = calls.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("request_count"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def rate_audit(calls: DataFrame, route: str, at: str, most: int = 20, seconds: int = 60) -> DataFrame:
    """calls with in_window (calls of the route in the trailing window, this one included; a call exactly `seconds` old has
    left it) and over (was the limit broken?).

    A task's groups are a route's calls of one stretch of `seconds`, with the times of the stretch before, so a route that is
    asked all the time is many groups. Calls without a time count one another."""
    long = seconds * 1_000_000
    own = calls.withColumns({"_micros": F.unix_micros(at), "_own": F.lit(True)})
    own = own.withColumn("_bucket", F.floor(F.col("_micros") / long))
    before = own.where("_micros is not null").select(route, "_micros", (F.col("_bucket") + 1).alias("_bucket"), F.lit(False).alias("_own"))
    window = Window.partitionBy(route, "_bucket").orderBy("_micros").rangeBetween(-long + 1, 0)
    both = own.unionByName(before, allowMissingColumns=True).withColumn("in_window", F.count("*").over(window))
    return both.where("_own").drop("_micros", "_bucket", "_own").withColumn("over", F.col("in_window") > most)


def progress(checkpoints: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), checkpoints / total))).otherwise(F.lit(0.0))


def skill_summary(manifests: DataFrame) -> DataFrame:
    """(book, rendered, total, complete) of manifest chapters (book, chapter, total)."""
    out = manifests.groupBy("book").agg(F.count("*").alias("rendered"), F.max("total").alias("total"))
    return out.withColumn("complete", (F.col("total") > 0) & (F.col("rendered") == F.col("total")))
