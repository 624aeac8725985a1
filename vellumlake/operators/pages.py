"""Pages of a book without chapters: repeated edges, outline ranges, fixed blocks, and what kind of text it is.

Pages are rows (book, page from 0, lines, top, bottom); top and bottom are the arrays of lines at a page's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumlake.functions.text import SPACE, bound, lines, stripped

# Page numbers, pagination lines, short equations, and lines of code or formulas.
PAGE_NUMBER = r"(?i)^(?:page\s+)?(?:\d{1,6}|[ivxlcdm]{1,12})$"
PAGINATION = r"(?i)^\s*(?:[-–—]\s*)?(?:[(\[{]\s*)?(?:page\s+\d{1,6}(?:\s*(?:of|/)\s*\d{1,6})?|\d{1,6}\s*(?:of|/)\s*\d{1,6})\s*[.!?]?\s*(?:[)\]}]\s*)?(?:[-–—]\s*)?$"
_ATOM = r"(?:[^\W\d_]\w*|\d+(?:\.\d+)?)"
_SIDE = rf"{_ATOM}(?:\s*[+*/^×÷−-]\s*{_ATOM})*"
EQUATION = rf"(?U)^{_SIDE}\s*(?:=|==|≈|≠|<=|>=|≤|≥)\s*{_SIDE}$"
CODE = [
    r"^(?:(?:async\s+)?(?:def|function)\s+[A-Za-z_]\w*\s*\([^)]*\)\s*(?::|\{)|class\s+[A-Za-z_]\w*(?:\s*\([^)]*\))?\s*(?::|\{))$",
    r"^(?:(?:if|elif|while|for|with)\s+(?:\([^)]*\)|.+):|(?:if|while|for|switch)\s*\([^)]*\)\s*\{)$",
    r"^(?:import\s+[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*(?:\s+as\s+[A-Za-z_]\w*)?|from\s+[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\s+import\s+(?:[A-Za-z_*]\w*|\*))$",
]
INDENTED = r"^[ \t]{2,}(?:(?:return|yield)\b.*(?:[+*/^−-]|==|!=|<=|>=|:=)|[A-Za-z_]\w*(?:(?:\.[A-Za-z_]\w*)|(?:\[[^]]+\]))*\s*(?:[+*/-]?=|:=)\s*\S)"
FORMULA = r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[^=].*[+*/^−-]"

BLOCK_PAGES, LEAST_REPEATS = 20, 3


def repeated_lines(pages: DataFrame, edge: str) -> DataFrame:
    """(book, line) of the lines that stand at the edge (top or bottom) of at least three, and half, of a book's pages.

    Lines are told apart on each page first, so the only rows that move are partial counts by book and line.
    """
    sizes = pages.groupBy("book").agg(F.count("*").alias("pages"))
    seen = pages.select("book", F.explode(F.array_distinct(edge)).alias("line")).groupBy("book", "line").agg(F.count("*").alias("n"))
    return seen.join(sizes, "book").where(F.col("n") >= F.greatest(F.lit(LEAST_REPEATS), F.ceil(F.col("pages") / 2))).select("book", "line")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(book, page, text) without the lines at the edges that are repeated or page numbers."""
    kept = pages
    for edge in ("top", "bottom"):
        found = repeated_lines(pages, edge).groupBy("book").agg(F.collect_set("line").alias(f"again_{edge}"))
        kept = kept.join(found, "book", "left").withColumn(f"again_{edge}", F.coalesce(f"again_{edge}", F.array().cast("array<string>")))
    own = F.filter(F.transform("lines", lambda x: F.regexp_replace(x, f"{SPACE}+$", "")), lambda x: stripped(x) != "")
    kept = kept.withColumn("lines", own).withColumn("n", F.size("lines"))
    goes = lambda edge: lambda x: F.array_contains(F.col(edge), x) & (F.array_contains(F.col(f"again_{edge}"), x) | stripped(x).rlike(PAGE_NUMBER))
    first = lambda stays: F.coalesce(F.array_position(stays, True), F.lit(0))
    stays = lambda arr, edge: F.transform(arr, lambda x: ~goes(edge)(x))
    kept = kept.withColumn("from_top", first(stays(F.col("lines"), "top"))).withColumn("from_end", first(stays(F.reverse("lines"), "bottom")))
    # a page whose lines all go at one edge has none left
    size = F.col("n") - F.col("from_top") - F.col("from_end") + 2
    body = F.when((F.col("from_top") == 0) | (F.col("from_end") == 0) | (size < 1), F.lit("")).otherwise(F.array_join(F.slice("lines", F.greatest(F.col("from_top"), F.lit(1)).cast("int"), F.greatest(size, F.lit(0)).cast("int")), "\n"))
    return kept.select("book", "page", body.alias("text"))


def outline_starts(outline: DataFrame) -> DataFrame:
    """(book, title, start) of the entries (book, pos, title, start, pages) that count: titled, within the book, and later
    than every entry before. A book whose first entry isn't its first page gets front matter."""
    fine = outline.where((F.col("title") != "") & (F.col("start") >= 0) & (F.col("start") < F.col("pages")))
    before = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("most", F.max("start").over(before)).where("most is null or start > most")
    front = fine.groupBy("book").agg(F.min("start").alias("least")).where("least > 0").select("book", F.lit("Front Matter").alias("title"), F.lit(0).cast("int").alias("start"))
    return fine.select("book", "title", F.col("start").cast("int").alias("start")).unionByName(front)


def outline_ranges(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, index, title, content, source_locator) of the chapters between starts (book, title, start); pages are rows
    (book, page, text). Each page finds its range by the last start at or before it, in one pass over the book's rows in
    order, so there is no join on ranges."""
    order = Window.partitionBy("book").orderBy("page", "kind")
    marks = starts.select("book", F.col("start").alias("page"), F.lit(0).alias("kind"), "title", F.lit(None).cast("string").alias("text"))
    both = marks.unionByName(pages.select("book", F.col("page").cast("int").alias("page"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"), "text"))
    start = F.last(F.when(F.col("kind") == 0, F.struct("page", "title")), ignorenulls=True).over(order)
    both = both.withColumn("start", start).where("kind = 1 and start is not null")
    return _joined(both.select("book", "page", "text", F.col("start.page").alias("start"), F.col("start.title").alias("title")), F.col("title"))


def fixed_blocks(pages: DataFrame, size: int = BLOCK_PAGES) -> DataFrame:
    """The chapters of `size` pages each."""
    own = pages.withColumn("start", (F.floor(F.col("page") / size) * size).cast("int"))
    return _joined(own, F.format_string("Pages %d-%d", F.col("start") + 1, F.col("end")))


def _joined(rows: DataFrame, title: Column) -> DataFrame:
    keys = ["book", "start"] + (["title"] if "title" in rows.columns else [])
    texts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"] != ""), lambda x: x["text"])
    out = rows.groupBy(*keys).agg(F.array_join(texts, "\n\n").alias("content"), (F.max("page") + 1).alias("end")).where("content <> ''")
    number = F.row_number().over(Window.partitionBy("book").orderBy("start")) - 1
    return out.select("book", number.alias("index"), title.alias("title"), "content", F.format_string("pdf:pages:%d-%d", F.col("start") + 1, F.col("end")).alias("source_locator"))


def has_meaning(texts: Column) -> Column:
    """Is there a short equation, or are there two letters outside pagination, in an array of page texts?"""
    rows = F.filter(F.transform(F.flatten(F.transform(texts, lines)), stripped), lambda x: (x != "") & ~x.rlike(PAGE_NUMBER) & ~x.rlike(PAGINATION))
    letters = lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"\P{L}", "")))
    return bound(rows, lambda r: F.exists(r, lambda x: x.rlike(EQUATION)) | (letters(r) >= 2))


def technical_lines(text: Column) -> Column:
    """How many lines are code, rows of a table or formulas."""

    def signal(x):
        # every kind of signal holds one of these, and few other lines do
        maybe = F.lit(False)
        for mark in ("=", "|", ":", "{", "import", "return", "yield"):
            maybe = maybe | F.contains(x, F.lit(mark))
        s = stripped(x)
        code = x.rlike(INDENTED)
        for p in CODE:
            code = code | s.rlike(p)
        return maybe & (s != "") & (code | (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2) | s.rlike(FORMULA))

    return F.size(F.filter(lines(text), signal))


def profile(chapters: DataFrame, book: str = "book", text: str = "content") -> DataFrame:
    """(book, profile): TECHNICAL with two or more technical lines."""
    return chapters.groupBy(book).agg(F.when(F.sum(technical_lines(F.col(text))) >= 2, "TECHNICAL").otherwise("TEXT").alias("profile"))
