"""Managed bundles: validation, and what an update writes, removes and leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumlake.functions.canonical import canonical_json
from vellumlake.functions.text import bound, is_relative_path
from vellumlake.operators.library import with_history

# Link forms that a bundle's files may hold, and words that they may not.
LINK = r"(?<!\\)\[[^\]]*(?<!\\)\]\(([^)\s]+)\)"
FORBIDDEN = ["<script", "javascript:", "allowed-tools:"]


def update_plan(old: DataFrame, new: DataFrame, managed: DataFrame | None = None) -> DataFrame:
    """(book, path, action) for files old and new (book, path, content): write, remove or keep. managed (book, path,
    sha256): what the last manifest owns; an old file that it doesn't own, or that was changed since, is a conflict where
    the update would touch it."""
    digest = lambda df, name: df.select("book", "path", F.sha2("content", 256).alias(name))
    both = digest(old, "was").join(digest(new, "now"), ["book", "path"], "full_outer")
    action = F.when(F.col("now").isNull(), "remove").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("write")
    if managed is not None:
        both = both.join(managed.select("book", "path", F.col("sha256").alias("own")), ["book", "path"], "left")
        foreign = F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("own"))
        action = F.when(foreign & F.col("now").isNull() & F.col("own").isNull(), "keep").when(foreign & ~F.col("was").eqNullSafe(F.col("now")), "conflict").otherwise(action)
    return both.select("book", "path", action.alias("action"))


def file_hashes(files: DataFrame, order: str = "path") -> DataFrame:
    """(book, files): the list of path and SHA-256 of each book's files, sorted by a column."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col("path").alias("path"), F.sha2("content", 256).alias("sha256"))))
    return files.groupBy("book").agg(F.transform(rows, lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"))).alias("files"))


def checksum(manifest: Column, names: list[str]) -> Column:
    """The digest of a manifest struct's fields but its checksum."""
    return F.sha2(canonical_json(F.struct(*(manifest[n].alias(n) for n in sorted(names) if n != "checksum"))), 256)


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), 1)


def unknown_links(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """(book, path, link) of the links of files (book, path, text) that aren't in allowed (book, link)."""
    found = files.select("book", "path", F.explode(links(F.col("text"))).alias("link")).distinct()
    return found.join(allowed.select("book", "link"), ["book", "link"], "left_anti").select("book", "path", "link")


def forbidden(text: Column) -> Column:
    """Does a file hold what no bundle may?"""
    low = F.lower(text)
    out = F.lit(False)
    for word in FORBIDDEN:
        out = out | low.contains(word)
    return out


def same_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(book, equal): do two listings (book, path) name the same files?"""
    left, right = a.select("book", "path", F.lit(1).alias("l")).distinct(), b.select("book", "path", F.lit(1).alias("r")).distinct()
    return left.join(right, ["book", "path"], "full_outer").groupBy("book").agg(F.min(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("equal"))


def parse_envelope(content: Column, prefix: str) -> Column:
    """struct<kind, book_key, chapter_index, fingerprint, stable_id, body, intact> of a managed note: intact if the header
    has its fields, in order, and the body the digest that it states."""
    field = lambda name: F.regexp_extract(content, rf'(?m)^{prefix}_{name}: "([^"]*)"$', 1)
    names = ["kind", "book_key", "chapter_index", "source_fingerprint", "stable_id", "body_sha256"]
    head = rf'^---\n{prefix}: "managed"\n{prefix}_schema: "1"\n' + "".join(rf'{prefix}_{n}: "[^"\n]*"\n' for n in names) + r"---\n"
    body = F.regexp_replace(content, head, "")
    return F.struct(*(field(n).alias(n) for n in names[:-1]), body.alias("body"), (content.rlike(head) & (F.sha2(body, 256) == field("body_sha256"))).alias("intact"))


#: The manifest of a book's notes, fields in canonical order.
VAULT_CHAPTER = "struct<card_paths:array<string>,frameworks:array<string>,index:int,input_fingerprint:string,note_path:string,title:string,topics:array<string>>"
VAULT_CARD = "struct<chapter_index:int,kind:string,path:string,stable_id:string,title:string>"
VAULT = f"struct<book_directory:string,book_key:string,book_title:string,cards:array<{VAULT_CARD}>,chapters:array<{VAULT_CHAPTER}>,checksum:string,moc_path:string,schema:int,total_chapters:int>"
VAULT_FIELDS = ["book_directory", "book_key", "book_title", "cards", "chapters", "checksum", "moc_path", "schema", "total_chapters"]
#: Chapters of a book, cards of a manifest, paths that an update may touch.
MOST_CHAPTERS, MOST_CARDS, MOST_PATHS = 5000, 10_000, 10_000


def merged_chapters(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The chapters (book_key, index, ...) of books' manifests after an update: those rendered before stay, unless they are
    rendered anew."""
    return with_history(previous, current, ["book_key", "index"])


def merged_cards(previous: DataFrame, current: DataFrame, chapters: DataFrame) -> DataFrame:
    """The cards (book_key, chapter_index, stable_id, ...) after an update of chapters (book_key, index): cards of those
    chapters are replaced, and so is a card whose stable_id comes again."""
    again = chapters.select("book_key", F.col("index").alias("chapter_index")).distinct()
    kept = previous.join(again, ["book_key", "chapter_index"], "left_anti")
    return with_history(kept, current, ["book_key", "stable_id"])


def vault_manifest(books: DataFrame, chapters: DataFrame, cards: DataFrame) -> DataFrame:
    """(book_key, manifest): the canonical JSON of each book's manifest, with its checksum. books: book_key, book_title,
    book_directory, moc_path, total_chapters (the total never falls below the last chapter's number); chapters: book_key and
    VAULT_CHAPTER's fields but card_paths, which are those of its cards by kind and stable_id; cards: book_key and
    VAULT_CARD's fields."""
    own = cards.groupBy("book_key", F.col("chapter_index").alias("index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "stable_id", "path"))), lambda x: x["path"]).alias("card_paths"))
    none = F.array().cast("array<string>")
    rows = chapters.drop("card_paths").join(own, ["book_key", "index"], "left").withColumn("card_paths", F.coalesce("card_paths", none))
    chapter = F.struct("card_paths", "frameworks", "index", "input_fingerprint", "note_path", "title", "topics")
    by_book = rows.groupBy("book_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", chapter.alias("c")))), lambda x: x["c"]).alias("chapters"), F.max("index").alias("last"))
    card = F.struct("chapter_index", "kind", "path", "stable_id", "title")
    all_cards = cards.groupBy("book_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "kind", "stable_id", card.alias("c")))), lambda x: x["c"]).alias("cards"))
    out = books.join(by_book, "book_key", "left").join(all_cards, "book_key", "left")
    total = F.greatest(F.coalesce("total_chapters", F.lit(0)), F.coalesce(F.col("last") + 1, F.lit(0))).cast("int")
    full = F.coalesce("cards", F.array().cast(f"array<{VAULT_CARD}>")), F.coalesce("chapters", F.array().cast(f"array<{VAULT_CHAPTER}>"))
    made = F.struct("book_directory", "book_key", "book_title", full[0].alias("cards"), full[1].alias("chapters"), F.lit("").alias("checksum"), "moc_path", F.lit(1).alias("schema"), total.alias("total_chapters"))
    made = out.select("book_key", made.alias("m"))
    return made.select("book_key", canonical_json(F.col("m").withField("checksum", checksum(F.col("m"), VAULT_FIELDS))).alias("manifest"))


def parsed_manifest(manifest: Column) -> Column:
    """The manifest in a text as VAULT, or null: it must be the canonical form of what it says, with the right checksum. So
    repeated keys, other fields, spaces and numbers written otherwise aren't taken."""

    def own(m: Column) -> Column:
        exact = (canonical_json(m) == manifest) & (checksum(m, VAULT_FIELDS) == m["checksum"]) & (m["schema"] == 1)
        return F.when(m.isNotNull(), F.when(F.coalesce(exact, F.lit(False)), m))

    return bound(F.from_json(manifest, VAULT), own)


def manifest_faults(manifests: DataFrame) -> DataFrame:
    """(book_key, fault) of manifests (book_key, m: VAULT) whose parts don't fit together; a book may have several faults.

    PATH: a path isn't relative, lies outside of the book's folder or chapter folder, or is used twice. INDEX: a chapter's
    number or a card's stable_id is used twice, or the total is less than the last chapter's number. CHAPTER: a card of a chapter that isn't
    there. LISTED: a chapter lists a card that isn't its own, or twice; CARD: a card that its chapter doesn't list. SIZE: more
    chapters or cards than a manifest holds."""
    m = F.col("m")
    one = manifests.select("book_key", "m")
    note = one.select("book_key", F.concat(m["book_directory"], F.lit("/Chapters/")).alias("_in"), F.explode(m["chapters"]).alias("c"))
    card = one.select("book_key", F.explode(m["cards"]).alias("k")).select("book_key", "k.*")
    fault = lambda df, name: df.select("book_key", F.lit(name).alias("fault"))
    paths = one.select("book_key", m["moc_path"].alias("path")).unionByName(note.select("book_key", F.col("c.note_path").alias("path"))).unionByName(card.select("book_key", "path"))
    outside = one.where((F.substring_index(m["moc_path"], "/", -1) == m["moc_path"]) | (F.regexp_replace(m["moc_path"], "/[^/]*$", "") != m["book_directory"]))
    listed = note.select("book_key", F.col("c.index").alias("chapter_index"), F.explode("c.card_paths").alias("path"))
    had = card.select("book_key", "chapter_index", "path")
    key = ["book_key", "chapter_index", "path"]
    parts = [
        fault(paths.where(~F.coalesce(is_relative_path(F.col("path")), F.lit(False))), "PATH"),
        fault(paths.groupBy("book_key", "path").count().where("count > 1"), "PATH"),
        fault(outside, "PATH"),
        fault(note.where(~F.startswith(F.col("c.note_path"), F.col("_in"))), "PATH"),
        fault(note.groupBy("book_key", "c.index").count().where("count > 1"), "INDEX"),
        fault(card.groupBy("book_key", "stable_id").count().where("count > 1"), "INDEX"),
        fault(one.where(m["total_chapters"] < F.coalesce(F.array_max(F.transform(m["chapters"], lambda x: x["index"])) + 1, F.lit(0))), "INDEX"),
        fault(card.join(note.select("book_key", F.col("c.index").alias("chapter_index")), ["book_key", "chapter_index"], "left_anti"), "CHAPTER"),
        fault(listed.join(had, key, "left_anti"), "LISTED"),
        fault(listed.groupBy(*key).count().where("count > 1"), "LISTED"),
        fault(had.join(listed, key, "left_anti"), "CARD"),
        fault(one.where((F.size(m["chapters"]) > MOST_CHAPTERS) | (F.size(m["cards"]) > MOST_CARDS)), "SIZE"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def candidate_paths(rendered: DataFrame, manifests: DataFrame) -> DataFrame:
    """(book, path, safe): every path that an update of a book may touch: those rendered (book, path), and all that the
    manifest (book, m: VAULT) before names."""
    m = F.col("m")
    named = F.concat(F.array(m["moc_path"]), F.transform(m["chapters"], lambda x: x["note_path"]), F.transform(m["cards"], lambda x: x["path"]))
    both = rendered.select("book", "path").unionByName(manifests.select("book", F.explode(named).alias("path"))).distinct()
    return both.withColumn("safe", F.coalesce(is_relative_path(F.col("path")), F.lit(False)))


def lost_history(previous: DataFrame, rendered: DataFrame, current: DataFrame) -> DataFrame:
    """(book, index) of chapters of a manifest before (book, index, path, sha256) that a rendered one lacks or has otherwise,
    though the update is of other chapters (current: book, index)."""
    key = ["book", "index"]
    old = previous.join(current.select(*key).distinct(), key, "left_anti")
    now = rendered.select(*key, F.col("path").alias("_path"), F.col("sha256").alias("_sha"))
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    return old.join(now, key, "left").where(~same).select(*key).distinct()
