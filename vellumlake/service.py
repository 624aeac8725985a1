"""The library as one object: import, look up, analyze, plan, render, publish and run jobs. Verbs give DataFrames."""

from __future__ import annotations

import functools
import importlib.util
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumlake.functions import canonical, text
from vellumlake.functions.numbering import checkpointed
from vellumlake.operators import aggregate, analysis, bundles, integrity, library, render
from vellumlake.operators.publish import Publisher, PublishError
from vellumlake.plans import calls, planning
from vellumlake.plans.jobs import DONE, JobError, Jobs
from vellumlake.plans.providers import Registry, asking
from vellumlake.sources import binary, epub, pdf
from vellumlake.sources.config import Config
from vellumlake.sources.extractors import Extractor, Extractors

SYSTEM = "library"
BOOKS = "book_id string, format string, source_fingerprint string, mode string, path string, title string, author string, language string, total_chapters int, created_at timestamp"
CHAPTERS = "book_id string, chapter_index int, title string, content string, source_locator string"
CACHE = f"source_system string, external_book_id string, chapter_index int, input_fingerprint string, analysis {analysis.SCHEMA}, created_at timestamp, updated_at timestamp"


#: Where a book's notes have their vault manifest.
VAULT_MANIFEST = "vault-manifest.json"


class Service:
    def __init__(self, spark: SparkSession, root: str, provider: Callable[[], analysis.Provider] | None = None, config: Config | None = None, key: str | None = None, extractors: list[Extractor] = ()):
        """provider: makes a provider in a worker; without one the configuration names it, and key is its credential. extractors:
        formats of one's own."""
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.provider = provider or Registry().maker(self.config.model, key)
        lanes = None if provider else asking(self.config.model)
        self.limits = {} if lanes is None else {"lanes": lanes, "per_window": self.config.model.requests_per_minute}
        self.log = calls.CallLog(spark, f"{self.root}/calls/log")
        self.extractors = Extractors(spark, extractors)
        self.tables = {}
        for name, schema in (("books", BOOKS), ("chapters", CHAPTERS), ("analyses", CACHE)):
            t = self.tables[name] = library.Table(spark, f"{self.root}/{name}")
            if t.version() is None:
                t.write(spark.createDataFrame([], schema))
        self.skills, self.notes = Publisher(spark, f"{self.root}/skills"), Publisher(spark, f"{self.root}/vault")

    # import and look-up

    def import_path(self, path: str, mode: str = "REFERENCE") -> DataFrame:
        """(path, book_id, error) of the files under path after importing them; a file that is in the library already gives
        its first record. Formats of one's own are read where they are, whatever the mode. COPY keeps the bytes of the files in the library and reads the books from there; a file that isn't
        what was copied any more isn't imported (SOURCE_CHANGED)."""
        files = binary.files(self.spark, path)
        good = files.where("error is null")
        changed = self.spark.createDataFrame([], "path string, error string")
        kept = F.col("path")
        if mode == "COPY":
            folder = f"{self.root}/sources/{uuid.uuid4().hex}"
            good.write.parquet(folder)
            copied = self.spark.read.parquet(folder)
            now = binary.changed(copied, binary.files(self.spark, path)).distinct()
            changed = now.select("path", F.lit("SOURCE_CHANGED").alias("error"))
            good = copied.join(now, "path", "left_anti")
            kept = F.concat(F.lit(f"{folder}#"), F.col("path"))
        e = epub.chapters(good.where("format = 'epub'"))
        own = [self.spark.read.format(x.name).load(path).withColumn("format", F.lit(x.name)) for x in self.extractors.custom]
        read = None
        if own:
            read = checkpointed(functools.reduce(DataFrame.unionByName, own))
            e = e.unionByName(read.select(e.columns))
            uri = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731 both ways to name a local file
            files = files.join(read.select(uri(F.col("path")).alias("_read")).distinct(), uri(F.col("path")) == F.col("_read"), "left_anti")
        p = pdf.page_rows(good.where("format = 'pdf'"))
        found = e.where("error is null").select("path", "title", "author", "language", "chapter_index", "chapter_title", "content", "source_locator")
        c = pdf.chapters(p)
        meta = p.where("page = 0").select("path", F.coalesce(F.nullif("title", F.lit("")), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)).alias("title"), F.coalesce("author", F.lit("")).alias("author"))
        from_pdf = c.where("error is null").withColumnRenamed("book", "path").withColumnRenamed("title", "chapter_title").join(meta, "path").withColumn("language", F.lit("")).withColumnRenamed("index", "chapter_index")
        found = found.unionByName(from_pdf.select(found.columns))
        failed = files.where("error is not null").select("path", "error").unionByName(e.where("error is not null").select("path", "error")).unionByName(c.where("error is not null").select(F.col("book").alias("path"), "error"))
        failed = failed.unionByName(changed)
        names = good.select("path", "format", "fingerprint")
        if read is not None:
            names = names.unionByName(read.where("error is null").select("path", "format", "fingerprint").distinct())
            kept = F.when(F.col("format").isin(*(x.name for x in self.extractors.custom)), F.col("path")).otherwise(kept)
        ids = names.select("path", "format", F.col("fingerprint").alias("source_fingerprint"), F.substring(F.sha2(F.concat("format", F.lit(":"), "fingerprint"), 256), 1, 32).alias("book_id"))
        sizes = found.groupBy("path", "title", "author", "language").agg(F.count("*").cast("int").alias("total_chapters"))
        new = ids.join(sizes, "path").select("book_id", "format", "source_fingerprint", F.lit(mode).alias("mode"), kept.alias("path"), "title", "author", "language", "total_chapters", F.current_timestamp().alias("created_at"))
        books, chapters = self.tables["books"], self.tables["chapters"]
        was, had = books.version(), chapters.version()
        have = books.read(was)
        rows = found.join(ids.select("path", "book_id"), "path").select("book_id", F.col("chapter_index").cast("int").alias("chapter_index"), F.col("chapter_title").alias("title"), "content", "source_locator").dropDuplicates(["book_id", "chapter_index"])
        rows = rows.join(have.select("book_id"), "book_id", "left_anti")
        # chapters first: a crash in between leaves some without a book, which the next import writes again
        chapters.write(library.upserted(chapters.read(had), rows, ["book_id", "chapter_index"]), owner=had)
        b = books.write(library.import_books(have, new), owner=was)
        done = ids.join(self.spark.read.parquet(f"{self.root}/books/{b}").select("book_id"), "book_id", "left_semi").select("path", "book_id")
        return done.join(failed, "path", "full_outer").select("path", "book_id", "error")

    def source(self, book_id: str) -> DataFrame:
        """(book_id, content) of a book's file: the library's copy, or the file that it refers to."""
        b = self.get_book(book_id).select("path", "mode").first()
        if b is None:
            return self.spark.createDataFrame([], "book_id string, content binary")
        if b["mode"] == "COPY":
            folder, own = b.path.split("#", 1)
            found = self.spark.read.parquet(folder).where(F.col("path") == own)
        else:
            found = binary.files(self.spark, b.path)
        return found.select(F.lit(book_id).alias("book_id"), "content")

    def list_books(self) -> DataFrame:
        return self.tables["books"].read().orderBy("created_at", "book_id")

    def get_book(self, book_id: str) -> DataFrame:
        return self.tables["books"].read().where(F.col("book_id") == book_id)

    def get_chapter(self, book_id: str, index: int) -> DataFrame:
        return self.tables["chapters"].read().where((F.col("book_id") == book_id) & (F.col("chapter_index") == index))

    def snapshots(self, book_id: str | None = None) -> DataFrame:
        """The library's chapters as snapshots with their input fingerprints."""
        c = self.tables["chapters"].read().join(self.tables["books"].read().select("book_id", F.col("title").alias("book_title"), "author"), "book_id")
        if book_id is not None:
            c = c.where(F.col("book_id") == book_id)
        none = F.array().cast("array<struct<id:string,text:string>>")
        payload = canonical.source_payload(F.col("title"), F.col("content"), annotations=none, highlights=none, reflections=none, user_notes=none)
        settings = {"language": self.config.analysis.language, "max_chunk_characters": str(self.config.analysis.max_chunk_characters)}
        return c.select(F.lit(SYSTEM).alias("source_system"), F.col("book_id").alias("external_book_id"), "chapter_index", canonical.input_fingerprint(payload, settings, analysis.SCHEMA).alias("input_fingerprint"), "title", "content", "source_locator", "book_title", "author")

    # analysis, plans, rendering

    def analyze(self, book_id: str | None = None, force: bool = False, only: DataFrame | None = None) -> DataFrame:
        """The snapshots with analysis, cache_hit and error; new results are stored before they are returned. only: chapters
        (chapter)."""
        cache = self.tables["analyses"]
        snaps = self.snapshots(book_id)
        if only is not None:
            snaps = snaps.join(only.select(F.col("chapter").alias("chapter_index")), "chapter_index", "left_semi")
        log = self.log
        if force:  # answers of its own; the lanes go on
            log = calls.CallLog(self.spark, f"{self.root}/calls/{uuid.uuid4().hex}")
            log.free, log.number = self.log.free, self.log.number
        _, made = calls.analyze(snaps, cache.read().select(*library.KEY, "input_fingerprint", "analysis"), self.provider, log, force, most=self.config.analysis.max_chunk_characters, **self.limits)
        self.log.free, self.log.number = log.free, log.number
        was = cache.version()
        now = F.current_timestamp()
        # results are kept before anything is made of them, so no call is made twice
        errors = library.Table(self.spark, f"{self.root}/errors")
        staged = library.Table(self.spark, f"{self.root}/staged")
        staged.write(made, owner=staged.version())
        made = staged.read()
        fresh = made.where("analysis is not null").select(*library.KEY, "input_fingerprint", "analysis", now.alias("created_at"), now.alias("updated_at"))
        cache.write(library.upsert_analyses(cache.read(), fresh), owner=was)
        errors.write(made.where("error is not null").select(*library.KEY, "input_fingerprint", "error"), owner=errors.version())
        new = fresh.select(*library.KEY, "input_fingerprint", F.lit(True).alias("fresh"))
        out = library.with_cache(snaps, cache.read().select(*library.KEY, "input_fingerprint", "analysis")).join(new, [*library.KEY, "input_fingerprint"], "left")
        out = out.withColumn("cache_hit", F.col("cache_hit") & F.col("fresh").isNull()).drop("fresh").join(errors.read(), [*library.KEY, "input_fingerprint"], "left")
        # results and errors are two commits: an error that a later result has overtaken isn't one
        return out.withColumn("error", F.when(F.col("analysis").isNull(), F.col("error")))

    def plan(self, book_id: str) -> DataFrame:
        """Chapters, pending ones, calls and tokens of a run over a book, and the digest that the plan is made for."""
        snaps = self.snapshots(book_id)
        key = F.concat_ws(":", "chapter_index", "input_fingerprint").alias("key")
        own = snaps.select(F.col("external_book_id").alias("book"), key, "content", "chapter_index", "input_fingerprint")
        cached = self.tables["analyses"].read().where(F.col("external_book_id") == book_id).select(key)
        cost = planning.estimate(own, cached, "book", "key", "content", self.config.analysis.max_chunk_characters, self.config.model.default_max_output_tokens)
        return cost.join(planning.plan_digest(own, "book", "chapter_index", "input_fingerprint"), "book").withColumn("created_at", F.current_timestamp())

    def _rendered(self, book_id: str, kind: str) -> DataFrame:
        """A book's analyzed chapters, written once, as several files are made of them; and those that were published before
        and have no analysis now, as they were. name and book_name, of which paths are made, are the first published ones."""
        a = self.analyze(book_id).where("analysis is not null")
        a = a.withColumn("book_key", canonical.book_key(F.col("source_system"), F.col("external_book_id"))).withColumn("title", text.normalized(F.col("title"))).drop("content", "error", "cache_hit")
        before = library.Table(self.spark, f"{self.root}/published/{book_id}/{kind}")
        if before.version() is None:
            return self._kept(book_id, "chapters", a.withColumns({"name": F.col("title"), "book_name": F.col("book_title")}))
        old = before.read()
        first = old.agg(F.min_by("book_name", "chapter_index")).first()[0]
        a = a.join(old.select("chapter_index", "name"), "chapter_index", "left")
        a = a.withColumns({"name": F.coalesce("name", "title"), "book_name": F.coalesce(F.lit(first), "book_title")})
        return self._kept(book_id, "chapters", library.with_history(old.select(a.columns), a, ["chapter_index"]))

    def _published(self, book_id: str, kind: str) -> None:
        """Remembers what was published: the next time, chapters that failed since stay, and names too."""
        t = library.Table(self.spark, f"{self.root}/published/{book_id}/{kind}")
        t.write(library.Table(self.spark, f"{self.root}/rendered/{book_id}/chapters").read(), owner=t.version())

    def _total(self, book_id: str) -> DataFrame:
        """(book, total) of a book, as it was imported: chapters without an analysis count too."""
        return self.get_book(book_id).select(F.col("book_id").alias("book"), F.col("total_chapters").alias("total"))

    def _kept(self, book_id: str, name: str, df: DataFrame) -> DataFrame:
        """df, written and read back."""
        t = library.Table(self.spark, f"{self.root}/rendered/{book_id}/{name}")
        t.write(df, owner=t.version())
        return t.read()

    def note_files(self, book_id: str) -> DataFrame:
        """(path, content) of the notes of a book: its chapters, a card for each concept and decision rule, the map, and the vault
        manifest, which names them all."""
        cfg = self.config
        name = F.concat(F.lit(f"{cfg.books_folder}/Chapters/"), F.format_string("%04d ", F.col("chapter_index") + 1), text.safe_component(F.col("name"), "Chapter"), F.lit(".md"))
        moc = F.concat(F.lit(f"{cfg.books_folder}/"), text.safe_component(F.col("book_name"), "Book"), F.lit(" MOC.md"))
        a = self._rendered(book_id, "notes").withColumns({"path": name, "moc": moc}).withColumnRenamed("chapter_index", "chapter")
        found = render.cards(a.select("book_key", "chapter", "analysis"))
        title = text.safe_component(F.col("subject"), "Card")
        at = a.select("book_key", "chapter", "input_fingerprint", F.col("path").alias("note"), "moc")
        cards = self._kept(book_id, "subjects", found.join(at, ["book_key", "chapter"]).withColumns({"title": title}))
        cards = cards.withColumn("path", F.concat(F.lit(f"{cfg.cards_folder}/"), "title", F.lit("--"), "stable_id", F.lit(".md")))
        back = lambda label, c: text.markdown_link(F.lit(label), F.col("path"), F.col(c))
        body = F.concat(F.lit("# "), text.markdown_text(F.col("subject")), F.lit("\n\n"), render.card_details(F.col("kind"), F.col("content")), F.lit("\n\n## Source chapter\n"), back("Chapter note", "note"), F.lit("\n\n## Book MOC\n"), back("Book MOC", "moc"), F.lit("\n"))
        cards = cards.withColumn("content_", render.frontmatter("card", F.col("book_key"), F.col("chapter"), F.col("input_fingerprint"), F.col("stable_id"), body))
        cards = cards.withColumns({"link": text.markdown_link(F.col("title"), F.col("note"), F.col("path")), "moc_link": text.markdown_link(F.col("title"), F.col("moc"), F.col("path"))})
        cards = self._kept(book_id, "cards", cards)
        linked = cards.groupBy("book_key", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "link"))), lambda x: x["link"]).alias("links"))
        none = F.array().cast("array<string>")
        notes = a.join(linked, ["book_key", "chapter"], "left")
        body = render.chapter_note(F.col("title"), F.col("book_title"), F.col("author"), F.col("source_system"), F.col("source_locator"), F.col("analysis"), none, F.coalesce("links", none))
        notes = notes.withColumn("content_", render.frontmatter("chapter", F.col("book_key"), F.col("chapter"), F.col("input_fingerprint"), F.format_string("chapter-%04d", "chapter"), body))
        label = F.concat(F.format_string("%02d ", F.col("chapter") + 1), "title")
        notes = self._kept(book_id, "notes", notes.withColumn("link", text.markdown_link(label, F.col("moc"), F.col("path"))))
        books = notes.groupBy("book_key", "moc").agg(
            F.max("book_title").alias("title"), F.count("*").alias("rendered"), F.max("input_fingerprint").alias("f"),
            F.transform(F.array_sort(F.collect_list(F.struct("chapter", "link"))), lambda x: x["link"]).alias("chapters"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("analysis.frameworks.name")))).alias("frameworks"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("analysis.topic_tags")))).alias("topics"),
        )
        per_book = cards.groupBy("book_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "kind", "stable_id", "moc_link"))), lambda x: x["moc_link"]).alias("cards"))
        total = self._total(book_id)
        missing = aggregate.missing_chapters(notes.select(F.lit(book_id).alias("book"), "chapter"), total)
        books = books.join(per_book, "book_key", "left").withColumn("cards", F.coalesce("cards", none)).crossJoin(total.join(missing, "book").drop("book"))
        books = books.withColumn("content_", render.frontmatter("moc", F.col("book_key"), F.lit(0), F.col("f"), F.lit("moc"), render.moc(books)))
        listed = notes.select("book_key", F.array_distinct("analysis.frameworks.name").alias("frameworks"), F.col("chapter").alias("index"), "input_fingerprint", F.col("path").alias("note_path"), "title", F.array_distinct("analysis.topic_tags").alias("topics"))
        own_cards = cards.select("book_key", F.col("chapter").alias("chapter_index"), "kind", "path", "stable_id", F.col("subject").alias("title"))
        one = books.select("book_key", F.col("title").alias("book_title"), F.lit(cfg.books_folder).alias("book_directory"), F.col("moc").alias("moc_path"), F.col("total").alias("total_chapters"))
        manifest = bundles.vault_manifest(one, listed, own_cards)
        parts = [notes.select("path", "content_"), cards.select("path", "content_"), books.select(F.col("moc").alias("path"), "content_"), manifest.select(F.lit(VAULT_MANIFEST).alias("path"), F.col("manifest").alias("content_"))]
        return render.union(parts).select("path", F.col("content_").cast("binary").alias("content"))

    def skill_files(self, book_id: str) -> DataFrame:
        """(path, content) of a book's skill bundle: main file, chapters, index, glossary, patterns, rules and interface."""
        a = self._rendered(book_id, "skill").withColumnRenamed("chapter_index", "chapter").withColumn("book", F.lit(book_id))
        one = a.select("book", "chapter", "book_title", "book_name", "author", "title", "analysis", text.chapter_path(F.col("chapter"), text.slug(F.col("name"), "chapter", 60)).alias("path"), render.skill_chapter(F.col("title"), F.col("source_locator"), F.col("analysis")).alias("content"))
        one = self._kept(book_id, "skill", one)
        current = one.groupBy("book").agg(F.max("chapter").alias("chapter"))
        parts = [one.select("path", "content"), render.chapter_index(one).select(F.lit("chapters/index.md").alias("path"), "content")]
        indexes = {
            ("glossary.md", "Glossary"): [("concepts", "term")],
            ("patterns.md", "Reusable patterns"): [("frameworks", "name"), ("mental_models", "name"), ("methods", "name")],
            ("cheatsheet.md", "Quick rules"): [("decision_rules", "rule"), ("key_takeaways", "")],
        }
        for (path, title), families in indexes.items():
            items = render.family_items(one, *families)
            totals = one.select("book").distinct().join(items.groupBy("book").agg(F.count("*").alias("n")), "book", "left").select("book", F.coalesce("n", F.lit(0)).alias("total"))
            parts.append(render.index_file(title, items, current, totals).select(F.lit(path).alias("path"), "content"))
        book = one.groupBy("book").agg(F.max("book_title").alias("t"), F.max("book_name").alias("named"), F.max("author").alias("author"), F.count("*").alias("rendered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("analysis.frameworks.name")))).alias("frameworks"), F.array_sort(F.collect_list(F.struct("chapter", "title", "path"))).alias("chapters")).join(self._total(book_id), "book")
        key = F.substring(F.sha2("book", 256), 1, 16)
        name = F.concat(text.slug(F.col("named"), "book", 40), F.lit("--"), key)
        parts.append(book.select(F.lit("SKILL.md").alias("path"), render.skill_file(name, F.col("t"), F.col("author"), F.col("rendered"), F.col("total"), F.col("frameworks"), F.col("chapters")).alias("content")))
        parts.append(book.select(F.lit("agents/openai.yaml").alias("path"), render.skill_card(name, F.col("t")).alias("content")))
        return render.union(parts).withColumn("content", F.col("content").cast("binary"))

    def forge_notes(self, book_id: str) -> tuple[str, bool]:
        """Publishes a book's notes. Nothing changes if the manifest's parts don't fit together (INVALID_MANIFEST), or if a path
        that the update may touch, rendered or named by the manifest before, isn't safe (UNSAFE_BUNDLE)."""
        files = self.note_files(book_id)
        parsed = lambda f: f.where(F.col("path") == VAULT_MANIFEST).select(F.lit(book_id).alias("book"), bundles.parsed_manifest(F.col("content").cast("string")).alias("m"))
        made = parsed(files)
        if made.where("m is null").count() or bundles.manifest_faults(made.withColumnRenamed("book", "book_key")).count():
            raise PublishError("INVALID_MANIFEST")
        was = self.notes.active(book_id)
        old = parsed(self.notes.files(book_id)) if was else made.where("false")
        if old.where("m is null").count():
            raise PublishError("INVALID_MANIFEST")
        if bundles.candidate_paths(files.select(F.lit(book_id).alias("book"), "path"), old).where("not safe").count():
            raise PublishError("UNSAFE_BUNDLE")
        done = self.notes.publish(book_id, files, was)
        self._published(book_id, "notes")
        return done

    def forge_skill(self, book_id: str) -> tuple[str, bool]:
        """Publishes a book's skill. Nothing changes if chapters that were published before, and that this update isn't of, would
        be lost or come out otherwise (HISTORY_LOST)."""
        files = self.skill_files(book_id)
        was = self.skills.active(book_id)
        if was:
            index = F.regexp_extract("path", r"^chapters/ch(\d{4})-", 1)
            numbered = lambda df: df.where(index != "").select(F.lit(book_id).alias("book"), index.try_cast("int").alias("index"), "path", "sha256")
            old = numbered(self.spark.createDataFrame([(x["path"], x["sha256"]) for x in self.skills.manifest(book_id)["files"]], "path string, sha256 string"))
            now = self.tables["analyses"].read().where(F.col("external_book_id") == book_id).select(F.lit(book_id).alias("book"), (F.col("chapter_index") + 1).alias("index"))
            if bundles.lost_history(old, numbered(files.withColumn("sha256", F.sha2("content", 256))), now).count():
                raise PublishError("HISTORY_LOST")
        done = self.skills.publish(book_id, files, was)
        self._published(book_id, "skill")
        return done

    def forge(self, book_id: str, target: str, digest: str, planned_at: datetime, idempotency_key: str | None = None, step: int = 100) -> tuple[str, tuple[str, bool] | None]:
        """A whole book: analyses its chapters as a job, `step` at a time, then publishes target ("notes" or "skill"). (state of the
        job, what publishing gave or None). digest is that of the plan which was confirmed: chapters or settings that have changed
        since are a JobError (PLAN_CHANGED), and so is a plan that has run out. The same key goes on with the same job."""
        if target not in ("notes", "skill"):
            raise JobError("UNKNOWN_TARGET")
        plan = self.plan(book_id).first()
        if plan is None or plan.digest != digest:
            raise JobError("PLAN_CHANGED")
        jobs = self.jobs()
        job = jobs.start(book_id, target, idempotency_key or digest, plan.total_chapters, planned_at)
        if jobs.get(job).status not in DONE:
            chapters = self.tables["chapters"].read().where(F.col("book_id") == book_id).select(F.col("chapter_index").alias("chapter"))
            jobs.run(job, chapters, lambda some: self.analyze(book_id, only=some), step)
        state = jobs.get(job).status
        if state != "COMPLETED":
            return state, None
        return state, self.forge_notes(book_id) if target == "notes" else self.forge_skill(book_id)

    def jobs(self) -> Jobs:
        return Jobs(self.spark, f"{self.root}/jobs", datetime.now)

    def faults(self) -> DataFrame:
        """(book_id, fault, n) of what doesn't fit together in the library's tables."""
        books, chapters, analyses = (self.tables[t].read() for t in ("books", "chapters", "analyses"))
        own = analyses.where(F.col("source_system") == SYSTEM).select(F.col("external_book_id").alias("book_id"), "chapter_index")
        return integrity.faults(books.select("book_id", "total_chapters"), chapters.select("book_id", "chapter_index"), own, chapters.select("book_id", "chapter_index").where("false"))

    def doctor(self) -> list[tuple[str, str]]:
        """(check, PASS, WARN or FAIL) of what a run needs."""
        have = lambda m: "PASS" if importlib.util.find_spec(m) else "WARN"
        out = [("configuration", "PASS"), *((f"module {m}", have(m)) for m in ("yaml", "pyarrow", "pandas"))]
        for name, t in self.tables.items():
            want = {"books": BOOKS, "chapters": CHAPTERS, "analyses": CACHE}[name]
            out.append((f"table {name}", "FAIL" if integrity.missing_columns(t.read(), want) else "PASS"))
        wrong = {r.fault: r.n for r in self.faults().groupBy("fault").agg(F.count("*").alias("n")).collect()}
        out += [(f"library: {f}", "FAIL" if wrong.get(f) else "PASS") for f in integrity.FAULTS]
        try:
            self.provider()
            out.append(("provider", "PASS"))
        except Exception:
            out.append(("provider", "FAIL"))
        return out
