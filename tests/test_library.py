"""Library tables, analysis, bundles, jobs, sources and streaming."""

import hashlib
import io
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellumlake.operators import aggregate, analysis, bundles, library, render
from vellumlake.plans import calls
from vellumlake.plans.jobs import JobError, Jobs
from vellumlake.sources import binary, config, epub, pdf

SNAP = "source_system string, external_book_id string, chapter_index int, input_fingerprint string, title string, content string"


def test_versions(spark, tmp_path):
    t = library.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    first = t.write(spark.range(3))
    assert t.read().count() == 3
    t.write(spark.range(5), owner=first)
    assert t.read().count() == 5
    with pytest.raises(RuntimeError):
        t.write(spark.range(9), owner=first)
    assert t.read().count() == 5


def test_import_is_idempotent(spark):
    schema = "book_id string, format string, source_fingerprint string, mode string, created_at int"
    old = spark.createDataFrame([("a", "epub", "f", "COPY", 1)], schema)
    new = spark.createDataFrame([("b", "epub", "f", "REFERENCE", 2), ("c", "pdf", "f", "COPY", 2), ("d", "pdf", "f", "COPY", 3)], schema)
    assert sorted(r.book_id for r in library.import_books(old, new).collect()) == ["a", "c"]


def test_cache_key(spark):
    df = spark.createDataFrame([("s", "b", 0, "a" * 64), ("", "b", 0, "a" * 64), ("s", "b", 5000, "a" * 64), ("s", "b", 0, "A" * 64), (None, "b", 0, "a" * 64)], "s string, b string, i int, f string")
    assert [r[0] for r in df.select(library.valid_cache_key(*(F.col(c) for c in "sbif"))).collect()] == [True, False, False, False, False]


def test_analyze(spark, tmp_path):
    class Flaky:
        """Fails as its text says, and counts on a file what it was asked."""

        def __init__(self, log):
            self.log = log

        def generate(self, system, user):
            with open(self.log, "a") as f:
                f.write("x")
            if "auth" in user:
                raise analysis.ModelError("MODEL_AUTH_FAILED")
            if "broken" in user:
                return "{"
            if "extra" in user:
                return {"core_idea": "x", "more": 1}
            if "boom" in user:
                raise KeyError("x")
            return analysis.LocalProvider().generate(system, user)

    log = str(tmp_path / "log")
    rows = [("s", "b", i, f"f{i}", "t", c) for i, c in enumerate(["hello\nworld", "auth", "broken", "extra", "boom", "long " * 100])]
    snaps = spark.createDataFrame([*rows, rows[0]], SNAP)
    cache = spark.createDataFrame([("s", "b", 5, "f5", None), ("s", "b", 0, "old", None)], f"source_system string, external_book_id string, chapter_index int, input_fingerprint string, analysis {analysis.SCHEMA}")
    answers = calls.CallLog(spark, str(tmp_path / "calls"))
    hits, made = calls.analyze(snaps, cache, lambda: Flaky(log), answers, most=24_000)
    assert [r.chapter_index for r in hits.collect()] == [5]
    got = {r.chapter_index: r for r in made.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert got[0].analysis.core_idea == "hello" and got[0].analysis.frameworks == [] and got[0].error is None
    assert [got[i].error.code for i in (1, 2, 3, 4)] == ["MODEL_AUTH_FAILED", "MODEL_OUTPUT_INVALID", "MODEL_OUTPUT_INVALID", "MODEL_UNAVAILABLE"]
    assert got[4].error.retryable and len(open(log).read()) == 1 + 1 + 2 + 2 + 1
    calls.analyze(snaps, cache, lambda: Flaky(log), answers)[1].collect()
    assert len(open(log).read()) == 7 + 1  # only the error that may go by is asked for again
    _, forced = calls.analyze(snaps, cache, analysis.LocalProvider, calls.CallLog(spark, str(tmp_path / "forced")), most=128, force=True)
    assert {r.chapter_index: r.error for r in forced.collect()} == dict.fromkeys(range(6))


def test_validation():
    assert analysis.valid({"core_idea": "x"}) and analysis.valid({"core_idea": "x", "concepts": [{"term": "t", "definition": "d", "evidence_refs": []}]})
    for bad in ({}, {"core_idea": 1}, {"core_idea": " "}, {"core_idea": "x", "more": []}, {"core_idea": "x", "key_takeaways": "x"}, {"core_idea": "x", "concepts": [{"definition": "d"}]}, []):
        assert not analysis.valid(bad)


def test_update_plan(spark):
    f = lambda **x: spark.createDataFrame([("b", k, bytearray(v.encode())) for k, v in x.items()], "book string, path string, content binary")
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    old, new = f(a="1", b="2", c="3", mine="m", edited="changed"), f(a="1", b="9", d="4", edited="new")
    assert {r.path: r.action for r in bundles.update_plan(old, new).collect()} == {"a": "keep", "b": "write", "c": "remove", "d": "write", "mine": "remove", "edited": "write"}
    managed = spark.createDataFrame([("b", "a", sha("1")), ("b", "b", sha("2")), ("b", "c", sha("3")), ("b", "edited", sha("e"))], "book string, path string, sha256 string")
    assert {r.path: r.action for r in bundles.update_plan(old, new, managed).collect()} == {"a": "keep", "b": "write", "c": "remove", "d": "write", "mine": "keep", "edited": "conflict"}


def test_envelope(spark):
    df = spark.createDataFrame([("k" * 16, 3, "f", "s", "body\nx")], "k string, c int, f string, s string, b string")
    df = df.withColumn("note", render.frontmatter("chapter", *(F.col(c) for c in "kcfsb")))
    e = df.select(bundles.parse_envelope(F.col("note"), render.PREFIX).alias("e")).first().e
    assert (e.kind, e.book_key, e.chapter_index, e.body, e.intact) == ("chapter", "k" * 16, "3", "body\nx", True)
    e = df.select(bundles.parse_envelope(F.concat("note", F.lit("!")), render.PREFIX).alias("e")).first().e
    assert not e.intact


def test_rate_window(spark):
    rows = [("r", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 59)] + [("r", datetime(2024, 1, 1, 0, 1, 0))]
    df = aggregate.rate_audit(spark.createDataFrame(rows, "route string, at timestamp"), "route", "at", most=2)
    assert [(r.in_window, r.over) for r in df.orderBy("at").collect()] == [(1, False), (2, False), (3, True), (3, True)]


def test_missing(spark):
    have = spark.createDataFrame([("b", 0)], "book string, chapter int")
    got = aggregate.missing_chapters(have, spark.createDataFrame([("b", 5000), ("c", 0)], "book string, total int")).collect()
    got = {r.book: r.missing for r in got}
    assert got["c"] == [] and len(got["b"]) == 101 and got["b"][0] == "02" and got["b"][-1] == "4,899 additional unprocessed chapters."


def test_jobs(spark, tmp_path):
    now = datetime(2024, 1, 1)
    jobs = Jobs(spark, str(tmp_path), lambda: now)
    with pytest.raises(JobError, match="PLAN_EXPIRED"):
        jobs.start("b", "skill", "k", 5, now - timedelta(minutes=30))
    job = jobs.start("b", "skill", "k", 5, now)
    assert jobs.start("b", "skill", "k", 5, now) == job
    with pytest.raises(JobError, match="JOB_CONFLICT"):
        jobs.start("b", "skill", "other", 5, now)
    chapters = spark.createDataFrame([(i,) for i in range(5)], "chapter int")
    seen = []

    def step(df):
        seen.extend(r.chapter for r in df.collect())
        if len(seen) == 2:
            jobs.control(job, "PAUSE")
        if 3 in seen and "failed" not in seen:
            seen.append("failed")
            raise OSError

    assert jobs.run(job, chapters, step, 2) == "PAUSED" and jobs.progress(job) == 0.4
    jobs.control(job, "RESUME")
    with pytest.raises(OSError):
        jobs.run(job, chapters, step, 2)
    assert jobs.get(job).status == "FAILED"
    again = Jobs(spark, str(tmp_path), lambda: now)
    again.control(job, "RESUME")
    assert again.run(job, chapters, step, 2) == "COMPLETED" and again.progress(job) == 1.0
    with pytest.raises(JobError):
        again.control(job, "CANCEL")
    with pytest.raises(JobError, match="JOB_NOT_FOUND"):
        again.get("none")


def book(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", more.pop("opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> T  x</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="e" href="e.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n" linear="no"/><itemref idref="e"/><itemref idref="a"/><itemref idref="c"/></spine></package>'))
        z.writestr("O/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><a href="a%20b.xhtml#x">First</a><a href="a%20b.xhtml">Second</a></nav></body></html>')
        z.writestr("O/a b.xhtml", "<html><body><h1>Head</h1><p>Text</p></body></html>")
        z.writestr("O/e.xhtml", "<html><body></body></html>")
        z.writestr("O/c.xhtml", "<html><body><p>More</p></body></html>")
        for k, v in more.items():
            z.writestr(k, v)
    return out.getvalue()


def make_pdf(pages, outline=(), title="Book"):
    objs = {1: "<< /Type /Catalog /Pages 2 0 R" + (" /Outlines 900 0 R" if outline else "") + " >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(pages)))}] /Count {len(pages)} >>", 3: f"<< /Title ({title}) /Author (Me) >>"}
    for i, rows in enumerate(pages):
        s = "BT /F1 12 Tf " + " ".join(f"1 0 0 1 72 {y} Tm ({t}) Tj" for y, t in rows) + " ET"
        objs[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {11 + 2 * i} 0 R >>"
        objs[11 + 2 * i] = f"<< /Length {len(s)} >>\nstream\n{s}\nendstream"
    if outline:
        objs[900] = "<< /First 901 0 R >>"
        for n, (t, p) in enumerate(outline):
            objs[901 + n] = f"<< /Title ({t}) /Dest [{10 + 2 * p} 0 R /Fit]" + (f" /Next {902 + n} 0 R" if n + 1 < len(outline) else "") + " >>"
    body = "".join(f"{k} 0 obj\n{v}\nendobj\n" for k, v in objs.items())
    return f"%PDF-1.4\n{body}trailer\n<< /Root 1 0 R /Info 3 0 R >>\nstartxref\n0\n%%EOF".encode("latin-1")


def test_files_and_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(book())
    (tmp_path / "b.txt").write_bytes(b"PK\x03\x04")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    (tmp_path / "large.epub").write_bytes(b"PK\x03\x04" + bytes(20_000))
    f = binary.files(spark, str(tmp_path), most=10_000)
    assert {r.path.rsplit("/")[-1]: (r.format, r.error) for r in f.collect()} == {"a.epub": ("epub", None), "b.txt": (None, "UNSUPPORTED_FORMAT"), "c.pdf": (None, "UNSUPPORTED_FORMAT"), "large.epub": (None, "EXTRACTION_FAILED")}
    got = epub.chapters(f.where("error is null")).orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.chapter_title, r.content, r.source_locator, r.title, r.author) for r in got] == [(0, "First", "# Head\n\nText", "epub:O/a b.xhtml", "T x", "A"), (1, "Chapter 2", "More", "epub:O/c.xhtml", "T x", "A")]
    before = f.where("error is null").select("path", "fingerprint")
    assert binary.changed(before, before).count() == 0
    assert binary.changed(before, before.limit(0)).count() == 1


@pytest.mark.parametrize("more", [{"../x": "1"}, {"/abs": "1"}, {"a\\b": "1"}, {"x.zip": "1"}, {"deep": b"PK\x03\x04xx"}, {"big": "0" * 3_000_000}, {"O/A B.XHTML": "1"}, {"opf": '<!DOCTYPE x [<!ENTITY a "b">]><package/>'}])
def test_hostile_epubs(more):
    with pytest.raises(Exception):  # noqa: B017
        epub.read(book(**more))


def test_pdf(spark):
    pages = [[(770, "Header"), (400, f"Body {i} of text"), (380, "more"), (20, f"{i + 1}")] for i in range(5)]
    books = [("a", "f", bytearray(make_pdf(pages, [("Opening", 0), ("Dup", 0), ("Two", 2), ("Back", 1)]))), ("b", "f", bytearray(make_pdf([[(400, "Only text here")]] * 22))), ("c", "f", bytearray(make_pdf([[(400, "Page 1 of 2")]]))), ("d", "f", bytearray(b"%PDF-1.4 /Encrypt")), ("e", "f", bytearray(b"%PDF-"))]
    rows = pdf.page_rows(spark.createDataFrame(books, "path string, fingerprint string, content binary")).cache()
    got = {}
    for r in pdf.chapters(rows).collect():
        got.setdefault(r.book, []).append((r["index"], r.title, r.source_locator, r.content, r.error))
    a = sorted(got["a"])
    assert [x[:3] for x in a] == [(0, "Opening", "pdf:pages:1-2"), (1, "Two", "pdf:pages:3-5")]
    assert a[0][3] == "Body 0 of text\nmore\n\nBody 1 of text\nmore"
    assert [x[2] for x in sorted(got["b"])] == ["pdf:pages:1-20", "pdf:pages:21-22"]
    assert [got[k][0][4] for k in "cde"] == ["OCR_REQUIRED", "ENCRYPTED_DOCUMENT", "EXTRACTION_FAILED"]
    first = rows.where("path = 'a' and page = 0").first()
    assert (first.title, first.author, first.pages) == ("Book", "Me", 5)


def test_config():
    assert config.from_mapping({"analysis": {"max_chunk_characters": 500}}).analysis.max_chunk_characters == 500
    for bad in ([], {"x": 1}, {"analysis": {"max_chunk_characters": 1}}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)


def test_stream(spark, tmp_path):
    from vellumlake.streaming.ingest import ingest, snapshots

    schema = "source_system string, external_book_id string, chapter_index int, fingerprint string, updated_at timestamp, content string"
    row = lambda i, f, at, c: f'{{"source_system":"s","external_book_id":"b","chapter_index":{i},"fingerprint":"{f}","updated_at":"2024-01-01T00:0{at}:00","content":"{c}"}}\n'
    (tmp_path / "in").mkdir()
    run = lambda: ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/1.json").write_text(row(0, "a", 1, "one") + row(1, "b", 1, "two") + row(0, "a", 1, "one"))
    run()
    (tmp_path / "in/2.json").write_text(row(0, "c", 2, "new") + row(1, "z", 0, "old"))
    run()
    got = snapshots(spark, str(tmp_path / "t")).orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.content) for r in got] == [(0, "new"), (1, "two")]
    # what is written follows what is new: three rows so far; a repeated, an older and a broken row add none
    log = lambda: sorted((r.chapter_index, r.fingerprint) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert log() == [(0, "a"), (0, "c"), (1, "b")]
    (tmp_path / "in/3.json").write_text(row(0, "c", 2, "new") + row(0, "b", 2, "tie below") + row(1, "y", 0, "older") + '{"source_system":"s","chapter_index":1}\n')
    run()
    assert log() == [(0, "a"), (0, "c"), (1, "b")]
    (tmp_path / "in/4.json").write_text(row(0, "d", 2, "tie above") + row(2, "n", 5, "third"))
    run()
    assert [(r.chapter_index, r.content) for r in snapshots(spark, str(tmp_path / "t")).orderBy("chapter_index").collect()] == [(0, "tie above"), (1, "two"), (2, "third")]


def test_service(spark, tmp_path):
    from vellumlake.operators.publish import PublishError, Publisher
    from vellumlake.service import Service

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.epub").write_bytes(book())
    (tmp_path / "in/b.pdf").write_bytes(make_pdf([[(400, "Some text of a page")], [(400, "And more text")]]))
    (tmp_path / "in/bad.epub").write_bytes(b"PK\x03\x04")
    s = Service(spark, str(tmp_path / "lib"))
    got = {r.path.rsplit("/")[-1]: (r.book_id, r.error) for r in s.import_path(str(tmp_path / "in")).collect()}
    assert got["bad.epub"] == (None, "EXTRACTION_FAILED") and got["a.epub"][0] and got["b.pdf"][0]
    s.import_path(str(tmp_path / "in"), "COPY")
    assert sorted((r.title, r.total_chapters, r["mode"]) for r in s.list_books().collect()) == [("Book", 1, "REFERENCE"), ("T x", 2, "REFERENCE")]
    a = got["a.epub"][0]
    assert s.get_book(a).count() == 1 and s.get_chapter(a, 1).first().content == "More"
    assert s.plan(a).first().pending_chapters == 2
    first = {r.chapter_index: (r.cache_hit, r.error) for r in s.analyze(a).collect()}
    assert first == {0: (False, None), 1: (False, None)}
    assert all(r.cache_hit for r in s.analyze(a).collect())
    assert s.plan(a).first().pending_chapters == 0
    generation, changed = s.forge_notes(a)
    assert changed and s.forge_notes(a) == (generation, False)
    notes = {r.path: bytes(r.content).decode() for r in s.notes.files(a).collect()}
    assert sorted(notes) == ["Books/Chapters/0001 First.md", "Books/Chapters/0002 Chapter 2.md", "Books/T x MOC.md", "vault-manifest.json"]
    assert "- Rendered: 2 / known total: 2." in notes["Books/T x MOC.md"] and "[01 First](Chapters/0001%20First.md)" in notes["Books/T x MOC.md"]
    s.forge_skill(a)
    assert {"SKILL.md", "patterns.md", "cheatsheet.md", "agents/openai.yaml", "chapters/index.md", "glossary.md", "chapters/ch0001-first.md"} <= {r.path for r in s.skills.files(a).collect()}
    assert s.skills.active_books() == [a]
    s.skills.install(a, str(tmp_path / "installed"))
    s.skills.install(a, str(tmp_path / "installed"))
    (tmp_path / "foreign").mkdir()
    with pytest.raises(PublishError, match="INSTALL_CONFLICT"):
        s.skills.install(a, str(tmp_path / "foreign"))
    assert all(v != "FAIL" for _, v in s.doctor())
    p = Publisher(spark, str(tmp_path / "p"))
    files = lambda *x: spark.createDataFrame([(k, bytearray(v)) for k, v in x], "path string, content binary")
    with pytest.raises(PublishError, match="UNSAFE_BUNDLE"):
        p.publish("b", files(("../x", b"1")))
    g1, _ = p.publish("b", files(("x", b"1")))
    with pytest.raises(PublishError, match="SOURCE_CHANGED"):
        p.publish("b", files(("x", b"2")), expected="gen-other")
    p.publish("b", files(("x", b"2")), expected=g1)
    p.publish("b", files(("x", b"3")))
    assert sorted(n[:4] for n in p.io.names(str(tmp_path / "p/b")) if not n.startswith(".")) == ["_act", "gen-", "gen-"]


def test_cards(spark):
    a = spark.createDataFrame([("k", 0, "one line\nsecond one")], "book_key string, chapter int, t string").withColumn("analysis", analysis.extractive(F.col("t"), F.lit("en")))
    got = render.cards(a).withColumn("d", render.card_details(F.col("kind"), F.col("content"))).orderBy("kind", "pos").collect()
    assert [(r.kind, r.subject, r.ordinal) for r in got] == [("concept", "one", 1), ("concept", "second", 1), ("decision_rule", "one line", 1), ("decision_rule", "second one", 1)]
    assert got[0].d == "## Concept\none line\n\n## Evidence\n- None." and got[2].d == "## Decision rule\none line\n\n## Conditions\n- None.\n\n## Evidence\n- None."


def test_main_file_and_families(spark):
    a = spark.createDataFrame([("b", 0, "Alpha x\nBeta y"), ("b", 1, "Alpha z")], "book string, chapter int, t string").withColumn("analysis", analysis.extractive(F.col("t"), F.lit("en")))
    items = render.family_items(a, ("decision_rules", "rule"), ("key_takeaways", ""))
    assert [(r.chapter, r.pos, r.value, r.reserved) for r in items.where("chapter = 0").orderBy("pos").collect()] == [(0, 0, "Alpha x", True), (0, 1, "Beta y", False), (0, 2, "Alpha x", True), (0, 3, "Beta y", False)]
    chapters = F.array(F.struct(F.lit(0).alias("chapter"), F.lit("T").alias("title"), F.lit("chapters/ch0001-t.md").alias("path")))
    body = spark.range(1).select(render.skill_file(F.lit("s"), F.lit("Book (x)"), F.lit(""), F.lit(1), F.lit(0), F.array(F.lit("F1")), chapters).alias("o")).first().o
    assert body.startswith('---\nname: "s"\n') and "# Book \\(x\\)\n" in body and "- [Chapter 0001: T](chapters/ch0001-t.md)\n" in body and "known total: unknown." in body and "- F1\n" in body


def test_service_tells_of_chapters_that_failed(spark, tmp_path):
    from vellumlake.operators import analysis
    from vellumlake.service import Service

    class Failing(analysis.LocalProvider):
        """Its model fails on the book's last chapter."""

        def generate(self, system, user):
            if "More" in user:
                raise RuntimeError("down")
            return super().generate(system, user)

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.epub").write_bytes(book())
    s = Service(spark, str(tmp_path / "lib"), Failing)
    b = s.import_path(str(tmp_path / "in")).first().book_id
    notes = {r.path: bytes(r.content).decode() for r in s.note_files(b).collect()}
    map_ = notes["Books/T x MOC.md"]
    assert "- Rendered: 1 / known total: 2." in map_ and "## Unprocessed chapters\n- 02\n" in map_
    skill = {r.path: bytes(r.content).decode() for r in s.skill_files(b).collect()}
    assert "- Rendered chapters: 1 / known total: 2." in skill["SKILL.md"]
