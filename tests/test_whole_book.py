"""A whole book: a confirmed plan, a job, publishing; and what a second publishing keeps."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_library import book

from vellumlake.operators import bundles
from vellumlake.operators.publish import PublishError
from vellumlake.plans.jobs import JobError
from vellumlake.service import VAULT_MANIFEST, Service


def flaky(flag):
    """Makes providers that fail on the chapter whose text is in the file `flag`."""
    from vellumlake.operators.analysis import LocalProvider

    class Flaky(LocalProvider):
        def generate(self, system, user):
            import os

            if os.path.exists(flag) and open(flag).read() in user:
                raise RuntimeError("down")
            got = super().generate(system, user)
            return got | {"concepts": [{"term": "Term", "definition": got["core_idea"]}]}

    return Flaky


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.epub").write_bytes(book())
    s = Service(spark, str(tmp_path / "lib"), flaky(str(tmp_path / "flag")))
    return s, s.import_path(str(tmp_path / "in")).first().book_id


def test_confirmed_plan_to_publishing(library):
    s, b = library
    plan = s.plan(b).first()
    with pytest.raises(JobError, match="PLAN_CHANGED"):
        s.forge(b, "notes", "0" * 64, plan.created_at)
    with pytest.raises(JobError, match="PLAN_EXPIRED"):
        s.forge(b, "notes", plan.digest, datetime.now() - timedelta(hours=2))
    with pytest.raises(JobError, match="UNKNOWN_TARGET"):
        s.forge(b, "other", plan.digest, datetime.now())
    state, (generation, changed) = s.forge(b, "notes", plan.digest, datetime.now(), "key", step=1)
    assert state == "COMPLETED" and changed and s.tables["analyses"].read().count() == 2
    # the same key is the same job: nothing is asked or written again
    asked = s.log.read().count()
    assert s.forge(b, "notes", plan.digest, datetime.now(), "key") == ("COMPLETED", (generation, False))
    assert s.log.read().count() == asked == 2
    jobs = s.jobs()
    assert jobs.progress(f"{b}-notes-key") == 1.0


def test_manifest_and_history(spark, tmp_path, library):
    s, b = library
    s.forge_notes(b)
    s.forge_skill(b)
    files = lambda p: {r.path: bytes(r.content).decode() for r in p.files(b).collect()}
    notes, skill = files(s.notes), files(s.skills)
    manifest = json.loads(notes[VAULT_MANIFEST])
    named = {manifest["moc_path"], *(c["note_path"] for c in manifest["chapters"]), *(c["path"] for c in manifest["cards"])}
    assert named == set(notes) - {VAULT_MANIFEST} and len(manifest["cards"]) == 2
    m = spark.createDataFrame([(b, notes[VAULT_MANIFEST])], "book_key string, t string").select("book_key", bundles.parsed_manifest(F.col("t")).alias("m"))
    assert m.where("m is null").count() == 0 and bundles.manifest_faults(m).count() == 0

    # the second chapter and its title change, and the model fails on it: its note, card and file stay as they were
    chapters = s.tables["chapters"]
    changed = chapters.read().withColumn("content", F.when(F.col("chapter_index") == 1, "Entirely new").otherwise(F.col("content")))
    changed = changed.withColumn("title", F.when(F.col("chapter_index") == 1, "Renamed").otherwise(F.col("title")))
    chapters.write(changed, owner=chapters.version())
    (tmp_path / "flag").write_text("Entirely new")
    s.forge_notes(b)
    s.forge_skill(b)
    assert files(s.notes) == notes and files(s.skills) == skill

    # once it works, the content changes and the names don't
    (tmp_path / "flag").unlink()
    s.forge_notes(b)
    s.forge_skill(b)
    now = files(s.notes)
    cards = {p for p in notes if p.startswith(s.config.cards_folder)}
    assert {p for p in now if "Chapters/" in p} == {p for p in notes if "Chapters/" in p} and "Renamed" in now["Books/Chapters/0002 Chapter 2.md"]
    assert len({p for p in now if p.startswith(s.config.cards_folder)} & cards) == 1 and set(files(s.skills)) == set(skill)


def test_an_unsafe_manifest_stops_publishing(spark, library, monkeypatch):
    s, b = library
    good = s.note_files(b)
    bad = good.withColumn("content", F.when(F.col("path") == VAULT_MANIFEST, F.lit("{}").cast("binary")).otherwise(F.col("content")))
    monkeypatch.setattr(s, "note_files", lambda _: bad)
    with pytest.raises(PublishError, match="INVALID_MANIFEST"):
        s.forge_notes(b)
    assert s.notes.active(b) is None
