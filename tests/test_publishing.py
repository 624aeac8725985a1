"""Versioned tables, generations, manifests and ownership, with a crash between every two steps."""

import json

import pytest

from vellumlake.operators import library
from vellumlake.operators.pointer import Files, Pointer
from vellumlake.operators.publish import MANIFEST, MARKER, PublishError, Publisher, manifest_of, parse_manifest


class Crash(Exception):
    pass


def crashing(monkeypatch, at):
    """From now on the at-th change of a file fails before it happens; gives how many there were."""
    done = [0]
    for name in ("put", "delete", "rename"):

        def wrap(self, *a, own=getattr(Files, name)):
            done[0] += 1
            if done[0] == at:
                raise Crash
            return own(self, *a)

        monkeypatch.setattr(Files, name, wrap)
    return done


def values(t):
    return sorted(r.x for r in t.read().collect())


def test_no_crash_loses_a_version(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(n,)], "x int")
    t = library.Table(spark, str(tmp_path / "t"))
    assert t.version() is None
    last = t.write(rows(0))
    for at in range(1, 9):
        with pytest.MonkeyPatch.context() as m:
            crashing(m, at)
            try:
                t.write(rows(at), owner=last)
            except Crash:
                pass
        assert t.version() is not None and values(t) in ([at], [at - 1])
        if values(t) != [at]:
            t.write(rows(at), owner=last)
        last = t.version()
    assert values(t) == [8]


def test_one_writer_wins(spark, tmp_path, monkeypatch):
    rows = lambda n: spark.createDataFrame([(n,)], "x int")
    t = library.Table(spark, str(tmp_path / "t"))
    first = t.write(rows(0))
    with pytest.raises(RuntimeError):
        t.write(rows(1))  # made from no version
    # both have read version one; the second comes while the first is about to name its own
    other, advance = library.Table(spark, str(tmp_path / "t")), Pointer.advance

    def late(self, number, text):
        monkeypatch.setattr(Pointer, "advance", advance)
        other.write(rows(2), owner=first)
        return advance(self, number, text)

    monkeypatch.setattr(Pointer, "advance", late)
    with pytest.raises(RuntimeError):
        t.write(rows(3), owner=first)
    assert values(t) == [2] and not [n for n in t.files.names(f"{t.path}/_versions") if not n.isdigit() and not n.startswith(".")]
    # where there are no links
    monkeypatch.setattr(Files, "local", lambda self, path: None)
    t.write(rows(4), owner=t.version())
    assert values(t) == [4] and not t.pointer.advance(1, "x") and values(t) == [4]


def bundle(spark, **files):
    return spark.createDataFrame([(k.replace("_", "/"), bytearray(v.encode())) for k, v in files.items()], "path string, content binary")


def content(p, book="b"):
    return {r.path: bytes(r.content).decode() for r in p.files(book).collect()}


def test_no_crash_loses_a_generation(spark, tmp_path):
    p = Publisher(spark, str(tmp_path / "p"))
    p.publish("b", bundle(spark, a="0"))
    for at in range(1, 8):
        with pytest.MonkeyPatch.context() as m:
            crashing(m, at)
            try:
                p.publish("b", bundle(spark, a=str(at), c_d=str(at)))
            except Crash:
                pass
        assert content(p)["a"] in (str(at), str(at - 1))
        p.publish("b", bundle(spark, a=str(at), c_d=str(at)))
        assert content(p) == {"a": str(at), "c/d": str(at)}


def test_install_never_leaves_nothing(spark, tmp_path):
    p = Publisher(spark, str(tmp_path / "p"))
    target = str(tmp_path / "out/own")
    p.publish("b", bundle(spark, a="1"))
    p.install("b", target)
    p.publish("b", bundle(spark, a="2"))
    for at in range(1, 6):
        with pytest.MonkeyPatch.context() as m:
            crashing(m, at)
            try:
                p.install("b", target)
            except Crash:
                pass
        whole = [n for n in p.io.names(str(tmp_path / "out")) if MARKER in p.io.names(f"{tmp_path}/out/{n}")]
        assert whole
    p.install("b", target)
    assert p.io.names(str(tmp_path / "out")) == ["own"] and p.io.get(f"{target}/a") == b"2"


def test_what_others_wrote_stays(spark, tmp_path):
    p = Publisher(spark, str(tmp_path / "p"))
    g, _ = p.publish("b", bundle(spark, a="1", n_x="note"))
    assert [f["path"] for f in p.manifest("b")["files"]] == ["a", "n/x"]
    home = tmp_path / "p/b" / g
    (home / "n/mine.md").write_text("my own")
    assert {r.path: r.action for r in p.plan("b", bundle(spark, a="2")).collect()} == {"a": "write", "n/x": "remove", "n/mine.md": "keep"}
    p.publish("b", bundle(spark, a="2"))
    assert content(p) == {"a": "2", "n/mine.md": "my own"} and [f["path"] for f in p.manifest("b")["files"]] == ["a"]
    # a file that was changed since, and one that isn't owned, stop an update that would touch them
    home = tmp_path / "p/b" / p.active("b")
    (home / "a").write_text("edited")
    with pytest.raises(PublishError, match="OUTPUT_CONFLICT"):
        p.publish("b", bundle(spark, a="3"))
    assert content(p)["a"] == "edited"
    (home / "a").write_text("2")
    with pytest.raises(PublishError, match="OUTPUT_CONFLICT"):
        p.publish("b", bundle(spark, a="3", n_mine="x").replace("n/mine", "n/mine.md", subset=["path"]))
    with pytest.raises(PublishError, match="UNSAFE_BUNDLE"):
        p.publish("b", bundle(spark, a="3").replace("a", MANIFEST, subset=["path"]))
    books = spark.createDataFrame([("b",), ("c",)], "book_id string")
    assert sorted((r.book_id, r.n_files) for r in p.status(books).collect()) == [("b", 1), ("c", None)]
    (home / MANIFEST).write_bytes((home / MANIFEST).read_bytes().replace(b'"schema":1', b'"schema":2'))
    with pytest.raises(PublishError, match="INVALID_MANIFEST"):
        p.publish("b", bundle(spark, a="3"))


def test_manifests():
    data = manifest_of("b", [("y", b"2"), ("x", b"1")])
    assert [f["path"] for f in parse_manifest(data)["files"]] == ["x", "y"]
    x = json.loads(data)
    signed = lambda **more: manifest_like(x | more)
    assert parse_manifest(signed()) is not None
    assert parse_manifest(signed(files=x["files"][::-1])) is None  # order
    assert parse_manifest(signed(files=[x["files"][0]] * 2)) is None
    assert parse_manifest(signed(files=[x["files"][0] | {"path": "../x"}])) is None
    assert parse_manifest(signed(files=[x["files"][0] | {"sha256": "x"}])) is None
    assert parse_manifest(signed(more=1)) is None and parse_manifest(signed(schema=2)) is None and parse_manifest(signed(files=[1])) is None
    assert parse_manifest(data + b"\n") is None and parse_manifest(b"\xff") is None and parse_manifest(b"[]") is None
    assert parse_manifest(data.replace(b'{"book":"b",', b'{"book":"a","book":"b",')) is None
    assert parse_manifest(json.dumps(x | {"checksum": "0" * 64}, sort_keys=True, separators=(",", ":")).encode()) is None


def manifest_like(x):
    import hashlib

    dump = lambda y: json.dumps(y, sort_keys=True, separators=(",", ":")).encode()
    x = {k: v for k, v in x.items() if k != "checksum"}
    return dump(x | {"checksum": hashlib.sha256(dump(x)).hexdigest()})
