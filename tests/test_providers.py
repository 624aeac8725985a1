"""Providers, limits and strict results; manifests whose parts don't fit; history."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from vellumlake.operators import analysis, bundles
from vellumlake.plans import calls, providers
from vellumlake.sources import config


@pytest.fixture()
def server():
    """A stub that answers with what `say` holds: (status, body) or a redirection."""

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            self.server.asked.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = self.server.say
            self.send_response(status)
            if status == 302:
                self.send_header("Location", "/elsewhere")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Stub)
    s.asked = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def made(server, kind=providers.OpenAI, **more):
    return kind(providers.Transport(providers.Gate(1000), 5, **more), f"http://127.0.0.1:{server.server_port}/v1/", "m", "secret")


def answer(text, reason="stop", **usage):
    return json.dumps({"choices": [{"finish_reason": reason, "message": {"content": text}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4} | usage}).encode()


def test_chat_completions(server):
    server.say = 200, answer('{"core_idea": "x"}')
    p = made(server)
    assert p.generate("s", "u") == {"core_idea": "x"}
    path, headers, body = server.asked[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer secret"
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and body["max_tokens"] == 4096
    assert p.usage == {"input_tokens": 3, "output_tokens": 4, "request_count": 1}


def test_messages(server):
    body = {"stop_reason": "end_turn", "content": [{"type": "text", "text": '{"core_'}, {"type": "text", "text": 'idea": "x"}'}], "usage": {"input_tokens": 1, "output_tokens": 2}}
    server.say = 200, json.dumps(body).encode()
    assert made(server, providers.Anthropic).generate("s", "u") == {"core_idea": "x"}
    assert server.asked[0][1]["X-Api-Key"] == "secret" and server.asked[0][2]["system"] == "s"
    server.say = 200, json.dumps(body | {"stop_reason": "max_tokens"}).encode()
    with pytest.raises(analysis.ModelError, match="MODEL_OUTPUT_INVALID"):
        made(server, providers.Anthropic).generate("s", "u")


@pytest.mark.parametrize("body", [b"no", b"[]", b"{}", answer("{}", "length"), answer('{"a": NaN}'), answer('{"a": 1, "a": 2}'), answer("[1]"), answer(" "), answer("{}", total_tokens=9), answer("{}", prompt_tokens=-1), answer("{}", prompt_tokens=True)])
def test_what_is_not_of_the_protocol(server, body):
    server.say = 200, body
    with pytest.raises(analysis.ModelError, match="MODEL_OUTPUT_INVALID"):
        made(server).generate("s", "u")


def test_usage_counts_before_the_answer_is_looked_at(server):
    server.say = 200, answer("{}", "length")
    p = made(server)
    with pytest.raises(analysis.ModelError):
        p.generate("s", "u")
    assert p.usage["request_count"] == 1 and p.usage["output_tokens"] == 4


@pytest.mark.parametrize("status, code, again", [(401, "MODEL_AUTH_FAILED", False), (403, "MODEL_AUTH_FAILED", False), (429, "RATE_LIMITED", True), (404, "MODEL_UNAVAILABLE", False), (302, "MODEL_UNAVAILABLE", False), (500, "MODEL_UNAVAILABLE", True), (503, "MODEL_UNAVAILABLE", True)])
def test_statuses(server, status, code, again):
    server.say = status, b""
    with pytest.raises(analysis.ModelError) as e:
        made(server).generate("s", "u")
    assert (e.value.code, e.value.retryable) == (code, again) and len(server.asked) == 1


def test_large_answers_and_no_server(server):
    server.say = 200, answer("{}")
    with pytest.raises(analysis.ModelError, match="MODEL_OUTPUT_INVALID"):
        made(server, most_bytes=20).generate("s", "u")
    gone = providers.OpenAI(providers.Transport(providers.Gate(9), 2), "http://127.0.0.1:9", "m")
    with pytest.raises(analysis.ModelError, match="MODEL_UNAVAILABLE"):
        gone.generate("s", "u")


def test_gate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    g = providers.Gate(2, lambda: now[0], sleep)
    at = []
    for _ in range(5):
        g.wait()
        at.append(now[0])
        now[0] += 1
    assert at == [0, 1, 60, 61, 120] and all(s > 0 for s in slept)
    with pytest.raises(ValueError):
        providers.Gate(0)


def test_registry_and_routes():
    assert providers.Registry().maker(config.Model()) is analysis.LocalProvider
    mine = providers.Registry({"mine": lambda: "made"})
    assert mine.maker(config.Model(provider="mine"))() == "made"
    made = providers.Registry().maker(config.Model(provider="anthropic", model="m", requests_per_minute=9, max_concurrency=4), "k")()
    assert made.base == "https://api.anthropic.com" and made.transport.gate.most == 2 and made.key == "k"
    assert providers.asking(config.Model()) is None and providers.asking(config.Model(provider="openai", requests_per_minute=1, max_concurrency=4)) == 1
    for bad in ({"openai": print}, {"local": print}):
        with pytest.raises(ValueError):
            providers.Registry(bad)
    for bad in (config.Model(provider="who"), config.Model(provider="openai_compatible")):
        with pytest.raises(ValueError):
            providers.Registry().maker(bad)
    with pytest.raises(ValueError):
        config.Model(requests_per_minute=0)
    assert providers.route("HTTPS://user:pw@Example.COM/v1//?q#f") == ("https", "example.com", 443, "/v1")
    assert providers.route("http://[2001:0DB8:0:0::1]:8080") == ("http", "2001:db8::1", 8080, "")


def test_routes_of_a_column(spark):
    df = spark.createDataFrame([(0, "http://[::0001]/a/"), (1, None), (2, "http://x:99999999/"), (3, "")], "i int, u string")
    got = {r.i: r.r for r in df.select("i", providers.routes(df.u).alias("r")).collect()}
    assert tuple(got[0]) == ("http", "::1", 80, "/a") and got[1] is None and got[2] is None and tuple(got[3]) == ("", "", None, "")


def test_results_keep_to_lengths_and_needed_fields():
    fine = {"core_idea": "x", "anti_patterns": [{"name": "a", "why": "b"}], "frameworks": [{"name": "f"}], "evidence_refs": [{"locator": "l"}]}
    assert analysis.valid(fine)
    for bad in (
        {"core_idea": "x" * 4001}, {"core_idea": "x", "anti_patterns": [{"name": "a"}]}, {"core_idea": "x", "concepts": [{"term": "t"}]},
        {"core_idea": "x", "frameworks": [{"name": "n" * 201}]}, {"core_idea": "x", "quality_warnings": [{"code": "c", "message": ""}]},
        {"core_idea": "x", "concepts": [{"term": "t", "definition": "d", "evidence_refs": [{"locator": ""}]}]},
    ):
        assert not analysis.valid(bad)
    for bad in ('{"a": 1, "a": 1}', "[]", '{"a": Infinity}', b'{"a": "\xff"}'):
        with pytest.raises(ValueError):
            analysis.loaded(bad)


def test_errors_say_whether_to_try_again(spark, tmp_path):
    class Refusing(analysis.LocalProvider):
        def generate(self, system, user):
            raise providers.failure(404 if "first" in user else 503)

    rows = spark.createDataFrame([("s", "b", 0, "f0", "t", "first"), ("s", "b", 1, "f1", "t", "second")], "source_system string, external_book_id string, chapter_index int, input_fingerprint string, title string, content string")
    got = {r.chapter_index: r.error for r in calls.analyses(rows, Refusing, calls.CallLog(spark, str(tmp_path / "log")), lanes=1).collect()}
    assert not got[0].retryable and got[1].retryable and got[0].code == got[1].code == "MODEL_UNAVAILABLE"


def manifest(**change):
    card = {"chapter_index": 0, "kind": "concept", "path": "Cards/a.md", "stable_id": "a" * 16, "title": "A"}
    chapter = {"card_paths": ["Cards/a.md"], "frameworks": [], "index": 0, "input_fingerprint": "f" * 64, "note_path": "Books/B/Chapters/1.md", "title": "C", "topics": []}
    return {"book_directory": "Books/B", "book_key": "k", "book_title": "B", "cards": [card], "chapters": [chapter], "checksum": "", "moc_path": "Books/B/MOC.md", "schema": 1, "total_chapters": 1} | change


def test_manifest_faults(spark):
    one = manifest()
    card, chapter = one["cards"][0], one["chapters"][0]
    cases = {
        "fine": (one, set()),
        "empty": (manifest(cards=[], chapters=[], total_chapters=0), set()),
        "moc elsewhere": (manifest(moc_path="Other/MOC.md"), {"PATH"}),
        "note elsewhere": (manifest(chapters=[chapter | {"note_path": "Books/C/1.md"}]), {"PATH"}),
        "climbing": (manifest(cards=[card | {"path": "../a.md"}], chapters=[chapter | {"card_paths": ["../a.md"]}]), {"PATH"}),
        "total": (manifest(total_chapters=0), {"INDEX"}),
        "twice": (manifest(chapters=[chapter, chapter | {"card_paths": [], "note_path": "Books/B/Chapters/2.md"}]), {"INDEX"}),
        "no chapter": (manifest(cards=[card | {"chapter_index": 3}]), {"CHAPTER", "LISTED", "CARD"}),
        "listed twice": (manifest(chapters=[chapter | {"card_paths": ["Cards/a.md"] * 2}]), {"LISTED"}),
        "not listed": (manifest(chapters=[chapter | {"card_paths": []}]), {"CARD"}),
    }
    rows = spark.createDataFrame([(name, m) for name, (m, _) in cases.items()], f"book_key string, m {bundles.VAULT}")
    got = {}
    for r in bundles.manifest_faults(rows).collect():
        got.setdefault(r.book_key, set()).add(r.fault)
    assert got == {name: want for name, (_, want) in cases.items() if want}


def test_manifests_come_back_only_as_they_were(spark):
    one = manifest()
    books = spark.createDataFrame([("k", "B “é”\n", "Books/B", "Books/B/MOC.md", 0), ("j", "J", "Books/J", "Books/J/MOC.md", 7)], "book_key string, book_title string, book_directory string, moc_path string, total_chapters int")
    chapters = spark.createDataFrame([("k", *(one["chapters"][0][n] for n in ("frameworks", "index", "input_fingerprint", "note_path", "title", "topics")))], "book_key string, frameworks array<string>, index int, input_fingerprint string, note_path string, title string, topics array<string>")
    cards = spark.createDataFrame([("k", *one["cards"][0].values())], "book_key string, chapter_index int, kind string, path string, stable_id string, title string")
    made = {r.book_key: r.manifest for r in bundles.vault_manifest(books, chapters, cards).collect()}
    m = json.loads(made["k"])
    assert m["chapters"] == one["chapters"] and m["cards"] == one["cards"] and m["total_chapters"] == 1 and json.loads(made["j"])["total_chapters"] == 7
    assert made["k"] == json.dumps(m, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    texts = [made["k"], made["k"] + " ", made["k"].replace('"total_chapters":1', '"total_chapters":2'), made["k"].replace('"schema":1', '"schema":1,"schema":1'), made["k"].replace('"title":"C"', '"title":"C","x":1'), "", "{}", "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", bundles.parsed_manifest(df.t).alias("m")).orderBy("i").collect()
    assert [r.m is not None for r in got] == [True] + [False] * 8


def test_cards_of_history(spark):
    row = "book_key string, chapter_index int, stable_id string, v int"
    old = spark.createDataFrame([("k", 0, "a", 1), ("k", 1, "b", 1), ("k", 2, "c", 1)], row)
    new = spark.createDataFrame([("k", 1, "d", 2), ("k", 1, "c", 2)], row)
    rendered = spark.createDataFrame([("k", 1)], "book_key string, index int")
    got = {(r.stable_id, r.chapter_index, r.v) for r in bundles.merged_cards(old, new, rendered).select("stable_id", "chapter_index", "v").collect()}
    assert got == {("a", 0, 1), ("d", 1, 2), ("c", 1, 2)}
