"""Queries against their SQL where small tables don't reach: many chapters, odd words, odd references."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A book of 10,012 chapters and one of two."""
    path = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(10_014).selectExpr("id as doc_id", "concat('Title ', id, '\\nLine') as text", "'en' as lang", "if(id < 10012, 'a', 'b') as source", "cast(6 as bigint) as n_chars")
    rows.write.parquet(f"{path}/documents.parquet")
    return path


def same(spark, name, path):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        try:
            con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
        except duckdb.IOException:
            pass
    got = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    rows = __spark_entry__.queries()[name](spark, path).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, got.fetchall()))
    return rows


def test_manifest_checksum_of_many_chapters(spark, many):
    assert len(same(spark, "manifest_checksum", many)) == 2


PAGE = """<html><body><nav><ul><li>One</li></ul></nav><div class="ad">Buy</div><article><h1>%s</h1><p>%s<br>x</article><footer>&copy; f</footer></body></html>"""


@pytest.fixture(scope="module")
def references(spark, tmp_path_factory):
    """References without a semicolon, twice escaped, and ones that the SQL doesn't know."""
    path = str(tmp_path_factory.mktemp("references"))
    said = ["cut &amp;&amp", "a &amp;lt; b", "&lt;b&gt; &amp; c", "token = &quot;7", "a & b &nbsp;&eacute;&#39; &#x27;", "&&amp;amp;&copy &lt"]
    said.append("deep " + "<p>one " * 700)
    spark.createDataFrame([(i, PAGE % (s.split(" <p>")[0], s)) for i, s in enumerate(said)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    return path


def test_page_first_heading_references(spark, references):
    found = {r.page_id: r.heading for r in same(spark, "page_first_heading", references)}
    assert found[0] == "cut &&amp" and found[3] == "token = &quot;7"


def test_xhtml_to_markdown_references(spark, references):
    found = {r.page_id: r.content for r in same(spark, "xhtml_to_markdown", references)}
    assert "cut &&amp" in found[0] and "&nbsp;&eacute;&#39; '" in found[4] and found[6].count("one") == 700


def test_skill_bundle_files_of_many_chapters(spark, many):
    assert {(r.book, r.chapters) for r in same(spark, "skill_bundle_files", many)} == {("a", 10_012), ("b", 2)}


def test_ocr_required_of_odd_words(spark, tmp_path):
    said = ["Di", "mil", "xiv\\nvii", "Où", "ñ é", "a\nb", "1 = 2", "Page 7", "m1l", "", "a\rb", "x", None, "di\rv"]
    rows = [(4 * i + k, s, "en", "s", 1) for i, s in enumerate(said) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.meaningful for r in same(spark, "ocr_required", str(tmp_path))}
    assert found[2] and not found[14] and not found[22]


def test_chat_examples_are_expanded(spark, monkeypatch):
    from vellumlake.llm import chat

    rows = [(1, 0, "user", "<a>"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d]"), (1, 4, "user", "tail"), (2, 0, "user", "only")]
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {(r.conv_id, r.example): r for r in examples.collect()}
    assert chat.parse(found[1, 1].prefix + found[1, 1].target) == [(r[2], r[3]) for r in rows[:4]]
    assert chat.unescape(found[1, 1].target) == "d]" + chat.TAIL and found[1, 1].prefix.endswith(chat.head("assistant"))
    assert found[1, 2].prefix is None and found[2, 0].prefix is None
    assert chat.digest(examples.withColumn("delta", examples.delta.substr(1, 0)).where("trainable")).where("n_turns = 4 and loss_chars = 3").count() == 1
    with pytest.raises(Exception, match="isn't whole"):
        chat.digest(examples.selectExpr("* except (prefix)", "replace(prefix, 'b', 'x') as prefix")).collect()


def test_plan_estimate_moves_counts_alone(spark):
    from vellumlake.operators import chunking
    from vellumlake.plans import planning

    texts = [None, "", "a" * 45, "# h\n\n" + "b" * 9, *(f"p {i}\n\n" * 9 for i in range(450))]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "doc_id long, book string, text string").coalesce(1)
    got = df.select("doc_id", chunking.chunk_count(df.text, 20).alias("n"), chunking.chunk_array(df.text, 20).alias("c")).collect()
    assert [r.c for r in sorted(got)] == [chunking.split(t, 20) for t in texts]
    assert [r.n for r in sorted(got)] == [None if t is None else len(chunking.split(t, 20)) for t in texts]
    plan = planning.estimate(df, df.select("doc_id").limit(0), "book", "doc_id", "text", 20)
    assert "array<string>" not in plan._jdf.queryExecution().analyzed().toString() and plan.first().total_chapters == len(texts)
    assert "run(text" in plan._jdf.queryExecution().analyzed().toString() and "size(run" not in plan._jdf.queryExecution().analyzed().toString()


def test_snapshot_faults_deal_rows_out(spark, monkeypatch):
    from vellumlake.operators import library

    monkeypatch.setattr(library, "SNAPSHOTS", 10)
    said = '''concat('{"external_identity":{"source_system":"s","external_book_id":"', id div 4, '"},"chapter":{"index":', id % 3, '}}')'''
    rows = spark.range(95).selectExpr("id div 4 as external_source_id", "cast(id % 4 as int) as chapter_index", f"{said} as snapshot")
    rows = rows.unionByName(spark.createDataFrame([(1, 9, "{"), (1, 9, None), (None, 0, "{}")], rows.schema))
    external = spark.range(1, 20).selectExpr("id as external_source_id", "'s' as source_system", "cast(if(id = 2, 3, id) as string) as external_book_id")
    out = library.snapshot_faults(rows, external)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "hashpartitioning(external_source_id" in plan and ", 10)" in plan
    found = sorted(map(tuple, out.collect()), key=str)
    want = []
    for i in range(95):
        if not 1 <= i // 4 < 20:
            want.append((i // 4, i % 4, "SOURCE_MISSING"))
        elif i // 4 == 2 or i % 3 != i % 4:
            want.append((i // 4, i % 4, "INCONSISTENT"))
    assert found == sorted([*want, (1, 9, "INCONSISTENT"), (1, 9, "INCONSISTENT"), (None, 0, "SOURCE_MISSING")], key=str)
