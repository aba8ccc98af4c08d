"""Relational plans, operators, verbs and streams on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from canopy import api
from canopy.functions import columns as X
from canopy.operators import grouping, matching, ordering
from canopy.plans.relational import Paths, in_order
from canopy.plans.rowlocal import run
from canopy.sources.publish import publish, to_xml
from canopy.sources.xml import Options, events, lint, parse, parse_nodes
from canopy.streaming import readers

XML = '<r xmlns:p="urn:p"><a x="1">5</a><a x="2">7<b>8</b></a><c><a x="3"/><p:a>9</p:a></c><!--note--></r>'


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, XML), (2, "<r/>"), (3, None), (4, "<r><a>")], "id long, xml string")


@pytest.fixture(scope="module")
def nodes(docs):
    return parse_nodes(docs, "id", "xml").cache()


@pytest.mark.parametrize("path", [
    "//a", "/r/a", "/r/*", "//a/@x", "//a[2]", "//a[@x = '2']", "/r/a[last()]", "//a[b]", "//a[not(b)]", "//b/ancestor::*", "//a/following-sibling::*", "//c/preceding::a", "//a[position() > 1]", "//a | //c", "//a except /r/a[1]",
    "//a[. > 5]", "/r/a[1]/following::a", "//p:a", "//c/..", "//a/text()", "//comment()", "(//a)[2]", "//a[count(b) = 1]", "//a[starts-with(@x, '3')]", "//*[name() = 'c']", "//a[string-length(.) = 1]", "/descendant::a[2]", "//a[@x][2]",
])
def test_relational_paths_agree_with_the_evaluator(nodes, path):
    ns = {"p": "urn:p"}
    want = [n.order for n in run(path, parse(XML).document, namespaces=ns)]
    document = parse(XML).document
    place = {}
    from canopy.model import rows

    table = rows(document)
    flat = sorted((n for d in [document, *document.descendants()] for n in [d, *d.attributes]), key=lambda n: n.order)
    place = {n.order: r[0] for n, r in zip(flat, table)}
    got = [r["pre"] for r in in_order(Paths(nodes.where("doc_id = 1"), ns).select(path)).collect()]
    assert got == [place[o] for o in want]


def test_counts_and_aggregates_cover_empty_documents(nodes):
    paths = Paths(nodes)
    assert {r["doc_id"]: r["n"] for r in paths.count("//a").collect()} == {1: 3, 2: 0}
    assert {r["doc_id"]: r["found"] for r in paths.exists("//c").collect()} == {1: True, 2: False}
    assert {r["doc_id"]: r["value"] for r in paths.aggregate("/r/a/@x", "sum").collect()} == {1: 3.0, 2: 0.0}


def test_bad_rows_have_errors_and_recover(docs):
    found = {r["doc_id"]: (r["ok"], len(r["errors"])) for r in lint(docs, "id", "xml").collect()}
    assert found == {1: (True, 0), 2: (True, 0), 3: (False, 1), 4: (False, 1)}
    assert parse_nodes(docs.where("id = 4"), "id", "xml", Options(recover=True)).where("kind = 'element'").count() == 2
    assert [r["event"] for r in events(docs.where("id = 2"), "id", "xml").orderBy("seq").collect()] == ["start", "end"]


def test_stored_paths_reach_the_scan(spark, nodes, tmp_path):
    nodes.write.parquet(f"{tmp_path}/nodes")
    stored = spark.read.parquet(f"{tmp_path}/nodes")
    plan = Paths(stored).select("/r/a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(kind)" in plan and "Join" not in plan and "Python" not in plan


def test_publish(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "x"), (2, 1, "c", "y")], "g long, o int, v string, w string")
    made = Paths(publish(rows, "g", ["o"], "t", "r", ["v", "w"]))
    assert sorted((r["doc_id"], r["text"]) for r in made.strings("/t/r/v").collect()) == [(1, "a"), (1, "b"), (2, "c")]
    assert [r["text"] for r in made.strings("/t/r[2]").collect()] == ["b"]
    xml = rows.select(to_xml("r", {"o": F.col("o")}, {"v": F.concat("v", F.lit("<&")), "w": F.col("w")}).alias("x")).orderBy("x").collect()
    assert xml[0]["x"] == '<r o="1"><v>a&lt;&amp;</v><w>x</w></r>'


def test_groups_and_order(spark):
    items = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabbbac")], "d int, i int, k string")
    get = lambda df: [tuple(r)[1:] for r in df.orderBy("group_no").collect()]
    count = {"n": F.count("*")}
    assert get(grouping.group_adjacent(items, ["d"], ["i"], F.col("k"), count)) == [(1, 2), (2, 3), (3, 1), (4, 1)]
    assert get(grouping.group_starting_with(items, ["d"], ["i"], F.col("k") == "b", count)) == [(1, 2), (2, 1), (3, 1), (4, 3)]
    assert get(grouping.group_ending_with(items, ["d"], ["i"], F.col("k") == "b", count)) == [(1, 3), (2, 1), (3, 1), (4, 2)]
    values = spark.createDataFrame([("10",), ("x",), ("9",), (None,)], "v string").withColumn("p", F.monotonically_increasing_id())
    for down, want in ((False, ["9", "10"]), (True, ["10", "9"])):
        got = [r["v"] for r in ordering.sort(values, [ordering.sort_key(F.col("v"), "number", down)], "p").collect()]
        assert got[2:] == want and set(got[:2]) == {"x", None}  # non-numbers come first in both directions
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r["k"], r["change"]) for r in matching.diff(old, new, ["k"], ["v"]).collect()) == [(1, "delete"), (2, "change"), (3, "add")]
    refs = spark.createDataFrame([("a b",), ("c",)], "r string")
    assert [r["value"] for r in matching.dangling(refs, F.col("r"), spark.createDataFrame([("a",), ("c",)], "k string"), F.col("k"), split=True).collect()] == ["b"]


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert one(X.substring(lit("12345"), lit(1.5), lit(2.6))) == "234" and one(X.substring(lit("12345"), lit(0), lit(3))) == "12" and one(X.substring(lit("12345"), lit(float("nan")))) == ""
    assert one(X.xround(lit(-1.5))) == -1 and one(X.divide(lit(1.0), lit(0.0))) == float("inf") and one(X.number_to_string(lit(1.50))) == "1.5"
    assert one(X.sequence(lit(3).cast("long"), lit(1).cast("long"))) == [] and one(X.align(lit("abc"), lit("--"))) == "ab" and one(X.align(lit("x"), lit("----"), "center")) == "-x--"
    assert one(lit("b").rlike(X.translate_regex("[a-c-[b]]", True))) is False and one(lit("é1").rlike(X.translate_regex(r"\i\c*", True))) is True
    assert [one(X.castable(lit(v), k)) for v, k in (("127", "byte"), ("128", "byte"), ("2024-02-30", "date"), ("P1Y", "duration"), ("P", "duration"), ("x", "NCName"))] == [True, False, False, True, False, True]


def test_verbs(spark, docs):
    got = {r["id"]: r["result"] for r in api.xpath_query(docs, "xml", "//a/@x").collect()}
    assert got[1]["value"] == ["1", "2", "3"] and got[3]["value"] is None and got[4]["error"]
    assert api.xpath_query(docs.where("id = 1"), "xml", "ext:twice(count(//a))", "number", namespaces={"ext": "u"}, functions={("{u}twice", 1): lambda c, x: [x[0] * 2]}).first()["result"]["value"] == 6
    sheet = '<xsl:stylesheet version="2.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:template match="/"><n><xsl:value-of select="count(//a)"/></n></xsl:template></xsl:stylesheet>'
    assert api.xslt_transform(docs.where("id = 1"), "xml", sheet).first()["result"]["value"] == "<n>3</n>"
    assert api.repair(docs.where("id = 4"), "xml").first()["repaired"]["value"] == "<r><a/></r>"
    assert api.c14n(docs.where("id = 2"), "xml").first()["canonical"]["value"] == "<r></r>"
    schema = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType/></xs:element></xs:schema>'
    issues = {r["id"]: [i["kind"] for i in r["issues"]] for r in api.validate(docs, "xml", "xsd", schema).collect()}
    assert issues[2] == [] and issues[1] and issues[3] == ["Malformed"] and issues[4] == ["Malformed"]


def test_catalogs_and_inclusion(spark):
    catalog = spark.createDataFrame([("uri", "urn:x", "x.xml"), ("rewrite", "http://a/", "file:/a/"), ("rewrite", "http://a/b/", "file:/b/")], "entry_type string, name string, target string")
    uris = spark.createDataFrame([("urn:x",), ("http://a/q",), ("http://a/b/q",), ("other",)], "u string")
    assert {r["u"]: r["resolved"] for r in api.resolve_catalog(uris, "u", catalog).collect()} == {"urn:x": "x.xml", "http://a/q": "file:/a/q", "http://a/b/q": "file:/b/q", "other": "other"}
    xi = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    table = spark.createDataFrame([("a", f'<a {xi}><xi:include href="b"/><xi:include href="t" parse="text"/><xi:include href="no"><xi:fallback>f</xi:fallback></xi:include></a>'), ("b", "<b>x</b>"), ("t", "<t>")], "u string, x string")
    made = {r["u"]: r["x"] for r in api.xinclude(table, "u", "x").collect()}
    assert made["a"] == f"<a {xi}><b>x</b>&lt;t&gt;f</a>"
    assert api.css_to_xpath("div > p.x #y") == "//div/p[contains(concat(' ', normalize-space(@class), ' '), ' x ')]//*[@id='y']"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<t><r><v>1</v></r><r><v>2</v></r></t>")
    rows = readers.stream_records(spark, f"{tmp_path}/in", "r", "v long")
    query = rows.writeStream.format("memory").queryName("records").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    assert sorted(r["v"] for r in spark.table("records").collect()) == [1, 2]
    table = spark.createDataFrame([(1, "<t><r><v>1</v></r><r/></t>")], "id long, x string")
    assert [r["xml"] for r in readers.subtrees(table, "id", "x", path="/t/r").orderBy("seq").collect()] == ["<r><v>1</v></r>", "<r/>"]
    assert readers.subtrees(table, "id", "x", depth=3).count() == 1 and readers.subtrees(table, "id", "x", when=lambda names: names[-1] == "v").count() == 1


def test_entry_imports_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "canopy", tmp_path / "canopy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True).returncode == 0


def test_typed_rows(spark):
    table = spark.createDataFrame([('<o id="7"><i k="a">5</i><i k="b">6</i></o>',)], "x string")
    row = api.typed_rows(table, "x", "`@id` long, i array<struct<`@k`: string, `$text`: int>>").first()["row"]
    assert row["@id"] == 7 and [(i["@k"], i["$text"]) for i in row["i"]] == [("a", 5), ("b", 6)]


def test_titles_are_as_their_sql_has_them(spark, tmp_path):
    import duckdb

    from canopy.plans.catalog import ORACLES, html_title

    texts = ["<title>a&amp;b &quot;c&quot; d&amp</title><p>x", "<p>none", "<title>é&#233;&lt;</title>", None, "<title>one</title><p>x<svg><title>two</title></svg>", "<title></title>"]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in html_title(spark, str(tmp_path)).collect()) == sorted(con.execute(ORACLES["html_title"]).fetchall())
