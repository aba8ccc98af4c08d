"""Work done for a document, as the number of Python calls: it does not depend on the machine."""

import sys

import pytest

from canopy.plans.rowlocal import Context, run
from canopy.plans.xpath import compile_xpath
from canopy.plans.xslt import compile_stylesheet, matches, transform
from canopy.sources.xml import parse
from canopy.validate.schematron import Schematron


def order(lines: int) -> str:
    return '<order key="1">' + "".join(f'<line flag="{"RNA"[i % 3]}" part="{i}"><qty>{i + 20}</qty><price>{i}.50</price></line>' for i in range(lines)) + "</order>"


def calls(work) -> int:
    """Python functions called by work()."""
    seen = [0]

    def count(frame, event, argument):
        seen[0] += event == "call"

    work()  # what is compiled and kept for all documents is not counted
    sys.setprofile(count)
    try:
        work()
    finally:
        sys.setprofile(None)
    return seen[0]


def evaluations(*expressions: str) -> int:
    """Calls for the expressions on an order of five lines."""
    document, trees = parse(order(5)).document, [compile_xpath(e) for e in expressions]
    return calls(lambda: [run(t, document) for t in trees])


def test_axes():
    first, last = "/order/line[1]", "/order/line[last()]"
    axes = "/order/child::line", f"{first}/qty/ancestor::node()", f"{first}/following-sibling::*", f"{last}/preceding::node()", "//attribute::*", "//text()", "/order/*/*", "/order/line/@*"
    assert evaluations(*(f"count({a})" for a in axes)) < 700  # 1,523 before


def test_operators():
    first = "xs:integer(/order/line[1]/qty)"
    assert evaluations(
        "/order/line[1] << /order/line[last()]", "for $i in 1 to count(/order/line) return $i * $i", f"(function($x) {{ $x + 1 }})({first})", f"map {{ 'q': {first} }}?q", "array:size(array { /order/line })",
        "count(distinct-values((/order/line[1] | /order/line[position() > 1])/qty))", f"let $a := {first}, $b := xs:integer(/order/line[last()]/qty) return $a + $b",
    ) < 550  # 1,112 before


def test_sequences():
    assert evaluations(
        "sum(/order/line/qty)", "max(/order/line/qty)", "fold-left(/order/line/qty ! xs:integer(.), 0, function($a, $b) { $a + $b * $b })", "count(filter(/order/line, function($l) { $l/qty > 10 }))",
        "some $x in /order/line/qty satisfies $x > 45", "empty(for $l in /order/line[@flag = 'R'] return $l/qty * 2)", "for $l in /order/line return string($l/qty)", "avg(/order/line/qty)",
    ) < 1_000  # 2,089 before
    assert run("(sum(('1', 2.5)), max(/order/line/qty), min((2, 1)), sum(/order/line/qty), xs:integer(' 07 '), avg(/order/line/@part))", parse(order(5)).document, compat=False) == [3.5, 24.0, 1, 110.0, 7, 2.0]


def test_templates():
    sheet = compile_stylesheet("""<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output method="text"/><xsl:template match="/"><xsl:apply-templates select="order/line"/></xsl:template>
        <xsl:template match="line" priority="-1"><xsl:call-template name="say"><xsl:with-param name="what" select="'line'"/></xsl:call-template></xsl:template>
        <xsl:template match="line[qty &gt; 21]"><xsl:call-template name="say"><xsl:with-param name="what">big</xsl:with-param></xsl:call-template></xsl:template>
        <xsl:template match="line[@flag = 'R']" priority="5"><xsl:call-template name="say"><xsl:with-param name="what" select="'returned'"/></xsl:call-template></xsl:template>
        <xsl:template name="say"><xsl:param name="what"/><xsl:value-of select="$what, qty" separator=":"/><xsl:text>;</xsl:text></xsl:template></xsl:stylesheet>""")
    assert transform(order(5), sheet)[0] == "returned:20;line:21;big:22;returned:23;big:24;"
    few, many = (calls(lambda n=n: transform(order(n), sheet)) for n in (5, 20))
    assert few < 1_300 and many < 5 * few  # 3,734 before


def test_schematron_rules_are_compiled_once_and_meet_each_node_once():
    from canopy.plans.documents import SCHEMATRON

    rules = Schematron(SCHEMATRON)
    small, large = (parse(order(n)).document for n in (10, 40))
    few, many = calls(lambda: rules.run(small)), calls(lambda: rules.run(large))
    assert few < 1_500 and many < 5 * few  # 34,611 and 457,875 when each node met all its siblings
    assert [f["message"] for f in rules.run(large)] == ["too heavy"] + ["large return"] * 7


@pytest.mark.parametrize("pattern", [
    "line", "line[@flag = 'R']", "line[qty > 22][@part]", "order/line[qty = 21]", "/order/line[2]", "line[last()]", "line[position() mod 2 = 0]", "/order", "/line", "/order/line[@flag]/qty", "@flag", "line/@*", "line/@node()", "order//qty",
    "line[count(preceding-sibling::line) = 1]", "node()", "line/node()", "@*[. = 'R']", "line[string-length(@part)]", "text()", "line[following-sibling::line[1]/@flag = 'A']", "qty[text()]",
])
def test_patterns_match_what_their_path_selects(pattern):
    document = parse(order(5)).document
    nodes = [document, *(x for e in document.descendants() for x in [e, *e.attributes])]
    tree = compile_xpath(pattern)
    ctx = Context(compat=False)
    for node in nodes[1:]:
        above, want = node.parent, False
        while above is not None:
            want, above = want or any(x is node for x in run(tree, above, compat=False)), above.parent
        assert matches(node, tree, ctx) == want, node.name
    assert not matches(document, tree, ctx)
