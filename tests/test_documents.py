"""Parsing, recovery, HTML, serialization, XSLT and validators without Spark."""

import pytest

from canopy.cli import main
from canopy.model import rows
from canopy.plans.xslt import Terminated, XSLTError, compile_stylesheet, transform
from canopy.sinks.serialize import Output, canonicalize, serialize
from canopy.sources.html import parse_html, quirks_mode, sniff_encoding
from canopy.sources.xml import Options, decode, parse, unescape, well_formed
from canopy.validate import dtd, relaxng, schematron, xsd


def test_rows_nest_by_pre_and_size():
    got = rows(parse('<a x="1"><b>t</b><c/></a>').document)
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(0, 5, "document", ""), (1, 4, "element", "a"), (2, 0, "attribute", "x"), (3, 1, "element", "b"), (4, 0, "text", ""), (5, 0, "element", "c")]


@pytest.mark.parametrize("bad", ["", "<a>", "<a></b>", "<a/><b/>", "<a>&undefined;</a>", "<a x=1/>", "<a x='1' x='2'/>", "<a>]]></a>", "text", "<a><!-- -- --></a>", "<?xml version='1.0'?><?xml version='1.0'?><a/>", "<p:a/>"])
def test_rejected(bad):
    assert not well_formed(bad)


@pytest.mark.parametrize(("bad", "good"), [("<a><b>x", "<a><b>x</b></a>"), ("<a><b>x</a>", "<a><b>x</b></a>"), ("<a></z>x</a>", "<a>x</a>"), ("<a>1 < 2 & 3</a>", "<a>1 &lt; 2 &amp; 3</a>"), ("<a>&nope;</a>", "<a>&amp;nope;</a>"), ("<a x=1/>", '<a x="1"/>')])
def test_recovered(bad, good):
    parsed = parse(bad, Options(recover=True))
    assert parsed.errors and serialize(parsed.document) == good


def test_entities_and_limits():
    assert parse('<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>').document.string() == "x"
    bomb = '<!DOCTYPE a [<!ENTITY a "' + "x" * 1000 + '">' + "".join(f'<!ENTITY {c} "{("&" + p + ";") * 20}">' for p, c in zip("abcd", "bcde")) + "]><a>&e;</a>"
    assert parse(bomb, Options(entity_bytes=10_000)).errors
    assert parse("<a>" * 50 + "</a>" * 50, Options(depth=10)).errors
    assert unescape("&lt;&#65;&#x42;&nope;") == "<AB&nope;"


def test_encodings():
    assert decode("<a>é</a>".encode("utf-16")) == "<a>é</a>" and decode("<?xml version='1.0' encoding='latin-1'?><a>é</a>".encode("latin-1")).endswith("é</a>")
    assert parse("<?xml version='1.0' encoding='latin-1'?><a>é</a>".encode("latin-1")).document.string() == "é"
    assert sniff_encoding(b"<meta charset=utf-8>") == "utf-8" and sniff_encoding(b"x") == "windows-1252"


def test_html():
    document = parse_html("<title>T&amp;</title><p>one<p>two<br><ul><li>a<li>b</ul><script>if (a < b) '</p>'</script>").document
    html = document.elements()[0]
    assert [c.local for c in html.elements()] == ["head", "body"]
    body = html.elements()[1]
    assert [c.local for c in body.elements()] == ["p", "p", "ul", "script"] and len(body.elements()[2].elements()) == 2
    assert "a < b" in serialize(document, Output(method="html")) and "<br>" in serialize(document, Output(method="html"))
    assert quirks_mode(None) and not quirks_mode("DOCTYPE html")
    assert parse_html(None).document.children == []


def test_canonical_form():
    source = '<a xmlns:z="u" z="1" b="2"><!--c--><z:c xmlns:z="u"/>\r\n&amp;</a>'
    assert canonicalize(parse(source).document) == '<a xmlns:z="u" b="2" z="1"><z:c></z:c>\n&amp;</a>'
    assert canonicalize(parse(source).document, exclusive=True) == '<a b="2" z="1"><z:c xmlns:z="u"></z:c>\n&amp;</a>'


def test_serialized_again():
    source = '<a xmlns="u"><b c="&lt;&quot;">x &amp; y</b><!--k--><?p d?></a>'
    assert serialize(parse(source).document) == source
    assert serialize(parse("<a><b/><c>t</c></a>").document, Output(indent=True)) == "<a>\n  <b/>\n  <c>t</c>\n</a>"


SHEET = '<xsl:stylesheet version="{}" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:f="u" exclude-result-prefixes="f">{}</xsl:stylesheet>'
SOURCE = '<r><i k="a">3</i><i k="b">1</i><i k="a">2</i></r>'
TRANSFORMS = [
    ('<xsl:template match="r"><o><xsl:for-each select="i"><xsl:sort select="." data-type="number"/><v p="{position()}"><xsl:value-of select="."/></v></xsl:for-each></o></xsl:template>', '<o><v p="1">1</v><v p="2">2</v><v p="3">3</v></o>'),
    ('<xsl:template match="/"><o><xsl:for-each-group select="//i" group-by="@k"><g k="{current-grouping-key()}" n="{count(current-group())}"/></xsl:for-each-group></o></xsl:template>', '<o><g k="a" n="2"/><g k="b" n="1"/></o>'),
    ('<xsl:template match="/"><o><xsl:for-each-group select="//i" group-adjacent="@k"><g><xsl:value-of select="current-group()"/></g></xsl:for-each-group></o></xsl:template>', "<o><g>3</g><g>1</g><g>2</g></o>"),
    ('<xsl:template match="/"><o><xsl:for-each-group select="//i" group-starting-with="i[@k=\'b\']"><g n="{count(current-group())}"/></xsl:for-each-group></o></xsl:template>', '<o><g n="1"/><g n="2"/></o>'),
    ('<xsl:template match="/"><o><xsl:for-each-group select="//i" group-ending-with="i[@k=\'b\']"><g n="{count(current-group())}"/></xsl:for-each-group></o></xsl:template>', '<o><g n="2"/><g n="1"/></o>'),
    ('<xsl:mode on-no-match="shallow-copy"/><xsl:template match="i[@k=\'b\']"/>', '<r><i k="a">3</i><i k="a">2</i></r>'),
    ('<xsl:key name="k" match="i" use="@k"/><xsl:template match="/"><xsl:value-of select="key(\'k\',\'a\')" separator=","/></xsl:template>', "3,2"),
    ('<xsl:template match="/"><xsl:iterate select="//i"><xsl:param name="s" select="0"/><xsl:on-completion><t><xsl:value-of select="$s"/></t></xsl:on-completion><xsl:next-iteration><xsl:with-param name="s" select="$s + number(.)"/></xsl:next-iteration></xsl:iterate></xsl:template>', "<t>6</t>"),
    ('<xsl:template match="i"><xsl:number format="A."/><xsl:apply-templates/></xsl:template>', "A.3B.1C.2"),
    ('<xsl:template match="/"><xsl:analyze-string select="\'a1b22\'" regex="[0-9]+"><xsl:matching-substring><n><xsl:value-of select="."/></n></xsl:matching-substring><xsl:non-matching-substring><xsl:value-of select="."/></xsl:non-matching-substring></xsl:analyze-string></xsl:template>', "a<n>1</n>b<n>22</n>"),
    ('<xsl:function name="f:d"><xsl:param name="x"/><xsl:sequence select="if ($x > 1) then $x * f:d($x - 1) else 1"/></xsl:function><xsl:template match="/"><xsl:value-of select="f:d(5)"/></xsl:template>', "120"),
    ('<xsl:template match="/"><xsl:try><xsl:sequence select="error()"/><xsl:catch>caught</xsl:catch></xsl:try></xsl:template>', "caught"),
    ('<xsl:template match="r"><xsl:call-template name="n"><xsl:with-param name="p" select="2"/></xsl:call-template></xsl:template><xsl:template name="n"><xsl:param name="p" select="1"/><xsl:element name="e{$p}"><xsl:attribute name="q" select="$p, 9"/></xsl:element></xsl:template>', '<e2 q="2 9"/>'),
    ('<xsl:template match="i" priority="1"><a><xsl:next-match/></a></xsl:template><xsl:template match="*[@k]"><b/></xsl:template>', "<a><b/></a><a><b/></a><a><b/></a>"),
    ('<xsl:template match="/"><xsl:merge><xsl:merge-source select="//i[1]"><xsl:merge-key select="@k"/></xsl:merge-source><xsl:merge-source select="//i[position()>1]"><xsl:merge-key select="@k"/></xsl:merge-source><xsl:merge-action><m k="{current-merge-key()}"><xsl:value-of select="current-merge-group()"/></m></xsl:merge-action></xsl:merge></xsl:template>', '<m k="a">3 2</m><m k="b">1</m>'),
    ('<xsl:output method="text"/><xsl:template match="/"><xsl:variable name="v"><a>x</a></xsl:variable><xsl:value-of select="$v/a, count(//i)" separator="|"/></xsl:template>', "x|3"),
]


@pytest.mark.parametrize(("body", "want"), TRANSFORMS)
def test_xslt(body, want):
    assert transform(SOURCE, SHEET.format("3.0", body))[0] == want


def test_xslt_outputs_and_errors():
    out, others, messages = transform(SOURCE, SHEET.format("3.0", '<xsl:param name="p"/><xsl:template match="/"><o><xsl:value-of select="$p"/></o><xsl:result-document href="x.xml"><y/></xsl:result-document><xsl:message>hello</xsl:message></xsl:template>'), {"p": "7"})
    assert (out, others, messages) == ("<o>7</o>", {"x.xml": "<y/>"}, ["hello"])
    with pytest.raises(Terminated):
        transform(SOURCE, SHEET.format("3.0", '<xsl:template match="/"><xsl:message terminate="yes">stop</xsl:message></xsl:template>'))
    with pytest.raises(XSLTError):
        compile_stylesheet("<a")
    base = SHEET.format("3.0", '<xsl:template match="i"><base/></xsl:template>')
    assert transform(SOURCE, compile_stylesheet(SHEET.format("3.0", '<xsl:import href="b"/><xsl:template match="i[1]"><top><xsl:apply-imports/></top></xsl:template>'), {"b": base}))[0] == "<top><base/></top><base/><base/>"


DTD = '<!DOCTYPE r [<!ELEMENT r (a+,b?)><!ELEMENT a (#PCDATA)><!ELEMENT b EMPTY><!ATTLIST a id ID #REQUIRED k (x|y) "x"><!ATTLIST b ref IDREF #IMPLIED>]>'


def test_dtd():
    good = parse(DTD + '<r><a id="i">t</a><b ref="i"/></r>')
    assert dtd.validate(good) == [] and dtd.inject_defaults(good).elements()[0].elements()[0].get("k") == "x"
    kinds = [i["kind"] for i in dtd.validate(parse(DTD + '<r><b ref="z"/><a k="q"/></r>'))]
    assert kinds == ["UnexpectedElement", "MissingRequiredAttribute", "FacetViolation", "KeyRefDangling"]


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="code"><xs:restriction base="xs:string"><xs:pattern value="[a-c]+"/></xs:restriction></xs:simpleType>
<xs:element name="o"><xs:complexType><xs:sequence><xs:element name="i" maxOccurs="unbounded"><xs:complexType><xs:simpleContent><xs:extension base="xs:int"><xs:attribute name="k" type="code" use="required"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
<xs:choice minOccurs="0"><xs:element name="d" type="xs:date"/><xs:element name="n" nillable="true" type="xs:int"/></xs:choice></xs:sequence><xs:assert test="count(i) lt 4"/></xs:complexType><xs:key name="kk"><xs:selector xpath="i"/><xs:field xpath="@k"/></xs:key></xs:element></xs:schema>"""


@pytest.mark.parametrize(("source", "kinds"), [
    ('<o><i k="a">5</i><d>2024-02-28</d></o>', []), ('<o><i k="a">5</i><n xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/></o>', []), ('<o><i k="a">5</i><d>2024-02-30</d></o>', ["TypeMismatch"]),
    ('<o><i k="z">5</i></o>', ["FacetViolation"]), ('<o><i>5</i></o>', ["MissingRequiredAttribute", "KeyNotUnique"]), ("<o/>", ["MissingRequiredElement"]), ('<o><i k="a">1</i><i k="a">2</i></o>', ["KeyNotUnique"]), ('<o><i k="a">1</i><z/></o>', ["UnexpectedElement"]),
    ('<o><i k="a">1</i><i k="b">1</i><i k="c">1</i><i k="ab">1</i></o>', ["AssertionViolation"]), ("<q/>", ["UnexpectedElement"]), ('<o q="1"><i k="a">1</i></o>', ["UnexpectedAttribute"]),
])
def test_xsd(source, kinds):
    assert [i["kind"] for i in xsd.Schema(XSD).validate(parse(source).document)] == kinds


def test_relaxng():
    grammar = relaxng.Grammar('<element name="r" xmlns="http://relaxng.org/ns/structure/1.0"><interleave><oneOrMore><element name="i"><attribute name="k"/><data type="int"/></element></oneOrMore><optional><element name="e"><empty/></element></optional></interleave></element>')
    check = lambda s: grammar.validate(parse(s).document)
    assert check('<r><e/><i k="1">5</i></r>') == [] and check('<r><i k="1">5</i><e/></r>') == []
    assert check("<r><i>5</i></r>") and check('<r><i k="1">x</i></r>') and check("<r/>") and check('<r><i k="1">5</i><e/><e/></r>')


def test_schematron():
    rules = schematron.Schematron('<schema xmlns="http://purl.oclc.org/dsdl/schematron"><pattern id="p"><let name="t" value="sum(//l)"/><rule context="order"><assert test="@total = $t">total <value-of select="@total"/> is not <value-of select="$t"/></assert><report test="count(l) &gt; 1">many</report></rule><rule context="*"><report test="true()">other</report></rule></pattern></schema>')
    found = rules.run(parse('<order total="5"><l>2</l><l>4</l></order>').document)
    assert [(f["kind"], f["message"]) for f in found] == [("assert", "total 5 is not 6"), ("report", "many"), ("report", "other"), ("report", "other")]


def test_command_line(tmp_path, capsys):
    f = tmp_path / "a.xml"
    f.write_text('<r><a x="1">5</a></r>')
    g = tmp_path / "b.xml"
    g.write_text("<r><a>")
    assert main(["lint", str(f)]) == 0 and main(["lint", str(g)]) == 1 and main(["xpath", "//a/@x", str(f)]) == 0 and main(["diff", str(f), str(f)]) == 0 and main(["repair", str(g)]) == 0
    assert "<r><a/></r>" in capsys.readouterr().out
    assert main(["xpath", "//zzz", "--exists", str(f)]) == 1 and main(["stats", str(tmp_path / "none")]) == 2
