"""Driver queries that run the row-local evaluator, XSLT and the validators over documents published from tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy import api
from canopy.plans.catalog import LINE_ORDER, SQL_LINES, query, read
from canopy.sources.publish import to_xml

EXSLT = {
    "math": "http://exslt.org/math", "set": "http://exslt.org/sets", "str": "http://exslt.org/strings", "re": "http://exslt.org/regular-expressions", "date": "http://exslt.org/dates-and-times", "exsl": "http://exslt.org/common",
}


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Documents over all cores: evaluating them takes far longer than their bytes tell, by which small tables would end in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def parts(spark, sf_dir) -> DataFrame:
    """p_partkey and a document of each part."""
    part = read(spark, sf_dir, "part")
    fields = {"name": F.col("p_name"), "type": F.col("p_type"), "brand": F.col("p_brand"), "price": F.format_string("%.2f", "p_retailprice")}
    return dealt(part, "p_partkey").select("p_partkey", to_xml("part", {"id": F.col("p_partkey"), "size": F.col("p_size")}, fields).alias("xml"))


def orders(spark, sf_dir) -> DataFrame:
    """l_orderkey and a document of each order: order / line[@flag][@part] / qty, price, in order of lines."""
    order = F.struct(*LINE_ORDER, "l_returnflag")
    lines = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("lines"))
    line = lambda x: to_xml("line", {"flag": x["l_returnflag"], "part": x["l_partkey"]}, {"qty": x["l_quantity"].cast("int"), "price": F.format_string("%.2f", x["l_extendedprice"])})
    inner = F.array_join(F.transform("lines", line), "")
    return lines.select("l_orderkey", F.concat(F.lit('<order key="'), F.col("l_orderkey"), F.lit('">'), inner, F.lit("</order>")).alias("xml"))


def events(spark, sf_dir) -> DataFrame:
    """event_id and a document of each event."""
    event = dealt(read(spark, sf_dir, "events"), "event_id")
    return event.select("event_id", to_xml("event", {"type": F.col("event_type")}, {"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "day": F.date_format("ts", "yyyy-MM-dd"), "json": F.col("props")}).alias("xml"))


def evaluated(df: DataFrame, key: str, expressions: dict[str, str], kinds: dict[str, str] | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """The key and a column for each expression, all evaluated in one pass over the document."""
    found = api.xpath_columns(df, "xml", expressions, namespaces=namespaces, into="xpath")
    made = [F.col("xpath.value")[i].cast((kinds or {}).get(name, "string")).alias(name) for i, name in enumerate(expressions)]
    return found.select(key, *made)


# --- expressions ---


@query("""
    SELECT p_partkey, concat(p_brand, '/', p_size) AS joined, starts_with(p_type, 'STANDARD')::VARCHAR AS st, ends_with(p_type, 'L')::VARCHAR AS en, contains(p_name, 'e')::VARCHAR AS has, length(p_name)::VARCHAR AS len,
           upper(p_name) AS up, lower(p_type) AS low, translate(p_name, 'aeiou', 'AEI') AS tr, array_to_string(string_split(p_name, ' '), ',') AS tok, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS repl,
           regexp_matches(p_type, '^[A-Z]+ [A-Z]+')::VARCHAR AS m, CASE WHEN p_name < 'm' THEN '-1' WHEN p_name = 'm' THEN '0' ELSE '1' END AS cmp, array_to_string(list_transform(string_split(left(p_name, 3), ''), lambda c: ascii(c)), ',') AS cps,
           replace(replace(p_name, ' ', '%20'), '#', '%23') AS uri, p_name || '+' || p_brand AS cat, substring(p_name, 2, 3) AS sub, left(p_name, 1) AS cp FROM part""")
def expr_strings(spark, sf_dir):
    return evaluated(parts(spark, sf_dir), "p_partkey", {
        "joined": "concat(/part/brand, '/', /part/@size)", "st": "starts-with(/part/type, 'STANDARD')", "en": "ends-with(/part/type, 'L')", "has": "contains(/part/name, 'e')", "len": "string-length(/part/name)",
        "up": "upper-case(/part/name)", "low": "lower-case(/part/type)", "tr": "translate(/part/name, 'aeiou', 'AEI')", "tok": "tokenize(/part/name, ' ')", "repl": "replace(/part/name, '[aeiou]+', '_')",
        "m": "matches(/part/type, '^[A-Z]+ [A-Z]+')", "cmp": "compare(/part/name, 'm')", "cps": "string-to-codepoints(substring(/part/name, 1, 3))", "uri": "encode-for-uri(/part/name)",
        "cat": "/part/name || '+' || /part/brand", "sub": "substring(/part/name, 2, 3)", "cp": "codepoints-to-string(string-to-codepoints(/part/name)[1])",
    })


@query("""
    SELECT p_partkey, p_size + 3 AS a, p_size - 30 AS s, p_size * 7 AS m, p_size // 4 AS i, p_size % 4 AS r, -p_size AS n, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice + 0.5)::BIGINT AS ro, abs(p_size - 25) AS ab,
           p_size / 8 AS d, p_size > 25 AS gt, p_size <= 10 AS le, p_size = 7 AS eq, p_size <> 7 AS ne, p_size BETWEEN 10 AND 20 AS andb, p_size < 5 OR p_size >= 45 AS orb, NOT (p_size < 25) AS nb, p_size >= 25 AS vge FROM part""")
def expr_numbers(spark, sf_dir):
    size = "xs:integer(/part/@size)"
    longs = {"a": f"{size} + 3", "s": f"{size} - 30", "m": f"{size} * 7", "i": f"{size} idiv 4", "r": f"{size} mod 4", "n": f"-{size}", "f": "floor(number(/part/price))", "c": "ceiling(number(/part/price))", "ro": "round(number(/part/price))", "ab": f"abs({size} - 25)"}
    truths = {"gt": "/part/@size > 25", "le": "/part/@size <= 10", "eq": f"{size} eq 7", "ne": f"{size} ne 7", "andb": "/part/@size >= 10 and /part/@size <= 20", "orb": f"{size} lt 5 or {size} ge 45", "nb": "not(/part/@size < 25)", "vge": f"{size} ge 25"}
    kinds = dict.fromkeys(longs, "long") | dict.fromkeys(truths, "boolean") | {"d": "double"}
    return evaluated(parts(spark, sf_dir), "p_partkey", longs | {"d": f"{size} div 8"} | truths, kinds)


@query(f"""
    WITH l AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINES}) AS i FROM lineitem)
    SELECT l_orderkey, count(*) AS n, sum(q) AS s, max(q) AS hi, min(q) AS lo, round(avg(q), 6) AS mean, bool_or(q > 45) AS some, bool_and(q > 5) AS every, string_agg(q::VARCHAR, ',' ORDER BY i) AS qs,
           string_agg((q * 2)::VARCHAR, ',' ORDER BY i) FILTER (l_returnflag = 'R') IS NOT DISTINCT FROM NULL AS no_r, CASE WHEN count(*) > 3 THEN 'many' ELSE 'few' END AS word, sum(q * q) AS squares,
           string_agg(q::VARCHAR, ',' ORDER BY i DESC) AS rev, count(DISTINCT q) AS kinds, coalesce(string_agg(q::VARCHAR, ',' ORDER BY i) FILTER (i BETWEEN 2 AND 3), '') AS sub,
           count(*) FILTER (q > 10) AS big, coalesce(min(i) FILTER (l_returnflag = 'N'), 0) AS at FROM l GROUP BY l_orderkey""")
def expr_sequences(spark, sf_dir):
    q = "/order/line/qty ! xs:integer(.)"
    longs = {"n": "count(/order/line)", "s": "sum(/order/line/qty)", "hi": "max(/order/line/qty)", "lo": "min(/order/line/qty)", "squares": f"fold-left({q}, 0, function($a, $b) {{ $a + $b * $b }})", "kinds": "count(distinct-values(/order/line/qty))",
             "big": "count(filter(/order/line, function($l) { $l/qty > 10 }))", "at": "(index-of(/order/line/@flag, 'N'), 0)[1]"}
    truths = {"some": "some $x in /order/line/qty satisfies $x > 45", "every": "every $x in /order/line/qty satisfies $x > 5", "no_r": "empty(for $l in /order/line[@flag = 'R'] return $l/qty * 2)"}
    words = {"qs": "for $l in /order/line return string($l/qty)", "word": "if (count(/order/line) > 3) then 'many' else 'few'", "rev": "reverse(/order/line/qty)", "sub": "subsequence(/order/line/qty, 2, 2)"}
    kinds = dict.fromkeys(longs, "long") | dict.fromkeys(truths, "boolean") | {"mean": "double"}
    return evaluated(orders(spark, sf_dir), "l_orderkey", longs | truths | words | {"mean": "avg(/order/line/qty)"}, kinds).withColumn("mean", F.round("mean", 6))


@query("""
    WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n AS child, 5 * n AS descendant, 5 * n + 2 AS descendant_or_self, 1 AS parent, 3 AS ancestor, 4 AS ancestor_or_self, n - 1 AS following_sibling, n - 1 AS preceding_sibling, 5 * (n - 1) AS following, 5 * (n - 1) AS preceding,
           1 AS self, 2 * n + 1 AS attribute, 1 AS namespaces, 2 * n AS texts, 2 * n AS wild, 2 * n AS atts FROM n""")
def expr_axes(spark, sf_dir):
    first, last = "/order/line[1]", "/order/line[last()]"
    counts = {
        "child": "/order/child::line", "descendant": "/order/descendant::node()", "descendant_or_self": "/descendant-or-self::node()", "parent": f"{first}/parent::order", "ancestor": f"{first}/qty/ancestor::node()",
        "ancestor_or_self": f"{first}/qty/ancestor-or-self::node()", "following_sibling": f"{first}/following-sibling::*", "preceding_sibling": f"{last}/preceding-sibling::line", "following": f"{first}/following::node()", "preceding": f"{last}/preceding::node()",
        "self": f"{first}/self::line", "attribute": "//attribute::*", "namespaces": "/order/namespace::*", "texts": "//text()", "wild": "/order/*/*", "atts": "/order/line/@*",
    }
    return evaluated(orders(spark, sf_dir), "l_orderkey", {k: f"count({v})" for k, v in counts.items()}, dict.fromkeys(counts, "long"))


@query(f"""
    WITH l AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINES}) AS i FROM lineitem),
         g AS (SELECT l_orderkey, count(*) AS n, list(q ORDER BY i) AS qs FROM l GROUP BY l_orderkey)
    SELECT l_orderkey, n > 1 AS before, n = 1 AS is_same, array_to_string(list_transform(generate_series(1, n), lambda x: x * x), ',') AS squares, qs[1] AS cast_, qs[1] < 128 AS castable, 'caught' AS tried, qs[1] + 1 AS inlined, n AS named, qs[1] * 10 AS partial,
           array_to_string(qs, '-') AS arrow, qs[1] AS looked, len(qs) AS size, len(list_distinct(qs))::VARCHAR AS uni, qs[1] + qs[-1] AS let_, n * 2 AS treated FROM g""")
def expr_operators(spark, sf_dir):
    first = "xs:integer(/order/line[1]/qty)"
    found = {
        "before": "/order/line[1] << /order/line[last()]", "is_same": "/order/line[1] is /order/line[last()]", "squares": "for $i in 1 to count(/order/line) return $i * $i", "cast_": "/order/line[1]/qty cast as xs:integer",
        "castable": "/order/line[1]/qty castable as xs:byte", "tried": "try { error() } catch * { 'caught' }", "inlined": f"(function($x) {{ $x + 1 }})({first})", "named": "let $f := count#1 return $f(/order/line)",
        "partial": f"(let $t := function($a, $b) {{ $a * $b }} return $t(?, 10))({first})", "arrow": "/order/line/qty => string-join('-')", "looked": f"map {{ 'q': {first} }}?q", "size": "array:size(array { /order/line })",
        "uni": "count(distinct-values((/order/line[1] | /order/line[position() > 1])/qty))", "let_": f"let $a := {first}, $b := xs:integer(/order/line[last()]/qty) return $a + $b", "treated": "(count(/order/line) treat as xs:integer) * 2",
    }
    kinds = dict.fromkeys(("before", "is_same", "castable"), "boolean") | dict.fromkeys(("cast_", "inlined", "named", "partial", "looked", "size", "let_", "treated"), "long")
    return evaluated(orders(spark, sf_dir), "l_orderkey", found, kinds)


@query("""
    SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts)::BIGINT AS se, strftime(ts, '%d.%m.%Y') AS fmt, strftime(ts::DATE + 45, '%Y-%m-%d') AS later, strftime(ts::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_later,
           date_diff('day', DATE '2024-01-01', ts::DATE) AS days, strftime(ts::DATE, '%Y-%m-%d') = '2024-01-05' AS eq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def expr_dates(spark, sf_dir):
    day = "xs:date(/event/day)"
    longs = {"y": "year-from-dateTime(xs:dateTime(/event/ts))", "mo": f"month-from-date({day})", "d": f"day-from-date({day})", "h": "hours-from-dateTime(xs:dateTime(/event/ts))", "mi": "minutes-from-dateTime(xs:dateTime(/event/ts))",
             "se": "seconds-from-dateTime(xs:dateTime(/event/ts))", "days": f"days-from-duration({day} - xs:date('2024-01-01'))", "k": "parse-json(/event/json)?k"}
    words = {"fmt": f"format-date({day}, '[D01].[M01].[Y0001]')", "later": f"{day} + xs:dayTimeDuration('P45D')", "month_later": f"{day} + xs:yearMonthDuration('P1M')", "eq": f"{day} eq xs:date('2024-01-05')"}
    found = evaluated(events(spark, sf_dir), "event_id", longs | words, dict.fromkeys(longs, "double") | {"eq": "boolean"})
    return found.select("event_id", *[F.col(n).cast("long").alias(n) for n in longs], *words)


@query("""
    SELECT p_partkey, round(sqrt(p_size), 9) AS sq, round(power(p_size, 2), 6) AS po, round(sin(p_size), 9) AS si, round(cos(p_size), 9) AS co, round(tan(p_size), 6) AS ta, round(ln(p_size), 9) AS lo, round(exp(p_size / 10.0), 6) AS ex, round(atan2(p_size, 3), 9) AS at,
           p_size AS hi, rpad('', (p_size % 6)::INT, 'ab') AS pad, rpad(left(p_brand, 9), 9, '*') AS al, array_to_string(string_split(p_type, ' '), '|') AS sp, upper(p_name) AS up, regexp_matches(p_type, '(?i)steel')::VARCHAR AS te,
           regexp_replace(p_name, '[aeiou]', '_', 'g') AS re, replace(p_name, ' ', '%20') AS en, p_name AS de, 'string' AS ty FROM part""")
def expr_extensions(spark, sf_dir):
    size = "number(/part/@size)"
    numbers = {"sq": f"math:sqrt({size})", "po": f"math:power({size}, 2)", "si": f"math:sin({size})", "co": f"math:cos({size})", "ta": f"math:tan({size})", "lo": f"math:log({size})", "ex": f"math:exp({size} div 10)", "at": f"math:atan2({size}, 3)"}
    words = {
        "pad": "str:padding(/part/@size mod 6, 'ab')", "al": "str:align(/part/brand, '*********')", "sp": "string-join(str:split(/part/type, ' '), '|')", "up": "str:upper-case(/part/name)", "te": "re:test(/part/type, 'steel', 'i')",
        "re": "re:replace(/part/name, '[aeiou]', 'g', '_')", "en": "str:encode-uri(/part/name, true())", "de": "str:decode-uri(str:encode-uri(/part/name, true()))", "ty": "exsl:object-type(string(/part/name))",
    }
    found = evaluated(parts(spark, sf_dir), "p_partkey", numbers | words | {"hi": "math:max((/part/@size, /part/@size))"}, dict.fromkeys(numbers, "double") | {"hi": "double"}, EXSLT)
    digits = {"po": 6, "ta": 6, "ex": 6}
    return found.select("p_partkey", *[F.round(n, digits.get(n, 9)).alias(n) for n in numbers], F.col("hi").cast("long").alias("hi"), *words)


@query("""
    SELECT event_id, dayofweek(ts) + 1 AS dw, dayname(ts) AS dn, left(dayname(ts), 3) AS da, monthname(ts) AS mn, left(monthname(ts), 3) AS ma, month(ts) AS mo, day(ts) AS dm, dayofyear(ts) AS dy, weekofyear(ts) AS wy, (day(ts) - 1) // 7 + 1 AS nth,
           hour(ts) AS h, minute(ts) AS mi, second(ts)::BIGINT AS s, year(ts) % 4 = 0 AS leap, strftime(ts::DATE + 40, '%Y-%m-%d') AS ad FROM events""")
def expr_extension_dates(spark, sf_dir):
    longs = {"dw": "day-in-week", "mo": "month-in-year", "dm": "day-in-month", "dy": "day-in-year", "wy": "week-in-year", "nth": "day-of-week-in-month", "h": "hour-in-day", "mi": "minute-in-hour", "s": "second-in-minute"}
    words = {"dn": "day-name", "da": "day-abbreviation", "mn": "month-name", "ma": "month-abbreviation", "leap": "leap-year"}
    calls = {n: f"date:{f}(/event/ts)" for n, f in (longs | words).items()} | {"ad": "date:add(/event/day, 'P40D')"}
    found = evaluated(events(spark, sf_dir), "event_id", calls, dict.fromkeys(longs, "double") | {"leap": "boolean"}, EXSLT)
    return found.select("event_id", *[F.col(n).cast("long").alias(n) for n in longs], *words, "ad")


RANGES_SQL = "SELECT p_partkey, " + ", ".join(
    f"v BETWEEN {low} AND {high} AS {name}" for name, low, high in (("byte", -128, 127), ("short", -32768, 32767), ("int_", -2147483648, 2147483647), ("unsignedbyte", 0, 255), ("unsignedshort", 0, 65535), ("positiveinteger", 1, 10**15), ("nonpositiveinteger", -(10**15), 0), ("negativeinteger", -(10**15), -1), ("nonnegativeinteger", 0, 10**15))
) + " FROM (SELECT p_partkey, (p_partkey - 1000) * (p_size % 5) * (p_size % 3) * 61 AS v FROM part)"


@query(RANGES_SQL)
def type_ranges(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<v>"), (F.col("p_partkey") - 1000) * (F.col("p_size") % 5) * (F.col("p_size") % 3) * 61, F.lit("</v>")).alias("xml"))
    names = {"byte": "byte", "short": "short", "int_": "int", "unsignedbyte": "unsignedByte", "unsignedshort": "unsignedShort", "positiveinteger": "positiveInteger", "nonpositiveinteger": "nonPositiveInteger", "negativeinteger": "negativeInteger", "nonnegativeinteger": "nonNegativeInteger"}
    return evaluated(part, "p_partkey", {n: f"/v castable as xs:{t}" for n, t in names.items()}, dict.fromkeys(names, "boolean"))


# --- stylesheets ---

SHEET = '<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:f="urn:f" exclude-result-prefixes="xs f"><xsl:output method="text"/>{}</xsl:stylesheet>'


def transformed(df: DataFrame, key: str, body: str) -> DataFrame:
    """The key and the text that a stylesheet makes of each document."""
    return api.xslt_transform(df, "xml", SHEET.format(body)).select(key, F.col("result.value").alias("out"))


LINES = f"SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINES}) AS i FROM lineitem"


@query(f"SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN 'returned:' || q WHEN q > 40 THEN 'big:' || q ELSE 'line:' || q END, ';' ORDER BY i) || ';' AS out FROM ({LINES}) GROUP BY l_orderkey")
def xslt_templates(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:apply-templates select="order/line"/></xsl:template>
        <xsl:template match="line" priority="-1"><xsl:call-template name="say"><xsl:with-param name="what" select="'line'"/></xsl:call-template></xsl:template>
        <xsl:template match="line[qty &gt; 40]"><xsl:call-template name="say"><xsl:with-param name="what">big</xsl:with-param></xsl:call-template></xsl:template>
        <xsl:template match="line[@flag = 'R']" priority="5"><xsl:call-template name="say"><xsl:with-param name="what" select="'returned'"/></xsl:call-template></xsl:template>
        <xsl:template name="say"><xsl:param name="what"/><xsl:value-of select="$what, qty" separator=":"/><xsl:text>;</xsl:text></xsl:template>""")  # fmt: skip


@query(f"SELECT l_orderkey, string_agg(l_returnflag || '=' || n || '/' || s, ' ' ORDER BY l_returnflag) AS out FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, sum(q) AS s FROM ({LINES}) GROUP BY 1, 2) GROUP BY l_orderkey")
def xslt_group_by(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:for-each-group select="order/line" group-by="@flag"><xsl:sort select="current-grouping-key()"/><xsl:if test="position() &gt; 1"><xsl:text> </xsl:text></xsl:if>
        <xsl:value-of select="concat(current-grouping-key(), '=', count(current-group()), '/', sum(current-group()/qty))"/></xsl:for-each-group></xsl:template>""")  # fmt: skip


@query(f"""WITH g AS (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM (SELECT *, (l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY i))::INT AS s FROM ({LINES})))
           SELECT l_orderkey, string_agg(l_returnflag || n, ',' ORDER BY g) AS out FROM (SELECT l_orderkey, g, l_returnflag, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY l_orderkey""")
def xslt_group_adjacent(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:variable name="all" as="xs:string*"><xsl:for-each-group select="order/line" group-adjacent="@flag"><xsl:sequence select="current-grouping-key() || count(current-group())"/></xsl:for-each-group></xsl:variable>
        <xsl:value-of select="$all" separator=","/></xsl:template>""")  # fmt: skip


@query(f"SELECT l_orderkey, string_agg(q::VARCHAR, ',' ORDER BY q DESC, i) AS out FROM ({LINES}) GROUP BY l_orderkey")
def xslt_sort(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:for-each select="order/line"><xsl:sort select="qty" data-type="number" order="descending"/><xsl:if test="position() != 1">,</xsl:if><xsl:value-of select="qty"/></xsl:for-each></xsl:template>""")  # fmt: skip


@query(f"SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') || ' ' || coalesce(string_agg(q::VARCHAR, '+' ORDER BY i) FILTER (l_returnflag = 'N'), '') AS out FROM ({LINES}) GROUP BY l_orderkey")
def xslt_key(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:key name="by-flag" match="line" use="@flag"/><xsl:template match="/"><xsl:value-of select="count(key('by-flag', 'N'))"/><xsl:text> </xsl:text><xsl:value-of select="key('by-flag', 'N')/qty" separator="+"/></xsl:template>""")  # fmt: skip


@query(f"SELECT l_orderkey, string_agg(i || '.' || q, ' ' ORDER BY i) AS out FROM ({LINES}) GROUP BY l_orderkey")
def xslt_number(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:for-each select="order/line"><xsl:if test="position() &gt; 1"><xsl:text> </xsl:text></xsl:if><xsl:number level="single" count="line" format="1"/>.<xsl:value-of select="qty"/></xsl:for-each></xsl:template>""")  # fmt: skip


@query(f"""WITH r AS (SELECT *, sum(q) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM ({LINES}))
           SELECT l_orderkey, string_agg(run::VARCHAR, ',' ORDER BY i) FILTER (run - q < 60) || CASE WHEN max(run) FILTER (run - q < 60) >= 60 THEN '!' ELSE '.' END AS out FROM r GROUP BY l_orderkey""")
def xslt_iterate(spark, sf_dir):
    return transformed(orders(spark, sf_dir), "l_orderkey", """
        <xsl:template match="/"><xsl:iterate select="order/line"><xsl:param name="run" select="0"/><xsl:on-completion>.</xsl:on-completion>
        <xsl:variable name="now" select="$run + xs:integer(qty)"/><xsl:if test="position() &gt; 1">,</xsl:if><xsl:value-of select="$now"/>
        <xsl:choose><xsl:when test="$now &gt;= 60"><xsl:break>!</xsl:break></xsl:when><xsl:otherwise><xsl:next-iteration><xsl:with-param name="run" select="$now"/></xsl:next-iteration></xsl:otherwise></xsl:choose></xsl:iterate></xsl:template>""")  # fmt: skip


@query("SELECT p_partkey, p_size || ':' || (CASE WHEN p_size < 2 THEN 1 ELSE p_size % 7 + p_size * 2 END) || ':' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: '[' || w || ']'), ' ') AS out FROM part")
def xslt_functions(spark, sf_dir):
    return transformed(parts(spark, sf_dir), "p_partkey", """
        <xsl:param name="factor" select="2"/><xsl:variable name="seven" select="7"/>
        <xsl:function name="f:mixed" as="xs:integer"><xsl:param name="n" as="xs:integer"/><xsl:sequence select="if ($n lt 2) then 1 else $n mod $seven + $n * $factor"/></xsl:function>
        <xsl:template match="/"><xsl:value-of select="part/@size, f:mixed(xs:integer(part/@size))" separator=":"/>:<xsl:analyze-string select="string(part/type)" regex="[A-Z]+"><xsl:matching-substring>[<xsl:value-of select="."/>]</xsl:matching-substring>
        <xsl:non-matching-substring><xsl:value-of select="."/></xsl:non-matching-substring></xsl:analyze-string></xsl:template>""")  # fmt: skip


@query("SELECT p_partkey, '<item code=\"' || p_partkey || '\"><name>' || p_name || '</name><kind big=\"' || CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END || '\"/></item>' AS out FROM part")
def xslt_construct(spark, sf_dir):
    sheet = """<xsl:stylesheet version="3.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"><xsl:output method="xml" omit-xml-declaration="yes"/>
        <xsl:template match="part"><xsl:element name="item"><xsl:attribute name="code" select="@id"/><xsl:copy-of select="name"/><kind big="{if (@size &gt; 25) then 'yes' else 'no'}"/></xsl:element></xsl:template></xsl:stylesheet>"""
    return api.xslt_transform(parts(spark, sf_dir), "xml", sheet).select("p_partkey", F.col("result.value").alias("out"))


@query("SELECT p_partkey, 'hidden' AS out, 1 AS n, p_brand AS said FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'shown', 0, NULL FROM part WHERE p_size <= 40")
def xslt_secondary(spark, sf_dir):
    sheet = SHEET.format("""<xsl:template match="/"><xsl:choose><xsl:when test="part/@size &gt; 40">hidden<xsl:message select="string(part/brand)"/><xsl:result-document href="b.txt" method="text"><xsl:value-of select="part/brand"/></xsl:result-document></xsl:when>
        <xsl:otherwise>shown</xsl:otherwise></xsl:choose></xsl:template>""")
    found = api.xslt_transform(parts(spark, sf_dir), "xml", sheet)
    return found.select("p_partkey", F.col("result.value").alias("out"), F.size("result.secondary").alias("n"), F.get("result.messages", 0).alias("said"))


# --- validation, output, inclusion ---

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="order"><xs:complexType><xs:sequence><xs:element name="line" maxOccurs="5"><xs:complexType><xs:sequence>
    <xs:element name="qty"><xs:simpleType><xs:restriction base="xs:integer"><xs:maxInclusive value="45"/></xs:restriction></xs:simpleType></xs:element><xs:element name="price" type="xs:decimal"/></xs:sequence>
    <xs:attribute name="flag" use="required"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="R"/><xs:enumeration value="N"/><xs:enumeration value="A"/></xs:restriction></xs:simpleType></xs:attribute>
    <xs:attribute name="part" type="xs:long" use="required"/></xs:complexType></xs:element></xs:sequence><xs:attribute name="key" type="xs:long"/></xs:complexType>
    <xs:unique name="parts"><xs:selector xpath="line"/><xs:field xpath="@part"/></xs:unique></xs:element></xs:schema>"""


@query(f"""SELECT l_orderkey, max(q) FILTER (i <= 5) > 45 AS facet, count(*) > 5 AS content, count(DISTINCT l_partkey) < count(*) AS again,
                  count(*) <= 5 AND max(q) <= 45 AND count(DISTINCT l_partkey) = count(*) AS valid FROM ({LINES}) GROUP BY l_orderkey""")
def xsd_orders(spark, sf_dir):
    found = api.validate(orders(spark, sf_dir), "xml", "xsd", XSD)
    has = lambda kinds: F.exists("issues", lambda i: i["kind"].isin(*kinds))
    facet, again = has(["FacetViolation"]), has(["UniqueNotSatisfied", "KeyNotUnique", "UniqueViolation"])
    content = has(["UnexpectedElement", "MissingElement", "ContentModel", "TooManyOccurrences"])
    return found.select("l_orderkey", facet.alias("facet"), content.alias("content"), again.alias("again"), (F.size("issues") == 0).alias("valid"))


RNG = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><start><element name="part"><attribute name="id"><data type="long"/></attribute>
    <attribute name="size"><data type="integer"><param name="maxInclusive">30</param></data></attribute><element name="name"><text/></element><element name="type"><text/></element>
    <element name="brand"><choice><value>Brand#11</value><value>Brand#12</value><value>Brand#13</value></choice></element><element name="price"><data type="decimal"/></element></element></start></grammar>"""


@query("SELECT p_partkey, p_size <= 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS valid FROM part")
def relaxng_parts(spark, sf_dir):
    return api.validate(parts(spark, sf_dir), "xml", "relaxng", RNG).select("p_partkey", (F.size("issues") == 0).alias("valid"))


DTD = "<!DOCTYPE part [<!ELEMENT part (name, type, brand, price)><!ELEMENT name (#PCDATA)><!ELEMENT type (#PCDATA)><!ELEMENT brand (#PCDATA)><!ELEMENT price (#PCDATA)><!ATTLIST part id CDATA #REQUIRED size (1|2|3|4|5|6|7|8|9|10) #REQUIRED>]>"


@query("SELECT p_partkey, p_size <= 10 AND p_partkey % 3 <> 0 AS valid FROM part")
def dtd_parts(spark, sf_dir):
    xml = F.when(F.col("p_partkey") % 3 == 0, F.replace("xml", F.lit("</part>"), F.lit("<more/></part>"))).otherwise(F.col("xml"))
    docs = parts(spark, sf_dir).select("p_partkey", F.concat(F.lit(DTD), xml).alias("xml"))
    return api.validate(docs, "xml", "dtd").select("p_partkey", (F.size("issues") == 0).alias("valid"))


SCHEMATRON = """<schema xmlns="http://purl.oclc.org/dsdl/schematron" queryBinding="xslt2"><pattern><rule context="order"><assert test="sum(line/qty) &lt;= 100">too heavy</assert><report test="count(line) = 1">single</report></rule></pattern>
    <pattern><rule context="line[@flag = 'R']"><assert test="qty &lt; 40">large return</assert></rule></pattern></schema>"""


@query(f"SELECT l_orderkey, (sum(q) > 100)::BIGINT AS heavy, (count(*) = 1)::BIGINT AS single, count(*) FILTER (l_returnflag = 'R' AND q >= 40) AS large FROM ({LINES}) GROUP BY l_orderkey")
def schematron_orders(spark, sf_dir):
    found = api.validate(orders(spark, sf_dir), "xml", "schematron", SCHEMATRON)
    said = lambda text: F.size(F.filter("issues", lambda i: i["message"] == text)).cast("long")
    return found.select("l_orderkey", said("too heavy").alias("heavy"), said("single").alias("single"), said("large return").alias("large"))


@query("SELECT p_partkey, '<part id=\"' || p_partkey || '\" size=\"' || p_size || '\"><name>' || p_name || '</name><e></e></part>' AS canonical FROM part")
def c14n_parts(spark, sf_dir):
    xml = F.concat(F.lit("<?xml version='1.0'?><part   size='"), F.col("p_size"), F.lit("' id='"), F.col("p_partkey"), F.lit("'><name>"), F.col("p_name"), F.lit("</name><!-- gone --><e/></part>"))
    return api.c14n(read(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml").select("p_partkey", F.col("canonical.value").alias("canonical"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY l_orderkey")
def subtree_stream(spark, sf_dir):
    from canopy.streaming.readers import subtrees

    found = subtrees(orders(spark, sf_dir), "l_orderkey", "xml", path="/order/line")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.regexp_extract("xml", "<qty>([0-9]+)", 1).cast("long")).alias("q"))


@query("SELECT p_partkey, p_size % 2 = 0 AS ok, CASE WHEN p_size % 2 = 1 THEN '<p><a>' || p_size || '</a></p>' ELSE '<p><a>' || p_size || '</a></p>' END AS repaired FROM part")
def recover_parts(spark, sf_dir):
    xml = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<p><a>"), F.col("p_size"), F.lit("</a></p>"))).otherwise(F.concat(F.lit("<p><a>"), F.col("p_size")))
    docs = read(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"))
    whole = api.xpath_query(api.repair(docs, "xml"), "xml", "count(//a)", "number", into="read")
    return whole.select("p_partkey", F.col("read.error").isNull().alias("ok"), F.col("repaired.value").alias("repaired"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS inner_, 1 AS outer_ FROM part")
def xpath_namespaces(spark, sf_dir):
    """Unprefixed names of a path mean the default namespace given, or none."""
    from canopy.plans.relational import Paths
    from canopy.sources.xml import parse_nodes

    inner = F.when(F.col("p_partkey") % 2 == 0, F.lit('<a xmlns="">2</a>')).otherwise(F.lit(""))
    docs = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('<r xmlns="urn:x"><a>1</a><b>'), inner, F.lit("</b></r>")).alias("xml"))
    nodes = parse_nodes(docs, "p_partkey", "xml")
    plain, bound = Paths(nodes).select("//a").select("doc_id"), Paths(nodes, {"": "urn:x"}).select("/r/a").groupBy("doc_id").agg(F.count("*").cast("int").alias("outer_"))
    found = docs.select(F.col("p_partkey").alias("doc_id")).join(plain.withColumn("inner_", F.lit(True)), "doc_id", "left").join(bound, "doc_id", "left")
    return found.select(F.col("doc_id").alias("p_partkey"), F.coalesce("inner_", F.lit(False)).alias("inner_"), "outer_")
