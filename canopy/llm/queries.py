"""Queries of the corpus operators for the driver: one op<N>_<name> each, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import classifier, decontaminate, exact_dedup, line_dedup, mixing, secrets, sharding, simhash, url_filter, warc
from canopy.llm.common import literal_table, shared_dir, table

#: Host, path, verdict of the listed URLs.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mark(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.mark(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.pages_of(warc.read_archive(spark, path, with_payload=False))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    marked = simhash.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the listed URLs."""
    rules = literal_table(spark, list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and place."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's overlap with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secrets.mark(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its group of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark(docs).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    found = (op1_line_dedup, op2_mixing, op3_quality_classifier, op4_warc, op5_simhash_dedup, op6_url_filter, op7_sharding, op8_decontamination, op9_secret_scan, op10_exact_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op2_mixing": r"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
                 s AS (SELECT source, sum(size)::BIGINT AS n, count(*) AS rows FROM d GROUP BY source),
                 w AS (SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1)::INT % 3] AS w, 3 * n AS cap FROM s),
                 -- Water filling: sources by cap a weight, each full if what those before leave would fill it.
                 f AS (SELECT *, (sum(n) OVER ())::HUGEINT - coalesce(sum(cap) OVER o, 0) AS left_, (sum(w) OVER ())::HUGEINT - coalesce(sum(w) OVER o, 0) AS of_
                       FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
                 g AS (SELECT *, left_ * w >= cap::HUGEINT * of_ AS is_full FROM f),
                 t AS (SELECT sum(n) - sum(cap) FILTER (is_full) AS l1, sum(n) AS l0, sum(w) FILTER (NOT is_full) AS of_ FROM g),
                 k AS (SELECT g.source, n AS source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (coalesce(l1, l0) * w)::DOUBLE / t.of_::DOUBLE END AS target,
                              ('0x' || md5('mix-1|' || CASE WHEN g.source IS NULL THEN 'n' ELSE 's' || g.source END)[1:8])::BIGINT / 4294967296.0::DOUBLE AS o FROM g, t),
                 p AS (SELECT doc_id, size, source_size, target, o, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                              row_number() OVER (PARTITION BY d.source ORDER BY size, ('0x' || md5('mix-1|' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT, doc_id) AS nth
                       FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
                 c AS (SELECT *, (floor(rate * nth + o) - floor(rate * (nth - 1) + o))::BIGINT AS copies FROM p)
            SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c""",
        "op1_line_dedup": r"""
            WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
                 e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
                 w AS (SELECT *, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
                              len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM e),
                 -- The shortest runs of 50 words that start or end with a line; every longer run is covered by such runs.
                 s AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
                       UNION SELECT a.doc_id, max(b.i), a.i AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.upto - b.upto + b.n >= 50 GROUP BY ALL),
                 p AS (SELECT s.doc_id, s.i, s.j, array_to_string(l.lines[s.i : s.j], chr(10)) AS passage FROM s JOIN l USING (doc_id)),
                 r AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS nth FROM p),
                 d AS (SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS i FROM r WHERE nth > 1),
                 g AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g, i FROM d),
                 m AS (SELECT doc_id, min(i) - 1 AS a, max(i) - 1 AS b FROM g GROUP BY doc_id, g),
                 x AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS deleted, sum(b - a + 1) AS n_deleted FROM m GROUP BY doc_id),
                 k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) AS kept FROM e LEFT JOIN d ON e.doc_id = d.doc_id AND e.i = d.i WHERE d.i IS NULL GROUP BY e.doc_id)
            SELECT l.doc_id, coalesce(k.kept, '') AS text, len(l.lines)::BIGINT AS n_lines, coalesce(x.n_deleted, 0)::BIGINT AS n_deleted, coalesce(x.deleted, '') AS deleted
            FROM l LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "op4_warc": r"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
                 g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h)
            SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
            FROM p LEFT JOIN g USING (h)""",
        "op6_url_filter": r"""
            WITH r(key_host, key_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                     ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
                 u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
                 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
                 m AS (SELECT page_id, host, path, key_host || key_path AS rule, rule_verdict,
                              row_number() OVER (PARTITION BY page_id ORDER BY length(key_host || key_path) DESC NULLS LAST, length(key_host) DESC) AS nth
                       FROM p LEFT JOIN r ON (host = key_host OR ends_with(host, '.' || key_host)) AND starts_with(path, key_path))
            SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE nth = 1""",
        "op10_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
                 g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
            SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
            FROM n JOIN g USING (t)""",
    }
