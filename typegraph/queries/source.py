"""Queries that read the source texts: extraction and the graph built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.extract.scan import fragments
from typegraph.operators.rank import pagerank
from typegraph.operators.slices import budget_members, longest_spans
from typegraph.plans.index import build_graph
from typegraph.plans.joins import spread
from typegraph.plans.scratch import Scratch
from typegraph.session import table
from typegraph.sources.files import is_source, plan_scan


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The C# files of the table, one row per path."""
    f = table(spark, d, "source_files").filter(is_source(F.col("file_path")) & F.col("code").isNotNull())
    return spread(f.select("file_path", "code").distinct(), spark, "file_path")


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark, "fragments").save(fragments(sources(spark, d)))


def source_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that the scan reads."""
    return table(spark, d, "source_files").select("file_path").distinct().filter(is_source(F.col("file_path")))


def extract_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Declared types with their spans and summaries."""
    return fragments(sources(spark, d)).select("file_path", F.explode("nodes").alias("x")).select("file_path", "x.*")


def extract_members(spark: SparkSession, d: str) -> DataFrame:
    """Constructors and methods with their signatures."""
    return fragments(sources(spark, d)).select("file_path", F.explode("members").alias("x")).select("file_path", "x.*")


def extract_usings(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces each file uses."""
    return fragments(sources(spark, d)).select("file_path", F.explode("usings").alias("namespace"))


def extract_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the members that serve requests."""
    x = fragments(sources(spark, d)).select("file_path", F.explode("endpoints").alias("x")).select("file_path", "x.*")
    return x.withColumn("line", F.col("line").cast("int"))


def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    """Written relations per label and target."""
    e = fragments(sources(spark, d)).select(F.explode("edges").alias("x")).select("x.*")
    return e.groupBy("relation", "to_type").agg(F.count("*").alias("n"))


def built_edges(spark: SparkSession, d: str) -> DataFrame:
    """Resolved edges of the graph built from the sources."""
    g = build_graph(_fragments(spark, d), spark)
    return g.edges.groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))


def built_calls(spark: SparkSession, d: str) -> DataFrame:
    """Resolved call-sites, those of chained receivers included."""
    g = build_graph(_fragments(spark, d), spark)
    return g.calls.select("caller", "member", "callee", "callee_member", "line", "file_path")


def built_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most central declared types of the sources (a report)."""
    g = build_graph(_fragments(spark, d), spark)
    r = pagerank(g.edges, spark).join(g.nodes.select("key", "kind"), "key")
    return r.orderBy(F.desc("rank"), "key").limit(15).select("key", "kind", F.round("rank", 9).alias("rank"))


def member_bodies(spark: SparkSession, d: str) -> DataFrame:
    """What a budget of sixty lines shows of each type's public members."""
    g = build_graph(_fragments(spark, d), spark)
    m = longest_spans(g.members.filter("is_public")).select("type_key", "member_name", "start_line", "end_line")
    return budget_members(m, 60).select("type_key", "member_name", "shown_lines", "show")


def scan_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a scan does if the store holds the files committed before April."""
    s = table(spark, d, "source_files").filter(is_source(F.col("file_path")) & F.col("code").isNotNull()).distinct()
    old = s.filter(F.col("committed_at") < F.expr("timestamp_ntz'2025-04-01'"))
    old = old.select("file_path", F.upper(F.sha1(F.regexp_replace("code", "^﻿", ""))).alias("hash"))
    return plan_scan(s.select("file_path", "code"), old)


QUERIES = {
    f.__name__: f
    for f in (
        source_paths, extract_nodes, extract_members, extract_endpoints, extract_usings, extract_relations, built_edges, built_calls, built_hubs,
        member_bodies, scan_plan,
    )
}
_IS_SOURCE = (
    "regexp_matches(lower(file_path), '[.]cs$') AND NOT regexp_matches(file_path, '(^|/)(obj|bin|[.]git|node_modules|[.]vs)/') "
    "AND NOT regexp_matches(lower(file_path), '[.](g|designer|assemblyinfo|globalusings[.]g)[.]cs$')"
)
#: Declarations by the lines of a file, as they are laid out here: a member stands at its type's inner indent, and a
#: closing brace at the indent of what it closes.
_MODIFIER = "(public|private|protected|internal|static|abstract|sealed|virtual|override|readonly|async|partial|extern|new|unsafe)"
_LINES = f"""
WITH src AS (SELECT DISTINCT file_path, regexp_split_to_array(ltrim(code, chr(65279)), '\\r\\n|\\n|\\r') AS ls FROM source_files WHERE code IS NOT NULL AND {_IS_SOURCE}),
line AS MATERIALIZED (SELECT file_path, unnest(ls) AS l, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS i FROM src),
ns AS (SELECT file_path, regexp_extract(l, '^namespace ([\\w.]+)', 1) AS namespace FROM line WHERE regexp_matches(l, '^namespace [\\w.]+')),
head AS MATERIALIZED (
  SELECT file_path, i, l, regexp_extract(l, '^[ \\t]*', 0) AS pad, regexp_extract(l, '^[ \\t]*(?:namespace [\\w.]+[{{])?(?:{_MODIFIER} +)*(class|interface|record|struct) (\\w+)', 2) AS kind,
    regexp_extract(l, '^[ \\t]*(?:namespace [\\w.]+[{{])?(?:{_MODIFIER} +)*(class|interface|record|struct) (\\w+)', 3) AS simple FROM line
  WHERE regexp_matches(l, '^[ \\t]*(namespace [\\w.]+[{{])?({_MODIFIER} +)*(class|interface|record|struct) \\w+')),
type AS MATERIALIZED (
  SELECT h.file_path, namespace, coalesce(namespace || '.', '') || simple AS name, simple, kind, h.l, h.pad, h.i,
    h.i - coalesce((SELECT count(*) FROM line b WHERE b.file_path = h.file_path AND b.i < h.i AND b.i > coalesce((SELECT max(c.i) FROM line c WHERE c.file_path = h.file_path AND c.i < h.i AND NOT regexp_matches(c.l, '^ *\\[')), 0)), 0) AS start_line,
    coalesce(CASE WHEN regexp_matches(h.l, ';\\s*$') OR (contains(h.l, '{{') AND length(replace(h.l, '{{', '')) = length(replace(h.l, '}}', ''))) THEN h.i END, (SELECT min(e.i) FROM line e WHERE e.file_path = h.file_path AND e.i > h.i AND starts_with(e.l, h.pad || '}}')), (SELECT max(e.i) FROM line e WHERE e.file_path = h.file_path AND trim(e.l) <> '')) AS end_line
  FROM head h LEFT JOIN ns USING (file_path))"""
_NODES = _LINES + """
SELECT t.file_path, name, coalesce(namespace, '') AS namespace, upper(kind[1]) || kind[2:] AS kind, regexp_matches(l, '^[ \\t]*(namespace [\\w.]+[{])?public ') AS is_public, CAST(start_line AS INTEGER) AS start_line, end_line,
  (SELECT nullif(regexp_replace(regexp_replace(string_agg(trim(regexp_replace(d.l, '^ *///', '')), ' ' ORDER BY d.i), '.*<summary> *(.*?) *</summary>.*', '\\1'), '\\s+', ' ', 'g'), '') FROM line d
   WHERE d.file_path = t.file_path AND d.i < start_line AND regexp_matches(d.l, '^ *///') AND d.i > coalesce((SELECT max(c.i) FROM line c WHERE c.file_path = t.file_path AND c.i < start_line AND NOT regexp_matches(c.l, '^ *///')), 0)) AS summary
FROM type t"""

_PLACED = _LINES + f""",
body AS MATERIALIZED (
  SELECT t.file_path, t.name, t.simple, t.end_line, o.i AS open_at,
    (SELECT regexp_extract(arg_min(b.l, b.i), '^[ \\t]*', 0) FROM line b WHERE b.file_path = t.file_path AND b.i > o.i AND trim(b.l) <> '') AS pad
  FROM type t JOIN (SELECT t.file_path, min(o.i) AS i FROM type t JOIN line o ON o.file_path = t.file_path AND o.i >= t.i AND regexp_matches(o.l, '[{{]\\s*$') GROUP BY 1) o USING (file_path)),
cand AS MATERIALIZED (
  SELECT b.*, l.i, l.l, regexp_extract(trim(l.l), '^((?:{_MODIFIER} )*)(.*?)(\\w+)(?:<[\\w, ]+>)?[(][^()]*[)]', ['m', 'x', 'ret', 'member']) AS p
  FROM body b JOIN line l ON l.file_path = b.file_path AND l.i > open_at AND l.i < end_line
    AND starts_with(l.l, pad) AND NOT regexp_matches(substring(l.l, length(pad) + 1, 1), '^[\\s}}{{/\\[#]')
    AND regexp_matches(l.l, '^[^=;(]*[(][^()]*[)]')),
found AS (SELECT *, p.ret = '' AND p.member = simple AS ctor FROM cand WHERE (p.ret <> '' OR p.member = simple) AND p.ret NOT LIKE '%operator%'),
placed AS (
  SELECT *, i - coalesce((SELECT count(*) FROM line b WHERE b.file_path = f.file_path AND b.i < f.i AND b.i > (SELECT max(c.i) FROM line c WHERE c.file_path = f.file_path AND c.i < f.i AND NOT regexp_matches(c.l, '^[ \\t]*\\['))), 0) AS start_line,
    CASE WHEN regexp_matches(f.l, ';\\s*$') OR (contains(f.l, '{{') AND length(replace(f.l, '{{', '')) = length(replace(f.l, '}}', ''))) THEN f.i
      ELSE (SELECT min(e.i) FROM line e WHERE e.file_path = f.file_path AND e.i > f.i AND (starts_with(e.l, pad || '}}') OR (NOT regexp_matches(f.l, '[)]\\s*$') AND regexp_matches(e.l, ';\\s*$')))) END AS last_line
  FROM found f)"""
_MEMBERS = _PLACED + """
SELECT file_path, name AS type_name, CASE WHEN ctor THEN '.ctor' ELSE p.member END AS member_name, CASE WHEN ctor THEN 'ctor' ELSE 'method' END AS kind,
  replace(regexp_replace(regexp_extract(trim(l), '^[^(]*[(][^()]*[)]', 0), ' ?([.<>()\\[\\],?]) ?', '\\1', 'g'), ',', ', ') AS signature, CAST(start_line AS INTEGER) AS start_line, coalesce(last_line, end_line) AS end_line, regexp_matches(p.m, '\\bpublic\\b') AS is_public FROM placed
UNION ALL
SELECT file_path, name, member, 'method', replace(regexp_replace(sig, ' ?([.<>()\\[\\],?]) ?', '\\1', 'g'), ',', ', '), i, i, contains(sig, 'public ') FROM (
  SELECT file_path, name, i, unnest(regexp_extract_all(l, '(?:(?:public|private|internal|static|async) )+[\\w<>]+ (\\w+)[(][^()]*[)]', 1)) AS member,
    unnest(regexp_extract_all(l, '(?:(?:public|private|internal|static|async) )+[\\w<>]+ (\\w+)[(][^()]*[)]', 0)) AS sig
  FROM type WHERE starts_with(l, 'namespace'))"""

_ENDPOINTS = _PLACED + """,
prefix AS (SELECT t.file_path, t.name, max(regexp_extract(a.l, '\\[Route[(]"([^"]*)"', 1)) AS prefix FROM type t
  JOIN line a ON a.file_path = t.file_path AND a.i >= t.start_line AND a.i < t.i AND contains(a.l, '[Route("') GROUP BY 1, 2),
e AS (
  SELECT p.file_path, p.name, p.p.member AS member, p.start_line, p.simple, coalesce(x.prefix, '') AS prefix, regexp_extract(a.l, '\\[Http(\\w+)', 1) AS verb,
    regexp_extract(a.l, '\\[Http\\w+[(]"([^"]*)"', 1) AS action FROM placed p LEFT JOIN prefix x USING (file_path, name)
  JOIN line a ON a.file_path = p.file_path AND a.i >= p.start_line AND a.i < p.i AND regexp_matches(a.l, '\\[Http(Get|Post|Put|Delete|Patch|Head|Options)\\b'))
SELECT file_path, name AS type_name, upper(verb) AS verb, coalesce('/' || nullif(array_to_string(list_filter([
    trim(replace(prefix, '[controller]', regexp_replace(simple, 'Controller$', '')), '/'), trim(action, '/')], lambda x: x <> ''), '/'), ''), nullif(action, ''), member) AS route,
  member AS method_name, start_line AS line FROM e"""
SQL = {
    "extract_nodes": _NODES,
    "extract_members": _MEMBERS,
    "extract_endpoints": _ENDPOINTS,
    "source_paths": f"SELECT DISTINCT file_path FROM source_files WHERE {_IS_SOURCE}",
    "extract_usings": f"""
SELECT file_path, regexp_extract(l, '^using ([A-Za-z0-9_.]+);', 1) AS namespace FROM (
  SELECT file_path, unnest(regexp_split_to_array(ltrim(code, chr(65279)), '\\r\\n|\\n|\\r')) AS l
  FROM (SELECT DISTINCT file_path, code FROM source_files WHERE code IS NOT NULL AND {_IS_SOURCE}))
WHERE regexp_matches(l, '^using [A-Za-z0-9_.]+;')""",
    "scan_plan": f"""
SELECT DISTINCT file_path, CASE WHEN committed_at < TIMESTAMP '2025-04-01' THEN 'same' ELSE 'new' END AS state
FROM source_files WHERE code IS NOT NULL AND {_IS_SOURCE}""",
}
