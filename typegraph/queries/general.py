"""Queries of the general data-preparation problems (1, 3, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.functions.names import bare_key, file_key, last_segment, relation_key, target_key
from typegraph.operators.hierarchy import descendants, hierarchy
from typegraph.operators.incremental import run_history
from typegraph.operators.orphans import orphan_references
from typegraph.operators.skew import dominant_keys, key_statistics
from typegraph.plans.scratch import Scratch
from typegraph.session import table




def p1_type_stats(spark: SparkSession, d: str) -> DataFrame:
    """References to and distinct referrers of every type, per table."""
    edges, calls = table(spark, d, "type_edges"), table(spark, d, "call_sites")
    e = key_statistics(edges, F.col("edge_id"), target_key(F.col("to_type"), F.col("to_resolved")), bare_key(F.col("from_type")))
    c = key_statistics(calls, F.col("call_id"), target_key(F.col("callee_type"), F.lit(False)), bare_key(F.col("caller_type")))
    return e.withColumn("src_table", F.lit("type_edges")).unionByName(c.withColumn("src_table", F.lit("call_sites")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that at least 2 percent of the references of a table bear."""
    stats = Scratch(spark, "stats").save(p1_type_stats(spark, d))  # one row per name, read twice
    return dominant_keys(stats, "src_table", 2).select("src_table", "type_key")


def inheritance_links(spark: SparkSession, d: str) -> DataFrame:
    """(node, parent): the base type that holds for each derived type."""
    edges, nodes = table(spark, d, "type_edges"), table(spark, d, "type_nodes")
    e = edges.filter(relation_key(F.col("relation")) == "inherits").select(
        "edge_id", "seen_at",
        F.coalesce("to_resolved", F.lit(False)).alias("full"),
        bare_key(F.col("from_type")).alias("node"),
        target_key(F.col("to_type"), F.col("to_resolved")).alias("target"),
    ).filter("node is not null and target is not null")
    declared = nodes.select(bare_key(F.col("type_name")).alias("__full")).filter("__full is not null")
    declared = declared.groupBy(last_segment(F.col("__full")).alias("__simple")).agg(F.min("__full").alias("__full"))
    e = e.join(declared, (F.col("target") == F.col("__simple")) & ~F.col("full"), "left")
    e = e.withColumn("parent", F.coalesce("__full", "target")).filter("node <> parent")
    last = F.max(F.struct("seen_at", "edge_id", "parent")).alias("e")
    return e.groupBy("node").agg(last).select("node", "e.parent")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth, path and state of every type that has a parent."""
    h = hierarchy(inheritance_links(spark, d), spark)
    return h.select(
        F.col("node").alias("type_key"), F.col("root").alias("root_key"), F.col("depth").alias("node_depth"),
        F.coalesce(F.array_join("path", " > "), F.lit("")).alias("full_path"), F.col("state").alias("node_state"),
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants and height of every base type that is neither on a circle nor below one."""
    pairs = descendants(hierarchy(inheritance_links(spark, d), spark))
    return pairs.groupBy(F.col("ancestor").alias("type_key")).agg(
        F.count("*").alias("n_descendants"), F.max("distance").alias("height")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows each succeeded run had to take up."""
    f = table(spark, d, "file_fragments")
    rows = f.select(
        file_key(F.col("file_path")).alias("key"), "scanned_at", F.col("fragment_id").cast("bigint").alias("fragment_id"),
        F.col("is_gone").alias("gone"), F.col("hash").alias("digest"), "arrived_at",
    )
    return run_history(spark, rows, table(spark, d, "scan_runs"), Scratch(spark, "incremental").root)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to types that did not exist when the reference was seen."""
    edges, calls = table(spark, d, "type_edges"), table(spark, d, "call_sites")
    nodes, ext = table(spark, d, "type_nodes"), table(spark, d, "external_types")
    # one key space for full (F:) and simple (S:) names
    kind = F.when(F.coalesce(F.col("to_resolved"), F.lit(False)), F.lit("F:")).otherwise(F.lit("S:"))
    refs = edges.select(
        F.lit("type_edges").alias("src_table"), F.col("edge_id").alias("ref_id"),
        F.concat(kind, target_key(F.col("to_type"), F.col("to_resolved"))).alias("key"), "seen_at",
    ).unionByName(calls.select(
        F.lit("call_sites").alias("src_table"), F.col("call_id").alias("ref_id"),
        F.concat(F.lit("S:"), target_key(F.col("callee_type"), F.lit(False))).alias("key"), "seen_at",
    ))
    never = F.lit(None).cast("timestamp_ntz")
    own = nodes.select(bare_key(F.col("type_name")).alias("n"), F.col("seen_at").alias("born"), F.col("removed_at").alias("died"))
    parents = own.select(F.concat(F.lit("F:"), "n").alias("key"), "born", "died")
    parents = parents.unionByName(own.select(F.concat(F.lit("S:"), last_segment(F.col("n"))).alias("key"), "born", "died"))
    parents = parents.unionByName(ext.select(F.concat(F.lit("F:"), bare_key(F.col("type_name"))).alias("key"), never.alias("born"), never.alias("died")))
    parents = parents.unionByName(ext.select(F.concat(F.lit("S:"), bare_key(F.col("simple_name"))).alias("key"), never.alias("born"), never.alias("died")))
    return orphan_references(spark, refs, parents.filter("key is not null"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return p5_found(spark, d).groupBy("src_table", "seen_month", "reason").agg(F.count("*").alias("n_refs"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_type_stats, p3_found, p3_descendants, p4_found, p5_found, p5_report)
}


def _bare(c: str) -> str:
    """SQL for a bare upper-case name of the test tables."""
    # type arguments go by the depth of their brackets
    parts = f"list_transform(regexp_extract_all({c}, '[<>]|[^<>]+'), lambda x: {{'d': 0, 's': x}})"
    step = (
        "CASE WHEN b.s = '<' THEN {'d': a.d + 1, 's': a.s} WHEN b.s = '>' AND a.d > 0 THEN {'d': a.d - 1, 's': a.s} "
        "WHEN a.d > 0 THEN a ELSE {'d': a.d, 's': a.s || b.s} END"
    )
    plain = f"CASE WHEN contains({c}, '<') THEN (list_reduce(list_prepend({{'d': 0, 's': ''}}, {parts}), lambda a, b: {step})).s ELSE {c} END"
    plain = f"regexp_replace({plain}, '`[0-9]+', '', 'g')"
    lead = "(?:(?:ref|out|in|params|readonly|scoped|this|new|typeof|nameof)[\\s(]+)*"
    return f"upper(nullif(regexp_extract({plain}, '^[\\s(]*{lead}(?:\\w+\\s*::\\s*)?(\\w+(?:\\.\\w+)*)', 1), ''))"


def _file(c: str) -> str:
    """SQL for the one key of all spellings of a file."""
    p = f"replace({c}, chr(92), '/')"
    parts = f"list_transform(list_filter(string_split({p}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])"
    step = (
        "CASE WHEN b[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] "
        f"WHEN b[1] = '..' AND len(a) = 0 AND starts_with({p}, '/') THEN a ELSE list_concat(a, b) END"
    )
    walked = f"array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), {parts}), lambda a, b: {step}), '/')"
    return f"upper(CASE WHEN {c} IS NULL THEN NULL WHEN starts_with({p}, '/') THEN '/' ELSE '' END || {walked})"


def _target(c: str, resolved: str) -> str:
    return f"CASE WHEN coalesce({resolved}, false) THEN {_bare(c)} ELSE regexp_extract({_bare(c)}, '[^.]*$') END"


_P1 = f"""
WITH r AS (
  SELECT DISTINCT 'type_edges' AS src_table, edge_id AS id, {_target('to_type', 'to_resolved')} AS type_key, {_bare('from_type')} AS referrer FROM type_edges
  UNION ALL
  SELECT DISTINCT 'call_sites', call_id, {_target('callee_type', 'false')}, {_bare('caller_type')} FROM call_sites),
s AS (SELECT src_table, type_key, count(*) AS n_refs, count(DISTINCT referrer) AS n_referrers FROM r GROUP BY 1, 2)"""

_P3 = f"""
WITH RECURSIVE d AS (
  SELECT regexp_extract(n, '[^.]*$') AS simple, min(n) AS full_name FROM (SELECT {_bare('type_name')} AS n FROM type_nodes) GROUP BY 1),
e AS (
  SELECT edge_id, seen_at, {_bare('from_type')} AS node, {_target('to_type', 'to_resolved')} AS target, coalesce(to_resolved, false) AS is_full
  FROM type_edges WHERE lower(trim(relation)) = 'inherits'),
r AS (SELECT e.*, coalesce(CASE WHEN NOT is_full THEN d.full_name END, target) AS parent FROM e LEFT JOIN d ON e.target = d.simple),
p AS (
  SELECT node, arg_max(parent, (seen_at, edge_id)) AS parent FROM r
  WHERE node IS NOT NULL AND parent IS NOT NULL AND node <> parent GROUP BY node),
w AS (
  SELECT node, [parent] AS path FROM p
  UNION ALL
  SELECT w.node, list_append(w.path, p.parent) FROM w JOIN p ON p.node = w.path[-1]
  WHERE NOT list_contains(w.path[:-2], w.path[-1])),
f AS (SELECT node, arg_max(path, len(path)) AS path FROM w GROUP BY node),
g AS (
  SELECT node, path, list_contains(path[:-2], path[-1]) AS round,
         list_position(path, path[-1]) AS first_at FROM f),
h AS (
  SELECT *, CASE WHEN round THEN path[first_at:] END AS ring FROM g)
"""

SQL = {
    "p1_type_stats": _P1 + " SELECT type_key, n_refs, n_referrers, src_table FROM s",
    "p1_found": _P1 + """, t AS (SELECT src_table, sum(n_refs) AS total FROM s GROUP BY 1)
SELECT s.src_table, type_key FROM s JOIN t USING (src_table) WHERE type_key IS NOT NULL AND n_refs * 100 >= 2 * total""",
    "p3_found": _P3 + """
SELECT node AS type_key,
  CASE WHEN round THEN list_aggregate(ring, 'min') ELSE path[-1] END AS root_key,
  CAST(CASE WHEN NOT round THEN len(path) WHEN list_contains(ring, node) THEN -1 ELSE first_at END AS INTEGER) AS node_depth,
  CASE WHEN round THEN '' ELSE array_to_string(list_append(list_reverse(path), node), ' > ') END AS full_path,
  CASE WHEN NOT round THEN 'tree' WHEN list_contains(ring, node) THEN 'cycle' ELSE 'below_cycle' END AS node_state
FROM h""",
    "p3_descendants": _P3 + """
SELECT a AS type_key, count(*) AS n_descendants, CAST(max(i) AS INTEGER) AS height
FROM (SELECT unnest(path) AS a, generate_subscripts(path, 1) AS i FROM h WHERE NOT round) GROUP BY a""",
    "p4_found": f"""
WITH ok AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY started_at, run_id) AS prev
            FROM (SELECT DISTINCT run_id, started_at FROM scan_runs WHERE status = 'succeeded' AND started_at IS NOT NULL)),
f AS (SELECT DISTINCT fragment_id, scanned_at, arrived_at, coalesce(is_gone, false) AS gone,
        CASE WHEN regexp_full_match(hash, '[0-9A-Fa-f]{{40}}') THEN upper(hash) END AS digest,
        {_file('file_path')} AS k
      FROM file_fragments),
r AS (SELECT f.*, ok.run_id, ok.started_at FROM f JOIN ok ON f.arrived_at < ok.started_at AND (ok.prev IS NULL OR f.arrived_at >= ok.prev)),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k, run_id ORDER BY scanned_at DESC, fragment_id DESC) = 1),
up AS (SELECT *, max(scanned_at) OVER (PARTITION BY k ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM one),
live AS (SELECT * FROM up WHERE seen IS NULL OR scanned_at > seen),
l AS (SELECT *, lag(gone) OVER w AS old_gone, lag(digest) OVER w AS old_digest FROM live WINDOW w AS (PARTITION BY k ORDER BY started_at))
SELECT run_id, fragment_id FROM l
WHERE CASE WHEN gone THEN coalesce(NOT old_gone, false)
           ELSE coalesce(old_gone, true) OR coalesce(digest <> old_digest, true) END""",
}
_P5 = f"""
WITH own AS (SELECT {_bare('type_name')} AS n, seen_at AS born, removed_at AS died FROM type_nodes),
life AS (SELECT 'F:' || n AS k, born, died FROM own UNION ALL SELECT 'S:' || regexp_extract(n, '[^.]*$'), born, died FROM own),
ext AS (SELECT 'F:' || {_bare('type_name')} AS k FROM external_types UNION SELECT 'S:' || {_bare('simple_name')} FROM external_types),
ref AS (
  SELECT DISTINCT 'type_edges' AS src_table, edge_id AS ref_id, seen_at,
    CASE WHEN coalesce(to_resolved, false) THEN 'F:' ELSE 'S:' END || {_target('to_type', 'to_resolved')} AS k FROM type_edges
  UNION ALL SELECT DISTINCT 'call_sites', call_id, seen_at, 'S:' || {_target('callee_type', 'false')} FROM call_sites),
j AS (
  SELECT src_table, ref_id, seen_at, ref.k,
    count(life.k) AS n, count(CASE WHEN born <= seen_at AND (died IS NULL OR seen_at < died) THEN 1 END) AS alive, min(died) AS first_death
  FROM ref LEFT JOIN life ON ref.k = life.k
  WHERE ref.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ext WHERE ext.k = ref.k)
  GROUP BY ALL),
o AS (
  SELECT src_table, ref_id, CASE WHEN n = 0 THEN 'missing' WHEN first_death <= seen_at THEN 'deleted' ELSE 'late' END AS reason,
    strftime(seen_at, '%Y-%m') AS seen_month FROM j WHERE alive = 0)"""
SQL["p5_found"] = _P5 + " SELECT src_table, ref_id, reason, seen_month FROM o"
SQL["p5_report"] = _P5 + " SELECT src_table, seen_month, reason, count(*) AS n_refs FROM o GROUP BY 1, 2, 3"
