"""Registered queries of the general table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.operators import hierarchy_links as H
from taxoflow.operators import rejects as R
from taxoflow.session import durable, table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return R.load_lines(table(spark, d, "sample_lines").where("line_no > 1"), table(spark, d, "sample_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.rejected(_lines(spark, d)).where(F.col("reason") != R.FILE).select("line_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return R.accepted(_lines(spark, d)).select("line_id", "sample_id", "sample")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """All lines that do not load, those of unknown files too, with the cell that failed."""
    return R.rejected(_lines(spark, d)).select("line_id", "reason", "failing_cell")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ontology_specs")
    return H.as_written(H.loop_nodes(H.clean_links(rows)), rows)


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = H.shortest_paths(durable(H.clean_links(table(spark, d, "ontology_specs"))))
    return paths.select("node", "parent", F.array_join("path", "/").alias("path"), "depth", "root", "ending")


def p5_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return H.reachable(durable(H.clean_links(table(spark, d, "ontology_specs"))))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return p5_ancestors(spark, d).groupBy("ancestor").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_rejects": p1_rejects, "p5_found": p5_found, "p5_paths": p5_paths, "p5_ancestors": p5_ancestors, "p5_descendants": p5_descendants}

_PARTS = """
l AS (SELECT line_id, coalesce(raw_line, '') AS t, delim, id_prefix,
    len(string_split(header_line, delim)) AS n
  FROM sample_lines JOIN sample_files USING (file_id) WHERE line_no > 1),
q AS (SELECT *, CASE WHEN delim = ',' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
    ELSE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') END AS quoted,
    CASE WHEN delim = ',' THEN regexp_extract_all(',' || t, '(?s),((?:"(?:[^"]|"")*"|[^",]*))', 1)
    ELSE regexp_extract_all(chr(9) || t, '(?s)\t((?:"(?:[^"]|"")*"|[^"\t]*))', 1) END AS f FROM l),
v AS (SELECT *, list_transform(f, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS g FROM q),
w AS (SELECT *, trim(g[1], ' \t\r\n') AS sid, array_to_string(g[2:], ' ') AS txt FROM v),
r AS (SELECT line_id, sid, txt, t, id_prefix, CASE WHEN NOT quoted THEN 'quoting' WHEN t = '' OR len(f) <> n THEN 'columns'
    WHEN NOT (starts_with(sid, id_prefix) AND regexp_full_match(substr(sid, length(id_prefix) + 1), '[0-9]+'))
      OR NOT regexp_matches(txt, '\\p{L}') OR regexp_matches(t, '[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{FFFD}]') THEN 'value' END AS reason FROM w)
"""

_TREE = """
l AS (SELECT DISTINCT replace(lower(trim(id)), ':', '_') AS node,
    CASE WHEN replace(lower(trim(parent_id)), ':', '_') NOT IN ('', 'owl_thing') THEN replace(lower(trim(parent_id)), ':', '_') END AS parent
  FROM ontology_specs WHERE trim(id) <> ''),
e AS (SELECT DISTINCT node, parent FROM l WHERE parent IS NOT NULL),
reach AS (SELECT node AS a, parent AS b FROM e UNION SELECT r.a, e.parent FROM reach r JOIN e ON r.b = e.node)
"""

_BROKEN = "regexp_matches(t, '[\\x00-\\x08\\x0a-\\x1f\\x7f\\x{FFFD}]')"
ORACLE = {
    "p1_rejects": f"""WITH {_PARTS} SELECT line_id, reason, CASE WHEN reason = 'value' THEN
    CASE WHEN {_BROKEN} THEN 'character' WHEN NOT regexp_matches(txt, '\\p{{L}}') AND starts_with(sid, id_prefix) AND regexp_full_match(substr(sid, length(id_prefix) + 1), '[0-9]+') THEN 'Sample' ELSE 'SampleId' END END AS failing_cell
  FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT line_id, 'file', NULL FROM sample_lines LEFT JOIN sample_files USING (file_id) WHERE line_no > 1 AND (sample_files.file_id IS NULL OR length(coalesce(delim, '')) <> 1)""",
    "p1_found": f"WITH {_PARTS} SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p1_loaded": f"WITH {_PARTS} SELECT line_id, sid AS sample_id, trim(txt, ' \t') AS sample FROM r WHERE reason IS NULL",
    "p5_found": f"WITH RECURSIVE {_TREE} SELECT DISTINCT id FROM ontology_specs WHERE replace(lower(trim(id)), ':', '_') IN (SELECT a FROM reach WHERE a = b)",
    "p5_paths": f"""WITH RECURSIVE {_TREE},
c AS (SELECT DISTINCT a AS node FROM reach WHERE a = b),
known AS (SELECT DISTINCT node FROM l),
up AS (SELECT node, parent FROM e WHERE node NOT IN (SELECT node FROM c)),
ends AS (SELECT node, CASE WHEN node IN (SELECT node FROM c) THEN 'loop' ELSE 'root' END AS ending FROM known WHERE node NOT IN (SELECT node FROM up)
  UNION ALL SELECT DISTINCT parent, 'missing' FROM up WHERE parent NOT IN (SELECT node FROM known)),
far AS (SELECT node, 0 AS depth FROM ends UNION SELECT up.node, far.depth + 1 FROM far JOIN up ON up.parent = far.node),
near AS (SELECT node, min(depth) AS depth FROM far GROUP BY node),
nxt AS (SELECT up.node, arg_min(up.parent, near.depth::VARCHAR.lpad(9, '0') || up.parent) AS parent FROM up JOIN near ON near.node = up.parent GROUP BY up.node),
way AS (SELECT node, node AS path, 0 AS depth, node AS root, ending FROM ends
  UNION ALL SELECT nxt.node, nxt.node || '/' || way.path, way.depth + 1, way.root, way.ending FROM way JOIN nxt ON nxt.parent = way.node)
SELECT up.node, up.parent, up.node || '/' || way.path AS path, way.depth + 1 AS depth, way.root, way.ending FROM up JOIN way ON way.node = up.parent
UNION ALL SELECT node, NULL, node, 0, node, ending FROM ends WHERE ending <> 'missing'""",
}
# Distances end below the bound; no shortest way in these tables is nearly as long, so it only stops loops.
_ANCESTORS = f"""{_TREE},
d AS (SELECT parent AS ancestor, node, 1 AS distance FROM e UNION SELECT e.parent, d.node, d.distance + 1 FROM d JOIN e ON d.ancestor = e.node WHERE d.distance < 400),
m AS (SELECT ancestor, node, min(distance) AS distance FROM d GROUP BY ALL)"""
ORACLE["p5_ancestors"] = f"WITH RECURSIVE {_ANCESTORS} SELECT ancestor, node, distance FROM m"
ORACLE["p5_descendants"] = f"WITH RECURSIVE {_ANCESTORS} SELECT ancestor, count(*) AS n_descendants, max(distance) AS height FROM m GROUP BY ancestor"
