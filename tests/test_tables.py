"""Line loading and hierarchies: defined results in odd cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from taxoflow.operators import hierarchy_links as H
from taxoflow.operators import rejects as R

FILES = [(1, ",", "SampleId,Sample", "A-"), (2, "\t", "SampleId\tSample\t\tSample", "b7"), (3, None, "x", "A-"), (4, ";", "Sample;SampleId", "")]
LINES = [
    (1, 1, "A-12,beef", None), (2, 1, ' A-12 ,"a ""b"" c, d"', None), (3, 1, 'A-1,say "hi"', "quoting"), (4, 1, 'A-1,"open', "quoting"), (5, 1, 'A-1, "x"', "quoting"), (6, 1, "", "columns"),
    (7, 1, "   ", "columns"), (8, 1, None, "columns"), (9, 1, "A-1", "columns"), (10, 1, "A-1,b,c", "columns"), (11, 1, "A-1x,beef", "value"), (12, 1, "A-,beef", "value"), (13, 1, "A-٣,beef", "value"),
    (14, 1, "A-1,12.5", "value"), (15, 1, "A-1,be\x07ef", "value"), (16, 1, "A-1,be�ef", "value"), (17, 1, "A-1,be\ref", "value"), (18, 1, "A-1,a\tb", None), (19, 1, "A-1,çé", None),
    (20, 2, "b712\tx\t\t", None), (21, 2, "b7\tx\t\t", "value"), (22, 2, "b712\tx", "columns"), (23, 2, 'b712\t"a\tb"\t\t', None), (24, 3, "A-1,beef", "file"), (25, 99, "A-1,beef", "file"), (26, 4, "beef;007", None),
    (27, 1, "﻿A-1,beef", "value"), (28, 1, "A-1," + "x" * 2_000_000, None), (1, 1, "A-12,beef", None), (29, 1, "A-1,\x00", "value"), (30, 1, 'A-1,""', "value"), (31, 1, 'A-"1",b', "quoting"),
]


def test_lines(spark):
    lines = spark.createDataFrame([(i, f, t, "x", "y") for i, f, t, _ in LINES], "line_id long, file_id long, raw_line string, reason string, sample string")
    files = spark.createDataFrame([(*f, 1) for f in FILES], "file_id long, delim string, header_line string, id_prefix string, line_id int")
    got = R.load_lines(lines, files).collect()
    assert sorted((r.line_id, r.reason or "") for r in got) == sorted((i, w or "") for i, _, _, w in LINES)
    by = {r.line_id: r for r in got}
    assert (by[2].sample_id, by[2].sample) == ("A-12", 'a "b" c, d')
    assert by[23].sample == "a\tb"
    assert (by[26].sample_id, by[26].sample) == ("007", "beef")
    assert len(by[28].sample) == 2_000_000
    assert (by[12].failing_cell, by[14].failing_cell, by[16].failing_cell) == ("SampleId", "Sample", "character")
    assert R.load_lines(lines.limit(0), files).count() == 0
    assert {r.reason for r in R.load_lines(lines, files.limit(0)).collect()} == {"file"}


def _links(spark, pairs):
    return spark.createDataFrame(pairs, "node string, parent string")


def test_clean_links(spark, rows):
    df = spark.createDataFrame([(" X:1", "y_1", 0), ("x_1", "Y:1", 0), ("z", "owl:Thing", 0), ("w", "", 0), (None, "q", 0), ("", "q", 0)], "id string, parent_id string, node int")
    assert rows(H.clean_links(df)) == [("w", None), ("x_1", "y_1"), ("z", None)]
    assert rows(H.as_written(H.clean_links(df).where("node = 'x_1'"), df)) == [(" X:1",), ("x_1",)]


def test_loops_against_plain_search(spark):
    rng = random.Random(7)
    for bound in (10_000, 25):
        pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)} | {("s", "s")}
        want = {a for a, b in H.reachable_pairs_bruteforce(pairs) if a == b}
        got = {r.node for r in H.loop_nodes(_links(spark, sorted(pairs)), bound=bound).collect()}
        assert got == want


def test_paths_in_fragments(spark):
    rng = random.Random(3)
    pairs = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 40)] + [("n5", "n1"), ("n9", "lost"), ("n0", None), ("a", "b"), ("b", "a"), ("c", "a")]
    whole = {(r.node, tuple(r.path), r.ending, r.depth, r.root) for r in H.node_paths(_links(spark, pairs)).collect()}
    parts = {(r.node, tuple(r.path), r.ending, r.depth, r.root) for r in H.node_paths(_links(spark, pairs), bound=15).collect()}
    assert whole == parts
    assert ("c", ("c", "a"), "loop", 1, "a") in whole
    assert ("a", ("a",), "loop", 0, "a") in whole
    assert ("n9", ("n9", "lost"), "missing", 1, "lost") in whole
    rows_of = lambda df: sorted((r.node, *r.path) for r in df.collect())
    pieces = spark.createDataFrame([(a, None if b == "lost" else b, [a] + (["lost"] if b == "lost" else [])) for a, b in pairs if a not in "abc"], "a string, b string, part array<string>")
    assert rows_of(H._paths_by_joins(pieces)) == rows_of(H._solve_paths(pieces, 15)) == sorted((n, *p) for n, p, e, _, _ in whole if n not in ("a", "b", "c"))


def test_shortest_paths(spark, monkeypatch):
    rng = random.Random(4)
    pairs = sorted({(f"n{i:02}", f"n{rng.randrange(i):02}") for i in range(1, 40) for _ in range(1 + (i % 5 == 0))}) + [("n09", "lost"), ("n07", "a"), ("n00", None), ("n05", None), ("a", "b"), ("b", "a"), ("c", "a")]
    links = _links(spark, pairs)
    best = {}
    for r in H.node_paths(links).collect():
        key = (r.node, r.path[1] if r.depth else None)
        best[key] = min(best.get(key, (999,)), (r.depth, tuple(r.path), r.root, r.ending))
    for bound in (10_000, 15):
        got = {(r.node, r.parent): (r.depth, tuple(r.path), r.root, r.ending) for r in H.shortest_paths(links, bound=bound).collect()}
        assert {k: (v[0], v[3]) for k, v in got.items()} == {k: (v[0], v[3]) for k, v in best.items()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in best.items()}
    monkeypatch.setattr(H, "STALLS", 0)
    again = {(r.node, r.parent): (r.depth, tuple(r.path), r.root, r.ending) for r in H.shortest_paths(links, bound=15).collect()}
    assert again == got
    assert H.shortest_paths(links.limit(0)).count() == 0
    assert H.shortest_paths(_links(spark, [x for i in range(40) for x in [(f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}")]]), bound=50).count() == 160


def test_ancestors_through_loops(spark):
    rng = random.Random(5)
    fixed = [("below", "a"), ("a", "b"), ("b", "a"), ("b", "top"), ("top", "c"), ("c", "d"), ("d", "c"), ("d", "root"), ("root", None), ("self", "self"), ("self", "lost")]
    for pairs in (fixed, sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(48)})):
        got = {(r.node, r.ancestor): r.distance for r in H.reachable(_links(spark, pairs)).collect()}
        assert set(got) == H.reachable_pairs_bruteforce([(a, b) for a, b in pairs if b])
        if pairs is fixed:
            assert (got["below", "root"], got["a", "a"], got["below", "c"], got["self", "lost"]) == (6, 2, 4, 1)
    assert H.reachable(_links(spark, [("x", None)])).count() == 0


def test_dense_loops_by_joins(spark):
    rng = random.Random(11)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)})
    want = {a for a, b in H.reachable_pairs_bruteforce(pairs) if a == b}
    links = _links(spark, pairs)
    by_joins = {r.node: r.label for r in H._loops_by_joins(links.toDF("a", "b")).collect()}
    by_fragments = {r.node: r.label for r in H.loop_nodes(links, bound=10).collect()}
    assert set(by_joins) == set(by_fragments) == want
    same = lambda x: {frozenset(k for k in x if x[k] == v) for v in x.values()}
    assert same(by_joins) == same(by_fragments)


def test_deep_chain_and_empty(spark):
    chain = _links(spark, [(f"n{i}", f"n{i + 1}" if i < 149 else None) for i in range(150)])
    r = H.node_paths(chain, bound=60).agg(F.max("depth"), F.count("*")).first()
    assert tuple(r) == (149, 150)
    assert H.reachable(chain).count() == 149 * 150 // 2
    assert H.loop_nodes(chain.limit(0)).count() == 0
    assert H.node_paths(chain.limit(0)).count() == 0
    assert H.reachable(chain.limit(0)).count() == 0


def test_very_long_chain_and_ring(spark):
    n = 100_000
    up = F.concat(F.lit("n"), F.col("id") + 1)
    chain = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") < n - 1, up).alias("parent"))
    assert H.loop_nodes(chain, bound=30_000).count() == 0
    ring = chain.unionByName(_links(spark, [(f"n{n - 1}", "n50000")]))
    r = H.loop_nodes(ring, bound=30_000).agg(F.count("*"), F.countDistinct("label")).first()
    assert tuple(r) == (50_000, 1)


def test_many_paths_between_few_nodes(spark, monkeypatch):
    diamond = lambda i: [(f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}")]
    stack = _links(spark, [x for i in range(40) for x in diamond(i)])  # 2 ** 40 paths
    assert H.reachable(stack).where("node = 'd0'").count() == 120
    assert H.loop_nodes(stack, bound=50).count() == 0
    back = stack.unionByName(_links(spark, [("d40", "d0")]))
    assert H.loop_nodes(back, bound=50).count() == 121
    monkeypatch.setattr(H, "PATH_ELEMENTS", 200)
    few = _links(spark, [x for i in range(8) for x in diamond(i)] + [("d8", None)])
    assert H.node_paths(few, bound=20).where("node = 'd0'").select("path").distinct().count() == 256


def test_one_parent_of_very_many(spark):
    star = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.when(F.col("id") % 3 > 0, "n0").otherwise(F.concat(F.lit("n"), F.col("id") - 2))).alias("parent"))
    assert H.node_paths(star, bound=100).count() == 3000
    assert H.loop_nodes(star.unionByName(_links(spark, [("n0", "n7")])), bound=100).count() == 2
