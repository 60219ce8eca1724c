"""Parent-child rows to full hierarchies.

Nodes are put into fragments of bounded size in which parents lie near their children:
pointers go a few steps along each node's first parent up to a head, which a hash
chooses, and what shares a head shares a fragment; clusters that are too large are
split. Inside a fragment, chains of parents are contracted to the fragment's exits
(parents that lie in other fragments). Nodes that other fragments enter form, with these
contracted links, a smaller quotient graph, which is solved in the same way. Its solution
then expands every fragment.

No task holds more than about ``bound`` links or ``PATH_ELEMENTS`` elements of paths, and
paths leave it in batches as they are found. A quotient that hardly shrinks (a graph so
dense that fragments contract nothing, or one with very many paths between few nodes) is
solved by joins that double the length of what they know, whatever its size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.session import durable

#: Links solved in one task.
FRAGMENT_LINKS = 50_000
#: Elements of paths that the links of one task may hold in all.
PATH_ELEMENTS = 1_000_000
#: One of so many nodes is a head, and pointers take so many steps on the way to one.
HEAD_EVERY, STEPS = 3, 3
#: A round that leaves more than this share of the links has stalled; after ``STALLS`` in a row joins take over.
STALLED, STALLS = 0.8, 2
#: Elements of paths in one batch that leaves a task.
_BATCH = 200_000
#: Parent values that mean that a node is a root.
ROOT_MARKS = ("", "owl:thing", "owl_thing")


def normal_id(c: Column | str) -> Column:
    """Ids compare trimmed, in lower case and with ':' equal to '_'."""
    return F.lower(F.translate(F.trim(F.col(c) if isinstance(c, str) else c), ":", "_"))


def clean_links(rows: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """Distinct (node, parent) in normal form; parent is null for a root's row."""
    p = normal_id(parent)
    return (
        rows.select(normal_id(child).alias("node"), F.when(~p.isin(*[m.replace(":", "_") for m in ROOT_MARKS]), p).alias("parent"))
        .where(F.col("node").isNotNull() & (F.col("node") != ""))
        .distinct()
    )


def _placement(rows: DataFrame, k: int, bound: int, seed: int) -> DataFrame:
    """(node, frag): the fragment of each a."""
    head = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(HEAD_EVERY)) == 0
    first = rows.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
    at = durable(first.select("node", F.when(head | F.col("up").isNull(), F.col("node")).otherwise(F.col("up")).alias("ptr")))
    step = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
    for _ in range(STEPS):
        at = at.join(step, "ptr", "left").select("node", F.coalesce("next", "ptr").alias("ptr"))
    at = durable(at)
    most = max(1, bound // 4)
    wide = at.groupBy("ptr").agg(F.count("*").alias("n")).where(F.col("n") > most)
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "node"), F.ceil(F.col("n") / most))).otherwise(0)
    return at.join(wide, "ptr", "left").select("node", F.pmod(F.xxhash64(F.lit(seed), "ptr", part), F.lit(k)).cast("int").alias("frag"))


def _fragments(rows: DataFrame, k: int, bound: int, seed: int) -> DataFrame:
    """``rows`` with the fragments ``fa`` of a and ``fb`` of b; ``fb`` is null where b has no row of its own."""
    at = _placement(rows, k, bound, seed)
    return rows.join(at.select(F.col("node").alias("a"), F.col("frag").alias("fa")), "a").join(at.select(F.col("node").alias("b"), F.col("frag").alias("fb")), "b", "left")


# Loops -------------------------------------------------------------------------


def _components(nodes: list[str], up: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components, each after all that it reaches."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    done: set[str] = set()
    stack: list[str] = []
    out: list[list[str]] = []
    for start in nodes:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        work = [(start, iter(up.get(start, ())))]
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    work.append((w, iter(up.get(w, ()))))
                    break
                if w not in done:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    comp = []
                    while True:
                        w = stack.pop()
                        done.add(w)
                        comp.append(w)
                        if w == v:
                            break
                    out.append(comp)
    return out


def _is_loop(comp: list[str], up: dict[str, list[str]]) -> bool:
    return len(comp) > 1 or comp[0] in up.get(comp[0], ())


def _columns(t: pa.Table) -> Iterator[tuple]:
    return zip(*(t.column(c).to_pylist() for c in t.column_names if c != "frag"), strict=True)


_FOUND = "kind int, a string, b string"
_LINK, _ENTRY, _LOOP, _WANTED = 0, 1, 2, 3


def _contract(t: pa.Table) -> pa.Table:
    """Links from entries to the exits that they reach, and local loops.

    Where these links would outnumber those of the fragment, its own links are given instead.
    """
    links, entries = [], set()
    for kind, a, b in _columns(t):
        links.append((a, b)) if kind == _LINK else entries.add(a)
    inside = {a for a, _ in links}
    up: dict[str, list[str]] = defaultdict(list)
    exits: dict[str, list[str]] = defaultdict(list)
    for a, b in links:
        (up if b in inside else exits)[a].append(b)
    comps = _components(list(inside), up)
    out = [(_LOOP, v, min(comp)) for comp in comps if _is_loop(comp, up) for v in comp]
    reach: dict[str, frozenset[str]] = {}
    nothing: frozenset[str] = frozenset()
    held = made = 0
    short = []
    for comp in comps:  # what a component reaches comes before it
        own = set(comp)
        parts = {reach[w] for v in comp for w in up.get(v, ()) if w not in own} - {nothing}
        direct = frozenset(x for v in comp for x in exits.get(v, ()))
        got = direct if not parts else next(iter(parts)) if len(parts) == 1 and not direct else nothing.union(direct, *parts)
        held += len(got) if got is direct or len(parts) != 1 or direct else 0
        for v in comp:
            reach[v] = got
            if v in entries:
                made += len(got)
                short.append((v, got))
        if made > len(links) or held > 8 * len(links):
            return _found(out + [(_LINK, a, b) for a, b in links])
    return _found(out + [(_LINK, v, x) for v, got in short for x in got])


def _expand_loops(t: pa.Table) -> pa.Table:
    """Nodes of the fragment that lie in one loop of the quotient graph.

    One node stands for each such loop, below its entries and above its exits; what then
    lies in a loop with that node lies in the loop.
    """
    up: dict[object, list] = defaultdict(list)
    for kind, a, b, label in _columns(t):
        if kind == _LOOP:
            up[(b,)].append(a)
        else:
            up[a].append(b)
            if label is not None:
                up[b].append((label,))
    out = []
    for comp in _components(list(up), up):
        marks = [v for v in comp if isinstance(v, tuple)]
        if marks and len(comp) > 1:
            out += [(_LOOP, v, marks[0][0]) for v in comp if not isinstance(v, tuple) and v in up]
    return _found(out)


def _found(rows: list[tuple[int, str, str]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string()), strict=True)], names=["kind", "a", "b"])


def _labels(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == _LOOP).select(F.col("a").alias("node"), F.col("b").alias("label"))


def _solve_loops(links: DataFrame, n: int, bound: int, depth: int = 0, stalls: int = 0) -> DataFrame:
    """(node, label) of all nodes in loops of ``links(a, b)``; one label for each loop."""
    if n <= bound:
        return _labels(links.select(F.lit(0).alias("frag"), F.lit(_LINK).alias("kind"), "a", "b").groupBy("frag").applyInArrow(_contract, _FOUND))
    if stalls >= STALLS:
        return _loops_by_joins(links)
    links = durable(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))  # a node without children is in no loop
    n = links.count()
    if n <= bound:
        return _solve_loops(links, n, bound)
    rows = durable(_fragments(links, -(-n // bound), bound, depth).where("fb is not null"))  # nor one without parents
    none = F.lit(None).cast("string")
    entries = rows.where("fa <> fb").select(F.col("fb").alias("frag"), F.lit(_ENTRY).alias("kind"), F.col("b").alias("a"), none.alias("b")).distinct()
    done = durable(rows.select(F.col("fa").alias("frag"), F.lit(_LINK).alias("kind"), "a", "b").unionByName(entries).groupBy("frag").applyInArrow(_contract, _FOUND))
    quotient = done.where(F.col("kind") == _LINK).select("a", "b").distinct()
    local = _labels(done)
    m = quotient.count()
    if m == 0:
        return local
    inner = durable(_solve_loops(quotient, m, bound, depth + 1, stalls + 1 if m > STALLED * n else 0))
    # only fragments that a loop of the quotient enters have something to expand
    at = rows.where("fa <> fb").select(F.col("b").alias("node"), F.col("fb").alias("frag")).unionByName(rows.select(F.col("a").alias("node"), F.col("fa").alias("frag"))).distinct()
    marks = inner.join(at, "node").select("frag", F.lit(_LOOP).alias("kind"), F.col("node").alias("a"), F.col("label").alias("b"), none.alias("label"))
    marks = durable(marks)
    out = inner.select(F.col("node").alias("b"), "label")
    own = rows.join(marks.select(F.col("frag").alias("fa")).distinct(), "fa", "left_semi").join(out, "b", "left").select(F.col("fa").alias("frag"), F.lit(_LINK).alias("kind"), "a", "b", F.when(F.col("fa") != F.col("fb"), F.col("label")).alias("label"))
    found = _labels(own.unionByName(marks).groupBy("frag").applyInArrow(_expand_loops, _FOUND))
    return found.unionByName(local.join(found, "node", "left_anti")).distinct()


def _loops_by_joins(links: DataFrame) -> DataFrame:
    """As ``_solve_loops`` from all pairs of nodes, for graphs that fragments do not contract."""
    up = durable(reachable(links.select(F.col("a").alias("node"), F.col("b").alias("parent"))))
    looped = up.where("node = ancestor").select("node")
    back = up.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    return up.join(looped, "node", "left_semi").join(back, ["node", "ancestor"], "left_semi").groupBy("node").agg(F.min("ancestor").alias("label"))


def loop_nodes(links: DataFrame, *, bound: int = FRAGMENT_LINKS) -> DataFrame:
    """(node, label) of each node that is its own ancestor; nodes of one loop share a label.

    ``links`` has node and parent as ``clean_links`` gives them. A node that only hangs
    below a loop, or leads from one loop to another, is none. Null parents, parents
    that are no node and repeated links are harmless; an empty table gives no rows.
    """
    pairs = durable(links.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    return _solve_loops(pairs, pairs.count(), bound)


# Paths -------------------------------------------------------------------------

_PATHS = "node string, exit string, path array<string>, entry boolean"


class _Rows:
    """Path rows on their way out, as batches."""

    def __init__(self) -> None:
        self.node: list[str] = []
        self.exit: list[str | None] = []
        self.entry: list[bool] = []
        self.flat: list[str] = []
        self.ends = [0]

    def batch(self) -> pa.RecordBatch:
        path = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.flat, pa.string()))
        out = pa.RecordBatch.from_arrays([pa.array(self.node, pa.string()), pa.array(self.exit, pa.string()), path, pa.array(self.entry, pa.bool_())], names=["node", "exit", "path", "entry"])
        self.__init__()
        return out


def _paths_of(batches: Iterator[pa.RecordBatch], some: bool) -> Iterator[pa.RecordBatch]:
    """Each node's paths, with ``some`` those of entries and wanted nodes, up to an end or to the first node of another fragment.

    ``path`` starts with the node and leaves out the exit. The graph has no loops, so a
    search needs no memory but its own way up.
    """
    steps: dict[str, list[tuple[str | None, list[str]]]] = defaultdict(list)
    entries, wanted = set(), set()
    for batch in batches:
        for kind, a, b, part in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "part")), strict=True):
            steps[a].append((b, part)) if kind == _LINK else entries.add(a) if kind == _ENTRY else wanted.add(a)
    rows = _Rows()
    for node in [n for n in steps if n in entries or n in wanted] if some else steps:
        work: list[tuple[str, tuple | None]] = [(node, None)]
        while work:
            at, trail = work.pop()
            for b, part in steps[at]:
                way = (part, trail)
                if b in steps:
                    work.append((b, way))
                    continue
                parts = []
                while way:
                    parts.append(way[0])
                    way = way[1]
                rows.flat.extend(chain.from_iterable(reversed(parts)))
                rows.ends.append(len(rows.flat))
                rows.node.append(node)
                rows.exit.append(b)
                rows.entry.append(node in entries)
                if len(rows.flat) > _BATCH:
                    yield rows.batch()
    yield rows.batch()


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _paths_of(batches, some=False)


def _some_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _paths_of(batches, some=True)


def _solve_paths(rows: DataFrame, bound: int, depth: int = 0, stalls: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """(node, path) for rows (a, b, part): from a over part, which starts with a, to b, or to an end where b is null.

    With ``wanted`` (node) only the paths of these nodes are listed.
    """
    local_paths = _local_paths if wanted is None else _some_paths
    asked = lambda df: df if wanted is None else df.join(wanted, "node", "left_semi")
    mark = lambda frag, kind, node: (F.col(frag).alias("frag"), F.lit(kind).alias("kind"), F.col(node).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("array<string>").alias("part"))
    n, elements = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("part")), F.lit(0))).first()
    k = max(-(-n // bound), -(-elements // PATH_ELEMENTS))
    if k <= 1:
        own = rows.select(F.lit(0).alias("frag"), F.lit(_LINK).alias("kind"), "a", "b", "part")
        own = own if wanted is None else own.unionByName(wanted.withColumn("frag", F.lit(0)).select(*mark("frag", _WANTED, "node")))
        return own.groupBy("frag").applyInArrow(local_paths, _PATHS).select("node", "path")
    if stalls >= STALLS:
        return asked(_paths_by_joins(rows))
    placed = durable(_fragments(rows, k, bound, depth))
    marks = placed.where("fa <> fb").select(*mark("fb", _ENTRY, "b")).dropDuplicates(["frag", "a"])
    if wanted is not None:
        marks = marks.unionByName(placed.join(wanted.withColumnRenamed("node", "a"), "a", "left_semi").select("fa", "a").distinct().select(*mark("fa", _WANTED, "a")))
    own = placed.select(F.col("fa").alias("frag"), F.lit(_LINK).alias("kind"), "a", "b", "part")
    local = durable(own.unionByName(marks).groupBy("frag").applyInArrow(local_paths, _PATHS))
    quotient = local.where("entry").select(F.col("node").alias("a"), F.col("exit").alias("b"), F.col("path").alias("part"))
    further = None if wanted is None else durable(asked(local).where("exit is not null").select(F.col("exit").alias("node")).distinct())
    inner = durable(_solve_paths(quotient, bound, depth + 1, stalls + 1 if quotient.count() > STALLED * n else 0, further))
    whole = asked(local).where("exit is null").select("node", "path")
    rest = asked(local).where("exit is not null").join(inner.select(F.col("node").alias("exit"), F.col("path").alias("more")), "exit")
    return whole.unionByName(rest.select("node", F.concat("path", "more").alias("path")))


def _paths_by_joins(rows: DataFrame) -> DataFrame:
    """As ``_solve_paths`` by joins: each doubles the links that a path is made of, and none has more rows than there are paths."""
    while not rows.where("b is not null").isEmpty():
        on = rows.select(F.col("a").alias("b"), F.col("b").alias("next"), F.col("part").alias("more"))
        further = rows.where("b is not null").join(on, "b").select("a", F.col("next").alias("b"), F.concat("part", "more").alias("part"))
        rows = durable(rows.where("b is null").unionByName(further))
    return rows.select(F.col("a").alias("node"), F.col("part").alias("path"))


def _path_rows(links: DataFrame, loops: DataFrame) -> DataFrame:
    """Links as rows (a, b, part) of ``_solve_paths``; paths end at loop nodes.

    The end of a path is told by a mark behind its last node, which no normal id can be.
    """
    looped = loops.select("node", F.lit(True).alias("looped"))
    nodes = links.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    # a root's own row counts only where the node has no parent in another row
    has = links.where("parent is not null").select("node", F.lit(True).alias("has")).distinct()
    l = links.join(looped, "node", "left").join(nodes, "parent", "left").join(has, "node", "left").where(F.col("parent").isNotNull() | F.col("has").isNull())
    part = (
        F.when(F.col("looped"), F.array("node", F.lit("#loop")))
        .when(F.col("parent").isNull(), F.array("node", F.lit("#root")))
        .when(F.col("known").isNull(), F.array("node", "parent", F.lit("#missing")))
        .otherwise(F.array("node"))
    )
    goes_on = F.col("looped").isNull() & F.col("known")
    return durable(l.select(F.col("node").alias("a"), F.when(goes_on, F.col("parent")).alias("b"), part.alias("part")).distinct())


def _ended(node: Column, marked: Column) -> list[Column]:
    size = F.size(marked) - 1
    path = F.slice(marked, F.lit(1), size)
    return [node, path.alias("path"), (size - 1).alias("depth"), F.element_at(path, -1).alias("root"), F.substring(F.element_at(marked, -1), 2, 10).alias("ending")]


def node_paths(links: DataFrame, loops: DataFrame | None = None, *, bound: int = FRAGMENT_LINKS) -> DataFrame:
    """All paths from each node to its roots: (node, path, depth, root, ending).

    ``path`` runs from the node to the root, both included; ``depth`` is its length
    less one. ``ending`` is ``root``, ``missing`` (the last parent has no row of its
    own) or ``loop``: a path ends at the first node that is in a loop, so a node in a
    loop has the one path of itself. A node with several parents has several paths.
    The rows number as the paths do, and these can double with each node of two
    parents; ``shortest_paths`` has a row for each link.
    """
    loops = durable(loop_nodes(links, bound=bound)) if loops is None else loops
    return _solve_paths(_path_rows(links, loops), bound).select(*_ended(F.col("node"), F.col("path")))


_LENGTHS = "kind int, a string, b string, w long"


def _lengths(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "a", "b", "w"])


def _in_order(links: list[tuple]) -> tuple[list[str], dict[str, list[tuple]]]:
    """Nodes of a fragment without loops, each after its parents, and their links."""
    own: dict[str, list[tuple]] = defaultdict(list)
    for a, b, w in links:
        own[a].append((b, w))
    return [c[0] for c in _components(list(own), {a: [b for b, _ in x if b in own] for a, x in own.items()})], own


def _contract_lengths(t: pa.Table) -> pa.Table:
    """Shortest ways from entries to exits and ends; the links themselves where these are fewer."""
    links, entries = [], set()
    for kind, a, b, w in _columns(t):
        links.append((a, b, w)) if kind == _LINK else entries.add(a)
    order, own = _in_order(links)
    best: dict[str, dict] = {}
    held = made = 0
    for a in order:
        got = best[a] = {}
        for b, w in own[a]:
            for x, more in best[b].items() if b in own else ((b, 0),):
                if w + more < got.get(x, w + more + 1):
                    got[x] = w + more
        held += len(got)
        made += len(got) if a in entries else 0
        if made > len(links) or held > 8 * len(links):
            return _lengths([(_LINK, a, b, w) for a, b, w in links])
    return _lengths([(_LINK, a, x, w) for a in order if a in entries for x, w in best[a].items()])


def _settle(t: pa.Table) -> pa.Table:
    """Shortest length from each node of a fragment to an end, by those of its exits (kind _ENTRY)."""
    links, known = [], {None: 0}
    for kind, a, b, w in _columns(t):
        if kind == _LINK:
            links.append((a, b, w))
        else:
            known[a] = w
    order, own = _in_order(links)
    for a in order:
        known[a] = min(w + known[b] for b, w in own[a])
    return _lengths([(_LINK, a, None, known[a]) for a in order])


def _solve_lengths(rows: DataFrame, bound: int, depth: int = 0, stalls: int = 0) -> DataFrame:
    """(node, length): of rows (a, b, w) without loops the least sum of w from each a to an end, where b is null."""
    n = rows.count()
    out = (F.col("a").alias("node"), F.col("w").alias("length"))
    if n <= bound:
        return rows.select(F.lit(0).alias("frag"), F.lit(_LINK).alias("kind"), "a", "b", "w").groupBy("frag").applyInArrow(_settle, _LENGTHS).select(*out)
    if stalls >= STALLS:
        return _lengths_by_joins(rows)
    placed = durable(_fragments(rows, -(-n // bound), bound, depth))
    own = placed.select(F.col("fa").alias("frag"), F.lit(_LINK).alias("kind"), "a", "b", "w")
    mark = lambda c: (F.lit(_ENTRY).alias("kind"), F.col("b").alias("a"), F.lit(None).cast("string").alias("b"), c.alias("w"))
    entries = placed.where("fa <> fb").select(F.col("fb").alias("frag"), *mark(F.lit(None).cast("long"))).distinct()
    quotient = durable(own.unionByName(entries).groupBy("frag").applyInArrow(_contract_lengths, _LENGTHS).groupBy("a", "b").agg(F.min("w").alias("w")))
    inner = durable(_solve_lengths(quotient, bound, depth + 1, stalls + 1 if quotient.count() > STALLED * n else 0))
    exits = placed.where("fa <> fb").select(F.col("fa").alias("frag"), "b").distinct().join(inner.withColumnRenamed("node", "b"), "b")
    return own.unionByName(exits.select("frag", *mark(F.col("length")))).groupBy("frag").applyInArrow(_settle, _LENGTHS).select(*out)


def _lengths_by_joins(rows: DataFrame) -> DataFrame:
    """As ``_solve_lengths`` by joins, one link further each time; for dense graphs, whose shortest ways have few links."""
    known = durable(rows.where("b is null").groupBy("a").agg(F.min("w").alias("length")))
    before, now = None, (0, 0)
    while now != before:
        step = rows.where("b is not null").join(known.withColumnRenamed("a", "b"), "b").select("a", (F.col("w") + F.col("length")).alias("length"))
        known = durable(known.unionByName(step).groupBy("a").agg(F.min("length").alias("length")))
        before, now = now, tuple(known.agg(F.count("*"), F.sum("length")).first())
    return known.withColumnRenamed("a", "node")


def shortest_paths(links: DataFrame, loops: DataFrame | None = None, *, bound: int = FRAGMENT_LINKS) -> DataFrame:
    """(node, parent, path, depth, root, ending): for each link the shortest path that begins with it.

    ``path``, ``depth``, ``root`` and ``ending`` are as in ``node_paths``. Of equally short
    ways the one over the smaller parent holds at each step. A node without parents, and one
    in a loop, has one row, with a null parent. All paths of a node are its links followed by
    the paths of their parents, so the rows give every path, though there are as many as links.
    """
    loops = durable(loop_nodes(links, bound=bound)) if loops is None else loops
    rows = _path_rows(links, loops)
    # the least length to an end makes one parent of each node the next on its way: a forest
    lengths = durable(_solve_lengths(rows.select("a", "b", F.size("part").cast("long").alias("w")), bound))
    total = F.size("part") + F.coalesce("length", F.lit(0))
    valued = rows.join(lengths.withColumnRenamed("node", "b"), "b", "left")
    forest = durable(valued.groupBy("a").agg(F.min(F.struct(total.alias("n"), F.coalesce("b", F.get("part", F.lit(1))).alias("via"), "b", "part")).alias("x")).select("a", "x.b", "x.part"))
    whole = durable(_solve_paths(forest, bound)).select(F.col("node").alias("b"), F.col("path").alias("more"))
    every = rows.join(whole, "b", "left").select("a", F.element_at("part", -1).alias("_end"), F.coalesce("b", F.when(F.element_at("part", -1) == "#missing", F.get("part", F.lit(1)))).alias("parent"), F.when(F.col("b").isNull(), F.col("part")).otherwise(F.concat("part", "more")).alias("marked"))
    return every.select(F.col("a").alias("node"), "parent", *_ended(F.col("a"), F.col("marked"))[1:])


def reachable(links: DataFrame) -> DataFrame:
    """(ancestor, node, distance): each pair once with its smallest distance, through loops as well.

    A node in a loop is its own ancestor. Paths are not listed, so many paths between two
    nodes cost no more than one. After each join all pairs up to twice the distance are
    known: a pair at a greater distance has a node between at exactly the last one.
    """
    pairs = durable(links.where("parent is not null").select(F.col("parent").alias("ancestor"), "node").distinct().withColumn("distance", F.lit(1)))
    reach = 1
    while not (far := pairs.where(F.col("distance") == reach)).isEmpty():
        on = pairs.select(F.col("node").alias("_via"), F.col("ancestor").alias("_top"), F.col("distance").alias("_more"))
        more = far.join(on, F.col("ancestor") == F.col("_via")).select(F.col("_top").alias("ancestor"), "node", (F.col("_more") + reach).alias("distance"))
        pairs = durable(pairs.unionByName(more).groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        reach *= 2
    return pairs


def as_written(nodes: DataFrame, rows: DataFrame, child: str = "id") -> DataFrame:
    """The ids of ``nodes(node)`` as they stand in ``rows``, each spelling once."""
    names = rows.select(F.col(child).alias("id"), normal_id(child).alias("node")).distinct()
    return names.join(nodes.select("node").distinct(), "node", "left_semi").select("id")


def reachable_pairs_bruteforce(pairs: Iterable[tuple[str, str]]) -> set[tuple[str, str]]:
    """All (node, ancestor) by plain search, for tests on small fixtures."""
    up: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs:
        up[a].add(b)
    out = set()
    for start in list(up):
        seen: set[str] = set()
        work = [start]
        while work:
            for w in up.get(work.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    work.append(w)
        out |= {(start, w) for w in seen}
    return out
