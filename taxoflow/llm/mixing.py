"""A training mix in which each source has its target share of the tokens.

Token budgets run down a tree: from all to the domains and their sources by target
shares, from a source to its languages by their tokens. What a node cannot fill within
its repeat limit goes to its siblings, and only what these cannot take goes up to the
next level. A leaf's budget is met by whole epochs and the token-prefix of one more, in
an order that is seeded for each epoch.

Domains and sources are planned on the driver, for their shares come from a short list.
Within a source, languages weigh and are limited by the same tokens, so each gets its
part of the source's budget; their number is not limited.

Prefixes are found without sorting a leaf: its tokens are summed in bins of the seeded
hash, the bins are added up, and only documents of the bin where the budget ends are
put in order.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.session import BROADCAST_ROWS, bounded_rows, durable

# Fixed value: how that public vocabulary's authors split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file may be at most this large, for every executor gets it.
TOKENIZER_BYTES = 16 << 20
#: Rows of the list of targets, which is planned on the driver.
TARGETS = 1_000_000
BINS = 1 << 14
#: A text is encoded in pieces of this many letters, cut after white space.
PIECE = 100_000


def _pieces(text: str) -> Iterator[str]:
    a = 0
    while len(text) - a > PIECE:
        b = text.rfind("\n", a + 1, a + PIECE)
        b = b if b > a else text.rfind(" ", a + 1, a + PIECE)
        b = b if b > a else a + PIECE
        yield text[a:b]
        a = b
    yield text[a:]


def token_counts(documents: DataFrame, text: str = "text", *, tokenizer: str) -> DataFrame:
    """``documents`` with a column ``n_tokens``; null and empty texts have 0.

    ``tokenizer`` is the path of the ranks of a byte-level BPE vocabulary, read by the driver.
    """
    path = Path(tokenizer)
    if path.stat().st_size > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} has more than {TOKENIZER_BYTES} bytes")
    data = documents.sparkSession.sparkContext.broadcast(path.read_bytes())
    schema = documents.schema
    at = schema.fieldNames().index(text)
    rest = [c for c in schema.fieldNames() if c not in (text, "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.value.splitlines())}
        encoding = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [sum(len(encoding.encode_ordinary(p)) for p in _pieces(x)) if x else 0 for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    fields = ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in rest), "n_tokens bigint"])
    return documents.mapInArrow(count, fields)


def fill(budget: float, weights: dict, limits: dict) -> dict:
    """Share ``budget`` by weight; what a member cannot take goes to the others by their weights."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if weights[k] > 0 and limits[k] > 0}
    left = min(budget, sum(limits[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= limits[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= limits[k] - given[k]
            given[k] = float(limits[k])
        open_ -= full
    return given


class Plan(NamedTuple):
    """Tokens for each leaf, and for each node with a share of its own what that share asks beyond all the node can hold."""

    given: dict[tuple, float]
    unplaced: dict[tuple, float]


def budgets(leaves: list[tuple[tuple, float, float]], shares: dict[tuple, float], budget: float) -> Plan:
    """Share ``budget`` down a tree.

    ``leaves`` has (path, tokens, limit). ``shares`` gives the shares of nodes in the whole by
    their path. A node without one weighs what the nodes below it do, or if none of these has
    a share, what its leaves hold. A shortage is first shared among the nodes below the same
    parent, then among those of the parent's level.
    """
    below: dict[tuple, dict] = defaultdict(dict)
    held: dict[tuple, float] = defaultdict(float)
    limit: dict[tuple, float] = defaultdict(float)
    for path, tokens, most in leaves:
        for i in range(len(path) + 1):
            held[path[:i]] += tokens
            limit[path[:i]] += most
            if i:
                below[path[: i - 1]][path[:i]] = True
    weight = dict(shares)
    for node in sorted(held, key=len, reverse=True):
        if node not in weight and any(k in weight for k in below.get(node, ())):
            weight[node] = sum(weight.get(k, 0.0) for k in below[node])
    given: dict[tuple, float] = {}

    def down(node: tuple, amount: float) -> None:
        if node not in below:
            given[node] = amount
            return
        kids = list(below[node])
        for k, v in fill(amount, {k: weight.get(k, held[k]) for k in kids}, {k: limit[k] for k in kids}).items():
            down(k, v)

    down((), min(budget, limit[()]))
    return Plan(given, {k: max(0.0, share * budget - limit[k]) for k, share in shares.items()})


def _name(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


class Mix:
    """Plan and rows of a mix; see ``mix_sources``."""

    def __init__(self, shares: DataFrame, rows: DataFrame) -> None:
        self.shares = shares
        self.rows = rows


def _few(df: DataFrame) -> DataFrame:
    """``df`` sent whole to every executor if it is small enough; it has been computed before."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix_sources(documents: DataFrame, targets: DataFrame, *, tokenizer: str, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", domain: str | None = None, tokens: int | None = None, seed: int = 42) -> Mix:
    """A mix of ``tokens`` tokens, as many as the documents have in all unless given.

    ``targets`` has source, target_share and max_repeats, and may have a column ``domain``,
    whose sources help each other out first; sources compare trimmed and in lower case, and
    of two rows for one source the greater share holds. Documents of null or other sources
    count in the total only.

    ``shares``: source, target_share, max_repeats, docs, available (tokens), short (whether
    the plan could not place the source's whole share of the mix, even with all documents
    used max_repeats times), budget, mix_tokens and actual_share, for each target, also
    those without documents. ``rows``: doc, source, lang, n_copies (how often the document
    is in the mix, at least 1), n_tokens. A leaf's mix never exceeds its budget, so it is
    less by up to one document. Repeated rows are separate documents; empty tables give no
    rows, and shares of 0.
    """
    spark = documents.sparkSession
    counted = token_counts(documents.select(F.col(doc).alias("_doc"), _name(source).alias("_source"), F.coalesce(_name(lang), F.lit("")).alias("_lang"), F.col(text).cast("string").alias("_text")), "_text", tokenizer=tokenizer)
    of = F.coalesce(_name(domain), F.lit("")) if domain else F.lit("")
    goals_df = targets.where("source is not null").groupBy(_name("source").alias("_source")).agg(F.max_by(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most"), of.alias("domain")), F.coalesce("target_share", F.lit(0.0))).alias("t")).select("_source", "t.*")
    sized = durable(counted)
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    goal_rows = bounded_rows(goals_df, TARGETS)
    if goal_rows is None:
        raise ValueError(f"more than {TARGETS} sources")
    mine = sized.join(_few(spark.createDataFrame([(r[0],) for r in goal_rows], "_source string")), "_source")
    stats = durable(mine.groupBy("_source", "_lang").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    by_source = {r[0]: r for r in stats.groupBy("_source").agg(F.sum("tokens").alias("available"), F.sum("docs").alias("docs")).collect()}  # at most one row for each target
    size = total if tokens is None else tokens
    path = {r[0]: (r.domain, r[0]) for r in goal_rows}
    available = {r[0]: by_source[r[0]].available if r[0] in by_source else 0 for r in goal_rows}
    plan = budgets([(path[r[0]], available[r[0]], available[r[0]] * r.most) for r in goal_rows], {path[r[0]]: float(r.share) for r in goal_rows}, size)
    # a source without tokens is short of whatever share it has
    goal = spark.createDataFrame(
        [(r[0], float(r.share), int(r.most), int(by_source[r[0]].docs) if r[0] in by_source else 0, int(available[r[0]]), plan.unplaced[path[r[0]]] > 0, int(plan.given[path[r[0]]] + 1e-6)) for r in goal_rows],
        "_source string, share double, most int, docs long, available long, short boolean, budget long",
    )
    # languages: each its part of the budget, in whole epochs and a prefix of one more
    b = F.when(F.col("available") > 0, F.floor(F.col("budget") * F.col("tokens") / F.col("available") + 1e-6)).otherwise(0)
    leaf = stats.join(_few(goal), "_source").select("_source", "_lang", "tokens", "most", b.cast("long").alias("b"))
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("b") / F.col("tokens")), F.col("most").cast("long"))).otherwise(0)
    leaf = leaf.withColumn("_whole", whole.cast("int"))
    planned = durable(leaf.select("_source", "_lang", "_whole", F.when(F.col("_whole") < F.col("most"), F.col("b") - F.col("_whole") * F.col("tokens")).otherwise(0).alias("_part")))
    rows = mine.join(_few(planned), ["_source", "_lang"]).withColumn("_h", F.xxhash64(F.lit(seed), F.col("_whole"), F.col("_doc")))
    rows = rows.withColumn("_bin", F.shiftrightunsigned("_h", 64 - BINS.bit_length() + 1).cast("int"))
    bins = rows.where("_part > 0").groupBy("_source", "_lang", "_part", "_bin").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("_source", "_lang").orderBy("_bin"))
    ends = bins.withColumn("upto", upto).where("upto > _part").groupBy("_source", "_lang").agg(F.min("_bin").alias("_end"), F.min_by(F.col("upto") - F.col("t"), "_bin").alias("_before"))
    ends = durable(ends)
    placed = rows.join(_few(ends), ["_source", "_lang"], "left")  # at most one row for each leaf
    clear = placed.where("_end is null or _bin <> _end").withColumn("_in", (F.col("_part") > 0) & (F.col("_end").isNull() | (F.col("_bin") < F.col("_end"))))
    order = Window.partitionBy("_source", "_lang").orderBy("_h", "_doc", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("_bin = _end").withColumn("_in", F.col("_before") + F.sum("n_tokens").over(order) <= F.col("_part"))
    chosen = clear.unionByName(edge).withColumn("n_copies", F.col("_whole") + F.col("_in").cast("int")).where("n_copies > 0")
    used = chosen.groupBy("_source").agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("mix_tokens"))
    s = goal.join(used, "_source", "left").fillna(0, ["mix_tokens"])
    s = s.withColumn("_all", F.sum("mix_tokens").over(Window.partitionBy(F.lit(0))))  # one row for each target
    shares = s.select(
        F.col("_source").alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), "docs", "available", "short", "budget",
        "mix_tokens", F.when(F.col("_all") > 0, F.col("mix_tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"),
    )
    return Mix(shares, chosen.select(F.col("_doc").alias(doc), F.col("_source").alias("source"), F.col("_lang").alias("lang"), "n_copies", "n_tokens"))
