"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Clusters are kept as rows (node, member), never as collected sets, so a component may hold any share of the data. In
a round each node sends its cluster to the cluster's minimum, and the minimum to the other members. Nodes with a single
neighbour that is smaller take no part in the rounds; they get its component at the end. Rows of a node with more than
``HOT`` of them meet the node's minimum by a broadcast of the at most rows / ``HOT`` such nodes, all others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfathom.session import cut_lineage

#: A node with more rows than this is not brought into one task.
HOT = 500_000


def _join_split(rows: DataFrame, table: DataFrame, key: str, hot: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key: the rows of keys that have more than ``hot`` of them stay
    where they are and meet a broadcast of the table's rows for these keys, at most rows / hot; the others are shuffled."""
    many = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(key)
    few = F.broadcast(many)
    return rows.join(F.broadcast(table.join(few, key, "left_semi")), key).unionByName(rows.join(few, key, "left_anti").join(table, key))


def components(edges: DataFrame, rounds: int = 60, hot: int = HOT) -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node of ``edges`` (a, b).

    Null ends are left out; an edge from a node to itself makes a component of one node. Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = cut_lineage(e)
    pairs = e.where("lo <> hi")
    ends = pairs.select(F.col("lo").alias("node"), F.lit(None).cast(e.schema["lo"].dataType).alias("only")).unionAll(pairs.select(F.col("hi").alias("node"), F.col("lo").alias("only")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("only").alias("only"))
    # A leaf is larger than its only neighbour, so it is no component's minimum, and its neighbour is no leaf.
    leaves = cut_lineage(degrees.where("n = 1 AND only IS NOT NULL").select(F.col("node").alias("hi"), F.lit(True).alias("leaf")))
    marked = cut_lineage(pairs.join(leaves, "hi", "left"))
    inner = marked.where("leaf IS NULL").select("lo", "hi")
    rows = inner.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionAll(inner.select(F.col("hi").alias("v"), F.col("lo").alias("u")))
    rows = cut_lineage(rows.unionAll(rows.select("v", F.col("v").alias("u")).distinct()))
    before = None
    for _ in range(rounds):
        low = _join_split(rows, rows.groupBy("v").agg(F.least("v", F.min("u")).alias("m")), "v", hot)
        # C to its minimum, the minimum to all of C; a node always keeps itself.
        sent = low.select(F.col("m").alias("v"), "u").unionAll(low.select(F.col("u").alias("v"), F.col("m").alias("u")))
        rows = cut_lineage(sent.distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    known = rows.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    # Nodes outside the rounds: those that have only leaves or only themselves.
    alone = e.select(F.col("lo").alias("node")).unionAll(e.where("lo = hi").select(F.col("hi").alias("node"))).distinct()
    alone = alone.join(known, "node", "left_anti").join(leaves.select(F.col("hi").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    centres = cut_lineage(known.unionByName(alone))
    hung = marked.where("leaf").select(F.col("hi").alias("leaf_node"), F.col("lo").alias("node"))
    return centres.unionByName(_join_split(hung, centres, "node", hot).select(F.col("leaf_node").alias("node"), "component"))


def essay_links(essays: DataFrame) -> DataFrame:
    """Edges (a, b) between essays and the sources, authors and base essays they name; keys carry their kind.

    Prefixes put sources before essays in code-point order, so a component's minimum is its smallest source_id if it
    has one and its smallest essay id if not; authors sort last.
    """
    author = F.lower(F.regexp_replace(F.get_json_object("meta", "$.author"), r"(?U)^\s+|\s+$", ""))
    base = F.get_json_object("meta", "$.base_doc_id")
    e = essays.where("id IS NOT NULL").select(F.concat(F.lit("1"), "id").alias("a"), "source_id", F.nullif(author, F.lit("")).alias("author"), base.alias("base"))
    known = e.select(F.col("a").alias("b")).distinct()
    bases = e.select("a", F.concat(F.lit("1"), "base").alias("b")).where("b IS NOT NULL").join(known, "b", "left_semi").select("a", "b")
    return (
        e.select("a", F.concat(F.lit("0"), "source_id").alias("b")).where("b IS NOT NULL")
        .unionAll(e.select("a", F.concat(F.lit("2"), "author").alias("b")).where("b IS NOT NULL"))
        .unionAll(bases).unionAll(e.select("a", F.col("a").alias("b"))).distinct()
    )


def essay_groups(essays: DataFrame) -> DataFrame:
    """(id, group_id): one row per essay; group_id is the smallest source_id of its group or else the smallest id."""
    c = components(essay_links(essays)).where(F.col("node").startswith("1"))
    return c.select(F.substring("node", 2, 1 << 30).alias("id"), F.substring("component", 2, 1 << 30).alias("group_id"))


def _uniform(*key: Column) -> Column:
    """A uniform number in (0, 1) from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def assign_splits(groups: DataFrame, targets: DataFrame, group: str = "group_id", large: float = 0.005) -> DataFrame:
    """(group, split_name, n): each group of ``groups`` (rows of records) in one split.

    Weighted rendezvous hashing: the split with the largest -share / ln(u) takes the group, u being a hash of group
    and split. A group with at least ``large`` of all records would upset the shares; there are at most 1 / large of
    them, and these are placed first, largest first, each with the split that lacks most records relative to its
    share (ties by hash); the rest then goes by hash with what the splits still lack as weights. Null or negative
    shares count as 0; no targets give no rows.
    """
    sizes = cut_lineage(groups.groupBy(group).agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = {r.split_name: max(0.0, r.share or 0.0) for r in targets.collect()}  # one row per split
    spark = groups.sparkSession
    schema = T.StructType([T.StructField(group, sizes.schema[group].dataType), T.StructField("split_name", T.StringType()), T.StructField("n", T.LongType())])
    whole = sum(share.values())
    if not total or not whole:
        return spark.createDataFrame([], schema)
    lack = {s: total * w / whole for s, w in share.items()}
    placed = []
    for r in sizes.where(F.col("n") >= large * total).orderBy(F.desc("n"), group).collect():  # at most 1 / large rows
        best = max(sorted(lack), key=lambda s: lack[s])
        lack[best] -= r.n
        placed.append((r[group], best, r.n))
    rest = sizes.where(F.col("n") < large * total)
    weights = {s: max(x, 0.0) for s, x in lack.items()}
    if not sum(weights.values()):
        weights = share
    scores = [F.struct((-F.lit(w) / F.log(_uniform(F.col(group), F.lit(s)))).alias("score"), F.lit(s).alias("split")) for s, w in sorted(weights.items()) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rest.select(group, best["split"].alias("split_name"), "n").unionByName(spark.createDataFrame(placed, schema))


def essay_splits(essays: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, group_id, split_name) of each essay."""
    g = cut_lineage(essay_groups(essays))
    return g.join(assign_splits(g, targets).select("group_id", "split_name"), "group_id").select("id", "group_id", "split_name")


def verdict_splits(essays: DataFrame, verdicts: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, split_name) of each sentence verdict of a known essay, and one row with a null
    sentence_index for each essay without verdicts; repeated scorings count once."""
    s = essay_splits(essays, targets).select(F.col("id").alias("doc_id"), "split_name")
    return s.join(verdicts.select("doc_id", "sentence_index").distinct(), "doc_id", "left").select("doc_id", "sentence_index", "split_name")
