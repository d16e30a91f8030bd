"""Prefix trie of conversations: a z-fast trie held as a table, built in batches and expanded to one row per prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import partitions
from docweave.session import stored

# A prefix is known by its depth and two 64-bit sums; ``words`` counts those of its turns.
PREFIX = "struct<a: bigint, b: bigint, words: bigint>"
NODES = f"low long, high long, above {PREFIX}, edge array<{PREFIX}>"
WORD = r"[^\x20\x09-\x0D]+"


def rebuilt(conversations: DataFrame, family: int = 20) -> DataFrame:
    """Turns (conv_id, depth, role, text) of conversations that share the opening of the first of their family.

    Conversation c takes the first h turns of c - c % ``family`` (all if fewer, none if absent) and then its
    own after its first h, where h is crc32 of c in decimal, modulo 4. Turns are ordered by turn
    (null first), then role and text; null roles and texts are empty. A conversation that has no turn
    left has one row with a null depth. Rows without a conv_id are left out.
    """
    plain = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turns = plain.withColumn("place", place.cast("long"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    first = F.col("conv_id") % family
    # The opening of a family's first conversation: three turns at most, so one row.
    opening = turns.where((first == 0) & (F.col("place") <= 3)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("opening"))
    opening = opening.select(F.col("conv_id").alias("head"), "opening")
    ids = turns.where("place = 1").select("conv_id", shared.alias("h"), (F.col("conv_id") - first).alias("head"))
    taken = F.coalesce(F.filter("opening", lambda t: t["place"] <= F.col("h")), F.array().cast("array<struct<place: bigint, role: string, text: string>>"))
    begun = ids.join(opening, "head", "left").select("conv_id", "h", taken.alias("taken"))
    borrowed = begun.select("conv_id", F.inline_outer("taken")).select("conv_id", F.col("place").alias("depth"), "role", "text")
    own = turns.join(begun.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").where("place > h")
    return borrowed.unionByName(own.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("depth"), "role", "text"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): for every depth of a conversation the prefix that ends there.

    A prefix is the exclusive or of the hashes of its turns and their depths. A conversation is one row;
    its texts are not in it.
    """
    so_far = W.partitionBy("conv_id").orderBy("depth")
    found = F.col("depth").isNotNull()

    def mixed(seed: int) -> Column:
        return F.bit_xor(F.when(found, F.xxhash64(F.lit(seed), "depth", "role", "text"))).over(so_far)

    words = F.coalesce(F.sum(F.when(found, F.regexp_count("text", F.lit(WORD)))).over(so_far), F.lit(0)).cast("long")
    steps = turns.select("conv_id", "depth", mixed(1).alias("a"), mixed(2).alias("b"), words.alias("words"))
    step = F.when(found, F.struct("depth", "a", "b", "words"))
    path = F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["words"].alias("words")))
    return steps.groupBy("conv_id").agg(path.alias("path"))


def _top() -> Column:
    """The empty prefix."""
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in ("a", "b", "words")])


def _at(path: Column, depth: Column) -> Column:
    """The prefix of a path at a depth from 0."""
    return F.when(depth == 0, _top()).otherwise(F.get(path, depth - 1))


def _key(depth: Column, prefix: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), prefix["a"].alias("a"), prefix["b"].alias("b"))


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] divisible by the highest power of two."""
    bits = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {bits}), {bits})")


def _common(path: Column, node: Column) -> Column:
    """Depth to which a path follows the edge of a node."""
    along = F.slice(path, node["low"].cast("int") + 1, F.size(node["edge"]))
    same = F.zip_with(along, node["edge"], lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]))
    return node["low"] + F.size(F.filter(same, lambda s: s))


def _lookup(rows: DataFrame, depth: Column, index: DataFrame) -> DataFrame:
    """Join rows to the node whose key is their prefix at ``depth``; rows with a null depth meet none, and are spread."""
    prefix = _at(F.col("path"), depth)
    own = F.xxhash64("n", "last.a")
    asked = rows.withColumns({
        "d": F.coalesce(depth, F.lit(-1)).cast("long"), "a": F.when(depth.isNull(), own).otherwise(prefix["a"]),
        "b": F.when(depth.isNull(), own).otherwise(prefix["b"])})
    return asked.join(index, ["d", "a", "b"], "left").drop("a", "b")


def _index(nodes: DataFrame, depth: Column) -> DataFrame:
    prefix = F.get("edge", (depth - F.col("low") - 1).cast("int"))
    return nodes.select(depth.cast("long").alias("d"), prefix["a"].alias("a"), prefix["b"].alias("b"), F.struct("low", "high", "edge").alias("hit"))


def locate(pending: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Add to sequences (n, last, path) their exit node ``node`` (null: the root) and ``shared``, the depth they share with the trie.

    Fat binary search: of the depths still possible the one divisible by the highest power of
    two is looked up among the nodes' handles; a hit moves the search below that node, a miss above the
    depth. The number of look-ups is the logarithm of the longest path. Last, the child of the node found is looked up
    by its first turn, as a path may leave the trie on the child's edge before its handle.
    """
    handles = _index(nodes, fattest("low", "high"))
    rows = pending.withColumns({"low": F.lit(0).cast("long"), "high": F.col("n"), "node": F.lit(None).cast(handles.schema["hit"].dataType)})
    for _ in range(longest.bit_length() + 1):
        rows = _lookup(rows, F.when(F.col("low") < F.col("high"), fattest("low", "high")), handles)
        hit = F.col("hit").isNotNull()
        rows = rows.withColumns({
            "low": F.when(hit, F.col("hit.high")).otherwise(F.col("low")), "high": F.when(hit | (F.col("d") < 0), F.col("high")).otherwise(F.col("d") - 1),
            "node": F.coalesce("hit", "node")}).drop("d", "hit")
    rows = rows.drop("low", "high").withColumn("shared", F.coalesce(_common(F.col("path"), F.col("node")), F.lit(0)))
    passed = F.coalesce(F.col("shared") == F.col("node.high"), F.lit(True)) & (F.col("n") > F.col("shared"))
    rows = _lookup(rows, F.when(passed, F.col("shared") + 1), _index(nodes, F.col("low") + 1))
    return rows.withColumns({
        "node": F.coalesce("hit", "node"), "shared": F.coalesce(_common(F.col("path"), F.col("hit")), F.col("shared"))}).drop("d", "hit")


def insert(located: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie after a batch, and the sequences inserted by it.

    Edges are cut where a sequence leaves them or ends on them. Of sequences that leave the trie at one point with the
    same turn the longest is inserted; the others share more with the trie in the next batch.
    """
    cuts = located.where("node IS NOT NULL AND shared < node.high").groupBy(
        _key(F.col("node.high"), F.element_at("node.edge", -1)).alias("key")).agg(F.array_sort(F.collect_set("shared")).alias("cuts"))
    keyed = nodes.withColumn("key", _key(F.col("high"), F.element_at("edge", -1))).join(cuts, "key", "left")
    bounds = F.concat(F.array("low"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array("high"))

    def part(i: Column) -> Column:
        low, high = F.get("bounds", i), F.get("bounds", i + 1)
        before = (low - F.col("low")).cast("int")
        above = F.when(before == 0, F.col("above")).otherwise(F.get("edge", before - 1))
        return F.struct(low.alias("low"), high.alias("high"), above.alias("above"), F.slice("edge", before + 1, (high - low).cast("int")).alias("edge"))

    divided = keyed.withColumn("bounds", bounds).select(F.inline(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), part)))
    leaving = located.where("shared < n").withColumn("way", _key(F.col("shared") + 1, F.get("path", F.col("shared").cast("int"))))
    chosen = stored(leaving.groupBy("way").agg(F.max(F.struct("n", "last", "path", "shared")).alias("s")).select("s.*"))
    low = F.col("shared").cast("int")
    leaves = chosen.select(
        F.col("shared").alias("low"), F.col("n").alias("high"), _at(F.col("path"), low).alias("above"),
        F.slice("path", low + 1, (F.col("n") - F.col("shared")).cast("int")).alias("edge"))
    return stored(divided.union(leaves)), chosen.select("n", "last")


def compacted(sequences: DataFrame) -> DataFrame:
    """Compacted trie of distinct sequences (n, last, path): nodes (low, high, above, edge), the root left out.

    A node ends at depth ``high``, where its members part or one of them ends; its edge holds the prefixes
    from depth ``low`` + 1 on, ``above`` that at ``low``. Each batch inserts a sequence for every way out of the trie, so
    the number of batches is at most the greatest depth that sequences share, and one; usually a few.
    """
    spark = sequences.sparkSession
    nodes = spark.createDataFrame([], NODES)
    pending = sequences.where("n > 0")
    longest = pending.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    left, first = longest > 0, True
    while left:
        if first:
            located = pending.withColumns({"node": F.lit(None).cast(f"struct<low: bigint, high: bigint, edge: array<{PREFIX}>>"), "shared": F.lit(0).cast("long")})
        else:
            located = stored(locate(pending, nodes, longest))
        nodes, done = insert(located, nodes)
        rest = located.where("shared < n").join(done, ["n", "last"], "left_anti").select("n", "last", "path")
        pending, first = stored(rest), False
        left = not pending.isEmpty()
    return nodes


def subtree_totals(tree: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Replace columns of ``tree(node, parent, …)`` by their totals over each node and all below it.

    Every node adds its total to the ancestor it points to and then points twice as far, so the number of
    rounds is the logarithm of the depth. Sums are combined before the shuffle, so a node of very many
    children is no hot key.
    """
    rows = stored(tree.withColumn("jump", F.col("parent")))
    names = list(totals)
    while not rows.where("jump IS NOT NULL").isEmpty():
        added = rows.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(*[f(n).alias(f"_{n}") for n, f in totals.items()])
        further = rows.where("jump IS NOT NULL").select(F.col("node").alias("jump"), F.col("jump").alias("_jump"))
        pairs = {n: totals[n] for n in names}
        merged = rows.join(added, "node", "left").withColumns({n: _both(pairs[n], n) for n in names}).drop(*[f"_{n}" for n in names])
        near = merged.where("jump.depth > 0").join(further, "jump", "left").withColumn("jump", F.col("_jump")).drop("_jump")
        far = merged.where("jump IS NULL OR jump.depth = 0").withColumn("jump", F.lit(None).cast(merged.schema["jump"].dataType))
        rows = stored(near.unionByName(far))
    return rows.drop("jump")


def _both(total, name: str) -> Column:
    if total is F.min:
        return F.least(name, f"_{name}")
    return F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0))


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``ends(node, conv_id)``: digest of the node's ids, ascending and joined by commas.

    Ids are sorted and written out in range partitions, which divide a node of very many ids; its
    digest then reads the written parts in order, so no task holds more than a batch of them.
    """
    keys = ["node", "conv_id"]
    laid = ends.select(*keys).repartitionByRange(partitions(ends.sparkSession), *keys).sortWithinPartitions(*keys)
    flat = laid.select("node.depth", "node.a", "node.b", "conv_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            change = np.zeros(batch.num_rows, bool)
            change[:1] = True
            for c in columns[:3]:
                change[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(change)
            ids = list(map(str, columns[3].tolist()))
            text = [",".join(ids[i:j]) for i, j in zip(at, [*at[1:], batch.num_rows])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), pa.array(text, pa.string())], names=["depth", "a", "b", "first", "text"])

    parts = flat.mapInArrow(write, "depth long, a long, b long, first long, text string")
    node = ["depth", "a", "b"]
    parts = parts.repartition(*node).sortWithinPartitions(*node, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def made(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*node, "ends_sha256"])

        for batch in batches:
            rows = []
            for *key, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    if current:
                        rows.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield made(rows)
        if current:
            yield made([(*current, state.hexdigest())])

    done = parts.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")
    return done.select(F.struct(*node).alias("node"), "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns(conv_id, depth, role, text)``, the empty one included.

    A conversation's turns are numbered 1, 2, … by ``depth``; one without turns has a row with a null depth.
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A prefix's members are the conversations that begin with it. ``saved_tokens`` adds, over the
    prefix and all that extend it, the words of their last turn times the members beyond the first.
    Other columns are left out; without a conversation there is no row.

    Equal conversations become one sequence first; the trie is built on those, and all that
    holds for an edge as a whole is computed on the compacted nodes.
    """
    own = stored(paths(turns).withColumn("n", F.size("path").cast("long")).withColumn("last", _at(F.col("path"), F.size("path"))))
    sequences = stored(own.groupBy("n", "last").agg(F.count("*").alias("convs"), F.min("conv_id").alias("least"), F.first("path").alias("path")))
    nodes = compacted(sequences.select("n", "last", "path"))
    keyed = nodes.select(_key(F.col("high"), F.element_at("edge", -1)).alias("node"), _key(F.col("low"), F.col("above")).alias("parent"), "low", "above", "edge")
    spark = turns.sparkSession
    root = spark.range(1).select(
        _key(F.lit(0), _top()).alias("node"), F.lit(None).cast(keyed.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("low"),
        _top().alias("above"), F.array().cast(f"array<{PREFIX}>").alias("edge"))
    ends = sequences.select(_key(F.col("n"), F.col("last")).alias("node"), "convs", "least")
    below = keyed.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    tree = keyed.unionByName(root).join(ends, "node", "left").join(below, "node", "left").withColumns({
        "convs": F.coalesce("convs", zero), "n_children": F.coalesce("n_children", zero)})
    tree = tree.withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    tree = subtree_totals(tree, {"convs": F.sum, "least": F.min, "leaves": F.sum})
    words = F.coalesce(F.try_element_at("edge", F.lit(-1))["words"], zero) - F.col("above.words")
    tree = subtree_totals(tree.withColumn("saved", (F.col("convs") - 1) * words), {"saved": F.sum}).where("convs > 0")
    parents = tree.select(F.col("node").alias("parent"), F.col("least").alias("parent_least"))
    digests = end_digests(own.select(_key(F.col("n"), F.col("last")).alias("node"), "conv_id"))
    tree = tree.join(parents, "parent", "left").join(digests, "node", "left")

    def step(prefix: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("above.words")).otherwise(F.get("edge", i - 1)["words"])
        return F.struct((F.col("low") + 1 + i).alias("depth"), (before - F.col("above.words")).alias("before"))

    steps = F.when(F.size("edge") == 0, F.array(F.struct(zero.alias("depth"), zero.alias("before")))).otherwise(F.transform("edge", step))
    last = F.col("depth") == F.col("node.depth")
    return tree.select("*", F.inline(steps)).select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") == F.col("low") + 1, F.col("parent_least")).when(F.col("depth") > 0, F.col("least")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends_sha256")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
