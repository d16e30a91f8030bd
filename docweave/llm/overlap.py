"""N-gram Jaccard join: count-vector R-trees inside cells of documents that agree in a group of shingles."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import asked, asked_only, components
from docweave.llm.words import mix, word_hashes
from docweave.session import discard, stored

DIMENSIONS = 64
LEAF = 16
# Bits of the smallest parity sketch; a larger set has one of over a bit a shingle.
PARITY = 1024
RATIO = 1.5
# Of the groups of a set the share that may be weak, beyond two.
SPARE = 16
# Documents of a cell that meet in one task; larger cells are cut into blocks that meet in pairs.
BLOCK = 256
# Candidates per member up to which a block lists its pairs; one with more is searched with its sets.
LISTED = 4


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``width`` words, A-Z lower-cased; fewer words make one shingle."""
    hashes, line, first = word_hashes(texts)
    cuts = np.r_[np.searchsorted(line, first), len(line)]
    count = max(0, len(hashes) - width + 1)
    joined = np.full(count, width, np.uint64)
    for k in range(width):
        joined = mix(joined + hashes[k : k + count])
    return [_distinct(joined[a : b - width + 1] if b - a >= width else _whole(hashes[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text of few words, none for a text without words."""
    joined = np.full(min(1, len(hashes)), len(hashes), np.uint64)
    for k in range(len(hashes)):
        joined = mix(joined + hashes[k])
    return joined


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


class Cells:
    """Which cells a set belongs to, so that any two sets of enough Jaccard similarity share one.

    Sets of similarity t differ in at most k = (1 - t) / (1 + t) of their joint sizes. Shingles are
    dealt into k + 1 + e groups by their hash; two such sets then agree entirely in e + 1 groups
    or more. A group with under two shingles is weak and names no cell; a set with more than e weak
    groups also takes cells of single shingles, the first ones in the order of their hashes, of
    which two similar sets share one. Sizes fall into bands; a pair meets in the larger one's.

    At a bound so low that even the largest set of a band has too many weak groups, cells of single
    shingles are the only ones: they find all pairs alone, and are fewer. They are the same in all
    bands, so ``bands`` says in which ones a set meets others.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = max(RATIO, 100 / percent)
        self.bounds = [1]
        held = (100 + percent) / (2 * max(1, 100 - percent)) * SPARE / (SPARE + 1)
        self.singles = (1 + held) * exp(-held) > 1 / SPARE

    def band(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, ceil(self.bounds[-1] * self.ratio)))
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def _bands(self, n: int) -> list[int]:
        own = self.band(n)
        self.band(self.bounds[own + 1])
        return [own] + [own + 1] * (100 * n >= self.percent * self.bounds[own + 1])

    def bands(self, ids: np.ndarray) -> list[int]:
        """Bands in which a set meets the others of a cell; one for all where cells are named by their band."""
        return self._bands(len(ids)) if self.singles and len(ids) else [0]

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        if n == 0:
            return np.zeros(0, np.int64)
        if self.singles:
            # Without a larger set that may be similar there is no smaller one either.
            return self._singles(ids).view(np.int64) if 100 * n >= self.percent * (n + 1) else np.zeros(0, np.int64)
        return np.unique(np.concatenate([self._in_band(ids, c) for c in self._bands(n)]).view(np.int64))

    def _singles(self, ids: np.ndarray) -> np.ndarray:
        """The first shingles in the order of their hashes, of which two similar sets share one."""
        return np.sort(mix(ids + np.uint64(12345)))[: len(ids) - -(-self.percent * len(ids) // 100) + 1]

    def _in_band(self, ids: np.ndarray, band: int) -> np.ndarray:
        most = self.bounds[band + 1] - 1
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        if k == 0:  # only equal sets are similar here, and those are one class already
            return np.zeros(0, np.uint64)
        spare = 2 + k // SPARE
        groups = k + 1 + spare
        which = (mix(ids ^ np.uint64(0xA5A5A5A5)) % np.uint64(groups)).astype(np.int64)
        counts = np.bincount(which, minlength=groups)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, which, mix(ids))
        tag = np.array([band * 2 + 1], np.uint64)
        full = np.flatnonzero(counts >= 2)
        cells = mix(mix(content[full]) + mix(full.astype(np.uint64) * np.uint64(1 << 20) + tag))
        if groups - len(full) > spare:
            cells = np.concatenate([cells, mix(self._singles(ids) + mix(tag + np.uint64(1)))])
        return cells


def counts_of(ids: np.ndarray) -> np.ndarray:
    """Point of a set: the number of its shingles in each of the groups."""
    return np.bincount((ids >> np.uint64(7)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS).astype(np.int32)


def parity_of(ids: np.ndarray) -> np.ndarray:
    """Parity sketch: every shingle turns one bit over, so sets that differ in d shingles differ in at most d bits.

    It has a power of two of bits, more than shingles, as a full one tells unlike sets from like ones no more.
    """
    bits = max(PARITY, 1 << len(ids).bit_length())
    spots = (mix(ids) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=bits) & 1).view(np.uint64)


def folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Parity sketches as ones of ``words`` words, which are no longer than any of them."""
    out = []
    for sketch in sketches:
        while len(sketch) > words:
            sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
        out.append(sketch)
    return np.array(out)


def apart_of(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """In how many bits the sketches of each pair differ, the longer one folded."""
    words = np.array([min(len(a), len(b)) for a, b in zip(one, other)], np.int64)
    apart = np.zeros(len(words), np.int64)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        a, b = (folded([sketches[k] for k in at], w) for sketches in (one, other))
        apart[at] = np.bitwise_count(a ^ b).astype(np.int64).sum(1)
    return apart


class Similar:
    """Exact test of two sets with the count bound before it."""

    def __init__(self, percent: int):
        self.percent = percent

    def may(self, overlap, sizes):
        """Whether an overlap, or a bound of it, is enough for the joint size of two sets."""
        return (100 + self.percent) * overlap >= self.percent * sizes

    def near(self, apart, sizes):
        """Whether sets whose sketches are so many bits apart may be similar."""
        return (100 + self.percent) * (sizes - apart) >= 2 * self.percent * sizes

    def __call__(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        if not len(small):
            return False
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return bool(self.may(int((large[at] == small).sum()), len(a) + len(b)))


class RTree:
    """Bulk-loaded tree over count vectors: every node knows the largest count per group and the smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = self._tiled(np.arange(len(points)))
        self.levels = []
        high, low = points[self.order], sizes[self.order]
        while len(high) > 1:
            cuts = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))

    def _tiled(self, rows: np.ndarray) -> np.ndarray:
        """Sort-tile order: cut along the widest coordinate into runs of whole leaves, and on within them."""
        if len(rows) <= LEAF:
            return rows
        part = self.points[rows]
        widest = int((part.max(0) - part.min(0)).argmax())
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self._tiled(rows[:half]), self._tiled(rows[half:])])

    def search(self, point: np.ndarray, size: int, similar: Similar) -> np.ndarray:
        """Rows whose overlap with a set may suffice: the sum of the smaller counts bounds it from above."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(0, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[k]
            good = similar.may(np.minimum(high[nodes], point).sum(1), low[nodes] + size)
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            nodes = (nodes[good][:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        rows = self.order[nodes] if self.levels else self.order
        return rows[similar.may(np.minimum(self.points[rows], point).sum(1), self.sizes[rows] + size)]


def spanning_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similar: Similar) -> list[tuple[int, int]]:
    """Links that join the same documents as all links between sets of different label would.

    A tree finds the candidates of each set; those already joined are skipped, the others verified.
    ``side``: with two blocks in the group only pairs across them are looked at.
    """
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    points = np.array([counts_of(s) for s in sets])
    across = side.min() != side.max()
    inside = np.flatnonzero(side == side.min())
    tree = RTree(points[inside], sizes[inside])
    links = []
    for q in np.flatnonzero(side == side.max()).tolist():
        for p in inside[tree.search(points[q], sizes[q], similar)].tolist():
            if (across or p < q) and root(int(label[p])) != root(int(label[q])) and similar(sets[p], sets[q]):
                parent[root(int(label[p]))] = root(int(label[q]))
                links.append((p, q))
    return links


def listed_pairs(points: np.ndarray, parity: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray,
                 similar: Similar, most: int = LISTED) -> list[tuple[int, int]] | None:
    """Pairs of different label whose count bound and sketches suffice, or None if there are over ``most`` per member.

    ``side``: with two blocks in the group only pairs across them are looked at.
    """
    across = side.min() != side.max()
    inside = np.flatnonzero(side == side.min())
    tree = RTree(points[inside], sizes[inside])
    pairs = []
    for q in np.flatnonzero(side == side.max()).tolist():
        found = inside[tree.search(points[q], sizes[q], similar)]
        found = found[(label[found] != label[q]) & (across | (found < q))]
        apart = np.bitwise_count(parity[found] ^ parity[q]).astype(np.int64).sum(1)
        found = found[similar.near(apart, sizes[found] + sizes[q])]
        pairs += [(q, p) for p in found.tolist()]
        if len(pairs) > most * len(label):
            return None
    return pairs


def _numbers(values: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in values.to_pylist()]


def jaccard_groups(docs: DataFrame, percent: int = 90, width: int = 3, block: int = BLOCK, listed: int = LISTED,
                   row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, for links of Jaccard ``percent`` or more.

    A document's set is its distinct shingles of ``width`` words; with fewer words the whole
    sequence is one, and an empty or null text has none and links with nothing. ``component_id`` is
    the smallest doc_id reachable by links. Rows that repeat a doc_id are documents of their own.
    ``row`` names a column of distinct longs that tells rows apart where doc_ids repeat or are null;
    it is returned too, with a ``component`` that is null only for documents without a set.

    Equal sets are one class, known by the number of its first row. Classes are dealt into cells (see
    ``Cells``); only cells of two or more are looked at, cells of the same members once. Each member is
    first held against the smallest member of its cell: count bound and parity sketch, then the sets. Cells
    whose members are still in several components are searched by R-trees of count vectors, in blocks, for
    links between components. A block lists its candidates if they are few per member, and a pair listed by many
    cells is verified once, if parity sketches of the two allow it; a block with more candidates is searched again with the sets at hand.
    Every step returns links along which components grow, never all pairs. Vectors and sketches are made
    with the cells; sets are made again from their texts, only for pairs that pass both. Tables of the steps are deleted when the result is written.
    """
    similar = Similar(percent)

    def short(counts: np.ndarray) -> bytes:
        return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int32).tobytes()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cells = Cells(percent)
        for batch in batches:
            found = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([cells.of(s) for s in found], pa.list_(pa.int64())), pa.array([cells.bands(s) for s in found], pa.list_(pa.int32())),
                 pa.array([short(counts_of(s)) for s in found], pa.binary()), pa.array([parity_of(s).tobytes() for s in found], pa.binary())],
                names=["doc_id", "row", "n_shingles", "key", "cells", "bands", "point", "parity"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row or "doc_id").cast("long").alias("row"))
    rows = texts.mapInArrow(summary, "doc_id long, row long, n_shingles long, key binary, cells array<long>, bands array<int>, point binary, parity binary")
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()))
    classes = stored(rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("least"), F.min("node").alias("node"), F.count("*").alias("copies")))
    # One row per class. Rows without copies are known by a bitmap and are not shuffled.
    marked = asked(rows, classes.where("copies > 1").select("key"), ["key"])
    copied = marked.where("_asked").join(classes.select("node"), "node", "left_semi")
    alone = marked.where("not _asked and key is not null").select(*copied.columns)
    single = alone.union(copied).select("node", "cells", "bands")

    spread = single.select("node", "bands", F.explode("cells").alias("cell"))
    # A node names a cell once, so a cell's rows are its members; a count takes the fewest bytes on the way.
    several = stored(spread.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1").select("cell"))
    # Few are left; only now each goes to all of its bands.
    met = asked_only(spread, several, ["cell"]).join(several, "cell")
    met = stored(met.select("node", "cell", F.explode("bands").alias("band")).select("node", F.xxhash64("cell", "band").alias("cell")))
    shared = met.groupBy("cell").agg(
        F.count("*").alias("members"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("mark")
    ).where("members > 1")
    # Cells of the same members are one: their number, smallest and checksum agree.
    shared = stored(shared.groupBy("members", "leader", "mark").agg(F.min("cell").alias("cell")))
    members = stored(met.join(shared.select("cell", "leader", "members"), "cell"))
    nodes = stored(members.select("node").distinct())
    points = rows.select("node", F.col("n_shingles").cast("int").alias("size"), "point", "parity")
    points = stored(asked_only(points, nodes, ["node"]).join(nodes, "node", "left_semi"))
    used = [rows, classes, several, met, shared, members, nodes, points]

    def kept(df: DataFrame) -> DataFrame:
        used.append(stored(df))
        return used[-1]

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            keys = [xxhash.xxh3_128_digest(s) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "ids"])

    def sets_of(few: DataFrame) -> DataFrame:
        """The sets of some nodes, made again from their texts. Texts of others stay where they are."""
        named = rows.select("node", "row", "key")
        named = kept(asked_only(named, few, ["node"]).join(few, "node", "left_semi"))
        chosen = asked_only(texts, named.select("row"), ["row"]).join(named.select("row").distinct(), "row", "left_semi")
        return kept(chosen.select("doc_id", "text").mapInArrow(full, "key binary, ids binary").join(
            named.select("node", "key"), "key").select("node", "ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b) for a, b in zip(_numbers(batch.column(2)), _numbers(batch.column(3)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def points_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        short = 2 * DIMENSIONS
        return np.array([np.frombuffer(x, np.uint16 if len(x) == short else np.int32).astype(np.int32) for x in column.to_pylist()])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = dict(zip(batch.schema.names, batch.columns))
                sizes = c["size_a"].to_numpy().astype(np.int64) + c["size_b"].to_numpy()
                good = similar.may(np.minimum(points_of(c["point_a"]), points_of(c["point_b"])).sum(1), sizes)
                good &= similar.near(apart_of(_numbers(c["parity_a"]), _numbers(c["parity_b"])), sizes)
                yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(good))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""
        pairs = kept(pairs)
        sets = sets_of(kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("ids").alias("x")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("ids").alias("y")), "b").select("a", "b", "x", "y")
        return kept(both.mapInArrow(check, "a long, b long"))

    firsts = kept(members.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    ends = [points.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in points.columns]) for x in "ab"]
    direct = linked(firsts.join(ends[0], "a").join(ends[1], "b").mapInArrow(bounded, "a long, b long"))
    label = kept(components(nodes, direct))

    labelled = members.select("cell", "node").join(label, "node")
    mixed = labelled.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    parts = F.ceil(F.col("size") / block).cast("int")
    open_cells = labelled.join(mixed.select("cell", "size"), "cell").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    meets = kept(open_cells.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "node", "component", "cell", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))

    def candidates(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        at = np.argsort(node, kind="stable")
        sketches = _numbers(group["parity"])
        points, parity = points_of(group["point"])[at], folded(sketches, min(map(len, sketches)))[at]
        sizes, label, side = (group[c].to_numpy()[at] for c in ("size", "component", "part"))
        pairs = listed_pairs(points, parity, sizes.astype(np.int64), label, side, similar, listed)
        dense, node = pairs is None, node[at]
        ends = [sorted((int(node[q]), int(node[p])), reverse=True) for q, p in pairs or []] or [[None, None]] * dense
        n = len(ends)
        return pa.table({"a": pa.array([x[0] for x in ends], pa.int64()), "b": pa.array([x[1] for x in ends], pa.int64()),
                         **{c: pa.array(group[c][:1].to_pylist() * n, t) for c, t in (("cell", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))}})

    def search(group: pa.Table) -> pa.Table:
        node, label = group["node"].to_numpy(), group["component"].to_numpy()
        at = np.argsort(node, kind="stable")
        found = _numbers(group["ids"])
        links = spanning_links([found[k] for k in at], label[at], group["part"].to_numpy()[at], similar)
        a, b = ([int(node[at[link[k]]]) for link in links] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = ["cell", "i", "j"]
    found = kept(meets.join(points, "node").groupBy(*blocks).applyInArrow(candidates, "a long, b long, cell long, i int, j int"))
    more = linked(found.where("a is not null").select("a", "b").distinct().join(firsts, ["a", "b"], "left_anti"))
    dense = found.where("a is null").select(*blocks)
    if not dense.isEmpty():
        crowded = kept(meets.join(dense, blocks, "left_semi"))
        again = crowded.join(sets_of(kept(crowded.select("node").distinct())), "node")
        more = more.union(kept(again.groupBy(*blocks).applyInArrow(search, "a long, b long")))
    final = components(nodes, direct.union(more))
    known = classes.select("key", "node", "least").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = kept(known.select("key", "least", "component"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("key", "component_id", "component")
    more = [F.col("row").alias(row), "component"] if row else []
    out = stored(rows.select("doc_id", "row", "n_shingles", "key").join(known, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more))
    discard(*used)
    return out
