"""Line dedup: exact set-similarity join of lines by rarity-ordered prefixes; later matches are removed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.llm.common import asked, asked_only
from docweave.llm.words import mix, word_hashes
from docweave.session import discard, stored

# Word frequencies are kept by hash in a table of fixed size: any order of words gives right results.
BUCKET_BITS = 18
# Bits of a frequency in the order of words; above, words go by hash.
OFTEN_BITS = 24
# Lines of one token that meet in one task; more are cut into blocks that meet in pairs.
BLOCK = 2000
# Words of a parity sketch, and the tokens up to which a line keeps all of it folded into the first, or the first two.
SKETCH = 4
FOLDED, HALVED = 64, 128
BUFFER = 200_000
# Rows of numbers that go to Python at a time; texts go in the session's smaller batches.
NARROW = 8192
LAST = 2**63 - 1


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Rows without texts go to Python in larger batches here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(NARROW))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _line_words(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines with at least ``least`` words, end to end; text, place in it and word count of each line."""
    hashes, line, first = word_hashes(texts)
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    sizes = np.diff(np.r_[starts, len(line)])
    found = line[starts]
    if least > 1:
        hashes = hashes[np.repeat(sizes >= least, sizes)]
        found, sizes = found[sizes >= least], sizes[sizes >= least]
    text = np.searchsorted(first, found, side="right") - 1
    return hashes, text, found - first[text], sizes


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_frequencies(texts: DataFrame, least: int) -> np.ndarray:
    """Occurrences of words in all lines that count, summed by hash bucket: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(_line_words(batch.column(0).to_pylist(), least)[0]), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    table = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        table[bucket] = n
    return table


def ordered_sets(hashes: np.ndarray, sizes: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each line from rare to frequent, end to end; their frequencies; tokens per line."""
    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    often = frequency[_bucket(hashes)]
    grade = np.minimum(often, (1 << OFTEN_BITS) - 1).astype(np.uint64)
    # Line, frequency and as much of the hash as has room in one number.
    room = np.uint64(64 - OFTEN_BITS - max(1, len(sizes).bit_length()))
    key = (((line << np.uint64(OFTEN_BITS)) | grade) << room) | (hashes >> (np.uint64(64) - room))
    order = np.argsort(key)
    key, tied = key[order], hashes[order]
    if ((key[1:] == key[:-1]) & (tied[1:] != tied[:-1])).any():
        order = np.lexsort((hashes, grade, line))
    hashes, line, often = hashes[order], line[order], often[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    return hashes[new], often[new], np.bincount(line[new].astype(np.int64), minlength=len(sizes))


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketch of each line: every token turns one of 256 bits over. Rows of ``SKETCH`` words."""
    starts = np.cumsum(sizes) - sizes
    spots = (mix(tokens) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    out = np.zeros((len(sizes), SKETCH), np.uint64)
    if len(starts):
        bits = np.left_shift(np.uint64(1), (spots & 63).astype(np.uint64))
        for k in range(SKETCH):
            out[:, k] = np.bitwise_xor.reduceat(np.where(spots >> 6 == k, bits, np.uint64(0)), starts)
    half = sizes <= HALVED
    out[half, :2], out[half, 2:] = out[half, :2] ^ out[half, 2:], 0
    short = sizes <= FOLDED
    out[short, 0], out[short, 1] = out[short, 0] ^ out[short, 1], 0
    return out


def bits_apart(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, both folded as the smaller set's is. Never more than tokens that differ."""
    turned = a ^ b
    half = turned[:, :2] ^ turned[:, 2:]
    folded = np.bitwise_count(half[:, 0] ^ half[:, 1]).astype(np.int64)
    halved, whole = (np.bitwise_count(x).astype(np.int64).sum(1) for x in (half, turned))
    return np.where(size <= FOLDED, folded, np.where(size <= HALVED, halved, whole))


def near_earlier(token: np.ndarray, side: np.ndarray, size: np.ndarray, place: np.ndarray, sketch: np.ndarray,
                 percent: int, all_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, earlier row) of the same token that may be similar; rows come by token, then in order of lines.

    Filters: length; position (what can still follow the shared token, and stand before it);
    parity sketch (sets that differ in d tokens differ in at most d bits). A row is done with its
    first candidate, unless ``all_of`` marks it: then it gets all of them.
    """
    start = np.maximum.accumulate(np.where(np.r_[True, token[1:] != token[:-1]], np.arange(len(token)), 0))
    rows, found, d = np.flatnonzero(np.arange(len(token)) > start), [], 1
    if all_of is not None:
        rows = rows[all_of[rows]]
    while len(rows):
        other = rows - d
        a, b = size[rows], size[other]
        need = -(-percent * (a + b) // (100 + percent))
        most = np.minimum(a - place[rows], b - place[other]) + np.minimum(place[rows], place[other])
        good = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (most >= need)
        good &= (side[rows] != side[other]) | (side[rows] < 0)
        left = np.flatnonzero(good)
        apart = bits_apart(sketch[rows[left]], sketch[other[left]], np.minimum(a[left], b[left]))
        good[left] = (a + b - 2 * need)[left] >= apart
        found.append((rows[good], other[good]))
        d += 1
        rows = (rows if all_of is not None else rows[~good])
        rows = rows[rows - d >= start[rows]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def alike_lines(left: list[str], right: list[str], percent: int) -> np.ndarray:
    """Whether the word sets of two lines have a Jaccard similarity of ``percent`` hundredths, for rows of pairs."""

    def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes, line, _ = word_hashes(texts)
        order = np.lexsort((hashes, line))
        hashes, line = hashes[order], line[order]
        new = np.ones(len(line), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        return hashes[new], line[new]

    (a, at_a), (b, at_b) = sets(left), sets(right)
    hashes, line = np.concatenate([a, b]), np.concatenate([at_a, at_b])
    order = np.lexsort((hashes, line))
    hashes, line = hashes[order], line[order]
    twice = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    both = np.bincount(line[1:][twice], minlength=len(left))
    return (100 + percent) * both >= percent * np.bincount(line, minlength=len(left))


def dedup_lines(docs: DataFrame, percent: int = 80, least: int = 1, block: int = BLOCK) -> DataFrame:
    """Columns of ``docs`` with similar later lines taken out of ``text``, plus n_lines and n_removed.

    A line is the set of its words, A-Z lower-cased. It is removed if any earlier line of any
    document, by doc_id and then place in the text, is alike: Jaccard similarity of at least
    ``percent`` hundredths. Every line with a word counts, however short; a line of white space alone
    is neither removed nor compared. Words are runs between ASCII white space, so a line of a script
    without spaces is one word and goes as a copy only. ``least`` above one leaves lines of fewer
    words alone. A null text stays null. Rows that repeat a doc_id are documents of their own where their texts
    differ, in order of a hash of the text; those of equal text are one document. Rows without a doc_id come
    after all others and are told apart in the same way.

    Equal sets are one class, met at its first line; sets too small to be like any other (under four
    words at 80) go no further. Of each other class the rarest tokens (as many as
    two similar sets must share one of) are spread, and rows of one token are compared with those
    before them until a candidate is found, in blocks where a token has very many. Candidates are
    verified on the sets; lines whose candidates fail get all theirs in a second round.
    """
    spark = docs.sparkSession
    # A document is told by doc_id (without one, the last) and own. Where a doc_id has several texts own is a hash of the
    # text, odd without a doc_id; else it only tells rows without a doc_id.
    number, text_hash = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(LAST - 1))
    several = docs.select(number.alias("doc_id"), text_hash.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b")
    unnamed = number.isNull().cast("long")
    identity = {"doc_id": F.coalesce(number, F.lit(LAST)), "own": unnamed if several.isEmpty() else text_hash + unnamed}
    texts = docs.select(identity["doc_id"].alias("doc_id"), "text", identity["own"].alias("own"))
    shared = spark.sparkContext.broadcast(word_frequencies(texts, least))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes, text, place, sizes = _line_words(batch.column(1).to_pylist(), least)
            tokens, often, sizes = ordered_sets(hashes, sizes, shared.value)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            # A set that even one more token takes below the bound is like equal sets only, which are its class.
            prefix = np.where((100 - percent) * sizes < percent, 0, sizes - -(-percent * sizes // 100) + 1)
            sketch = sketches(tokens, sizes)
            at = np.repeat(starts - (np.cumsum(prefix) - prefix), prefix) + np.arange(prefix.sum())
            offsets = pa.array(np.r_[0, np.cumsum(prefix)].astype(np.int32))
            frequent = np.r_[0, np.cumsum(often[at] > block)]
            ends_p = np.cumsum(prefix)
            raw, rest = tokens.tobytes(), sketch[:, 1:].tobytes()
            keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            # The words of a sketch after the first, as far as they are not folded into others.
            kept, step = (8 * ((sizes > FOLDED) + 2 * (sizes > HALVED))).tolist(), 8 * (SKETCH - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), batch.column(2).take(pa.array(text)), pa.array(place.astype(np.int32)),
                 pa.array(sizes.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(sketch[:, 0].copy().view(np.int64)),
                 pa.array([rest[step * k : step * k + n] if n else None for k, n in enumerate(kept)], pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array((tokens[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                 pa.array((frequent[ends_p] - frequent[ends_p - prefix]).astype(np.int32))],
                names=["doc_id", "own", "line", "size", "key", "sketch", "rest", "prefix", "frequent"])

    tables: list[DataFrame] = []

    def noted(df: DataFrame) -> DataFrame:
        tables.append(stored(df))
        return tables[-1]

    lines = noted(texts.mapInArrow(
        summary, "doc_id long, own long, line int, size int, key binary, sketch long, rest binary, prefix array<int>, frequent int"))
    at = ["doc_id", "own", "line"]
    # A class: the first of its lines, and what they have in common.
    common = [F.first(c).alias(c) for c in ("size", "sketch", "rest", "prefix", "frequent")]
    classes = lines.groupBy("key").agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("copies"), *common)
    classes = noted(classes.select("key", "first.*", "copies", "size", "sketch", "rest", "prefix", "frequent"))

    # A row is its slot (token, and the two blocks that meet), its line, size, place and sketch, in few bytes: shape holds the
    # low bits of line, size and place; high the others, which are seldom set, and which of the two blocks the line is of.
    spread = classes.select(*at, "size", "sketch", "rest", "frequent", F.size("prefix").alias("n"), F.posexplode("prefix").alias("place", "token"))
    zero = F.lit(0)

    def rows_of(spread: DataFrame, i=zero, j=zero, upper=zero) -> DataFrame:
        blocks = F.shiftleft(F.pmod(i, F.lit(1 << 16)), 16).bitwiseOR(F.pmod(j, F.lit(1 << 16)))
        shape = F.expr("shiftleft(bigint(line) & 16777215, 40) | shiftleft(bigint(size) & 1048575, 20) | (bigint(place) & 1048575)")
        high = F.expr("shiftleft(shiftright(line, 24), 22) | shiftleft(shiftright(size, 20), 11) | shiftright(place, 20)")
        high = high.bitwiseOR(F.shiftleft(upper.cast("int"), 30))
        return spread.select("own", blocks.alias("blocks"), high.alias("high"), "rest", "token", "doc_id", shape.alias("shape"), "sketch",
                             *(c for c in spread.columns if c == "open"))

    def slotted(spread: DataFrame) -> DataFrame:
        often = spread.where(F.col("place") >= F.col("n") - F.col("frequent"))
        part = F.pmod(F.xxhash64(*at), F.col("parts")).cast("int")
        cut = often.join(parts, "token").withColumn("part", part).withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        rare = spread.where(F.col("place") < F.col("n") - F.col("frequent")).union(often.join(parts, "token", "left_anti").select(spread.columns))
        i, j = F.least("part", "other"), F.greatest("part", "other")
        return rows_of(rare).union(rows_of(cut, i, j, (i != j) & (F.col("part") == j)))

    # Of tokens frequent in the texts, those with many rows here are cut into blocks.
    parts = spread.where(F.col("place") >= F.col("n") - F.col("frequent")).groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    parts = noted(parts.where("parts > 1"))

    ends = [f"{n}_" for n in at]
    pair = StructType.fromDDL("doc_id long, own long, line int, doc_id_ long, own_ long, line_ int")

    def candidates(rows: DataFrame, marked: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def compare(held: pa.Table) -> pa.RecordBatch:
                c = {name: held[name].to_numpy() for name in held.column_names if name != "rest"}
                shape, high, sketch = c["shape"], c["high"].astype(np.int64), np.zeros((len(held), SKETCH), np.uint64)
                c["line"] = (((high >> 22 & 0xFF) << 24) | (shape >> 40 & 0xFFFFFF)).astype(np.int32)
                size, place = (high >> 11 & 0x7FF) << 20 | shape >> 20 & 0xFFFFF, (high & 0x7FF) << 20 | shape & 0xFFFFF
                sketch[:, 0] = c["sketch"].view(np.uint64)
                for above, (first, last) in ((HALVED, (1, SKETCH)), (FOLDED, (1, 2))):
                    there = (size > above) & ((size <= HALVED) | (above == HALVED))
                    sketch[there, first:last] = np.frombuffer(b"".join(held["rest"].filter(pa.array(there)).to_pylist()), np.uint64).reshape(-1, last - first)
                i, j = c["blocks"] >> 16 & 0xFFFF, c["blocks"] & 0xFFFF
                side = np.where(i == j, -1, high >> 30 & 1)
                slot = c["token"].astype(np.int64) << 32 | c["blocks"].astype(np.int64) & 0xFFFFFFFF
                a, b = near_earlier(slot, side, size, place, sketch, percent, c["open"] if marked else None)
                other = np.logical_or.reduce([c[n][a] != c[n][b] for n in at])
                a, b = a[other], b[other]
                apart = bits_apart(sketch[a], sketch[b], np.minimum(size[a], size[b])).astype(np.int32)
                return pa.RecordBatch.from_arrays([*(pa.array(c[n][k]) for k in (a, b) for n in at), pa.array(apart)], names=[*pair.names, "apart"])

            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(len(h) for h in held) < BUFFER:
                    continue
                rows = pa.Table.from_batches(held).combine_chunks()
                # The last slot may go on in the next batch.
                token, blocks = rows["token"].to_numpy(), rows["blocks"].to_numpy()
                here = (token == token[-1]) & (blocks == blocks[-1])
                whole = int(np.flatnonzero(~here)[-1]) + 1 if not here.all() else 0
                yield compare(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
            if held:
                yield compare(pa.Table.from_batches(held).combine_chunks())

        ordered = rows.repartition("token", "blocks").sortWithinPartitions("token", "blocks", "doc_id", "own", F.expr("shiftright(high & 1073741823, 22)"), "shape")
        found = ordered.mapInArrow(run, StructType([*pair.fields, *StructType.fromDDL("apart int").fields]))
        if marked:
            return found.select(*pair.names).distinct()
        # In the first round the closest candidate of each line, by its sketch.
        best = F.min_by(F.struct(*ends), F.struct("apart", *ends)).alias("best")
        return found.groupBy(*at).agg(best).select(*at, "best.*")

    def lines_of(wanted: DataFrame) -> DataFrame:
        """Texts of the lines (doc_id, own, line)."""
        wanted = noted(wanted)
        numbers = noted(wanted.select("doc_id", "own").distinct())
        # Only texts of such documents are cut, and only such lines are sent to the join.
        cut = asked_only(texts, numbers, ["doc_id", "own"]).select("doc_id", "own", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
        return asked_only(cut, wanted, at).join(wanted, at, "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = [batch.column(c).to_pylist() for c in ("x", "y")]
                good = alike_lines(*both, percent)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in pair.names), pa.array(good)], names=[*pair.names, "alike"])

        sets = noted(lines_of(pairs.select(*at).union(pairs.select(*ends)).distinct()))
        left = pairs.join(sets.withColumnRenamed("words", "x"), at)
        right = sets.select(*[F.col(n).alias(f"{n}_") for n in at], F.col("words").alias("y"))
        both = left.join(right, ends).select(*pair.names, "x", "y")
        return noted(both.mapInArrow(run, StructType([*pair.fields, *StructType.fromDDL("alike boolean").fields])))

    with narrow_batches(spark):
        pairs = noted(candidates(slotted(spread), False))
    judged = verified(pairs)
    alike = judged.where("alike").select(*at).distinct()
    unsettled = noted(judged.where("not alike").select(*at).distinct().join(alike, at, "left_anti"))
    if not unsettled.isEmpty():
        tokens = noted(classes.join(unsettled, at, "left_semi").select(F.explode("prefix").alias("token")).distinct())
        again = spread.join(tokens, "token", "left_semi").join(unsettled.withColumn("open", F.lit(True)), at, "left")
        with narrow_batches(spark):
            rest = noted(candidates(slotted(again.withColumn("open", F.coalesce("open", F.lit(False)))), True))
        rest = noted(rest.join(pairs, pair.names, "left_anti"))
        alike = alike.union(verified(rest).where("alike").select(*at).distinct())

    # Only classes of several lines, or like an earlier one, lose any.
    gone = classes.select("key", "copies", *at).join(alike.withColumn("gone", F.lit(True)), at, "left").where("gone OR copies > 1")
    gone = noted(gone.select("key", *[F.col(n).alias(f"{n}_") for n in at], F.coalesce("gone", F.lit(False)).alias("gone")))
    later = (F.col("doc_id") != F.col("doc_id_")) | (F.col("own") != F.col("own_")) | (F.col("line") != F.col("line_"))
    removed = lines.select("key", *at).join(gone, "key").where(F.col("gone") | later)
    removed = stored(removed.groupBy(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_set("line").alias("_removed")))
    # What the result is made of is this table and the documents.
    discard(*tables)
    named = docs.withColumns({"_doc": identity["doc_id"], "_own": identity["own"]})
    # Texts that lose nothing stay where they are.
    named = asked(named, removed.select("_doc", "_own"), ["_doc", "_own"])
    changed = named.where("_asked").join(removed, ["_doc", "_own"], "left").select(*docs.columns, "_removed")
    joined = changed.union(named.where(~F.col("_asked")).select(*docs.columns, F.lit(None).cast("array<int>").alias("_removed")))
    joined = joined.withColumn("_found", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(zero, F.size("_found") - 1), "_removed")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get("_found", k)), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), zero).otherwise(F.size("_found")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), zero).cast("long").alias("n_removed"),
    )
