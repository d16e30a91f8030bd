"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes are coalesced into groups and linked where they overlap."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.llm.packing import SETTLED
from docweave.llm.pieces import memory, pieces, split
from docweave.session import stored

# Links after which a block of documents is closed: what one task holds at once.
BLOCK_LINKS = 1 << 24
# Pairs per dictionary row of a block.
CHUNK = 1 << 16
# Pairs of documents gathered before they are merged into the pairs of their block.
FRESH = 1 << 22
FIELDS = (
    "block long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, ends binary, "
    "pairs binary, keys array<int>, docs array<int>"
)
TYPES = {
    **dict.fromkeys(("block", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links"), pa.int64()),
    "groups": pa.string(), "ends": pa.binary(), "pairs": pa.binary(), "keys": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()),
}


class PlainBytes:
    """Byte-level BPE that takes the strings of special tokens for plain text, and the bytes of its ids."""

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        size = max(table.values()) + 1
        words = [b""] * size
        for word, rank in table.items():
            words[rank] = word
        self.surface = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids(self, text: str) -> np.ndarray:
        if ord(max(text)) < SETTLED:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)
            except ValueError:  # the pattern gives up on very long runs of white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)


@lru_cache(maxsize=2)
def plain_bytes(vocabulary: str, ranks: str) -> PlainBytes:
    """One tokenizer per worker process."""
    return PlainBytes(vocabulary, ranks)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of every run, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order intervals by start and give each, in that order, the number of its group.

    A group breaks where a start reaches the largest end seen before it.
    """
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.r_[False, starts[order][1:] >= reach[:-1]] if len(order) else np.zeros(0, bool)
    return order, np.cumsum(breaks)


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of an A and a B interval that share a byte; both lists ascend and have no gaps."""
    first = np.searchsorted(ends_b, starts_a, "right")
    sizes = np.searchsorted(starts_b, ends_a, "left") - first
    return np.repeat(np.arange(len(starts_a)), sizes), spread(first, sizes)


def written(ids: np.ndarray, group: np.ndarray, side: np.ndarray, doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Text form ``a1,a2|b1;a3|b2,b3`` of the tokens of all documents, end to end, and where each token's text ends."""
    digits = np.zeros((len(ids), 11), np.uint8)
    width = np.ones(len(ids), np.int64)
    for power in range(1, 10):
        width += ids >= 10**power
    for place in range(int(width.max(initial=1))):
        here = width > place
        digits[here, place] = 48 + ids[here] // 10 ** (width[here] - 1 - place) % 10
    last = np.r_[doc[1:] != doc[:-1], True]
    new_group, new_side = np.r_[group[1:] != group[:-1], True], np.r_[side[1:] != side[:-1], True]
    mark = np.where(last, 0, np.where(new_group, ord(";"), np.where(new_side, ord("|"), ord(","))))
    digits[np.arange(len(ids)), width] = mark
    return digits[digits != 0].tobytes(), np.cumsum(width + (mark != 0))


class Block:
    """Which documents of a task belong together: their pairs and how many documents hold each."""

    def __init__(self):
        self.number = TaskContext.get().partitionId() << 32
        self._open()

    def _open(self) -> None:
        self.rows, self.links, self.fresh = 0, 0, []
        self.keys, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, rows: int, links: int) -> None:
        """``keys`` holds every pair once for each document of a batch that has it."""
        self.fresh.append(keys)
        self.rows, self.links = self.rows + rows, self.links + links
        if sum(map(len, self.fresh)) > FRESH:
            self._merge()

    def _merge(self) -> None:
        fresh, docs = np.unique(np.concatenate([np.zeros(0, np.int64), *self.fresh]), return_counts=True)
        keys, where = np.unique(np.r_[self.keys, fresh], return_inverse=True)
        self.docs = np.bincount(where, weights=np.r_[self.docs, docs], minlength=len(keys)).astype(np.int64)
        self.keys, self.fresh = keys, []

    def close(self) -> Iterator[pa.RecordBatch]:
        """Dictionary rows of the block; the next block begins."""
        self._merge()
        for at in range(0, len(self.keys), CHUNK):
            part = slice(at, at + CHUNK)
            yield _batch({"block": [self.number], "keys": [self.keys[part]], "docs": [self.docs[part]]}, 1)
        self.number += 1
        self._open()


def _batch(columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * rows), t) for n, t in TYPES.items()], names=list(TYPES))


def packed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pair keys and how often each occurs, as byte planes of their differences, which compress well."""
    both = np.stack([np.diff(keys, prepend=0), times]).astype("<u4")
    return both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``packed``."""
    planes = np.frombuffer(blob, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    both = np.ascontiguousarray(planes).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _aligned(a: PlainBytes, b, known, docs: list, texts: list, block: Block) -> pa.RecordBatch:
    """Align a batch of documents at once: their bytes stand end to end, and groups never cross documents."""
    n = len(texts)
    given = [b" " + t.encode() if t else b"" for t in texts]
    parts = [a.ids(" " + t) if t else np.zeros(0, np.int64) for t in texts]
    ids_a, sizes_a = np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(p) for p in parts], np.int64)
    words, n_words = split(b, texts)
    rows = known.rows(words)
    ids_b, per_word = known.gather(rows).astype(np.int64), known.sizes[rows]
    doc_of_word = np.repeat(np.arange(n), n_words)
    sizes_b = np.bincount(doc_of_word, weights=per_word, minlength=n).astype(np.int64)

    def surface(ids, starts, lengths, table):
        return table[spread(starts[ids], lengths[ids])].tobytes()

    whole = b"".join(given)
    bytes_a = surface(ids_a, a.starts, a.lengths, a.surface)
    bytes_b = surface(ids_b, b.surface_start, b.surface_len, b.surface)
    if bytes_a != whole or bytes_b != whole:  # some document is not spelled by its tokens: it has none
        good = np.zeros(n, bool)
        ends_a = np.cumsum(np.bincount(np.repeat(np.arange(n), sizes_a), weights=a.lengths[ids_a], minlength=n)).astype(np.int64)
        ends_b = np.cumsum(np.bincount(np.repeat(np.arange(n), sizes_b), weights=b.surface_len[ids_b], minlength=n)).astype(np.int64)
        for k, text in enumerate(given):
            good[k] = bytes_a[ends_a[k - 1] if k else 0 : ends_a[k]] == text == bytes_b[ends_b[k - 1] if k else 0 : ends_b[k]]
        ids_a, ids_b = ids_a[np.repeat(good, sizes_a)], ids_b[np.repeat(good, sizes_b)]
        sizes_a, sizes_b = sizes_a * good, sizes_b * good
        given = [text if ok else b"" for text, ok in zip(given, good)]

    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.surface_len[ids_b])
    starts_a, starts_b = ends_a - a.lengths[ids_a], ends_b - b.surface_len[ids_b]
    starts, ends = np.r_[starts_a, starts_b], np.r_[ends_a, ends_b]
    order, group_of = coalesce(starts, ends)
    group = np.empty(len(order), np.int64)
    group[order] = group_of
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    doc = np.r_[np.repeat(np.arange(n), sizes_a), np.repeat(np.arange(n), sizes_b)]
    shown = np.lexsort((side, group))  # stable, so tokens of a side keep their order
    text, text_ends = written(np.r_[ids_a, ids_b][shown], group[shown], side[shown], doc[shown])
    both = sizes_a + sizes_b
    cuts = np.r_[0, np.r_[0, text_ends][np.cumsum(both)]]
    # Group ends are the ends of A's tokens that close a group, counted in the document.
    closing = np.r_[group[: len(ids_a)][1:] != group[: len(ids_a)][:-1], True] if len(ids_a) else np.zeros(0, bool)
    base = np.cumsum([len(t) for t in given]) - np.array([len(t) for t in given], np.int64)
    doc_a = doc[: len(ids_a)]
    group_ends = (ends_a - base[doc_a])[closing].astype("<u4")
    n_groups = np.bincount(doc_a[closing], minlength=n)
    end_cuts = np.r_[0, np.cumsum(n_groups)]

    left, right = overlaps(starts_a, ends_a, starts_b, ends_b)
    keys = doc_a[left] << 32 | ids_a[left] * b.size + ids_b[right]
    keys, times = np.unique(keys, return_counts=True)
    pair_doc, keys = keys >> 32, keys & 0xFFFFFFFF
    n_links = np.bincount(doc_a[left], minlength=n)
    pair_cuts = np.searchsorted(pair_doc, np.arange(n + 1))
    first = block.rows
    block.add(keys, n, len(left))
    return _batch({
        "block": np.full(n, block.number), "row": np.arange(first, first + n), "doc_id": docs,
        "n_a": sizes_a, "n_b": sizes_b, "n_groups": n_groups, "n_links": n_links,
        "groups": [text[cuts[k] : cuts[k + 1]].decode() for k in range(n)],
        "ends": [group_ends[end_cuts[k] : end_cuts[k + 1]].tobytes() for k in range(n)],
        "pairs": [packed(keys[pair_cuts[k] : pair_cuts[k + 1]], times[pair_cuts[k] : pair_cuts[k + 1]]) for k in range(n)],
    }, n)


def align(docs: DataFrame, vocabulary: str, ranks: str, model: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Align the tokens of every text of ``docs(doc_id, text)`` under a byte-level BPE (A) and a sentencepiece model (B).

    A encodes a space and the text, B the text, to which it adds the space itself; special tokens are
    plain text to both. ``ranks`` is A's vocabulary as tiktoken ranks. One row per document:
    n_a, n_b, n_groups, n_links, ``groups`` (ids as ``a1,a2|b1;a3|b2,b3``), ``ends`` (byte offset in space
    and text at which each group ends, unsigned 32-bit little-endian) and ``pairs`` (see ``packed``: the
    id pairs A * size of B + B that overlap, and how often). A text that is null, empty or not spelled
    by both token sequences has no tokens: zeros and empty values. Repeated and null ids are rows like
    any other; more columns of ``docs`` are left out.

    Documents of a task that stand together form a ``block``, numbered by ``row``; each block also gives
    rows with ``row`` null that list its distinct pairs (``keys``) and the number of its documents
    that hold them (``docs``). No shuffle; a task holds one Arrow batch and the pairs of one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = plain_bytes(vocabulary, ranks), pieces(model)
        known, block = memory(model, "encode_words"), Block()
        for batch in batches:
            if batch.num_rows:
                yield _aligned(a, b, known, batch.column(0).to_pylist(), batch.column(1).to_pylist(), block)
            if block.links >= block_links:
                yield from block.close()
        yield from block.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, StructType.fromDDL(FIELDS))


def link_support(aligned: DataFrame, model: str) -> DataFrame:
    """Add n_best and count_sum to stored rows of ``align``: how the links of a document are shared by the corpus.

    A pair's count is the number of documents that hold it. ``count_sum`` adds the counts over the
    links of a document, ``n_best`` counts its links whose count is the highest of their A id. A pair
    has one row per block, not per document, so the commonest pair weighs no more in the shuffle than
    any pair found in every block, and each block then meets the counts of its own pairs only.
    The highest counts go to all tasks: one number per A id, so the vocabulary bounds them.
    """
    size = pieces(model).size
    given = aligned.where("row IS NULL").select("block", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("docs").alias("docs"))))
    total = F.sum("docs").over(W.partitionBy("key"))
    counted = stored(given.select("block", "key", total.alias("count")))
    best = counted.groupBy(F.floor(F.col("key") / size).cast("int").alias("a")).agg(F.max("count").alias("best")).toArrow()
    highest = np.zeros(int(max(best["a"].to_pylist(), default=0)) + 1, np.int64)
    highest[best["a"].to_numpy()] = best["best"].to_numpy()
    kept = [f for f in aligned.schema.fields if f.name not in ("block", "row", "pairs", "keys", "docs")]
    result = StructType([*kept, *StructType.fromDDL("n_best long, count_sum long").fields])

    def support(rows: pa.Table, counts: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        keys, numbers = counts["key"].to_numpy().astype(np.int64), counts["count"].to_numpy()
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        is_best = numbers == highest[keys // size] if len(keys) else np.zeros(0, bool)
        n_best, sums = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        at = 0
        for chunk in rows["pairs"].chunks:
            for blob in chunk:
                own, times = unpacked(blob.as_py())
                place = np.searchsorted(keys, own)
                n_best[at], sums[at] = (times * is_best[place]).sum(), (times * numbers[place]).sum()
                at += 1
        table = rows.select([f.name for f in kept])
        return table.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(sums))

    rows = aligned.where("row IS NOT NULL").select("block", "row", "pairs", *[f.name for f in kept])
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(support, result)
