"""Best-fit packing: tokenised documents cut into pieces and packed into sequences by minimum bin slack."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.llm.common import numbered
from docweave.session import stored

# Below this code point the classes of characters are the same in every Unicode version in use.
SETTLED = 0x250


class ByteBpe:
    """Ids of the tokenizers library for a byte-level BPE vocabulary.

    ``ranks`` is the same vocabulary as tiktoken ranks. Texts of settled characters are encoded by
    tiktoken, which gives the same ids several times faster; all others by tokenizers itself.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if text and ord(max(text)) < SETTLED:
            try:
                return np.array(self.fast.encode(text, allowed_special="all", disallowed_special=()), "<u4")
            except ValueError:  # the pattern gives up on very long runs of white space
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, ranks: str) -> ByteBpe:
    """One tokenizer per worker process."""
    return ByteBpe(vocabulary, ranks)


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str, size: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of at most ``size`` tokens of all documents: doc_id, piece, start, length, ids.

    A document is its ids and then ``end``; a null text is empty, and so one token. Only longer
    ones are cut; the remainder comes first, so every other piece is full. ``ids`` is binary,
    unsigned 32-bit little-endian numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(vocabulary, ranks)
        last = np.array([end], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([tokenizer.ids(text or ""), last])
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k in range(len(cuts) - 1):
                    rows.append((doc, k, cuts[k], cuts[k + 1] - cuts[k], ids[cuts[k] : cuts[k + 1]].tobytes()))
            columns = zip(*rows) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, StructType.fromDDL("doc_id long, piece int, start long, length long, ids binary"))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the fullest set that fits in ``room``, of at most ``counts[n]`` pieces of length n, largest first.

    Subset sums as bits of one integer: bit s of the k-th set tells whether the first k groups of
    pieces reach s. A count is cut into powers of two, so a length takes few steps.
    """
    groups = []
    for n in sorted((n for n, left in counts.items() if left and n <= room), reverse=True):
        left, part = min(counts[n], room // n), 1
        while left:
            groups.append((n, min(part, left)))
            left -= groups[-1][1]
            part *= 2
    mask, reached = (1 << (room + 1)) - 1, [1]
    for n, times in reversed(groups):  # from the smallest, so that the way back takes the largest it can
        reached.append((reached[-1] | reached[-1] << n * times) & mask)
    total, chosen = reached[-1].bit_length() - 1, []
    for at in range(len(reached) - 1, 0, -1):
        n, times = groups[len(groups) - at]
        if total >= n * times and reached[at - 1] >> (total - n * times) & 1:
            chosen += [n] * times
            total -= n * times
    return chosen


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Minimum bin slack on a histogram: (number of equal bins, lengths in a bin) until no piece is left.

    Each bin takes the largest length left and the fullest feasible set for the rest. The same set
    is taken as often as the counts allow, so the work depends on the lengths, not on the pieces.
    """
    left, made = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        left[first] -= 1
        chosen = [first, *fullest(left, size - first)]
        left[first] += 1
        uses = {n: chosen.count(n) for n in chosen}
        times = min(left[n] // k for n, k in uses.items())
        made.append((times, chosen))
        left = {n: c - times * uses.get(n, 0) for n, c in left.items()}
        left = {n: c for n, c in left.items() if c}
    return made


def pack(pieces: DataFrame, size: int = 1024, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give every row of ``pieces`` (column ``length``, 1 to ``size``) its sequence_id and offset.

    Pieces of equal length are alike for packing: the driver sees only the number of pieces per
    length (at most ``size`` numbers) and makes the list of bins from it; pieces are numbered
    within their length without a large group in one task, and the number tells the place. The
    list of places has a few rows per bin pattern, bounded by ``size`` squared, and is broadcast.
    A null length or one outside 1 to ``size`` is an error. Other columns are kept; the same pieces
    in another order take each other's places.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces)
    counts = {n: c for n, c in pieces.groupBy("length").count().collect()}
    if any(n is None or not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths outside 1 to {size}: {sorted(map(str, counts))[:5]}")
    places, base, used = [], 0, {}
    for times, chosen in patterns(counts, size):
        offset = 0
        for n in dict.fromkeys(chosen):
            k = chosen.count(n)
            first = used.get(n, 0)
            places.append((n, first, first + times * k, k, base, offset))
            used[n] = first + times * k
            offset += n * k
        base += times
    slots = spark.createDataFrame(places, "_n long, _from long, _to long, _each long, _base long, _offset long")
    ranked = numbered(pieces, F.col("length"), list(order), "_rank")
    at = F.col("_rank") - F.col("_from")
    hit = (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(slots), hit).select(
        *pieces.columns, (F.col("_base") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
