"""SentencePiece BPE in numpy: encoding in merge rounds over flat arrays, decoding, and token counts of every prefix."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
RUN = 16
# Entries of a worker's memory of words; it starts anew when full, so its size is bounded.
REMEMBERED = 6_000_000
# Binary logarithm of the slots of a worker's memory of pairs.
PAIR_BITS = 22


class Table:
    """Read-only map from non-negative numbers to numbers, looked up for whole arrays; -1 where there is none."""

    def __init__(self, items: dict[int, int]):
        bits = max(4, (4 * len(items)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for key, at in zip(items, self._slots(np.fromiter(items, np.int64, len(items))).tolist()):
            while self.keys[at] != -1:
                at = (at + 1) & self.last
            self.keys[at], self.values[at] = key, items[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            there = self.keys[at[left]]
            found = there == keys[left]
            out[left[found]] = self.values[at[left[found]]]
            left = left[~found & (there != -1)]
        return out


class Pieces:
    """Vocabulary of a SentencePiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        if model.encode(" a  b", out_type=str) != model.encode("▁a▁▁b", out_type=str):
            raise ValueError(f"{path} normalises texts; only models that mark spaces are supported")
        # Ids of the 256 bytes, and the bytes that each id stands for.
        self.byte_ids = np.zeros(256, np.int32)
        surface = []
        self.ids = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(name.replace(MARK, " ").encode())
                self.ids[name] = i
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.concatenate([[0], np.cumsum(self.surface_len)[:-1]])
        self.spaced = np.array([name.startswith(MARK) for name in names])
        self.silent = self.surface_len == 0
        self._pairs(names, [model.get_score(i) for i in range(size)])
        self._trie()
        # Do spaces only begin a piece, and do pieces of several spaces hold nothing else?
        self.by_word = all(MARK not in p.lstrip(MARK) and (p.strip(MARK) == "" or not p.startswith(MARK * 2)) for p in self.ids)
        self.by_word &= max(len(p) for p in self.ids if not p.strip(MARK)) == RUN
        self.word = re.compile(rf"{MARK}{{{RUN}}}(?={MARK})|{MARK}{{0,{RUN}}}[^{MARK}]+|{MARK}+" if self.by_word else r"(?s).+")

    def _pairs(self, names: list[str], scores: list[float]) -> None:
        """Pairs of ids that merge, what they give, and its rank (equal scores have equal ranks)."""
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = np.full(self.size, len(order) + 1, np.int32)
        for i in self.ids.values():
            self.rank[i] = order[scores[i]]
        found = []
        for name, i in self.ids.items():
            for cut in range(1, len(name)):
                left, right = self.ids.get(name[:cut]), self.ids.get(name[cut:])
                if left is not None and right is not None:
                    found.append((left * self.size + right, i, left, right))
        self.pair_of = {f[0]: f[1] for f in found}
        self.pair_table = Table(self.pair_of)
        # A merge is hasty where its result has a merge of its own that comes no later: then only
        # the leftmost one may be made before looking again.
        self.hasty = np.zeros(self.size, bool)
        for _, i, left, right in found:
            for part in (left, right):
                if self.rank[i] <= self.rank[part]:
                    self.hasty[part] = True

    def _trie(self) -> None:
        """The pieces' prefixes: (state, character) leads to a state; each state may be a piece."""
        states = {"": 0}
        steps = {}
        for name in self.ids:
            for k in range(1, len(name) + 1):
                if name[:k] not in states:
                    states[name[:k]] = len(states)
                    steps[states[name[: k - 1]] * 0x110000 + ord(name[k - 1])] = states[name[:k]]
        self.trie = Table(steps)
        self.state_piece = np.full(len(states), -1, np.int64)
        for name, i in self.ids.items():
            if self.merged(name) == [i]:  # a piece that merging cannot build is never given
                self.state_piece[states[name]] = i
        self.longest = max(map(len, self.ids))

    def merged(self, text: str) -> list[int]:
        """Ids of a short string, merged pair by pair: best rank first, then leftmost; -1 for an unknown character."""
        symbols = [self.ids.get(c, -1) for c in text]
        while len(symbols) > 1:
            best = None
            for k in range(len(symbols) - 1):
                new = self.pair_of.get(symbols[k] * self.size + symbols[k + 1]) if symbols[k] >= 0 and symbols[k + 1] >= 0 else None
                if new is not None and (best is None or self.rank[new] < best[0]):
                    best = (self.rank[new], k, new)
            if best is None:
                break
            symbols[best[1] : best[1] + 2] = [best[2]]
        return symbols

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and the number of ids of each word.

        In every round each word finds its best pair among its symbols (a segmented minimum), all
        its pairs of that rank are merged at once from the left, and the arrays are compacted.
        Words in which no pair is left leave the arrays.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        # Characters that are pieces are their id, others are -1 - code point.
        kinds, where = np.unique(points, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1 - int(c)) for c in kinds], np.int64)
        symbols = known[where] if len(points) else points
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        never = np.iinfo(np.int32).max
        while len(symbols):
            pair = (owner[:-1] == owner[1:]) & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
            new = np.full(len(symbols), -1, np.int64)
            new[:-1][pair] = self.pair_table(symbols[:-1][pair] * self.size + symbols[1:][pair])
            rank = np.where(new >= 0, self.rank[new], never)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == never
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                left = ~over
                symbols, owner, new, rank, least = symbols[left], owner[left], new[left], rank[left], least[left]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == least)
            # Of overlapping pairs every second one is made, counted from the left of their run.
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.flatnonzero(fresh)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            first = np.r_[True, owner[hit][1:] != owner[hit][:-1]]
            hit = hit[(place % 2 == 0) & (first | ~self._held(hit, owner, new))]
            symbols[hit] = new[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
        if (symbols < 0).any():
            symbols, owner = self._bytes(symbols, owner)
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(words))

    def _held(self, hit: np.ndarray, owner: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Hits of words in which any hit is hasty: there only the leftmost may be merged."""
        words, where = np.unique(owner[hit], return_inverse=True)
        hasty = np.zeros(len(words), bool)
        np.logical_or.at(hasty, where, self.hasty[new[hit]])
        return hasty[where]

    def _bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace unknown characters by the ids of their UTF-8 bytes."""
        spelled = {int(s): self.byte_ids[list(chr(-1 - int(s)).encode())] for s in np.unique(symbols[symbols < 0])}
        width = np.ones(len(symbols), np.int64)
        for s, ids in spelled.items():
            width[symbols == s] = len(ids)
        out, at = np.repeat(symbols, width), np.concatenate([[0], np.cumsum(width)[:-1]])
        for s, ids in spelled.items():
            out[at[symbols == s][:, None] + np.arange(len(ids))] = ids
        return out, np.repeat(owner, width)

    def prefix_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of every prefix of every word, end to end, and the words' lengths.

        The encoding of a prefix ends in the one piece that goes with the last piece of what is
        left before it: two neighbours go together when merging their joint text gives the two
        back. So one step per character finds last piece and count from those of shorter prefixes.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        start_of = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(points)) - start_of
        room = np.repeat(sizes, sizes) - place
        ends, begins, tokens = [], [], []
        alive, state = np.arange(len(points)), np.zeros(len(points), np.int64)
        for length in range(1, self.longest + 1):
            inside = room[alive] >= length
            alive, state = alive[inside], state[inside]
            state = self.trie(state * 0x110000 + points[alive + length - 1])
            if length == 1:
                strange = alive[state < 0]
            alive, state = alive[state >= 0], state[state >= 0]
            piece = self.state_piece[state]
            ends.append(alive[piece >= 0] + length - 1)
            begins.append(alive[piece >= 0])
            tokens.append(piece[piece >= 0])
        # A character without a piece stands alone, as so many byte tokens, and goes with anything.
        ends, begins, tokens = np.concatenate([*ends, strange]), np.concatenate([*begins, strange]), np.concatenate(
            [*tokens, np.full(len(strange), self.size)])
        cost = np.where(tokens < self.size, 1, self._utf8(points[begins]))
        order = np.argsort(place[ends], kind="stable")
        ends, begins, tokens, cost = ends[order], begins[order], tokens[order], cost[order]
        cuts = np.searchsorted(place[ends], np.arange(sizes.max(initial=0) + 1))
        last, count = np.full(len(points), -1, np.int64), np.zeros(len(points), np.int32)
        for k in range(len(cuts) - 1):
            e, b, t, c = (x[cuts[k] : cuts[k + 1]] for x in (ends, begins, tokens, cost))
            head = place[b] == 0
            before = np.where(head, self.size, last[b - 1])
            good = head | self._together(before, t)
            e, b, t, c, head = e[good], b[good], t[good], c[good], head[good]
            last[e] = t
            count[e] = c + np.where(head, 0, count[b - 1])
        return count, sizes

    @staticmethod
    def _utf8(points: np.ndarray) -> np.ndarray:
        return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)

    def _together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces gives these two pieces."""
        free = (left >= self.size) | (right >= self.size)
        keys = left * self.size + right
        if not hasattr(self, "known_pairs"):
            # A pair has one slot by its hash; the last pair of a slot stays, so the memory is bounded.
            self.known_pairs, self.known_good = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
            self.names = {i: n for n, i in self.ids.items()}
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        good = self.known_good[slot]
        lacks = np.flatnonzero((self.known_pairs[slot] != keys) & ~free & (left >= 0))
        if len(lacks):
            missing, where = np.unique(keys[lacks], return_inverse=True)
            first, second = missing // self.size, missing % self.size
            ids, sizes = self.encode_words([self.names[a] + self.names[b] for a, b in zip(first.tolist(), second.tolist())])
            at, two = np.cumsum(sizes) - sizes, sizes == 2
            new = np.zeros(len(missing), bool)
            new[two] = (ids[at[two]] == first[two]) & (ids[at[two] + 1] == second[two])
            good[lacks] = new[where]
            self.known_pairs[slot[lacks]], self.known_good[slot[lacks]] = keys[lacks], new[where]
        return free | (good & (left >= 0))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: spaces for marks, one leading space dropped, bytes that are no UTF-8 replaced one by one."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        width = self.surface_len[ids]
        at = np.repeat(self.surface_start[ids] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        text = self.surface[at].tobytes()
        return text[1 if self.spaced[ids[0]] else 0 :].decode("utf-8", "each-byte")


codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)


@lru_cache(maxsize=4)
def memory(path: str, kind: str) -> Memory:
    """One memory per worker process, model and kind of array, kept from task to task."""
    return Memory(getattr(pieces(path), kind))


class Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Memory:
    """Per-word arrays computed once: finds the rows of words and computes what is missing."""

    def __init__(self, compute):
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.filled = 0
        self.values = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word. Starts anew first if the memory is full, so rows hold until the next call."""
        if len(self.known) + self.filled > REMEMBERED:
            self.clear()
        self.known.fresh = missing = []
        n = len(self.known)
        rows = np.array(list(map(self.known.__getitem__, words)), np.int64)
        if missing:
            values, sizes = self.compute(missing)
            end = self.filled + len(values)
            self.values = self._room(self.values, end)
            self.starts, self.sizes = self._room(self.starts, n + len(missing)), self._room(self.sizes, n + len(missing))
            self.values[self.filled : end] = values
            self.starts[n : n + len(missing)] = self.filled + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(missing)] = sizes
            self.filled = end
        return rows

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """Values of the rows end to end."""
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.values[at]


def split(vocabulary: Pieces, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Words of marked texts, end to end, and their number per text."""
    words: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = vocabulary.word.findall(MARK + text.replace(" ", MARK))
            sizes[k] = len(found)
            words += found
    return words, sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def encode(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """Columns of ``docs`` plus ``ids``: the ids of the whole text as the sentencepiece library gives them.

    ``ids`` is binary, unsigned 32-bit little-endian numbers, begin and end id included. A null
    text is empty. Works batch by batch without a shuffle; words are encoded once per worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        known = memory(model, "encode_words")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            words, sizes = split(vocabulary, texts)
            rows = known.rows(words)
            ids = known.gather(rows).astype("<u4")
            ends = np.cumsum(sums(known.sizes[rows], sizes))
            frame = np.array([vocabulary.begin, vocabulary.end], "<u4")
            out = [frame[:1].tobytes() + part.tobytes() + frame[1:].tobytes() for part in np.split(ids, ends[:-1])] if len(texts) else []
            yield _with(batch, {"ids": pa.array(out, pa.binary())})

    return docs.mapInArrow(run, _schema(docs, "ids binary"))


def decode(encoded: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """Columns of ``encoded`` plus ``decoded``, the text of the ids as the library decodes them; null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = [vocabulary.decode(np.frombuffer(i or b"", "<u4").astype(np.int64)) for i in ids]
            yield _with(batch, {"decoded": pa.array(out, pa.string())})

    return encoded.mapInArrow(run, _schema(encoded, "decoded string"))


def count_tokens(docs: DataFrame, model: str, budget: int, column: str = "text", prefixes: bool = False) -> DataFrame:
    """Columns of ``docs`` plus ``n_tokens`` and ``fit_chars``; with ``prefixes`` also the whole table of counts.

    The number of tokens, without begin and end, is known for every prefix of a text (in code
    points, the empty one left out); ``n_tokens`` is that of the whole text, ``fit_chars`` the
    longest prefix with at most ``budget`` tokens, so a cut needs no second encoding.
    ``prefix_tokens`` holds the counts as signed 32-bit little-endian numbers. A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        known = memory(model, "prefix_counts")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            words, sizes = split(vocabulary, texts)
            rows = known.rows(words)
            inside = known.gather(rows)
            lengths = known.sizes[rows]
            whole = known.values[known.starts[rows] + lengths - 1].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            total = sums(whole, sizes)
            chars = sums(lengths, sizes)
            # Tokens of the words before, counted within each text.
            before = np.cumsum(whole) - whole - np.repeat(np.cumsum(total) - total, sizes)
            counts = inside + np.repeat(before, lengths)
            fit, tables, at = [], [], 0
            for n, size in zip(total.tolist(), chars.tolist()):
                own = counts[at + 1 : at + size].astype("<i4")  # the first character is the added space
                at += size
                good = np.flatnonzero(own <= budget) if n > budget else own
                fit.append(len(own) if n <= budget else int(good[-1]) + 1 if len(good) else 0)
                tables.append(own.tobytes() if prefixes else None)
            made = {"n_tokens": pa.array(total, pa.int64()), "fit_chars": pa.array(fit, pa.int64())}
            yield _with(batch, made | ({"prefix_tokens": pa.array(tables, pa.binary())} if prefixes else {}))

    return docs.mapInArrow(run, _schema(docs, "n_tokens long, fit_chars long" + ", prefix_tokens binary" * prefixes))


def _schema(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
