"""Scoring by a gated recurrent language model: truncated backpropagation in numpy, class-factored softmax, whole documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.session import stored

# Words after which a block of documents is closed, and distinct words per dictionary row.
BLOCK_WORDS, CHUNK = 1 << 22, 1 << 14
# Words of learned documents gathered before they are counted.
FRESH = 1 << 20
# Words of documents that are scored or trained on together, and lanes and steps of a training window.
TOGETHER, LANES, WINDOW = 1 << 22, 128, 16
# Texts whose states move on together when they are scored.
TEXTS = 512
# Numbers per row of parameters on their way to the average, and tasks averaged in one group.
SLICE, GROUPED = 1 << 15, 64
SMOOTH = 0.1

# ---------------------------------------------------------------- words and counts


def held_out(doc_id) -> bool:
    """Documents the model never learns from; those without an id among them."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


BLOCKS = "block long, row long, doc_id long, held_out boolean, tokens binary, first int, words array<binary>, seen array<long>"
BLOCK_TYPES = {
    "block": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "tokens": pa.binary(),
    "first": pa.int32(), "words": pa.list_(pa.binary()), "seen": pa.list_(pa.int64()),
}


def _record(types: dict, columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * rows), t) for n, t in types.items()], names=list(types))


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Texts as numbers of words, in blocks of documents that share a list of words.

    A-Z are lower-cased; a text is its words and then the end, which is written as the empty word.
    Rows with ``row`` hold a document (``tokens``: signed 32-bit little-endian numbers), the others
    a part of the block's list from number ``first`` on, with how often each word was ``seen`` in documents
    that are learned from. No shuffle; a task holds one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size, numbers, seen, learned = TaskContext.get().partitionId() << 32, 0, 0, Numbers(), np.zeros(0, np.int64), []

        def counted():
            more = np.bincount(np.concatenate([np.zeros(0, np.int32), *learned]), minlength=len(numbers))
            more[: len(seen)] += seen
            return more

        def listed():
            words, seen = list(numbers), counted()
            for at in range(0, len(words), CHUNK):
                part = slice(at, at + CHUNK)
                yield _record(BLOCK_TYPES, {"block": [block], "first": [at], "words": [words[part]], "seen": [seen[part]]}, 1)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            held = [held_out(i) for i in ids]
            tokens = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = (text or b"").lower().split()
                found.append(b"")
                tokens.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            learned += [t for t, h in zip(tokens, held) if not h]
            if sum(map(len, learned)) >= FRESH:
                seen, learned = counted(), []
            if ids:
                yield _record(BLOCK_TYPES, {
                    "block": np.full(len(ids), block), "row": np.arange(rows, rows + len(ids)), "doc_id": ids, "held_out": held,
                    "tokens": [t.tobytes() for t in tokens]}, len(ids))
            rows, size = rows + len(ids), size + sum(map(len, tokens))
            if size >= block_words:
                yield from listed()
                block, rows, size, numbers, seen, learned = block + 1, 0, 0, Numbers(), np.zeros(0, np.int64), []
        yield from listed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, StructType.fromDDL(BLOCKS))


@dataclass
class Counts:
    """What is known of the words of all documents that are learned from."""

    total: int
    distinct: int
    # Counts of the words in the model, most frequent first.
    kept: np.ndarray

    def log10(self, count: np.ndarray) -> np.ndarray:
        """Smoothed log10 share of words of these counts; one unknown word is allowed for."""
        return np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    @property
    def rest(self) -> float:
        """Smoothed mass of all words outside the model, the unknown one too."""
        return self.total - float(self.kept.sum()) + SMOOTH * (self.distinct - len(self.kept) + 1)


def counted_documents(docs: DataFrame, kept: int) -> tuple[DataFrame, Counts]:
    """(doc_id, held_out, n_tokens, n_known, base_score, rest_score, ids) of all documents, and the corpus counts.

    ``ids`` are the ``kept`` most frequent learned words by rank (ties by hash), ``kept`` standing for any other;
    ``rest_score`` is the log10 probability of the others among themselves, in proportion to their
    smoothed counts. Words are counted per block first; each block then meets the counts of its own words, so
    no count table is broadcast and a word of every document has one row per block. Sent to the driver: the
    hashes of ``kept`` words.
    """
    blocks = stored(word_blocks(docs))
    lists = blocks.where("row IS NULL").select("block", "first", F.posexplode(F.arrays_zip("words", "seen")).alias("at", "w"))
    same = W.partitionBy("word")
    words = lists.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("w.words").alias("word"), F.col("w.seen").alias("seen"))
    words = stored(words.select(
        "block", "number", F.sum("seen").over(same).alias("count"), F.xxhash64("word").alias("hash"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first")))
    known = words.where("first AND count > 0")
    distinct, total = known.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    top = known.orderBy(F.col("count").desc(), "hash").limit(kept).select("count", "hash").collect()
    counts = Counts(total, distinct, np.array([r["count"] for r in top], np.int64))
    hashes = np.array([r["hash"] for r in top], np.int64)
    by_hash = np.argsort(hashes)
    rest = np.log10(counts.rest)
    schema = StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest_score double, ids binary")

    def numbered(rows: pa.Table, listed: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        count, rank = np.zeros(listed.num_rows, np.int64), np.full(listed.num_rows, kept, np.uint16)
        number, own = listed["number"].to_numpy(), listed["hash"].to_numpy()
        count[number] = listed["count"].to_numpy()
        if len(hashes):
            place = np.minimum(np.searchsorted(hashes, own, sorter=by_hash), len(hashes) - 1)
            hit = (hashes[by_hash[place]] == own) & (listed["count"].to_numpy() == counts.kept[by_hash[place]])
            rank[number[hit]] = by_hash[place[hit]]
        base = counts.log10(count)
        outside = np.where(rank == kept, np.log10(count + SMOOTH) - rest, 0.0)
        out = {f.name: [] for f in schema}
        for blob in (b.as_py() for chunk in rows["tokens"].chunks for b in chunk):
            tokens = np.frombuffer(blob, "<i4")
            out["n_tokens"].append(len(tokens))
            out["n_known"].append(int((count[tokens] > 0).sum()))
            out["base_score"].append(float(base[tokens].sum()))
            out["rest_score"].append(float(outside[tokens].sum()))
            out["ids"].append(rank[tokens].astype("<u2").tobytes())
        made = {n: pa.array(out[n], t) for n, t in zip(
            ("n_tokens", "n_known", "base_score", "rest_score", "ids"), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))}
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], **made})

    rows = blocks.where("row IS NOT NULL").select("block", "row", "doc_id", "held_out", "tokens")
    return rows.groupBy("block").cogroup(words.drop("first").groupBy("block")).applyInArrow(numbered, schema), counts


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Embedding, one gated recurrent layer, and a softmax over classes of words and then the words of a class.

    Words are ranked by frequency and dealt to classes of ``width`` neighbours; one more class
    holds all words outside the model. The output biases begin at the words' shares, so an
    untrained network already gives the smoothed frequencies. Start of a text: its own input.
    """

    def __init__(self, counts: Counts, kept: int, hidden: int = 16, embedded: int = 16, width: int = 32, dtype=np.float32):
        self.kept, self.hidden, self.width = kept, hidden, width
        self.classes = -(-kept // width)
        self.dtype = dtype
        mass = np.zeros(self.classes * width)
        mass[: len(counts.kept)] = counts.kept + SMOOTH
        per_class = np.r_[mass.reshape(self.classes, width).sum(1), counts.rest]
        draw = np.random.default_rng(1)

        def drawn(*shape, scale):
            return draw.normal(0, scale, shape)

        with np.errstate(divide="ignore", invalid="ignore"):
            start = {
                "embed": drawn(kept + 2, embedded, scale=0.3),
                "into": drawn(embedded, 3 * hidden, scale=embedded**-0.5), "bias": np.zeros(3 * hidden),
                "again": drawn(hidden, 3 * hidden, scale=hidden**-0.5), "again_bias": np.zeros(hidden),
                "class": drawn(hidden, self.classes + 1, scale=0.05), "class_bias": np.maximum(np.log(per_class / per_class.sum()), -80),
                "word": drawn(self.classes, hidden, width, scale=0.05),
                "word_bias": np.where(mass > 0, np.log(mass) - np.repeat(np.log(per_class[:-1]), width), -80).reshape(self.classes, width),
            }
        # Words that do not exist (a small corpus) have no mass at all, whatever is learned.
        self.absent = (mass == 0).reshape(self.classes, width)
        self.set({name: value.astype(dtype) for name, value in start.items()})

    def set(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, value in self.p.items():
            self.p[name] = flat[at : at + value.size].reshape(value.shape).astype(self.dtype)
            at += value.size

    def forward(self, inputs: np.ndarray, state: np.ndarray, fresh: np.ndarray | None = None):
        """States after every step of ``inputs(steps, lanes)`` and what going back needs; ``fresh`` lanes begin anew."""
        p, h = self.p, self.hidden
        given = p["embed"][inputs]
        gates = given @ p["into"] + p["bias"]
        steps, lanes = inputs.shape
        states, before, carried, new = (np.empty((steps, lanes, h), self.dtype) for _ in range(4))
        open_ = np.empty((steps, lanes, 2 * h), self.dtype)  # how far each unit updates and resets
        kept = None if fresh is None else (~fresh[:, :, None]).astype(self.dtype)
        for t in range(steps):
            before[t] = state if fresh is None else state * kept[t]
            again = before[t] @ p["again"]
            open_[t] = _sigmoid(gates[t, :, : 2 * h] + again[:, : 2 * h])
            carried[t] = again[:, 2 * h :] + p["again_bias"]
            new[t] = np.tanh(gates[t, :, 2 * h :] + open_[t, :, h:] * carried[t])
            state = states[t] = new[t] + open_[t, :, :h] * (before[t] - new[t])
        return states, (given, before, open_, carried, new, kept)

    def _softmax(self, logits: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability of the picked column of every row, and the exponentials and their sums.

        Logits, which begin at or below 0, are kept where their exponential is finite.
        """
        np.clip(logits, -80, 80, out=logits)
        own = logits[np.arange(len(logits)), picked]
        powers = np.exp(logits, out=logits)
        sums = powers @ np.ones((powers.shape[1], 1), self.dtype)
        return own - np.log(sums[:, 0]), powers, sums

    def _slope(self, powers: np.ndarray, sums: np.ndarray, picked: np.ndarray, scale) -> np.ndarray:
        """Gradient of the scaled negative log probability by the logits, in place of the exponentials."""
        powers *= scale / sums
        powers[np.arange(len(powers)), picked] -= scale
        return powers

    def _classes(self, targets: np.ndarray) -> np.ndarray:
        return np.where(targets == self.kept, self.classes, targets // self.width)

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Places of the targets in classes of words, ordered by class, and the part of each class."""
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(self.classes + 1)).tolist()
        return order[: cuts[-1]], [(c, slice(i, j)) for c, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]

    def _word_logits(self, states: np.ndarray, classes: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """Logits of the words of each state's class, for states ordered by class."""
        logits = self.p["word_bias"][classes]
        for c, part in parts:
            logits[part] += states[part] @ self.p["word"][c]
        if self.absent.any():
            logits[self.absent[classes]] = -80
        return logits

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (a word's rank, or ``kept``: outside) after its state."""
        classes = self._classes(targets)
        out = self._softmax(states @ self.p["class"] + self.p["class_bias"], classes)[0].astype(np.float64)
        at, parts = self._by_class(classes)
        own = classes[at]
        out[at] += self._softmax(self._word_logits(states[at], own, parts), targets[at] - own * self.width)[0]
        return out

    def gradients(self, inputs, targets, counted, state, fresh):
        """Gradient of the mean negative log probability of the counted targets of a window, the loss sum and the last state.

        The state before the window is taken as given, which cuts the way back there.
        """
        p, h = self.p, self.hidden
        states, (given, before, open_, carried, new, kept) = self.forward(inputs, state, fresh)
        live = np.flatnonzero(counted.ravel())
        scale = self.dtype(1 / max(1, len(live)))
        flat = states.reshape(-1, h)[live]
        wanted = targets.ravel()[live]
        classes = self._classes(wanted)
        log_class, powers, sums = self._softmax(flat @ p["class"] + p["class_bias"], classes)
        d_class = self._slope(powers, sums, classes, scale)
        g = {"class": flat.T @ d_class, "class_bias": d_class.sum(0)}
        d_flat = d_class @ p["class"].T
        at, parts = self._by_class(classes)
        near, own = flat[at], classes[at]
        place = wanted[at] - own * self.width
        log_word, powers, sums = self._softmax(self._word_logits(near, own, parts), place)
        loss = -float(log_class.sum()) - float(log_word.sum())
        d_word = self._slope(powers, sums, place, scale)
        g["word"], g["word_bias"] = np.zeros_like(p["word"]), np.zeros_like(p["word_bias"])
        back, d_near = np.ascontiguousarray(p["word"].transpose(0, 2, 1)), np.empty_like(near)
        for c, part in parts:
            g["word"][c] = near[part].T @ d_word[part]
            d_near[part] = d_word[part] @ back[c]
        if parts:
            g["word_bias"][[c for c, _ in parts]] = np.add.reduceat(d_word, [part.start for _, part in parts])
        d_flat[at] += d_near
        d_states = np.zeros((states.shape[0] * states.shape[1], h), self.dtype)
        d_states[live] = d_flat
        d_states = d_states.reshape(states.shape)
        update, reset = open_[:, :, :h], open_[:, :, h:]
        # What each gate passes on of the state's gradient, for the whole window at once.
        by_new = (1 - update) * (1 - new * new)
        by_update, by_reset = (before - new) * update * (1 - update), by_new * carried * reset * (1 - reset)
        by_gate, by_carried = np.concatenate([by_update, by_reset, by_new], 2), by_new * reset
        d_gates, d_again = np.empty_like(by_gate), np.empty_like(by_gate)
        back = np.ascontiguousarray(p["again"].T)
        d_next = np.zeros_like(state)
        for t in range(len(inputs) - 1, -1, -1):
            d_state = d_states[t] + d_next
            np.multiply(by_gate[t].reshape(-1, 3, h), d_state[:, None], out=d_gates[t].reshape(-1, 3, h))
            d_again[t, :, : 2 * h] = d_gates[t, :, : 2 * h]
            np.multiply(d_state, by_carried[t], out=d_again[t, :, 2 * h :])
            d_next = (d_state * update[t] + d_again[t] @ back) * kept[t]
        before = before.reshape(-1, h)
        rows = d_gates.reshape(-1, 3 * h)
        g["again"], g["again_bias"] = before.T @ d_again.reshape(-1, 3 * h), d_again[:, :, 2 * h :].sum((0, 1))
        g["into"], g["bias"] = given.reshape(-1, given.shape[2]).T @ rows, rows.sum(0)
        d_given = rows @ p["into"].T
        order = np.argsort(inputs.ravel(), kind="stable")
        ids = inputs.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["embed"] = (ids[first], np.add.reduceat(d_given[order], first))
        return g, loss, states[-1]


# ---------------------------------------------------------------- training and scoring


def lanes(texts: list[np.ndarray], count: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end on lanes of near equal length: inputs, targets, which places count, where a text begins."""
    import heapq

    heap = [(0, k) for k in range(count)]
    dealt = [[] for _ in range(count)]
    for text in sorted(texts, key=len, reverse=True):
        size, k = heapq.heappop(heap)
        dealt[k].append(text)
        heapq.heappush(heap, (size + len(text), k))
    steps = max(size for size, _ in heap)
    inputs, targets = np.full((steps, count), start, np.int64), np.zeros((steps, count), np.int64)
    counted, fresh = np.zeros((steps, count), bool), np.zeros((steps, count), bool)
    shuffle = np.random.default_rng(2)
    for k, own in enumerate(dealt):
        at = 0
        for j in shuffle.permutation(len(own)):
            text = own[j]
            inputs[at + 1 : at + len(text), k] = text[:-1]
            targets[at : at + len(text), k] = text
            counted[at : at + len(text), k] = True
            fresh[at, k] = True
            at += len(text)
    return inputs, targets, counted, fresh


class Learner:
    """Steps of gradient descent, each number scaled by its past gradients."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate = network, rate
        self.past = {name: np.full(v.shape, 1e-8, v.dtype) for name, v in network.p.items()}

    def learn(self, texts: list[np.ndarray]) -> int:
        """One pass over the texts by windows of truncated backpropagation."""
        net = self.network
        inputs, targets, counted, fresh = lanes(texts, min(LANES, len(texts)), net.kept + 1)
        state = np.zeros((inputs.shape[1], net.hidden), net.dtype)
        for t in range(0, len(inputs), WINDOW):
            part = slice(t, t + WINDOW)
            if counted[part].any():
                g, _, state = net.gradients(inputs[part], targets[part], counted[part], state, fresh[part])
                self.step(g)
        return int(counted.sum())

    def step(self, gradients: dict) -> None:
        for name, g in gradients.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            past = self.past[name]
            past[at] += g * g
            self.network.p[name][at] -= self.rate * g / np.sqrt(past[at])


def gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches put together until they hold enough words, with their texts as numbers."""
    held, texts, size = [], [], 0
    for batch in batches:
        own = [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size >= TOGETHER:
            yield held, texts
            held, texts, size = [], [], 0
    if texts:
        yield held, texts


def _averaged(parts: DataFrame) -> DataFrame:
    """Mean of the slices of a group, weighted by the words behind them."""

    def mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        weights = table["words"].to_numpy().astype(np.float64)
        total = sum(w * np.frombuffer(v.as_py(), "<f4").astype(np.float64) for w, v in zip(weights, table["numbers"].combine_chunks()))
        return pa.table({
            "team": pa.array([key[1].as_py() // GROUPED], pa.int64()), "task": pa.array([key[1].as_py()], pa.int64()), "slice": pa.array([key[0].as_py()], pa.int32()),
            "words": pa.array([int(weights.sum())], pa.int64()), "numbers": pa.array([(total / weights.sum()).astype("<f4").tobytes()], pa.binary())})

    return parts.groupBy("slice", "team").applyInArrow(mean, parts.schema)


def train(known: DataFrame, network: Network, rounds: int, rate: float) -> Network:
    """Train on every document of ``known(turn, held_out, ids)`` that is not held out, once, in ``rounds`` rounds.

    In a round every task learns from its own documents of that turn, beginning with the common
    parameters; the results are averaged by words learned, in two levels, so no task sees more
    than a bounded number of them. The driver keeps the parameters only, whose size does not depend on the data.
    """
    schema = StructType.fromDDL("team long, task long, slice int, words long, numbers binary")
    for turn in range(rounds):
        flat = network.flat()

        def run(batches: Iterator[pa.RecordBatch], flat=flat, rate=rate / (1 + turn)) -> Iterator[pa.RecordBatch]:
            task, words = TaskContext.get().partitionId(), 0
            network.load(flat)
            learner = Learner(network, rate)
            for _, texts in gathered(batches, "ids"):
                words += learner.learn(texts)
            if words:
                made = network.flat()
                cuts = range(0, len(made), SLICE)
                yield pa.RecordBatch.from_pydict({
                    "team": pa.array([task // GROUPED] * len(cuts), pa.int64()), "task": pa.array([task] * len(cuts), pa.int64()),
                    "slice": pa.array(range(len(cuts)), pa.int32()), "words": pa.array([words] * len(cuts), pa.int64()),
                    "numbers": pa.array([made[at : at + SLICE].astype("<f4").tobytes() for at in cuts], pa.binary())})

        parts = known.where((F.col("turn") == turn) & ~F.col("held_out")).select("ids").mapInArrow(run, schema)
        teams = _averaged(parts)
        whole = _averaged(teams.withColumn("task", F.col("team")).withColumn("team", F.lit(0).cast("long")))
        mean = whole.select("slice", "numbers").orderBy("slice").collect()
        if mean:
            network.load(np.frombuffer(b"".join(r["numbers"] for r in mean), "<f4"))
    return network


def text_scores(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of whole texts; states are carried from window to window until a text ends."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes, total = np.array([len(texts[k]) for k in order]), np.zeros(len(texts))
    # Texts end to end, longest first, and then room to read on behind the last.
    flat = np.concatenate([*(texts[k] for k in order), np.zeros(WINDOW, np.int64)])
    starts = np.cumsum(sizes) - sizes
    for first in range(0, len(order), TEXTS):
        group, size, start = order[first : first + TEXTS], sizes[first : first + TEXTS], starts[first : first + TEXTS]
        state, before = np.zeros((len(group), network.hidden), network.dtype), np.full(len(group), network.kept + 1)
        for t in range(0, int(size[0]), WINDOW):
            live = int((size > t).sum())
            steps = np.arange(t, min(t + WINDOW, int(size[0])))[:, None]
            counted = np.flatnonzero((steps < size[:live]).ravel())
            targets = flat[np.minimum(start[:live] + steps, len(flat) - 1)]
            states, _ = network.forward(np.concatenate([before[None, :live], targets[:-1]]), state[:live])
            state, before = states[-1], targets[-1]
            scores = network.log_probability(states.reshape(-1, network.hidden)[counted], targets.ravel()[counted])
            total[group[:live]] += np.bincount(counted % live, weights=scores, minlength=live)
    return total


def score_documents(docs: DataFrame, kept: int = 2048, rounds: int = 4, rate: float = 0.05) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)`` by a recurrent model learned from the documents not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed frequencies) and
    score, both log10 probabilities of the whole text, its end included. The model tells the ``kept`` most frequent words apart;
    any other word has the probability of being outside, times its smoothed share of the words
    outside, so probabilities add up to one over all words and one unknown. Every document that is not held out is
    learned from once. A null text is empty and so the end alone; a null doc_id is held out; repeated ids are
    rows like any other; more columns are left out. Without a document to learn from, every score is that of the one unknown word.
    """
    spark = docs.sparkSession
    known, counts = counted_documents(docs, kept)
    known = stored(known.withColumn("turn", F.pmod(F.xxhash64("doc_id", "n_tokens", "base_score"), F.lit(rounds)).cast("int")))
    network = train(known, Network(counts, kept), rounds, rate)
    shared = spark.sparkContext.broadcast(network.flat())
    ln10, total = np.log(10), counts.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network.load(shared.value)
        for held, texts in gathered(batches, "ids"):
            table = pa.Table.from_batches(held)
            scores = text_scores(network, texts) / ln10 + table["rest_score"].to_numpy() if total else np.zeros(len(texts))
            made = table.drop_columns(["ids", "rest_score"])
            made = made.append_column("train_tokens", pa.array(np.full(len(texts), total), pa.int64())).append_column("score", pa.array(scores, pa.float64()))
            yield from made.combine_chunks().to_batches()

    schema = StructType.fromDDL(
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")
    scored = known.drop("turn").mapInArrow(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
