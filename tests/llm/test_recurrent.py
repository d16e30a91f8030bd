"""The recurrent language model: gradients, probabilities, plain recounts, and held-out accuracy."""

import collections
import math
import zlib

import numpy as np
import pytest

from docweave.llm import recurrent
from docweave.llm.queries import QUERIES
from docweave.llm.recurrent import Counts, Network

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def network(kept=10, counts=(9, 7, 5, 4, 3, 2, 2), dtype=np.float64):
    return Network(Counts(sum(counts) + 6, len(counts) + 4, np.array(counts)), kept, hidden=5, embedded=3, width=4, dtype=dtype)


def plain_score(net, text):
    """One step at a time, straight from the definition."""
    p, h = net.p, net.hidden
    state, before, total = np.zeros(h), net.kept + 1, 0.0
    for word in text:
        gates, again = p["embed"][before] @ p["into"] + p["bias"], state @ p["again"]
        update = 1 / (1 + np.exp(-(gates[:h] + again[:h])))
        reset = 1 / (1 + np.exp(-(gates[h : 2 * h] + again[h : 2 * h])))
        new = np.tanh(gates[2 * h :] + reset * (again[2 * h :] + p["again_bias"]))
        state = (1 - update) * new + update * state
        own = net.classes if word == net.kept else word // net.width
        logits = state @ p["class"] + p["class_bias"]
        total += logits[own] - np.log(np.exp(logits).sum())
        if own < net.classes:
            logits = (state @ p["word"][own] + p["word_bias"][own])[~net.absent[own]]
            place = (~net.absent[own])[: word - own * net.width].sum()
            total += logits[place] - np.log(np.exp(logits).sum())
        before = word
    return total


def test_scores_equal_single_steps_and_carry_state():
    net, draw = network(), np.random.default_rng(5)
    texts = [draw.choice([0, 1, 2, 3, 4, 5, 6, 10], n) for n in (1, 3, 40, 17, 2, 100)]
    assert recurrent.text_scores(net, texts) == pytest.approx([plain_score(net, t) for t in texts])


def test_probabilities_add_up_to_one():
    net = network()
    words = [*range(7), net.kept]
    for history in ([], [2], [1, 10, 4, 0]):
        shares = [math.exp(plain_score(net, [*history, w]) - plain_score(net, history)) for w in words]
        assert sum(shares) == pytest.approx(1)


def test_untrained_network_begins_near_the_word_shares():
    counts = Counts(34, 9, np.array([9, 7, 5, 4, 3, 2, 2]))
    net = Network(counts, 10, width=4, dtype=np.float64)
    for name in ("class", "word"):
        net.p[name][:] = 0
    shares = (np.r_[counts.kept + 0.1, counts.rest]) / (34 + 0.1 * 10)
    assert [math.exp(s) for s in recurrent.text_scores(net, [np.array([w]) for w in [*range(7), 10]])] == pytest.approx(shares)


def test_gradients_equal_differences():
    net, draw = network(), np.random.default_rng(3)
    steps, count = 6, 3
    targets = draw.choice([0, 1, 2, 4, 5, 6, 10], (steps, count))
    fresh = np.zeros((steps, count), bool)
    fresh[0, :2], fresh[3, 1] = True, True
    inputs = np.where(fresh, net.kept + 1, np.vstack([targets[:1], targets[:-1]]))
    counted = np.ones((steps, count), bool)
    counted[4:, 2] = False
    state = draw.normal(size=(count, net.hidden))

    def loss():
        return net.gradients(inputs, targets, counted, state, fresh)[1] / counted.sum()

    gradients = net.gradients(inputs, targets, counted, state, fresh)[0]
    for name, value in net.p.items():
        g = gradients[name]
        if isinstance(g, tuple):
            full = np.zeros_like(value)
            full[g[0]] = g[1]
            g = full
        for at in draw.choice(value.size, min(value.size, 12), replace=False):
            place, step = np.unravel_index(at, value.shape), 1e-5
            if name == "word_bias" and net.absent[place]:
                continue
            old = value[place]
            value[place] = old + step
            up = loss()
            value[place] = old - step
            down = loss()
            value[place] = old
            assert g[place] == pytest.approx((up - down) / (2 * step), abs=1e-6), name


def test_lanes_hold_every_text_once():
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 9, n) for n in (1, 5, 30, 2, 2, 7)]
    inputs, targets, counted, fresh = recurrent.lanes(texts, 3, 99)
    found = []
    for k in range(3):
        begins = [*np.flatnonzero(fresh[:, k]), counted[:, k].sum()]
        for a, b in zip(begins, begins[1:]):
            found.append(targets[a:b, k].tolist())
            assert inputs[a:b, k].tolist() == [99, *targets[a : b - 1, k]]
    assert sorted(found) == sorted(t.tolist() for t in texts)


EDGES = [
    (0, "The cat SAT on the mat.\n\tThe end"), (1, None), (2, ""), (3, "  \n "), (None, "no id at all"), (4, "The cat SAT on the mat.\n\tThe end"),
    (4, "other text, same id"), (5, "Ünï Ä b"), (7, "word " * 5000), (9, "w" * 100_000), *[(k, f"filler number {k % 7} the cat") for k in range(20, 60)],
]


def recount(docs):
    """Tokens, counts and base score by plain Python."""
    def words(text):
        kept = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            kept = kept.replace(c, " ")
        return [*filter(None, kept.split(" ")), None]

    def out(doc):
        return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0

    seen = collections.Counter(w for doc, text in docs if not out(doc) for w in words(text))
    total, distinct = sum(seen.values()), len(seen)
    return [
        (doc, out(doc), len(words(text)), sum(seen[w] > 0 for w in words(text)), total,
         pytest.approx(sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(text))))
        for doc, text in docs]


@pytest.mark.parametrize("kept, block", [(64, 1 << 22), (4096, 50)])
def test_counts_equal_a_recount(spark, kept, block, monkeypatch):
    given = spark.createDataFrame(EDGES, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS block", "2 AS score", "3 AS words")
    blocks = recurrent.word_blocks
    monkeypatch.setattr(recurrent, "word_blocks", lambda docs: blocks(docs, block))
    rows = recurrent.score_documents(given, kept=kept, rounds=2).select(COLUMNS).collect()
    key = lambda r: (repr(r[0]), r[2])
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(recount(EDGES), key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    equal = [r.score for r in rows if r.doc_id in (0, 4) and r.n_tokens == 9]
    assert len(equal) == 2 and equal[0] == pytest.approx(equal[1], rel=1e-4)


def test_nothing_to_learn_from(spark):
    assert recurrent.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = recurrent.score_documents(spark.createDataFrame([(None, "some words")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(None, True, 3, 0, 0, pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))]


def test_model_beats_word_shares_on_held_out_documents(spark):
    rows = [r for r in QUERIES["op13_lm_scoring"](spark, SMALL).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    base, score = sum(r.base_score for r in rows) / tokens, sum(r.score for r in rows) / tokens
    assert len(rows) > 50 and score > base + 0.1
