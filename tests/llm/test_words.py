"""Hashes of words by arrays, sketches of lines, and the filter that keeps texts in place."""

import random

import numpy as np

from docweave.llm import lines, overlap
from docweave.llm.common import asked
from docweave.llm.words import word_hashes


def test_hashes_are_those_of_words_and_lines():
    rnd = random.Random(3)
    texts = [None, "", " ", "\n", "A\tb\x0bc\rd\x0ce", "x\x1fy\x00 x\x1fy", "a a\x00 a\x00\x00", "Ä ä ä", *("q" * n for n in (7, 8, 9, 15, 16, 17, 40))]
    texts += ["".join(rnd.choice("abAB \n\té字") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    hashes, line, first = word_hashes(texts)
    known, at = {}, 0
    for k, text in enumerate(texts):
        for n, part in enumerate((text or "").encode().lower().split(b"\n")):
            for word in part.split():
                assert line[at] == first[k] + n and known.setdefault(word, hashes[at]) == hashes[at]
                at += 1
    assert at == len(hashes) and len(set(known.values())) == len(known)
    assert all(len(x) == 0 for x in word_hashes([]))


def test_shingles_of_a_batch_are_those_of_each_text():
    texts = [None, "a", "a b", "a b c", "a b c d", " \n", "a b c d", "b c a b c a b"]
    for width in (1, 3, 5):
        sets = overlap.shingle_sets(texts, width)
        assert [s.tolist() for s in sets] == [overlap.shingle_sets([t], width)[0].tolist() for t in texts]
        assert all((s[1:] > s[:-1]).all() for s in sets)
    assert [len(s) for s in overlap.shingle_sets(texts, 3)] == [0, 1, 1, 1, 2, 0, 2, 3]


def test_sketches_of_any_two_sizes_never_part_similar_sets():
    rnd = np.random.default_rng(2)
    for n in (5, 60, 64, 65, 70, 126, 128, 129, 140, 400):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.r_[a[n // 9 :], rnd.integers(0, 2**63, n // 6).astype(np.uint64)]
        sketch = lines.sketches(np.r_[a, b], np.array([len(a), len(b)]))
        apart = lines.bits_apart(sketch[:1], sketch[1:], np.array([min(len(a), len(b))]))
        assert apart[0] <= len(np.setxor1d(a, b))


def test_sets_are_ordered_alike_where_hashes_begin_alike():
    hashes = np.array([7, 5, 6, 5, 1 << 63, 5, 7, 6], np.uint64)
    tokens, _, sizes = lines.ordered_sets(hashes, np.array([5, 3]), np.ones(1 << lines.BUCKET_BITS, np.int64))
    assert tokens.tolist() == [5, 6, 7, 1 << 63, 5, 6, 7] and sizes.tolist() == [4, 3]


def test_all_that_is_wanted_is_asked_for_and_little_else(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "IF(id % 2 = 0, NULL, id) own")
    wanted = rows.where("doc_id % 40 < 2")
    found = asked(rows, wanted, ["doc_id", "own"])
    assert found.count() == 4000 and found.columns == ["doc_id", "own", "_asked"]
    assert found.where("doc_id % 40 < 2 AND NOT _asked").count() == 0 and found.where("_asked").count() < 600
    assert asked(rows, wanted.limit(0), ["doc_id"]).where("_asked").count() == 0


def test_texts_without_removed_lines_are_not_shuffled(spark):
    docs = spark.createDataFrame([(k, f"w{k} x{k} y{k} z{k} v{k}" if k else "w1 x1 y1 z1 v1") for k in range(40)], "doc_id long, text string")
    found = lines.dedup_lines(docs)
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.text) for r in found.where("n_removed > 0").collect()] == [(1, "")]


def test_lines_of_many_words_are_compared(spark):
    base = [f"w{k}" for k in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:2800], "a", "b"])), (3, " ".join(base[:2000])), (4, " ".join(base[:100])), (5, " ".join([*base[:95], "c"]))]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
