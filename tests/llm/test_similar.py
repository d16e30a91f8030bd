"""Near-duplicate operators against brute force."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docweave.llm import lines, overlap, vectors
from docweave.llm.common import components
from docweave.session import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closure(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    words = WORD.findall(lower(text))
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def altered(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return words


def near_texts(seed, families=12, size=7):
    rnd = random.Random(seed)
    texts = []
    for k in range(families):
        base = [rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(rnd.choice([4, 9, 13, 25, 60, 140, 400]))]
        texts += [" ".join(altered(rnd, base, rnd.randint(0, max(1, len(base) // 25)))) for _ in range(size)]
        texts.append(" ".join([*base[: len(base) // 2], *(f"y{k}{n}" for n in range(len(base) // 2))]))
    return [None, "", "  \n", "one", "One", "one two", "ONE two", "one two three", *texts, *texts[:5], "long " * 3000, "long " * 3001]


def check_groups(spark, texts, percent, width, block, listed=overlap.LISTED):
    docs = spark.createDataFrame([(k, t, "k", k) for k, t in enumerate(texts)], "doc_id long, text string, key string, node long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in overlap.jaccard_groups(docs, percent, width, block, listed).collect()}
    sets = [shingles(t, width) for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = closure(range(len(texts)), links)
    assert got == {k: (len(sets[k]), label[k]) for k in range(len(texts))}


def test_jaccard_groups_equal_brute_force(spark):
    check_groups(spark, near_texts(1), 90, 3, 256)


def test_jaccard_groups_in_small_blocks_and_at_a_lower_bound(spark):
    check_groups(spark, near_texts(2, 6, 14), 80, 5, 4)


def test_blocks_of_many_candidates_are_searched_with_their_sets(spark):
    check_groups(spark, near_texts(3, 6, 14), 80, 3, 16, listed=0)


def test_parity_sketches_never_part_similar_sets():
    rnd = np.random.default_rng(5)
    similar = overlap.Similar(80)
    for n in (3, 40, 700, 5000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        b = np.unique(np.r_[a[n // 10 :], rnd.integers(0, 2**63, n // 10, dtype=np.int64).view(np.uint64)])
        apart = int(np.bitwise_count(overlap.parity_of(a) ^ overlap.parity_of(b)).sum())
        assert apart <= len(np.setxor1d(a, b)) and similar(a, b) and similar.near(apart, len(a) + len(b))


def test_cells_are_shared_by_all_similar_sets():
    rnd = random.Random(4)
    for percent in (90, 80):
        cells, similar = overlap.Cells(percent), overlap.Similar(percent)
        for _ in range(1500):
            n = rnd.choice([3, 8, 10, 12, 19, 20, 40, 150, 700])
            a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
            drop = rnd.randint(0, n // 8 + 1)
            b = np.unique(np.concatenate([a[drop:], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, drop))], np.uint64)]))
            if similar(a, b) and len(a) and not np.array_equal(a, b):
                assert np.intersect1d(cells.of(a), cells.of(b)).size


def test_sets_at_a_low_bound_have_few_cells_and_meet_in_a_band():
    rnd = np.random.default_rng(9)
    cells, similar = overlap.Cells(80), overlap.Similar(80)
    for n in (5, 9, 40, 149, 150, 480, 2000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
        for b in (a[n // 6 :], np.r_[a, a[: n // 5] ^ np.uint64(1)], a[n // 10 :]):
            assert len(cells.of(b)) <= len(b) // 5 + 1
            if similar(a, b):
                assert set(cells.bands(a)) & set(cells.bands(b))


def test_sketches_tell_large_unlike_sets_apart():
    rnd = np.random.default_rng(7)
    similar = overlap.Similar(80)
    for n, m in ((3000, 3000), (4000, 4300), (20000, 17000)):
        a, b = (np.unique(rnd.integers(0, 2**63, k, dtype=np.int64)).view(np.uint64) for k in (n, m))
        like = np.r_[a[n // 20 :], b[: n // 20]]
        sketches = [overlap.parity_of(x) for x in (a, b, like, a[:-150])]
        assert not similar.near(overlap.apart_of(sketches[:1], sketches[1:2]), np.array([len(a) + len(b)]))[0]
        for k, other in ((2, like), (3, a[:-150])):
            assert similar.near(overlap.apart_of(sketches[:1], sketches[k : k + 1]), np.array([len(a) + len(other)]))[0]


def test_tables_of_the_steps_are_deleted(spark):
    def tables():
        return {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("table-")}

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(near_texts(6, 4, 5))], "doc_id long, text string")
    before = tables()
    found = overlap.jaccard_groups(docs, 80, 5)
    # The result itself, and the last edges of the two times that components are looked for.
    assert found.count() and len(tables() - before) <= 3

    before = tables()
    found = lines.dedup_lines(spark.createDataFrame(list(enumerate(line_texts(3))), "doc_id long, text string"))
    assert found.count() and len(tables() - before) == 1


def test_tree_finds_all_that_may_be_similar():
    rnd = np.random.default_rng(5)
    base = rnd.poisson(3, (20, overlap.DIMENSIONS))
    points = np.maximum(0, base[rnd.integers(0, 20, 300)] + rnd.integers(-1, 2, (300, overlap.DIMENSIONS))).astype(np.int32)
    sizes, similar = points.sum(1), overlap.Similar(90)
    tree = overlap.RTree(points, sizes)
    for q in range(0, 300, 7):
        want = {p for p in range(300) if similar.may(int(np.minimum(points[p], points[q]).sum()), int(sizes[p] + sizes[q]))}
        assert set(tree.search(points[q], int(sizes[q]), similar).tolist()) == want


def brute_lines(rows, percent=80, least=5):
    seen, removed = [], set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n")):
            words = WORD.findall(lower(line))
            if len(words) < least:
                continue
            own = set(words)
            if any(100 * len(own & s) >= percent * len(own | s) for s in seen):
                removed.add((doc, n))
            seen.append(own)
    return removed


def line_texts(seed):
    rnd = random.Random(seed)
    bases = [[rnd.choice("pqrstuv") + str(rnd.randrange(60)) for _ in range(rnd.choice([5, 6, 9, 14, 30, 90]))] for _ in range(14)]
    texts = [None, "", "\n\n", "too short here", "a b c d e\nA B C D E\ne d c b a a"]
    for _ in range(45):
        chosen = [altered(rnd, rnd.choice(bases), rnd.randint(0, 5)) for _ in range(rnd.randint(1, 5))]
        texts.append("\n".join(" ".join(c) for c in chosen))
    return [*texts, texts[7], "w " * 4000 + "\n" + "z " * 4000]


def test_line_dedup_equals_brute_force(spark):
    for block in (2000, 3):
        rows = list(enumerate(line_texts(block)))
        docs = spark.createDataFrame([(k, t, k, "s") for k, t in rows], "doc_id long, text string, line long, size string").repartition(3)
        got = {r.doc_id: r for r in lines.dedup_lines(docs, block=block).collect()}
        removed = brute_lines(rows)
        for k, text in rows:
            found = None if text is None else text.split("\n")
            want = None if found is None else "\n".join(x for n, x in enumerate(found) if (k, n) not in removed)
            assert got[k].text == want and got[k].n_lines == len(found or [])
            assert got[k].n_removed == sum(1 for d, _ in removed if d == k) and got[k].size == "s"


def test_short_lines_are_removed_too(spark):
    rnd = random.Random(8)
    short = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    rows = [(k, "\n".join(rnd.choice([*short, "", " \t", "她在河边的老磨坊前休息。", "Read more", "read  MORE"]) for _ in range(rnd.randint(1, 8)))) for k in range(60)]
    rows += [(60, "k l m n"), (61, "k l m n o"), (62, "l m n o"), (63, "q r s"), (64, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    removed = brute_lines(rows, least=1)
    assert (61, 0) in removed and (62, 0) in removed and (64, 0) not in removed
    for block in (2000, 3):
        for row in lines.dedup_lines(docs, block=block).collect():
            found = rows[row.doc_id][1].split("\n")
            assert row.text == "\n".join(x for n, x in enumerate(found) if (row.doc_id, n) not in removed)


def test_lines_without_a_doc_id_come_last(spark):
    line, near, alone = "a b c d e f g h i j", "a b c d e f g h i k", "l m n o p q"
    rows = [(None, f"{line}\n{alone}"), (1, line), (2, near), (3, f"x y z\n{line}"), (None, f"{near}\nr s"), (None, f"{alone}\nr s"), (None, None), (None, "r s\nx y z")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long").repartition(3)
    for block in (2000, 2):
        got = {r.row: r for r in lines.dedup_lines(docs, block=block).collect()}
        assert [got[k].text for k in (1, 2, 3, 6)] == [line, "", "x y z", None]
        left = [x for k in (0, 4, 5, 7) for x in got[k].text.split("\n") if x]
        assert sorted(left) == [alone, "r s"]
        assert sum(got[k].n_removed for k in (0, 4, 5, 7)) == 6 and got[6].n_removed == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.jaccard_groups(docs).collect() == []
    assert lines.dedup_lines(docs).collect() == []
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_rows_do_not_fail(spark):
    rows = [(1, "a b c d e f g\nh i j k l m n"), (1, "a b c d e f g\nh i j k l m n"), (None, "a b c d e f g"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(overlap.jaccard_groups(docs).collect()) == 4
    assert len(lines.dedup_lines(docs).collect()) == 4


def test_vectors_equal_brute_force(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for _ in range(9):
        base = rnd.normal(size=40)
        rows += [(base + rnd.normal(size=40) * s).tolist() for s in (0.05, 0.15, 0.2, 0.25, 0.3, 0.33)]
    rows += [rnd.normal(size=40).tolist() for _ in range(150)]
    rows += [rows[0], rows[0], [x * 1e300 for x in rows[1]], [0.0] * 40, None, [], [float("nan")] * 40, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    frame = spark.createDataFrame([(k, v, k) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, weight long").repartition(4)
    good = [v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for v in rows]
    links = []
    for b, y in enumerate(good):
        for a in range(b):
            x = good[a]
            if x is not None and y is not None and len(x) == len(y):
                u, w = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.95:
                    links.append((a, b))
    label = closure(range(len(rows)), links)
    want = {k: (sum(k in p for p in links), label[k], label[k] == k) for k in range(len(rows))}
    for tile in (4096, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame, tile=tile).collect()}
        assert got == want


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (95, 90), (7, 7), (None, 3)]
    nodes = spark.createDataFrame([(n,) for n in [*range(41), 90, 95, 100, 500]], "node long")
    got = dict(components(nodes, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, 500: 500}
    assert components(nodes, spark.createDataFrame([], "a long, b long")).where(F.col("node") != F.col("component")).count() == 0


def test_unlike_texts_of_one_doc_id_lose_only_their_own_lines(spark):
    rows = [
        (1, "a line that all of them have in common"), (2, "a line that all of them have in common\nprecious words of this one"),
        (2, "precious line nobody else has at all\na line that all of them have in common"), (2, None),
        (None, "one more without an id\na line that all of them have in common"), (None, "a line that all of them have in common\nlast of all")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    expected = [
        (1, "a line that all of them have in common"), (2, "precious words of this one"), (2, "precious line nobody else has at all"), (2, None),
        (None, "one more without an id"), (None, "last of all")]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
