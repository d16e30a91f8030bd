"""The prefix trie against a plain dictionary of prefixes and against its SQL."""

import hashlib
import random
import re
import zlib

import pytest

from docweave.llm import trie
from docweave.llm.queries import ORACLES, QUERIES
from docweave.session import stored
from workload.check import canonical, oracle_rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """Conversations as tuples of turns, with the opening of the first of their family."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    return out


def brute(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in members if q[:-1] == p and q] for p in members}
    rows = []

    def totals(p):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * words
        for q in children[p]:
            more = totals(q)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(conversations[c]) == len(p))))
        rows.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        totals(())
    return sorted(rows, key=repr)


def random_rows(seed, n):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = rnd.choice([*range(60), 400, 405, None])
        depth = rnd.choice([1, 2, 3, 9])
        said = [(rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b c", "", None, " x\ty  z "])) for _ in range(depth)]
        rows += [(conv, rnd.choice([k, k, None]), role, text) for k, (role, text) in enumerate(said)]
    return rows


CASES = {
    "random": random_rows(1, 80),
    "chain": [(c, t, "user", f"t{t}") for c in range(0, 400, 20) for t in range(1 + c // 20)],
    "copies": [(c, t, "user", f"same {t}") for c in range(200) for t in range(6)],
    "one long": [(20, t, "user", f"t {t}") for t in range(700)] + [(40, t, "user", f"t {t}" if t < 650 else "other") for t in range(700)],
    "no turns left": [(c, 0, "user", "only") for c in (1, 2, 3, 5, 21, 22, 25, 27)],
    "repeated rows": [(7, 1, "user", "x")] * 5 + [(8, 1, "user", "x")] * 3 + [(None, 1, "user", "x")],
    "nothing": [], "nulls": [(None, None, None, None), (3, None, None, None), (3, None, None, None)],
}


@pytest.mark.parametrize("name", CASES)
def test_trie_equals_a_dictionary_of_prefixes(spark, name):
    rows = CASES[name]
    given = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS n", "'x' AS node")
    found = sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(given)).select(COLUMNS).collect()), key=repr)
    assert found == brute(rebuild(rows))


def test_search_finds_where_each_sequence_leaves_the_trie(spark):
    rnd = random.Random(7)
    texts = [tuple(rnd.choice("ab") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    rows = [(c, d + 1, "user", t) for c, text in enumerate(texts) for d, t in enumerate(text)]
    own = trie.paths(spark.createDataFrame(rows, "conv_id long, depth long, role string, text string"))
    own = stored(own.selectExpr("conv_id", "cast(size(path) as long) n", "element_at(path, -1) last", "path"))
    known = {texts[c] for c in range(0, 60, 2)}
    sequences = own.where("conv_id % 2 = 0").selectExpr("n", "last", "path").dropDuplicates(["n", "last"])
    nodes = trie.compacted(sequences)
    # A node stands where members part or one ends, and nowhere else.
    prefixes = {t[:d] for t in known for d in range(len(t) + 1)}
    stands = [p for p in prefixes if p and (p in known or sum(p + (c,) in prefixes for c in "ab") > 1)]
    assert nodes.count() == len(stands)
    for row in trie.locate(own, nodes, 13).collect():
        text = texts[row.conv_id]
        shared = max(d for d in range(len(text) + 1) if text[:d] in prefixes)
        assert row.shared == shared
        if shared:
            assert row.node.low < shared <= row.node.high


def test_two_fattest_number(spark):
    pairs = [(low, high) for low in range(0, 40) for high in range(low + 1, 42)]
    for row in spark.createDataFrame(pairs, "low long, high long").withColumn("f", trie.fattest("low", "high")).collect():
        assert row.f == max(range(row.low + 1, row.high + 1), key=lambda n: n & -n)


def test_a_node_of_many_ids_is_digested_in_parts(spark):
    ends = spark.range(3000).selectExpr("struct(cast(0 as long) depth, cast(0 as long) a, cast(0 as long) b) node", "id * 7 % 3000 AS conv_id")
    expected = hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert [r.ends_sha256 for r in trie.end_digests(ends).collect()] == [expected]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    df = QUERIES["op11_prefix_trie"](spark, f"/root/testdata/{sf}")
    columns, rows = oracle_rows(f"/root/testdata/{sf}", ORACLES["op11_prefix_trie"])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([c for c, _ in columns], rows)
