import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions.text import tokens
from docweave.operators import search

WORDS = "order Orders reorder wörld a b the customer list #tag".split()


def make_docs(spark, n=60, seed=1):
    rnd = random.Random(seed)

    def text(k):
        return " ".join(rnd.choice(WORDS) for _ in range(k))

    rows = [(i, text(3), [rnd.choice(WORDS), rnd.choice(WORDS)], None if i % 9 == 0 else text(30)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, title STRING, tags ARRAY<STRING>, content STRING")


def brute(rows, query, k):
    found = []
    terms = re.findall(r"\w+", query.lower())
    for doc_id, title, tags, content in rows:
        t = sum(1 for w in terms if w in title.lower())
        g = sum(1 for w in terms if w in " ".join(tags).lower())
        c = sum((content or "").lower().count(w) for w in terms)
        total = 4 * t + 2 * g + c
        if total > 0:
            found.append((-total, doc_id, t, g, c))
    return [(d, t, g, c, -neg) for neg, d, t, g, c in sorted(found)[:k]]


def test_tokens_are_unicode_words(spark):
    row = spark.createDataFrame([("Hello, Wörld_1! x-y",)], "t STRING").select(tokens(F.col("t")).alias("w")).first()
    assert row.w == ["hello", "wörld_1", "x", "y"]


def test_top_k_equals_brute_force(spark):
    rows, docs = make_docs(spark)
    for query in ("order THE a", "wörld wörld", "zzz", "  "):
        got = [tuple(r[c] for c in ("doc_id", "title_score", "tag_score", "content_score", "total"))
               for r in search.search_top_k(docs, query, 7).collect()]
        assert got == brute(rows, query, 7)


def test_batch_equals_brute_force(spark, monkeypatch):
    rows, docs = make_docs(spark, 80, 2)
    queries = {1: "order the", 2: "b ord der", 3: "customer list order order", 4: "none at all", 5: "ö"}
    table = spark.createDataFrame(list(queries.items()), "query_id BIGINT, text STRING")
    for bound in (200_000, 0):
        monkeypatch.setattr("docweave.functions.joins.BROADCAST_ROWS", bound)
        got = {}
        for r in search.search_batch(search.build_postings(docs), table, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.title_score, r.tag_score, r.content_score, r.total))
        assert got == {q: brute(rows, text, 6) for q, text in queries.items() if brute(rows, text, 6)}


CONTENTS = [
    "", "plain only", "intro\n\n# A\n\nbody a\n## B  \nbody b\n", "# One\ntext", "## \nnext line\ntail\n# Z\n", "#no heading\n####### seven\n# yes",
    "a\r\n# b\r\nc", "\n\n# only heading", "#\u3000wide\xa0\nbody\u2028x\n## y\x1c\n",
]


def sections_by_regex(content):
    found = list(re.finditer(r"^(#{1,6})\s+(.+?)\s*$", content, re.MULTILINE))
    if not found:
        return [("", 0, content.strip())]
    out = []
    if content[: found[0].start()].strip():
        out.append(("", 0, content[: found[0].start()].strip()))
    for i, m in enumerate(found):
        end = found[i + 1].start() if i + 1 < len(found) else len(content)
        out.append((m.group(2).strip(), len(m.group(1)), content[m.end():end].strip()))
    return out


def test_sections(spark):
    docs = spark.createDataFrame(list(enumerate(CONTENTS)), "doc_id BIGINT, content STRING")
    got = {}
    for r in search.split_sections(docs).orderBy("doc_id", "sec_ord").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.level, r.body))
    assert got == {i: sections_by_regex(c) for i, c in enumerate(CONTENTS)}


def greedy(content, query, budget):
    sections = sections_by_regex(content)
    if len([s for s in sections if s[0]]) <= 1:
        units = [p.strip() for p in re.split(r"\n\s*\n", content) if p.strip()]
        if not units:
            return content[:budget], 0
        scored_text = [u.lower() for u in units]
    else:
        units = [(f"{'#' * lv} {h}\n\n{b}" if h else b).rstrip() for h, lv, b in sections]
        scored_text = [(h + " " + b).lower() for h, _, b in sections]
    order = range(len(units))
    scores = [0] * len(units)
    if query:
        terms = re.findall(r"\w+", query.lower())
        scores = [sum(t.count(w) for w in terms) for t in scored_text]
        order = sorted(order, key=lambda i: (-scores[i], i))
    chosen, left = [], budget
    for i in order:
        if query and scores[i] == 0 and chosen:
            break
        if len(units[i]) + 2 > left and chosen:
            break
        chosen.append(i)
        left -= len(units[i]) + 2
    return "\n\n".join(units[i] for i in sorted(chosen)).strip(), len(units) - len(chosen)


def random_contents(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 8)):
            if rnd.random() < 0.35:
                parts.append("#" * rnd.randint(1, 3) + " " + rnd.choice(WORDS))
            parts.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 12))))
        out.append("\n\n".join(parts))
    return out


def test_passages_equal_the_greedy_loop(spark):
    contents = random_contents(300, 5)
    docs = spark.createDataFrame(list(enumerate(contents)), "doc_id BIGINT, content STRING")
    asked = docs.withColumn("query", F.lit("order the"))
    blank = {r.doc_id: (r.passage, r.omitted) for r in search.relevant_passages(docs.withColumn("query", F.lit("")), 120).collect()}
    assert blank == {i: greedy(c, None, 120) for i, c in enumerate(contents)}
    for budget in (40, 120, 2500):
        got = {r.doc_id: (r.passage, r.omitted) for r in search.relevant_passages(asked, budget).collect()}
        lead = {r.doc_id: (r.passage, r.omitted) for r in search.lead_passages(docs, budget).collect()}
        assert got == {i: greedy(c, "order the", budget) for i, c in enumerate(contents)}
        assert lead == {i: greedy(c, None, budget) for i, c in enumerate(contents)}


def test_substring_pairs_on_long_and_short_texts(spark, monkeypatch):
    from docweave.functions.joins import substring_pairs

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc") for _ in range(n)) for n in (0, 3, 60, 64, 65, 300, 511, 512, 513, 3000)] * 2
    needles = ["a", "abc", "cabca", "aaaaa", "zz", texts[9][250:262], texts[9][505:530], texts[5], texts[9] + "x", ""]
    left = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    right = spark.createDataFrame([(n,) for n in needles + ["abc"]], "n STRING")
    expected = sorted((i, n) for i, t in enumerate(texts) for n in set(needles) if n and n in t)
    for bound in (200_000, 3):
        monkeypatch.setattr("docweave.functions.needles.NEEDLE_ROWS", bound)
        got = sorted((r.id, r.needle) for r in substring_pairs(left, "t", right, "n").collect())
        assert got == expected


def test_containment_beyond_one_automaton_and_of_many_lengths(spark, monkeypatch):
    from docweave.functions import needles
    from docweave.functions.joins import substring_pairs

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab") for _ in range(n)) for n in (0, 1, 7, 250, 900)] + [None, "aß😀a", "aaaaaaa"]
    wanted = {texts[4][k : k + k // 2 + 1] for k in range(200)} | {"aa", "ß😀", "zzz", "aaa"}
    assert len({len(w) for w in wanted}) >= 100
    left = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts * 2)], "id INT, t STRING, _x INT")
    right = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(wanted))] + [("", -1), (None, -2)], "n STRING, number LONG")
    names = dict(enumerate(sorted(wanted)))
    pairs = sorted((i, w) for i, t in enumerate(texts * 2) for w in wanted if t and w in t)
    for bound in (200_000, 30, 1):
        monkeypatch.setattr(needles, "NEEDLE_ROWS", bound)
        assert sorted((r.id, r.needle) for r in substring_pairs(left, "t", right, "n").collect()) == pairs
        found = needles.find_needles(left, "t", right, "n", "number")
        assert found.columns == ["id", "t", "_x", "found"]
        counts = sorted((r.id, names[f.key], f.times) for r in found.collect() for f in r.found)
        assert counts == sorted((i, w, (texts * 2)[i].count(w)) for i, w in pairs)


@pytest.mark.parametrize("shard, part, block, words", [(10, 1, 1, 200_000), (7, 2, 3, 2), (2_000_000, 1_000_000, 64, 200_000)])
def test_batch_by_shards_and_blocks(spark, monkeypatch, shard, part, block, words):
    rnd = random.Random(block)
    monkeypatch.setattr(search, "SHARD_POSTINGS", shard * 100)
    monkeypatch.setattr(search, "PART_TERMS", part)
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr("docweave.functions.needles.NEEDLE_ROWS", words)
    rows, docs = make_docs(spark, 150, 9)
    queries = {f"q{k}": " ".join(rnd.choice([*WORDS, "ord", "e", "zzz"]) for _ in range(rnd.randrange(5))) for k in range(8)}
    table = spark.createDataFrame([*queries.items(), ("none", None)], "query_id STRING, text STRING")
    got = {}
    for r in search.search_batch(search.build_postings(docs), table, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.title_score, r.tag_score, r.content_score, r.total))
    assert got == {q: brute(rows, text, 4) for q, text in queries.items() if brute(rows, text, 4)}


def test_no_row_per_query_and_document_leaves_a_task(spark):
    rows, docs = make_docs(spark, 400, 4)
    table = spark.createDataFrame([(k, "a b order customer") for k in range(50)], "query_id BIGINT, text STRING")
    found = search.search_batch(search.build_postings(docs), table, 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Only the merge is keyed by query, and it stands above the shards, which give k rows per query each.
    lines = plan.splitlines()
    merge = [k for k, line in enumerate(lines) if "hashpartitioning(query_id" in line]
    shards = [k for k, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line]
    assert merge and shards and merge[0] < shards[0] and not any("query_id" in line and "Join" in line for line in lines[shards[0]:] if "token" not in line)


def test_a_shard_gives_its_best_only(spark):
    import pyarrow as pa

    found = [[{"key": 5, "times": 1}]] * 200
    rows = pa.table({
        "doc_id": pa.array(range(200)), "tf": pa.array([1 + d % 17 for d in range(200)]), "in_title": pa.array([0] * 200, pa.int32()), "in_tags": pa.array([0] * 200, pa.int32()),
        "found": pa.array(found, pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int32())])))})
    terms = pa.table({"query_id": pa.array([1, 2, 3]), "token_id": pa.array([5, 5, 6]), "times": pa.array([1, 2, 1])})
    best = search._shard_best(rows, terms, 4).to_pylist()
    expected = sorted(range(200), key=lambda d: (-(d % 17), d))[:4]
    assert [(r["query_id"], r["doc_id"], r["total"]) for r in best] == [(q, d, q * 17) for q in (1, 2) for d in expected]


def test_more_results_than_ten_are_given(spark):
    docs = spark.createDataFrame([(k, f"apple {k}", ["t"], "apple") for k in range(30)], "doc_id BIGINT, title STRING, tags ARRAY<STRING>, content STRING")
    assert search.search_top_k(docs, "apple", 25).count() == 25


def test_shards_are_bounded_by_postings_of_tokens(spark, monkeypatch):
    # Each of the 40 postings holds 6 query tokens, so shards of 30 postings are 8, not 2.
    docs = spark.createDataFrame([(k, "t", ["g"], "abcdef") for k in range(40)], "doc_id BIGINT, title STRING, tags ARRAY<STRING>, content STRING")
    wanted = spark.createDataFrame([(w, k) for k, w in enumerate("abcdef")], "token STRING, token_id LONG")
    monkeypatch.setattr(search, "SHARD_POSTINGS", 30)
    assert search.shard_count(search.expand_terms(search.build_postings(docs), wanted), 1) == 8
    assert search.shard_count(search.expand_terms(search.build_postings(docs), wanted.where("false")), 3) == 3
