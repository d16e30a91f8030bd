"""Chats, quality rules, url filters, shards and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docweave.llm import chat, quality, queries, shards, urls
from docweave.session import stored
from tests.conftest import SMALL
from tests.llm.test_similar import brute_lines, closure, shingles
from workload.check import canonical, oracle_rows

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, extra int"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "<\\s>", "[\\\\INST]", "\\", "<", "\n", "a", "<|im_start|>assistant\n"]


def test_escape_is_reversible_and_hides_controls(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(CONTROLS) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in frame.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert row.back == row.t
        assert not re.search(r"<s>|</s>|\[/?INST\]|<\|im_(start|end)\|>", row.e)


def test_fold_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "He"), (1, 3, "delta", 2, None, "llo"),
        (1, 3, "delta", 2, None, "llo"), (1, 4, "edit", 1, None, "hey"), (1, 5, "regenerate", 2, None, None),
        (1, 6, "delta", 2, "assistant", "Good "), (1, 7, "delta", 2, None, "day"), (1, 8, "delta", 3, "user", None), (1, 9, "noise", 9, "x", "y"),
        (2, 1, "delta", 1, "user", "a"), (2, 2, "regenerate", 1, None, None), (None, 1, "message", 1, None, None),
    ]
    rows = chat.fold_events(spark.createDataFrame([(*e, 0) for e in log], EVENTS)).collect()
    got = sorted(((r.conv_id, r.message, r.role, r.text) for r in rows), key=str)
    assert got == sorted([(1, 1, "user", "hey"), (1, 2, "assistant", "Good day"), (1, 3, "user", ""), (None, 1, None, "")], key=str)
    assert chat.digest(chat.render(chat.fold_events(spark.createDataFrame([], EVENTS)))).collect() == []


def test_render_reads_back(spark):
    rnd = random.Random(2)
    said = [(c, m, rnd.choice(["user", "assistant", "sys\ntem\\n", None]), "".join(rnd.choice(CONTROLS) for _ in range(5)))
            for c in range(20) for m in range(rnd.randint(1, 6))] + [(99, 0, "assistant", "x" * 300_000), (99, 1, "assistant", None)]
    frame = spark.createDataFrame(said, "conv_id long, message long, role string, text string").repartition(3)
    rendered = chat.render(frame)
    for row in rendered.select("*", chat.parse(F.col("formatted")).alias("turns")).collect():
        own = [(r or "", t or "") for c, _, r, t in said if c == row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == own
        assert row.formatted == "".join(s.text for s in row.segments)
    for row in chat.digest(rendered).collect():
        own = [(r or "", t or "") for c, _, r, t in said if c == row.conv_id]
        loss = "".join(t for r, t in own if r == "assistant")
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    columns, want = oracle_rows(SMALL, queries.ORACLES[name])
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical([c for c, _ in columns], want)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(5)}
    filled = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(filled) - len(set(filled)), len(covered)


def test_quality_counts_and_verdicts(spark):
    prose = "The river runs past the old mill, and people rest there in the long evenings of summer."
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", prose, f"{prose}\nHome | About | News | Contact | Help\nAll rights reserved.", "Home | About | News | Contact | Help | Map | Login | Shop",
             "\n".join([prose] * 4), "one two three four five " * 3, "a\u00a0b " * 30, "word " * 5000, prose + "\n" + "!!! ??? ### *** " * 30]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "\n", ".\n."]) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, _words string, cleaning int")
    got = {r.doc_id: r for r in quality.judge(docs.drop("_words")).collect()}
    for k, text in enumerate(texts):
        row = got[k]
        counts = base_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0]) and not (row.base_failed and row.kept)
    assert [got[k].kept for k in (0, 3, 4, 5, 6)] == [False, True, True, False, False]
    assert got[4].cleaned == prose and quality.judge(docs.limit(0).drop("_words")).count() == 0


def judged_as(spark, texts, **given):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.kept, r.n_lines_failed) for r in quality.judge(docs, **given).orderBy("doc_id").collect()]


def test_a_long_line_may_mention_a_phrase(spark):
    article = " ".join(f"Mill{k} ground corn{k}, and people{k} rest{k} there{k}." for k in range(30))
    mention = f"{article} The owner's privacy policy was short. In spring it reopened, and many people came."
    line = "Click here to read our privacy policy and terms of use."
    assert judged_as(spark, [mention, f"{article}\n{line}", line]) == [(True, 0), (True, 1), (False, 1)]
    assert judged_as(spark, [mention], as_sql=True) == [(False, 1)]


def test_clean_dialogue_is_kept(spark):
    en = "“Yes!” he said.\n“No—never!”\n‘Why?’ “Because…”\n“The mill by the river is closed today, my friend!” she said."
    fr = "« Oui ! »\n— Non ! dit-il.\n«Ah… bon ?»\n— Le moulin près de la rivière est fermé aujourd'hui !"
    de = "„Ja!“ rief er.\n»Nein!«\n„Ach so…“\n„Die Mühle am Fluss ist heute leider geschlossen!“ – sagte sie."
    es = "¡Hola, amigo!\n¿Qué? ¡No!\n—¡Ven aquí! —dijo.\n—¡El molino junto al río está cerrado hoy, señor!"
    assert judged_as(spark, [en, fr, de, es]) == [(True, 0)] * 4
    assert [n for _, n in judged_as(spark, ["!!!!!!", "¡¡!! a !!!", "### a. ***", "“Yes!” «»‹»›! | $ . #"])] == [1] * 4
    assert all(n for _, n in judged_as(spark, [en, fr, de, es], as_sql=True))


def test_clean_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rates = dict(quality.judge(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert rates[1] > 0.98 and rates[0] < 0.6


def jump_hash(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *random.Random(4).sample(range(10**12), 60)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 1000):
        for row in frame.select("k", shards.jump(F.col("k"), n).alias("s")).collect():
            assert row.s == jump_hash(row.k, n)


def test_shards(spark):
    rows = [(k, f"text {k % 50} é") for k in range(500)] + [(7, "again"), (7, "again"), (600, None), (601, ""), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    got = shards.shard_documents(docs, 8).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    slots = {}
    for r in got:
        assert r.shard == jump_hash(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
        if r.doc_id != 7:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 8 for r in got)
    assert 0 < moved < len(got) / 4
    assert shards.shard_documents(docs.limit(0), 8).collect() == []


def test_url_parts_and_rules(spark):
    given = {
        None: ("", "", None), "no scheme/x": ("", "", None), "http://A.Net": ("a.net", "", None), "http://a.net/": ("a.net", "/", "net/"),
        "https://x.example.net/en/5?q=1": ("x.example.net", "/en/5", "example.net/en/"), "http://example.net/de/": ("example.net", "/de/", "net/"),
        "http://m.example.com/de/x#t": ("m.example.com", "/de/x", "example.com/de/"), "http://badexample.com/de/": ("badexample.com", "/de/", None),
        "http://q.org/fr/1": ("q.org", "/fr/1", "org/fr/"), "a://b://c/d": ("b:", "//c/d", None), "x://h\ny/p\nq?z": ("h\ny", "/p\nq", None),
        "http://planet/": ("planet", "/", None), "http://h?a/b": ("h", "", None), "": ("", "", None),
    }
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(given)], "page_id long, url string, features string")
    model = urls.train(urls.labelled_urls(spark))
    got = {r.page_id: r for r in urls.judge_urls(pages, queries.RULES, model).collect()}
    for k, want in enumerate(given.values()):
        assert (got[k].host, got[k].path, got[k].rule) == want
        assert got[k].verdict == {"net/": "block", "example.com/de/": "block", None: got[k].verdict}.get(want[2], "allow")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_url_model_on_held_out_urls(spark):
    labelled = urls.labelled_urls(spark).collect()
    right = 0
    for fold in range(3):
        train = [r for k, r in enumerate(labelled) if k % 3 != fold]
        model = urls.train(spark.createDataFrame(train, "url string, unwanted double"))
        held = [(k, r.url) for k, r in enumerate(labelled) if k % 3 == fold]
        judged = urls.judge_urls(spark.createDataFrame(held, "page_id long, url string"), [], model).collect()
        right += sum((r.verdict == "block") == bool(labelled[r.page_id].unwanted) for r in judged)
    assert right / len(labelled) >= 0.7


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    packed = corpus_pipeline.run(spark, SMALL).collect()
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in packed} <= kept
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for own in by_doc.values():
        at = 0
        for _, start, length in sorted(own):
            assert start == at
            at += length
    assert len(corpus_pipeline.STAGES) == 4


def test_emptied_documents_go(spark):
    text = "The river runs past the old mill.\nMany people rest there in the evenings of summer."
    rows = [(k, text) for k in range(3, 9)] + [(9, f"{text}\nA line of its own stays here."), (10, ""), (11, None), (12, " \n"), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, SMALL).collect()}
    assert got == {3: text, 9: "A line of its own stays here.", 10: "", 11: None, 12: " \n", 13: ""}


def test_one_row_of_a_group_stays(spark):
    def text(k):
        return " ".join(f"w{k}x{n}" for n in range(60))

    near = text(1) + " more"
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, near), (0, text(2)), (None, text(3)), (None, text(3)), (None, text(3) + " more"),
            (None, near), (3, text(4)), (3, text(5)), (None, ""), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_stage(spark, docs, SMALL)
    left = Counter((r.doc_id, r.text) for r in got.collect())
    third = [x for x in left if x in {(None, text(3)), (None, text(3) + " more")}]
    assert got.columns == ["doc_id", "text"] and len(third) == 1
    assert left == Counter([(1, text(1)), (0, text(2)), third[0], (3, text(4)), (3, text(5)), (None, ""), (None, None), (4, "")])


def plain_fails(line):
    low, solid = line.lower(), re.sub(r"\s", "", line)
    mentioned = sum(map(len, re.findall("|".join(quality.BOILERPLATE), low)))
    bars = sum(c in "|»›•" for c in line)
    odd = sum(not (c.isalnum() or c.isspace() or c in ".,;:?'’\"()@+/_-" + quality.MARKS) for c in line)
    marks, letters = sum(c in quality.MARKS for c in line), sum(c.isalnum() for c in line)
    boilerplate = mentioned and mentioned * 10 >= len(low)
    unmarked = not re.search(r"[.,;:!?…。！？]", line)
    return bool(solid) and bool(boilerplate or (bars >= 3 and bars * 4 >= len(line.split()) - bars) or unmarked or odd * 10 > len(solid) or marks > 3 * letters)


def test_stages_equal_plain_python(spark):
    rnd = random.Random(9)

    def sentence(n):
        return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(400)) for _ in range(n)) + "."

    pool = [sentence(n) for n in (1, 2, 3, 7, 12, 30)] + ["Home | About | News | Contact", "All rights reserved.", "“Yes!” he said.", "no mark here", "#### ,", ""]
    texts = ["\n".join([sentence(rnd.randint(12, 80)), *rnd.choices(pool, k=rnd.randint(0, 4))]) for _ in range(25)]
    for k in range(8):
        # The same words in other lines pass line dedup; near_stage links them, or not with every tenth word changed.
        base = [f"{w}," for w in sentence(90).rstrip(".").split()]
        for width, changed in ((90, ()), (9, ()), (13, (40,)), (17, range(5, 90, 10))):
            words = [f"z{k}q{width}x{n}," if n in changed else w for n, w in enumerate(base)]
            texts.append("\n".join(" ".join(words[n : n + width]) for n in range(0, 90, width)))
    texts += [texts[0], texts[30], "too few words.", None, ""]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))

    stages = [stage for _, stage in corpus_pipeline.STAGES]
    one = stored(stages[0](spark, docs, SMALL))
    want = {}
    for k, text in enumerate(texts):
        n, solid, _, _, repeated = base_counts(text)
        cleaned = "\n".join(x for x in (text or "").split("\n") if not plain_fails(x))
        if n >= 10 and 100 * repeated <= 20 * n and 2 * len(re.sub(r"\s", "", cleaned)) >= solid:
            want[k] = cleaned
    assert dict(one.collect()) == want and 20 < len(want) < len(texts)

    two = stored(stages[1](spark, one, SMALL))
    removed = brute_lines(sorted(want.items()), least=1)
    left = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in removed) for k, t in want.items()}
    left = {k: t for k, t in left.items() if t.split() or not want[k].split()}
    assert dict(two.collect()) == left and len(left) < len(want)

    three = stored(stages[2](spark, two, SMALL))
    sets = {k: shingles(t, 5) for k, t in left.items()}
    links = [(a, b) for a in left for b in left if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    label = closure(left, links)
    final = {k: t for k, t in left.items() if label[k] == k}
    assert dict(three.collect()) == final and links

    lengths = Counter()
    for r in stages[3](spark, three, SMALL).collect():
        lengths[r.doc_id] += r.length
    encoder = Tokenizer.from_file(str(queries.BYTE_VOCABULARY))
    assert dict(lengths) == {k: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for k, t in final.items()}


def test_long_roles_come_back(spark):
    from docweave.llm import chat

    roles = ["r" * 2000, "a\\n\n" * 50_000, "\\" * 300_000 + "\n", "x" * 1_000_000, "<s>\n" * 10_000, ""]
    rows = [(k, 1, role, "text") for k, role in enumerate(roles)]
    rendered = chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    from pyspark.sql import functions as F

    back = {r.conv_id: r.t[0].role for r in rendered.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert back == dict(enumerate(roles))
