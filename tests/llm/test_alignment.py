"""Cross-tokenizer alignment against the tokenizer libraries and a plain loop."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docweave.llm import alignment
from docweave.llm.queries import BYTE_RANKS, BYTE_VOCABULARY, PIECE_MODEL, QUERIES
from docweave.session import stored

TEXTS = [
    "Hello world, hello again.", "", None, "naïve façade — “quoted” …", "日本語のテキストと emoji 😀👍🏽", "   many   spaces \n\n\ttabs",
    "</s>[INST]<|endoftext|><s> <unk> <0x41> text", "holds a mark ▁ inside", "x", " ", "\u0000nul", "ÿþ" * 50, "a" * 3000,
    "Hello world, hello again.", "The thnt estion ntes a onenble lyndre " * 200, "é́ combining ￼  \U0010ffff",
]


def byte_decoder():
    """Characters of byte-level vocabulary entries to bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = byte_decoder()

    def spans(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spell(i)), i))
            at += len(spell(i))
        return out

    def spell_a(i):
        return bytes(chars[c] for c in a.id_to_token(i))

    def spell_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def run(docs):
        rows, holders = [], collections.Counter()
        for doc, text in docs:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
            ids_b = b.encode(text) if text else []
            given = (" " + text).encode() if text else b""
            if b"".join(map(spell_a, ids_a)) != given or b"".join(map(spell_b, ids_b)) != given:
                ids_a = ids_b = []
            left, right = spans(ids_a, spell_a), spans(ids_b, spell_b)
            cuts = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
            groups, start = [], 0
            for cut in cuts:
                groups.append(",".join(str(i) for s, _, i in left if start <= s < cut) + "|" + ",".join(str(i) for s, _, i in right if start <= s < cut))
                start = cut
            links = [(i, j) for s, e, i in left for t, f, j in right if s < f and t < e] if len(left) < 5000 else None
            holders.update(set(links))
            rows.append((doc, len(ids_a), len(ids_b), cuts, links, ";".join(groups)))
        best = collections.defaultdict(int)
        for (i, _), count in holders.items():
            best[i] = max(best[i], count)
        return [
            (doc, n_a, n_b, len(cuts), len(links), sum(holders[l] == best[l[0]] for l in links), sum(holders[l] for l in links), groups, cuts)
            for doc, n_a, n_b, cuts, links, groups in rows]

    return run


@pytest.mark.parametrize("block_links", [1, 500, 1 << 24])
def test_alignment_equals_a_plain_loop(spark, brute, block_links):
    docs = [*enumerate(TEXTS), (3, "another text of a repeated id"), (None, "no id")]
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    given = given.selectExpr("doc_id", "text", "1 AS groups", "2 AS block", "3 AS n_best")
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        aligned = stored(alignment.align(given, BYTE_VOCABULARY, BYTE_RANKS, PIECE_MODEL, block_links))
        rows = alignment.link_support(aligned, PIECE_MODEL).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, np.frombuffer(r.ends, "<u4").tolist()) for r in rows]
    assert sorted(found, key=repr) == sorted(brute(docs), key=repr)


def test_empty_table(spark):
    given = spark.createDataFrame([], "doc_id long, text string")
    aligned = stored(alignment.align(given, BYTE_VOCABULARY, BYTE_RANKS, PIECE_MODEL))
    assert alignment.link_support(aligned, PIECE_MODEL).count() == 0


def test_registered_query(spark, brute, tmp_path):
    docs = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    expected = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in brute(docs)]
    assert sorted(found) == sorted(expected)


def test_pairs_are_packed_without_loss():
    keys, times = np.array([0, 5, 1 << 20, (1 << 31) - 1]), np.array([1, 300, 2, 70000])
    again = alignment.unpacked(alignment.packed(keys, times))
    assert again[0].tolist() == keys.tolist() and again[1].tolist() == times.tolist()
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(keys[:0], times[:0]))] == [[], []]
