"""Encoding, decoding, prefix counts and packing against the libraries and brute force."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docweave.llm import packing, pieces, queries

MODEL = queries.PIECE_MODEL
PARTS = ["a", "b", "the", "th", " ", "  ", "   ", "é", "ß", "Z", "1", "▁", "\n", "\t", "你好", "🙂", "\u0301", "\x00", "</s>", "<s>",
         "[INST]", "<|endoftext|>", "ing", "er", "==", "//", "-"]


def odd_texts(n=150):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [None, "", " ", " " * 70, "a" * 300, "=" * 90, "x" + " " * 40 + "the", "ab" * 2000, *made]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encode_and_decode_equal_the_library(spark, library):
    texts = odd_texts()
    docs = frame(spark, texts).drop("ids")
    rows = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = [1, *library.encode(row.text or ""), 2]
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert row.decoded == library.decode(ids)


def test_decode_of_any_ids(library):
    rnd = random.Random(5)
    vocabulary = pieces.pieces(MODEL)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259)]) for _ in range(12)]
        assert vocabulary.decode(np.array(ids)) == library.decode(ids)
    assert vocabulary.decode(np.zeros(0, np.int64)) == ""


def test_prefix_counts_equal_encoding_every_prefix(spark, library):
    texts = odd_texts(60)
    rows = pieces.count_tokens(frame(spark, texts), MODEL, 7, prefixes=True).collect()
    for row in rows:
        text = row.text or ""
        counts = [len(library.encode(text[: n + 1])) for n in range(len(text))] if len(text) < 400 else None
        assert row.n_tokens == len(library.encode(text))
        if counts is not None:
            assert np.frombuffer(row.prefix_tokens, "<i4").tolist() == counts
            assert row.fit_chars == max([n + 1 for n, c in enumerate(counts) if c <= 7], default=0)


def test_byte_bpe_equals_tokenizers():
    exact = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    own = packing.byte_bpe(queries.BYTE_VOCABULARY, queries.BYTE_RANKS)
    for text in [*odd_texts(), *("".join(chr(c) for c in range(k, k + 40) if not 0xD800 <= c < 0xE000) for k in range(0, 0x3000, 40))]:
        assert own.ids(text or "").tolist() == exact.encode(text or "", add_special_tokens=False).ids


def test_fullest_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(0, 25)
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(sum(x) for r in range(len(items) + 1) for x in itertools.combinations(items, r) if sum(x) <= room)
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == best and all(chosen.count(n) <= counts[n] for n in chosen)


def test_packing_is_gapless_and_tight(spark):
    rnd = random.Random(2)
    lengths = [min(64, max(1, int(rnd.lognormvariate(2.5, 1)))) for _ in range(900)] + [64] * 300
    rows = [(k % 400, k, n, f"t{k}") for k, n in enumerate(lengths)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, offset_note string"), 64).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.offset_note) for r in packed) == sorted(rows)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(lengths) // 64) * 1.05 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long"), 64).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 65)], "doc_id long, piece int, length long"), 64)


def test_pieces_of_documents(spark):
    exact = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    texts = [None, "", "a b c d e f g h i", "word " * 40, "word " * 40]
    rows = packing.token_pieces(frame(spark, texts), queries.BYTE_VOCABULARY, queries.BYTE_RANKS, size=8).collect()
    for k, text in enumerate(texts):
        whole = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in rows if r.doc_id == k)
        assert [i for p in own for i in p[3]] == whole
        assert [p[0] for p in own] == list(range(len(own))) and all(p[2] == 8 for p in own[1:])
        assert all(p[1] == sum(q[2] for q in own[: p[0]]) and p[2] == len(p[3]) for p in own)


def test_queries_on_the_small_tables(spark, library):
    from tests.conftest import SMALL

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_sentencepiece"](spark, SMALL).collect():
        ids = [1, *library.encode(docs[r.doc_id]), 2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in queries.QUERIES["op6_token_counts"](spark, SMALL).collect():
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    assert public_tokenizers.path("piece_bpe_32k.model") == MODEL
    packed = queries.QUERIES["op2_best_fit_packing"](spark, SMALL)
    lengths = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert lengths[0] <= 1024 and lengths[1] <= -(-lengths[2] // 1024) * 1.05 + 1
