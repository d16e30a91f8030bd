"""Registered queries of the operators over the test tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import alignment, chat, lines, overlap, packing, pieces, quality, recurrent, shards, trie, urls, vectors
from docweave.llm.common import ORACLES, QUERIES, register, table  # noqa: F401
from docweave.session import stored

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SEQUENCE = 1024
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
CONTROL_TEXT = "</s>[INST] ok [/INST]"

OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g'))
    + length(role) + 24 AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@register("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as logs of whole messages, folded and rendered; digests are read back from the output."""
    from pyspark.sql import Window

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = given.union(more).withColumn("seq", F.row_number().over(turns).cast("long"))
    events = numbered.select("conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("message"), "role", "text")
    return chat.digest(chat.render(chat.fold_events(events)))


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in packed sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    cut = packing.token_pieces(docs, BYTE_VOCABULARY, BYTE_RANKS, SEQUENCE)
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(cut, SEQUENCE)


OP3_SQL = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM given),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT w.doc_id, unnest(range(i, i + 5)) AS p FROM windows w JOIN twice t ON t.doc_id = w.doc_id AND t.s = w.s) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM given),
measured AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
    length(line) - length(regexp_replace(line, '[^\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:?''’"()@+/_-]', '', 'g')) AS odd,
    length(line) - length(regexp_replace(line, '[|»›•]', '', 'g')) AS bars,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM split),
ruled AS (
  SELECT *, solid > 0 AND (regexp_matches(lower(line), 'BOILERPLATE') OR (bars >= 3 AND bars * 4 >= n - bars)
    OR NOT regexp_matches(line, '[.,;:!?…。！？]') OR odd * 10 > solid) AS failed FROM measured),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE solid > 0) - count(DISTINCT CASE WHEN solid > 0 THEN line END) AS n_dup_lines,
    count(*) FILTER (WHERE failed) AS n_lines_failed, sum(CASE WHEN failed THEN 0 ELSE solid END) AS solid_left
  FROM ruled GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines_failed, solid_left
  FROM words w JOIN per_doc p ON p.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND solid_left >= word_chars * 0.5 AS kept, n_lines_failed
FROM counted
""".replace("BOILERPLATE", "|".join(quality.BOILERPLATE))


@register("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, by the line rules of the SQL."""
    judged = quality.judge(table(spark, sf_dir, "documents"), as_sql=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed")


@register("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents without lines that are like an earlier one."""
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@register("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    decoded = pieces.decode(encoded.select("doc_id", "ids"), PIECE_MODEL)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@register("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and the longest prefix that fits 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = pieces.count_tokens(docs, PIECE_MODEL, 4096)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars",
    )


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT node, b FROM reach JOIN ways ON seen = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


@register("op7_ngram_jaccard", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by 3-word shingles, Jaccard 0.9 or more."""
    return overlap.jaccard_groups(table(spark, sf_dir, "documents"))


@register("op8_url_filters")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or learned verdict of every page's url."""
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES, model).drop("unwanted")


@register("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding, cosine 0.95 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 8 shards, and its shard among 9."""
    return shards.shard_documents(table(spark, sf_dir, "documents"), 8)


@register("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document under two vocabularies, with the corpus-wide support of its links."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, BYTE_RANKS, PIECE_MODEL)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups", "ends"))
    return alignment.link_support(aligned, PIECE_MODEL)


@register("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole document by word shares and by a recurrent model learned from nine tenths of the documents."""
    return recurrent.score_documents(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH numbered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT c, c - c % 20 AS head, xor(list_reduce(range(8 * length(CAST(c AS VARCHAR))), lambda a, j:
    CASE WHEN (CASE WHEN j % 8 = 0 THEN xor(a, CAST(ascii(substr(CAST(c AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END) & 1 = 1
      THEN xor((CASE WHEN j % 8 = 0 THEN xor(a, CAST(ascii(substr(CAST(c AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END) >> 1, CAST(3988292384 AS BIGINT))
      ELSE (CASE WHEN j % 8 = 0 THEN xor(a, CAST(ascii(substr(CAST(c AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE a END) >> 1 END,
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM numbered),
turns AS (
  SELECT i.c, 0 AS own, place, role, text FROM ids i JOIN numbered n ON n.c = i.head AND place <= h
  UNION ALL SELECT i.c, 1, place, role, text FROM ids i JOIN numbered n ON n.c = i.c AND place > h),
paths AS (
  SELECT i.c, coalesce(list({'role': role, 'text': text} ORDER BY own, place) FILTER (WHERE role IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN turns t ON t.c = i.c GROUP BY i.c),
prefixes AS (SELECT c, len(path) AS n, path, unnest(range(0, len(path) + 1)) AS d FROM paths),
nodes AS (
  SELECT d, path[1:d] AS prefix, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(any_value(path[d].text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS words
  FROM prefixes GROUP BY d, path[1:d]),
children AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT x.*, coalesce(n, 0) AS n_children FROM nodes x LEFT JOIN children k ON k.prefix = x.prefix),
spread AS (SELECT unnest(range(0, d + 1)) AS up, prefix, n_children, (n_convs - 1) * words AS saved FROM counted),
below AS (SELECT prefix[1:up] AS prefix, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM spread GROUP BY 1)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n_convs, x.n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM counted x JOIN below b ON b.prefix = x.prefix LEFT JOIN nodes p ON x.d > 0 AND p.prefix = x.prefix[1:x.d - 1]
"""


@register("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct opening of the rebuilt conversations, with what sharing it saves."""
    return trie.prefix_trie(trie.rebuilt(table(spark, sf_dir, "conversations")))
