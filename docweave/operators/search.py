"""Relevance search over documents and selection of passages under a length budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.expr import let
from docweave.functions.needles import find_needles
from docweave.functions.text import SPACE, occurrences, rstrip, strip, tokens
from docweave.session import spread_small, stored

# Weights of a hit by place, the passage budget and the result limits.
TITLE_WEIGHT, TAG_WEIGHT, CONTENT_WEIGHT = 4, 2, 1
BUDGET = 2500
DEFAULT_RESULTS = 5
# Postings of query tokens in a shard, which take about 250 bytes each there, query words that visit a shard together, and
# documents under one upper bound.
SHARD_POSTINGS, PART_TERMS, BLOCK_DOCS = 1_000_000, 1_000_000, 64
# How a heading line and a paragraph break are written.
HEADING = rf"(?md)^(#{{1,6}}){SPACE}+(.+?){SPACE}*$"
BLANK_LINE = rf"\n{SPACE}*\n"


def total_score(title: Column, tag: Column, content: Column) -> Column:
    return title * TITLE_WEIGHT + tag * TAG_WEIGHT + content * CONTENT_WEIGHT


# ---------------------------------------------------------------- one query


def _present(terms: Column, text: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def score_title_tags(docs: DataFrame, query: str) -> DataFrame:
    """Add ``title_score`` and ``tag_score``: how many query words occur in title and tags."""
    terms = tokens(F.lit(query))
    return docs.withColumns({
        "title_score": _present(terms, F.lower("title")),
        "tag_score": _present(terms, F.lower(F.array_join("tags", " "))),
    })


def _content_score(terms: Column) -> Column:
    counts = let(F.lower("content"), lambda text: F.transform(terms, lambda t: occurrences(text, t)))
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return F.coalesce(total, F.lit(0).cast("bigint"))


def score_content(docs: DataFrame, query: str) -> DataFrame:
    """Add ``content_score``: occurrences of the query words in the content, 0 without content."""
    return docs.withColumn("content_score", _content_score(tokens(F.lit(query))))


def search_top_k(docs: DataFrame, query: str, k: int = DEFAULT_RESULTS) -> DataFrame:
    """Best documents for one query; ties keep catalog order. No words, no rows."""
    terms = tokens(F.lit(query))
    scores = F.struct(
        _present(terms, F.lower("title")).alias("title_score"),
        _present(terms, F.lower(F.array_join("tags", " "))).alias("tag_score"),
        _content_score(terms).alias("content_score"),
    )
    summed = let(scores, lambda s: F.struct(
        s["title_score"].alias("title_score"), s["tag_score"].alias("tag_score"), s["content_score"].alias("content_score"),
        total_score(s["title_score"], s["tag_score"], s["content_score"]).alias("total"),
    ))
    # Dropping the misses inside the array keeps the filter from scoring every text twice.
    hits = F.filter(F.array(summed), lambda s: s["total"] > 0)
    return (
        docs.select("doc_id", "title", F.inline(hits))
        .orderBy(F.col("total").desc(), "doc_id")
        .limit(k)
    )


# ---------------------------------------------------------------- many queries


def build_postings(docs: DataFrame) -> DataFrame:
    """(word, doc_id, tf, in_title, in_tags): each word of a document once, with its uses.

    Words are counted inside the document's own row order, so the count is combined
    before anything is shuffled. Store it once and search it many times.
    """
    places = F.array(
        F.struct(F.lit("c").alias("place"), F.col("content").alias("text")),
        F.struct(F.lit("t").alias("place"), F.col("title").alias("text")),
        F.struct(F.lit("g").alias("place"), F.array_join("tags", " ").alias("text")),
    )
    words = spread_small(docs.select("doc_id", "title", "tags", "content")).select(
        "doc_id", F.explode(places).alias("p")
    ).select(
        "doc_id", "p.place", F.explode(tokens(F.col("p.text"))).alias("word")
    )
    return words.groupBy("word", "doc_id").agg(
        F.count_if(F.col("place") == "c").alias("tf"),
        F.max(F.when(F.col("place") == "t", 1).otherwise(0)).alias("in_title"),
        F.max(F.when(F.col("place") == "g", 1).otherwise(0)).alias("in_tags"),
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, times): the words of each query with their multiplicity."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("query_id", "token").agg(F.count("*").alias("times"))
    )


def expand_terms(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, n, found): vocabulary words holding query tokens, with their postings and (key, times) of every token in them.

    ``tokens(token, token_id)`` are distinct. A token consists of word characters only, so an occurrence in a text
    never crosses the edge of a word: counting inside words and adding up is exact.
    """
    words = postings.groupBy("word").agg(F.count("*").alias("n"))
    return find_needles(words, "word", tokens, "token", "token_id")


def shard_count(expanded: DataFrame, least: int) -> int:
    """Shards for an expanded vocabulary: a posting counts once for every token in its word, as a word holds several."""
    total = expanded.agg(F.coalesce(F.sum(F.col("n") * F.size("found")), F.lit(0))).first()[0]
    return max(least, -(-total // SHARD_POSTINGS))


def search_batch(postings: DataFrame, queries: DataFrame, k: int = DEFAULT_RESULTS) -> DataFrame:
    """Top ``k`` documents for every row of ``queries(query_id, text)``.

    Postings meet the words that hold a query token by equi-join; words no query asks for fall out there. What is left
    goes to shards of documents, and the query words to all shards; a shard returns its ``k`` best
    documents of every query (``_shard_best``), and these are merged. So no row per query and document leaves
    a task, and a common token, which is in a large share of the documents, is divided among the shards. Both shards and parts of
    the queries have a bounded size.
    """
    spark = postings.sparkSession
    terms = stored(query_terms(queries))
    tokens = stored(terms.select("token").distinct().withColumn("token_id", F.monotonically_increasing_id()))
    numbered = terms.join(tokens, "token").select("query_id", "token_id", "times")
    # The expansion grows with the vocabulary, so it must never be broadcast on an estimate.
    expanded = stored(expand_terms(postings, tokens))
    hits = postings.join(expanded.drop("n").hint("merge"), "word")
    shards = shard_count(expanded, spark.sparkContext.defaultParallelism)
    parts = max(1, -(-terms.count() // PART_TERMS))
    dealt = hits.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), _every(parts).alias("part"),
        "doc_id", "tf", "in_title", "in_tags", "found")
    asked = numbered.select(
        F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), _every(shards).alias("shard"), "query_id", "token_id", "times")
    types = {f.name: f.dataType.simpleString() for f in (postings.schema["doc_id"], queries.schema["query_id"])}
    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, title_score long, tag_score long, content_score long, total long"

    def best(rows: pa.Table, words: pa.Table) -> pa.Table:
        return _shard_best(rows, words, k)

    partial = dealt.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(best, schema)
    order = W.partitionBy("query_id").orderBy(F.col("total").desc(), "doc_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _every(number: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of every run, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _shard_best(rows: pa.Table, terms: pa.Table, k: int) -> pa.Table:
    """The ``k`` best documents of one shard for every query, by postings in blocks with upper bounds.

    Documents are ordered by all they could score and cut into blocks, so that blocks differ in what they can reach.
    Every token keeps its highest score per block; their sum over a query's words bounds each block. The most promising blocks
    are scored first; then only those are whose bound reaches the k-th best total (equal totals count, as
    the smaller document wins them).
    """
    flat = rows["found"].combine_chunks()
    sizes = pc.list_value_length(flat).to_numpy().astype(np.int64)
    # Documents by number, in order of their ids.
    ids = pc.unique(rows["doc_id"]).sort()
    doc = pc.index_in(rows["doc_id"], ids).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(rows.num_rows), sizes)
    tokens, token = np.unique(flat.flatten().field("key").to_numpy(), return_inverse=True)
    places = token * len(ids) + doc[row]
    order = np.argsort(places, kind="stable")
    first = np.flatnonzero(np.r_[True, places[order][1:] != places[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    if not len(first):
        return _results(ids, terms["query_id"].combine_chunks().slice(0, 0), *np.zeros((5, 0), np.int64))
    times, at = flat.flatten().field("times").to_numpy().astype(np.int64)[order], row[order]
    content = np.add.reduceat(rows["tf"].to_numpy()[at] * times, first)
    title = np.maximum.reduceat(rows["in_title"].to_numpy()[at].astype(np.int64), first)
    tag = np.maximum.reduceat(rows["in_tags"].to_numpy()[at].astype(np.int64), first)
    token, doc = places[order][first] // len(ids), places[order][first] % len(ids)
    impact = title * TITLE_WEIGHT + tag * TAG_WEIGHT + content * CONTENT_WEIGHT

    by_impact = np.argsort(-np.bincount(doc, weights=impact, minlength=len(ids)), kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_impact] = np.arange(len(ids))
    order = np.lexsort((place[doc], token))
    token, doc, title, tag, content, impact = (x[order] for x in (token, doc, title, tag, content, impact))
    block = place[doc] // BLOCK_DOCS
    blocks = int(block.max()) + 1
    # One entry per token and block: where its postings are and their highest score.
    entry = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
    entry_size, entry_block, highest = np.diff(np.r_[entry, len(token)]), block[entry], np.maximum.reduceat(impact, entry)
    entry_of_token = np.searchsorted(token[entry], np.arange(len(tokens) + 1))

    query_ids = terms["query_id"].combine_chunks().dictionary_encode()
    query = query_ids.indices.to_numpy()
    asked, known = np.searchsorted(tokens, terms["token_id"].to_numpy()), np.isin(terms["token_id"].to_numpy(), tokens)
    order = np.flatnonzero(known)
    order = order[np.argsort(query[order], kind="stable")]
    query, asked, times = query[order], asked[order], terms["times"].to_numpy()[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, query[1:] != query[:-1]]), len(query)] if len(query) else np.zeros(1, np.int64)
    found = []
    for a, b in zip(cuts, cuts[1:]):
        start, size = entry_of_token[asked[a:b]], entry_of_token[asked[a:b] + 1] - entry_of_token[asked[a:b]]
        own, weight = _runs(start, size), np.repeat(times[a:b], size)
        bound = np.bincount(entry_block[own], weights=weight * highest[own], minlength=blocks)
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        head = 1 + -(-k // BLOCK_DOCS)
        hits = _scored(own, weight, ranked[:head], blocks, entry_block, entry, entry_size, doc, title, tag, content)
        least = np.partition(hits[1], len(hits[1]) - k)[-k] if len(hits[1]) >= k else 1
        rest = ranked[head:][bound[ranked[head:]] >= least]
        if len(rest):
            more = _scored(own, weight, rest, blocks, entry_block, entry, entry_size, doc, title, tag, content)
            hits = [np.r_[x, y] for x, y in zip(hits, more)]
        top = np.lexsort((hits[0], -hits[1]))[:k]
        found.append([np.full(len(top), query[a]), *(x[top] for x in hits)])
    number, doc, total, title, tag, content = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((6, 0), np.int64)
    return _results(ids, query_ids.dictionary.take(pa.array(number, pa.int64())), doc, title, tag, content, total)


def _scored(own, weight, chosen, blocks, entry_block, entry, entry_size, doc, title, tag, content) -> list[np.ndarray]:
    """Documents of the chosen blocks that score, with total and its parts."""
    wanted = np.zeros(blocks, bool)
    wanted[chosen] = True
    here = wanted[entry_block[own]]
    entries, weight = own[here], weight[here]
    at, weight = _runs(entry[entries], entry_size[entries]), np.repeat(weight, entry_size[entries])
    docs, number = np.unique(doc[at], return_inverse=True)
    parts = [np.bincount(number, weights=weight * x[at], minlength=len(docs)).astype(np.int64) for x in (title, tag, content)]
    total = parts[0] * TITLE_WEIGHT + parts[1] * TAG_WEIGHT + parts[2] * CONTENT_WEIGHT
    return [x[total > 0] for x in (docs, total, *parts)]


def _results(ids: pa.Array, queries: pa.Array, doc, title, tag, content, total) -> pa.Table:
    scores = {"title_score": title, "tag_score": tag, "content_score": content, "total": total}
    return pa.table({
        "query_id": queries, "doc_id": ids.take(pa.array(doc.astype(np.int64))), **{n: pa.array(x.astype(np.int64)) for n, x in scores.items()}})


# ---------------------------------------------------------------- sections and paragraphs


def sections_of(content: Column) -> Column:
    """Array of struct(heading, level, body): a level-0 intro if there is text above the first
    heading, then one section per heading up to the next heading of any level."""
    marks = F.regexp_extract_all(content, F.lit(HEADING), F.lit(1))
    heads = F.regexp_extract_all(content, F.lit(HEADING), F.lit(2))
    bodies = F.split(content, HEADING, -1)
    intro = F.array(F.struct(
        F.lit("").alias("heading"), F.lit(0).alias("level"), strip(F.get(bodies, F.lit(0))).alias("body")
    ))
    headed = F.transform(
        F.arrays_zip(marks.alias("mark"), heads.alias("head"), F.slice(bodies, 2, F.size(bodies)).alias("body")),
        lambda z: F.struct(
            strip(z["head"]).alias("heading"), F.length(z["mark"]).alias("level"), strip(z["body"]).alias("body")
        ),
    )
    return (
        F.when(F.size(heads) == 0, intro)
        .when(strip(F.get(bodies, F.lit(0))) != "", F.concat(intro, headed))
        .otherwise(headed)
    )


def split_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_ord, heading, level, body) of ``docs(doc_id, content)``."""
    return docs.select("doc_id", F.posexplode(sections_of(F.col("content"))).alias("sec_ord", "s")).select(
        "doc_id", "sec_ord", "s.heading", "s.level", "s.body"
    )


def score_sections(sections: DataFrame, query: str) -> DataFrame:
    """Add ``score``: occurrences of the query words in heading and body."""
    text = F.lower(F.concat_ws(" ", "heading", "body"))
    return sections.withColumn("score", _count_terms(tokens(F.lit(query)), text))


def _count_terms(terms: Column, text: Column) -> Column:
    counts = let(text, lambda plain: F.transform(terms, lambda t: occurrences(plain, t)))
    return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)


def paragraphs_of(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, BLANK_LINE, -1), strip), lambda p: p != "")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, par_ord, body): pieces between blank lines."""
    return docs.select("doc_id", F.posexplode(paragraphs_of(F.col("content"))).alias("par_ord", "body"))


def _render(section: Column) -> Column:
    head = F.concat(F.repeat(F.lit("#"), section["level"]), F.lit(" "), section["heading"], F.lit("\n\n"))
    return rstrip(F.when(section["heading"] != "", F.concat(head, section["body"])).otherwise(section["body"]))


def route_units(docs: DataFrame) -> DataFrame:
    """Cut each document into its ranking units: sections, or paragraphs when it has at most
    one headed section. Adds ``unit_kind`` and ``units`` (score text and rendered text)."""
    cut = docs.withColumn("_sections", sections_of(F.col("content")))
    headed = F.size(F.filter("_sections", lambda s: s["heading"] != ""))
    section_units = F.transform(
        "_sections",
        lambda s: F.struct(
            F.lower(F.concat_ws(" ", s["heading"], s["body"])).alias("search_text"), _render(s).alias("shown")
        ),
    )
    paragraph_units = F.transform(
        paragraphs_of(F.col("content")),
        lambda p: F.struct(F.lower(p).alias("search_text"), p.alias("shown")),
    )
    return cut.withColumns({
        "unit_kind": F.when(headed <= 1, F.lit("paragraph")).otherwise(F.lit("section")),
        "units": F.when(headed <= 1, paragraph_units).otherwise(section_units),
    }).drop("_sections")


def select_passages(routed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pick units best first while they fit; adds ``chosen`` (positions) and ``n_units``.

    With a ``query`` column, units rank by score then position and a zero score stops the
    pick; without, they come in order. The best unit is always taken. A document is one
    row, so the running budget is kept by a fold over its units and nothing is shuffled.
    """
    ranked_by_query = "query" in routed.columns
    if ranked_by_query:
        # Without a query text every unit counts as a hit and keeps its place.
        asked = F.coalesce(F.col("query"), F.lit("")) != ""
        scored = let(tokens(F.col("query")), lambda terms: F.transform(
            "units",
            lambda u, i: F.struct(
                F.when(asked, -_count_terms(terms, u["search_text"])).otherwise(-1).alias("neg"), i.alias("pos"),
                (F.length(u["shown"]) + 2).alias("size"),
            ),
        ))
        routed = routed.withColumn("_ranked", F.array_sort(scored))
    else:
        routed = routed.withColumn("_ranked", F.transform(
            "units",
            lambda u, i: F.struct(F.lit(-1).alias("neg"), i.alias("pos"), (F.length(u["shown"]) + 2).alias("size")),
        ))
    start = F.struct(F.lit(budget).alias("left"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(acc: Column, unit: Column) -> Column:
        fits = (acc["taken"] == 0) | ((unit["neg"] < 0) & (unit["size"] <= acc["left"]))
        take = acc["open"] & fits
        return F.struct(
            F.when(take, acc["left"] - unit["size"]).otherwise(acc["left"]).alias("left"),
            (acc["taken"] + take.cast("int")).alias("taken"),
            take.alias("open"),
        )

    taken = F.aggregate("_ranked", start, step)["taken"]
    return routed.withColumn("_taken", taken).withColumns({
        "chosen": F.sort_array(F.transform(F.slice("_ranked", 1, F.col("_taken")), lambda r: r["pos"])),
        "n_units": F.size("units"),
    }).drop("_ranked", "_taken")


def assemble_passages(selected: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Chosen units in document order joined by blank lines, plus the number left out.

    A document without any unit shows its first ``budget`` characters.
    """
    shown = strip(F.array_join(F.transform("chosen", lambda i: F.get("units", i)["shown"]), "\n\n"))
    return selected.withColumns({
        "passage": F.when(F.col("n_units") == 0, F.substring("content", 1, budget)).otherwise(shown),
        "omitted": F.col("n_units") - F.size("chosen"),
    }).drop("units", "chosen", "content")


def relevant_passages(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Budgeted passages per row of docs(doc_id, content[, query])."""
    return assemble_passages(select_passages(route_units(docs), budget), budget)


def lead_passages(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Opening units of each document under the budget."""
    return relevant_passages(docs.drop("query"), budget)
