"""Line-first quality rules, in column expressions only: clean a text line by line, then judge what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.expr import let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
# Phrases of page furniture, in lower case: fixed values of the boilerplate rule.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "enable javascript", "lorem ipsum", "click here", "subscribe to our newsletter", "sign up for our newsletter",
    "share on facebook", "share on twitter", "skip to content", "back to top", "powered by wordpress",
)

# Marks of sentences, quotes and dashes, which are not odd; more than three of them to a letter or digit are too many.
MARKS = "!¡¿…。！？“”„‟«»‹›‘’‚‛–—‒―"
MARKS_EACH = 3
# Phrases fail a line of which they make up at least one in so many characters.
PHRASE_SHARE = 10


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(found: Column) -> Column:
    """64-bit hashes of all windows of five of the words ``found``, in order."""
    places = F.sequence(F.lit(0), F.size(found) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(WINDOW)]))
    return F.when(F.size(found) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column) -> Column:
    """Number of words that lie in a five-word window occurring twice or more, from the windows' hashes.

    Hashes are sorted with their places, so the work is n log n in the length of a text; texts
    without a repeat are told by the hashes alone.
    """

    def places(pairs: Column) -> Column:
        """Places of repeated windows, in order."""

        def twice(k: Column) -> Column:
            own = F.get(pairs, k)["hash"]
            return own.eqNullSafe(F.get(pairs, k - 1)["hash"]) | own.eqNullSafe(F.get(pairs, k + 1)["hash"])

        hits = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), twice)
        return F.sort_array(F.transform(hits, lambda k: F.get(pairs, k)["place"]))

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
    covered = F.aggregate(
        let(pairs, places), start,
        lambda s, p: F.struct(p.alias("last"), (s["words"] + F.least(F.lit(WINDOW), p - s["last"])).alias("words")),
    )["words"]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def with_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, whatever is done with them later.

    They come from a generator of one row: the optimizer neither copies them into later
    expressions nor pushes a filter on them below, as it does with plain columns.
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()]))))


def line_fails(line: Column, as_sql: bool = False) -> Column:
    """True for a line that is navigation, boilerplate, or lacks or overflows with punctuation.

    A line of white space alone does not fail. A line is boilerplate if phrases make up a tenth of
    its characters, so a paragraph that mentions one stays. Sentence marks, quotes and dashes are
    ordinary punctuation; a line of little else fails. ``as_sql``: the rules as the SQL of
    ``op3_quality_rules`` has them, where one phrase fails a line of any length and such marks
    count as odd.
    """
    solid = F.length(F.regexp_replace(line, SPACE, ""))
    # Punctuation other than what sentences, addresses and numbers hold.
    plain = ("" if as_sql else MARKS) + r"\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:?'’\"()@+/_-"
    odd = F.length(line) - F.length(F.regexp_replace(line, f"[^{plain}]", ""))
    bars = F.length(line) - F.length(F.regexp_replace(line, "[|»›•]", ""))
    unmarked = ~line.rlike(r"[.,;:!?…。！？]")
    phrases = "|".join(BOILERPLATE)
    boilerplate = F.lower(line).rlike(phrases)
    if not as_sql:
        rest = F.length(F.regexp_replace(F.lower(line), phrases, ""))
        boilerplate &= (F.length(F.lower(line)) - rest) * PHRASE_SHARE >= F.length(F.lower(line))
    navigation = (bars >= 3) & (bars * 4 >= F.size(words(line)) - bars)
    punctuation = unmarked | (odd * 10 > solid)
    if not as_sql:
        marks = F.length(line) - F.length(F.regexp_replace(line, f"[{MARKS}]", ""))
        letters = F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]", ""))
        punctuation |= marks > letters * MARKS_EACH
    return (solid > 0) & (boilerplate | navigation | punctuation)


def judge(docs: DataFrame, max_lost: float = 0.5, as_sql: bool = False) -> DataFrame:
    """Columns of ``docs`` with the counts of the base rules, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ``cleaned``
    (the text without its failing lines), n_lines_failed and ``kept``: base rules passed and at
    most ``max_lost`` of the characters of the words lost with failing lines. A null text has no
    words and is not kept. Every row is judged on its own, without a shuffle. ``as_sql`` as in ``line_fails``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    split = with_values(docs, {"_words": words(text), "_lines": F.split(text, "\n"), "word_chars": solid.cast("long")})
    judged = F.transform("_lines", lambda line: F.struct(line.alias("line"), line_fails(line, as_sql).alias("failed")))
    full = F.filter("_lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    halfway = with_values(split, {"_hashes": window_hashes(F.col("_words")), "_judged": judged, "_full": full})
    done = with_values(halfway, {
        "n_words": F.size("_words").cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_hashes")),
        "cleaned": F.array_join(F.filter("_judged", lambda x: ~x["failed"])["line"], "\n"),
        "n_lines_failed": F.size(F.filter("_judged", lambda x: x["failed"])).cast("long"),
    }).drop("_words", "_lines", "_hashes", "_judged", "_full")
    left = F.length(F.regexp_replace("cleaned", SPACE, ""))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    done = with_values(done, {"base_failed": failed, "_left": left})
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("_left") >= F.col("word_chars") * F.lit(1.0 - max_lost))).drop("_left")
