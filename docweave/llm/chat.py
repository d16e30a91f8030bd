"""Chat formatting: fold event logs of conversations into final messages, then render them with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


START, END = "<|im_start|>", "<|im_end|>"
BEGIN, CLOSE = "<s>", "</s>"
# Strings with a meaning in this or a common chat template; an escaped text holds none of them.
CONTROL = (r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)")
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
RESETS = ("message", "edit")


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of every control string, also of those already escaped."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Exact inverse of ``escape``."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of logs ``events(conv_id, seq, kind, message, role, text)``; more columns are dropped.

    In order of ``seq``, kind ``message`` or ``edit`` sets the text of a message, ``delta`` appends
    to it and ``regenerate`` discards the message and all with a higher number written so far.
    Exact repeats of an event count once; events tied in ``seq`` are folded with the setting ones
    first, then by role and text. A null text is empty, the last role that is not null holds,
    other kinds are ignored, and a null ``conv_id`` or ``message`` is a value like any other.
    Returns conv_id, message, role, text.

    All steps are partitioned by conversation and share one exchange; windows spill.
    """
    events = events.select("conv_id", "seq", "kind", "message", "role", "text")
    upto = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("conv_id", "message")
    seq, kind = F.col("seq"), F.col("kind")
    written = kind.isin(*RESETS, "delta") & (F.col("_cut").isNull() | (seq > F.col("_cut")))
    live = (
        events.withColumn("_cut", F.max(F.when(kind == "regenerate", seq)).over(upto))
        .where(written)
        .withColumn("_set", F.max(F.when(kind.isin(*RESETS), seq)).over(own))
        .withColumn("_role", F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own))
        .where(F.col("_set").isNull() | (seq >= F.col("_set")))
    )
    part = F.struct(seq, (~kind.isin(*RESETS)).alias("late"), "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(part)).alias("_parts"), F.max("_role").alias("role"))
    return folded.select("conv_id", "message", "role", F.array_join("_parts.text", "").alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted text per conversation of ``messages(conv_id, message, role, text)``.

    Returns conv_id, ``formatted`` and ``segments``, an array of (text, loss) whose texts give
    ``formatted`` when joined and whose flag is the loss mask: the texts of learned roles. Null
    roles and texts are empty; tied messages come by role and text. A conversation is one output
    row, so its messages meet in one task; nothing else has to.
    """
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_said"))

    def segment(text: Column, loss) -> Column:
        return F.struct(text.alias("text"), F.coalesce(loss, F.lit(False)).alias("loss"))

    def shown(m: Column) -> Column:
        role = F.regexp_replace(F.regexp_replace(m["role"], r"\\", r"\\\\"), "\n", r"\\n")
        return F.array(
            segment(F.concat(F.lit(START), escape(role), F.lit("\n")), F.lit(False)),
            segment(escape(m["text"]), m["role"].isin(*learned)),
            segment(F.lit(END + "\n"), F.lit(False)),
        )

    segments = F.concat(
        F.array(segment(F.lit(BEGIN), F.lit(False))), F.flatten(F.transform("_said", shown)),
        F.array(segment(F.lit(CLOSE), F.lit(False))),
    )
    done = said.select("conv_id", segments.alias("segments"))
    return done.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """Read the turns back from a formatted text: an array of (role, text)."""
    turn = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"

    def role(escaped: Column) -> Column:
        # A doubled backslash is told from one before an n by looking at pairs from the left.
        plain = F.regexp_replace(unescape(escaped), r"\G([^\\]*+(?:\\\\[^\\]*+)*+)\\n", "$1\n")
        return F.regexp_replace(plain, r"\\\\", r"\\")

    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(1)), role).alias("role"),
        F.transform(F.regexp_extract_all(formatted, F.lit(turn), F.lit(2)), unescape).alias("text"),
    )


def digest(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations: turns, learned text and size."""
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("_turns"), F.array_join(loss, "").alias("_loss"))
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
