"""Column helpers for text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.expr import let

# The characters a Unicode-aware strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Line ends besides "\n" that split a text into lines.
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# One whitespace character in a Java pattern, with the same reach as WHITESPACE.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"(?U)\w+"


def strip(text: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, ends are stripped."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def lines(text: Column) -> Column:
    """Split into lines at any line end."""
    return F.split(F.regexp_replace(text, LINE_END, "\n"), "\n", -1)


def clean_lines(text: Column) -> Column:
    """Per line: collapse whitespace; drop blank lines; join with a newline."""
    return F.array_join(
        F.filter(F.transform(lines(text), collapse), lambda line: line != ""), "\n"
    )


def tokens(text: Column) -> Column:
    """Lower-case word runs in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``; an empty needle counts 0."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, gone / F.length(needle)).otherwise(0).cast("int")


def contains_fold(text: Column, needle: str) -> Column:
    """Null-safe, case-insensitive substring test against a constant."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    words = F.split(F.lower(text), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), ""
    )


def path_parts(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path, "/"), lambda part: part != "")


def canonical_path(path: Column) -> Column:
    """Leading slash, no trailing slash except on the bare root. Note ``//`` becomes empty."""
    slashed = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(slashed) > 1, F.rtrim(slashed, F.lit("/"))).otherwise(slashed)


def url_path(url: Column) -> Column:
    """Path part of a URL (no host, query or fragment); a bare host gives ``/``."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


# Wording that marks something as on its way out.
DEPRECATION = (
    r"(?iU)\b(deprecated|will be removed|no longer supported?|sunset|end[- ]of[- ]life)\b"
)
NOTE_LIMIT = 240


def is_deprecated(text: Column) -> Column:
    """Does the text hold a deprecation marker."""
    return F.coalesce(F.rlike(text, F.lit(DEPRECATION)), F.lit(False))


def deprecation_note(text: Column, limit: int | None = None) -> Column:
    """The sentence holding the first deprecation marker, or null.

    The sentence runs from after the last full stop before the marker to the first one
    after it. With ``limit``, as listings show it, a longer one is cut and dotted.
    """
    def sentence(found: Column) -> Column:
        before = F.substring(text, F.lit(1), found["at"] - 1)
        after = F.substring(text, found["at"] + F.length(found["marker"]), F.length(text))
        return strip(F.concat(F.substring_index(before, ".", -1), found["marker"], F.substring_index(after, ".", 1)))

    def shorten(note: Column) -> Column:
        return F.when(
            F.length(note) > limit, F.concat(F.substring(note, 1, limit - 3), F.lit("..."))
        ).otherwise(note)

    found = F.struct(
        F.regexp_instr(text, F.lit(DEPRECATION)).alias("at"), F.regexp_extract(text, DEPRECATION, 0).alias("marker")
    )
    whole = let(found, sentence)
    return F.when(is_deprecated(text), whole if limit is None else let(whole, shorten))
