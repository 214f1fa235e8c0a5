"""Text functions, Column to Column; all run inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and the plain ones they become.
_ONE_TO_ONE = ("‘’“”–— ", "''\"\"-- ")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_INSTRUCTION = r"(?i)\s*\((?:Please select[^)]*|Select one|Select all that apply|if applicable)\)\s*"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def spaced(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def clean_label(c: Column) -> Column:
    """A printed label as a field name: plain characters, without instructions."""
    c = F.translate(c, *_ONE_TO_ONE)
    for mark, plain in _LIGATURES.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    # twice, as in "aBcD" one boundary's letter is the next one's neighbour
    for _ in range(2):
        c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    c = F.btrim(F.regexp_replace(spaced(c), _INSTRUCTION, " "))

    def closed(c: Column) -> Column:
        unclosed = F.length(F.regexp_replace(c, r"[^(]", "")) > F.length(F.regexp_replace(c, r"[^)]", ""))
        return F.split(spaced(F.when(unclosed, F.regexp_replace(c, r"\([^(]*$", "")).otherwise(c)), " ")

    def single(words: Column) -> Column:
        head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))
        repeated = (F.size(words) > 1) & F.array_contains(head, F.element_at(words, -1))
        return F.btrim(F.array_join(F.when(repeated, head).otherwise(words), " "), F.lit(" :,-"))

    return let(let(c, closed), single)


def slug(c: Column, fallback: str = "unlabelled") -> Column:
    s = F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def squash(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def first_line(c: Column) -> Column:
    """The first line that isn't empty, without back-ticks around it; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.btrim(F.btrim(x), F.lit("`")))
    lines = F.filter(F.transform(lines, lambda x: F.btrim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def same_question(question: Column, current: Column, options: Column) -> Column:
    """Is a probed question the current one, its wrapped end, or a run of its last options' words?"""
    q, now = squash(question), squash(current)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(options), F.lit(1))), lambda i: squash(F.array_join(F.slice(options, i, F.size(options)), "")))
    near = (q != "") & (now.endswith(q) | F.array_contains(tails, q))
    return F.coalesce(current, F.lit("")).__ne__("") & ((question == current) | near)


def select_mode(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("all that apply")), "many").when(F.contains(low, F.lit("select one")) | F.contains(low, F.lit("please select")), "one").otherwise("")


def equivalent(want: Column, have: Column) -> Column:
    """Equal but for case and marks; a none-marker is also met by an empty value."""
    from formspark.functions.rules import NONE_MARKERS

    return (squash(want) == squash(have)) | (F.lower(F.btrim(want)).isin(NONE_MARKERS) & (F.btrim(have) == ""))


def joined_parts(parts: Column) -> Column:
    """Parts of a wrapped answer as one."""
    clean = F.transform(parts, lambda p: F.btrim(F.rtrim(F.btrim(p), F.lit(","))))
    return F.array_join(F.filter(clean, lambda p: p != ""), ", ")


def context_tokens(need: Column) -> Column:
    """A context length for so many tokens: whole thousands of 1,024, from 4,096 to 32,768."""
    return F.greatest(F.lit(4096), F.least(F.lit(32768), (F.floor(need / 1024) + 1) * 1024)).cast("long")
