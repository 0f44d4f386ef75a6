"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """The segments of a relative path; their order is the order of a walk of the tree."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def dirname(path: Column) -> Column:
    """The directory of a path; the root is '.'."""
    parts = segments(path)
    return F.when(F.size(parts) < 2, ".").otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def prefixes(path: Column) -> Column:
    """All directories above a path, nearest first, the root '.' last."""
    parts = segments(path)
    up = F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )
    return F.concat(up, F.array(F.lit(".")))


def trim_all(text: Column) -> Column:
    """Without white space, of any kind that Unicode has, at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def tokenise(text: Column) -> Column:
    """Distinct lower-cased runs of letters and decimal digits, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda x: x != ""))


#: Characters with an escape of one letter.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}


def quoted(text: Column) -> Column:
    """In double quotes, with backslashes before what can't stand in them as it is; characters that don't print are given by number."""

    def escaped(c: Column) -> Column:
        number = lambda n: F.lpad(F.lower(F.hex(F.ascii(c))), n, "0")
        out = F.when(c.rlike(r"[\x00-\x1F\x7F]"), F.concat(F.lit("\\x"), number(2))).when(c.rlike(r"[\p{L}\p{M}\p{N}\p{P}\p{S} ]"), c)
        out = out.when(F.ascii(c) < 0x10000, F.concat(F.lit("\\u"), number(4))).otherwise(F.concat(F.lit("\\U"), number(8)))
        for raw, short in ESCAPES.items():
            out = F.when(c == raw, F.lit(short)).otherwise(out)
        return out

    special = text.rlike(r'[^\p{L}\p{M}\p{N}\p{P}\p{S} ]|["\\]')
    return F.concat(F.lit('"'), F.when(special, F.array_join(F.transform(F.split(text, ""), escaped), "")).otherwise(text), F.lit('"'))
