"""Scalar text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARENT_TOKEN = "<|parent of|>"
CHILD_TOKEN = "<|child of|>"
MATCH_TOKEN = "[MATCHING]"
ALL_TOKENS = (PARENT_TOKEN, CHILD_TOKEN)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_key(name: Column | str) -> Column:
    """Lower case, letters and digits only: the key under which two names are the same."""
    return F.lower(F.regexp_replace(_c(name), "[^a-zA-Z0-9]", ""))


def without_spaces(name: Column | str) -> Column:
    return F.replace(F.lower(_c(name)), F.lit(" "), F.lit(""))


def is_ascii(text: Column | str) -> Column:
    return _c(text).rlike(r"\A[\x00-\x7F]*\z")


def sentence_name(domain: Column | str, name: Column | str) -> Column:
    return F.concat(_c(domain), F.lit(": "), _c(name))


def add_token(token: str, text: Column | str, space: bool = True) -> Column:
    return F.concat(F.lit(token + " " * space), _c(text))


def strip_prefix(text: Column | str) -> Column:
    """Removes one leading <|...|> token and the blanks around the rest."""
    return F.trim(F.regexp_replace(_c(text), r"^<\|[^|]+\|>", ""))


def after_colon(text: Column | str) -> Column:
    """What follows the first colon, trimmed; the whole text without one."""
    return F.trim(F.element_at(F.split(_c(text), ":", 2), -1))


def truncated(text: Column | str, most: int = 30) -> Column:
    return F.when(F.char_length(_c(text)) > most, F.concat(F.substring(_c(text), 1, most - 3), F.lit("..."))).otherwise(_c(text))


def from_place(text: Column | str, n: int) -> Column:
    """What follows the first n characters."""
    return F.substring(_c(text), n + 1, 2147483647 - n)


def first_character(text: Column | str) -> Column:
    return F.substring(_c(text), 1, 1)


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(F.trim(_c(a))) == F.lower(F.trim(_c(b)))


def non_word_stripped(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\W+", "")


def integer_suffix(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), r"([0-9]+)$", 1).try_cast("bigint")


def tolerant_id(text: Column | str) -> Column:
    """An id from free text: whole numbers exactly, other numbers truncated, anything else null."""
    return F.coalesce(F.trim(_c(text)).try_cast("bigint"), F.trim(_c(text)).try_cast("double").try_cast("bigint"))


def seeded_order(seed: int, *keys: Column | str) -> Column:
    """A reproducible random order: the md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))


def bytes_text(size: Column | str) -> Column:
    """A number of bytes for a reader: two digits after the point and the largest unit that leaves 1 or more, B to PB."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    text = lambda i: F.format_string(f"%.2f {units[i]}", F.round(_c(size).cast("double") / 1024**i, 2))
    out = F.when(_c(size) < 1024, text(0))
    for i in range(1, len(units) - 1):
        out = out.when(_c(size) < 1024 ** (i + 1), text(i))
    return out.otherwise(F.when(_c(size).isNotNull(), text(len(units) - 1)))


def bytes_label(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PB"
