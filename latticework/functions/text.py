"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation and the ellipsis.
PUNCTUATION = r"^[!-/:-@\[-`{-~…]+$"


def matches_at_start(text: Column | str, pattern: str) -> Column:
    return F.rlike(text, F.lit(f"^(?:{pattern})"))


def is_punctuation(text: Column | str) -> Column:
    """Whether all of a text, one character at least, is punctuation."""
    return F.rlike(text, F.lit(PUNCTUATION))


def without_pound(text: Column | str) -> Column:
    """Drops one leading ``#``; an empty text stays empty."""
    return F.regexp_replace(text, "^#", "")


def joined(items: Column, separator: str = " ") -> Column:
    """Elements as text with a separator, nulls left out but for a leading one, which reads None; null for an empty array."""
    texts = F.transform(items, lambda x: x.cast("string"))
    first = F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit("None"))
    rest = F.filter(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), lambda x: x.isNotNull())
    return F.when(F.size(items) > 0, F.array_join(F.concat(F.array(first), rest), separator))


def file_name(path: Column | str, with_suffix: bool = True) -> Column:
    """Last item of a path behind ``/``, or null without one; without suffix: up to its first dot."""
    path = F.col(path) if isinstance(path, str) else path
    last = F.substring_index(path, "/", -1)
    return F.when(F.contains(path, F.lit("/")), last if with_suffix else F.substring_index(last, ".", 1))


def converted(text: Column | str, kind: str) -> Column:
    """A text as int, long or float (a double), or as it is for any other kind; null if it can't be read as that."""
    text = F.col(text) if isinstance(text, str) else text
    target = {"int": "int", "long": "long", "float": "double"}.get(kind)
    return text.try_cast(target) if target else text
