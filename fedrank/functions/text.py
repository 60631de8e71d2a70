"""Text columns: entities, tags, tokens, overlap, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules

#: White space of any script, and the byte-order mark; fixed values.
BLANK = r"[\s   -     　﻿]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{BLANK}+", " "))


def decode_entities(text: Column) -> Column:
    """The entity of the zero-width space goes; six entities are decoded, ``&amp;`` first, so a doubly encoded one is decoded twice; runs of white space are one blank."""
    out = F.regexp_replace(text, "(?i)&#x200B;", "")
    for name, plain in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " ")):
        out = F.regexp_replace(out, f"(?i)&{name};", plain)
    return trim(F.regexp_replace(out, BLANK + "{2,}", " "))


def strip_html(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", " "))


def keyword_tokens(query: Column) -> Column:
    """Lower-cased alphanumeric words of three letters or more that are no stop words; repeated ones stay."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(rules.STOP_WORDS))


def overlap(text: Column, tokens: Column, weight: int) -> Column:
    """``weight`` for each token that occurs anywhere in the text, also within words."""
    return F.size(F.filter(tokens, lambda t: F.contains(text, t))) * weight


def truncate(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != ""))


def normalise_content(text: Column, most: int = 50_000) -> Column:
    """Page text with at most one empty line in a row, trimmed and cut."""
    return truncate(trim(F.regexp_replace(text, "\n{3,}", "\n\n")), most)


def cache_key(query: Column, engines: Column, limit: Column) -> Column:
    """Query without outer blanks in lower case, sorted engines or ``all``, and limit."""
    names = F.when(engines.isNull(), "all").otherwise(F.array_join(F.array_sort(engines), ","))
    return F.concat_ws("|", F.lower(trim(query)), names, limit.cast("string"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def filled(*parts: Column) -> list[Column]:
    """Empty strings as nulls, for concat_ws and coalesce."""
    return [F.when(p != "", p) for p in parts]
