"""Text predicates and names as Column expressions; all of them take null as an empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java character class. Fixed value.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: A text asks for its source if it holds a request and a thing asked for, or a phrase that needs none. Fixed values.
REQUESTS = ("please provide", "please share", "send me")
THINGS = ("transcript", "source text", "source material", "podcast text", "material")
PHRASES = ("once shared", "once you share", "when you provide")
DEFAULT_SLUG, DEFAULT_FOLDER = "podcast", "Podcast Export"


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(filled(text), f"^{WHITE}+|{WHITE}+$", "")


def compact(text: Column) -> Column:
    """Stripped, with each run of white space as one blank."""
    return F.trim(F.regexp_replace(filled(text), f"{WHITE}+", " "))


def has_text(text: Column) -> Column:
    return compact(text) != ""


def or_default(text: Column, default: str) -> Column:
    """``default`` where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def asks_for_source(text: Column) -> Column:
    """Whether a generated text asks for its source instead of summing it up."""
    low = F.lower(compact(text))
    return (_any(low, REQUESTS) & _any(low, THINGS)) | _any(low, PHRASES)


def slug(name: Column) -> Column:
    """Letters and digits in lower case, each other run one dash, none at the ends; never empty."""
    dashed = F.regexp_replace(filled(name), r"[^\p{L}\p{N}]+", "-")
    low = F.array_join(F.transform(F.split(dashed, ""), F.lower), "")  # letter by letter: no final sigma
    return or_default(F.btrim(low, F.lit("-")), DEFAULT_SLUG)


def folder_name(name: Column) -> Column:
    """A name without characters that file systems refuse; never empty."""
    return or_default(compact(F.regexp_replace(filled(name), r'[<>:"/\\|?*\x00-\x1f]+', " ")), DEFAULT_FOLDER)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent_name(path: Column) -> Column:
    """The name of the folder that a path's last part is in; empty if there is none."""
    return F.regexp_extract(filled(path), r"([^/]+)/+[^/]+/*$", 1)


def named(name: Column) -> Column:
    """(id, name) of a speaker."""
    return F.struct(slug(name).alias("id"), name.alias("name"))
