"""Free-form JSON metadata: typed access through VARIANT, speakers, and flat values for a store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeloom.functions.text import filled, strip

#: Speaker values that name nobody. Fixed value.
NOBODY = ("unknown", "multiple", "mixed")


def field(metadata: Column, key: str) -> Column:
    """The VARIANT at a key: null if the key is absent, a JSON null if it is null."""
    return F.try_variant_get(metadata, f"$.{key}", "variant")


def is_kind(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def text_of(value: Column) -> Column:
    """A value as text: null as None, booleans capitalised, nothing if the key is absent."""
    text = F.when(is_kind(value, "BOOLEAN"), F.initcap(value.cast("string"))).otherwise(value.cast("string"))
    return F.when(F.is_variant_null(value), F.lit("None")).otherwise(text)


def truthy(value: Column) -> Column:
    """False for absent keys, null, false, zero, and empty texts, lists and objects."""
    text = value.cast("string")
    empty = text.isin("", "[]", "{}") | (~is_kind(value, "STRING") & (text.isin("false") | F.coalesce(text.try_cast("double") == 0, F.lit(False))))
    return F.coalesce(value.isNotNull() & ~F.is_variant_null(value) & ~empty, F.lit(False))


def truthy_text(value: Column) -> Column:
    return F.when(truthy(value), text_of(value))


def _strings(items: Column) -> Column:
    return F.transform(F.filter(F.try_variant_get(items, "$", "array<variant>"), lambda x: is_kind(x, "STRING")), lambda x: x.cast("string"))


def listed(text: Column) -> Column:
    """Items of a text that is a strict JSON list (its strings) or else a list with commas (stripped)."""
    value = F.try_parse_json(text)
    parts = F.transform(F.split(text, ",", -1), strip)
    return F.when(text.isNotNull() & value.isNull(), parts).when(is_kind(value, "ARRAY"), _strings(value)).when(value.isNotNull(), F.array().cast("array<string>"))


def names_somebody(name: Column) -> Column:
    return (strip(name) != "") & ~F.lower(name).isin(*NOBODY)


def speakers(metadata: Column) -> Column:
    """Distinct speakers in order: the field ``speaker``, then ``speakers`` (a list, or a text with one).

    Names of nobody are told by their unstripped value; only strings count.
    """
    one, many = field(metadata, "speaker"), field(metadata, "speakers")
    first = F.when(is_kind(one, "STRING"), F.array(one.cast("string")))
    rest = F.coalesce(F.when(is_kind(many, "ARRAY"), _strings(many)), listed(F.when(is_kind(many, "STRING"), many.cast("string"))))
    none = F.array().cast("array<string>")
    found = F.filter(F.concat(F.coalesce(first, none), F.coalesce(rest, none)), lambda x: names_somebody(filled(x)))
    return F.array_distinct(F.transform(found, strip))


def flat_values(metadata: Column) -> Column:
    """A map of texts: null is empty, scalars as they are, nested values as compact JSON."""
    return F.transform_values(F.try_variant_get(metadata, "$", "map<string, variant>"), lambda k, v: F.when(v.isNull() | F.is_variant_null(v), F.lit("")).otherwise(v.cast("string")))


def ascii_only(json: Column) -> Column:
    """JSON text with every character beyond printable ASCII as its UTF-16 units, each as a backslash, u and four digits."""
    parts = F.regexp_extract_all(json, F.lit(r"([\x00-\x7e]+|[^\x00-\x7e]+)"), F.lit(1))
    units = lambda t: F.regexp_replace(F.lower(F.hex(F.encode(t, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.when(json.rlike(r"^[\x00-\x7e]*$"), json).otherwise(F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^[\x00-\x7e]"), t).otherwise(units(t))), ""))


def spaced(json: Column) -> Column:
    """Compact JSON text with a blank behind each comma and colon that is not in a string."""
    parts = F.regexp_extract_all(json, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++)'), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(t.startswith('"'), t).otherwise(F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")))), "")


def quoted(text: Column) -> Column:
    """The text as a JSON string in ASCII."""
    array = F.to_json(F.array(text))
    return ascii_only(F.substring(array, F.lit(2), F.length(array) - 2))


def flat_json(metadata: Column) -> Column:
    """Metadata (JSON text of an object) as a flat JSON object in ASCII: null becomes an empty text, nested values become texts of JSON.

    Numbers keep the form that VARIANT gives them. A null text, or one that is no object, becomes an empty object.
    """
    rows = F.map_entries(F.try_variant_get(F.try_parse_json(metadata), "$", "map<string, variant>"))
    nested = lambda v: is_kind(v, "ARRAY") | is_kind(v, "OBJECT")
    value = lambda v: F.when(v.isNull() | F.is_variant_null(v), F.lit('""')).when(nested(v), quoted(ascii_only(spaced(F.to_json(v))))).otherwise(ascii_only(F.to_json(v)))
    members = F.transform(rows, lambda e: F.concat(quoted(e["key"]), F.lit(": "), value(e["value"])))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(members, ", "), F.lit("")), F.lit("}"))
