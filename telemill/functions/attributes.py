"""Typed reads of attributes, text cleaning, and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attr(attrs: Column | str, *path: str) -> Column:
    """Text of the attribute at ``path`` (names may hold dots), null if absent; '' counts as absent."""
    c = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.nullif(F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path)), F.lit(""))


def variant_string(v: Column, name: str | None = None) -> Column:
    """A string attribute of a VARIANT, or the string that it is; a value of another type gives null."""
    path = "$" if name is None else f"$['{name}']"
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def variant_number(v: Column, name: str, kind: str = "double") -> Column:
    """A number attribute: numbers, and strings that hold one; integers cut fractions off."""
    path = f"$['{name}']"
    text = F.try_variant_get(v, path, "string")
    number = text.try_cast("double")
    if kind == "double":
        return number
    whole = text.try_cast("bigint")
    return F.coalesce(whole, F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint"))


def variant_bool(v: Column, name: str) -> Column:
    """A boolean attribute: booleans, and the strings true and false."""
    text = F.lower(F.try_variant_get(v, f"$['{name}']", "string"))
    return F.when(text == "true", True).when(text == "false", False)


def string_like(v: Column, name: str) -> Column:
    """Text of a string, number or boolean attribute; numbers without an exponent and without closing zeros."""
    path = f"$['{name}']"
    text = F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    plain = F.when(text.rlike("[eE]"), F.coalesce(text.try_cast("decimal(38,10)").cast("string"), text)).otherwise(text)
    short = F.when(plain.rlike(r"^-?[0-9]+\.[0-9]*$"), F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)
    return F.when(kind.isin("STRING", "BOOLEAN"), text).otherwise(short)


def clean_text(c: Column) -> Column:
    """NUL and invalid UTF-8 become the replacement character."""
    return F.replace(F.make_valid_utf8(c), F.lit("\x00"), F.lit("�"))


def clean_json(c: Column) -> Column:
    """The same over a JSON body: NUL escapes, wherever a value holds them."""
    return F.regexp_replace(clean_text(c), r"(?<!\\)((?:\\\\)*)\\u0000", "$1�")


def clean_number(c: Column) -> Column:
    """A number as text that JSON can hold: NaN and the infinities as strings."""
    return F.when(F.isnan(c), F.lit('"NaN"')).when(c == float("inf"), F.lit('"+Inf"')).when(c == float("-inf"), F.lit('"-Inf"')).otherwise(c.cast("string"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys at every level and no blanks; what is no JSON stays as it is."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return x

    return texts.map(one)


def canonical_map(m: Column) -> Column:
    """Canonical JSON of a flat map of strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def base_name(path: Column) -> Column:
    """Last part of a path: closing slashes off, ``/`` for the root, null for empty."""
    cut = F.regexp_replace(path, r"/+$", "")
    return F.when(path == "", None).when(cut == "", "/").otherwise(F.element_at(F.split(cut, "/"), -1))
