"""Typed look-ups in JSON documents: a missing field, a JSON null and a wrong type are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """VARIANT; null where the text is no JSON, has a key twice or a NaN."""
    return F.try_parse_json(text)


def _step(path: str) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))


def lookup(v: Column, path: str) -> Column:
    """The variant at a dotted path; SQL null if missing, a variant null if null."""
    return F.try_variant_get(v, _step(path), "variant")


def is_object(v: Column) -> Column:
    """False for every other kind, and where there is nothing. An object fits a struct without fields, so nothing of it is copied."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def kind(v: Column) -> Column:
    """The JSON kind: OBJECT, ARRAY, STRING, BOOLEAN, NUMBER, NULL, or MISSING. What lies inside an object or a list is not looked at."""
    return (
        F.when(v.isNull(), "MISSING").when(F.is_variant_null(v), "NULL").when(is_object(v), "OBJECT").when(elements(v).isNotNull(), "ARRAY")
        .otherwise(F.coalesce(F.element_at(F.create_map(F.lit("STRING"), F.lit("STRING"), F.lit("BOOLEAN"), F.lit("BOOLEAN")), F.schema_of_variant(v)), F.lit("NUMBER")))
    )


def text(v: Column) -> Column:
    """The value of a JSON string; null for any other kind."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def elements(v: Column) -> Column:
    """array<variant> of a JSON array; null for any other kind."""
    return F.try_variant_get(v, "$", "array<variant>")
