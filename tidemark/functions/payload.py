"""Rows to JSON payloads and back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAG = "map<string, variant>"


def payload(columns: Iterable[str], as_text: Iterable[str] = ()) -> Column:
    """JSON of the columns, nulls written out; those of ``as_text`` go as strings."""
    texts = set(as_text)
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c in texts else F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def merged(old: Column, new: Column) -> Column:
    """Top-level merge: the new value of a key wins, keys that only the old has stay.

    Duplicate keys are dropped from the old side first, so that no session
    setting is needed. A blank or malformed old payload counts as empty.
    """
    had, has = (F.coalesce(F.from_json(x, BAG), F.from_json(F.lit("{}"), BAG)) for x in (old, new))
    left = F.map_filter(had, lambda k, _: ~F.map_contains_key(has, k))
    return F.to_json(F.map_concat(left, has), {"ignoreNullFields": "false"})


def parsed(text: Column, schema: T.StructType, defaults: dict[str, Column] | None = None) -> Column:
    """A payload as a struct: unknown keys are left out, missing ones take the default."""
    row = F.from_json(text, schema)
    return F.struct(*[F.coalesce(row[f.name], defaults[f.name]).alias(f.name) if defaults and f.name in defaults else row[f.name].alias(f.name) for f in schema])


def quoted(text: Column) -> Column:
    """A text as a JSON string, whatever it holds."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def messages(pairs: Column) -> Column:
    """An array of structs (name, message) as a JSON object in that order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e["name"]), F.lit(": "), quoted(e["message"]))), ", "), F.lit("}"))
