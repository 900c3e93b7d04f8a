"""Open JSON by variants: one spelling for equal values, fields on a path, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(json: Column) -> Column:
    """One spelling of equal JSON: keys in the order of their code points at every depth, no blanks, numbers without idle zeros or a minus before zero.

    Null for text that isn't JSON or names a key twice. Numbers written with an
    exponent keep the spelling of a double.
    """
    return F.to_json(F.try_parse_json(json))


def same(a: Column, b: Column) -> Column:
    """Whether two texts are equal JSON; null if one isn't JSON."""
    return canonical(a) == canonical(b)


def payload_fingerprint(kind: Column, value: Column) -> Column:
    """Of an artifact: the digest of its kind (a plain name) and its value (JSON) in canonical spelling."""
    return F.sha2(F.concat(F.lit('{"kind":"'), kind, F.lit('","value":'), canonical(value), F.lit("}")), 256)


def has_types(json: Column, fields: dict[str, str]) -> Column:
    """Whether JSON text is an object of exactly these fields, each of its type: string, number, boolean, array, object or null, several with a bar between."""
    named = {"string": "STRING", "number": "(?:BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}
    keys = F.json_object_keys(json)
    ok = F.size(keys) == len(fields)
    for name, kinds in fields.items():
        of = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$['{name}']", "variant"))
        ok = ok & F.array_contains(keys, name) & F.coalesce(of.rlike("^(?:" + "|".join(named[k] for k in kinds.split("|")) + ")$"), F.lit("null" in kinds.split("|")))
    return F.coalesce(ok, F.lit(False))


def with_path(json: Column, path: list[str], value: Column) -> Column:
    """``json`` with ``value`` (JSON) at a path of keys, in canonical spelling. Only the last key may be new; where the way to it is missing nothing changes."""
    key, *rest = path
    fields = F.from_json(json, "map<string,variant>")
    inner = F.to_json(fields[key])
    new = with_path(inner, rest, value) if rest else value
    kept = F.map_filter(fields, lambda k, v: k != key)
    set_ = F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(new))))
    return canonical(F.when(fields.isNull() | (fields[key].isNull() if rest else F.lit(False)), json).otherwise(set_))
