"""Documents in JSON against a nested schema: the schema is compiled to one expression over VARIANT,
so a table of documents is read once, whatever the schema holds.

A schema is data, as it's read from a YAML or JSON file. A node has
  type         string, integer, number, boolean, null, date, time, enum, scalar, any, object or list; or a list of these
  required     whether the field must be there
  required_if  {path, and equals | values | contains_any | present}: must be there if the value at path is so.
               path starts at the object that holds the field; with scope: container_parent, at the
               object that holds that one
  non_empty    no empty text, list or object
  values       what an enum (or other scalar) may be
  min, max     bounds of a number
  max_items, min_items
  of           the schema of a list's items
  fields       an object's fields by name; others are unknown, unless
  additional   gives the schema of all others
  field_sets   the fields of an object must be exactly one of these sets
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<path:string,rule:string>>"


def violations(docs: DataFrame, key: str, json_col: str, schema: dict) -> DataFrame:
    """key, path, rule: everything in which a document differs from the schema. A null text is 'missing',
    one that is no JSON 'malformed'; both at the root."""
    parsed = docs.select(key, F.col(json_col).isNull().alias("_none"), F.try_parse_json(json_col).alias("_v"))
    v = F.col("_v")
    whole = F.when(F.col("_none"), _found(F.lit("$"), "missing")).when(v.isNull(), _found(F.lit("$"), "malformed")).otherwise(_check(schema, v, F.lit("$"), []))
    return parsed.select(key, F.inline(whole))


def _found(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))).cast(FOUND)


def _none() -> Column:
    return F.array().cast(FOUND)


def _if(broken: Column, path: Column, rule: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), _found(path, rule)).otherwise(_none())


def _at(v: Column, *names: str) -> Column:
    """The value under these names; null if it isn't there."""
    return F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in names), "variant")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is(v: Column, kind: str) -> Column:
    if kind == "any":
        return F.lit(True)
    if kind == "object":
        return _entries(v).isNotNull()
    if kind == "list":
        return _items(v).isNotNull()
    said = F.schema_of_variant(v)
    number = said.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(said, F.lit("DECIMAL"))
    return {
        "string": said == "STRING",
        "date": (said == "STRING") & _text(v).rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "time": (said == "STRING") & _text(v).rlike(r"^\d{2}:\d{2}(:\d{2})?$"),
        "integer": said == "BIGINT",
        "number": number,
        "boolean": said == "BOOLEAN",
        "null": said == "VOID",
        "enum": (said == "STRING") | number | (said == "BOOLEAN"),
        "scalar": (said == "STRING") | number | (said == "BOOLEAN"),
    }[kind]


def _holds(condition: dict, scopes: list[Column]) -> Column:
    """Whether the condition of a required_if holds; scopes: the objects around the field, the nearest last."""
    place = -2 if condition.get("scope") == "container_parent" else -1
    if len(scopes) < -place:
        return F.lit(False)
    v = _at(scopes[place], *condition["path"].split("."))
    there = v.isNotNull() & ~F.is_variant_null(v)
    if "equals" in condition:
        return there & (_text(v) == str(condition["equals"]))
    if "values" in condition:
        return there & _text(v).isin(*map(str, condition["values"]))
    if "contains_any" in condition:
        return there & reduce(lambda a, b: a | b, [F.contains(_text(v), F.lit(w)) for w in condition["contains_any"]])
    return there if condition.get("present", True) else ~there


def _check(node: dict, v: Column, path: Column, scopes: list[Column]) -> Column:
    """What is wrong with a value that is there."""
    kinds = node.get("type", "any")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    fits = reduce(lambda a, b: a | b, [_is(v, k) for k in kinds])
    found = []
    if node.get("non_empty"):
        found.append(_if((F.trim(_text(v)) == "") | (F.size(_items(v)) == 0) | (F.size(_entries(v)) == 0), path, "non_empty"))
    if "values" in node:
        found.append(_if(~_text(v).isin(*map(str, node["values"])), path, "enum"))
    number = F.try_variant_get(v, "$", "double")
    for name, broken in (("min", lambda b: number < b), ("max", lambda b: number > b), ("min_items", lambda b: F.size(_items(v)) < b), ("max_items", lambda b: F.size(_items(v)) > b)):
        if name in node:
            found.append(_if(broken(node[name]), path, name))
    if "of" in node:
        each = F.transform(_items(v), lambda x, i: _check(node["of"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), scopes))
        found.append(F.coalesce(F.flatten(each), _none()))
    if "object" in kinds and ("fields" in node or "additional" in node):
        found.append(F.when(_entries(v).isNotNull(), _object(node, v, path, scopes)).otherwise(_none()))
    inside = F.concat(*found) if found else _none()
    return F.when(fits, inside).otherwise(_found(path, "type"))


def _object(node: dict, v: Column, path: Column, scopes: list[Column]) -> Column:
    fields, found = node.get("fields", {}), []
    below = lambda name: F.concat(path, F.lit("."), name if isinstance(name, Column) else F.lit(name))
    names = F.map_keys(_entries(v))
    declared = F.array(*map(F.lit, fields)).cast("array<string>")
    if "additional" in node:
        others = F.filter(F.map_entries(_entries(v)), lambda e: ~F.array_contains(declared, e["key"]))
        found.append(F.flatten(F.transform(others, lambda e: _check(node["additional"], e["value"], below(e["key"]), [*scopes, v]))))
    else:
        unknown = F.array_sort(F.array_except(names, declared))
        found.append(F.transform(unknown, lambda n: F.struct(below(n).alias("path"), F.lit("unknown_field").alias("rule"))))
    if "field_sets" in node:
        fits = reduce(lambda a, b: a | b, [F.array_sort(names) == F.array(*map(F.lit, sorted(s))) for s in node["field_sets"]])
        found.append(_if(~fits, path, "field_set"))
    for name, field in fields.items():
        inner = _at(v, name)
        rule = _none()
        if field.get("required"):
            rule = _found(below(name), "required")
        elif "required_if" in field:
            rule = _if(_holds(field["required_if"], [*scopes, v]), below(name), "required_if")
        found.append(F.when(inner.isNull(), rule).otherwise(_check(field, inner, below(name), [*scopes, v])))
    return F.concat(*found)
