"""JSON Schema as column predicates over VARIANT: a row for each rule that a document breaks.

Known words: type, enum, const, required, properties, additionalProperties (false), items, minItems,
minLength, pattern, minimum, maximum, dependentRequired, not, if/then/else, allOf. A schema is
compiled once to one expression a rule, nested arrays by exists(), so a table is checked in one pass
without Python. Words that aren't known raise.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about a document.
NOTES = {"$schema", "$id", "title", "description", "default", "examples", "$comment"}

Rule = tuple[str, Callable[[Column], Column]]


def _get(value: Column, name: str) -> Column:
    """A field of an object, null if it isn't there; a JSON null is a value."""
    return F.try_variant_get(value, f"$[{json.dumps(name)}]".replace('"', "'") if "'" not in name else f'$["{name}"]', "variant")


#: Types of a JSON value by the schema that Spark tells of it.
_KINDS = {"null": "VOID", "string": "STRING", "boolean": "BOOLEAN", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT", "object": "OBJECT.*", "array": "ARRAY.*"}


def _is(value: Column, names: list[str]) -> Column:
    """Whether value is of one of the types; its schema, as long as the value is, is made once a test."""
    return F.schema_of_variant(value).rlike(f"(?s)^(?:{'|'.join(_KINDS[n] for n in names)})$")


def _when(kinds: list[str], test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rule that only values of some kinds can break."""
    return lambda v: F.coalesce(_is(v, kinds) & test(v), F.lit(False))


def _broken(rules: list[Rule]) -> Callable[[Column], Column]:
    return lambda v: F.coalesce(F.lit(False) if not rules else _any([test(v) for _, test in rules]), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def rules(schema: dict, path: str = "$") -> list[Rule]:
    """(name, test) of each rule of a schema; a test is true of a value that breaks it."""
    out: list[Rule] = []
    add = lambda word, test: out.append((f"{path} {word}", test))
    number = lambda v: F.try_variant_get(v, "$", "double")
    text = lambda v: F.try_variant_get(v, "$", "string")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    for word, said in schema.items():
        if word in NOTES or word in ("then", "else"):
            continue
        if word == "type":
            names = [said] if isinstance(said, str) else said
            add("type", lambda v, names=names: ~_is(v, names))
        elif word in ("enum", "const"):
            given = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in (said if word == "enum" else [said])]
            add(word, lambda v, given=given: ~F.to_json(v).isin(*given))
        elif word == "required":
            for name in said:
                add(f"required {name}", _when(["object"], lambda v, name=name: _get(v, name).isNull()))
        elif word == "dependentRequired":
            for name, others in said.items():
                for other in others:
                    add(f"{name} requires {other}", _when(["object"], lambda v, name=name, other=other: _get(v, name).isNotNull() & _get(v, other).isNull()))
        elif word == "properties":
            for name, sub in said.items():
                for label, test in rules(sub, f"{path}.{name}"):
                    # absent fields break nothing but `required`
                    out.append((label, _when(["object"], lambda v, name=name, test=test: _get(v, name).isNotNull() & F.coalesce(test(_get(v, name)), F.lit(False)))))
        elif word == "additionalProperties":
            if said is not False:
                raise ValueError(f"{path}: additionalProperties must be false")
            names = list(schema.get("properties", {}))
            known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
            add("additionalProperties", _when(["object"], lambda v, known=known: F.size(F.array_except(F.json_object_keys(F.to_json(v)), known)) > 0))
        elif word == "items":
            for label, test in rules(said, f"{path}[]"):
                out.append((label, _when(["array"], lambda v, test=test: F.exists(items(v), lambda e: F.coalesce(test(e), F.lit(False))))))
        elif word in ("minItems", "maxItems"):
            add(word, _when(["array"], lambda v, word=word, said=said: F.size(items(v)) < said if word == "minItems" else F.size(items(v)) > said))
        elif word == "minLength":
            add(word, _when(["string"], lambda v, said=said: F.length(text(v)) < said))
        elif word == "pattern":
            add(word, _when(["string"], lambda v, said=said: ~text(v).rlike(said)))
        elif word in ("minimum", "maximum"):
            add(word, _when(["number"], lambda v, word=word, said=said: number(v) < said if word == "minimum" else number(v) > said))
        elif word == "not":
            inner = _broken(rules(said, path))
            add("not", lambda v, inner=inner: ~inner(v))
        elif word == "allOf":
            for sub in said:
                out += rules(sub, path)
        elif word == "if":
            met = _broken(rules(said, path))
            for branch, holds in (("then", False), ("else", True)):
                for label, test in rules(schema.get(branch, {}), path):
                    out.append((f"{label} ({branch})", lambda v, met=met, test=test, holds=holds: (met(v) == F.lit(holds)) & test(v)))
        else:
            raise ValueError(f"{path}: unknown word {word!r}")
    return out


def violations(rows: DataFrame, schema: dict, key: str, document: str = "document") -> DataFrame:
    """key, rule of every rule of the schema that a row's document, a JSON text, breaks; texts that aren't JSON break the rule 'not JSON'."""
    value = rows.select(F.col(key), F.try_parse_json(F.col(document)).alias("__v"))
    named = rules(schema)
    # columns of one projection share what they have in common, such as a value's type; parts of one array don't
    found = value.select(key, F.col("__v").isNull().alias("__none"), *(F.coalesce(test(F.col("__v")), F.lit(False)).alias(f"__r{i}") for i, (_, test) in enumerate(named)))
    tests = [F.when(F.col("__none"), F.lit("not JSON"))] + [F.when(~F.col("__none") & F.col(f"__r{i}"), F.lit(name)) for i, (name, _) in enumerate(named)]
    return found.select(key, F.explode(F.array_compact(F.array(*tests))).alias("rule"))
