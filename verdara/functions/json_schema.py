"""JSON Schema to Catalyst: a schema document becomes one Column that lists what a JSON text breaks, and where.

The text is parsed once, to a VARIANT; each keyword is an expression on it, so nothing but built-ins runs for a row.

Keywords: type, enum, const, required, properties, additionalProperties, items, minItems, maxItems, uniqueItems, pattern,
minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, format (date-time, date, uuid), allOf, anyOf,
oneOf, not, local $ref. Others that only describe are passed over; what would constrain and isn't known here is an error
when the schema is compiled, not a rule that is silently left out.

A problem is `path: keyword`, the path in the manner `$.scenes[2].assets`; they come in the order of the schema. A text that
is no JSON, or NULL, has the one problem `$: not json`. Whole numbers are integers however they are written, so 1.0 is one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdara.functions.geo import let

#: Keywords that constrain nothing.
DESCRIPTIVE = {"$schema", "$id", "$defs", "$comment", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
# Texts of formats.
FORMATS = {"uuid": "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"}

_NONE = "array<string>"


def _list(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(_NONE) if found else F.array().cast(_NONE)


def _kind(v: Column) -> Column:
    """The JSON type of a variant."""
    name = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "double")
    number = F.when(whole == F.floor(whole), "integer").otherwise("number")
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "BIGINT", "integer").otherwise(number)
    )


class _Compiler:
    def __init__(self, root: dict) -> None:
        self.root = root

    def resolved(self, ref: str, seen: tuple[str, ...]) -> dict:
        if not ref.startswith("#") or ref in seen:
            raise ValueError(f"only local references that don't return to themselves can be compiled: {ref}")
        at = self.root
        for part in ref.removeprefix("#").strip("/").split("/"):
            at = at[part.replace("~1", "/").replace("~0", "~")] if part else at
        return at

    def check(self, schema: dict | bool, v: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """The problems of a variant that is there."""
        if isinstance(schema, bool):
            return _list() if schema else _list(F.concat(path, F.lit(": not allowed")))
        rest = dict(schema)
        parts: list[Column] = []
        if ref := rest.pop("$ref", None):
            parts.append(self.check(self.resolved(ref, seen), v, path, (*seen, ref)))
        for name in DESCRIPTIVE:
            rest.pop(name, None)

        def rules(kind: Column) -> Column:
            made = [*parts]
            for name in list(rest):
                rule: Callable | None = getattr(self, "_" + name.replace("-", "_"), None)
                if rule is None and name != "additionalProperties":
                    raise ValueError(f"the keyword {name} isn't known")
                if rule is not None:
                    made.append(rule(rest[name], v, kind, path, seen))
            if "additionalProperties" in rest:
                made.append(self.additional(rest, v, kind, path, seen))
            return F.flatten(F.array(*made)) if made else _list()

        return let(_kind(v), rules) if rest else (F.flatten(F.array(*parts)) if parts else _list())

    def _fails(self, bad: Column, path: Column, word: str) -> Column:
        return _list(F.when(F.coalesce(bad, F.lit(False)), F.concat(path, F.lit(f": {word}"))))

    # -- any value ---------------------------------------------------------------------------------------
    def _type(self, want, v, kind, path, seen):
        names = [want] if isinstance(want, str) else list(want)
        return self._fails(~kind.isin(*names, *(["integer"] if "number" in names else [])), path, "type")

    def _same(self, v: Column, kind: Column, value) -> Column:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(value))
        return F.to_json(v) == json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)

    def _const(self, value, v, kind, path, seen):
        return self._fails(~F.coalesce(self._same(v, kind, value), F.lit(False)), path, "const")

    def _enum(self, values, v, kind, path, seen):
        any_ = F.lit(False)
        for value in values:
            any_ |= F.coalesce(self._same(v, kind, value), F.lit(False))
        return self._fails(~any_, path, "enum")

    # -- strings and numbers -----------------------------------------------------------------------------
    def _text(self, bad: Callable[[Column], Column], v, kind, path, word):
        return self._fails((kind == "string") & bad(F.try_variant_get(v, "$", "string")), path, word)

    def _pattern(self, pattern, v, kind, path, seen):
        return self._text(lambda t: ~t.rlike(pattern), v, kind, path, "pattern")

    def _minLength(self, n, v, kind, path, seen):  # noqa: N802  named as the keyword
        return self._text(lambda t: F.char_length(t) < n, v, kind, path, "minLength")

    def _maxLength(self, n, v, kind, path, seen):  # noqa: N802
        return self._text(lambda t: F.char_length(t) > n, v, kind, path, "maxLength")

    def _format(self, name, v, kind, path, seen):
        if name not in FORMATS:
            return _list()  # the standard lets unknown formats pass
        real = lambda t: t.try_cast("timestamp").isNull() if name != "uuid" else F.lit(False)
        return self._text(lambda t: ~t.rlike(FORMATS[name]) | real(t), v, kind, path, "format")

    def _number(self, bad: Callable[[Column], Column], v, kind, path, word):
        return self._fails(kind.isin("integer", "number") & bad(F.try_variant_get(v, "$", "double")), path, word)

    def _minimum(self, n, v, kind, path, seen):
        return self._number(lambda x: x < n, v, kind, path, "minimum")

    def _maximum(self, n, v, kind, path, seen):
        return self._number(lambda x: x > n, v, kind, path, "maximum")

    def _exclusiveMinimum(self, n, v, kind, path, seen):  # noqa: N802
        return self._number(lambda x: x <= n, v, kind, path, "exclusiveMinimum")

    def _exclusiveMaximum(self, n, v, kind, path, seen):  # noqa: N802
        return self._number(lambda x: x >= n, v, kind, path, "exclusiveMaximum")

    # -- arrays ------------------------------------------------------------------------------------------
    def _elements(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def _minItems(self, n, v, kind, path, seen):  # noqa: N802
        return self._fails((kind == "array") & (F.size(self._elements(v)) < n), path, "minItems")

    def _maxItems(self, n, v, kind, path, seen):  # noqa: N802
        return self._fails((kind == "array") & (F.size(self._elements(v)) > n), path, "maxItems")

    def _uniqueItems(self, on, v, kind, path, seen):  # noqa: N802
        texts = F.transform(self._elements(v), lambda e: F.to_json(e))
        return self._fails((kind == "array") & (F.size(F.array_distinct(texts)) < F.size(texts)) & F.lit(bool(on)), path, "uniqueItems")

    def _items(self, schema, v, kind, path, seen):
        each = F.transform(self._elements(v), lambda e, i: self.check(schema, e, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen))
        return F.when(kind == "array", F.flatten(each)).otherwise(_list())

    # -- objects -----------------------------------------------------------------------------------------
    def _fields(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "map<string,variant>")

    def _required(self, names, v, kind, path, seen):
        lost = [F.when((kind == "object") & ~F.map_contains_key(self._fields(v), n), F.concat(path, F.lit(f".{n}: required"))) for n in names]
        return _list(*lost)

    def _properties(self, schemas, v, kind, path, seen):
        def of(name: str, schema) -> Column:
            own = lambda field: F.when(field.isNotNull(), self.check(schema, field, F.concat(path, F.lit(f".{name}")), seen)).otherwise(_list())
            return let(F.try_element_at(self._fields(v), F.lit(name)), own)

        made = F.flatten(F.array(*[of(n, s) for n, s in schemas.items()])) if schemas else _list()
        return F.when(kind == "object", made).otherwise(_list())

    def additional(self, whole, v, kind, path, seen):
        """Fields that `properties` doesn't name."""
        known = list(whole.get("properties", {}))
        more = F.filter(F.array_sort(F.map_keys(self._fields(v))), lambda k: ~k.isin(*known)) if known else F.array_sort(F.map_keys(self._fields(v)))
        each = F.transform(more, lambda k: self.check(whole["additionalProperties"], F.element_at(self._fields(v), k), F.concat(path, F.lit("."), k), seen))
        return F.when(kind == "object", F.flatten(each)).otherwise(_list())

    # -- combinations ------------------------------------------------------------------------------------
    def _allOf(self, schemas, v, kind, path, seen):  # noqa: N802
        return F.flatten(F.array(*[self.check(s, v, path, seen) for s in schemas]))

    def _passing(self, schemas, v, path, seen) -> Column:
        return sum((F.size(self.check(s, v, path, seen)) == 0).cast("int") for s in schemas)

    def _anyOf(self, schemas, v, kind, path, seen):  # noqa: N802
        return self._fails(self._passing(schemas, v, path, seen) == 0, path, "anyOf")

    def _oneOf(self, schemas, v, kind, path, seen):  # noqa: N802
        return self._fails(self._passing(schemas, v, path, seen) != 1, path, "oneOf")

    def _not(self, schema, v, kind, path, seen):
        return self._fails(F.size(self.check(schema, v, path, seen)) == 0, path, "not")


def problems(text: Column, schema: dict) -> Column:
    """What the JSON `text` breaks of a schema, an array of texts; empty if it is sound."""
    compiler = _Compiler(schema)
    found = lambda v: F.when(v.isNull(), _list(F.lit("$: not json"))).otherwise(compiler.check(schema, v, F.lit("$")))
    return let(F.try_parse_json(text), found)
