"""Compiled JSON Schemas against what each keyword says."""

import json

import pytest
from pyspark.sql import functions as F

from verdara.functions import json_schema

SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "title": "a record", "type": "object", "required": ["id", "scenes"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "format": "uuid"}, "kind": {"enum": ["ndvi", 3, None, {"a": 1}]}, "version": {"const": "2.0.0"}, "share": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 100},
        "at": {"type": "string", "format": "date-time"}, "count": {"type": "integer"}, "name": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-zé]+$"},
        "scenes": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"$ref": "#/$defs/scene"}},
        "either": {"oneOf": [{"type": "string"}, {"type": "integer"}, {"type": "number"}], "not": {"const": "no"}},
    },
    "$defs": {"scene": {"type": "object", "required": ["item"], "properties": {"item": {"type": "string"}, "bands": {"type": "object", "additionalProperties": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}}},
}
GOOD = {"id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "scenes": [{"item": "a"}]}
CASES = [
    (GOOD, []),
    ({**GOOD, "kind": None, "share": 99.9, "at": "2024-01-01T00:00:00Z", "count": 2.0, "name": "abé", "version": "2.0.0", "either": "x"}, []),
    ({**GOOD, "kind": 3.0, "share": None, "scenes": [{"item": "a", "bands": {"x": None, "y": "z"}}, {"item": "b"}]}, []),
    ({**GOOD, "kind": {"a": 1}, "either": 1.5}, []),
    ({}, ["$.id: required", "$.scenes: required"]),
    ([], ["$: type"]),
    (None, ["$: type"]),
    ({**GOOD, "id": "no"}, ["$.id: format"]),
    ({**GOOD, "id": 7}, ["$.id: type"]),
    ({**GOOD, "kind": "other"}, ["$.kind: enum"]),
    ({**GOOD, "version": 2}, ["$.version: const"]),
    ({**GOOD, "share": -1}, ["$.share: minimum"]),
    ({**GOOD, "share": 100}, ["$.share: exclusiveMaximum"]),
    ({**GOOD, "share": "5"}, ["$.share: type"]),
    ({**GOOD, "at": "2024-13-01T00:00:00Z"}, ["$.at: format"]),
    ({**GOOD, "at": "yesterday"}, ["$.at: format"]),
    ({**GOOD, "count": 2.5}, ["$.count: type"]),
    ({**GOOD, "name": "é"}, ["$.name: minLength"]),
    ({**GOOD, "name": "ABCDE"}, ["$.name: maxLength", "$.name: pattern"]),
    ({**GOOD, "scenes": []}, ["$.scenes: minItems"]),
    ({**GOOD, "scenes": [{"item": "a"}] * 4}, ["$.scenes: maxItems", "$.scenes: uniqueItems"]),
    ({**GOOD, "scenes": [{"item": "a"}, {}, {"item": 5, "bands": {"r": 1, "g": "x"}}]}, ["$.scenes[1].item: required", "$.scenes[2].item: type", "$.scenes[2].bands.r: anyOf"]),
    ({**GOOD, "scenes": {"item": "a"}}, ["$.scenes: type"]),
    ({**GOOD, "either": 1}, ["$.either: oneOf"]),
    ({**GOOD, "either": "no"}, ["$.either: not"]),
    ({**GOOD, "extra": 1, "also": 2}, ["$.also: not allowed", "$.extra: not allowed"]),
]


def test_every_keyword(spark):
    texts = [(json.dumps(c, ensure_ascii=False),) for c, _ in CASES] + [("{",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").coalesce(1).select(json_schema.problems(F.col("t"), SCHEMA)).collect()]
    for (case, want), found in zip(CASES, got, strict=False):
        assert sorted(found) == sorted(want), case
    assert got[len(CASES) :] == [["$: not json"]] * 3


def test_what_cannot_be_compiled_is_an_error(spark):
    for bad in ({"patternProperties": {}}, {"$ref": "https://example.org/x"}, {"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}):
        with pytest.raises(ValueError):
            json_schema.problems(F.lit("1"), bad)
    one, two = spark.range(1).select(json_schema.problems(F.lit("1"), {}), json_schema.problems(F.lit("1"), {"properties": {}, "items": False})).first()
    assert one == two == []
