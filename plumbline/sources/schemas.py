"""JSON Schema documents as Spark columns that list what a JSON text breaks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that check nothing.
REMARKS = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly"}
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE")
KINDS = {"null": ("VOID",), "boolean": ("BOOLEAN",), "string": ("STRING",), "array": ("ARRAY",), "object": ("OBJECT",), "number": NUMBERS, "integer": NUMBERS}
FORMATS = {
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "date-time": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?([Zz]|[+-][0-9]{2}:?[0-9]{2})$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$",
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
}
_ISSUES = "array<struct<path:string,keyword:string>>"


@dataclass(frozen=True)
class _Place:
    """A value, its kind, and its JSON pointer in the document."""

    value: Column
    kind: Column
    pointer: Column

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def is_(self, name: str) -> Column:
        found = self.kind.isin(*KINDS[name])
        return found & (self.get("double") % 1 == 0) if name == "integer" else found

    def field(self, key: str) -> Column:
        """The value of a property, null where there is none."""
        quote = "'" if '"' in key else '"'
        if quote in key:
            raise ValueError(f"a property with both kinds of quotes: {key}")
        return F.try_variant_get(self.value, f"$[{quote}{key}{quote}]", "variant")

    def below(self, key: str) -> Column:
        said = key.replace("~", "~0").replace("/", "~1")
        return F.concat(self.pointer, F.lit(f"/{said}"))

    def issue(self, keyword: str, bad: Column, pointer: Column | None = None) -> Column:
        one = F.array(F.struct((self.pointer if pointer is None else pointer).alias("path"), F.lit(keyword).alias("keyword")))
        return F.when(F.coalesce(bad, F.lit(False)), one).otherwise(F.array().cast(_ISSUES))


def _at(value: Column, pointer: Column, checks: Callable[[_Place], list[Column]]) -> Column:
    """The issues of a value, none where it is null.

    The value is the variable of a lambda function, so it is extracted and its kind is found once, however often the checks name them.
    """
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    one = F.array(F.struct(value.alias("v"), kind.alias("k")))
    each = F.transform(one, lambda n: F.when(n["k"].isNotNull(), _joined(checks(_Place(n["v"], n["k"], pointer)))).otherwise(F.array().cast(_ISSUES)))
    return F.element_at(each, 1)


def _joined(found: list[Column]) -> Column:
    return F.concat(*found) if found else F.array().cast(_ISSUES)


def _equals(at: _Place, value: object) -> Column:
    if value is None:
        return at.is_("null")
    if isinstance(value, bool):
        return at.is_("boolean") & (at.get("boolean") == value)
    if isinstance(value, int | float):
        return at.is_("number") & (at.get("double") == float(value))
    if isinstance(value, str):
        return at.is_("string") & (at.get("string") == value)
    same = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.to_json(at.get("variant")) == same


class _Compiler:
    def __init__(self, schema: Mapping, documents: Mapping[str, Mapping]):
        self.schema, self.documents = schema, documents

    def target(self, reference: str, root: Mapping) -> tuple[Mapping | bool, Mapping]:
        document, _, pointer = reference.partition("#")
        if document:
            if document not in self.documents:
                raise ValueError(f"no schema document {document}")
            root = self.documents[document]
        found = root
        for step in pointer.split("/")[1:]:
            found = found[step.replace("~1", "/").replace("~0", "~")]
        return found, root

    def issues(self, at: _Place, schema: Mapping | bool, root: Mapping, within: tuple[str, ...]) -> list[Column]:
        """The issue arrays of one value; they need not be looked at where the value is absent."""
        if isinstance(schema, bool):
            return [] if schema else [at.issue("false", F.lit(True))]
        below = lambda place, sub: self.issues(place, sub, root, within)
        value_of = lambda value, pointer, sub: _at(value, pointer, lambda place: below(place, sub))
        valid = lambda sub: F.size(_joined(below(at, sub))) == 0
        text, number, size = at.get("string"), at.get("double"), lambda kind: F.size(at.get(kind))
        fields, elements = "map<string,variant>", "array<variant>"
        bounds: dict[str, tuple[str, Callable[[object], Column]]] = {
            "minimum": ("number", lambda x: number < float(x)),
            "maximum": ("number", lambda x: number > float(x)),
            "exclusiveMinimum": ("number", lambda x: number <= float(x)),
            "exclusiveMaximum": ("number", lambda x: number >= float(x)),
            "minLength": ("string", lambda x: F.length(text) < x),
            "maxLength": ("string", lambda x: F.length(text) > x),
            "pattern": ("string", lambda x: ~text.rlike(x)),
            "minItems": ("array", lambda x: size(elements) < x),
            "maxItems": ("array", lambda x: size(elements) > x),
            "minProperties": ("object", lambda x: size(fields) < x),
            "maxProperties": ("object", lambda x: size(fields) > x),
        }
        known = list(schema.get("properties", {}))
        out: list[Column] = []
        for keyword, given in schema.items():
            if keyword in REMARKS or keyword in ("then", "else"):
                continue
            if keyword in bounds:
                kind, bad = bounds[keyword]
                out.append(at.issue(keyword, at.is_(kind) & bad(given)))
            elif keyword == "type":
                kinds = [given] if isinstance(given, str) else given
                out.append(at.issue("type", ~_any([at.is_(k) for k in kinds])))
            elif keyword == "const":
                out.append(at.issue("const", ~F.coalesce(_equals(at, given), F.lit(False))))
            elif keyword == "enum":
                out.append(at.issue("enum", ~F.coalesce(_any([_equals(at, x) for x in given]), F.lit(False))))
            elif keyword == "format":
                if given not in FORMATS:
                    raise ValueError(f"unknown format {given}")
                out.append(at.issue("format", at.is_("string") & ~text.rlike(FORMATS[given])))
            elif keyword == "uniqueItems":
                if given:
                    said = F.transform(at.get(elements), lambda e: F.to_json(e))
                    out.append(at.issue("uniqueItems", F.size(F.array_distinct(said)) < F.size(said)))
            elif keyword == "required":
                out += [at.issue("required", at.is_("object") & at.field(k).isNull(), at.below(k)) for k in given]
            elif keyword == "dependentRequired":
                for key, needed in given.items():
                    there = at.field(key).isNotNull()
                    out += [at.issue("dependentRequired", there & at.field(k).isNull(), at.below(k)) for k in needed]
            elif keyword == "properties":
                out += [value_of(at.field(key), at.below(key), sub) for key, sub in given.items()]
            elif keyword in ("additionalProperties", "propertyNames"):
                if given is not True:
                    out.append(self._entries(at, keyword, given, known, value_of))
            elif keyword == "items":
                place = lambda i: F.concat(at.pointer, F.lit("/"), i.cast("string"))
                each = F.transform(at.get(elements), lambda e, i: value_of(e, place(i), given))
                out.append(F.coalesce(F.flatten(each), F.array().cast(_ISSUES)))
            elif keyword == "allOf":
                out += [c for sub in given for c in below(at, sub)]
            elif keyword == "anyOf":
                out.append(at.issue("anyOf", ~_any([valid(sub) for sub in given])))
            elif keyword == "oneOf":
                out.append(at.issue("oneOf", sum((valid(sub).cast("int") for sub in given), F.lit(0)) != 1))
            elif keyword == "not":
                out.append(at.issue("not", valid(given)))
            elif keyword == "if":
                out.append(F.when(valid(given), _joined(below(at, schema.get("then", True)))).otherwise(_joined(below(at, schema.get("else", True)))))
            elif keyword == "$ref":
                if given in within:
                    raise ValueError(f"a schema that contains itself: {given}")
                sub, there = self.target(given, root)
                out += self.issues(at, sub, there, (*within, given))
            else:
                raise ValueError(f"unknown keyword {keyword}")
        return out

    def _entries(self, at: _Place, keyword: str, given: Mapping | bool, known: list[str], value_of: Callable) -> Column:
        """Issues of the fields without a schema of their own, or of the names of all fields."""
        entries = F.map_entries(at.get("map<string,variant>"))
        if keyword == "additionalProperties" and known:
            entries = F.filter(entries, lambda e: ~e["key"].isin(*known))
        said = lambda e: F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        pointer = lambda e: F.concat(at.pointer, F.lit("/"), said(e))

        def found(e: Column) -> Column:
            if given is False:
                return at.issue(keyword, F.lit(True), pointer(e))
            return value_of(e["key"].cast("variant") if keyword == "propertyNames" else e["value"], pointer(e), given)

        return F.coalesce(F.flatten(F.transform(entries, found)), F.array().cast(_ISSUES))


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for c in found:
        out = out | c
    return out


def schema_issues(text: Column, schema: Mapping, documents: Mapping[str, Mapping] | None = None) -> Column:
    """What a JSON text breaks of a JSON Schema document: a sorted array of structs of ``path`` (JSON pointer) and ``keyword``.

    The document is compiled once, on the driver, into one expression over the parsed text; ``$ref`` reaches into it and into
    ``documents`` (by their ``$id``).  A keyword or format that is not known, and a schema that contains itself, is an error.
    A missing property is named by its own path.  ``anyOf``, ``oneOf`` and ``not`` give one issue.  Text that is null, is not JSON,
    or has a name twice in one object breaks ``json``.  Numbers are compared as doubles, patterns are those of Java.  A number in
    ``uniqueItems`` counts by its value, but 1 and 1e0 as two.
    """
    compiler = _Compiler(schema, documents or {})
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword")))
    parsed = F.transform(F.array(F.try_parse_json(text)), lambda d: F.when(d.isNull(), broken).otherwise(_at(d, F.lit(""), lambda at: compiler.issues(at, schema, schema, ("#",)))))
    return F.array_sort(F.array_distinct(F.element_at(parsed, 1)))


def violations(df: DataFrame, text: str, schema: Mapping, documents: Mapping[str, Mapping] | None = None) -> DataFrame:
    """The columns of ``df`` but ``text``, with a row per issue of its text: ``path, keyword``; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in (text, "path", "keyword")]
    # an inner explode would have a filter on the size of the array put below it, which computes the array twice
    found = df.select(*kept, F.explode_outer(schema_issues(F.col(text), schema, documents)).alias("_issue"))
    return found.where(F.col("_issue").isNotNull()).select(*kept, "_issue.path", "_issue.keyword")
