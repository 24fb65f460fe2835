"""Documents as they arrive: JSON text, merged and judged by the types of its values before it becomes a row.

A typed row cannot tell ``[1, 2]`` from ``["1", "2"]`` nor see a field that the schema
lacks; a Variant can. What passes here is therefore what a typed row holds without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recallspark.functions.rank import one_of
from recallspark.operators.validate import NESTED, REQUIRED
from recallspark.schema import DATE_PATTERN, ID_PATTERN, LABEL_PATTERN, STATUSES

ENTRIES = "map<string,variant>"
NONE = "array<string>"

# --------------------------------------------------------------- fixed values
# Rules of the string arrays: no value twice, how many at least, the form of a value.
LISTS = {
    "tags": (True, 0, None),
    "labels": (True, 1, LABEL_PATTERN),
    "triggers": (True, 1, None),
    "remembered_facts": (False, 1, None),
    "solution_pattern": (False, 0, None),
    "pitfalls": (False, 0, None),
}
# Messages; `{}` is the value or field meant.
MESSAGES = {
    "object": "memory must be a JSON object.",
    "missing": "missing required field '{}'.",
    "unknown": "unknown field '{}'.",
    "version": "schema_version must be 1.",
    "id": "id must be lowercase kebab-case.",
    "status": "status '{}' is not one of " + f"{sorted(STATUSES)}.",
    "description": "description must be a string of at least 20 characters.",
    "array": "field '{}' must be an array.",
    "items": "field '{}' must have at least {} item(s).",
    "strings": "field '{}' must contain only strings.",
    "format": "field '{}' value '{}' has an invalid format.",
    "twice": "field '{}' contains duplicate values.",
    "undeclared": "label '{}' is not declared in labels.json.",
    "inner object": "{} must be an object.",
    "inner missing": "{} is missing '{}'.",
    "inner unknown": "{} has unknown field '{}'.",
    "string": "{} must be a string.",
    "validated": "evidence.last_validated must be YYYY-MM-DD.",
    "created": "evidence.created must be an ISO-8601 string.",
    "related": "relationships.related must be an array.",
    "entry": "relationships.related entries must be objects with exactly 'id' and 'reason'.",
    "entry id": "relationships.related id must be lowercase kebab-case.",
    "entry reason": "relationships.related reason must be a string of at least 10 characters.",
}
# ----------------------------------------------------------- end fixed values


def kind(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` (JSON null), ...; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time, however often it is named (what stands
    inside lambdas and branches is otherwise worked out anew at every place)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(held: Column, patch: Column, depth: int = 2) -> Column:
    """Two JSON objects as one: objects merge down to ``depth``, every other value of the patch replaces.

    A patch that is no object gives null.
    """
    def joined(both: Column) -> Column:
        old, new = both["old"], both["new"]
        taken = new
        if depth > 1:
            taken = F.transform_values(new, lambda k, v: once(old[k], lambda was: F.when(
                one_of(kind(v), "OBJECT") & one_of(kind(was), "OBJECT"),
                F.parse_json(merged(F.to_json(was), F.to_json(v), depth - 1))).otherwise(v)))
        return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), taken))

    return once(F.struct(F.from_json(held, ENTRIES).alias("old"), F.from_json(patch, ENTRIES).alias("new")), joined)


def judged(df: DataFrame, body: str, known_labels: list[str] | None = None) -> DataFrame:
    """``df`` with ``errors``: all messages about the JSON document in column ``body``; none means valid.

    Text that is no JSON object (a key given twice included) has one message. Missing and
    unknown fields come alone, everything else is judged once the fields are right.
    ``evidence.created`` may be null, which is what a stored row has for a field left out.
    ``known_labels`` is the registry, a vocabulary people maintain by hand; None skips it.
    """
    shaped = df.withColumn("_parsed", F.try_parse_json(body))
    shaped = shaped.withColumn("_fields", F.when(one_of(kind(F.col("_parsed")), "OBJECT"), _keys(F.col("_parsed"))))
    required = F.array(*map(F.lit, REQUIRED))
    shape = F.when(F.col("_fields").isNull(), F.array(F.lit(MESSAGES["object"]))).otherwise(
        F.concat(_told("missing", F.array_except(required, "_fields")), _told("unknown", F.array_except("_fields", required))))
    shaped = shaped.withColumn("_shape", shape)
    rules = F.concat(*(F.coalesce(r, F.array().cast(NONE)) for r in _rules(F.col("_parsed"), known_labels)))
    return shaped.withColumn("errors", F.when(F.size("_shape") > 0, F.col("_shape")).otherwise(rules)).drop("_parsed", "_fields", "_shape")


def _rules(doc: Column, known_labels: list[str] | None) -> list[Column]:
    rules = [
        _unless(F.coalesce(F.try_variant_get(doc, "$.schema_version", "double") == 1, F.lit(False)) & ~one_of(kind(_at(doc, "schema_version")), "STRING"), "version"),
        _unless(_like(_at(doc, "id"), ID_PATTERN), "id"),
        once(_at(doc, "status"), lambda v: _unless(one_of(_text(v), *STATUSES), _message(
            "status", F.when(one_of(kind(v), "VOID"), "None").otherwise(F.coalesce(_text(v), F.to_json(v)))))),
        _unless(_long(_at(doc, "description"), 20), "description"),
    ]
    for name, (unique, least, pattern) in LISTS.items():
        rules.append(_strings(name, _at(doc, name), unique, least, pattern))
    if known_labels is not None:
        registry = F.array(*map(F.lit, known_labels)).cast(NONE)
        rules.append(_told("undeclared", F.filter(_texts(_at(doc, "labels")), lambda x: x.rlike(LABEL_PATTERN) & ~F.array_contains(registry, x))))
    rules.append(once(_at(doc, "scope"), lambda scope: _inner(scope, "scope", [
        *(_given(scope, f, lambda v, f=f: _unless(one_of(kind(v), "STRING"), _message("string", f"scope.{f}"))) for f in ("project", "area")),
        *(_given(scope, f, lambda v, f=f: _strings(f"scope.{f}", v, True)) for f in ("files", "applies_to")),
    ])))
    rules.append(once(_at(doc, "evidence"), lambda evidence: _inner(evidence, "evidence", [
        _given(evidence, "created_from_task", lambda v: _unless(one_of(kind(v), "STRING"), _message("string", "evidence.created_from_task"))),
        _given(evidence, "last_validated", lambda v: _unless(_like(v, DATE_PATTERN), "validated")),
        _given(evidence, "created", lambda v: _unless(one_of(kind(v), "STRING", "VOID"), "created")),
    ])))
    rules.append(once(_at(doc, "relationships"), lambda links: _inner(links, "relationships", [
        _given(links, "related", _related),
        *(_given(links, f, lambda v, f=f: _strings(f"relationships.{f}", v, True, 0, ID_PATTERN)) for f in ("supersedes", "superseded_by")),
    ])))
    return rules


def _inner(value: Column, name: str, rules: list[Column]) -> Column:
    """The rules of an object inside the document, its own fields first."""
    needed, optional = NESTED[name]
    need, may = F.array(*map(F.lit, needed)), F.array(*map(F.lit, needed + optional))
    none = F.array().cast(NONE)
    names = once(_keys(value), lambda have: F.concat(
        _told("inner missing", F.array_except(need, have), name), _told("inner unknown", F.array_except(have, may), name)))
    inside = F.concat(names, *(F.coalesce(r, none) for r in rules))
    return F.when(one_of(kind(value), "OBJECT"), inside).otherwise(F.array(_message("inner object", name)))


def _related(value: Column) -> Column:
    """Links with a reason; a null in their place is taken for none."""
    entries = F.try_variant_get(value, "$", "array<variant>")
    right = lambda e: one_of(kind(e), "OBJECT") & (F.array_sort(_keys(e)) == F.array(F.lit("id"), F.lit("reason")))
    each = F.flatten(F.transform(entries, lambda e: F.when(F.coalesce(right(e), F.lit(False)), F.concat(
        _unless(_like(_at(e, "id"), ID_PATTERN), "entry id"), _unless(_long(_at(e, "reason"), 10), "entry reason"))).otherwise(
        F.array(F.lit(MESSAGES["entry"])))))
    return F.when(one_of(kind(value), "ARRAY"), each).when(one_of(kind(value), "VOID"), F.array().cast(NONE)).otherwise(
        F.array(F.lit(MESSAGES["related"])))


def _strings(name: str, value: Column, unique: bool = False, least: int = 0, pattern: str | None = None) -> Column:
    """Rules of an array of strings. Judging its values ends at the first that is no string."""
    def judged(given: Column) -> Column:
        whole, texts, odd = given["whole"], given["texts"], given["odd"]
        rules = [_unless(F.size(whole) >= least, _message("items", name, str(least)))] if least else []
        if pattern:
            before = F.when(odd == 0, texts).otherwise(F.slice(texts, 1, F.greatest(odd - 1, F.lit(0)).cast("int")))
            rules.append(F.transform(F.filter(before, lambda x: ~x.rlike(pattern)), lambda x: _message("format", name, x)))
        rules.append(_unless(odd == 0, _message("strings", name)))
        if unique:
            rules.append(_unless((odd > 0) | (F.size(F.array_distinct(texts)) == F.size(texts)), _message("twice", name)))
        return F.concat(*rules)

    def listed(value: Column) -> Column:
        values = once(F.try_variant_get(value, "$", "array<variant>"), lambda whole: F.struct(
            whole.alias("whole"), F.try_variant_get(value, "$", "array<string>").alias("texts"),
            F.array_position(F.transform(whole, lambda x: ~one_of(kind(x), "STRING")), True).alias("odd")))
        return F.when(one_of(kind(value), "ARRAY"), once(values, judged)).otherwise(F.array(_message("array", name)))

    return once(value, listed)


def _at(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant")


def _keys(value: Column) -> Column:
    return F.json_object_keys(F.to_json(value))


def _text(value: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(one_of(kind(value), "STRING"), F.try_variant_get(value, "$", "string"))


def _texts(value: Column) -> Column:
    """Those values of an array that are strings."""
    return F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: one_of(kind(x), "STRING")),
                       lambda x: F.try_variant_get(x, "$", "string"))


def _like(value: Column, pattern: str) -> Column:
    return once(value, lambda v: F.coalesce(_text(v).rlike(pattern), F.lit(False)))


def _long(value: Column, least: int) -> Column:
    return once(value, lambda v: F.coalesce(F.length(_text(v)) >= least, F.lit(False)))


def _given(of: Column, field: str, rule) -> Column:
    """A rule for a field that may be left out."""
    return once(_at(of, field), lambda value: F.when(kind(value).isNotNull(), rule(value)))


def _message(name: str, *values: Column | str) -> Column:
    """The message with its places filled."""
    parts = MESSAGES[name].split("{}")
    filled = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        filled += [F.lit(value) if isinstance(value, str) else value, F.lit(part)]
    return F.concat(*filled)


def _told(name: str, values: Column, *before: str) -> Column:
    """One message per value."""
    return F.transform(values, lambda x: _message(name, *before, x))


def _unless(fine: Column, message: Column | str) -> Column:
    text = F.lit(MESSAGES[message]) if isinstance(message, str) else message
    return F.when(fine, F.array().cast(NONE)).otherwise(F.array(text))
