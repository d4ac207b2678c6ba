"""Request documents: JSON texts checked against the schemas of the mutations, in one scan; and small inline relations."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.rules import RuleError, validate


@dataclass(frozen=True)
class Field:
    """A field of a document. `kind` is string, boolean, integer, date, uuid, email, object, uuids or condition."""

    kind: str
    required: bool = True
    nullable: bool = False
    least: int | None = None
    most: int | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()


# Patterns and limits of the request documents.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
KEY = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
EMAIL = r"^[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
MAX_PRIORITY = 1_000_000
MAX_GROUPS = 1000

_TEXT = dict(least=1, most=200)
_key = Field("string", least=1, most=100, pattern=KEY)
_name = Field("string", least=1, most=300)
_date = Field("date", required=False)
_groups = Field("uuids", required=False, most=MAX_GROUPS)


def _optional(f: Field) -> Field:
    return Field(f.kind, False, f.nullable, f.least, f.most, f.pattern, f.values)


_EMPLOYEE = {
    "externalId": Field("string", **_TEXT), "displayName": _name, "email": Field("email", False, True),
    **{n: Field("string", False, True, **_TEXT) for n in ("location", "department", "employmentType")},
    "isManager": Field("boolean", False), "hireDate": Field("date", False, True), "attributes": Field("object", False), "effectiveFrom": _date}
_POLICY = {"key": _key, "categoryId": Field("uuid"), "name": _name, "description": Field("string", False, True, most=4000),
           "enabled": Field("boolean", False), "metadata": Field("object", False), "effectiveFrom": _date}
_RULE = {"policyId": Field("uuid"), "priority": Field("integer", False, least=-MAX_PRIORITY, most=MAX_PRIORITY), "enabled": Field("boolean", False),
         "validFrom": Field("date"), "validTo": Field("date", False, True), "condition": Field("condition")}
_LATER = ("validTo must be later than validFrom", lambda d: ~F.coalesce(_text(d, "validTo") <= _text(d, "validFrom"), F.lit(False)))

#: Schema name to (fields, refinements over the whole document: message and what must hold).
SCHEMAS: dict[str, tuple[dict[str, Field], tuple]] = {
    "employee": (_EMPLOYEE, ()),
    "employee_create": (_EMPLOYEE | {"groupIds": _groups}, ()),
    "employee_update": ({n: _optional(f) for n, f in _EMPLOYEE.items() if n != "externalId"} | {"groupIds": _groups}, (
        ("At least one employee field is required", lambda d: _any_present(d, [n for n in _EMPLOYEE if n not in ("externalId", "effectiveFrom")] + ["groupIds"])),)),
    "employee_preview": ({n: _optional(f) for n, f in _EMPLOYEE.items() if n != "effectiveFrom"} | {
        "employeeId": Field("uuid", False), "groupIds": _groups, "asOfDate": _date}, (
        ("New employee previews require externalId and displayName",
         lambda d: _present(d, "employeeId") | (_present(d, "externalId") & _present(d, "displayName"))),)),
    "group": ({"key": _key, "name": _name, "description": Field("string", False, True, most=2000)}, ()),
    "category": ({"key": _key, "name": _name, "cardinality": Field("string", values=("SINGLE", "MULTIPLE"))}, ()),
    "policy": (_POLICY, ()),
    "policy_version": ({n: f for n, f in _POLICY.items() if n not in ("key", "categoryId")} | {"effectiveFrom": Field("date")}, ()),
    "rule": (_RULE | {"key": _key, "publish": Field("boolean", False)}, (_LATER,)),
    "rule_version": (_RULE | {"publish": Field("boolean", False)}, (_LATER,)),
    "override": ({"employeeId": Field("uuid"), "policyId": Field("uuid"), "action": Field("string", values=("ASSIGN", "EXCLUDE")),
                  "priority": Field("integer", False, least=-MAX_PRIORITY, most=MAX_PRIORITY), "reason": Field("string", least=1, most=2000),
                  "validFrom": _date, "validTo": Field("date", False, True)}, (_LATER,)),
    "rule_preview": (_RULE | {"validFrom": _date, "ruleId": Field("uuid", False), "asOfDate": _date,
                              "exampleLimit": Field("integer", False, least=0, most=100)}, (_LATER,)),
}


def _node(doc: Column, name: str) -> Column:
    return F.variant_get(doc, f'$["{name}"]', "variant")


def _text(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f'$["{name}"]', "string")


def _present(doc: Column, name: str) -> Column:
    return _node(doc, name).isNotNull()


def _any_present(doc: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | _present(doc, n)
    return out


@F.pandas_udf(StringType())
def condition_error(conditions: pd.Series) -> pd.Series:
    """What is wrong with each condition, null if nothing is; batches come by Arrow."""
    def one(text):
        if text is None:
            return None
        try:
            validate(json.loads(text))
        except (RuleError, ValueError) as error:
            return str(error)
        return None

    return conditions.map(one)


def _fault(doc: Column, name: str, f: Field) -> Column:
    """The first fault of one field, or null."""
    node, text = _node(doc, name), _text(doc, name)
    kind = F.schema_of_variant(node)
    whole = kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT)$")
    number = F.try_variant_get(doc, f'$["{name}"]', "double")
    wrong = {"string": kind != "STRING", "email": kind != "STRING", "uuid": kind != "STRING", "date": kind != "STRING", "boolean": kind != "BOOLEAN",
             "integer": ~(whole | (kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)))), "object": ~kind.startswith("OBJECT"),
             "condition": ~kind.startswith("OBJECT"), "uuids": ~kind.startswith("ARRAY")}[f.kind]
    out = F.when(wrong, "type")
    if f.kind in ("uuid", "email", "date"):
        out = out.when(~text.rlike({"uuid": UUID, "email": EMAIL, "date": DATE}[f.kind]), f.kind)
    if f.kind == "date":
        out = out.when(F.try_to_date(text, "yyyy-MM-dd").isNull(), "date")
    if f.kind == "string":
        if f.least is not None:
            out = out.when(F.length(text) < f.least, "short")
        if f.most is not None:
            out = out.when(F.length(text) > f.most, "long")
        if f.pattern:
            out = out.when(~text.rlike(f.pattern), "pattern")
        if f.values:
            out = out.when(~text.isin(*f.values), "value")
    if f.kind == "integer":
        out = out.when((number < f.least) | (number > f.most), "range")
    if f.kind == "uuids":
        items = F.from_json(F.to_json(node), "array<string>")
        out = out.when(F.size(items) > f.most, "long").when(F.exists(items, lambda x: ~x.rlike(UUID)), "uuid")
    empty = F.lit(None).cast("string") if f.nullable else F.lit("null")
    missing = F.lit("required") if f.required else F.lit(None).cast("string")
    fault = F.when(node.isNull(), missing).when(F.is_variant_null(node), empty).otherwise(out)
    return F.when(fault.isNotNull(), F.concat(F.lit(f"{name}: "), fault))


def check(docs: DataFrame, schema: str, text_col: str = "document") -> DataFrame:
    """The rows with `error`: the first fault in the order of the schema's fields, then its refinements; null if valid.

    Unknown fields are ignored. A text that is no JSON object is an error too.
    """
    fields, refinements = SCHEMAS[schema]
    rows = docs.withColumn("_doc", F.try_parse_json(text_col))
    doc = F.col("_doc")
    shape = F.when(doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT"), "not an object")
    faults = [shape, *[_fault(doc, n, f) for n, f in fields.items()]]
    for n, f in fields.items():
        if f.kind == "condition":
            why = condition_error(F.to_json(_node(doc, n)))
            faults.append(F.when(why.isNotNull(), F.concat(F.lit(f"{n}: "), why)))
    faults += [F.when(~F.coalesce(holds(doc), F.lit(False)), message) for message, holds in refinements]
    return rows.withColumn("error", F.coalesce(*faults)).drop("_doc")


def record_set(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """An inline relation from a JSON array of records in each row."""
    return texts.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def array_rows(table: DataFrame, column: str, name: str) -> DataFrame:
    """A row per element of an array column, beside the other columns."""
    return table.select(*[c for c in table.columns if c != column], F.explode(column).alias(name))


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    """The whole numbers from first to last, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)
