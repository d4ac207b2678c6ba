"""The rule language: validation and compilation of boolean conditions to Columns.

A condition is a JSON tree of comparisons, group tests, and / or / not. Every
leaf is two-valued: it is coalesced to true or false here, so that `not` is
plain negation. A snapshot row offers the columns of `SNAPSHOT_FIELDS`,
`attributes` (VARIANT), `group_ids` (array of strings, never null).
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and limits of the language.
SNAPSHOT_FIELDS = ("external_id", "email", "location", "department", "employment_type", "is_manager", "hire_date")
COMPARISONS = ("EQ", "NE", "GT", "GTE", "LT", "LTE", "IN", "NOT_IN")
ORDERINGS = ("GT", "GTE", "LT", "LTE")
MAX_LIST_VALUES = 1000
MAX_CHILDREN = 100
_KEY = re.compile(r"[A-Za-z0-9_.-]{1,200}")
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


class RuleError(ValueError):
    """A condition that the language does not allow."""


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise RuleError(message)


def _keys(node: dict, *names: str) -> None:
    _check(isinstance(node, dict) and set(node) == set(names), f"expected exactly the keys {names}")


def _scalar(value) -> bool:
    return value is None or isinstance(value, (str, bool, int)) or isinstance(value, float) and math.isfinite(value)


def validate(node) -> None:
    """Raise RuleError unless `node` is a condition of the language."""
    _check(isinstance(node, dict), "a condition is an object")
    kind = node.get("type")
    if kind in ("and", "or"):
        _keys(node, "type", "conditions")
        _check(isinstance(node["conditions"], list) and 1 <= len(node["conditions"]) <= MAX_CHILDREN, "1 to 100 conditions")
        for child in node["conditions"]:
            validate(child)
    elif kind == "not":
        _keys(node, "type", "condition")
        validate(node["condition"])
    elif kind == "group":
        _keys(node, "type", "groupId", "operator")
        _check(node["operator"] in ("MEMBER_OF", "NOT_MEMBER_OF"), "unknown group operator")
        _check(isinstance(node["groupId"], str) and bool(node["groupId"]), "groupId is a string")
    elif kind == "comparison":
        _keys(node, "type", "fact", "operator", "value")
        _check(node["operator"] in COMPARISONS, "unknown operator")
        value, many = node["value"], node["operator"] in ("IN", "NOT_IN")
        _check(isinstance(value, list) == many, f"{node['operator']} {'requires' if many else 'does not accept'} an array")
        values = value if many else [value]
        _check(not many or 1 <= len(values) <= MAX_LIST_VALUES, "1 to 1000 values")
        _check(all(map(_scalar, values)), "values are scalars")
        fact = node["fact"]
        _check(isinstance(fact, dict), "a fact is an object")
        if fact.get("kind") == "employee":
            _keys(fact, "kind", "field")
            _check(fact["field"] in SNAPSHOT_FIELDS, "unknown field")
        elif fact.get("kind") == "attribute":
            _keys(fact, "kind", "key")
            _check(isinstance(fact["key"], str) and bool(_KEY.fullmatch(fact["key"])), "invalid attribute key")
        elif fact.get("kind") == "tenure_days":
            _keys(fact, "kind")
            _check(all(type(v) is int and v >= 0 for v in values), "tenure_days values are non-negative integers")
        elif fact.get("kind") == "as_of_date":
            _keys(fact, "kind")
            _check(all(map(is_iso_date, values)), "as_of_date values are ISO dates")
        else:
            raise RuleError("unknown fact")
    else:
        raise RuleError("unknown condition type")


def is_iso_date(value) -> bool:
    """Whether a value is a day of the calendar, written year-month-day."""
    if not (isinstance(value, str) and _ISO.fullmatch(value)):
        return False
    try:
        datetime.date.fromisoformat(value)
    except ValueError:
        return False
    return True


def is_group_id(value: str) -> bool:
    try:
        return str(uuid.UUID(value)) == value.lower()
    except ValueError:
        return False


def _plain(value):
    """Whole floats as integers, so that 4.0 and 4 are written alike."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def content_hash(condition: dict | str) -> str:
    node = json.loads(condition) if isinstance(condition, str) else condition
    return hashlib.sha256(canonical_json(node).encode()).hexdigest()


def canonical_json(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class Dependency:
    """A fact a rule reads; `selector` is JSON, `mandatory` says that no match is possible without it."""

    type: str
    key: str
    operator: str
    selector: str
    mandatory: bool = False


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _order(left: Column, operator: str, right) -> Column:
    right = right if isinstance(right, Column) else F.lit(right)
    out = {"GT": left > right, "GTE": left >= right, "LT": left < right, "LTE": left <= right}[operator]
    return F.coalesce(out, F.lit(False))


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class _Fact:
    """How a fact's column compares with literals: presence, equality and order."""

    present: Column
    shown: Column  # JSON text of the value, null where it is missing

    def equals(self, value) -> Column: ...
    def orders(self, operator: str, value) -> Column: ...


class _Stored(_Fact):
    def __init__(self, name: str):
        self.column, self.kind = F.col(name), "boolean" if name == "is_manager" else "string"
        if name == "hire_date":
            self.column = F.date_format(self.column, "yyyy-MM-dd")
        self.present = F.lit(True)
        self.shown = F.coalesce(F.to_json(F.struct(self.column.alias("v"))), F.lit("{}"))

    def equals(self, value) -> Column:
        if value is None:
            return self.column.isNull()
        fits = isinstance(value, bool) if self.kind == "boolean" else isinstance(value, str)
        return self.column.eqNullSafe(F.lit(value)) if fits else F.lit(False)

    def orders(self, operator: str, value) -> Column:
        return _order(self.column, operator, value) if self.kind == "string" and isinstance(value, str) else F.lit(False)


class _Attribute(_Fact):
    def __init__(self, key: str):
        self.path = f'$["{key}"]'
        self.node = F.variant_get("attributes", self.path, "variant")
        self.present = self.node.isNotNull()
        self.kind = F.schema_of_variant(self.node)
        self.shown = F.to_json(self.node)

    def _typed(self, value) -> tuple[Column, Column]:
        """(the attribute has the literal's type, its typed value)"""
        if isinstance(value, bool):
            return self.kind == "BOOLEAN", F.try_variant_get("attributes", self.path, "boolean")
        if _number(value):
            return (self.kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"),
                    F.try_variant_get("attributes", self.path, "double"))
        return self.kind == "STRING", F.try_variant_get("attributes", self.path, "string")

    def equals(self, value) -> Column:
        if value is None:
            return F.coalesce(F.is_variant_null(self.node), F.lit(False))
        fits, typed = self._typed(value)
        return F.coalesce(fits & (typed == F.lit(float(value) if _number(value) else value)), F.lit(False))

    def orders(self, operator: str, value) -> Column:
        if not (_number(value) or isinstance(value, str)):
            return F.lit(False)
        fits, typed = self._typed(value)
        return F.coalesce(fits, F.lit(False)) & _order(typed, operator, float(value) if _number(value) else value)


class _Tenure(_Fact):
    def __init__(self, as_of: Column):
        self.column = F.greatest(F.lit(0), F.datediff(as_of, F.col("hire_date")))
        self.present = F.col("hire_date").isNotNull()
        self.column = F.when(self.present, self.column)
        self.shown = self.column.cast("string")

    def equals(self, value) -> Column:
        return F.coalesce(self.column == F.lit(value), F.lit(False))

    def orders(self, operator: str, value) -> Column:
        return _order(self.column, operator, value)


class _AsOf(_Fact):
    def __init__(self, as_of: Column):
        self.column, self.present = F.date_format(as_of, "yyyy-MM-dd"), F.lit(True)
        self.shown = self.column

    def equals(self, value) -> Column:
        return self.column.eqNullSafe(F.lit(value))

    def orders(self, operator: str, value) -> Column:
        return _order(self.column, operator, value)


def _fact(fact: dict, as_of: Column) -> _Fact:
    return {"employee": lambda: _Stored(fact["field"]), "attribute": lambda: _Attribute(fact["key"]),
            "tenure_days": lambda: _Tenure(as_of), "as_of_date": lambda: _AsOf(as_of)}[fact["kind"]]()


def fact_name(node: dict) -> str:
    if node["type"] == "group":
        return f"group.{node['groupId']}"
    fact = node["fact"]
    return {"employee": f"employee.{fact.get('field')}", "attribute": f"employee.attributes.{fact.get('key')}"}.get(
        fact["kind"], fact["kind"])


def _leaf(node: dict, as_of: Column) -> Column:
    if node["type"] == "group":
        member = F.array_contains("group_ids", node["groupId"])
        return member if node["operator"] == "MEMBER_OF" else ~member
    fact, operator, value = _fact(node["fact"], as_of), node["operator"], node["value"]
    if operator in ORDERINGS:
        return fact.orders(operator, value)
    same = _any(fact.equals(v) for v in (value if isinstance(value, list) else [value]))
    # A null value satisfies NE and NOT_IN; a missing one satisfies nothing.
    return same if operator in ("EQ", "IN") else fact.present & ~same


def _predicate(node: dict, as_of: Column) -> Column:
    if node["type"] == "not":
        return ~_predicate(node["condition"], as_of)
    if node["type"] in ("and", "or"):
        parts = [_predicate(c, as_of) for c in node["conditions"]]
        return _all(parts) if node["type"] == "and" else _any(parts)
    return _leaf(node, as_of)


def _trace(node: dict, as_of: Column, path: str) -> list[Column]:
    """Trace entries in post-order: children before their parent."""
    out = []
    if node["type"] == "not":
        out += _trace(node["condition"], as_of, f"{path}.not")
    for i, child in enumerate(node.get("conditions", [])):
        out += _trace(child, as_of, f"{path}.{node['type']}[{i}]")
    name = operator = expected = F.lit(None).cast("string")
    actual = F.lit(None).cast("string")
    if node["type"] == "comparison":
        name, operator = F.lit(fact_name(node)), F.lit(node["operator"])
        expected, actual = F.lit(canonical_json(node["value"])), _fact(node["fact"], as_of).shown
    elif node["type"] == "group":
        name, operator, expected = F.lit(fact_name(node)), F.lit(node["operator"]), F.lit("true")
        actual = F.array_contains("group_ids", node["groupId"]).cast("string")
    out.append(F.struct(F.lit(path).alias("path"), F.lit(node["type"]).alias("type"), _predicate(node, as_of).alias("matched"),
                        name.alias("fact"), actual.alias("actual"), operator.alias("operator"), expected.alias("expected")))
    return out


def _leaves(node: dict) -> list[dict]:
    if node["type"] == "not":
        return _leaves(node["condition"])
    if node["type"] in ("and", "or"):
        return [leaf for c in node["conditions"] for leaf in _leaves(c)]
    return [node]


def _dependency(leaf: dict, mandatory: bool = False) -> Dependency:
    if leaf["type"] == "group":
        return Dependency("GROUP", leaf["groupId"], leaf["operator"], "true", mandatory)
    fact = leaf["fact"]
    kind, key = {"employee": ("FIELD", fact.get("field")), "attribute": ("ATTRIBUTE", fact.get("key"))}.get(
        fact["kind"], ("TIME", fact["kind"]))
    return Dependency(kind, key, leaf["operator"], canonical_json(leaf["value"]), mandatory)


def _selectors(node: dict) -> set[Dependency]:
    """Positive leaves without which the condition cannot hold: union under AND, intersection under OR."""
    if node["type"] == "and":
        return set().union(*map(_selectors, node["conditions"]))
    if node["type"] == "or":
        keyed = [{(d.type, d.key, d.selector): d for d in _selectors(c)} for c in node["conditions"]]
        return {d for k, d in keyed[0].items() if all(k in other for other in keyed[1:])}
    if node["type"] == "not":
        return set()
    own = _dependency(node, True)
    return {own} if own.operator in ("EQ", "IN", "MEMBER_OF") and own.type != "TIME" else set()


def _dates(node: dict, as_of: Column) -> list[Column]:
    """Dates on which a time-dependent leaf can change its answer."""
    out = []
    for leaf in _leaves(node):
        kind = leaf["fact"]["kind"] if leaf["type"] == "comparison" else None
        if kind not in ("tenure_days", "as_of_date"):
            continue
        shifts = {"GT": (1,), "LTE": (1,), "GTE": (0,), "LT": (0,)}.get(leaf["operator"], (0, 1))
        for value in leaf["value"] if isinstance(leaf["value"], list) else [leaf["value"]]:
            for shift in shifts:
                out.append(F.date_add("hire_date", value + shift) if kind == "tenure_days"
                           else F.date_add(F.lit(value).cast("date"), shift))
    return out


def next_date(dates: list[Column], as_of: Column) -> Column:
    """The earliest of the dates after as_of, null if there is none."""
    if not dates:
        return F.lit(None).cast("date")
    return F.array_min(F.filter(F.array(*dates), lambda d: d > as_of))


@dataclass
class CompiledRule:
    """A validated condition as Columns over a snapshot row, with what the planner derives from it."""

    condition: dict
    predicate: Column
    trace: Column
    transition_dates: list[Column]
    dependencies: list[Dependency]
    specificity: int
    content_hash: str
    selectors: list[Dependency] = field(default_factory=list)


def compile_rule(condition: dict | str, as_of: Column) -> CompiledRule:
    node = json.loads(condition) if isinstance(condition, str) else condition
    validate(node)
    selectors = {(d.type, d.key): d for d in sorted(_selectors(node), key=lambda d: d.selector)}
    found: dict[tuple[str, str], Dependency] = {}
    for leaf in _leaves(node):
        d = _dependency(leaf)
        found.setdefault((d.type, d.key), selectors.get((d.type, d.key), d))
        if d.type == "TIME" and d.key == "tenure_days":
            found.setdefault(("FIELD", "hire_date"), Dependency("FIELD", "hire_date", d.operator, "null"))
    return CompiledRule(
        condition=node, predicate=_predicate(node, as_of), trace=F.array(*_trace(node, as_of, "$")),
        transition_dates=_dates(node, as_of), dependencies=[found[k] for k in sorted(found)],
        specificity=len(_leaves(node)), content_hash=content_hash(node),
        selectors=[selectors[k] for k in sorted(selectors)])


class RuleCompiler:
    """Compiles each immutable rule version once; a version that comes back with another content is an error."""

    def __init__(self, as_of: Column, capacity: int = 10_000):
        self.as_of, self.capacity = as_of, capacity
        self._known: dict[str, CompiledRule] = {}

    def get(self, version_id: str, condition: dict | str, content_hash: str | None = None) -> CompiledRule:
        if version_id in self._known:
            rule = self._known.pop(version_id)
        else:
            rule = compile_rule(condition, self.as_of)
            if len(self._known) >= self.capacity:
                self._known.pop(next(iter(self._known)))
        if content_hash not in (None, rule.content_hash):
            raise RuleError(f"rule version {version_id} changed its content")
        self._known[version_id] = rule
        return rule


def selector_predicate(selectors: list[Dependency]) -> Column:
    """A sound filter for the employees a rule can match: groups, then fields, then attributes; null equals null."""
    out = F.lit(True)
    for d in sorted(selectors, key=lambda d: ("GROUP", "FIELD", "ATTRIBUTE").index(d.type)):
        if d.type == "GROUP":
            out = out & F.array_contains("group_ids", d.key)
        else:
            value = json.loads(d.selector)
            fact = _Stored(d.key) if d.type == "FIELD" else _Attribute(d.key)
            out = out & _any(fact.equals(v) for v in (value if isinstance(value, list) else [value]))
    return out


# Helpers to write conditions.
def compare(fact: str, operator: str, value) -> dict:
    kind, _, key = fact.partition(".")
    node = {"attribute": {"kind": "attribute", "key": key}, "tenure_days": {"kind": "tenure_days"},
            "as_of_date": {"kind": "as_of_date"}}.get(kind, {"kind": "employee", "field": fact})
    return {"type": "comparison", "fact": node, "operator": operator, "value": value}


def group(group_id: str, operator: str = "MEMBER_OF") -> dict:
    return {"type": "group", "groupId": group_id, "operator": operator}


def all_of(*conditions: dict) -> dict:
    return {"type": "and", "conditions": list(conditions)}


def any_of(*conditions: dict) -> dict:
    return {"type": "or", "conditions": list(conditions)}


def none_of(condition: dict) -> dict:
    return {"type": "not", "condition": condition}
