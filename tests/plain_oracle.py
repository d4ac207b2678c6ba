"""A second evaluation and resolution in plain Python, sharing nothing with the engine."""

import datetime


def value_of(fact, row, day):
    """(present, value) of a fact."""
    kind = fact["kind"]
    if kind == "employee":
        v = row[fact["field"]]
        return True, v.isoformat() if isinstance(v, datetime.date) else v
    if kind == "attribute":
        return fact["key"] in row["attributes"], row["attributes"].get(fact["key"])
    if kind == "tenure_days":
        return row["hire_date"] is not None, None if row["hire_date"] is None else max(0, (day - row["hire_date"]).days)
    return True, day.isoformat()


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def holds(node, row, day):
    kind = node["type"]
    if kind == "and":
        return all(holds(c, row, day) for c in node["conditions"])
    if kind == "or":
        return any(holds(c, row, day) for c in node["conditions"])
    if kind == "not":
        return not holds(node["condition"], row, day)
    if kind == "group":
        return (node["groupId"] in row["group_ids"]) == (node["operator"] == "MEMBER_OF")
    present, left = value_of(node["fact"], row, day)
    op, right = node["operator"], node["value"]
    if op in ("EQ", "IN"):
        return present and any(same(left, v) for v in (right if op == "IN" else [right]))
    if op in ("NE", "NOT_IN"):
        return present and not any(same(left, v) for v in (right if op == "NOT_IN" else [right]))
    if not present or left is None or right is None or isinstance(left, bool) or isinstance(right, bool):
        return False
    if isinstance(left, str) != isinstance(right, str):
        return False
    return {"GT": left > right, "GTE": left >= right, "LT": left < right, "LTE": left <= right}[op]


def leaves(node):
    if node["type"] == "not":
        return leaves(node["condition"])
    return sum(map(leaves, node["conditions"])) if node["type"] in ("and", "or") else 1


def candidates(row, rules, overrides, day):
    """(category, policy, is rule, minus priority, minus specificity, candidate id, action), ordered by precedence when sorted."""
    iso, out = day.isoformat(), []
    for r in rules:
        live = r["enabled"] and r["policy_enabled"] and r["valid_from"] <= iso and (not r["valid_to"] or r["valid_to"] > iso)
        if live and holds(r["condition"], row, day):
            out.append((r["category_id"], r["policy_id"], 1, -r["priority"], -leaves(r["condition"]), f"rule:{r['version_id']}", "ASSIGN"))
    for o in overrides:
        if not o["revoked"] and o["valid_from"] <= day and (o["valid_to"] is None or o["valid_to"] > day):
            out.append((o["category_id"], o["policy_id"], 0, -o["priority"], -(2 ** 53 - 1), f"manual:{o['id']:012d}", o["action"]))
    return out


def assigned(row, rules, overrides, categories, day):
    """The (category, policy) pairs that an employee holds."""
    found, out = candidates(row, rules, overrides, day), set()
    for category, kind in categories.items():
        own = sorted((c[2], c[3], c[4], c[5], c[1], c[6]) for c in found if c[0] == category)
        first = {}
        for c in own:
            first.setdefault(c[4], c)
        eligible = [c for c in own if first[c[4]] is c and c[5] == "ASSIGN"]
        out |= {(category, c[4]) for c in (eligible[:1] if kind == "SINGLE" else eligible)}
    return out
