"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is analysed on the driver into a Boolean query
over trigrams that every match must contain. The corpus is indexed on the
trigrams that the rules ask for; postings are intersected by document, and only
candidates are handed to the regular expression. A rule without mandatory
trigrams is run over every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast

_parser = re._parser

#: Bytes of candidate rows that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Most strings that the analysis keeps for one stretch of a pattern.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    `pattern` is used by both Java and Python. A match counts when its group
    `group` has at least `min_chars` characters; shorter matches consume text
    and are dropped.
    """

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1


# The patterns of the three base kinds.
BASE_RULES = (
    Rule("assign",
         r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of the class is maximal, so asking for 32 up front finds the same matches as dropping shorter runs.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

TrigramQuery = frozenset  # alternatives, each a frozenset of trigrams that must all occur


def _strings(node) -> set[str] | None:
    """Every lower-cased string a parsed node can match, or None when they are not few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence(arg[-1])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if any(x is None for x in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _required(strings: set[str]) -> list[frozenset] | None:
    """Alternatives of trigrams for a stretch, or None when some string is too short to tell."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [s for s in sets if not any(o < s for o in sets)]


def trigram_query(pattern: str) -> TrigramQuery:
    """The Boolean query (an OR of ANDs) implied by a pattern; empty when nothing is mandatory."""
    conjunction: list[list[frozenset]] = []
    stretch = {""}

    def close():
        alternatives = _required(stretch)
        if alternatives:
            conjunction.append(alternatives)

    for node in _parser.parse(pattern):
        part = _strings(node)
        if part is None or len(stretch) * len(part) > MAX_STRINGS:
            close()
            stretch = part if part is not None else {""}
        else:
            stretch = {a + b for a, b in product(stretch, part)}
    close()
    if not conjunction:
        return frozenset()
    combined = [frozenset().union(*c) for c in product(*conjunction)]
    return frozenset(s for s in combined if not any(o < s for o in combined))


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index restricted to the asked trigrams: (trigram position, doc_id)."""
    lowered = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.filter(
        F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]),
        lambda x: x.isNotNull())
    return lowered.select("doc_id", F.explode(present).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """Documents that satisfy some rule's query: doc_id and one Boolean `maybe_<n>` per indexed rule."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = sorted({i // 60 for i in place.values()})
    seen = postings.groupBy("doc_id").agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w,
                        F.expr(f"shiftleft(1L, trigram - {60 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
        for w in words])

    def holds(alternative: frozenset) -> Column:
        out = F.lit(True)
        for w in words:
            mask = sum(1 << (place[t] - 60 * w) for t in alternative if place[t] // 60 == w)
            if mask:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return out

    flags = {}
    for n, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            any_of = F.lit(False)
            for alternative in sorted(query, key=sorted):
                any_of = any_of | holds(alternative)
            flags[f"maybe_{n}"] = any_of
    seen = seen.select("doc_id", *[c.alias(k) for k, c in flags.items()])
    keep = F.lit(False)
    for k in flags:
        keep = keep | F.col(k)
    return seen.where(keep)


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start,kind_order,end,kind>> of a rule's matches, in code points, end exclusive.

    The pieces between matches come from split and the matches from
    regexp_extract_all; running lengths give the positions.
    """
    kind = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"
    pattern = F.lit(rule.pattern)
    empty = F.array().cast(kind)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None

    def located(x: Column) -> Column:
        def step(acc, i):
            start = acc["at"] + F.length(F.get(x["between"], i))
            end = start + F.length(F.get(x["hits"], i))
            span = F.struct(start.cast("long").alias("start"), F.lit(order).alias("kind_order"),
                            end.cast("long").alias("end"), F.lit(rule.kind).alias("kind"))
            counts = F.length(F.get(x["sized"], i)) >= rule.min_chars
            return F.struct(end.cast("long").alias("at"),
                            F.when(counts, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
        places = F.sequence(F.lit(0), F.size(x["hits"]) - 1)
        return F.aggregate(places, begin, step, lambda acc: acc["out"])

    def found(h: Column) -> Column:
        parts = F.struct(h.alias("hits"), (h if sized is None else sized).alias("sized"),
                         F.split(text, rule.pattern, -1).alias("between"))
        return F.when(F.size(h) > 0, _let(parts, located)).otherwise(empty)

    return _let(hits, found)


def secret_scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, text and spans (array of start, kind_order, end, kind), then `keep`.

    Spans of one kind are leftmost and do not overlap; spans of different kinds
    may. They are ordered by start, then by the rule's place. A null text is
    empty and has no spans. Ids may be null or repeat: a candidate id marks all
    its rows, and every row is verified on its own text. An empty table gives an
    empty result; other columns are ignored, whatever their names.

    Ids travel with the postings, so they should be narrow. The candidates are
    broadcast when the bytes of their ids and flags, as counted, fit
    `broadcast_bytes`.
    """
    work = Scratch(docs.sparkSession, "secret-scan")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).alias(f"keep_{c}") for c in keep])
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for alternative in q for t in alternative})
    flags = [f"maybe_{n}" for n, q in enumerate(queries) if q]
    if trigrams:
        found = work.put(candidates(trigram_postings(base, trigrams), rules, trigrams), "candidates")
        id_bytes = F.sum(F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)))
        rows, held = found.agg(F.count("*"), F.coalesce(id_bytes, F.lit(0))).first()
        # A hashed row takes its id, a byte a flag rounded up to words, and 24 bytes besides.
        found = checked_broadcast(found.withColumnRenamed("doc_id", "hit_id"), 1,
                                  held + rows * (24 + 8 * (2 + len(flags))), broadcast_bytes)
        base = base.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").drop("hit_id")
    per_rule = []
    for n, rule in enumerate(rules):
        spans = rule_spans(F.col("text"), rule, n)
        if f"maybe_{n}" in flags:
            spans = F.when(F.coalesce(F.col(f"maybe_{n}"), F.lit(False)), spans).otherwise(
                F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"))
        per_rule.append(spans)
    return base.select("doc_id", "text", F.array_sort(F.concat(*per_rule)).alias("spans"),
                       *[F.col(f"keep_{c}").alias(c) for c in keep])


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Replace the spans of `secret_scan` in its text by `mask`: the scanned columns but for spans.

    Overlapping spans are replaced once. Text outside the spans is untouched.
    """
    def step(acc, s):
        start = F.greatest(s["start"], acc["at"])
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        moved = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.when(
            s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit(""))).alias("out"))
        return F.when(s["end"] > acc["at"], moved).otherwise(acc)

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("spans", begin, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.size("spans") > 0, rest).otherwise(F.col("text")).alias("text")
    return scanned.select(*[text if c == "text" else F.col(c) for c in scanned.columns if c != "spans"])
