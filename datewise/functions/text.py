"""String functions of searches, keys and presentation, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay in lower case and words that stay in upper case.
LOWERCASE_WORDS = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "or", "the", "to")
ACRONYMS = ("DCAS", "DEP", "DOE", "DOHMH", "DOT", "EMT", "FDNY", "HR", "HRA", "IT", "NY", "NYC", "NYPD")


def collapse(text: Column) -> Column:
    """Trimmed, runs of white space as one space, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def required_text(text: Column, most: int) -> Column:
    clean = collapse(text)
    return F.when(F.length(clean) <= most, clean)


def usable_name(text: Column, most: int) -> Column:
    clean = required_text(text, most)
    return F.when(~clean.rlike(r"(?i)^(?:x{2,}|redacted|unknown|n/?a)$"), clean)


def contains_ignoring_case(text: Column, part: str) -> Column:
    """Substring search; % and _ of the user's text act as wildcards."""
    return F.coalesce(text.ilike(f"%{part}%"), F.lit(False))


def all_tokens_match(text: Column, query: str) -> Column:
    """Every white-space-separated token of the query occurs in the text."""
    tokens = F.split(F.trim(F.lit(query.lower())), r"\s+")
    return F.coalesce(F.forall(tokens, lambda t: F.like(F.lower(text), F.concat(F.lit("%"), t, F.lit("%")))), F.lit(False))


def humanize(text: Column) -> Column:
    """Lower case, with the first letter after the start, white space, / _ or - in upper case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([\s/_-]|^)([^\s/_-]*)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.rlike(r"^[\s/_-]"), F.concat(F.substring(p, 1, 1), F.upper(F.substring(p, 2, 1)), F.substring(p, 3, 100000)))
        .otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100000)))), "")


def derived_key(prefix: str, values: Column) -> Column:
    """prefix, slug of the values and eight hex digits of their hash, at most 100 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.array_join(values, "-")), "[^a-z0-9]+", "-"), "^-|-$", "")
    slug = F.when(slug == "", F.lit("segment")).otherwise(slug)
    room = max(1, 100 - len(prefix) - 10)
    cut = F.regexp_replace(F.substring(slug, 1, room), "-$", "")
    return F.concat_ws("-", F.lit(prefix), cut, F.substring(F.sha2(F.to_json(values), 256), 1, 8))


def format_imported(value: Column) -> Column:
    """Title case for facts stored in capitals: acronyms and two-letter words stay, small words go lower."""
    clean = F.nullif(F.trim(F.regexp_replace(F.trim(value), r"^[*#]+\s*", "")), F.lit(""))
    words = F.split(F.lower(clean), r"(?<=[\s/-])|(?=[\s/-])")

    def one(w: Column, i: Column) -> Column:
        core = F.upper(F.regexp_extract(w, r"[a-z0-9](.*[a-z0-9])?", 0))
        first = F.size(F.filter(F.slice(words, 1, i), lambda x: ~x.rlike(r"^[\s/-]+$") & (x != ""))) == 0
        small = F.lower(core).isin(*LOWERCASE_WORDS)
        shown = (F.when(core.isin(*ACRONYMS) | ((F.length(core) == 2) & ~small), core)
                 .when(small & ~first, F.lower(core))
                 .otherwise(F.concat(F.substring(core, 1, 1), F.lower(F.substring(core, 2, 100000)))))
        return F.when(core == "", w).otherwise(F.concat(
            F.regexp_extract(w, r"^[^a-z0-9]*", 0), shown, F.regexp_extract(w, r"[^a-z0-9]*$", 0)))

    return F.when(clean != F.upper(clean), clean).otherwise(F.array_join(F.transform(words, one), ""))


def record_id(external_id: Column) -> Column:
    bare = F.regexp_replace(external_id, "(?i)^nyc-", "")
    compact = F.regexp_replace(bare, "(?i)[^a-z0-9]", "")
    return F.upper(F.substring(F.when(compact != "", compact).otherwise(bare), 1, 12))


def iso_date(text: Column) -> Column:
    """The first ten characters as a date, null unless they are one."""
    day = F.substring(text, 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def backoff_seconds(attempts: Column) -> Column:
    """Delay before another attempt: two to the attempts, to the eighth at most, never over 300."""
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(attempts, F.lit(8)))).cast("int")
