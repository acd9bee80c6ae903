"""Validation rules over tables: one row in, one verdict out, then pass or quarantine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wellspark.functions.values import let
from wellspark.operators.cleaning import SCRIPT_PATTERNS, sanitize_html, sanitize_string

# Patterns, limits and words of the rule sets.
# Each pattern comes with the literals, in small letters, without which it cannot match.
SQL_PATTERNS = [
    (r"'.*?;.*?--", ["'", ";", "--"]), (r'".*?;.*?--', ['"', ";", "--"]), (r"'.*?OR.*?=.*?'", ["'", "=", "or"]), (r'".*?OR.*?=.*?"', ['"', "=", "or"]),
    (r"'.*?\sOR\s.*?=", ["'", "=", "or"]), (r'".*?\sOR\s.*?=', ['"', "=", "or"]), (r"\sOR\s+\d+=\d+", ["=", "or"]), (r"'.*?UNION.*?SELECT", ["'", "union", "select"]), (r'".*?UNION.*?SELECT', ['"', "union", "select"]),
    (r"'.*?DROP\s+TABLE", ["'", "drop", "table"]), (r'".*?DROP\s+TABLE', ['"', "drop", "table"]), (r"'.*?INSERT\s+INTO", ["'", "insert", "into"]), (r'".*?INSERT\s+INTO', ['"', "insert", "into"]),
    (r"'.*?DELETE\s+FROM", ["'", "delete", "from"]), (r'".*?DELETE\s+FROM', ['"', "delete", "from"]), (r"'.*?UPDATE.*?SET", ["'", "update", "set"]), (r'".*?UPDATE.*?SET', ['"', "update", "set"]),
    (r"--\s*$", ["--"]), (r"/\*.*?\*/", ["/*", "*/"]), (r";\s*--", [";", "--"]),
]
SCRIPT_NEEDS = {
    r"<script[^>]*>.*?</script>": ["<script", "</script>"], r"javascript:": ["javascript:"], r"on\w+\s*=": ["=", "on"], r"<iframe[^>]*>.*?</iframe>": ["<iframe", "</iframe>"],
    r"<object[^>]*>.*?</object>": ["<object", "</object>"], r"<embed[^>]*>": ["<embed"], r"<link[^>]*>": ["<link"], r"<meta[^>]*>": ["<meta"], r"expression\s*\(": ["expression"],
    r"url\s*\(": ["url"], r"@import": ["@import"],
}
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ORGANIZATION_CHARS = r"^[a-zA-Z0-9\s\.\-_&,()]+$"
PERSON_CHARS = r"^[a-zA-Z\s\.\-\']+$"
EXPERIMENT_CHARS = r"^[a-zA-Z0-9\s\.\-_#@!$%^&*()+=\[\]{}|;:,.<>?]+$"
SEARCH_CHARS = r"^[a-zA-Z0-9\s\.\-_@]+$"
FORBIDDEN_SCHEMES = ["javascript:", "data:", "vbscript:", "file:"]
HOSTILE_CONTENT = ["<script", "javascript:", "vbscript:", "onclick=", "onerror=", "onload=", "eval(", "exec(", "__import__", "subprocess", "os.system", "shell_exec", "passthru"]
URL_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _any_guarded(text: Column, patterns: list[tuple[str, list[str]]]) -> Column:
    """Whether a pattern matches in any case; literal tests on the text in small letters, made once, run before each pattern."""

    def test(low: Column) -> Column:
        out = F.lit(False)
        for pattern, needs in patterns:
            guard = F.lit(True)
            for piece in needs:
                guard = guard & F.contains(low, F.lit(piece))
            out = out | (guard & text.rlike("(?i)" + pattern))
        return out

    return let(F.lower(text), test)


def has_script(text: Column) -> Column:
    return _any_guarded(text, [(p, SCRIPT_NEEDS[p]) for p in SCRIPT_PATTERNS])


def has_sql(text: Column) -> Column:
    """Any SQL-injection pattern."""
    return _any_guarded(text, SQL_PATTERNS)


def has_hostile_content(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in HOSTILE_CONTENT]))


@dataclass(frozen=True)
class Rule:
    """``broken(raw, clean)`` is true for a violation; ``level`` is error or warning."""

    message: str
    broken: Callable[[Column, Column], Column]
    level: str = "error"


def _length(message: str, low: int | None, high: int | None) -> list[Rule]:
    rules = []
    if low is not None:
        rules.append(Rule(f"{message} must be at least {low} characters", lambda r, c: F.length(c) < low))
    if high is not None:
        rules.append(Rule(f"{message} must not exceed {high} characters", lambda r, c: F.length(c) > high))
    return rules


def _chars(message: str, pattern: str) -> Rule:
    return Rule(f"{message} contains unusual characters", lambda r, c: ~c.rlike(pattern), "warning")


def _script(what: str) -> Rule:
    return Rule(f"{what} contains invalid characters", lambda r, c: has_script(r))


def _sql(what: str) -> Rule:
    return Rule(f"{what} contains invalid characters", lambda r, c: has_sql(r))


RULES: dict[str, list[Rule]] = {
    "email": [
        _script("Email"), Rule("Please enter a valid email address", lambda r, c: ~c.rlike(EMAIL)),
        Rule("Email address is too long (max 254 characters)", lambda r, c: F.length(c) > 254),
    ],
    "organization": [_script("Organization name"), _sql("Organization name"), *_length("Organization name", 2, 100), _chars("Organization name", ORGANIZATION_CHARS)],
    "person": [_script("Name"), Rule("Name is required", lambda r, c: F.length(c) < 1), *_length("Name", None, 100), _chars("Name", PERSON_CHARS)],
    "experiment": [_script("Experiment name"), _sql("Experiment name"), *_length("Experiment name", 3, 200), _chars("Experiment name", EXPERIMENT_CHARS)],
    "search": [_script("Search"), _sql("Search"), *_length("Search text", None, 100), _chars("Search", SEARCH_CHARS)],
    "url": [
        _script("URL"), Rule("URL protocol not allowed", lambda r, c: F.lower(r).rlike("^(" + "|".join(FORBIDDEN_SCHEMES) + ")")), *_length("URL", None, 500),
        Rule("URL should start with http:// or https://", lambda r, c: (c != "") & ~c.rlike("^https?://"), "warning"),
    ],
}
REQUIRED = {"email": "Email is required", "organization": "Organization name is required", "person": "Full name is required", "experiment": "Experiment name is required"}


def check(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Add ``sanitized``, ``errors``, ``warnings`` and ``is_valid`` for one column."""
    raw = F.coalesce(F.col(column), F.lit(""))
    staged = df.withColumn("__clean", sanitize_html(F.trim(raw)))
    clean = F.col("__clean")
    lists = {}
    for level in ("error", "warning"):
        found = [F.when(rule.broken(raw, clean), F.lit(rule.message)) for rule in RULES[kind] if rule.level == level]
        lists[level] = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    empty = raw == ""
    missing = F.array(F.lit(REQUIRED[kind])) if kind in REQUIRED else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    checked = staged.select(
        *df.columns, F.when(empty, "").otherwise(clean).alias("sanitized"), F.when(empty, missing).otherwise(lists["error"]).alias("errors"),
        F.when(empty, none).otherwise(lists["warning"]).alias("warnings"),
    )
    return checked.withColumn("is_valid", F.size("errors") == 0)


def split_valid(checked: DataFrame, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with one row per error)."""
    good = checked.filter("is_valid")
    bad = checked.filter("NOT is_valid").select(
        F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), F.lit("validation").alias("category"), F.lit("medium").alias("severity"),
        F.explode("errors").alias("message"), F.lit(True).alias("recoverable"),
    )
    return good, bad


def rule_counts(checked: DataFrame) -> DataFrame:
    """How often each error and warning occurred."""
    both = F.concat(
        F.transform("errors", lambda m: F.struct(F.lit("error").alias("level"), m.alias("message"))),
        F.transform("warnings", lambda m: F.struct(F.lit("warning").alias("level"), m.alias("message"))),
    )
    return checked.select(F.inline(both)).groupBy("level", "message").agg(F.count(F.lit(1)).alias("n"))


def safe_url(url: Column) -> Column:
    """URL rebuilt from scheme, host, path and query; NULL when the scheme is not allowed."""
    part = lambda i: F.regexp_extract(url, URL_PARTS, i)
    scheme, query = F.lower(part(1)), part(4)
    path = F.regexp_replace(part(3), ";[^/]*$", "")
    rebuilt = F.concat(scheme, F.lit("://"), part(2), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    bad = F.lower(url).rlike("|".join(FORBIDDEN_SCHEMES))
    return F.when(scheme.isin("http", "https") & ~bad, rebuilt)


def to_integer(text: Column, low: int | None = None, high: int | None = None) -> Column:
    """BIGINT of an integer text inside the bounds, else NULL."""
    value = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(ok, value)


def resolve_path(path: Column, base: str) -> Column:
    """Absolute path with ``.`` and ``..`` folded; relative paths start at the base."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    fold = F.aggregate(
        F.split(full, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(fold, "/"))


def path_under(path: Column, base: str) -> Column:
    """The resolved path when it lies in the base folder, else NULL."""
    root = base.rstrip("/")
    resolved = resolve_path(path, base)
    return F.when((resolved == root) | resolved.startswith(root + "/"), resolved)


def check_schema(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """One error map per row from rules such as ``{"age": {"type": "integer", "min": 0, "required": True}}``."""
    errors = []
    for field, rule in schema.items():
        text = F.col(field).cast("string")
        blank = F.coalesce(text, F.lit("")) == ""
        kind = rule.get("type", "string")
        if kind == "email":
            low = F.lower(F.trim(text))
            fails, message = ~low.rlike(EMAIL) | (F.length(low) > 254), "Invalid email address"
        elif kind == "integer":
            fails, message = to_integer(text, rule.get("min"), rule.get("max")).isNull(), "Invalid integer value"
        elif kind in ("organization", "experiment"):
            low, high = (2, 100) if kind == "organization" else (3, 200)
            fails, message = ~F.length(F.trim(text)).between(low, high), f"Invalid {kind} name"
        elif "max_length" in rule:
            fails, message = F.length(text) > rule["max_length"], f"{field} is too long"
        else:
            fails, message = F.lit(False), ""
        found = F.when(~blank & fails, F.lit(message))
        if rule.get("required"):
            found = F.when(blank, F.lit(f"{field} is required")).otherwise(found)
        errors.append(F.struct(F.lit(field).alias("field"), found.alias("message")))
    broken = F.filter(F.array(*errors), lambda e: e["message"].isNotNull())
    return df.withColumn("errors", F.map_from_entries(broken)).withColumn("is_valid", F.size("errors") == 0)


#: Pieces an organisation's name may not hold, in any case.
ORGANIZATION_WORDS = ["<script", "javascript:", "select", "drop", "insert", "update", "delete", "union"]


def _checked_field(field: str, rule: dict) -> tuple[Column, Column]:
    """(error or NULL, sanitized text) of a field that is not blank."""
    raw = F.col(field).cast("string")
    kind = rule.get("type", "string")
    none = F.lit(None).cast("string")
    if kind == "email":
        low = F.lower(F.trim(raw))
        return F.when(~low.rlike(EMAIL) | (F.length(low) > 254), "Invalid email address"), low
    if kind == "integer":
        number = to_integer(raw, rule.get("min"), rule.get("max"))
        return F.when(number.isNull(), "Invalid integer value"), number.cast("string")
    if kind == "organization":
        clean = sanitize_string(raw, 100)
        words = reduce(lambda a, b: a | b, [F.contains(F.lower(clean), F.lit(w)) for w in ORGANIZATION_WORDS])
        error = F.when(F.length(raw) > 100, "Organization name must not exceed 100 characters").when(F.length(clean) < 2, "Organization name must be at least 2 characters").when(words, "Organization name contains invalid characters")
        return error, clean
    if kind == "experiment":
        clean = sanitize_string(raw, 200)
        return F.when(F.length(clean) < 3, "Experiment name must be at least 3 characters").when(F.length(clean) > 200, "Experiment name must not exceed 200 characters"), clean
    return none, sanitize_string(raw, rule.get("max_length", 1000))


def check_form(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """``errors`` (field to message), ``sanitized`` (field to cleaned text, only of fields without error) and ``is_valid`` of each row.

    A blank optional field is sanitized to NULL; a text field is cut to its
    ``max_length`` and cleaned, never refused, as the form does.
    """
    errors, cleaned = [], []
    for field, rule in schema.items():
        blank = F.coalesce(F.col(field).cast("string"), F.lit("")) == ""
        error, clean = _checked_field(field, rule)
        found = F.when(blank, F.lit(f"{field} is required") if rule.get("required") else F.lit(None).cast("string")).otherwise(error)
        errors.append(F.struct(F.lit(field).alias("field"), found.alias("value")))
        cleaned.append(F.when(found.isNull(), F.struct(F.lit(field).alias("field"), F.when(~blank, clean).alias("value"))))
    out = df.withColumn("_errors", F.filter(F.array(*errors), lambda e: e["value"].isNotNull())).withColumn("_cleaned", F.array_compact(F.array(*cleaned)))
    return out.withColumn("errors", F.map_from_entries("_errors")).withColumn("sanitized", F.map_from_entries("_cleaned")).withColumn("is_valid", F.size("_errors") == 0).drop("_errors", "_cleaned")


def missing_fields(df: DataFrame, fields: list[str]) -> Column:
    """Names of required fields that are NULL or blank, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields])), ", ")
