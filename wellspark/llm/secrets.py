"""Secrets: patterns, and character Markov models of random strings against ordinary identifiers; column expressions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspark.session import settle

#: Patterns of the base kinds in the order of their rank, and of the candidates for the models.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "random": "[A-Za-z0-9+/_=-]{16,}"}
KINDS = list(PATTERNS)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Long strings that label themselves as ordinary: words in one case or camel case with separators, and numbers.
ORDINARY = "^([A-Z]?[a-z]++([/_=+-]?[A-Z]?[a-z]++)*+[/_=+-]*[0-9]{0,4}|[A-Z]++([/_=+-][A-Z]++)*+[/_=+-]*[0-9]{0,4}|[0-9]+)$"
#: A string is a secret at this log-likelihood ratio in thousandths: in all, and for each character.
LEAST, LEAST_EACH = 10_000, 400
#: Counts that the share of a single character adds to the counts after each character.
WEIGHT = 20


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern with the lengths of the gaps before them, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(found, gaps, lambda m, g: F.struct(F.lit(kind).alias("kind"), m.alias("match"), F.char_length(g).alias("gap")))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` (of the row), ``id``, ``kind``, ``start``, ``end``, ``match``; a row without matches has one row with nulls."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    arrays = F.concat(*[F.filter(_matches(F.col("text"), p, k), lambda m: m["match"].isNotNull()) for k, p in enumerate(PATTERNS.values())])
    rows = keyed.select("key", "id", F.posexplode_outer(arrays).alias("at", "m")).select("key", "id", "at", "m.kind", "m.match", "m.gap").repartition("key")
    so_far = F.sum(F.col("gap") + F.char_length("match")).over(Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", so_far).withColumn("start", F.col("end") - F.char_length("match"))


def _is_base(kind: Column, match: Column) -> Column:
    return F.coalesce(((kind == 0) & (F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 8)) | kind.isin(1, 2), F.lit(False))


def samples(found: DataFrame) -> DataFrame:
    """Labelled strings: ``secret`` 1 for the values of base matches, 0 for long ordinary ones outside them; each string once."""
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    hit = found.filter(_is_base(F.col("kind"), F.col("match"))).select(value.alias("match"), F.lit(1).alias("secret"))
    other = found.filter((F.col("kind") == 3) & F.col("match").rlike(ORDINARY)).select("match", F.lit(0).alias("secret"))
    both = hit.union(other).groupBy("match").agg(F.max("secret").alias("secret"))
    cut = F.regexp_replace("match", r"\.", "")
    return both.select(cut.alias("match"), "secret").filter(F.char_length("match") >= 8)


def ratios(found: DataFrame) -> list[int]:
    """Log-likelihood ratios of all character pairs in thousandths, from the pair counts of the samples, smoothed by the counts of single characters."""
    chars = F.split(F.concat(F.lit("^"), F.col("match")), "")
    pair = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = samples(found).select("secret", F.explode(pair).alias("p")).groupBy("secret", "p.a", "p.b").agg(F.count("*").alias("n")).collect()
    counts = {(r["secret"], r["a"], r["b"]): r["n"] for r in counted}  # at most 2 * 68 * 67
    after: Counter = Counter()
    alone: Counter = Counter()
    for (s, a, b), n in counts.items():
        after[s, a] += n
        alone[s, b] += n
        alone[s, ""] += n

    def log_share(s: int, a: str, b: str) -> float:
        share = (alone[s, b] + 0.5) / (alone[s, ""] + 0.5 * len(ALPHABET))
        return math.log((counts.get((s, a, b), 0) + WEIGHT * share) / (after[s, a] + WEIGHT))

    return [round(1000 * (log_share(1, a, b) - log_share(0, a, b))) for a in "^" + ALPHABET for b in ALPHABET]


def _score(text: Column, table: list[int]) -> Column:
    values = F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)")
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("total"))

    def step(acc: Column, char: Column) -> Column:
        state = F.instr(F.lit(ALPHABET), char)
        return F.struct(state.alias("state"), (acc["total"] + F.element_at(values, (acc["state"] * len(ALPHABET) + state).cast("int"))).alias("total"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda acc: acc["total"])


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    Positions are code points.  A string of 16 or more token characters outside
    the base matches is added as ``random`` where the model of the document
    table's secrets outweighs that of its ordinary long strings.  Null and empty
    texts have no spans (empty string).  Without labelled secrets the random
    model is uniform.  Repeated rows each count; an empty table gives no rows;
    other columns are not read.
    """
    found = settle(candidates(docs, id_col, text_col), "candidates")
    table = ratios(found)
    longest = F.char_length("match")
    random = F.coalesce((F.col("kind") == 3) & (F.when(F.col("kind") == 3, _score(F.col("match"), table)) >= F.greatest(F.lit(LEAST), LEAST_EACH * longest)), F.lit(False))
    base = _is_base(F.col("kind"), F.col("match"))
    span = F.struct("start", "kind", "end")
    gathered = found.groupBy("key").agg(
        F.first("id").alias("id"),
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(F.when(random, span)).alias("more"),
    )
    outside = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return gathered.select(F.col("id").alias(id_col), count(0), count(1), count(2), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", outside)).alias("spans"))
