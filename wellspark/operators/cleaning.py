"""Text cleaning as column expressions; Python runs only for Unicode normal forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wellspark.functions.characters import (
    NAME_REPLACEMENTS, NAME_SYMBOLS, NON_ASCII, NUMERIC_FORMS, SCIENTIFIC, category_of, non_ascii_chars, replace_chars,
)
from wellspark.functions.ordered import int_chunk, number_rows
from wellspark.functions.values import let

# Patterns removed after escaping, and URL schemes that are made harmless.
SCRIPT_PATTERNS = [
    r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>.*?</iframe>", r"<object[^>]*>.*?</object>", r"<embed[^>]*>",
    r"<link[^>]*>", r"<meta[^>]*>", r"expression\s*\(", r"url\s*\(", r"@import",
]
DANGEROUS_SCHEMES = ["javascript:", "vbscript:", "data:", "file:"]
TOKEN_CHARS = 4
FILES_PER_BATCH = 10


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt evenly by a hash before costly text work, which else runs in as many tasks as the file has row groups.

    The hash covers the text too, so that rows of one id do not stay together.
    The same plan at every size: the shuffle costs a small part of what the work does.
    """
    return df.repartition(F.xxhash64(*columns))


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normal


def normalize(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form.  ASCII texts are equal to it already and reach Python only as NULL."""
    return F.coalesce(_normal_form(form)(F.when(text.rlike(NON_ASCII), text)), text)


def clean_controls(text: Column) -> Column:
    """Control characters become spaces; runs of spaces collapse; every tab-separated part is trimmed.

    ASCII texts, in which only a few codes count, take narrow classes.  What a plain
    search or the first and last character rule out is not matched at all.
    """

    def cleaned(controls: str, space: str) -> Column:
        double = lambda t: F.contains(t, F.lit("  "))
        broken = lambda t: F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\t"))
        padded = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(rf"[{space}\t\n]")
        single = let(F.regexp_replace(text, controls, " "), lambda t: F.when(double(t), F.regexp_replace(t, "  +", " ")).otherwise(t))
        parts = let(single, lambda t: F.when(broken(t), F.regexp_replace(t, rf"[{space}]++([\t\n])[{space}]*+|([\t\n])[{space}]++", "$1$2")).otherwise(t))
        return let(parts, lambda t: F.when(padded(t), F.regexp_replace(t, rf"^[{space}\t\n]++|[{space}\t\n]++$", "")).otherwise(t))

    narrow = cleaned(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", r" \r")
    return F.when(text.rlike(NON_ASCII), cleaned(r"[\p{C}&&[^\t\n\r]]", r" \r\p{Z}")).otherwise(narrow)


def scientific_to_ascii(text: Column, keep_original: bool = False) -> Column:
    return replace_chars(text, SCIENTIFIC, keep_original)


def numeric_to_ascii(text: Column) -> Column:
    return replace_chars(text, NUMERIC_FORMS)


def clean_text(
    text: Column, normal: bool = True, scientific: bool = True, numeric: bool = True, controls: bool = True,
    keep_original: bool = False, order: str = "reference",
) -> Column:
    """All cleaning steps with a record of what was done.

    ``order="reference"`` normalises first, which turns raised digits into plain
    ones (10⁶ becomes 106); ``order="lossless"`` spells them out before.
    """
    out = F.coalesce(text, F.lit(""))
    if order == "lossless" and numeric:
        out = numeric_to_ascii(out)
    if normal:
        out = normalize(out)
    out = _after_normal(out, scientific, numeric, controls, keep_original)
    steps = _steps(normal, scientific, numeric, controls)
    before = F.coalesce(text, F.lit(""))
    return let(out, lambda o: F.struct(
        o.alias("processed_text"), (before != o).alias("has_changes"), steps.alias("processing_steps"),
        F.array_distinct(non_ascii_chars(before)).alias("unicode_chars_found"), F.length(before).alias("original_length"),
        F.length(o).alias("processed_length"), (~o.rlike(NON_ASCII)).alias("ascii_compatible"),
    ))


def _steps(normal: bool, scientific: bool, numeric: bool, controls: bool) -> Column:
    names = {"normalized": normal, "control_chars_cleaned": controls, "scientific_chars_converted": scientific, "numeric_unicode_converted": numeric}
    return F.array(*[F.lit(name) for name, done in names.items() if done])


def _after_normal(out: Column, scientific: bool, numeric: bool, controls: bool, keep_original: bool) -> Column:
    """Controls, then both character tables in one pass: no character is in both, and no replacement holds one of the other's."""
    if controls:
        out = clean_controls(out)
    if scientific and numeric:
        return replace_chars(out, NUMERIC_FORMS | {k: f"{v}({k})" if keep_original else v for k, v in SCIENTIFIC.items()})
    if scientific:
        return scientific_to_ascii(out, keep_original)
    return numeric_to_ascii(out) if numeric else out


def clean_table(
    df: DataFrame, text: str, normal: bool = True, scientific: bool = True, numeric: bool = True, controls: bool = True,
    keep_original: bool = False, order: str = "reference",
) -> DataFrame:
    """``clean_text`` in plain stages, each text computed once: what is named more than once is a column of a stage before."""
    before = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("__normal", numeric_to_ascii(before) if order == "lossless" and numeric else before)
    if normal:
        staged = staged.withColumn("__normal", normalize(F.col("__normal")))
    done = staged.withColumn("__done", _after_normal(F.col("__normal"), scientific, numeric, controls, keep_original))
    out = F.col("__done")
    return done.select(
        *df.columns, out.alias("processed_text"), (before != out).alias("has_changes"), _steps(normal, scientific, numeric, controls).alias("processing_steps"),
        F.array_distinct(non_ascii_chars(before)).alias("unicode_chars_found"), F.length(before).alias("original_length"),
        F.length(out).alias("processed_length"), (~out.rlike(NON_ASCII)).alias("ascii_compatible"),
    )


def plain_name(name: Column) -> Column:
    """Accents dropped, separators and reserved characters as single underscores."""
    base = F.regexp_replace(normalize(name, "NFD"), r"\p{Mn}", "")
    return F.regexp_replace(F.regexp_replace(F.translate(base, ' /\\:*?"<>|', "_" * 10), "_+", "_"), "^_+|_+$", "")


@F.pandas_udf(T.StringType())
def _readable(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form with every remaining non-ASCII character spelled out by symbol word or short name."""
    known: dict[str, str] = {}

    def word(c: str) -> str:
        if c not in known:
            short = unicodedata.name(c, "").lower().replace(" ", "_")
            known[c] = NAME_SYMBOLS.get(c) or (short if short and len(short) <= 10 else "unicode_char")
        return known[c]

    for s in parts:
        yield s.map(lambda t: None if t is None else "".join(c if c < "\x80" or c in NAME_REPLACEMENTS else word(c) for c in unicodedata.normalize("NFKD", t)))


def _safe_part(name: Column, max_length: int) -> Column:
    """Words for reserved characters, single underscores, no leading digit, limited length; may be empty."""
    room = max_length - 10

    def shorten(t: Column) -> Column:
        last = F.length(F.substring(t, 1, room)) - F.instr(F.reverse(F.substring(t, 1, room)), "_")
        cut = F.when(F.contains(F.substring(t, 1, room), F.lit("_")) & (last > room * 0.7), last).otherwise(room)
        return F.when(F.length(t) > max_length, F.substring(t, F.lit(1), cut)).otherwise(t)

    t = F.regexp_replace(F.regexp_replace(replace_chars(name, NAME_REPLACEMENTS), "_+", "_"), r"^[_.]+|[_.]+$", "")
    return let(let(t, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("file_"), x)).otherwise(x)), shorten)


def _ascii(name: Column) -> Column:
    return F.coalesce(_readable(F.when(name.rlike(NON_ASCII), name)), name)


def readable_name(name: Column, max_length: int = 200) -> Column:
    """File name with reserved characters as words; never empty, never starting with a digit."""
    done = let(_safe_part(_ascii(name), max_length), lambda t: F.when(t == "", "sanitized_file").otherwise(t))
    return F.when(F.coalesce(name, F.lit("")) == "", "unnamed_file").otherwise(done)


def readable_path(path: Column, max_length: int = 200) -> Column:
    """Every folder and the file name made readable one by one; ``.`` and ``..`` are kept."""
    def part(p: Column) -> Column:
        return let(_safe_part(p, max_length), lambda t: F.when(p.isin("", ".", ".."), p).when(t == "", "sanitized_file").otherwise(t))

    return F.array_join(F.transform(F.split(_ascii(path), "/"), part), "/")


def upload_name(name: Column, max_length: int = 255) -> Column:
    """Base name without control characters, one dot only, at most ``max_length`` long."""
    t = F.regexp_replace(F.substring_index(name, "/", -1), r"\p{C}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s.-]", "_"), r"(?U)\s+", "_")

    def one_dot(x: Column) -> Column:
        stem, ext = F.regexp_replace(x, r"\.[^.]*$", ""), F.regexp_extract(x, r"(\.[^.]*)$", 1)
        return F.when(F.regexp_count(x, F.lit(r"\.")) > 1, F.concat(F.replace(stem, F.lit("."), F.lit("_")), ext)).otherwise(x)

    def cut(x: Column) -> Column:
        stem, ext = F.regexp_replace(x, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(x, r"(?<=.)(\.[^.]*)$", 1)
        short = F.concat(F.substring(stem, F.lit(1), F.lit(max_length) - F.length(ext)), ext)
        return F.when(x.isin("", "."), "unnamed_file").when(F.length(x) > max_length, short).otherwise(x)

    return let(let(t, one_dot), cut)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def sanitize_html(text: Column) -> Column:
    """Escape, then drop script patterns.  After escaping only the patterns without ``<`` can still match."""
    out = escape_html(text)
    for pattern in SCRIPT_PATTERNS:
        if not pattern.startswith("<"):
            out = F.regexp_replace(out, "(?isU)" + pattern, "")
    return out


def sanitize_string(text: Column, max_length: int | None = None) -> Column:
    """Tags removed, the rest escaped, URL schemes made harmless; shortened only where a length is asked for.

    A tag starts with a letter, ``/``, ``!`` or ``?``, so comparison signs stay; entities are not escaped again.
    """
    t = normalize(F.replace(text, F.lit("\x00"), F.lit("")))
    t = t if max_length is None else F.substring(t, 1, max_length)
    t = F.regexp_replace(t, "<[A-Za-z/!?][^>]*>", "")
    t = F.regexp_replace(t, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")
    for raw, safe in (("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    for scheme in DANGEROUS_SCHEMES:
        for s in (scheme, scheme.upper()):
            t = F.replace(t, F.lit(s), F.lit(s.replace(":", "_")))
    return F.trim(t)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / TOKEN_CHARS)


def contexts(df: DataFrame, group: str, order: str, name: str, text: str, size: int = FILES_PER_BATCH, max_chars: int | None = None) -> DataFrame:
    """Numbered headings with contents, ``size`` items per context.

    Items are numbered chunk by chunk, then collected per (group, batch): at most
    ``size`` items meet in one group.  ``max_chars`` limits each content if given.
    """
    numbered = number_rows(df, [group], [F.col(order)], int_chunk(order), "__k")
    content = F.col(text) if max_chars is None else F.substring(F.col(text), 1, max_chars)
    inside = F.col("__k") % size
    piece = F.concat(F.lit("File "), (inside + 1).cast("string"), F.lit(": "), F.col(name), F.lit("\nContent: "), content, F.lit("\n\n"))
    return numbered.groupBy(group, F.floor(F.col("__k") / size).alias("batch")).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(inside.alias("k"), piece.alias("p")))), lambda x: x["p"]), "").alias("context")
    )


def composition(df: DataFrame, text: str) -> DataFrame:
    """ASCII and other characters of a whole corpus and per-category counts.

    Only non-ASCII characters are exploded, and they are counted per distinct
    character in each task before anything is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    chars = df.select(F.explode(non_ascii_chars(t)).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    by_category = chars.groupBy(category_of(F.col("ch")).alias("name")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    lengths = df.agg(F.sum(F.length(t)).alias("total"), F.sum(F.length(F.regexp_replace(t, NON_ASCII, ""))).alias("ascii"))
    pairs = F.array(
        F.struct(F.lit("total").alias("name"), F.col("total").alias("n")), F.struct(F.lit("ascii").alias("name"), F.col("ascii").alias("n")),
        F.struct(F.lit("non_ascii").alias("name"), (F.col("total") - F.col("ascii")).alias("n")),
    )
    return by_category.unionByName(lengths.select(F.inline(pairs)), allowMissingColumns=True)


def special_characters(df: DataFrame, text: str) -> DataFrame:
    """Distinct non-ASCII characters of a corpus with count and category, and whether a table maps them."""
    chars = df.select(F.explode(non_ascii_chars(F.col(text))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return chars.select(
        "ch", "n", category_of(F.col("ch")).alias("category"), F.col("ch").isin(list(SCIENTIFIC)).alias("is_scientific"), F.col("ch").isin(list(NUMERIC_FORMS)).alias("is_numeric_form")
    )
