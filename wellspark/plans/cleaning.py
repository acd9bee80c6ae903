"""Text cleaning over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.functions import characters as ch
from wellspark.operators import cleaning as cl, sinks
from wellspark.plans.registry import query, view
from wellspark.plans.views import table


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def pages(spark, sf):
    return table(spark, sf, "pages")


def _sql_replace(column: str, chars: dict[str, str]) -> str:
    out = column
    for k, v in chars.items():
        key = "''''" if k == "'" else f"'{k}'"
        out = f"replace({out}, {key}, '{v}')"
    return out


# Symbols are put into the text on both sides, since the corpus holds few of them.
MARKED = "text || ' 5±2 µM α-Ω ≥10⁶ λ₁ ½ 37°C ' || doc_id || '²'"
view("marked_docs", f"SELECT doc_id, {MARKED} AS text FROM documents")


def marked(spark, sf):
    return docs(spark, sf).withColumn("text", F.concat("text", F.lit(" 5±2 µM α-Ω ≥10⁶ λ₁ ½ 37°C "), F.col("doc_id").cast("string"), F.lit("²")))


@query("cln_01_normal_form")
def cln_01(spark, sf):
    return marked(spark, sf).select("doc_id", cl.normalize(F.col("text")).alias("text"))


@query("cln_01b_normal_form_c", "SELECT doc_id, nfc_normalize(text) AS text FROM marked_docs")
def cln_01b(spark, sf):
    return marked(spark, sf).select("doc_id", cl.normalize(F.col("text"), "NFC").alias("text"))


@query("cln_02_control_characters", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\p{Cf}\\p{Co}]', ' ', 'g'), ' +', ' ', 'g'),
  '[ \\r\\p{Z}]*([\\t\\n])[ \\r\\p{Z}]*', '\\1', 'g'), '^[ \\r\\t\\n\\p{Z}]+|[ \\r\\t\\n\\p{Z}]+$', '', 'g') AS text
FROM (SELECT doc_id, replace(text, 'e ', 'e' || chr(1) || chr(9) || ' ') || '  ' || chr(127) || ' end ' AS text FROM documents)""")
def cln_02(spark, sf):
    dirty = F.concat(F.replace(F.col("text"), F.lit("e "), F.lit("e\x01\t ")), F.lit("  \x7f end "))
    return cl.spread(docs(spark, sf).select("doc_id", "text"), "doc_id", "text").select("doc_id", cl.clean_controls(dirty).alias("text"))


@query("cln_03_scientific", f"SELECT doc_id, {_sql_replace('text', ch.SCIENTIFIC)} AS text FROM marked_docs")
def cln_03(spark, sf):
    return marked(spark, sf).select("doc_id", cl.scientific_to_ascii(F.col("text")).alias("text"))


@query("cln_03b_scientific_kept", f"SELECT doc_id, {_sql_replace('text', {k: f'{v}({k})' for k, v in ch.SCIENTIFIC.items()})} AS text FROM marked_docs")
def cln_03b(spark, sf):
    return marked(spark, sf).select("doc_id", cl.scientific_to_ascii(F.col("text"), keep_original=True).alias("text"))


@query("cln_04_numeric_forms", f"SELECT doc_id, {_sql_replace('text', ch.NUMERIC_FORMS)} AS text FROM marked_docs")
def cln_04(spark, sf):
    return marked(spark, sf).select("doc_id", cl.numeric_to_ascii(F.col("text")).alias("text"))


# Compatibility forms of what ``MARKED`` adds; the corpus itself holds no such character, and its letters are composed.
def _compatible(column: str) -> str:
    return _sql_replace(f"nfc_normalize({column})", {"µ": "μ", "⁶": "6", "₁": "1", "½": "1⁄2", "²": "2"})


def _controls(column: str) -> str:
    out = f"regexp_replace({column}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\p{{Cf}}\\p{{Co}}]', ' ', 'g')"
    for pattern, new in ((" +", " "), (r"[ \r\p{Z}]*([\t\n])[ \r\p{Z}]*", r"\1"), (r"^[ \r\t\n\p{Z}]+|[ \r\t\n\p{Z}]+$", "")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


def _spelled(column: str) -> str:
    return _sql_replace(_sql_replace(column, ch.SCIENTIFIC), ch.NUMERIC_FORMS)


_FOUND = "(SELECT coalesce(string_agg(c, '' ORDER BY pos), '') FROM (SELECT c, min(pos) AS pos FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c, unnest(range(len(regexp_extract_all(text, '[^\\x00-\\x7F]')))) AS pos) GROUP BY c))"


@query("cln_05_full_cleaning", f"""
SELECT doc_id, done AS processed_text, text <> done AS has_changes, 'normalized,control_chars_cleaned,scientific_chars_converted,numeric_unicode_converted' AS steps, {_FOUND} AS found,
  length(text) AS original_length, length(done) AS processed_length, NOT regexp_matches(done, '[^\\x00-\\x7F]') AS ascii_compatible
FROM (SELECT doc_id, text, {_spelled(_controls(_compatible('text')))} AS done FROM marked_docs)""")
def cln_05(spark, sf):
    done = cl.clean_table(cl.spread(marked(spark, sf).select("doc_id", "text"), "doc_id", "text"), "text")
    return done.select(
        "doc_id", "processed_text", "has_changes", F.array_join("processing_steps", ",").alias("steps"), F.array_join("unicode_chars_found", "").alias("found"),
        "original_length", "processed_length", "ascii_compatible",
    )


@query("cln_05b_lossless_order", f"""
SELECT doc_id, done AS processed_text, NOT regexp_matches(done, '[^\\x00-\\x7F]') AS ascii_compatible
FROM (SELECT doc_id, {_spelled(_controls(_compatible(_sql_replace('text', ch.NUMERIC_FORMS))))} AS done FROM marked_docs)""")
def cln_05b(spark, sf):
    spread = cl.spread(marked(spark, sf).select("doc_id", "text"), "doc_id", "text")
    return cl.clean_table(spread, "text", order="lossless").select("doc_id", "processed_text", "ascii_compatible")


@query("cln_06_plain_names", """
SELECT doc_id, regexp_replace(regexp_replace(translate(strip_accents(text), ' /\\:*?"<>|', '__________'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM documents""")
def cln_06(spark, sf):
    return docs(spark, sf).select("doc_id", cl.plain_name(F.col("text")).alias("name"))


@query("cln_07_readable_names")
def cln_07(spark, sf):
    # Names only: the address of each page, and a file name built from each document's fields.
    urls = pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("given"))
    built = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang", "doc_id", F.lit("5±2 µM 37°C.csv")).alias("given"))
    named = urls.unionByName(built).withColumn("name", cl.readable_name(F.col("given")))
    return sinks.unique_names(named, "kind", "name", "id").select("kind", "id", "given", F.col("unique_name").alias("name"))


@query("cln_07b_readable_paths")
def cln_07b(spark, sf):
    return pages(spark, sf).select("page_id", cl.readable_path(F.col("url")).alias("path"))


@query("cln_08_upload_names", """
SELECT page_id, CASE WHEN length(b) - length(replace(b, '.', '')) > 1 THEN replace(regexp_replace(b, '\\.[^.]*$', ''), '.', '_') || regexp_extract(b, '\\.[^.]*$') ELSE b END AS name
FROM (SELECT page_id, regexp_replace(regexp_replace(string_split(u, '/')[-1], '[^A-Za-z0-9_\\s.-]', '_', 'g'), '\\s+', '_', 'g') AS b FROM (SELECT page_id, url || '.v1.final report.csv' AS u FROM pages))""")
def cln_08(spark, sf):
    return pages(spark, sf).select("page_id", cl.upload_name(F.concat("url", F.lit(".v1.final report.csv"))).alias("name"))


ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
REMOVED = ESCAPED
for _p in (r"javascript:", r"on[\p{L}\p{M}\p{N}_]+[\s\p{Z}]*=", r"expression[\s\p{Z}]*\(", r"url[\s\p{Z}]*\(", r"@import"):
    REMOVED = f"regexp_replace({REMOVED}, '{_p}', '', 'gis')"


@query("cln_09_sanitized_html", f"SELECT page_id, {REMOVED} AS html FROM pages")
def cln_09(spark, sf):
    return pages(spark, sf).select("page_id", cl.sanitize_html(F.col("html")).alias("html"))


_TEXT = "regexp_replace(regexp_replace(html, '<[A-Za-z/!?][^>]*>', '', 'g'), '&', '&amp;', 'g')"
_TEXT = f"regexp_replace({_TEXT}, '&amp;([A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)', '&\\1', 'g')"
_TEXT = f"replace(replace({_TEXT}, '<', '&lt;'), '>', '&gt;')"
for _scheme in ("javascript:", "vbscript:", "data:", "file:"):
    for _s in (_scheme, _scheme.upper()):
        _TEXT = f"replace({_TEXT}, '{_s}', '{_s.replace(':', '_')}')"


@query("cln_10_sanitized_text", f"SELECT page_id, trim({_TEXT}, ' ') AS text FROM pages")
def cln_10(spark, sf):
    return pages(spark, sf).select("page_id", cl.sanitize_string(F.col("html")).alias("text"))


@query("cln_11_token_estimate", "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations")
def cln_11(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", cl.estimate_tokens(F.col("text")).alias("tokens"))


@query("cln_12_contexts", """
SELECT lang, (k // 10) AS batch, count(*) AS n_items, string_agg('File ' || (k % 10 + 1) || ': ' || source || chr(10) || 'Content: ' || text || chr(10) || chr(10), '' ORDER BY k) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) GROUP BY lang, k // 10""")
def cln_12(spark, sf):
    return cl.contexts(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "lang", "doc_id", "source", "text")


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(c, '^\\p{{{k}}}') THEN '{k}'" for k in ch.CATEGORIES if k != "Cn") + " ELSE 'Cn' END"
view("corpus_chars", "SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM marked_docs) GROUP BY c")


@query("agg_25_text_composition", f"""
SELECT {CATEGORY} AS name, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM corpus_chars GROUP BY 1
UNION ALL SELECT 'total', sum(length(text))::BIGINT, NULL FROM marked_docs UNION ALL SELECT 'ascii', sum(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::BIGINT, NULL FROM marked_docs
UNION ALL SELECT 'non_ascii', sum(length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::BIGINT, NULL FROM marked_docs""")
def agg_25(spark, sf):
    return cl.composition(marked(spark, sf), "text")


def _in(chars) -> str:
    return ", ".join(f"'{c}'" for c in chars)


@query("agg_25b_special_characters", f"""
SELECT c AS ch, n, {CATEGORY} AS category, c IN ({_in(ch.SCIENTIFIC)}) AS is_scientific, c IN ({_in(ch.NUMERIC_FORMS)}) AS is_numeric_form FROM corpus_chars""")
def agg_25b(spark, sf):
    return cl.special_characters(marked(spark, sf), "text")
