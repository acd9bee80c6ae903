"""Rule checks, quarantine and error reports over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wellspark.operators import errors as er, quality as dq, reports as rp
from wellspark.operators.cleaning import spread
from wellspark.plans.cleaning import ESCAPED, REMOVED
from wellspark.plans.registry import query, view
from wellspark.plans.views import table, users

SCRIPT_SQL = "(?i)<script[^>]*>.*?</script>|javascript:|on[A-Za-z0-9_]+\\s*=|<iframe[^>]*>.*?</iframe>|<object[^>]*>.*?</object>|<embed[^>]*>|<link[^>]*>|<meta[^>]*>|expression\\s*\\(|url\\s*\\(|@import"
SQL_SQL = "(?i)" + "|".join(f"(?:{p})" for p, _ in dq.SQL_PATTERNS).replace("'", "''")


def clean_sql(text: str) -> str:
    return REMOVED.replace(ESCAPED, ESCAPED.replace("(html", f"(trim({text})"))


def list_sql(items: list[tuple[str, str]]) -> str:
    """SQL for the messages whose condition holds, in order, joined by bars."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {cond} THEN '{msg}' END" for cond, msg in items) + ")"


def verdict_sql(source: str, key: str, text: str, required: str, errors: list[tuple[str, str]], warnings: list[tuple[str, str]]) -> str:
    warn = list_sql(warnings) if warnings else "''"
    need = f"'{required}'" if required else "''"
    return f"""
SELECT {key}, sanitized, errors, warnings, errors = '' AS is_valid FROM (
  SELECT {key}, CASE WHEN t = '' THEN '' ELSE c END AS sanitized, CASE WHEN t = '' THEN {need} ELSE {list_sql(errors)} END AS errors, CASE WHEN t = '' THEN '' ELSE {warn} END AS warnings
  FROM (SELECT {key}, t, {clean_sql('t')} AS c FROM (SELECT {key}, coalesce({text}, '') AS t FROM {source})))"""


def verdict(df, column, kind):
    done = dq.check(df, column, kind)
    return done.withColumn("errors", F.array_join("errors", "|")).withColumn("warnings", F.array_join("warnings", "|")).drop(column)


XSS, INJ = f"regexp_matches(t, '{SCRIPT_SQL}')", f"regexp_matches(t, '{SQL_SQL}')"


view("mails", """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN lower(c_name) || '@example.org' WHEN 1 THEN 'user' || c_custkey || '@example.org' WHEN 2 THEN ' a.b+' || c_custkey || '@mail.example.com ' WHEN 3 THEN '' ELSE 'javascript:x' || c_custkey || '@example' END AS mail FROM customer""")


def mails(spark, sf):
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    mail = (
        F.when(k % 5 == 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).when(k % 5 == 1, F.concat(F.lit("user"), t, F.lit("@example.org")))
        .when(k % 5 == 2, F.concat(F.lit(" a.b+"), t, F.lit("@mail.example.com "))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("javascript:x"), t, F.lit("@example")))
    )
    return table(spark, sf, "customer").select(k.alias("id"), mail.alias("mail"))


@query("dq_01_email", verdict_sql("mails", "id", "mail", "Email is required", [
    (XSS, "Email contains invalid characters"), ("NOT regexp_matches(c, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')", "Please enter a valid email address"),
    ("length(c) > 254", "Email address is too long (max 254 characters)")], []))
def dq_01(spark, sf):
    return verdict(mails(spark, sf), "mail", "email")


view("names", """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || '''; DROP TABLE x; --' WHEN 2 THEN repeat(p_name || ' & Co ', 12) WHEN 3 THEN 'x' WHEN 4 THEN p_type || ' Labs (No. ' || p_size || ')' ELSE '<script>alert(1)</script>' || p_brand END AS name FROM part""")


def names(spark, sf):
    k = F.col("p_partkey")
    name = (
        F.when(k % 6 == 0, F.col("p_name")).when(k % 6 == 1, F.concat("p_name", F.lit("'; DROP TABLE x; --"))).when(k % 6 == 2, F.repeat(F.concat("p_name", F.lit(" & Co ")), F.lit(12)))
        .when(k % 6 == 3, "x").when(k % 6 == 4, F.concat("p_type", F.lit(" Labs (No. "), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("<script>alert(1)</script>"), F.col("p_brand")))
    )
    return table(spark, sf, "part").select(k.alias("id"), name.alias("name"))


@query("dq_02_organization", verdict_sql("names", "id", "name", "Organization name is required", [
    (XSS, "Organization name contains invalid characters"), (INJ, "Organization name contains invalid characters"), ("length(c) < 2", "Organization name must be at least 2 characters"),
    ("length(c) > 100", "Organization name must not exceed 100 characters")], [("NOT regexp_matches(c, '^[a-zA-Z0-9\\s\\.\\-_&,()]+$')", "Organization name contains unusual characters")]))
def dq_02(spark, sf):
    return verdict(names(spark, sf), "name", "organization")


@query("dq_03_person", verdict_sql("names", "id", "name", "Full name is required", [
    (XSS, "Name contains invalid characters"), ("length(c) < 1", "Name is required"), ("length(c) > 100", "Name must not exceed 100 characters")],
    [("NOT regexp_matches(c, '^[a-zA-Z\\s\\.\\-'']+$')", "Name contains unusual characters")]))
def dq_03(spark, sf):
    return verdict(names(spark, sf), "name", "person")


@query("dq_04_experiment", verdict_sql("names", "id", "name", "Experiment name is required", [
    (XSS, "Experiment name contains invalid characters"), (INJ, "Experiment name contains invalid characters"), ("length(c) < 3", "Experiment name must be at least 3 characters"),
    ("length(c) > 200", "Experiment name must not exceed 200 characters")],
    [("NOT regexp_matches(c, '^[a-zA-Z0-9\\s\\.\\-_#@!$%^&*()+=\\[\\]{}|;:,.<>?]+$')", "Experiment name contains unusual characters")]))
def dq_04(spark, sf):
    return verdict(names(spark, sf), "name", "experiment")


@query("dq_05_search", verdict_sql("names", "id", "name", "", [
    (XSS, "Search contains invalid characters"), (INJ, "Search contains invalid characters"), ("length(c) > 100", "Search text must not exceed 100 characters")],
    [("NOT regexp_matches(c, '^[a-zA-Z0-9\\s\\.\\-_@]+$')", "Search contains unusual characters")]))
def dq_05(spark, sf):
    return verdict(names(spark, sf), "name", "search")


view("links", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'javascript:' || url WHEN 2 THEN replace(url, 'http://', 'ftp://') ELSE url || '#part;p=1' END AS url FROM pages""")


def links(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit("javascript:"), "url")).when(k % 4 == 2, F.replace(F.col("url"), F.lit("http://"), F.lit("ftp://"))).otherwise(F.concat("url", F.lit("#part;p=1")))
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query("dq_06_url_rules", verdict_sql("links", "page_id", "url", "", [
    (XSS, "URL contains invalid characters"), ("regexp_matches(lower(t), '^(javascript:|data:|vbscript:|file:)')", "URL protocol not allowed"), ("length(c) > 500", "URL must not exceed 500 characters")],
    [("c <> '' AND NOT regexp_matches(c, '^https?://')", "URL should start with http:// or https://")]))
def dq_06(spark, sf):
    return verdict(links(spark, sf), "url", "url")


@query("dq_06b_rebuilt_url", """
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), 'javascript:|data:|vbscript:|file:') THEN regexp_replace(url, '#.*$', '') END AS url FROM links""")
def dq_06b(spark, sf):
    return links(spark, sf).select("page_id", dq.safe_url(F.col("url")).alias("url"))


view("bodies", """
SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL SELECT 'name', id, name FROM names""")


def bodies(spark, sf):
    parts = [
        table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")),
        table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")),
        names(spark, sf).select(F.lit("name").alias("kind"), "id", F.col("name").alias("body")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dq_07_patterns", f"SELECT kind, id, regexp_matches(body, '{SCRIPT_SQL}') AS script, regexp_matches(body, '{SQL_SQL}') AS sql_pattern FROM bodies")
def dq_07(spark, sf):
    b = F.col("body")
    return spread(bodies(spark, sf), "id", "body").select("kind", "id", dq.has_script(b).alias("script"), dq.has_sql(b).alias("sql_pattern"))


@query("dq_08_integer", """
SELECT o_orderkey, CASE WHEN v BETWEEN 10 AND 5000 THEN v END AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS v FROM orders)""")
def dq_08(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".5"))).when(k % 3 == 1, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("+"), k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", dq.to_integer(text, 10, 5000).alias("value"))


@query("dq_09_path", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/data/base/a/' || o_orderkey WHEN 1 THEN NULL WHEN 2 THEN '/data/base/c' || o_orderkey ELSE NULL END AS path FROM orders""")
def dq_09(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("a/./"), t)).when(k % 4 == 1, F.concat(F.lit("../other/"), t))
        .when(k % 4 == 2, F.concat(F.lit("/data/base/a/b/../../c"), t)).otherwise(F.concat(F.lit("/data/base_2/"), t))
    )
    return table(spark, sf, "orders").select("o_orderkey", dq.path_under(path, "/data/base").alias("path"))


SCHEMA = {"mail": {"type": "email", "required": True}, "amount": {"type": "integer", "min": 0, "max": 5000}, "title": {"type": "experiment", "required": True}, "note": {"max_length": 8}}


@query("dq_10_schema", """
SELECT id, concat_ws('|', CASE WHEN mail = '' THEN 'mail: mail is required' WHEN NOT regexp_matches(lower(trim(mail)), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 'mail: Invalid email address' END,
  CASE WHEN amount NOT BETWEEN 0 AND 5000 THEN 'amount: Invalid integer value' END, CASE WHEN length(title) NOT BETWEEN 3 AND 200 THEN 'title: Invalid experiment name' END, CASE WHEN length(note) > 8 THEN 'note: note is too long' END) AS errors
FROM (SELECT id, mail, c_acctbal::BIGINT AS amount, repeat('x', (c_custkey % 5)::INTEGER + 1) AS title, c_mktsegment AS note FROM mails JOIN (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal, c_mktsegment FROM customer) ON c_custkey = id)""")
def dq_10(spark, sf):
    form = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("bigint").alias("amount"), F.repeat(F.lit("x"), (F.col("c_custkey") % 5 + 1).cast("int")).alias("title"), F.col("c_mktsegment").alias("note")
    ).join(mails(spark, sf), "id")
    done = dq.check_schema(form, SCHEMA)
    return done.select("id", F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|").alias("errors"))


FORM = {"mail": {"type": "email", "required": True}, "amount": {"type": "integer", "min": 0, "max": 5000}, "lab": {"type": "organization", "required": True}, "title": {"type": "experiment"}, "note": {"max_length": 8}}


@query("dq_10b_form", """
SELECT id, concat_ws('|', CASE WHEN mail = '' THEN 'mail: mail is required' WHEN NOT regexp_matches(lower(trim(mail)), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN 'mail: Invalid email address' END,
    CASE WHEN amount NOT BETWEEN 0 AND 5000 THEN 'amount: Invalid integer value' END,
    CASE id % 6 WHEN 0 THEN 'lab: lab is required' WHEN 1 THEN 'lab: Organization name must be at least 2 characters' WHEN 2 THEN 'lab: Organization name contains invalid characters' WHEN 4 THEN 'lab: Organization name must not exceed 100 characters' END,
    CASE WHEN id % 5 IN (1, 2) THEN 'title: Experiment name must be at least 3 characters' END) AS errors,
  CASE id % 6 WHEN 3 THEN 'Good Lab &amp; Co' WHEN 5 THEN '5 &lt; 6 labs' END AS lab, CASE id % 5 WHEN 3 THEN 'xxx' WHEN 4 THEN 'xxxx' END AS title, substr(note, 1, 8) AS note
FROM (SELECT id, mail, c_acctbal::BIGINT AS amount, c_mktsegment AS note FROM mails JOIN (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal, c_mktsegment FROM customer) ON c_custkey = id)""")
def dq_10b(spark, sf):
    """A form with an organisation's name: missing, too short, with a forbidden word, with tags, too long, with a sign."""
    k = F.col("c_custkey")
    labs = F.array(*[F.lit(x) for x in ("", "x", "Selected Labs", "Good <b>Lab</b> & Co", "y" * 101, "5 < 6 labs")])
    form = table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_acctbal").cast("bigint").alias("amount"), F.element_at(labs, (k % 6 + 1).cast("int")).alias("lab"), F.repeat(F.lit("x"), (k % 5).cast("int")).alias("title"), F.col("c_mktsegment").alias("note")
    ).join(mails(spark, sf), "id")
    done = dq.check_form(form, FORM)
    listed = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "|")
    return done.select("id", listed.alias("errors"), *[F.try_element_at("sanitized", F.lit(f)).alias(f) for f in ("lab", "title", "note")])


@query("dq_11_required_fields", "SELECT id, concat_ws(', ', CASE WHEN full_name IS NULL THEN 'full_name' END, CASE WHEN username = '' THEN 'username' END, CASE WHEN last_login IS NULL THEN 'last_login' END) AS missing FROM users")
def dq_11(spark, sf):
    u = users(spark, sf)
    return u.select("id", dq.missing_fields(u, ["full_name", "username", "last_login"]).alias("missing"))


@query("dq_12_hostile_content", """
SELECT kind, id, regexp_matches(lower(body), '<script|javascript:|vbscript:|onclick=|onerror=|onload=|eval\\(|exec\\(|__import__|subprocess|os\\.system|shell_exec|passthru') AS hostile FROM bodies""")
def dq_12(spark, sf):
    return bodies(spark, sf).select("kind", "id", dq.has_hostile_content(F.col("body")).alias("hostile"))


@query("dq_rule_counts", f"""
SELECT level, message, count(*) AS n FROM (SELECT 'error' AS level, unnest(string_split(errors, '|')) AS message FROM ({verdict_sql("mails", "id", "mail", "Email is required", [
    (XSS, "Email contains invalid characters"), ("NOT regexp_matches(c, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')", "Please enter a valid email address")], [])}) WHERE errors <> '') GROUP BY ALL""")
def dq_counts(spark, sf):
    return dq.rule_counts(dq.check(mails(spark, sf), "mail", "email"))


view("attempts", "SELECT o_orderkey AS id, o_orderkey % 4 AS kind, o_custkey FROM orders")
MESSAGE = "CASE kind WHEN 0 THEN 'CSV line ' || id || ' is broken' WHEN 1 THEN 'API quota used up' WHEN 2 THEN 'connection lost' ELSE 'FileNotFoundError: ' || id END"
CATEGORY = "CASE kind WHEN 0 THEN 'csv_parsing' WHEN 1 THEN 'api_error' WHEN 2 THEN 'network' ELSE 'file_io' END"


def attempts(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    message = (
        F.when(k % 4 == 0, F.concat(F.lit("CSV line "), t, F.lit(" is broken"))).when(k % 4 == 1, "API quota used up").when(k % 4 == 2, "connection lost").otherwise(F.concat(F.lit("FileNotFoundError: "), t))
    )
    raw = F.when(k % 5 == 0, F.concat(t, F.lit("x"))).otherwise(t)
    return table(spark, sf, "orders").select(k.alias("id"), raw.alias("raw"), message.alias("message"))


@query("err_01_partial_results", f"""
SELECT 'ok' AS part, id::VARCHAR AS key, id::DOUBLE AS result, NULL AS category FROM attempts WHERE id % 5 <> 0 UNION ALL SELECT 'failed', id::VARCHAR, NULL, {CATEGORY} FROM attempts WHERE id % 5 = 0""")
def err_01(spark, sf):
    from wellspark.functions.values import to_num

    good, bad = er.with_recovery(attempts(spark, sf), "id", to_num("raw"), F.col("message"))
    ok = good.select(F.lit("ok").alias("part"), F.col("id").cast("string").alias("key"), "result", F.lit(None).cast("string").alias("category"))
    return ok.unionByName(bad.select(F.lit("failed").alias("part"), "key", F.lit(None).cast("double").alias("result"), "category"))


@query("err_02_error_class", f"SELECT id, {CATEGORY} AS category, CASE kind WHEN 0 THEN 'medium' ELSE 'high' END AS severity FROM attempts")
def err_02(spark, sf):
    c = er.classify(F.col("message"))
    return attempts(spark, sf).select("id", c["category"].alias("category"), c["severity"].alias("severity"))


@query("err_03_friendly_message", "SELECT id, " + "CASE kind WHEN 0 THEN '" + er.MESSAGES["csv_parsing"] + "' WHEN 1 THEN '" + er.MESSAGES["api_error"] + "' WHEN 2 THEN '" + er.MESSAGES["network"] + "' ELSE '" + er.MESSAGES["file_io"] + "' END AS message FROM attempts")
def err_03(spark, sf):
    return attempts(spark, sf).select("id", er.friendly(er.classify(F.col("message"))["category"]).alias("message"))


@query("err_04_fallback_value", "SELECT id, CASE WHEN id % 5 = 0 THEN -1 ELSE id END::DOUBLE AS value FROM attempts")
def err_04(spark, sf):
    from wellspark.functions.values import to_num

    return attempts(spark, sf).select("id", er.fallback(lambda: to_num("raw"), -1.0).alias("value"))


def error_rows(spark, sf):
    c = er.classify(F.col("message"))
    return attempts(spark, sf).select(c["category"].alias("category"), c["severity"].alias("severity"), (F.col("id") % 3 != 0).alias("recoverable"))


ERRORS = f"SELECT {CATEGORY} AS category, CASE kind WHEN 0 THEN 'medium' ELSE 'high' END AS severity, id % 3 <> 0 AS recoverable FROM attempts"
TOTALS = f"""
SELECT CASE WHEN g = 1 THEN 'category' WHEN g = 2 THEN 'severity' ELSE 'all' END AS level, coalesce(category, severity, 'total') AS value, n, recoverable, unrecoverable FROM (
  SELECT category, severity, grouping(category, severity) AS g, count(*) AS n, count(*) FILTER (recoverable) AS recoverable, count(*) FILTER (NOT recoverable) AS unrecoverable
  FROM ({ERRORS}) GROUP BY GROUPING SETS ((category), (severity), ()))"""


@query("agg_21_error_report", TOTALS)
def agg_21(spark, sf):
    return rp.error_totals(error_rows(spark, sf))


@query("err_05_run_report", f"SELECT *, 12::BIGINT AS files_processed, 'out.csv' AS output_file, 3.5::DOUBLE AS seconds, 'completed_with_errors' AS status FROM ({TOTALS})")
def err_05(spark, sf):
    return er.run_report(error_rows(spark, sf), 12, "out.csv", 3.5)
