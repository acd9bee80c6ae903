"""Files as tables, and results written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.operators import quality as dq, sinks
from wellspark.plans.cleaning import _controls, _spelled
from wellspark.plans.registry import query, view
from wellspark.plans.reports import E
from wellspark.plans.views import experiments, log_lines, table, usage
from wellspark.session import work_folder
from wellspark.sources import files as fs


@query("src_01_list_files", """SELECT 'o_orderstatus=' || o_orderstatus AS folder, 'csv' AS extension, TRUE AS has_content FROM orders GROUP BY o_orderstatus""")
def src_01(spark, sf):
    """Orders written as files in a folder for each status, then found again by extension."""
    base = work_folder(spark, "listed")
    table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey").write.partitionBy("o_orderstatus").option("header", True).csv(base)
    listed = fs.list_files(spark, base, ["csv"])
    folder = F.element_at(F.split("path", "/"), -2)
    return listed.groupBy(folder.alias("folder"), fs.extension(fs.file_name(F.col("path"))).alias("extension")).agg((F.sum("length") > 0).alias("has_content"))


view("upload_files", """
SELECT page_id, 'up/' || page_id || CASE page_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.exe' ELSE '.pdf' END AS path, strlen(html) AS length, html FROM pages
UNION ALL SELECT 100000 + doc_id, 'up/d' || doc_id || '.csv', strlen(text), text FROM documents""")


def upload_files(spark, sf):
    k = F.col("page_id")
    ext = F.when(k % 4 == 0, ".csv").when(k % 4 == 1, ".TXT").when(k % 4 == 2, ".exe").otherwise(".pdf")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("up/"), k.cast("string"), ext).alias("path"), F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("up/d"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return pages.unionByName(docs).withColumn("length", F.octet_length("content").cast("bigint"))


INFO = """SELECT path, string_split(path, '/')[-1] AS filename, lower(string_split(path, '.')[-1]) AS extension, length AS size_bytes, round(length / 1048576.0::DOUBLE, 2) AS size_mb,
  lower(string_split(path, '.')[-1]) IN ('csv', 'txt', 'pdf', 'docx', 'doc', 'rtf') AS is_supported_type FROM upload_files"""


@query("src_02_file_info", INFO)
def src_02(spark, sf):
    return fs.file_info(upload_files(spark, sf))


@query("src_03_validation_summary", f"""
SELECT count(*) AS total_files, count(*) FILTER (ok) AS valid_files, count(*) FILTER (NOT ok) AS invalid_files, sum(size_bytes)::BIGINT AS total_bytes,
  (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT extension AS e FROM ({INFO}) WHERE is_supported_type)) AS types, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 4) AS success_rate
FROM (SELECT *, is_supported_type AND size_bytes > 0 AS ok FROM ({INFO}))""")
def src_03(spark, sf):
    return fs.validation_summary(fs.file_info(upload_files(spark, sf)))


@query("src_04_upload_checks", """
SELECT path, CASE lower(string_split(path, '.')[-1]) WHEN 'csv' THEN 'text/csv' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
  concat_ws('|', CASE WHEN path LIKE '%.exe' THEN 'File type not allowed: exe' END, CASE WHEN path LIKE '%.exe' THEN 'Detected file type not allowed' END,
   CASE WHEN regexp_matches(lower(html), '<script|javascript:|vbscript:|onclick=|onerror=|onload=|eval\\(|exec\\(|__import__|subprocess|os\\.system|shell_exec|passthru') THEN 'File contains potentially malicious content' END) AS errors FROM upload_files""")
def src_04(spark, sf):
    up = upload_files(spark, sf)
    done = fs.check_uploads(up, dq.has_hostile_content(fs.decode_text(F.col("content"))))
    return done.select("path", "mime_type", F.array_join("errors", "|").alias("errors"))


@query("src_05_encoding_fallback", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'utf-16' WHEN doc_id % 3 = 1 AND latin AND NOT ascii THEN 'latin-1' ELSE 'utf-8' END AS encoding, text
FROM (SELECT doc_id, text, regexp_matches(text, '^[\\x00-\\x{FF}]*$') AS latin, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii FROM documents)""")
def src_05(spark, sf):
    """Texts stored in three encodings and read back without being told which."""
    k, t = F.col("doc_id"), F.col("text")
    latin = t.rlike(r"^[\x00-\xFF]*$")
    content = F.when(k % 3 == 0, F.encode(t, "UTF-16")).when((k % 3 == 1) & latin, F.encode(F.when((k % 3 == 1) & latin, t), "ISO-8859-1")).otherwise(F.encode(t, "UTF-8"))
    stored = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return stored.select("doc_id", fs.encoding_name(F.col("content")).alias("encoding"), fs.decode_text(F.col("content")).alias("text"))


@query("src_07_headered_csv", """
SELECT o_orderkey, NULL AS l_quantity, o_totalprice AS amount, 'orders' AS source FROM orders UNION ALL SELECT l_orderkey, l_quantity, l_extendedprice, 'lineitem' FROM lineitem""")
def src_07(spark, sf):
    """Two groups of CSV files with different headers, written whole and read as one table."""
    base = work_folder(spark, "csv")
    sinks.write_csv(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount")), f"{base}/orders")
    sinks.write_csv(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"), "l_quantity"), f"{base}/lineitem")
    groups = fs.read_csv_groups(spark, {"o_orderkey BIGINT, amount DOUBLE": [f"{base}/orders"], "o_orderkey BIGINT, amount DOUBLE, l_quantity DOUBLE": [f"{base}/lineitem"]})
    tagged = {ddl: df.withColumn("source", F.lit(name)) for (ddl, df), name in zip(groups.items(), ("orders", "lineitem"))}
    return fs.union_groups(tagged).select("o_orderkey", "l_quantity", "amount", "source")


@query("snk_01_csv_result", 'SELECT plate_id, well_id, "raw data", "raw mapping" FROM data_wells FULL JOIN map_wells USING (plate_id, well_id)')
def snk_01(spark, sf):
    from wellspark.operators.plates import combine
    from wellspark.plans.views import data_wells, map_wells

    path = work_folder(spark, "wells-csv")
    wells = combine(data_wells(spark, sf), map_wells(spark, sf))
    sinks.write_csv(wells, path)
    return spark.read.option("header", True).schema(wells.schema).csv(path)


@query("snk_02_json_summary", "SELECT organization_id, count(*) AS experiments, max(created_at) AS newest FROM experiments GROUP BY organization_id")
def snk_02(spark, sf):
    path = work_folder(spark, "summary-json")
    summary = experiments(spark, sf).groupBy("organization_id").agg(F.count(F.lit(1)).alias("experiments"), F.max("created_at").alias("newest"))
    sinks.write_json(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query("snk_04_appended_events", 'SELECT "timestamp"::DATE AS usage_date, metric_type, count(*) AS n FROM usage GROUP BY ALL')
def snk_04(spark, sf):
    path = work_folder(spark, "usage")
    u = usage(spark, sf)
    sinks.append_events(u.filter(F.col("metric_type") == "error"), path)
    sinks.append_events(u.filter(F.col("metric_type") != "error"), path)
    return spark.read.parquet(path).groupBy("usage_date", "metric_type").agg(F.count(F.lit(1)).alias("n"))


@query("snk_10b_linked_append", """
SELECT user_id, 'create_experiment' AS action_type, 'pending' AS status, count(*) AS n FROM experiments GROUP BY user_id""")
def snk_10b(spark, sf):
    """New experiments and their audit entries, written by one call and joined again on the generated ids."""
    base = work_folder(spark, "linked")
    sinks.append_linked(spark, experiments(spark, sf).select("user_id", "organization_id", "name"), E.now, f"{base}/experiments", f"{base}/audit")
    made, log = spark.read.parquet(f"{base}/experiments"), spark.read.parquet(f"{base}/audit")
    joined = made.join(log.withColumnRenamed("target_id", "id"), "id")
    return joined.groupBy("user_id", "action_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("cln_13_file_set_cleaning", f"""
SELECT doc_id, lang, 'utf-8' AS encoding, octet_length(encode(text))::BIGINT AS size_bytes, text <> done AS has_changes, length(text) AS original_length, length(done) AS processed_length,
  NOT regexp_matches(done, '[^\\x00-\\x7F]') AS ascii_compatible, done AS processed_text FROM (SELECT doc_id, lang, text, {_spelled(_controls('nfc_normalize(text)'))} AS done FROM documents)""")
def cln_13(spark, sf):
    """Cleaned texts written by language, read back with one metadata row per file."""
    from wellspark.operators.cleaning import clean_table

    path = work_folder(spark, "cleaned")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    texts = docs.select("doc_id", "lang", fs.encoding_name(F.col("content")).alias("encoding"), F.octet_length("content").alias("size_bytes"), fs.decode_text(F.col("content")).alias("text"))
    clean_table(texts, "text").drop("text").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(path).select("doc_id", "lang", "encoding", "size_bytes", "has_changes", "original_length", "processed_length", "ascii_compatible", "processed_text")


@query("src_06b_large_text_lines", "SELECT file, count(*) AS n_lines, max(line_no) AS last_line FROM log_lines GROUP BY file")
def src_06b(spark, sf):
    return log_lines(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))
