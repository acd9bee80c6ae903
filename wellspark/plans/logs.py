"""Log alignment over the table event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.operators import logs as lg, structure as st
from wellspark.plans.registry import query, view
from wellspark.plans.structure import log_annotation
from wellspark.plans.views import log_lines, table
from wellspark.session import work_folder
from wellspark.sources import annotations as an

NULLS = "('', 'N/A', 'NaN', 'null', 'NULL', '-', 'missing', 'n/a')"

view("log_time", """
SELECT file, row, TRY_CAST(cell AS TIMESTAMP) AS "timestamp" FROM named_log_cells WHERE col = 0""")
view("log_long", f"""
SELECT c.file AS source_file, c.row AS line_no, t."timestamp" AS "timestamp", 'original' AS timestamp_source,
  replace(replace(c.file, '.csv', ''), '_log', '') || '_' || name AS "column", CASE WHEN cell NOT IN {NULLS} THEN cell END AS value
FROM named_log_cells c JOIN log_time t ON t.file = c.file AND t.row = c.row WHERE col <> 0""")


def facts_of(spark, sf):
    lines = log_lines(spark, sf)
    comma = lines.filter(F.col("line_no") == 0).select("file", F.lit(",").alias("delimiter"))
    return lg.file_facts(lines, comma, log_annotation(spark, sf))


def timed(spark, sf, prefix=True):
    return lg.with_time(log_lines(spark, sf), facts_of(spark, sf), prefix)


@query("log_03_fast_path", f"""
SELECT "timestamp", source_file, line_no, max(CASE WHEN name = 'value' THEN value END) AS value, max(CASE WHEN name = 'props' THEN value END) AS props, max(CASE WHEN name = 'user_id' THEN value END) AS user_id
FROM (SELECT c.file AS source_file, c.row AS line_no, t."timestamp" AS "timestamp", name, CASE WHEN cell NOT IN {NULLS} THEN cell END AS value
  FROM named_log_cells c JOIN log_time t ON t.file = c.file AND t.row = c.row WHERE col <> 0) GROUP BY 1, 2, 3""")
def log_03(spark, sf):
    return lg.wide_by_position(log_lines(spark, sf), facts_of(spark, sf), ["props", "user_id", "value"], prefix=False)


@query("log_04_original_times", 'SELECT source_file, line_no, "timestamp", timestamp_source, "column", value FROM log_long')
def log_04(spark, sf):
    good, _bad = lg.split_bad_times(timed(spark, sf))
    return lg.to_long(good)


@query("log_04b_quarantine", """
SELECT file AS source, line_no::VARCHAR AS key, 'data_processing' AS category, 'medium' AS severity, 'unparseable timestamp: ' || split_part(line, ',', 1) AS message, TRUE AS recoverable
FROM (SELECT file, line_no, CASE WHEN line_no % 13 = 0 THEN 'late,' || line ELSE line END AS line FROM log_lines) WHERE line_no >= 3 AND line_no % 13 = 0""")
def log_04b(spark, sf):
    """Every thirteenth line gets a broken time; those lines go to quarantine and nowhere else."""
    lines = log_lines(spark, sf)
    broken = lines.withColumn("line", F.when((F.col("line_no") % 13 == 0) & (F.col("line_no") >= 3), F.concat(F.lit("late,"), "line")).otherwise(F.col("line")))
    return lg.split_bad_times(lg.with_time(broken, facts_of(spark, sf)))[1]


view("imputed", """
SELECT event_type || '_log.csv' AS file, event_id + 1 AS row_index, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", (event_id % 10)::DOUBLE AS confidence_score FROM events WHERE event_id % 3 = 0""")


def imputed(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    return e.filter(k % 3 == 0).select(
        F.concat("event_type", F.lit("_log.csv")).alias("file"), (k + 1).alias("row_index"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), (k % 10).cast("double").alias("confidence_score")
    )


@query("log_05_imputed_times", """
SELECT file, line_no, line, i."timestamp"::TIMESTAMP AS "timestamp", confidence_score, 'imputed' AS timestamp_source FROM log_lines JOIN (SELECT file, row_index AS line_no, "timestamp", confidence_score FROM imputed) i USING (file, line_no)""")
def log_05(spark, sf):
    return lg.impute_times(log_lines(spark, sf), imputed(spark, sf))


@query("log_05b_imputation_report", """
SELECT file, count(*) FILTER (line_no IS NOT NULL AND row_index IS NOT NULL) AS covered, count(*) FILTER (row_index IS NULL) AS uncovered, count(*) FILTER (line_no IS NULL) AS out_of_range
FROM (SELECT coalesce(l.file, i.file) AS file, l.line_no AS line_no, i.row_index AS row_index FROM log_lines l FULL JOIN imputed i ON l.file = i.file AND l.line_no = i.row_index) GROUP BY file""")
def log_05b(spark, sf):
    return lg.imputation_report(log_lines(spark, sf), imputed(spark, sf))


@query("join_10_positional", """
SELECT l.file AS file, line_no, i."timestamp" AS "timestamp" FROM log_lines l JOIN imputed i ON l.file = i.file AND l.line_no = i.row_index""")
def join_10(spark, sf):
    marks = imputed(spark, sf).select("file", F.col("row_index").alias("line_no"), "timestamp")
    return log_lines(spark, sf).join(marks, ["file", "line_no"]).select("file", "line_no", "timestamp")


EVENTS = "SELECT file, line_no, line, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS event_sequence, 'none' AS timestamp_source FROM log_lines"


@query("log_06_event_sequence", EVENTS)
def log_06(spark, sf):
    return lg.event_sequence(log_lines(spark, sf))


@query("win_01_sequence_small_chunks", f"SELECT file, line_no, event_sequence FROM ({EVENTS})")
def win_01(spark, sf):
    """The same numbering with chunks of 512 lines, so that the carry between chunks does most of the work."""
    return lg.event_sequence(log_lines(spark, sf), chunk_rows=512).select("file", "line_no", "event_sequence")


@query("log_07_prefixed_columns", "SELECT \"column\", count(*) AS n, count(value) AS n_known FROM log_long GROUP BY \"column\"")
def log_07(spark, sf):
    return lg.to_long(timed(spark, sf)).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"))


def log_answer(spark, sf):
    """A log answer per part: timed, imputed or neither, in JSON inside tags."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit('{"files": [{"file_name": "f'), k.cast("string"), F.lit('_log.csv", "timestamp_present": '), F.when(k % 3 == 0, "true").otherwise("false"),
        F.when(k % 3 == 1, F.concat(F.lit(', "imputed_timestamps": [{"row_index": 5, "timestamp": "2024-01-01T00:00:00"}], "confidence_score": '), (k % 10).cast("string"))).otherwise(""),
        F.lit("}]}"),
    )
    return table(spark, sf, "part").select(k.alias("batch"), F.concat(F.lit("ok <json_output>"), body, F.lit("</json_output>")).alias("answer"))


@query("log_08_timestamp_source", """
SELECT 'f' || p_partkey || '_log.csv' AS file_name, CASE p_partkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'imputed' ELSE 'none' END AS timestamp_source, p_partkey % 3 = 1 AND p_partkey % 10 < 8 AS low_confidence_imputation FROM part""")
def log_08(spark, sf):
    return an.log_answers(log_answer(spark, sf), "answer").select("file_name", "timestamp_source", "low_confidence_imputation")


@query("log_09_match_annotation", """
SELECT p_partkey AS batch, CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey || '_log.csv' WHEN 1 THEN 'upload/f' || p_partkey || '_log.csv' WHEN 2 THEN 'other.csv' ELSE 'late.csv' END AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' WHEN 2 THEN 'position' ELSE 'none' END AS matched_by, CASE WHEN p_partkey % 4 < 3 THEN 'f' || p_partkey || '_log.csv' END AS file_name FROM part""")
def log_09(spark, sf):
    answers = log_answer(spark, sf).select("batch", F.from_json(an.find_json(F.col("answer")), an.LOG_ANSWER)["files"].alias("files"))
    k = F.col("p_partkey")
    own = F.concat(F.lit("f"), k.cast("string"), F.lit("_log.csv"))
    name = F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("upload/"), own)).when(k % 4 == 2, "other.csv").otherwise("late.csv")
    files = table(spark, sf, "part").select(k.alias("batch"), name.alias("name"), F.when(k % 4 == 3, 1).otherwise(0).alias("position"))
    return lg.match_annotations(files, answers).select("batch", "name", "matched_by", F.col("annotation.file_name").alias("file_name"))


@query("log_10_unified", """
SELECT "timestamp", max(CASE WHEN "column" = 'click_props' THEN value END) AS click_props, max(CASE WHEN "column" = 'click_value' THEN value END) AS click_value, max(CASE WHEN "column" = 'error_user_id' THEN value END) AS error_user_id,
  max(CASE WHEN "column" = 'error_value' THEN value END) AS error_value, max(CASE WHEN "column" = 'purchase_props' THEN value END) AS purchase_props, max(CASE WHEN "column" = 'purchase_value' THEN value END) AS purchase_value,
  max(CASE WHEN "column" = 'signup_user_id' THEN value END) AS signup_user_id, max(CASE WHEN "column" = 'signup_value' THEN value END) AS signup_value,
  max(CASE WHEN "column" = 'view_props' THEN value END) AS view_props, max(CASE WHEN "column" = 'view_value' THEN value END) AS view_value, source_file, line_no
FROM log_long GROUP BY source_file, line_no, "timestamp" """)
def log_10(spark, sf):
    facts = facts_of(spark, sf)
    return lg.wide_by_position(log_lines(spark, sf), facts, lg.column_names(facts))


@query("log_10b_by_header", f"""
SELECT header, source_file, line_no, "timestamp", "column", value FROM (SELECT c.file AS source_file, c.row AS line_no, t."timestamp" AS "timestamp", name AS "column", CASE WHEN cell NOT IN {NULLS} THEN cell END AS value,
  CASE WHEN split_part(c.file, '_', 1) IN ('error', 'signup') THEN 'event time,user_id,value' ELSE 'timestamp,value,props' END AS header FROM named_log_cells c JOIN log_time t ON t.file = c.file AND t.row = c.row)""")
def log_10b(spark, sf):
    """Rows written in groups of equal headers, and opened again with their names."""
    base = work_folder(spark, "by-header")
    lg.write_by_header(log_lines(spark, sf), facts_of(spark, sf), base)
    named = spark.read.parquet(f"{base}/rows").join(spark.read.parquet(f"{base}/headers"), "header")
    return named.select(F.array_join("names", ",").alias("header"), "source_file", "line_no", "timestamp", F.inline(F.arrays_zip(F.col("names").alias("column"), F.col("values").alias("value"))))


@query("log_11_type_votes", """
SELECT "column", count(value) AS n_values, count(CASE WHEN regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 1 END) AS n_numeric,
  count(CASE WHEN regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 1 END) > 0.7 * count(value) AS is_numeric FROM log_long GROUP BY "column" """)
def log_11(spark, sf):
    return lg.type_votes(lg.to_long(timed(spark, sf)))


@query("log_11b_typed", """
SELECT "timestamp", source_file, line_no, max(CASE WHEN name = 'value' THEN TRY_CAST(value AS DOUBLE) END) AS value, max(CASE WHEN name = 'user_id' THEN TRY_CAST(value AS DOUBLE) END) AS user_id
FROM (SELECT c.file AS source_file, c.row AS line_no, t."timestamp" AS "timestamp", name, cell AS value FROM named_log_cells c JOIN log_time t ON t.file = c.file AND t.row = c.row WHERE col <> 0) GROUP BY 1, 2, 3""")
def log_11b(spark, sf):
    wide = lg.to_wide(timed(spark, sf, prefix=False), ["user_id", "value"])
    return lg.apply_types(wide, ["user_id", "value"])


@query("log_12_time_order", 'SELECT "timestamp", file AS source_file, row AS line_no FROM log_time ORDER BY 1, 2, 3')
def log_12(spark, sf):
    return lg.in_time_order(timed(spark, sf).select("timestamp", "source_file", "line_no"))


@query("log_15_common_zone", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR ELSE date_trunc('second', ts) END AS timestamp_utc FROM events""")
def log_15(spark, sf):
    k = F.col("event_id")
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(k % 3 == 0, F.concat(local, F.lit("+02:00"))).otherwise(local)
    zone = F.when(k % 3 == 1, "Asia/Tokyo").otherwise("UTC")
    e = table(spark, sf, "events").select("event_id", stamp.alias("stamp"), zone.alias("zone"))
    return lg.to_common_zone(e, "stamp", "zone").select("event_id", "timestamp_utc")


@query("log_16_resample", """
SELECT event_type, b AS bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY b) AS value, v IS NULL AS carried
FROM (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 10 MINUTE)) AS b FROM (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM events) GROUP BY event_type)
LEFT JOIN (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS b, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) USING (event_type, b)""")
def log_16(spark, sf):
    return lg.resample(table(spark, sf, "events"), "event_type", "ts", "value", "event_id", 600)


@query("log_17_fill_gaps", """
SELECT event_type, event_id, v, f AS forward_fill, coalesce(v, CASE WHEN f IS NOT NULL AND b IS NOT NULL THEN (f + b) / 2 ELSE coalesce(f, b) END) AS neighbour_mean FROM (
  SELECT event_type, event_id, v, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS f,
    first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM (SELECT event_type, event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events))""")
def log_17(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    from wellspark.functions.ordered import int_chunk

    return lg.fill_gaps(e, "event_type", "event_id", "v", int_chunk("event_id", 1000))


@query("win_05_carry_label", """
SELECT file, line_no, last_value(CASE WHEN line_no % 97 = 0 THEN line END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS label FROM log_lines""")
def win_05(spark, sf):
    from wellspark.functions.ordered import fill_forward, int_chunk

    label = F.when(F.col("line_no") % 97 == 0, F.col("line"))
    return fill_forward(log_lines(spark, sf), ["file"], ["line_no"], int_chunk("line_no", 1000), {"label": label}).select("file", "line_no", "label")


@query("src_06_raw_lines", "SELECT doc_id::VARCHAR AS file, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def src_06(spark, sf):
    from wellspark.sources.files import to_lines

    return to_lines(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


@query("src_08_header_less_grid", "SELECT file, row, col, cell FROM cells")
def src_08(spark, sf):
    from wellspark.plans.plates import plate_cells

    return plate_cells(spark, sf)


