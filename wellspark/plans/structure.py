"""Delimiter, header and block detection over table plate files."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.functions.values import is_num, null_token, to_num
from wellspark.operators import structure as st
from wellspark.plans.registry import query, view
from wellspark.plans.views import log_lines, raw_lines, table
from wellspark.session import settle


def _clean(spark, sf):
    return st.fix_decimal_commas(st.strip_bom(raw_lines(spark, sf)))


def _found(lines):
    """Delimiter of each file, settled so that the join with the lines is planned by its true size."""
    return settle(st.detect_delimiter(lines), "delimiters")


@query("txt_01_strip_bom", "SELECT file, line_no, regexp_replace(line, '^' || chr(65279), '') AS line FROM raw_lines")
def txt_01(spark, sf):
    return st.strip_bom(raw_lines(spark, sf))


@query("txt_02_decimal_comma", "SELECT file, line_no, line FROM clean_lines")
def txt_02(spark, sf):
    return _clean(spark, sf)


@query("txt_03_delimiter_score", """
SELECT file, delimiter, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, rank) AS k FROM scores) WHERE k = 1""")
def txt_03(spark, sf):
    return st.detect_delimiter(_clean(spark, sf), fixed=False).withColumn("score", F.round("score", 6))


@query("txt_03b_delimiter_score_fixed", "SELECT file, delimiter, round(score, 6) AS score FROM detected")
def txt_03b(spark, sf):
    return st.detect_delimiter(_clean(spark, sf)).withColumn("score", F.round("score", 6))


@query("txt_04_delimiter_count", """
SELECT file, CASE WHEN c > 0 AND s > c THEN ';' WHEN c = m THEN ',' WHEN s = m THEN ';' WHEN t = m THEN chr(9) ELSE '|' END AS delimiter
FROM (SELECT *, greatest(c, s, t, p) AS m FROM (
  SELECT file, sum(length(line) - length(replace(line, ',', ''))) AS c, sum(length(line) - length(replace(line, ';', ''))) AS s,
    sum(length(line) - length(replace(line, chr(9), ''))) AS t, sum(length(line) - length(replace(line, '|', ''))) AS p
  FROM (SELECT file, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM raw_lines) GROUP BY file))""")
def txt_04(spark, sf):
    return st.detect_delimiter_by_count(raw_lines(spark, sf))


view("header_view", """
SELECT file, coalesce(min(CASE WHEN n > 4 AND k > n * 0.5 THEN line_no END), 1) AS header_rows
FROM (SELECT file, line_no, len(p) AS n, len(list_filter(p, lambda x: regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'))) AS k
      FROM (SELECT file, line_no, list_filter(regexp_split_to_array(replace(line, ',', '.'), '\\s+'), lambda x: x <> '') AS p FROM clean_lines))
GROUP BY file""")


@query("txt_06_header_rows", "SELECT file, header_rows FROM header_view")
def txt_06(spark, sf):
    return st.header_rows(_clean(spark, sf))


@query("txt_07_plate_label_row", """
SELECT file, min(CASE WHEN contains(lower(line), 'plate') AND contains(lower(line), 'id') THEN line_no END) AS plate_id_row,
  bool_or(contains(lower(line), 'plate') AND contains(lower(line), 'id')) AS has_plate_id
FROM raw_lines GROUP BY file""")
def txt_07(spark, sf):
    return st.plate_label_row(raw_lines(spark, sf))


@query("txt_08_column_pattern", """
SELECT file, line_no, len(string_split(line, delimiter)) AS n_cols FROM clean_lines JOIN detected USING (file) WHERE regexp_matches(line, '\\S')""")
def txt_08(spark, sf):
    lines = _clean(spark, sf)
    return st.column_pattern(lines, _found(lines))


view("starts", """
SELECT file, coalesce(min(CASE WHEN n = 12 AND k > 8.4 THEN line_no END), any_value(header_rows)) AS data_start
FROM (SELECT file, line_no, len(p) AS n, len(list_filter(p, lambda x: regexp_matches(trim(CASE WHEN contains(x, ',') AND NOT contains(x, '.') THEN replace(x, ',', '.') ELSE x END), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'))) AS k
      FROM (SELECT file, line_no, string_split(line, delimiter) AS p FROM clean_lines JOIN detected USING (file) WHERE regexp_matches(line, '\\S')))
JOIN header_view USING (file) GROUP BY file""")

view("blocks", """
SELECT file, data_start, coalesce(min(CASE WHEN line_no > data_start AND
   (NOT regexp_matches(line, '\\S') OR len(string_split(trim(line), delimiter)) < greatest(2.0, expected * 0.5) OR regexp_matches(lower(line), 'total|summary|notes|comments|analysis')) THEN line_no END),
   max(line_no) + 1) AS data_end
FROM clean_lines JOIN detected USING (file) JOIN starts USING (file)
JOIN (SELECT file, mode_n AS expected FROM (SELECT file, n AS mode_n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, n) AS k
      FROM (SELECT file, len(string_split(line, delimiter)) AS n FROM clean_lines JOIN detected USING (file) JOIN starts USING (file)
            WHERE line_no >= data_start AND regexp_matches(line, '\\S')) GROUP BY file, n) WHERE k = 1) USING (file)
GROUP BY file, data_start""")


def _block(spark, sf):
    lines = _clean(spark, sf)
    found = _found(lines)
    starts = settle(st.data_start(lines, found, st.header_rows(lines)), "starts")
    return lines, found, st.data_block(lines, found, starts)


@query("txt_09_data_block", "SELECT file, data_start, data_end FROM blocks")
def txt_09(spark, sf):
    return _block(spark, sf)[2]


@query("txt_05_delimiter_uniform", """
SELECT file, delimiter, n_cols FROM (SELECT file FROM blocks) LEFT JOIN (SELECT file, delimiter, n_cols FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY n_cols DESC, rank) AS k FROM (
    SELECT file, rank, delimiter, min(n) AS n_cols FROM (
      SELECT file, rank, delimiter, len(string_split(line, delimiter)) AS n FROM clean_lines JOIN blocks USING (file)
      CROSS JOIN (VALUES (0, chr(9)), (1, ','), (2, ';'), (3, '|'), (4, '  ')) AS o(rank, delimiter)
      WHERE line_no >= data_start AND line_no < data_end AND regexp_matches(line, '\\S'))
    GROUP BY ALL HAVING min(n) = max(n) AND min(n) > 1)) WHERE k = 1) USING (file)""")
def txt_05(spark, sf):
    lines, _, blocks = _block(spark, sf)
    return st.detect_uniform_delimiter(lines, blocks)


@query("txt_10_cells", "SELECT file, row, col, cell FROM cells")
def txt_10(spark, sf):
    lines = _clean(spark, sf)
    return st.to_cells(lines, _found(lines))


view("log_cells", """
SELECT file, line_no AS row, unnest(range(len(parts))) AS col,
  trim(CASE WHEN regexp_matches(unnest(parts), '^\\s*".*"\\s*$') THEN replace(regexp_replace(unnest(parts), '^\\s*"|"\\s*$', '', 'g'), '""', '"') ELSE unnest(parts) END) AS cell
FROM (SELECT file, line_no, regexp_extract_all(line || ',', '("(?:[^"]|"")*"[^,]*|[^,]*),', 1) AS parts FROM log_lines WHERE regexp_matches(line, '\\S'))""")


def log_cells(spark, sf):
    lines = log_lines(spark, sf)
    comma = lines.filter(F.col("line_no") == 0).select("file", F.lit(",").alias("delimiter"))
    return st.to_cells(lines, settle(comma, "delimiters"))


@query("txt_10b_quoted_cells", "SELECT file, row, col, cell FROM log_cells")
def txt_10b(spark, sf):
    return log_cells(spark, sf)


@query("txt_11_null_tokens", """
SELECT file, row, col, CASE WHEN cell NOT IN ('', 'N/A', 'NaN', 'null', 'NULL', '-', 'missing', 'n/a') THEN cell END AS cell FROM log_cells""")
def txt_11(spark, sf):
    return log_cells(spark, sf).withColumn("cell", null_token("cell"))


NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
view("typed_raw", f"""
SELECT file, row, col, cell, CASE WHEN regexp_matches(p, '{NUM}') THEN TRY_CAST(p AS DOUBLE) END AS value_num, regexp_matches(p, '{NUM}') AS is_number
FROM (SELECT *, CASE WHEN contains(cell, ',') AND NOT contains(cell, '.') THEN replace(cell, ',', '.') ELSE cell END AS p
      FROM (SELECT file, line_no AS row, unnest(range(len(string_split(line, ';')))) AS col, trim(unnest(string_split(line, ';'))) AS cell FROM raw_lines))""")


@query("txt_12_numbers", "SELECT file, row, col, cell, value_num, is_number FROM typed_raw")
def txt_12(spark, sf):
    parts = raw_lines(spark, sf).select("file", F.col("line_no").alias("row"), F.posexplode(F.split("line", ";")).alias("col", "cell"))
    cells = parts.withColumn("cell", F.trim("cell"))
    return cells.withColumn("value_num", to_num("cell")).withColumn("is_number", is_num("cell"))


view("padded", """
SELECT file, row, c AS col, cell, 'Col_' || (c + 1) AS name FROM (SELECT DISTINCT file, row FROM cells)
JOIN (SELECT file, max(col) AS last FROM cells GROUP BY file) USING (file)
JOIN (SELECT unnest(range(200)) AS c) ON c <= last LEFT JOIN (SELECT file, row, col AS c, cell FROM cells) USING (file, row, c)""")


@query("txt_13_pad_rows", "SELECT file, row, col, cell, name FROM padded")
def txt_13(spark, sf):
    lines = _clean(spark, sf)
    return st.pad_rows(lines, _found(lines))


# Text documents cut at spaces give every shape: single words, and far over fifty columns.
view("word_cells", """
SELECT doc_id::VARCHAR AS file, line_no AS row, unnest(range(len(p))) AS col, unnest(p) AS cell
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, string_split(unnest(string_split(text, chr(10))), ' ') AS p FROM documents)""")


def word_cells(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    return lines.select("file", "row", F.posexplode(F.split("line", " ", -1)).alias("col", "cell"))


@query("txt_14_shape_rules", """
SELECT file, row, col, cell, n AS n_cols, n > 50 AS wide FROM word_cells JOIN (SELECT file, max(col) + 1 AS n FROM word_cells GROUP BY file) USING (file) WHERE n >= 2""")
def txt_14(spark, sf):
    return st.apply_shape_rules(word_cells(spark, sf))


@query("txt_14b_rejected_files", """
SELECT file, n_cells, 'fewer than two columns' AS reason FROM (SELECT file, max(col) + 1 AS n, count(*) AS n_cells FROM word_cells GROUP BY file) WHERE n < 2""")
def txt_14b(spark, sf):
    return st.rejected_files(word_cells(spark, sf))


@query("txt_15_empty_plates", """
SELECT file, r AS row, c AS col, NULL::VARCHAR AS cell FROM (SELECT file FROM padded WHERE row = 0 GROUP BY file HAVING count(cell) < 12)
CROSS JOIN (SELECT unnest(range(8)) AS r) CROSS JOIN (SELECT unnest(range(12)) AS c)""")
def txt_15(spark, sf):
    """Files whose label line is ragged fail the strict header-less reader and fall back to an empty grid."""
    lines = _clean(spark, sf)
    padded = st.pad_rows(lines, _found(lines)).filter(F.col("row") == 0)
    failed = padded.groupBy("file").agg(F.count("cell").alias("n")).filter(F.col("n") < 12)
    return st.empty_plates(failed)


@query("txt_16_duplicate_headers", """
SELECT file, len(p) <> len(list_distinct(p)) AS duplicate_headers
FROM (SELECT file, list_transform(string_split(trim(line), ','), lambda x: trim(x)) AS p FROM clean_lines WHERE line_no = 0)""")
def txt_16(spark, sf):
    return st.duplicate_headers(_clean(spark, sf))


view("log_starts", """
SELECT file, 0::BIGINT AS hint, coalesce(min(CASE WHEN regexp_matches(line, '\\S') AND NOT starts_with(trim(line), '#') AND
   (contains(line, 'EVENT_ID:') OR (regexp_matches(line, '[0-9]') AND (contains(line, ':') OR contains(line, '-')))
    OR (NOT regexp_matches(lower(line), 'time|event|column|header|name') AND (contains(line, ',') OR contains(line, chr(9)) OR regexp_matches(line, '\\S\\s+\\S')))) THEN line_no END),
   max(CASE WHEN line_no = 1 AND regexp_matches(line, '\\S') THEN line_no END), 0) AS data_start
FROM log_lines GROUP BY file""")


def log_starts(spark, sf):
    lines = log_lines(spark, sf)
    return st.correct_data_start(lines, lines.filter(F.col("line_no") == 0).select("file", F.lit(0).alias("hint")))


@query("txt_17_correct_data_start", "SELECT file, hint, data_start FROM log_starts")
def txt_17(spark, sf):
    return log_starts(spark, sf)


@query("txt_18_names_from_data", """
SELECT file, col, CASE WHEN trim(cell) = '' OR trim(cell) = 'nan' THEN 'col_' || col WHEN contains(cell, ':') THEN split_part(cell, ':', 1)
  WHEN contains(trim(cell), ',') AND length(split_part(trim(cell), ',', 1)) BETWEEN 1 AND 19 THEN split_part(trim(cell), ',', 1) ELSE 'col_' || col END AS name
FROM log_cells JOIN log_starts USING (file) WHERE row = data_start""")
def txt_18(spark, sf):
    return st.names_from_first_row(log_cells(spark, sf), log_starts(spark, sf))


view("named_log_cells", """
SELECT file, row, c.col AS col, coalesce(nullif(h.cell, ''), 'col_' || c.col) AS name, c.cell AS cell
FROM log_cells c JOIN (SELECT file, CASE WHEN file IN ('error_log.csv', 'signup_log.csv') THEN 2 ELSE 0 END AS header_row,
   CASE WHEN file IN ('error_log.csv', 'signup_log.csv') THEN 3 ELSE 1 END AS start_row FROM log_starts) USING (file)
LEFT JOIN (SELECT file, row AS header_row, col, cell FROM log_cells) h USING (file, header_row, col) WHERE row >= start_row""")


def log_annotation(spark, sf):
    """Header and data rows as an annotator would give them."""
    files = log_lines(spark, sf).filter(F.col("line_no") == 0).select("file")
    noisy = F.col("file").isin("error_log.csv", "signup_log.csv")
    return files.select("file", F.when(noisy, 2).otherwise(0).alias("header_row"), F.when(noisy, 3).otherwise(1).alias("data_start"))


def named_log_cells(spark, sf):
    return st.named_cells(log_cells(spark, sf), log_annotation(spark, sf))


@query("txt_19_named_cells", "SELECT file, row, col, name, cell FROM named_log_cells")
def txt_19(spark, sf):
    return named_log_cells(spark, sf)


@query("txt_20_simple_parse", """
SELECT file, row, col, name, cell FROM (SELECT file, line_no AS row, unnest(range(len(p))) AS col, trim(unnest(p)) AS cell
  FROM (SELECT file, line_no, string_split(line, ',') AS p FROM raw_lines WHERE line_no > 0 AND regexp_matches(line, '\\S')))
JOIN (SELECT file, unnest(range(len(p))) AS col, trim(unnest(p)) AS name FROM (SELECT file, string_split(line, ',') AS p FROM raw_lines WHERE line_no = 0)) USING (file, col)""")
def txt_20(spark, sf):
    return st.simple_parse(raw_lines(spark, sf))


@query("txt_21_parse_log", """
SELECT file, n_rows, n_cols, delimiter, header_rows FROM (SELECT file, count(DISTINCT row) AS n_rows, max(col) + 1 AS n_cols FROM cells GROUP BY file)
JOIN detected USING (file) JOIN header_view USING (file)""")
def txt_21(spark, sf):
    lines = _clean(spark, sf)
    found = _found(lines)
    return st.parse_log(st.to_cells(lines, found), found, st.header_rows(lines))


@query("agg_24_mode_width", """
SELECT file, n_cols, n FROM (SELECT file, n_cols, count(*) AS n, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, n_cols) AS k
  FROM (SELECT file, len(string_split(line, delimiter)) AS n_cols FROM clean_lines JOIN detected USING (file)) GROUP BY file, n_cols) WHERE k = 1""")
def agg_24(spark, sf):
    lines = _clean(spark, sf)
    widths = lines.join(_found(lines), "file").select("file", st.width_by(F.col("line"), F.col("delimiter")).alias("n_cols"))
    counts = widths.groupBy("file", "n_cols").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("file").agg(F.max_by(F.struct("n_cols", "n"), F.struct(F.col("n"), -F.col("n_cols"))).alias("m")).select("file", "m.n_cols", "m.n")
