"""Profile flags and time columns over table files table from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspark.operators import logs as lg, profile as pf
from wellspark.plans.registry import query, view
from wellspark.plans.views import table

view("prof_cells", """
SELECT file, row, unnest(range(len(names))) AS col, unnest(names) AS name, unnest(cells) AS cell FROM (
  SELECT CASE WHEN k = 7 THEN 'w' || o_orderkey ELSE 'f' || (o_custkey % 64) END AS file, o_orderkey + 1 AS row,
    CASE k WHEN 0 THEN ['timestamp', 'qty', 'price'] WHEN 1 THEN ['start_time', 'end_time', 'qty'] WHEN 2 THEN ['epoch_ms', 'qty', 'flag'] WHEN 3 THEN ['note', 'x_1', 'x_2', 'x_3']
      WHEN 4 THEN ['temp°', 'value', 'site'] WHEN 5 THEN ['value', 'value', 'rare'] WHEN 6 THEN ['time_local', 'mixed', 'event_note']
      ELSE list_transform(range(CASE WHEN o_orderkey % 5 = 0 THEN 104 ELSE 12 END), lambda i: 'c' || i) END AS names,
    CASE k WHEN 0 THEN [d, q, p] WHEN 1 THEN [d, d, q] WHEN 2 THEN [(1600000000 + o_orderkey)::VARCHAR, q, o_orderstatus] WHEN 3 THEN [CASE WHEN o_orderkey % 2 = 0 THEN '# checked' ELSE 'ok' END, q, '', '']
      WHEN 4 THEN [q || ' °C', q, 'A'] WHEN 5 THEN [p, '', CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END]
      WHEN 6 THEN ['2024-01-01 10:00-MST', CASE WHEN o_orderkey % 2 = 0 THEN q ELSE 'abc' END, 'seen at 2024-01-01T10:00Z']
      ELSE list_transform(range(CASE WHEN o_orderkey % 5 = 0 THEN 104 ELSE 12 END), lambda i: i::VARCHAR) END AS cells
  FROM (SELECT *, o_custkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, (o_orderkey % 50)::VARCHAR AS q, printf('%.2f', o_totalprice) AS p FROM orders))""")


def prof_cells(spark, sf):
    """64 table files of seven awkward kinds, and one wide single-row file per order of the eighth."""
    o, k = F.col("o_orderkey"), F.col("o_custkey") % 8
    d, q, p = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), (o % 50).cast("string"), F.format_string("%.2f", "o_totalprice")
    wide = F.sequence(F.lit(0), F.when(o % 5 == 0, 103).otherwise(11))
    text = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = F.lit("")
    names = (
        F.when(k == 0, text("timestamp", "qty", "price")).when(k == 1, text("start_time", "end_time", "qty")).when(k == 2, text("epoch_ms", "qty", "flag"))
        .when(k == 3, text("note", "x_1", "x_2", "x_3")).when(k == 4, text("temp°", "value", "site")).when(k == 5, text("value", "value", "rare"))
        .when(k == 6, text("time_local", "mixed", "event_note")).otherwise(F.transform(wide, lambda i: F.concat(F.lit("c"), i.cast("string"))))
    )
    cells = (
        F.when(k == 0, F.array(d, q, p)).when(k == 1, F.array(d, d, q)).when(k == 2, F.array((o + 1600000000).cast("string"), q, F.col("o_orderstatus")))
        .when(k == 3, F.array(F.when(o % 2 == 0, "# checked").otherwise("ok"), q, e, e)).when(k == 4, F.array(F.concat(q, F.lit(" °C")), q, F.lit("A")))
        .when(k == 5, F.array(p, e, F.when(o % 4 == 0, "x").otherwise("")))
        .when(k == 6, F.array(F.lit("2024-01-01 10:00-MST"), F.when(o % 2 == 0, q).otherwise("abc"), F.lit("seen at 2024-01-01T10:00Z")))
        .otherwise(F.transform(wide, lambda i: i.cast("string")))
    )
    file = F.when(k == 7, F.concat(F.lit("w"), o.cast("string"))).otherwise(F.concat(F.lit("f"), (F.col("o_custkey") % 64).cast("string")))
    rows = table(spark, sf, "orders").select(file.alias("file"), (o + 1).alias("row"), F.arrays_zip(names.alias("name"), cells.alias("cell")).alias("z"))
    return rows.select("file", "row", F.posexplode("z").alias("col", "z")).select("file", "row", "col", "z.name", "z.cell")


NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NULLS = "('', 'N/A', 'NaN', 'null', 'NULL', '-', 'missing', 'n/a')"
TS = "CASE WHEN regexp_matches(cell, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN TRY_CAST(cell AS TIMESTAMP) END"

view("prof_head", f"""
SELECT *, {TS} AS parsed FROM (SELECT *, row_number() OVER (PARTITION BY file, col ORDER BY row) AS k FROM prof_cells WHERE cell NOT IN {NULLS}) WHERE k <= 10""")

view("prof_known", f"SELECT *, {TS} AS parsed FROM prof_cells WHERE cell NOT IN {NULLS}")

view("prof_time", """
SELECT file, ts_col, ts_name, step FROM (SELECT file, col AS ts_col, name AS ts_name, step, row_number() OVER (PARTITION BY file ORDER BY step, col) AS k FROM (
  SELECT file, col, name, CASE WHEN lower(trim(name)) IN ('timestamp', 'time', 'datetime', 'date_time', 'created_at', 'updated_at', 'event_time', 'log_time', 'recorded_at') THEN 1
    WHEN regexp_matches(lower(name), 'time|date|stamp') AND n > 0 AND parsed = n THEN 2 WHEN col < 3 AND parsed > 0 THEN 3 END AS step
  FROM (SELECT DISTINCT file, col, name FROM prof_cells) LEFT JOIN (SELECT file, col, count(*) AS n, count(parsed) AS parsed FROM prof_known GROUP BY file, col) USING (file, col)) WHERE step IS NOT NULL) WHERE k = 1""")

view("prof_rows", f"""
SELECT file, row, count(CASE WHEN cell NOT IN {NULLS} THEN 1 END) AS filled, bool_or(starts_with(trim(cell), '#')) AS comment FROM prof_cells GROUP BY file, row""")

view("prof_cols", f"""
SELECT s.file, s.col, s.name, n_known, n_known > n_numeric AS is_text, n10, num10, embedded, epoch_values, odd_values, unit_values
FROM (SELECT file, col, name, count(CASE WHEN cell NOT IN {NULLS} THEN 1 END) AS n_known, count(CASE WHEN cell NOT IN {NULLS} AND regexp_matches(cell, '{NUM}') THEN 1 END) AS n_numeric FROM prof_cells GROUP BY ALL) s
LEFT JOIN (SELECT file, col, count(*) AS n10, count(*) FILTER (regexp_matches(regexp_replace(cell, '[.-]', '', 'g'), '^[0-9]+$')) AS num10,
   bool_or(((contains(cell, 'T') AND contains(cell, 'Z')) OR (contains(cell, 'at 20') AND contains(cell, ':')))) AS embedded,
   bool_or(coalesce(TRY_CAST(cell AS DOUBLE) BETWEEN 1e9 AND 9999999999999, FALSE)) AS epoch_values,
   bool_or((regexp_matches(cell, '-MST|-PST|-EST|-GMT') OR (length(cell) > 10 AND regexp_matches(cell, '[0-9]') AND parsed IS NULL))) AS odd_values,
   bool_or(regexp_matches(cell, '°|§|µ|±|HPA|L/MIN|KG/M3')) AS unit_values FROM prof_known GROUP BY file, col) h ON h.file = s.file AND h.col = s.col""")

view("prof_flags", """
SELECT c.*, n_rows <= 2 AND n_cols > 10 AS transposed, n_rows > 5 AND least_filled < n_cols * 0.5 AS irregular_rows, comment_cells, n_rows FROM (
 SELECT file, count(*) AS n_cols, count(*) FILTER (regexp_matches(lower(name), 'time|date')) > 1 AS many_time_columns, count(DISTINCT name) < count(*) AS duplicate_names,
  bool_or(n_known / nr::DOUBLE < 0.5) AS mostly_missing_column, bool_or(coalesce(is_text AND n10 > 5 AND least(num10, n10 - num10) >= 2, FALSE)) AS mixed_types,
  count(*) FILTER (regexp_matches(lower(name), 'unnamed:|column_|field_|var_|x\\.|x_')) > 2 AS suspicious_names, count(*) > 100 AS very_wide,
  bool_or(coalesce(is_text AND embedded, FALSE)) AS embedded_timestamps, bool_or(coalesce(NOT is_text AND (regexp_matches(lower(name), 'epoch|millis|unix|tick') OR coalesce(epoch_values, FALSE)), FALSE)) AS epoch_column,
  bool_or(coalesce(regexp_matches(lower(name), 'time|date|stamp') AND odd_values, FALSE)) AS odd_time_format, bool_or(regexp_matches(name, '[^\\x00-\\x7F]')) AS non_ascii_names,
  bool_or(coalesce(is_text AND unit_values, FALSE)) AS units_in_values FROM prof_cols JOIN (SELECT file, count(*) AS nr FROM prof_rows GROUP BY file) USING (file) GROUP BY file) c
JOIN (SELECT file, count(*) AS n_rows, min(filled) AS least_filled, bool_or(comment) AS comment_cells FROM prof_rows GROUP BY file) r USING (file)""")

ANY = " OR ".join(pf.FLAGS)


def profile(spark, sf):
    return pf.profile_files(prof_cells(spark, sf))


def _register(i: int, flag: str) -> None:
    @query(f"prf_{i:02d}_{flag}", f"SELECT file, {flag} FROM prof_flags")
    def run(spark, sf):
        return profile(spark, sf).select("file", flag)


for _i, _flag in enumerate(pf.FLAGS, 1):
    _register(_i, _flag)


@query("log_01_time_column", "SELECT file, ts_col, ts_name, step::BIGINT AS step FROM prof_time")
def log_01(spark, sf):
    return lg.time_column(prof_cells(spark, sf))


@query("log_02_standard_structure", f"""
SELECT file, n_rows, n_cols, ({ANY}) AS needs_annotation, ts_col, ts_name, NOT ({ANY}) AND ts_col IS NOT NULL AND n_cols >= 2 AS is_standard FROM prof_flags LEFT JOIN prof_time USING (file)""")
def log_02(spark, sf):
    return profile(spark, sf).select("file", "n_rows", "n_cols", "needs_annotation", "ts_col", "ts_name", "is_standard")


@query("log_14_routing", f"""
SELECT file, CASE WHEN NOT ({ANY}) AND ts_col IS NOT NULL AND n_cols >= 2 THEN 'fast' ELSE 'annotated' END AS method FROM prof_flags LEFT JOIN prof_time USING (file)""")
def log_14(spark, sf):
    return lg.route(profile(spark, sf))


@query("log_13_run_summary", f"""
SELECT method, count(*) AS files, count(*) FILTER (n_rows > 0) AS succeeded, count(*) FILTER (n_rows = 0) AS failed, round(count(*) FILTER (n_rows > 0) * 100.0::DOUBLE / count(*), 4) AS success_rate
FROM (SELECT n_rows, CASE WHEN NOT ({ANY}) AND ts_col IS NOT NULL AND n_cols >= 2 THEN 'fast' ELSE 'annotated' END AS method FROM prof_flags LEFT JOIN prof_time USING (file)) GROUP BY method""")
def log_13(spark, sf):
    p = profile(spark, sf)
    method = F.when(F.col("is_standard"), "fast").otherwise("annotated")
    return lg.run_summary(p.select(method.alias("method"), (F.col("n_rows") > 0).alias("ok")))


@query("win_04_first_values", "SELECT file, col, name, row, cell, k FROM prof_head")
def win_04(spark, sf):
    return lg.first_values(prof_cells(spark, sf), 10).select("file", "col", "name", "row", "cell", "k")
