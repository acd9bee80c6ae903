"""The given tables seen as laboratory files and as usage entities.

Each view exists twice: as a DataFrame here and as SQL text for the twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wellspark.functions.ordered import sessionize
from wellspark.plans.registry import view

USAGE_AS_OF = "2024-01-31 00:00:00"
EXPERIMENTS_AS_OF = "2001-08-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


# --- plates -----------------------------------------------------------------

view("grid", "SELECT o_orderkey // 96 AS plate, (o_orderkey % 96) // 12 AS r, o_orderkey % 12 AS c, o_totalprice AS v, o_orderpriority AS label FROM orders")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.floor(k / 96).alias("plate"), F.floor((k % 96) / 12).alias("r"), (k % 12).alias("c"),
        F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("label"),
    )


view("delims", """SELECT DISTINCT plate, CASE plate % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS d FROM grid""")


def delimiter_of(plate: Column) -> Column:
    m = plate % 4
    return F.when(m == 0, ",").when(m == 1, ";").when(m == 2, "\t").otherwise("|")


view("plate_rows", """
SELECT plate, r, d, CASE d WHEN ',' THEN string_agg(x, ',' ORDER BY c) WHEN ';' THEN string_agg(x, ';' ORDER BY c)
  WHEN '|' THEN string_agg(x, '|' ORDER BY c) ELSE string_agg(x, chr(9) ORDER BY c) END AS line
FROM (SELECT *, CASE WHEN plate % 4 = 1 THEN replace(printf('%.2f', v), '.', ',') ELSE printf('%.2f', v) END AS x FROM grid) JOIN delims USING (plate)
GROUP BY plate, r, d""")

view("raw_lines", """
SELECT 'plate_' || plate || '.csv' AS file, 0::BIGINT AS line_no,
       CASE WHEN plate % 3 = 0 THEN chr(65279) ELSE '' END || 'Plate ID ' || plate || CASE WHEN plate % 8 < 4 THEN repeat(d, 11) ELSE '' END AS line
FROM delims
UNION ALL SELECT 'plate_' || plate || '.csv', r + 1, line FROM plate_rows
UNION ALL SELECT 'plate_' || plate || '.csv', 9, '' FROM delims WHERE plate % 5 = 0
UNION ALL SELECT 'plate_' || plate || '.csv', 10, 'Notes: checked by hand' FROM delims WHERE plate % 5 = 0""")


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Plate files as raw lines: four delimiters, decimal commas, BOMs, blank lines and notes."""
    g = grid(spark, sf)
    cell = F.format_string("%.2f", "v")
    cell = F.when(F.col("plate") % 4 == 1, F.replace(cell, F.lit("."), F.lit(","))).otherwise(cell)
    rows = g.groupBy("plate", "r").agg(*[F.max(F.when(F.col("c") == i, cell)).alias(f"c{i}") for i in range(12)])
    d = delimiter_of(F.col("plate"))
    file = F.concat(F.lit("plate_"), F.col("plate").cast("string"), F.lit(".csv")).alias("file")

    def joined(sep: str) -> Column:
        return F.concat_ws(sep, *[f"c{i}" for i in range(12)])

    body = F.when(d == ",", joined(",")).when(d == ";", joined(";")).when(d == "\t", joined("\t")).otherwise(joined("|"))
    data = rows.select(file, (F.col("r") + 1).alias("line_no"), body.alias("line"))
    bom = F.when(F.col("plate") % 3 == 0, "﻿").otherwise("")
    tail = F.when(F.col("plate") % 8 < 4, F.repeat(d, F.lit(11))).otherwise("")
    label = F.concat(bom, F.lit("Plate ID "), F.col("plate").cast("string"), tail)
    # The well with position 0 exists once per plate, so it stands for the plate.
    plates = g.filter((F.col("r") == 0) & (F.col("c") == 0))
    noted = F.when(F.col("plate") % 5 == 0, F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), label.alias("line")),
        F.struct(F.lit(9).cast("long").alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(10).cast("long").alias("line_no"), F.lit("Notes: checked by hand").alias("line")),
    )).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), label.alias("line"))))
    extra = plates.select(file, F.inline(noted))
    return data.unionByName(extra)


# Two CSV-like views: the cells of plate files as the splitter should see them.
view("clean_lines", """
SELECT file, line_no, CASE WHEN length(line) - length(replace(line, ',', '')) > 0
  AND length(line) - length(replace(line, ';', '')) > length(line) - length(replace(line, ',', ''))
  THEN regexp_replace(line, '\\b([0-9]+),([0-9]+)\\b', '\\1.\\2', 'g') ELSE line END AS line
FROM (SELECT file, line_no, regexp_replace(line, '^' || chr(65279), '') AS line FROM raw_lines)""")

view("candidate_widths", """
SELECT file, line_no, rank, delimiter, length(line) - length(replace(line, delimiter, '')) + 1 AS n_cols
FROM clean_lines CROSS JOIN (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) AS o(rank, delimiter)
WHERE regexp_matches(line, '\\S')""")

view("scores", """
SELECT file, rank, delimiter, n_cols,
  n * 100.0::DOUBLE / total + CASE WHEN n_cols IN (8, 12, 96) THEN 50 WHEN n_cols > 4 THEN 10 ELSE 0 END
  - CASE WHEN n_cols < 2 THEN 50 WHEN n_cols > 50 THEN 20 ELSE 0 END
  + CASE WHEN delimiter = ';' AND n::DOUBLE / total > 0.8 THEN 20 ELSE 0 END AS score
FROM (SELECT *, row_number() OVER (PARTITION BY file, rank ORDER BY n DESC, n_cols) AS k, sum(n) OVER (PARTITION BY file, rank) AS total
      FROM (SELECT file, rank, delimiter, n_cols, count(*) AS n FROM candidate_widths GROUP BY ALL))
WHERE k = 1""")

view("detected", """
SELECT file, delimiter, score FROM (SELECT file, rank, delimiter, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, rank) AS k
  FROM (SELECT file, rank, delimiter, CASE WHEN n_cols < 2 THEN 0 ELSE score END AS score FROM scores)) WHERE k = 1""")

view("cells", """
SELECT file, line_no AS row, unnest(range(len(parts))) AS col, trim(unnest(parts)) AS cell
FROM (SELECT file, line_no, string_split(line, delimiter) AS parts FROM clean_lines JOIN detected USING (file) WHERE regexp_matches(line, '\\S'))""")

view("annotation", """
SELECT DISTINCT 'plate_' || plate || '.csv' AS file, CASE WHEN plate % 6 = 0 THEN NULL ELSE 'P' || plate END AS plate_id,
  1::BIGINT AS start_row, CASE WHEN plate % 2 = 0 THEN 7 ELSE 8 END::BIGINT AS end_row, 0::BIGINT AS start_col, 11::BIGINT AS end_col FROM grid""")


def annotation(spark: SparkSession, sf: str) -> DataFrame:
    """Where the grid sits in each file; half of the end rows are one short."""
    plates = grid(spark, sf).filter((F.col("r") == 0) & (F.col("c") == 0))
    p = F.col("plate")
    return plates.select(
        F.concat(F.lit("plate_"), p.cast("string"), F.lit(".csv")).alias("file"),
        F.when(p % 6 != 0, F.concat(F.lit("P"), p.cast("string"))).alias("plate_id"),
        F.lit(1).alias("start_row"), F.when(p % 2 == 0, 7).otherwise(8).alias("end_row"),
        F.lit(0).alias("start_col"), F.lit(11).alias("end_col"),
    )


view("data_wells", """SELECT 'P' || plate AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS well_id, printf('%.2f', v) AS "raw data" FROM grid""")
view("map_wells", """SELECT 'P' || plate AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS well_id, label AS "raw mapping" FROM grid WHERE (plate * 96 + r * 12 + c) % 7 <> 0""")


def _well_keys() -> list[Column]:
    return [
        F.concat(F.lit("P"), F.col("plate").cast("string")).alias("plate_id"),
        F.concat(F.char(F.lit(65) + F.col("r").cast("int")), (F.col("c") + 1).cast("string")).alias("well_id"),
    ]


def data_wells(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf).select(*_well_keys(), F.format_string("%.2f", "v").alias("raw data"))


def map_wells(spark: SparkSession, sf: str) -> DataFrame:
    missing = (F.col("plate") * 96 + F.col("r") * 12 + F.col("c")) % 7 == 0
    return grid(spark, sf).filter(~missing).select(*_well_keys(), F.col("label").alias("raw mapping"))


view("scopes", """
SELECT 'P' || p_partkey AS plate_id, 1 AS row_from, 1 + p_size % 8 AS row_to, 1 AS col_from, 12 AS col_to, 'brand' AS field, p_brand AS value FROM part
UNION ALL SELECT 'P' || p_partkey, 1, 8, 1 + p_size % 12, 1 + p_size % 12, 'kind', p_type FROM part""")


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    pid = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("plate_id")
    rows = part.select(pid, F.lit(1).alias("row_from"), (1 + F.col("p_size") % 8).alias("row_to"), F.lit(1).alias("col_from"),
                       F.lit(12).alias("col_to"), F.lit("brand").alias("field"), F.col("p_brand").alias("value"))
    one = 1 + F.col("p_size") % 12
    cols = part.select(pid, F.lit(1).alias("row_from"), F.lit(8).alias("row_to"), one.alias("col_from"), one.alias("col_to"),
                       F.lit("kind").alias("field"), F.col("p_type").alias("value"))
    return rows.unionByName(cols)


view("protocol_wells", """
SELECT plate_id, well_id, max(CASE WHEN field = 'brand' THEN value END) AS protocol_brand, max(CASE WHEN field = 'kind' THEN value END) AS protocol_kind
FROM (SELECT plate_id, field, value, chr((64 + r)::INTEGER) || c AS well_id
      FROM scopes JOIN (SELECT unnest(range(1, 9)) AS r) ON r BETWEEN row_from AND row_to
      JOIN (SELECT unnest(range(1, 13)) AS c) ON c BETWEEN col_from AND col_to)
GROUP BY plate_id, well_id""")


# --- instrument logs ----------------------------------------------------------

NOISY_LOGS = ["error", "signup"]

view("log_values", """
SELECT event_type || '_log.csv' AS file, event_type, event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'n/a' ELSE printf('%.2f', value) END AS value_text, props
FROM events""")

view("log_lines", """
SELECT file, event_id + 3 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || user_id || ',' || value_text AS line FROM log_values WHERE event_type IN ('error', 'signup')
UNION ALL SELECT file, event_id + 1, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || value_text || ',"' || replace(props, '"', '""') || '"' FROM log_values WHERE event_type NOT IN ('error', 'signup')
UNION ALL SELECT DISTINCT file, 0, CASE WHEN event_type IN ('error', 'signup') THEN '# device log' ELSE 'timestamp,value,props' END FROM log_values
UNION ALL SELECT DISTINCT file, 2, 'event time,user_id,value' FROM log_values WHERE event_type IN ('error', 'signup')""")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One log file per event type: noisy ones have a comment and a late header, the others quoted JSON."""
    e = table(spark, sf, "events")
    file = F.concat("event_type", F.lit("_log.csv"))
    noisy = F.col("event_type").isin(NOISY_LOGS)
    k = F.col("event_id")
    value = F.when(k % 11 == 0, "").when(k % 17 == 0, "n/a").otherwise(F.format_string("%.2f", "value"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(noisy, F.concat_ws(",", stamp, F.col("user_id").cast("string"), value)).otherwise(F.concat_ws(",", stamp, value, quoted))
    data = e.select(file.alias("file"), F.when(noisy, k + 3).otherwise(k + 1).alias("line_no"), line.alias("line"))
    heads = F.when(noisy, F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("# device log").alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("event time,user_id,value").alias("line")),
    )).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("timestamp,value,props").alias("line"))))
    files = e.select("event_type").distinct()
    return data.unionByName(files.select(file.alias("file"), F.inline(heads)))


# --- usage entities -------------------------------------------------------------

view("organizations", """
SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey <> 0 AS is_active, TIMESTAMP '2000-01-01' + to_days(n_nationkey * 24) AS created_at FROM nation""")


def organizations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("is_active"),
        (ntz("2000-01-01 00:00:00") + F.make_dt_interval(F.col("n_nationkey") * 24)).alias("created_at"),
    )


view("users", """
SELECT c_custkey AS id, c_nationkey::BIGINT AS organization_id,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_name END AS full_name,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 5000 THEN '' ELSE 'user_' || c_custkey END AS username,
  lower(c_name) || '@example.org' AS email, c_acctbal >= 0 AS is_active, c_custkey % 10 = 0 AS is_admin, c_custkey % 100 = 0 AS is_system_admin,
  TIMESTAMP '1995-01-01' + to_days((c_custkey % 2418)::INTEGER) AS created_at,
  CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2001-06-01' + to_hours(c_custkey % 1700) END AS last_login
FROM customer""")


def users(spark: SparkSession, sf: str) -> DataFrame:
    k, active = F.col("c_custkey"), F.col("c_acctbal") >= 0
    house = F.col("c_mktsegment") == "HOUSEHOLD"
    return table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_nationkey").cast("long").alias("organization_id"),
        F.when(~house, F.col("c_name")).alias("full_name"),
        F.when(house & (F.col("c_acctbal") < 5000), "").otherwise(F.concat(F.lit("user_"), k.cast("string"))).alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        active.alias("is_active"), (k % 10 == 0).alias("is_admin"), (k % 100 == 0).alias("is_system_admin"),
        (ntz("1995-01-01 00:00:00") + F.make_dt_interval((k % 2418).cast("int"))).alias("created_at"),
        F.when(active, ntz("2001-06-01 00:00:00") + F.make_dt_interval(F.lit(0), (k % 1700).cast("int"))).alias("last_login"),
    )


view("experiments", """
SELECT o_orderkey AS id, o_custkey AS user_id, c_nationkey::BIGINT AS organization_id, 'Experiment ' || o_orderkey AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
  o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 7200) END AS completed_at,
  '{"analysis_type": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'time_series' ELSE 'plate' END || '", "files_processed": ' || (o_orderkey % 9) || ', "summary": {"total_samples": ' || (o_orderkey % 96) || '}}' AS metadata
FROM orders JOIN customer ON c_custkey = o_custkey""")


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments carry their organisation, looked up from the owner."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    meta = F.concat(
        F.lit('{"analysis_type": "'), F.when(k % 3 == 0, "time_series").otherwise("plate"), F.lit('", "files_processed": '), (k % 9).cast("string"),
        F.lit(', "summary": {"total_samples": '), (k % 96).cast("string"), F.lit("}}"),
    )
    owner = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("organization_id"))
    return table(spark, sf, "orders").join(owner, "o_custkey").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), "organization_id", F.concat(F.lit("Experiment "), k.cast("string")).alias("name"),
        status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k % 7200)).alias("completed_at"),
        meta.alias("metadata"),
    )


view("usage", """
SELECT event_id AS id, c_nationkey::BIGINT AS organization_id, user_id, event_type AS metric_type, value AS metric_value, ts AS "timestamp", props AS metadata
FROM events JOIN customer ON c_custkey = user_id""")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("organization_id"))
    return table(spark, sf, "events").join(owner, "user_id").select(
        F.col("event_id").alias("id"), "organization_id", "user_id", F.col("event_type").alias("metric_type"),
        F.col("value").alias("metric_value"), F.col("ts").alias("timestamp"), F.col("props").alias("metadata"),
    )


view("limits", """
SELECT n_nationkey::BIGINT AS organization_id, 20 + n_nationkey AS experiments_monthly, 1000 AS api_calls_daily, 1024 AS storage_mb FROM nation WHERE n_nationkey % 2 = 0""")


def limits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").filter(k % 2 == 0).select(
        k.cast("long").alias("organization_id"), (k + 20).alias("experiments_monthly"),
        F.lit(1000).alias("api_calls_daily"), F.lit(1024).alias("storage_mb"),
    )


view("sessions", """
SELECT user_id, s AS session_no, min(ts) AS created_at, max(ts) AS last_activity, count(*) AS n_events,
  max(ts) + INTERVAL 24 HOUR AS expires_at, user_id % 4 <> 0 AS is_active
FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s""")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    merged = sessionize(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 1800)
    return merged.select(
        "user_id", "created_at", "last_activity", "n_events",
        (F.col("last_activity") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"), (F.col("user_id") % 4 != 0).alias("is_active"),
    )


view("audit", """
SELECT o_orderkey AS id, o_custkey AS user_id, c_nationkey::BIGINT AS user_org_id, o_orderkey % 25 AS target_org_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'promote_user' WHEN 1 THEN 'deactivate_organization' WHEN 2 THEN 'set_config' WHEN 3 THEN 'view_organization' ELSE 'login' END AS action_type,
  o_orderpriority AS attempt_type, o_orderstatus = 'F' AS success, o_orderdate AS "timestamp"
FROM orders JOIN customer ON c_custkey = o_custkey""")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    action = (
        F.when(k % 5 == 0, "promote_user").when(k % 5 == 1, "deactivate_organization").when(k % 5 == 2, "set_config")
        .when(k % 5 == 3, "view_organization").otherwise("login")
    )
    owner = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("user_org_id"))
    return table(spark, sf, "orders").join(owner, "o_custkey").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), "user_org_id", (k % 25).alias("target_org_id"), action.alias("action_type"),
        F.col("o_orderpriority").alias("attempt_type"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderdate").alias("timestamp"),
    )
