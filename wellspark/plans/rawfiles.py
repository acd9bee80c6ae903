"""Real files, written from the given tables and read back: records over lines, splits, plates, inference, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W, functions as F

from wellspark.operators import logs as lg, plates as pl, profile as pf, records as rec
from wellspark.plans.plates import cut_wells
from wellspark.plans.registry import query, view
from wellspark.plans.views import map_wells, raw_lines, table
from wellspark.session import settle, work_folder
from wellspark.sources import files as fs
from wellspark.sources.lines import read_lines

# --- records over several lines -----------------------------------------------------------------------------------

view("notes", """
SELECT doc_id, doc_id // 50 AS n, CASE (doc_id // 50) % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS d,
  CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), ' ', ' "') ELSE coalesce(text, '') END AS note, coalesce(lang, 'none') || ' 3"' AS size FROM documents""")
view("note_cells", """
SELECT 'notes_' || n || '.csv' AS file, unnest([0, 1, 2])::BIGINT AS col, trim(unnest([doc_id::VARCHAR, note, size])) AS cell,
  coalesce(sum(length(note) - length(replace(note, chr(10), '')) + 1) OVER (PARTITION BY n ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row FROM notes""")


def notes(spark, sf):
    """A CSV record per document, fifty to a file; texts keep their line breaks, a third of them is full of quotes."""
    k = F.col("doc_id")
    n = F.floor(k / 50)
    d = F.element_at(F.array(*[F.lit(x) for x in ",;\t|"]), (n % 4 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    note = F.when(k % 3 == 0, F.replace(text, F.lit(" "), F.lit(' "'))).otherwise(text)
    record = F.concat(k.cast("string"), d, F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'), d, F.coalesce("lang", F.lit("none")), F.lit(' 3"'))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("notes_"), n.cast("string"), F.lit(".csv")).alias("file"), d.alias("delimiter"), record.alias("record"))


def _note_lines(spark, sf):
    each = notes(spark, sf).withColumn("lines", F.split("record", "\n", -1))
    before = W.partitionBy("file").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)  # fifty records of a file
    placed = each.withColumn("first", F.coalesce(F.sum(F.size("lines")).over(before), F.lit(0)))
    return placed.select("file", "first", F.posexplode("lines").alias("i", "line")).select("file", (F.col("first") + F.col("i")).alias("line_no"), "line")


@query("txt_10c_cells_over_lines", "SELECT file, row, col, cell FROM note_cells")
def txt_10c(spark, sf):
    """Quoted cells with line breaks, delimiters and doubled quotes, with chunks of 256 lines, so that states are carried often."""
    known = notes(spark, sf).select("file", "delimiter").distinct()
    return rec.record_cells(rec.to_records(_note_lines(spark, sf), known, chunk_rows=256), known)


def _named(path):
    return F.regexp_extract(path, "/name=([^/]*)/", 1)


@query("src_08b_grid_of_real_files", "SELECT file, row, col, cell FROM note_cells")
def src_08b(spark, sf):
    """The same records written as files and read back line by line."""
    base = work_folder(spark, "note-files")
    out = notes(spark, sf)
    out.select(F.col("file").alias("name"), "doc_id", F.col("record").alias("value")).repartition("name").sortWithinPartitions("name", "doc_id").drop("doc_id").write.partitionBy("name").text(base)
    lines = settle(read_lines(spark, base).select(_named(F.col("file")).alias("file"), "line_no", "line"), "note-lines")
    known = out.select("file", "delimiter").distinct()
    return rec.record_cells(rec.to_records(lines, known), known)


@query("src_06c_lines_of_split_files", """
SELECT 'texts_' || doc_id // 1000 AS file, (first + unnest(range(len(l))))::BIGINT AS line_no, unnest(l) AS line
FROM (SELECT doc_id, l, sum(len(l)) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) - len(l) AS first FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))""")
def src_06c(spark, sf):
    """Texts written one after the other into large files, and every line of them with its number."""
    base = work_folder(spark, "text-files")
    name = F.concat(F.lit("texts_"), F.floor(F.col("doc_id") / 1000).cast("string"))
    out = table(spark, sf, "documents").select(name.alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    out.repartition("name").sortWithinPartitions("name", "doc_id").drop("doc_id").write.partitionBy("name").text(base)
    return read_lines(spark, base).select(_named(F.col("file")).alias("file"), "line_no", "line")


@query("join_01c_from_plate_files", """
SELECT plate_id, well_id, "raw data", value_num, "raw mapping" FROM cut_wells FULL JOIN map_wells USING (plate_id, well_id)""")
def join_01c(spark, sf):
    """Plate files on disk, found by their ending, decoded, cut to wells and joined with the sample map."""
    base = work_folder(spark, "plate-files")
    by_no = F.map_from_entries(F.collect_list(F.struct("line_no", "line")))
    grouped = raw_lines(spark, sf).groupBy(F.col("file").alias("name")).agg(by_no.alias("by_no"), F.max("line_no").alias("last"))
    # A line number without a line is a blank line of the file.
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda i: F.coalesce(F.try_element_at("by_no", i), F.lit(""))), "\n")
    whole = grouped.select("name", text.alias("value"))
    whole.repartition("name").write.partitionBy("name").option("lineSep", "\r\n").text(base)
    read = fs.read_texts(fs.scan_files(spark, base, ["txt"]))
    lines = fs.to_lines(read.select(_named(F.col("file")).alias("file"), F.regexp_replace("text", "\r\n$", "").alias("text")))
    return pl.merge_wells(cut_wells(spark, sf, settle(lines, "plate-lines")), map_wells(spark, sf))


# --- routing ------------------------------------------------------------------------------------------------------

view("routed_events", """
SELECT event_id, event_type || '_' || user_id % 8 || '.csv' AS file, user_id % 8 AS k, ts, printf('%.2f', value) AS v, user_id::VARCHAR AS u,
  row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY event_id) AS i FROM events""")
view("routed_rows", """
SELECT *, i + CASE WHEN k IN (4, 5, 7) THEN 1 ELSE 0 END AS line_no, CASE WHEN k < 4 THEN 'fast' WHEN k = 7 THEN 'quarantine' ELSE 'annotated' END AS method, k <> 6 AND event_id % 11 = 0 AS broken FROM routed_events""")


def routed(spark, sf):
    """Logs of five kinds in one go: standard ones, some with a comment row, some without times, some nobody has described."""
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") % 8).withColumn("file", F.concat_ws("", "event_type", F.lit("_"), (F.col("user_id") % 8).cast("string"), F.lit(".csv")))
    k = F.col("k")
    from wellspark.functions.ordered import int_chunk, number_rows

    numbered = number_rows(e, ["file"], [F.col("event_id")], int_chunk("event_id"), "i").withColumn("row", (F.col("i") + 1 + k.isin(4, 5, 7).cast("int")).cast("int"))
    stamp = F.when(F.col("event_id") % 11 == 0, "late").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    body = [F.format_string("%.2f", "value"), F.col("user_id").cast("string")]
    data = numbered.select("file", "row", F.when(k == 6, F.array(*body)).otherwise(F.array(stamp, *body)).alias("cells"))
    files = e.select("file", "k").distinct()
    text = lambda *xs: F.array(*[F.lit(x) for x in xs])
    first = files.select("file", F.lit(0).alias("row"), F.when(k == 6, text("value", "user")).otherwise(text("timestamp", "value", "user")).alias("cells"))
    remark = files.filter(k.isin(4, 5, 7)).select("file", F.lit(1).alias("row"), text("# calibrated", "", "").alias("cells"))
    rows = settle(data.unionByName(first).unionByName(remark), "log-rows")
    annotation = files.filter(k.isin(4, 5, 6)).select("file", F.lit(0).alias("header_row"), F.when(k == 6, 1).otherwise(2).alias("data_start"))
    times = numbered.filter((k == 6) & (F.col("event_id") % 3 == 0)).select("file", F.col("row").alias("row_index"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
    standard = settle(pf.profile_files(lg.named_by_first_row(rows)).select("file", "is_standard"), "standard")
    return lg.read_routed(rows, standard, annotation, times)


@query("log_14b_routed_rows", """
SELECT file AS source_file, line_no, CASE WHEN k <> 6 OR event_id % 3 = 0 THEN ts END AS "timestamp", CASE WHEN k <> 6 THEN 'original' WHEN event_id % 3 = 0 THEN 'imputed' ELSE 'none' END AS timestamp_source,
  unnest(['value', 'user']) AS "column", unnest([v, u]) AS value FROM routed_rows WHERE k <> 7 AND NOT broken""")
def log_14b(spark, sf):
    return routed(spark, sf)[0]


@query("log_14c_routed_quarantine", """
SELECT file AS source, line_no::VARCHAR AS key, 'data_processing' AS category, 'medium' AS severity, CASE WHEN k = 7 THEN 'no annotation for a file that is not standard' ELSE 'unparseable timestamp: late' END AS message, TRUE AS recoverable
FROM routed_rows WHERE k = 7 OR broken
UNION ALL SELECT DISTINCT file, unnest(['0', '1']), 'data_processing', 'medium', 'no annotation for a file that is not standard', TRUE FROM routed_rows WHERE k = 7""")
def log_14c(spark, sf):
    return routed(spark, sf)[1]


@query("log_13b_routed_summary", """
SELECT method, count(*) AS files, count(*) FILTER (n > 0) AS succeeded, count(*) FILTER (n = 0) AS failed, round(count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*), 4) AS success_rate
FROM (SELECT file, method, count(*) FILTER (k <> 7 AND NOT broken) AS n FROM routed_rows GROUP BY file, method) GROUP BY method""")
def log_13b(spark, sf):
    return lg.run_summary(routed(spark, sf)[2])


# --- typed reading without a schema -------------------------------------------------------------------------------


@query("src_07b_inferred_types", """
SELECT 'orders' AS source, unnest(['o_orderkey', 'amount', 'o_orderdate', 'o_comment']) AS name, unnest(['bigint', 'double', 'date', 'string']) AS type
UNION ALL SELECT 'lineitem', unnest(['o_orderkey', 'amount', 'l_quantity', 'shipped', 'late']), unnest(['bigint', 'double', 'double', 'timestamp_ntz', 'boolean'])""")
def src_07b(spark, sf):
    """The types found in files that hold whole and broken numbers, days, times, yes and no, and text with line breaks."""
    from wellspark.sources.inference import read_inferred

    read = read_inferred(spark, _csv_files(spark, sf))
    each = [df.drop("source_path").select(F.lit("lineitem" if "l_quantity" in df.columns else "orders").alias("source"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in df.drop("source_path").dtypes])).alias("x"))
            .select("source", "x.*").distinct() for df in read]
    return reduce(lambda a, b: a.unionByName(b), each)


def _csv_files(spark, sf):
    base = work_folder(spark, "typed-csv")
    o = table(spark, sf, "orders")
    remark = F.concat(F.col("o_orderpriority"), F.lit(',\n"'), F.col("o_orderstatus"), F.lit('"'))
    o.select("o_orderkey", F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("o_orderdate"), remark.alias("o_comment")).write.option("header", True).option("escape", '"').csv(f"{base}/orders")
    li = table(spark, sf, "lineitem")
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"), "l_quantity", shipped.alias("shipped"), (F.col("l_discount") > 0.05).alias("late")).write.option("header", True).csv(f"{base}/lineitem")
    return [f"{base}/orders", f"{base}/lineitem"]


@query("src_07c_inferred_rows", """
SELECT o_orderkey, o_totalprice AS amount, NULL::DOUBLE AS l_quantity, o_orderdate::DATE AS o_orderdate, o_orderpriority || ',' || chr(10) || '"' || o_orderstatus || '"' AS o_comment, NULL::TIMESTAMP AS shipped, NULL::BOOLEAN AS late, 'orders' AS source FROM orders
UNION ALL SELECT l_orderkey, l_extendedprice, l_quantity, NULL, NULL, l_shipdate::TIMESTAMP, l_discount > 0.05, 'lineitem' FROM lineitem""")
def src_07c(spark, sf):
    """The same files read by the types found, one typed read for each header."""
    from wellspark.sources.inference import read_inferred

    united = fs.union_groups(dict(enumerate(read_inferred(spark, _csv_files(spark, sf)))))
    return united.withColumn("source", F.element_at(F.split("source_path", "/"), -2)).drop("source_path")
