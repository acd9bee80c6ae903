"""Plate reshaping, protocols, categories and the well joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wellspark.operators import categories, plates as pl, protocols as pr, structure as st
from wellspark.plans.registry import query, view
from wellspark.plans.structure import _clean, _found
from wellspark.plans.views import annotation, data_wells, grid, map_wells, raw_lines, scopes, table
from wellspark.session import settle
from wellspark.sources import annotations as an


def plate_cells(spark, sf):
    lines = _clean(spark, sf)
    return st.to_cells(lines, _found(lines))


view("fixed_annotation", """
SELECT a.file, plate_id, start_row, CASE WHEN start_row = 1 AND end_row = 7 AND coalesce(e.has8, FALSE) THEN 8 ELSE end_row END AS end_row, start_col, end_col
FROM annotation a LEFT JOIN (SELECT file, bool_or(cell <> '') AS has8 FROM cells WHERE row = 8 GROUP BY file) e USING (file)""")
view("block_cells", """
SELECT file, plate_id, row - start_row AS r, col - start_col AS c, cell FROM cells JOIN fixed_annotation USING (file)
WHERE row BETWEEN start_row AND end_row AND col BETWEEN start_col AND end_col""")
view("cut_wells", """
SELECT coalesce(plate_id, 'Unknown') AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS well_id, nullif(cell, '') AS "raw data", TRY_CAST(replace(cell, ',', '.') AS DOUBLE) AS value_num FROM block_cells""")


@query("plt_01_cut_blocks", """
SELECT file, plate_id, row - start_row AS r, col - start_col AS c, cell FROM cells JOIN annotation USING (file)
WHERE row BETWEEN start_row AND end_row AND col BETWEEN start_col AND end_col""")
def plt_01(spark, sf):
    return pl.cut_blocks(plate_cells(spark, sf), annotation(spark, sf))


@query("plt_02_end_row", "SELECT file, plate_id, start_row, end_row, start_col, end_col FROM fixed_annotation")
def plt_02(spark, sf):
    return pl.correct_end_row(plate_cells(spark, sf), annotation(spark, sf))


def cut_wells(spark, sf, lines=None):
    lines = _clean(spark, sf) if lines is None else st.fix_decimal_commas(st.strip_bom(lines))
    facts = settle(st.detect_delimiter(lines).join(annotation(spark, sf), "file"), "plate-facts")
    return pl.grid_to_wells(pl.cut_lines(lines, facts), "raw data")


@query("plt_02b_corrected_blocks", "SELECT file, plate_id, r, c, cell FROM block_cells")
def plt_02b(spark, sf):
    """The two-step form: correct the annotation from the cells, then cut."""
    cells = plate_cells(spark, sf)
    return pl.cut_blocks(cells, pl.correct_end_row(cells, annotation(spark, sf)))


@query("plt_03_grid_to_wells", 'SELECT plate_id, well_id, "raw data", value_num FROM cut_wells')
def plt_03(spark, sf):
    return cut_wells(spark, sf)


@query("plt_03b_wide_grid", """
SELECT plate, chr((65 + r)::INTEGER) || (c + 1) AS well_id, printf('%.2f', v) AS "raw data" FROM grid
UNION ALL SELECT plate, chr((65 + r)::INTEGER) || (c + 1), NULL FROM (SELECT DISTINCT plate, r FROM grid) CROSS JOIN (SELECT unnest(range(12)) AS c)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = plate * 96 + r * 12 + c)""")
def plt_03b(spark, sf):
    wide = grid(spark, sf).groupBy("plate", F.col("r").cast("int").alias("r")).agg(
        *[F.max(F.when(F.col("c") == i, F.format_string("%.2f", "v"))).alias(f"c{i}") for i in range(12)]
    )
    return pl.wide_grid_to_wells(wide, ["plate"], "r", [f"c{i}" for i in range(12)], "raw data")


view("well_lines", """
SELECT 'wells_' || plate || '.csv' AS file, plate * 96 + r * 12 + c AS k, 1 + r * 12 + c AS line_no, r, c, v, label FROM grid""")


def well_file_lines(spark, sf):
    """One file per plate in ``Well,Treatment,Signal`` form; one in five has a foreign id."""
    g = grid(spark, sf)
    file = F.concat(F.lit("wells_"), F.col("plate").cast("string"), F.lit(".csv")).alias("file")
    odd = (F.col("plate") % 5 == 0) & (F.col("r") == 0) & (F.col("c") == 0)
    well = F.when(odd, "total").otherwise(pl.well_id(F.col("r").cast("int"), F.col("c")))
    body = g.select(file, (1 + F.col("r") * 12 + F.col("c")).alias("line_no"), F.concat_ws(",", well, "label", F.format_string("%.2f", "v")).alias("line"))
    head = g.filter((F.col("r") == 0) & (F.col("c") == 0)).select(file, F.lit(0).cast("long").alias("line_no"), F.lit("Well,Treatment,Signal").alias("line"))
    return body.unionByName(head)


def well_file_cells(spark, sf):
    lines = well_file_lines(spark, sf)
    return st.to_cells(lines, lines.filter(F.col("line_no") == 0).select("file", F.lit(",").alias("delimiter")))


@query("plt_04_well_files", """
SELECT plate_id, well_id, field, value FROM (
  SELECT 'wells_' || plate AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS well_id, 'raw Treatment' AS field, label AS value, plate FROM grid
  UNION ALL SELECT 'wells_' || plate, chr((65 + r)::INTEGER) || (c + 1), 'raw Signal', printf('%.2f', v), plate FROM grid) WHERE plate % 5 <> 0""")
def plt_04(spark, sf):
    return pl.well_file_rows(well_file_cells(spark, sf)).drop("name")


@query("plt_04b_well_file_map", """
SELECT 'wells_' || plate AS plate_id, chr((65 + r)::INTEGER) || (c + 1) AS well_id, label AS "raw mapping" FROM grid WHERE plate % 5 <> 0""")
def plt_04b(spark, sf):
    return pl.well_file_mapping(well_file_cells(spark, sf))


view("stacked", """
SELECT 'stack_' || (plate // 8) AS file, (plate % 8) * 11 + r + 1 AS line_no, plate, r, string_agg(printf('%.2f', v), ',' ORDER BY c) AS line FROM grid GROUP BY plate, r""")


def stacked_lines(spark, sf):
    """Eight plates per file, each under its own label, blank lines between."""
    g = grid(spark, sf)
    rows = g.groupBy("plate", "r").agg(*[F.max(F.when(F.col("c") == i, F.format_string("%.2f", "v"))).alias(f"c{i}") for i in range(12)])
    file = F.concat(F.lit("stack_"), F.floor(F.col("plate") / 8).cast("string")).alias("file")
    base = (F.col("plate") % 8) * 11
    body = rows.select(file, (base + F.col("r") + 1).alias("line_no"), F.concat_ws(",", *[f"c{i}" for i in range(12)]).alias("line"))
    firsts = g.filter((F.col("r") == 0) & (F.col("c") == 0))
    label = F.concat(F.lit("Plate ID "), F.col("plate").cast("string"))
    return body.unionByName(firsts.select(file, base.alias("line_no"), label.alias("line"))).unionByName(
        firsts.select(file, (base + 9).alias("line_no"), F.lit("").alias("line"))
    )


@query("plt_05_plate_segments", "SELECT file, line_no, line, 'Plate ID ' || plate AS label, r FROM stacked")
def plt_05(spark, sf):
    return pl.plate_segments(stacked_lines(spark, sf)).filter(st.not_blank())


view("answers", """
SELECT p_partkey AS id, p_partkey % 3 AS kind, p_brand, p_type, p_size FROM part""")


def answers(spark, sf):
    """Model answers in three JSON shapes, wrapped in four kinds of surrounding text."""
    k = F.col("p_partkey")
    first = F.concat(F.lit('{"brand": "'), F.col("p_brand"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    wells = F.concat(F.lit('{"A1": '), first, F.lit(', "B12": "'), F.col("p_type"), F.lit('"}'))
    body = (
        F.when(k % 3 == 0, F.concat(F.lit('{"plate_'), k.cast("string"), F.lit('": '), wells, F.lit("}")))
        .when(k % 3 == 1, wells)
        .otherwise(F.concat(F.lit('{"metadata": {"plate_id": {"value": "'), k.cast("string"), F.lit('"}}, "wells": '), wells, F.lit("}")))
    )
    text = (
        F.when(k % 4 == 0, body)
        .when(k % 4 == 1, F.concat(F.lit("Here it is:\n<json_output>\n"), body, F.lit("\n</json_output> done")))
        .when(k % 4 == 2, F.concat(F.lit("Result\n```json\n"), body, F.lit("\n```\nend")))
        .otherwise(F.concat(F.lit("I think "), body, F.lit(" is right")))
    )
    return table(spark, sf, "part").select(k.cast("string").alias("file"), text.alias("answer"), body.alias("expected"))


view("answer_json", """
SELECT p_partkey::VARCHAR AS file, CASE p_partkey % 3 WHEN 0 THEN '{"plate_' || p_partkey || '": ' || w || '}' WHEN 1 THEN w
  ELSE '{"metadata": {"plate_id": {"value": "' || p_partkey || '"}}, "wells": ' || w || '}' END AS json
FROM (SELECT *, '{"A1": {"brand": "' || p_brand || '", "size": ' || p_size || '}, "B12": "' || p_type || '"}' AS w FROM part)""")


@query("src_10_find_json", "SELECT file, json FROM answer_json")
def src_10(spark, sf):
    return answers(spark, sf).select("file", an.find_json(F.col("answer")).alias("json"))


@query("src_09_embedded_csv", """
SELECT p_partkey::VARCHAR AS file, line_no, CASE line_no WHEN 0 THEN 'Well,Value' WHEN 1 THEN 'A1,' || p_size ELSE 'A2,' || p_brand END AS line
FROM part CROSS JOIN (SELECT unnest(range(3)) AS line_no)""")
def src_09(spark, sf):
    text = F.concat(F.lit("Thinking.\n<csv_output>\nWell,Value\nA1,"), F.col("p_size").cast("string"), F.lit("\nA2,"), F.col("p_brand"), F.lit("\n</csv_output>"))
    return an.embedded_csv_lines(table(spark, sf, "part").select("p_partkey", text.alias("answer")), "p_partkey", "answer")


view("json_wells", """
SELECT p_partkey::VARCHAR AS file, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::BIGINT AS format,
  CASE WHEN p_partkey % 3 = 1 THEN 'Unknown' ELSE p_partkey::VARCHAR END AS plate_id, well_id, field,
  CASE field WHEN 'protocol_brand' THEN p_brand WHEN 'protocol_size' THEN p_size::VARCHAR ELSE p_type END AS value
FROM part CROSS JOIN (VALUES ('A1', 'protocol_brand'), ('A1', 'protocol_size'), ('B12', 'protocol_conditions')) AS x(well_id, field)""")


def json_wells(spark, sf):
    return pr.wells_from_json(answers(spark, sf).select("file", an.find_json(F.col("answer")).alias("json")))


@query("plt_06_protocol_json", "SELECT file, format, plate_id, well_id, field, value FROM json_wells")
def plt_06(spark, sf):
    return json_wells(spark, sf)


@query("plt_06b_protocol_wide", """
SELECT file, plate_id, well_id, max(CASE WHEN field = 'protocol_brand' THEN value END) AS protocol_brand,
  max(CASE WHEN field = 'protocol_size' THEN value END) AS protocol_size, max(CASE WHEN field = 'protocol_conditions' THEN value END) AS protocol_conditions
FROM json_wells GROUP BY file, plate_id, well_id""")
def plt_06b(spark, sf):
    return pr.widen(json_wells(spark, sf), ["protocol_brand", "protocol_size", "protocol_conditions"])


def protocol_wells(spark, sf):
    return pr.widen(pr.expand_scopes(scopes(spark, sf)), ["protocol_brand", "protocol_kind"])


@query("plt_07_scopes", "SELECT plate_id, well_id, protocol_brand, protocol_kind FROM protocol_wells")
def plt_07(spark, sf):
    return protocol_wells(spark, sf)


@query("plt_08_plate_id_padded", """
SELECT o_orderkey, CASE WHEN regexp_matches(id, '^[A-Za-z][0-9]$') THEN id[1] || '0' || id[2] ELSE id END AS plate_id
FROM (SELECT o_orderkey, chr((65 + o_orderkey % 26)::INTEGER) || (o_orderkey % 30) AS id FROM orders)""")
def plt_08(spark, sf):
    k = F.col("o_orderkey")
    raw = F.concat(F.char(F.lit(65) + (k % 26).cast("int")), (k % 30).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", pl.pad_plate_id(raw).alias("plate_id"))


@query("plt_09_plate_id_core", """
SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, 'Plate\\s*ID\\s*([A-Za-z0-9_]+)', 'i') THEN regexp_extract(raw, 'Plate\\s*ID\\s*([A-Za-z0-9_]+)', 1, 'i')
  WHEN regexp_matches(raw, 'Plate\\s*([A-Za-z0-9_]+)', 'i') THEN regexp_extract(raw, 'Plate\\s*([A-Za-z0-9_]+)', 1, 'i') ELSE raw END AS plate_id
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Plate ID ' || o_orderkey WHEN 1 THEN 'plate ' || o_orderkey WHEN 2 THEN 'Sample Plate S' || o_orderkey
  WHEN 3 THEN 'Plate ID-' || o_orderkey ELSE o_orderkey::VARCHAR END AS raw FROM orders)""")
def plt_09(spark, sf):
    k, t = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("Plate ID "), t)).when(k % 5 == 1, F.concat(F.lit("plate "), t))
        .when(k % 5 == 2, F.concat(F.lit("Sample Plate S"), t)).when(k % 5 == 3, F.concat(F.lit("Plate ID-"), t)).otherwise(t)
    )
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), pl.core_plate_id(raw).alias("plate_id"))


@query("plt_10_check_plates", """
SELECT plate_id, n_rows, n_wells, n_bad, n_missing, round(n_missing * 100.0::DOUBLE / n_rows, 4) AS missing_pct, n_wells = 96 AS complete,
  n_missing * 100.0 / n_rows > 50 AS mostly_missing, n_bad = 0 AS is_valid
FROM (SELECT plate_id, count(*) AS n_rows, count(DISTINCT well_id) AS n_wells, count(DISTINCT CASE WHEN NOT regexp_matches(well_id, '^[A-H]([1-9]|1[0-2])$') THEN well_id END) AS n_bad,
  count(*) FILTER ("raw data" IS NULL) AS n_missing FROM cut_wells GROUP BY plate_id)""")
def plt_10(spark, sf):
    return pl.check_plates(cut_wells(spark, sf), "raw data")


@query("plt_10b_bad_wells", """
SELECT plate_id, well_id, count(*) AS n_rows
FROM (SELECT 'P' || (l_orderkey // 50) AS plate_id, chr((65 + l_linenumber)::INTEGER) || (1 + l_orderkey % 15) AS well_id FROM lineitem)
WHERE NOT regexp_matches(well_id, '^[A-H]([1-9]|1[0-2])$') GROUP BY plate_id, well_id""")
def plt_10b(spark, sf):
    li = table(spark, sf, "lineitem")
    wells = li.select(
        F.concat(F.lit("P"), F.floor(F.col("l_orderkey") / 50).cast("string")).alias("plate_id"),
        F.concat(F.char(F.lit(65) + F.col("l_linenumber")), (1 + F.col("l_orderkey") % 15).cast("string")).alias("well_id"),
    )
    return pl.bad_wells(wells)


@query("plt_11_check_protocol", """
SELECT plate_id, count(DISTINCT well_id) AS n_wells, count(*) AS n_values, count(DISTINCT CASE WHEN NOT regexp_matches(well_id, '^[A-H][0-9]{1,2}$') THEN well_id END) AS n_bad,
  count(DISTINCT field) AS n_fields, bool_and(regexp_matches(well_id, '^[A-H][0-9]{1,2}$')) AS is_valid FROM json_wells GROUP BY plate_id""")
def plt_11(spark, sf):
    return pr.check_protocol(json_wells(spark, sf))


view("merged", """
SELECT plate_id, well_id, "raw data", "raw mapping", protocol_brand, protocol_kind
FROM data_wells FULL JOIN map_wells USING (plate_id, well_id) FULL JOIN protocol_wells USING (plate_id, well_id)""")


def merged(spark, sf):
    return pl.combine(data_wells(spark, sf), map_wells(spark, sf), protocol_wells(spark, sf))


_CHECKED = ["raw data", "raw mapping", "protocol_brand", "protocol_kind"]


@query("plt_10c_check_all_columns", " UNION ALL ".join(f"""
SELECT plate_id, '{c}' AS "column", n_rows, n_wells, n_bad, n_missing, round(n_missing * 100.0::DOUBLE / n_rows, 4) AS missing_pct, concat_ws('; ', CASE WHEN n_bad > 0 THEN 'Invalid well ID format' END,
  CASE WHEN n_wells <> 96 THEN 'Expected 96 wells, found ' || n_wells END, CASE WHEN n_missing * 100.0 / n_rows > 50 THEN 'Column ''{c}'' has ' || printf('%.1f', round(n_missing * 100.0::DOUBLE / n_rows, 4)) || '% missing data' END) AS warnings, TRUE AS is_valid
FROM (SELECT plate_id, count(*) AS n_rows, count(DISTINCT well_id) AS n_wells, count(DISTINCT CASE WHEN NOT regexp_matches(well_id, '^[A-H]([1-9]|1[0-2])$') THEN well_id END) AS n_bad, count(*) FILTER ("{c}" IS NULL) AS n_missing FROM merged GROUP BY plate_id)""" for c in _CHECKED))
def plt_10c(spark, sf):
    """Every value column of the merged wells, in one pass."""
    return pl.check_plate_columns(merged(spark, sf).select("plate_id", "well_id", *_CHECKED))


@query("plt_12_run_summary", """
SELECT count(*) AS total_samples, count(DISTINCT plate_id) AS unique_plates, 1::BIGINT AS data_columns, 1::BIGINT AS map_columns, 2::BIGINT AS protocol_columns, TRUE AS has_protocol FROM merged""")
def plt_12(spark, sf):
    return pl.run_summary(merged(spark, sf))


@query("plt_13_table_kind", """
SELECT file, CASE file::BIGINT % 4 WHEN 0 THEN 'data' WHEN 1 THEN 'map' WHEN 2 THEN 'protocol' ELSE 'unknown' END AS kind FROM answer_json""")
def plt_13(spark, sf):
    k = F.col("p_partkey")
    key = F.when(k % 4 == 0, "raw_data_indices").when(k % 4 == 1, "raw_mapping_indices").when(k % 4 == 2, "experimental_conditions").otherwise("other")
    json = F.concat(F.lit('{"'), key, F.lit('": {"start_row": '), F.col("p_size").cast("string"), F.lit("}}"))
    return table(spark, sf, "part").select(k.cast("string").alias("file"), an.table_kind(json).alias("kind"))


_PARTS = {"protocol": "protocol_wells", "data": "data_wells", "map": "map_wells"}
_COLUMNS = {'"raw data"': "data", '"raw mapping"': "map", "protocol_brand": "protocol", "protocol_kind": "protocol"}


def _inputs_sql(names: tuple[str, ...]) -> str:
    shown = ", ".join(c if p in names else f"NULL AS {c}" for c, p in _COLUMNS.items())
    joined = _PARTS[names[0]] + "".join(f" FULL JOIN {_PARTS[n]} USING (plate_id, well_id)" for n in names[1:])
    return f"SELECT '{'+'.join(names)}' AS inputs, plate_id, well_id, {shown} FROM {joined}"


INPUTS = [("data",), ("map",), ("protocol",), ("data", "map"), ("protocol", "data"), ("protocol", "map"), ("protocol", "data", "map")]


@query("plt_14_available_inputs", " UNION ALL ".join(_inputs_sql(n) for n in [INPUTS[-1], *INPUTS[:-1]]))
def plt_14(spark, sf):
    """All seven sets of inputs a run can have."""
    parts = {"data": data_wells(spark, sf), "mapping": map_wells(spark, sf), "protocol": protocol_wells(spark, sf)}
    runs = [pl.combine(**{("mapping" if n == "map" else n): parts["mapping" if n == "map" else n] for n in names}).withColumn("inputs", F.lit("+".join(names))) for names in INPUTS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


view("named_files", """
SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '_log' ELSE '_notes' END || CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.txt' ELSE '.png' END AS name, text FROM documents""")


def named_files(spark, sf):
    k = F.col("doc_id")
    name = F.concat(F.col("source"), F.when(k % 4 == 0, "_log").otherwise("_notes"), F.when(k % 3 == 0, ".csv").when(k % 3 == 1, ".txt").otherwise(".png"))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), "text")


@query("plt_15_default_category", """
SELECT doc_id, name, CASE WHEN name LIKE '%.csv' THEN CASE WHEN regexp_matches(lower(name), 'log|sensor|monitor|equipment|instrument|event|activity')
   OR regexp_matches(lower(text), 'timestamp|datetime|time|temperature|pressure|status|event') THEN 'log' ELSE 'data' END
  WHEN name LIKE '%.txt' THEN CASE WHEN regexp_matches(lower(name), 'log|sensor|monitor|equipment|instrument|event|activity') THEN 'log' ELSE 'protocol' END ELSE 'other' END AS category FROM named_files""")
def plt_15(spark, sf):
    return named_files(spark, sf).select("doc_id", "name", categories.default_category(F.col("name"), F.col("text")).alias("category"))


@query("plt_16_answered_category", """
SELECT doc_id, name, CASE doc_id % 6 WHEN 0 THEN 'map' WHEN 1 THEN 'log' WHEN 2 THEN 'protocol' WHEN 3 THEN 'data'
  ELSE CASE WHEN name LIKE '%.csv' THEN 'data' WHEN name LIKE '%.txt' THEN 'protocol' ELSE 'other' END END AS category FROM named_files""")
def plt_16(spark, sf):
    k, n = F.col("doc_id"), F.col("name")
    answer = (
        F.when(k % 6 == 0, F.concat(F.lit('{"'), n, F.lit('" : "Map"}'))).when(k % 6 == 1, F.concat(F.lit("'"), n, F.lit("': 'log'")))
        .when(k % 6 == 2, F.concat(n, F.lit(": protocol"))).when(k % 6 == 3, F.concat(n, F.lit(" -> data"))).when(k % 6 == 4, F.concat(n, F.lit(": banana")))
    )
    files = named_files(spark, sf)
    stated = files.select("doc_id", answer.alias("answer"))
    return categories.answered_category(files.select("doc_id", "name"), stated, "doc_id")


@query("plt_17_by_category", """
SELECT category, count(*) AS n_files, count(DISTINCT name) AS n_names, sum(length(text))::BIGINT AS n_chars
FROM (SELECT *, CASE WHEN name LIKE '%.csv' THEN CASE WHEN regexp_matches(lower(name), 'log|sensor|monitor|equipment|instrument|event|activity')
   OR regexp_matches(lower(text), 'timestamp|datetime|time|temperature|pressure|status|event') THEN 'log' ELSE 'data' END
  WHEN name LIKE '%.txt' THEN CASE WHEN regexp_matches(lower(name), 'log|sensor|monitor|equipment|instrument|event|activity') THEN 'log' ELSE 'protocol' END ELSE 'other' END AS category FROM named_files)
GROUP BY category""")
def plt_17(spark, sf):
    files = named_files(spark, sf).withColumn("category", categories.default_category(F.col("name"), F.col("text")))
    return files.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("name").alias("n_names"), F.sum(F.length("text")).alias("n_chars")
    )


@query("join_01_merge_wells", "SELECT * FROM merged")
def join_01(spark, sf):
    return merged(spark, sf)


@query("join_01b_from_raw_files", """
SELECT plate_id, well_id, "raw data", value_num, "raw mapping" FROM cut_wells FULL JOIN map_wells USING (plate_id, well_id)""")
def join_01b(spark, sf):
    """Raw plate files to wells, joined with the sample map: the whole path in one plan."""
    return pl.merge_wells(cut_wells(spark, sf), map_wells(spark, sf))


@query("join_09_range_scope", """
SELECT plate_id, well_id, field, value FROM (
SELECT plate_id, 'protocol_' || field AS field, value, chr((64 + r)::INTEGER) || c AS well_id
      FROM scopes JOIN (SELECT unnest(range(1, 9)) AS r) ON r BETWEEN row_from AND row_to
      JOIN (SELECT unnest(range(1, 13)) AS c) ON c BETWEEN col_from AND col_to)""")
def join_09(spark, sf):
    return pr.expand_scopes(scopes(spark, sf))


@query("join_09b_many_rectangles", """
SELECT p_partkey, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col, o_totalprice AS price FROM orders)
JOIN (SELECT p_partkey, p_partkey % 60 AS r0, p_partkey % 60 + p_size % 20 AS r1, p_partkey * 7 % 90 AS c0, p_partkey * 7 % 90 + p_size % 9 AS c1 FROM part) ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY p_partkey""")
def join_09b(spark, sf):
    """One file, a rectangle for each part: they overlap everywhere, and meet the cells of their bins only."""
    o, k = F.col("o_orderkey"), F.col("p_partkey")
    cells = table(spark, sf, "orders").select(F.lit("f").alias("file"), F.floor(o / 100).alias("row"), (o % 100).alias("col"), F.col("o_totalprice").alias("cell"))
    rects = table(spark, sf, "part").select(F.lit("f").alias("file"), "p_partkey", (k % 60).alias("start_row"), (k % 60 + F.col("p_size") % 20).alias("end_row"), (k * 7 % 90).alias("start_col"), (k * 7 % 90 + F.col("p_size") % 9).alias("end_col"))
    return pl.cut_blocks(cells, rects).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cell"), 2).alias("total"))


@query("sort_06_well_order", """
SELECT plate_id, well_id, "raw mapping", row_number() OVER (PARTITION BY plate_id ORDER BY well_id[1], well_id[2:]::INTEGER) AS position FROM map_wells""")
def sort_06(spark, sf):
    from pyspark.sql import Window as W

    # Wells per plate are bounded by the plate format.
    order = W.partitionBy("plate_id").orderBy(F.substring("well_id", 1, 1), F.substring("well_id", 2, 3).cast("int"))
    return pl.sort_wells(map_wells(spark, sf).withColumn("position", F.row_number().over(order)))


@query("set_03_distinct_wells", "SELECT DISTINCT plate_id, well_id FROM merged")
def set_03(spark, sf):
    return merged(spark, sf).select("plate_id", "well_id").distinct()


@query("set_04_column_sets", """
SELECT coalesce(l.field, r.field) AS field, CASE WHEN r.field IS NULL THEN 'left only' WHEN l.field IS NULL THEN 'right only' ELSE 'both' END AS found_in
FROM (SELECT DISTINCT field FROM json_wells) l FULL JOIN (SELECT 'protocol_brand' AS field FROM protocol_wells WHERE protocol_brand IS NOT NULL
  UNION SELECT 'protocol_kind' FROM protocol_wells WHERE protocol_kind IS NOT NULL) r ON l.field = r.field""")
def set_04(spark, sf):
    """Fields of the two kinds of protocol: in both, or in one alone."""
    return pl.column_sets(json_wells(spark, sf), pr.expand_scopes(scopes(spark, sf)))


@query("prj_02_text_columns", 'SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM orders')
def prj_02(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
