"""Shapes of messy plate files and logs, typed in small, and the cleaning rules against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from wellspark.functions.characters import NUMERIC_FORMS, SCIENTIFIC
from wellspark.functions.values import parse_time, to_num
from wellspark.operators import cleaning as cl, plates as pl, structure as st

NUMBERS = [[round(0.1 * (r * 12 + c), 2) for c in range(12)] for r in range(8)]


def lines_of(spark, **files):
    rows = [(f, i, line) for f, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no bigint, line string")


def plate_text(sep=",", decimal="."):
    body = "\n".join(sep.join(str(v).replace(".", decimal) for v in row) for row in NUMBERS)
    return "Plate ID 1" + sep * 11 + "\n" + body


@pytest.mark.parametrize("sep,decimal", [(",", "."), (";", ","), ("\t", "."), ("|", ".")])
def test_plate_grid_round_trip(spark, sep, decimal):
    lines = st.fix_decimal_commas(lines_of(spark, f=plate_text(sep, decimal)))
    found = st.detect_delimiter(lines, fixed=True)
    assert found.first().delimiter == sep
    cells = st.to_cells(lines, found)
    ann = spark.createDataFrame([("f", "1", 1, 7, 0, 11)], "file string, plate_id string, start_row int, end_row int, start_col int, end_col int")
    wells = pl.grid_to_wells(pl.cut_blocks(cells, pl.correct_end_row(cells, ann)), "raw data")
    assert wells.count() == 96
    back = {(r.r, r.c): float(r.cell.replace(",", ".")) for r in pl.wells_to_grid(wells, "raw data").collect()}
    assert back == {(r, c): NUMBERS[r][c] for r in range(8) for c in range(12)}


def test_detection_does_not_depend_on_other_files(spark):
    files = {"a": plate_text(","), "b": plate_text(";", ","), "c": plate_text("|")}
    together = {r.file: (r.delimiter, r.score) for r in st.detect_delimiter(lines_of(spark, **files)).collect()}
    for name, text in files.items():
        alone = st.detect_delimiter(lines_of(spark, **{name: text})).first()
        assert together[name] == (alone.delimiter, alone.score)


def test_three_plates_in_one_map_file(spark):
    block = "\n".join(",".join(f"s{r}_{c}" for c in range(12)) for r in range(8))
    text = "Combined maps\n\n" + "\n\n".join(f"Plate ID {i}\n{block}" for i in (1, 2, 3))
    seg = pl.plate_segments(lines_of(spark, m=text)).filter(st.not_blank())
    counts = {r.label: (r.n, r.lo, r.hi) for r in seg.groupBy("label").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    assert counts == {f"Plate ID {i}": (8, 0, 7) for i in (1, 2, 3)}


def test_data_start_of_log_shapes(spark):
    event_log = "# controller\n# unit 4\n\n# columns below\nname list\n# end\n\nEVENT_ID:0001 DEADBAND:0.1 SETPOINT:7.2\nEVENT_ID:0002 DEADBAND:0.1 SETPOINT:7.3"
    time_log = "# sensor\n# a\n\n# b\n# header\n2024-01-01T00:00:00 1.0 2.0 3.0 4.0"
    lines = lines_of(spark, e=event_log, t=time_log)
    hints = spark.createDataFrame([("e", 5), ("t", 3)], "file string, hint int")
    assert {r.file: r.data_start for r in st.correct_data_start(lines, hints).collect()} == {"e": 7, "t": 5}


def test_quoted_cells(spark):
    lines = lines_of(spark, q='a,"b, ""c""",d\n"x",,z\n,,')
    comma = spark.createDataFrame([("q", ",")], "file string, delimiter string")
    rows = {}
    for r in st.to_cells(lines, comma).orderBy("row", "col").collect():
        rows.setdefault(r.row, []).append(r.cell)
    assert rows == {0: ["a", 'b, "c"', "d"], 1: ["x", "", "z"], 2: ["", "", ""]}


def test_numbers_and_times(spark):
    texts = ["1", "1,5", "1.5", "1d", "NaN", "", "-2e3", ".5", "5.", "1,234.5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_num("t")).collect()] == [1.0, 1.5, 1.5, None, None, None, -2000.0, 0.5, 5.0, None, None]
    times = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "01/02/2024 03:04:05", "soon", "1234", "2024-13-40"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t string").select(F.date_format(parse_time("t"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", None, None, None]


SAMPLES = ["10⁶cells λ₁ ½ ™ ℃", "µM α-Ω ±5 °C", "plain ascii", "été naïve", "", None, "a\x01\x02b \t  c​ d \r\n  x", "日本語 テスト", "A B"]


def python_clean(t):
    t = t or ""
    t = unicodedata.normalize("NFKC", t)
    t = "".join(" " if unicodedata.category(c).startswith("C") and c not in "\t\n\r" else c for c in t)
    t = "\n".join("\t".join(re.sub(" +", " ", p).strip() for p in line.split("\t")) for line in t.split("\n")).strip()
    t = "".join(SCIENTIFIC.get(c, c) for c in t)
    return "".join(NUMERIC_FORMS.get(c, c) for c in t)


def test_full_cleaning_matches_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, t string")
    table = {r.i: r for r in cl.clean_table(df, "t").collect()}
    struct = {r.i: r.c for r in df.select("i", cl.clean_text(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(SAMPLES):
        want = python_clean(t)
        assert table[i].processed_text == want == struct[i].processed_text
        assert table[i].has_changes == ((t or "") != want) == struct[i].has_changes
        assert table[i].unicode_chars_found == list(dict.fromkeys(c for c in (t or "") if ord(c) > 127))
        assert table[i].original_length == len(t or "") and table[i].ascii_compatible == want.isascii()


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms(spark, form):
    df = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    got = [r[0] for r in df.select(cl.normalize(F.col("t"), form)).collect()]
    assert got == [None if t is None else unicodedata.normalize(form, t) for t in SAMPLES]


def test_lossless_order_keeps_raised_digits(spark):
    df = spark.createDataFrame([("10⁶cells λ₁ ½",)], "t string")
    assert cl.clean_table(df, "t").first().processed_text == "106cells lambda1 1⁄2"
    assert cl.clean_table(df, "t", order="lossless").first().processed_text == "10^6cells lambda_1 1/2"


def test_lossless_text_is_computed_once(spark):
    df = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    plan = cl.clean_table(df, "t", order="lossless").select("processed_text", "ascii_compatible")._jdf.queryExecution().optimizedPlan().toString()
    # Once before the normal form, once after it with the other table.
    assert plan.count("regexp_extract_all") == 2 and "array_distinct" not in plan


def test_controls_at_ends_and_breaks_match_plain_python(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("ab \t\n\r\x01\x85\u2028\u00a0é\u200b") for _ in range(r.randrange(9)))) for i in range(4000)]
    rows += [(5000 + i, "".join(r.choice("ab \t\n\r\x01\x7f") for _ in range(r.randrange(9)))) for i in range(4000)]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", cl.clean_controls(F.col("t"))).collect())
    for i, t in rows:
        t = "".join(" " if unicodedata.category(c).startswith("C") and c not in "\t\n\r" else c for c in t)
        edge, nl = " \r\u00a0\u2028", "[\t\n]"
        t = re.sub(f"[{edge}]*({nl})[{edge}]*", r"\1", re.sub(" +", " ", t))
        assert got[i] == t.strip(edge + "\t\n"), i


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    once = cl.clean_table(df, "t").select(F.col("processed_text").alias("t"))
    twice = cl.clean_table(once, "t")
    assert twice.filter("has_changes").count() == 0


def test_awkward_names(spark):
    names = ["Normal File", "a<b>c:d", "test#1 (µM).csv", "123 start", "", None, "€uro…name", "***", "x" * 300, "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(cl.readable_name(F.col("n"))).collect()]
    assert got[:7] == ["Normal_File", "a_lt_b_gt_c_colon_d", "test_hash_1_lparen_muM_rparen_dot_csv", "file_123_start", "unnamed_file", "unnamed_file", "euro_signuro_dot_dot_dot_name"]
    assert got[7] == "star_star_star" and len(got[8]) == 190 and got[9] == "eunicode_char"


def test_upload_names(spark):
    names = ["../../etc/passwd", "a b.csv", "x.tar.gz.exe", "rés\u0007umé.pdf", "", "n" * 300 + ".csv"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(cl.upload_name(F.col("n"))).collect()]
    assert got == ["passwd", "a_b.csv", "x_tar_gz.exe", "résumé.pdf", "unnamed_file", "n" * 251 + ".csv"]


def test_sanitized_string(spark):
    df = spark.createDataFrame([("<b>Hi</b> a&b JAVASCRIPT:x \x00",), ("x" * 2000,)], "t string")
    got = [r[0] for r in df.select(cl.sanitize_string(F.col("t"))).collect()]
    assert got[0] == "Hi a&amp;b JAVASCRIPT_x" and len(got[1]) == 2000


def test_readable_names_are_of_names_and_unique(spark, tmp_path):
    from wellspark.plans.cleaning import cln_07

    spark.createDataFrame([(i, f"https://a.org/{'x' * 300}/{i}", "") for i in range(3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, "word " * 100 + str(i), "en", "web", 500) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names = [r.name for r in cln_07(spark, str(tmp_path)).collect()]
    assert len(set(names)) == len(names) == 6 and not any("word_word" in n for n in names)
