"""Arriving log files: nothing is lost, nothing counts twice."""

from pyspark.sql import functions as F

from wellspark.streaming import logfiles as lf


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_lines_in_are_rows_and_quarantine_over_restarts(spark, tmp_path):
    head = ["# device", "time;v"]
    put(tmp_path / "in/a", "x.txt", head + [f"2024-01-01 00:00:{i:02d};{i}" for i in range(20)])
    put(tmp_path / "in/b", "y.txt", head + ["2024-01-01 00:00:01;1", "never;2", "", "2024-01-01 00:00:03;3"])
    run = lambda: lf.run_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    first = run()
    assert (first["rows"].count(), first["quarantine"].count()) == (22, 1)
    put(tmp_path / "in/again/a", "x.txt", head + [f"2024-01-01 00:00:{i:02d};{i}" for i in range(20)])  # the same file once more
    put(tmp_path / "in/c", "z.txt", head + ["late;1", "2024-01-02 00:00:00;2"])
    put(tmp_path / "in/c", "same_head_only.txt", head)
    second = run()
    assert (second["rows"].count(), second["quarantine"].count()) == (23, 2)
    ledger = {r.name: (r.n_lines, r.n_rows, r.n_quarantined) for r in second["ledger"].collect()}
    assert ledger == {"a/x.txt": (20, 20, 0), "b/y.txt": (3, 2, 1), "c/z.txt": (2, 1, 1), "c/same_head_only.txt": (0, 0, 0)}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    sink = lf.append_batches(str(tmp_path))
    texts = spark.createDataFrame([("d/one.txt", "time,v\n2024-01-01 00:00:00,1\nbad,2"), ("e/d/one.txt", "time,v\n2024-01-01 00:00:00,1\nbad,2")], "file string, text string")
    for batch in (0, 0, 1):
        sink(texts, batch)
    read = lambda part: spark.read.parquet(f"{tmp_path}/{part}")
    assert (read("rows").count(), read("quarantine").count(), read("ledger").agg(F.sum("n_lines")).first()[0]) == (1, 1, 2)
