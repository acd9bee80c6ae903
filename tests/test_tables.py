"""Joins, table changes, streams and hooks on small inputs."""

import pytest
from pyspark.sql import functions as F

from wellspark.functions import hooks
from wellspark.operators import errors as er, listings as ls, logs as lg, plates as pl, protocols as pr, quality as dq, sinks
from wellspark.session import work_folder
from wellspark.sources import annotations as an
from wellspark.streaming import events as ev, locks as lk


def test_outer_join_keeps_all_keys_and_left_columns_win(spark):
    a = spark.createDataFrame([("1", "A1", "x"), (None, "B2", "y")], "plate_id string, well_id string, note string")
    b = spark.createDataFrame([("1", "A1", "other", 5), ("2", "C3", "z", 6)], "plate_id string, well_id string, note string, v int")
    got = {(r.plate_id, r.well_id): (r.note, r.v) for r in pl.merge_wells(a, b).collect()}
    assert got == {("1", "A1"): ("x", 5), ("Unknown", "B2"): ("y", None), ("2", "C3"): (None, 6)}


def test_combine_needs_an_input():
    with pytest.raises(ValueError):
        pl.combine()


def test_well_order_and_formats(spark):
    wells = spark.createDataFrame([("p", w) for w in ["A10", "A2", "B1", "A1"]], "plate_id string, well_id string")
    assert [r.well_id for r in pl.sort_wells(wells).collect()] == ["A1", "A2", "A10", "B1"]
    odd = spark.createDataFrame([("p", "P24", "1"), ("p", "Q1", "2")], "plate_id string, well_id string, v string")
    assert pl.check_plates(odd, "v", 96).first().n_bad == 2 and pl.check_plates(odd, "v", 384).first().n_bad == 1


def test_protocol_shapes(spark):
    twelve = ", ".join(f'"A{i}": {{"dose": {i}}}' for i in range(1, 12))
    docs = [("short", '{"7": {' + twelve + "}}"), ("conditions", '{"experimental_conditions": {"Z9": "odd"}}'), ("broken", "{nothing"), ("other", '{"foo bar": 1}')]
    got = pr.wells_from_json(spark.createDataFrame(docs, "file string, json string"))
    rows = {}
    for r in got.collect():
        rows.setdefault(r.file, []).append((r.format, r.plate_id, r.well_id, r.field, r.value))
    assert len(rows["short"]) == 11 and rows["short"][0][:2] == (1, "7")
    assert rows["conditions"] == [(3, "Unknown", "Z9", "protocol_conditions", "odd")]
    assert "broken" not in rows and "other" not in rows


def test_field_limit_is_an_error(spark):
    long = spark.createDataFrame([("p", "A1", f"protocol_{i}", "v") for i in range(5)], "plate_id string, well_id string, field string, value string")
    with pytest.raises(ValueError):
        pr.field_names(long, limit=4)
    assert len(pr.widen(long).columns) == 7


def test_json_places(spark):
    texts = ['{"a": 1}', "x <json_output>{\"a\": 2}</json_output>", "```json\n{\"a\": 3}\n```", 'so {"a": 4} ok', "none", "{broken"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(an.find_json(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": 4}', None, None]


def test_upsert_retain_update_delete(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 3, 10), ("c", 4, 5), ("c", 5, 6)], "k string, v int, at int")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], "at").collect()) == [("a", 1, 10), ("b", 3, 10), ("c", 5, 6)]
    kept, gone = sinks.retain(old.unionByName(new), "at", F.lit(6))
    assert kept.count() == 4 and gone.count() == 1
    changed = sinks.apply_updates(old, spark.createDataFrame([("a", 9)], "k string, v int"), ["k"])
    assert sorted(tuple(r) for r in changed.collect()) == [("a", 9, 10), ("b", 2, 10)]
    left = sinks.delete_owned(old, spark.createDataFrame([("a", 1), ("b", 7)], "k string, v int"), "k", "v")
    assert [r.k for r in left.collect()] == ["b"]


def test_unique_names(spark):
    files = spark.createDataFrame([("d", "a.csv", i) for i in range(4)] + [("d", ".hidden", 9), ("e", "a.csv", 5), ("d", "x", 6), ("d", "x", 7)], "dir string, name string, i bigint")
    got = sorted((r.dir, r.unique_name) for r in sinks.unique_names(files, "dir", "name", "i").collect())
    assert got == [("d", ".hidden"), ("d", "a.csv"), ("d", "a_1.csv"), ("d", "a_2.csv"), ("d", "a_3.csv"), ("d", "x"), ("d", "x_1"), ("e", "a.csv")]


def test_export_is_partitioned_rows(spark, tmp_path):
    people = spark.createDataFrame([(1, 7, "x"), (2, 8, "y")], "id bigint, organization_id bigint, email string")
    rows = sinks.export_rows({"users": people})
    sinks.write_json(rows, str(tmp_path / "out"), partition_by=["organization_id", "entity"])
    assert (tmp_path / "out" / "organization_id=7" / "entity=users").is_dir()


def test_visible_items(spark):
    items = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 3, 8)], "id bigint, user_id bigint, organization_id bigint")
    viewers = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 8, False)], "id bigint, organization_id bigint, is_admin boolean")
    seen = {v: sorted(r.id for r in ls.visible_items(items, viewers.filter(F.col("id") == v)).collect()) for v in (1, 2, 3)}
    assert seen == {1: [1, 2], 2: [2], 3: [3]}
    counts = {r.user_id: r.visible for r in ls.visible_counts(items, viewers).collect()}
    assert counts == {v: len(s) for v, s in seen.items()}


def test_pass_and_quarantine_cover_the_input(spark):
    df = spark.createDataFrame([(1, "a@b.org"), (2, "nope"), (3, ""), (4, None)], "id int, mail string")
    good, bad = dq.split_valid(dq.check(df, "mail", "email"), "mails", "id")
    assert [r.id for r in good.collect()] == [1]
    assert sorted((r.key, r.message) for r in bad.collect()) == [("2", "Please enter a valid email address"), ("3", "Email is required"), ("4", "Email is required")]


def test_recovery_strict_mode_stops(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "id int, t string")
    good, bad = er.with_recovery(df, "id", F.col("t").try_cast("int"), F.lit("csv is broken"))
    assert good.count() == 1 and bad.first().category == "csv_parsing"
    strict, _ = er.with_recovery(df, "id", F.col("t").try_cast("int"), F.lit("csv is broken"), strict=True)
    with pytest.raises(Exception, match="csv is broken"):
        strict.collect()


def test_type_vote_keeps_lost_text_when_asked(spark):
    rows = [(str(i),) for i in range(8)] + [("bad",), (None,)]
    wide = spark.createDataFrame(rows, "c string")
    typed = lg.apply_types(wide, ["c"], keep_raw=True)
    assert dict(typed.dtypes) == {"c": "double", "c__raw": "string"} and typed.filter("c IS NULL AND c__raw = 'bad'").count() == 1


def test_column_limit_is_an_error(spark):
    facts = spark.createDataFrame([("f_log.csv", ["t", "a", "b"], 0)], "file string, names array<string>, ts_col int")
    assert lg.column_names(facts) == ["f_a", "f_b"] and lg.column_names(facts, prefix=False) == ["a", "b"]
    with pytest.raises(ValueError):
        lg.column_names(facts, limit=1)


def test_first_values(spark):
    rows = [("f", r, 0, str(r)) for r in range(50)] + [("f", r, 1, str(r) if r >= 30 and r % 2 else "n/a") for r in range(50)]
    cells = spark.createDataFrame(rows, "file string, row int, col int, cell string")
    assert {(r.col, r.row) for r in lg.first_values(cells, 3).collect()} == {(0, r) for r in range(3)} | {(1, r) for r in (31, 33, 35)}


def test_time_column_of_rows_agrees_with_the_full_search(spark):
    """Exact name, content deep in the file, and a file without any time."""
    def file(name, header, line):
        return [(name, 0, header)] + [(name, i, line(i)) for i in range(1, 40)]

    rows = file("a", ["v", "timestamp"], lambda i: [str(i), "x"]) + file("b", ["v", "w"], lambda i: [str(i), f"2024-01-01 00:00:{i:02d}" if i > 30 else ""])
    rows += file("c", ["v", "w"], lambda i: [str(i), "text"]) + file("d", ["start_time", "w"], lambda i: [f"2024-01-01 00:00:{i:02d}", "text"])
    df = spark.createDataFrame(rows, "file string, row int, cells array<string>")
    ann = spark.createDataFrame([(f, 0, 1) for f in "abcd"], "file string, header_row int, data_start int")
    heads = lg.header_names(df, ann)
    data = df.filter("row > 0").join(heads, "file")
    got = {r.file: (r.ts_name, r.step) for r in lg.time_column_of_rows(data, heads).collect()}
    assert got == {"a": ("timestamp", 1), "b": ("w", 3), "d": ("start_time", 2)}


def brute_force_lock(rows):
    out, state = {}, {}
    for user, event, at, success in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        failed, until = state.get(user, (0, None))
        if until is not None and at < until:
            out[event] = (True, failed)
            continue
        failed, until = (0, None) if success else (failed + 1, until)
        if not success:
            until = at + 900 if failed >= 5 else None
        state[user] = (failed, until)
        out[event] = (False, failed)
    return out


def attempts(seed=3, n=400):
    import random

    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([5, 30, 100, 400, 899, 900, 901])
        rows.append((rng.choice([1, 1, 1, 2]), i, t, rng.random() < 0.15))
    return rows


def as_logins(spark, rows):
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, s bigint, success boolean")
    return df.select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"), "success")


def test_gated_lock_batch(spark):
    rows = attempts()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {r.event_id: (r.ignored, r.failed_attempts) for r in lk.gated_locks_batch(as_logins(spark, rows)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert got == brute_force_lock(rows)
    assert any(ignored for ignored, _ in got.values())


def test_gated_lock_stream_keeps_state_between_batches(spark, tmp_path):
    rows = attempts(seed=5)
    folder = str(tmp_path / "in")
    import time

    for i in range(4):
        as_logins(spark, rows[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.event_id: (r.ignored, r.failed_attempts) for r in lk.gated_locks(stream).collect()}
    assert got == brute_force_lock(rows)


def test_gated_lock_of_a_hot_user_is_cut_into_units(spark):
    rows = [(1 if i % 2 else 100 + i % 7, i, (i // 40) * 5000 + (i % 40) * (20 if i % 3 else 70), i % 11 == 0) for i in range(3000)]
    got = {r.event_id: (r.ignored, r.failed_attempts) for r in lk.gated_locks_batch(as_logins(spark, rows), unit_seconds=3600).collect()}
    assert got == brute_force_lock(rows)
    units = lk._in_units(as_logins(spark, rows), 3600).groupBy("user_id", "unit").count().collect()
    assert sum(r.user_id == 1 for r in units) > 50 and max(r["count"] for r in units) < 100


def test_all_start_states_of_a_unit(spark):
    import random

    for seed in range(30):
        rng, at, paths, walks = random.Random(seed), 10**9, lk.Paths(), {f: (f, 0) for f in (0, 1, 2, 3, 4, 5, 9)}
        for _ in range(rng.randrange(1, 60)):
            at += rng.choice([1, 60, 300, 899]) * 10**6
            good = rng.random() < 0.1
            paths.add(at, good)
            walks = {f: lk.step(*s, at, good)[:2] for f, s in walks.items()}
        failed, counted, until = paths.ends()
        for f, end in walks.items():
            i = min(f, 5)
            assert end == (failed[i] + (f if counted[i] else 0), until[i])


def test_late_attempts_go_aside_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = attempts(seed=9)
    first, second = rows[:200], rows[200:]
    late = [(1, 9000, 3, False), (2, 9001, 4, True)]
    sink = lk.lock_batches(str(tmp_path), 3600)
    for part, batch in ((first, 0), (second + late, 1), (second + late, 1), ([(5, 9002, rows[-1][2] + 90 * 86400, True)], 2)):
        sink(as_logins(spark, part), batch)
    read = lambda what: spark.read.parquet(f"{tmp_path}/{what}").collect()
    got = {r.event_id: (r.ignored, r.failed_attempts) for r in read("data") if r.event_id != 9002}
    assert got == brute_force_lock(rows) and {r.event_id for r in read("late")} == {9000, 9001}
    want = {u: f for u, f in ((u, [f for e, (_, f) in sorted(got.items()) if rows[e][0] == u][-1]) for u in (1, 2)) if f}
    assert {r.user_id: r.failed for r in spark.read.parquet(f"{tmp_path}/state/batch_id=2").collect() if r.user_id != 5} == want


def test_late_events_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    import time

    for stamp in ("2024-01-05 00:00:00", "2024-01-08 00:00:00", "2024-01-09 00:00:00", "2024-01-05 01:00:00", "2024-01-12 00:00:00"):
        spark.sql(f"SELECT 1L AS user_id, 'click' AS event_type, 1.0D AS value, TIMESTAMP_NTZ '{stamp}' AS ts").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    users = spark.createDataFrame([(1, 7)], "id bigint, organization_id bigint")
    out = ev.run_available(ev.daily_counters(ev.read_events(spark, folder, "*.parquet", files_per_batch=1), users), "late")
    got = {str(r.window_start)[:10]: r.event_count for r in out.collect()}
    assert got == {"2024-01-05": 1, "2024-01-08": 1, "2024-01-09": 1}


def test_item_errors_stay_with_their_item(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    got = df.select(hooks.apply_items(lambda t: str(int(t) * 2), F.col("t")).alias("r")).select("r.*").collect()
    assert got[0].result == "2" and got[1].result is None and got[1].error.startswith("ValueError")


class FakeSession:
    """Just enough of a session for the folder choice."""

    def __init__(self, master, folder):
        self.conf = {"spark.sql.warehouse.dir": "hdfs:///warehouse"} | ({"spark.checkpoint.dir": folder} if folder else {})
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})


def test_work_folder_follows_the_cluster_setting():
    assert work_folder(FakeSession("spark://host", "hdfs:///shared"), "x").startswith("hdfs:///shared/x-")
    assert work_folder(FakeSession("spark://host", None), "x").startswith("hdfs:///warehouse/_work/x-")
