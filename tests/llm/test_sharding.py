"""Shards against jump hashing in plain Python."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.tables import documents, odd_rows
from wellspark.llm import sharding


def plain_jump(doc_id, shards):
    key = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)
    at, after = -1, 0
    while after < shards:
        at = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_shards(spark):
    rows = odd_rows() + [(77, "same text", "en", "a")] * 50 + [(78, f"other {i}", "en", "a") for i in range(50)]
    out = sharding.assign(documents(spark, rows)).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(i, 16), plain_jump(i, 17)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out), key=str) == want
    slots = defaultdict(list)
    for r in out:
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(documents(spark, [])).count() == 0


def test_jumps_beyond_the_first_are_made(spark, monkeypatch):
    monkeypatch.setattr(sharding, "JUMPS", 2)
    keys = spark.range(500).withColumn("p", sharding.jump(sharding.stable_key(F.col("id")), 1000)).select("id", "p.at", "p.next")
    assert {r.id: r.at for r in keys.collect()} == {i: plain_jump(i, 1000) for i in range(500)}


def test_growth_moves_only_what_it_must(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(docs, f"{tmp_path}/old", 8, parts=2)
    sharding.grow_shards(spark, f"{tmp_path}/old", f"{tmp_path}/new", 8, parts=2)
    old, new = spark.read.parquet(f"{tmp_path}/old"), spark.read.parquet(f"{tmp_path}/new")
    assert old.count() == 4000 and {r.shard for r in old.select("shard").distinct().collect()} == set(range(8))
    moved = {r.doc_id for r in new.filter("shard = 8").collect()}
    assert moved == {i for i in range(4000) if plain_jump(i, 9) == 8} and abs(len(moved) - 4000 / 9) < 100
