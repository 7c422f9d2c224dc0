import zlib

from pyspark.sql import functions as F

from plexgraph.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    key = lambda v: (v is None, v)
    want = sorted((key(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((key(r.doc_id), r.size, r.text_crc32) for r in got) == want
    sizes = []
    for s in range(shards):
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
        sizes.append(sum(r.size for r in got if r.shard == s))
    assert sum(sizes) == sum(r.size for r in got)
    return sizes


def test_awkward_table(awkward, rows_of, no_docs):
    check(rows_of, sharding.histogram_sort(awkward, shards=3).collect(), 3)
    assert sharding.histogram_sort(no_docs).count() == 0


def test_near_equal_with_a_hot_text(spark):
    rows = [(i, "the same text again and again" if i % 3 == 0 else f"text number {i} " * (1 + i % 17)) for i in range(6000)]
    sizes = check(rows, sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
    mean = sum(sizes) / 8
    assert max(abs(s - mean) for s in sizes) <= 0.002 * mean + 600


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 4} " * 30) for i in range(4000)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.05).collect()
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_one_row_and_equal_rows(spark):
    assert check([(1, "x")], sharding.histogram_sort(spark.createDataFrame([(1, "x")], "doc_id long, text string")).collect(), 8)
    rows = [(5, "same")] * 40
    check(rows, sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)


def test_equal_rows_are_split(spark):
    rows = [(5, "the same row again")] * 4000 + [(i, f"text {i}") for i in range(4000)]
    sizes = check(rows, sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), 8)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 8


def test_written_shards(spark, tmp_path, awkward, rows_of):
    docs = spark.createDataFrame([(i, f"row {i} " * (i % 9 + 1), "en") for i in range(200)], "doc_id long, text string, lang string")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    placed = {r.doc_id: (r.shard, r.slot) for r in sharding.histogram_sort(docs, shards=4).collect()}
    assert {r.doc_id: (r.shard_number, r.slot_number) for r in back} == placed and len(back) == 200 and {r.shard_number for r in back} == {0, 1, 2, 3}
    # Null ids, repeated ids and rows, and columns named like the result's own.
    named = awkward.withColumn("slot_number", F.lit("x"))
    sharding.write_shards(named, str(tmp_path / "awkward"), shards=3)
    back = spark.read.parquet(str(tmp_path / "awkward"))
    assert set(named.columns) < set(back.columns) and {"slot_number_", "shard_number"} <= set(back.columns)
    assert sorted(str(tuple(r)) for r in back.select(*awkward.columns).collect()) == sorted(str(tuple(r)) for r in awkward.collect())
    for s in range(3):
        mine = sorted(r.slot_number_ for r in back.filter(F.col("shard_number") == s).collect())
        assert mine == list(range(len(mine)))


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    monkeypatch.setattr(sharding, "LEAST_PARTS", 4)
    rows = [(i, f"text {i}" if i % 3 else "hot text") for i in range(20_000)]
    sizes = check(rows, sharding.histogram_sort(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4)
    assert max(sizes) - min(sizes) <= 0.004 * sum(sizes)
