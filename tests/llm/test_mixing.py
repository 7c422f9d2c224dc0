import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plexgraph.llm import mixing


TEN = "w " * 10
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def targets(sizes):
    """Water filling by steps: what is over a cap is shared again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in names if s not in capped)
        new = {s: 3 * sizes[s] for s in names if s not in capped and left * weight[s] / w > 3 * sizes[s]}
        if not new:
            return {s: capped.get(s, left * weight[s] / w if w else 0) for s in names}
        capped |= new


def check(rows, got):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = {}, {}
    for i, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
        largest[s] = max(largest.get(s, 0), size_of(t))
    want = targets(sizes)
    key = lambda v: (v is None, v)
    assert sorted((key(r.doc_id), r.size) for r in got) == sorted((key(i), size_of(t)) for i, t, *_ in rows)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and r.taken <= 3 * r.size and r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= largest[s]


def test_awkward_table(awkward, rows_of, no_docs):
    check(rows_of, mixing.mix(awkward).collect())
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_hot_source_and_all_levels(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "LEVELS", (2, 4, 8, 20, 52))
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), "en", "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "tiny"] if i % 50 == 0 else ["a", "b", "c"]), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = mixing.mix(df).collect()
    check(rows, one)
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_picks_are_by_threshold(spark):
    rows = [(i, TEN, "en", "ab"[i % 2], 1) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    h = lambda i: int(hashlib.md5(f"{i}:{hashlib.md5(TEN.encode()).hexdigest()}".encode()).hexdigest()[:13], 16)
    for s in "ab":
        mine = sorted((h(r.doc_id), -r.copies) for r in got if r.source == s)
        assert [c for _, c in mine] == sorted(c for _, c in mine)


def test_repeats_are_rows(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    made = {r.doc_id: r["n"] for r in mixing.mixed_documents(df).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert made == {i: c for i, c in copies.items() if c}


def test_plan_is_native(spark, no_docs):
    plan = mixing.mix(no_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("same", [True, False])
def test_rows_without_ids_are_split(spark, same):
    """A source of rows without ids, equal or not in text, and one of rows that share an id."""
    rows = [(None, TEN if same else f"w{i} " * 10, "en", "b", 1) for i in range(100)] + [(i, TEN, "en", "a", 1) for i in range(300)] + [(7, TEN, "en", "c", 1)] * 90
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    got = mixing.mix(df)
    check(rows, got.collect())
    want = {r.source: r.taken for r in got.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    made = mixing.mixed_documents(df)
    assert {r.source: r.n for r in made.groupBy("source").agg((10 * F.count(F.lit(1))).alias("n")).collect()} == {s: n for s, n in want.items() if n}


def test_many_sources_equal_few(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 30), "en", f"s{rng.randrange(300)}", 1) for i in range(1500)]
    df = spark.createDataFrame(rows, COLUMNS)
    one = mixing.mix(df).collect()
    check(rows, one)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixing.mix(df).collect()))
