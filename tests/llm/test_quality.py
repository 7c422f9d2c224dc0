import random
import zlib

import numpy as np

from plexgraph.llm import quality


def corpus(n=600):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice("stone river light under seven walks".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(20, 120))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in words)
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good)))
    return rows, labels


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    one, two = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(one.value, two.value) and np.array_equal(one.cut, two.cut)


def test_awkward_empty_and_unlabelled(spark, awkward, rows_of, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (9, 1), (None, 1), (4, None), (77, 3)], "doc_id long, quality int")
    got = quality.classify(awkward, labels).collect()
    assert len(got) == len(rows_of) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(no_docs, labels).count() == 0
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.score(awkward, quality.train(awkward, labels), keep="mark").columns == [*awkward.columns, "mark"]


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    t = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=10, depth=3)

    def walk(row):
        total = t.base
        for f, c, v in zip(t.feature, t.cut, t.value):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += v[at - (2**t.depth - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])


def test_sample_bound(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    small = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), most=150)
    assert small.score(np.array([quality.statistics(rows[1][1])]))[0] > 0.5


def test_repeated_ids_count_once(spark):
    rows, labels = corpus(120)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, known = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int")
    again = spark.createDataFrame(rows + [rows[1]] * 400, schema), spark.createDataFrame(labels + [labels[1]] * 50, "doc_id long, quality int")
    one, two = quality.train(docs, known), quality.train(*again)
    assert np.array_equal(one.value, two.value) and np.array_equal(one.cut, two.cut) and one.base == two.base
