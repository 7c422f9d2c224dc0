import random

import pytest

import corpus_pipeline
from plexgraph.llm import minhash, quality, secrets


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    d, rows, labels = tmp_path_factory.mktemp("sf"), [], []
    say = lambda n: " ".join(rng.choice("stone river light under seven walks green paper".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))
    for i in range(240):
        text = say(rng.randrange(15, 90)) + "."
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 7 == 0:
            text += ' token = "0123456789abcdef0123456789abcdef"'
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(500 + i, rows[1][1], "en", "a", len(rows[1][1])) for i in range(5)] + [(600, None, None, None, None), (601, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_each_stage_on_its_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, sf_dir), "test")
        outs.append(docs)
    assert len(outs) == 5 and all(o.columns == ["doc_id", "text", "lang", "source", "n_chars"] for o in outs[:4])
    good, unique, clean, mixed, packed = outs
    scored = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.filter("predicted = 1").collect()}
    assert not {i for i in range(0, 240, 5)} & {r.doc_id for r in good.collect()}
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in minhash.near_duplicates(good).filter("kept").collect()} and not {500, 501, 502, 503, 504} & {r.doc_id for r in unique.collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {r.doc_id for r in unique.collect()}
    for i, t in texts.items():
        assert t == before[i] or "[SECRET]" in t
    assert not any("0123456789abcdef" in (t or "") for t in texts.values())
    assert {r.doc_id for r in mixed.collect()} <= set(texts) and {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_and_awkward_rows(spark, sf_dir, awkward):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == awkward.columns
        docs = corpus_pipeline.stash(docs, "test")
    corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count()


def test_empty_tables(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, sf_dir), "test")
        assert docs.count() == 0


def test_repeated_ids_stay_once(spark, sf_dir):
    rows = [(1, "seven green stones under light", "en", "a", 5)] * 3 + [(None, "another text here", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect()) == ["1", "None"]


def test_secret_free_documents_are_untouched(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 7 AND doc_id > 0")
    assert sorted(map(tuple, secrets.redact(df, secrets.weights_of(spark)).collect())) == sorted(map(tuple, df.collect()))


def test_unlike_texts_of_one_id_stay(spark, sf_dir, awkward):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one, "en", "a", 1), (2, one + " more", "en", "a", 1), (2, two, "en", "a", 2), (3, three, "en", "a", 3), (3, two + " tail", "en", "a", 4), (None, three, "en", "b", 5), (None, three, "de", "b", 6)]
    rows += [(None, "a text of its own", None, None, 7), (9, None, None, None, None), (9, None, None, None, None), (4, "four words of text", "en", "a", 8), (4, "four words of text", "en", "a", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect()), key=str)
    assert got == sorted([(1, one), (2, two), (3, three), (None, "a text of its own"), (9, None), (9, None), (4, "four words of text")], key=str)
    kept = corpus_pipeline.near_duplicate_stage(spark, awkward, sf_dir)
    assert kept.columns == awkward.columns and sorted(map(str, kept.collect())) == sorted(map(str, corpus_pipeline.near_duplicate_stage(spark, awkward.repartition(5), sf_dir).collect()))
