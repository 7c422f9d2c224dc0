import random
import re

import numpy as np
import pytest

from plexgraph.llm import common, minhash
from plexgraph.llm.components import UnionFind

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    uf = UnionFind()
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                uf.union(i, j)
    return sorted([(i, len(s), None if i is None else uf.find(i), i is None or uf.find(i) == i) for i, s in sets], key=str)


def run(df, k):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k=k).collect()], key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_awkward_table_equals_brute_force(awkward, rows_of, k):
    assert run(awkward, k) == brute([r[:2] for r in rows_of], k)


def test_a_large_chain_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 16)
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(400))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(60)] = word()
        rows.append((i * 3, " ".join(t)))
    rows += [(1000 + i, " ".join(word() for _ in range(40))) for i in range(60)] + [(2000 + i, rows[0][1]) for i in range(80)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4) == brute(rows, 4)


def test_no_rows(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    for share in (0.9, 0.5, 0.0):
        b = np.concatenate([a[: int(len(a) * share)], np.unique(rng.integers(0, 1 << 63, len(a) - int(len(a) * share)).astype(np.uint64))])
        s = minhash.super_minhash([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_signatures_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 40, 900, 2, 5000)]
    whole, cut = minhash.super_minhash(sets), minhash.super_minhash(sets, at_once=700)
    assert (whole == cut).all() and all((minhash.super_minhash([s])[0] == w).all() for s, w in zip(sets, whole))


def test_words_are_hashed_alike_wherever_cut():
    text = ("Ab cd\tefgh  ij " * 50).encode()
    assert (minhash.word_hashes(text)[0] == minhash.word_hashes(text, slice_bytes=7)[0]).all()


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 50, 200, 1)]
    assert minhash.overlaps(sets, sets, wide=32).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_long_words_with_one_polynomial_hash_are_told_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert minhash.word_hashes(word.encode())[0] != minhash.word_hashes(other.encode())[0]
    assert run(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string"), 4) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_only_what_is_read_later_stays_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g")]
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [p.name[:9] for p in (tmp_path / "plexgraph").iterdir()] == ["dup-rows-"]
