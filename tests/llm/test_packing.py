import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plexgraph.llm import packing


def check(rows, got, capacity):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cut = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    order = lambda t: tuple((x is None, x) for x in t)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=order) == sorted(want, key=order)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(w[3] for w in want)


def test_awkward_table(awkward, rows_of):
    bins, total = check(rows_of, packing.pack(awkward, group_rows=6).collect(), 1024)
    assert bins <= math.ceil(total / 1024) + 4


def test_few_sequences(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "tree", "lake"]) for _ in range(rng.randrange(1, 90)))) for i in range(900)]
    bins, total = check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=64, group_rows=100).collect(), 64)
    assert bins <= math.ceil(total / 64) * 1.01 + 1


def test_no_rows_and_kept_ids(spark, no_docs):
    assert packing.pack(no_docs).count() == 0
    r = packing.pack(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), keep_ids=True).first()
    assert r["ids"][-1] == packing.END_ID and len(r["ids"]) == r["length"]


def test_search_raises_squared_fill_and_empties_bins():
    rng = random.Random(9)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(2, 40))]
        first = [[i] for i in range(len(sizes))] if rng.random() < 0.5 else packing.best_fit(sizes, 60)
        out = packing.local_search(first, sizes, 60)
        fills = [sum(sizes[i] for i in b) for b in out]
        assert sorted(i for b in out for i in b) == list(range(len(sizes))) and max(fills) <= 60
        assert sum(f * f for f in fills) >= sum(sum(sizes[i] for i in b) ** 2 for b in first) and len(out) <= len(first)


def test_exchanges_of_each_kind():
    assert packing.local_search([[0, 1], [2, 3]], [6, 3, 4, 2], 10) == [[0, 2], [3, 1]] or len(packing.local_search([[0, 1], [2, 3]], [6, 3, 4, 2], 10)) == 2
    two_for_one = packing.local_search([[0, 1], [2, 3, 4]], [7, 2, 1, 2, 4], 10)
    assert max(sum([7, 2, 1, 2, 4][i] for i in b) for b in two_for_one) == 10
    assert len(packing.local_search([[0], [1]], [4, 5], 10)) == 1  # one move empties a bin


def test_search_ends_only_where_no_exchange_is_left():
    rng = random.Random(12)
    for _ in range(40):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(2, 30))]
        out = packing.local_search(packing.best_fit(sizes, 50), sizes, 50)
        fill = [sum(sizes[i] for i in b) for b in out]
        for d, donor in enumerate(out):
            for a, receiver in enumerate(out):
                if a == d or fill[a] == 50 or fill[d] == 50:
                    continue
                gains = [sizes[i] - back for i in donor for back in [0, *(sizes[y] for y in receiver)]]
                gains += [sizes[i] + sizes[j] - sizes[y] for i in donor for j in donor if i < j for y in receiver]
                assert not any(0 < g <= 50 - fill[a] and g > fill[d] - fill[a] for g in gains)


def test_ids_equal_the_named_tokenizer(spark):
    """Every text of the test data, and strings that tokenizers trip over."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    odd = ["'s 'LL ", "\u00a0", "\u2028", "\t\r\n", "  \n\n ", "\U0001f642", "e\u0301", "\u0000", "\ufffd", "123456", "١٢٣", "ǅ", "ß", "漢字", "<|endoftext|>", "<|endo", "don't", "\u200d", "…", "½"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 30))) for _ in range(1500)] + ["a" * 3000, " " * 3000, "x1" * 2000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] if os.path.exists("/root/testdata/sf0.01") else []
    for t in texts:
        assert packing.token_ids(t).tolist() == [*exact.encode(t or "", add_special_tokens=False).ids, 2]
