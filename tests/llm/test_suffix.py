import hashlib
import os
import random

import numpy as np
import pytest

from plexgraph.llm import induced, suffix_dedup
from plexgraph.llm.induced import suffix_order


def order_of(symbols, depth, memory, tmp_path, dtype=np.int64):
    text = np.array([*symbols, 0], dtype=dtype)
    parts = list(suffix_order(text, depth, str(tmp_path), memory))
    return text, np.concatenate([p for p, _ in parts]).tolist(), np.concatenate([x for _, x in parts]).tolist()


@pytest.mark.parametrize("memory", [2, 3, 8, 1000])
@pytest.mark.parametrize("dtype,fan", [(np.int64, 256), (np.int16, 256), (np.int64, 2), (np.int64, 3)])
def test_suffixes_and_prefixes_equal_sorting(tmp_path, memory, dtype, fan, monkeypatch):
    monkeypatch.setattr(induced, "FAN", fan)
    rng = random.Random(memory)
    for _ in range(120):
        n, kinds, depth = rng.randrange(1, 60), rng.choice([1, 2, 3, 5, 50]), rng.choice([1, 2, 5, 20, 100])
        t = [rng.randrange(0 if rng.random() < 0.3 else 1, kinds + 1) for _ in range(n)] + [1]
        t = t[:10] * 4 + [1] if rng.random() < 0.3 else t
        text, pos, pre = order_of(t, depth, memory, tmp_path, dtype)
        suffixes = [tuple(text[i : i + depth].tolist()) for i in pos]
        assert sorted(pos) == list(range(len(text))) and suffixes == sorted(suffixes)
        for a, b, common in zip(suffixes, suffixes[1:], pre[1:]):
            assert common == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_text_far_larger_than_memory(tmp_path, monkeypatch):
    """Queues spill, arrays are files, and the recursion, whose alphabet is large, works in ranges of names."""
    spilled, files, depths = [], [], []
    spill, real, named = induced.Queue.spill, induced.scratch, induced._named
    monkeypatch.setattr(induced.Queue, "spill", lambda self: (spill(self), spilled.append(self.spilled), None)[2])
    monkeypatch.setattr(induced, "scratch", lambda folder, n, dtype, memory: (files.append(n > memory), real(folder, n, dtype, memory))[1])
    monkeypatch.setattr(induced, "_named", lambda text, *more: (depths.append(len(text)), named(text, *more))[1])
    rng = np.random.default_rng(4)
    part = rng.integers(1, 20, 3000)
    text = np.concatenate([part, rng.integers(1, 20, 6000), part[500:2500], part, rng.integers(1, 20, 3000), [1, 0]]).astype(np.int16)
    memory = 300
    got = list(suffix_order(text, 100, str(tmp_path), memory))
    pos, pre = (np.concatenate([p[i] for p in got]) for i in range(2))
    raw = text.astype(np.uint8).tobytes()
    want = sorted(range(len(text)), key=lambda i: raw[i : i + 100])
    assert [raw[i : i + 100] for i in pos] == [raw[i : i + 100] for i in want] and sorted(pos.tolist()) == list(range(len(text)))
    assert all(raw[a : a + c] == raw[b : b + c] and (c == 100 or raw[a + c : a + c + 1] != raw[b + c : b + c + 1]) for a, b, c in zip(pos[:-1].tolist(), pos[1:].tolist(), pre[1:].tolist()))
    assert max(len(p) for p, _ in got) <= memory and sum(spilled) > len(text) / 4 and sum(files) > 20 and len(depths) > 1
    assert not list(tmp_path.iterdir())


def brute(rows):
    texts = sorted({((i is None, i), t or "") for i, t, *_ in rows}, key=lambda r: r[0])
    seen, out = set(), {}
    for key, t in texts:
        b = t.encode()
        mask, end = bytearray(len(b)), 0
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                a = max(j, end)
                mask[a : j + 100] = b"\1" * (j + 100 - a)
                end = j + 100
            seen.add(w)
        spans = sum(mask[j] and not (j and mask[j - 1]) for j in range(len(b)))
        out[key, t] = (len(b), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(b, mask) if not m)).hexdigest())
    return out


def test_awkward_table_equals_brute_force(awkward, rows_of, no_docs):
    # Two texts under one id are ordered by hash, which the brute force does not know: they share nothing here.
    want = brute(rows_of)
    got = sorted((((r.doc_id is None, r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(awkward).collect()), key=str)
    assert got == sorted((((i is None, i), *want[(i is None, i), t or ""]) for i, t, *_ in rows_of), key=str)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot,bits,memory", [(100, 1 << 27, 4_000_000), (1, 1 << 12, 50), (3, 1 << 27, 500)])
def test_passages_copies_and_runs(spark, hot, bits, memory):
    rng = random.Random(7)
    word = lambda: rng.choice("stone river light under seven walks green paper".split()) + rng.choice(["", "s", "ing"])
    say = lambda n: " ".join(word() for _ in range(n))
    passage, rows = say(40), []
    for i in range(90):
        kind = i % 6
        rows.append((i * 2, say(30) + (passage if kind < 3 else passage[:150] + "Z" + passage[151:] if kind == 3 else "") + say(25) if kind < 5 else "ab" * 200 + say(5)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(3000, passage + passage), (3001, "é" * 120 + passage[:99])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot, filter_bits=bits, memory=memory).collect()}
    want = brute(rows)
    assert {(i, *v) for i, v in got.items()} == {(k[0][1], *v) for k, v in want.items()}


def test_long_document_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << 11)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, text), (2, text[500:2600] + "Q" + text[7000:7400])]
    want = brute(rows)
    anchors = [x for x in suffix_dedup.segments([text.encode()])]
    covered = np.concatenate([np.concatenate([np.arange(s, s + w) for s, w in zip(a[1], a[2])]) for a in anchors])
    assert sorted(covered.tolist()) == list(range(len(text) - 99))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, *v) for i, v in got.items()} == {(k[0][1], *v) for k, v in want.items()}


def test_whole_table_equals_brute_force(spark):
    """Every row of the test data's documents, against a table of all strings of 100 bytes."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    docs = spark.read.parquet(path)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {(k[0][1], *v) for k, v in want.items()}
