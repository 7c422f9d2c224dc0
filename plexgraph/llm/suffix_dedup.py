"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier.

Each 100-byte string is routed by its anchor, the 32 bytes in it whose hash is least; strings with one anchor form a
segment, about 134 bytes for 35 strings. Equal strings have equal anchors, so they meet, and anchors that occur in one
text only, once, need no further look: a first pass counts anchors, a second one emits the segments of the rest, past a
filter of bounded size. What a full filter lets through besides stands alone in its group and goes no farther. Equal
segments leave their earliest occurrence. Where an anchor stands in many different
segments, its segments are halved, and each half routed by the longer context that its strings share, until no group is
large. Then each shard's suffixes are sorted by external induction (see induced.py); neighbours that share 100 bytes are
equal strings, and all but the earliest are marked.

Whole copies of a text need no segments: all of a later copy of 100 bytes or more is removed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import Scratch, table
from plexgraph.llm.induced import pieces, scratch, suffix_order
from plexgraph.llm.minhash import _BYTE, _powers_to, mixed

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Bits of the filter of repeated anchors at most; with more anchors it lets more segments through, never fewer.
FILTER_BITS = 1 << 27
#: Different segments of one anchor beyond which they are routed by longer contexts.
HOT = 100
#: Bytes of a shard, and the suffixes of it that are worked on in memory at a time; the rest is on the task's disk.
SHARD_BYTES, MEMORY = 4 << 20, 1_500_000
_PIECE = 1 << 20  # positions in a buffer have 20 bits
_U = np.uint64
LAST = (1 << 63) - 1


def _buffers(raws: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (document, offset, bytes) in buffers of less than 2**19 bytes. A long document's pieces overlap, so that
    each string lies in one piece."""
    held, size = [], 0
    for k, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, _PIECE // 4):
            part = raw[at : at + _PIECE // 4 + LENGTH - 1]
            if size + len(part) >= _PIECE // 2:
                yield held
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
    if held:
        yield held


def segments(raws: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each buffer: document, first string's start, number of strings, anchor's place in the segment, anchor."""
    for pieces in _buffers(raws):
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        b = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
        n = len(b)
        up, down = _powers_to(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * up[:n], dtype=np.uint64, out=total[1:])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        key = (grams & ~_U(_PIECE - 1)) | np.arange(len(grams), dtype=np.uint64)
        # Least key of every WINDOW in a row: from both sides of blocks of that width.
        wide = -(-len(key) // WINDOW) * WINDOW
        padded = np.concatenate([key, np.full(wide - len(key), ~_U(0))]).reshape(-1, WINDOW)
        left = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        right = np.minimum.accumulate(padded, axis=1).reshape(-1)
        strings = n - LENGTH + 1
        anchor = (np.minimum(left[:strings], right[WINDOW - 1 : WINDOW - 1 + strings]) & _U(_PIECE - 1)).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)[:strings]
        valid = np.arange(strings) + LENGTH <= ends[piece]
        edge = np.ones(strings, dtype=bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        # Invalid strings stand at the ends of pieces only.
        first = np.flatnonzero(edge & valid)
        run = np.cumsum(edge) - 1
        count = np.bincount(run[valid], minlength=int(run[-1]) + 1)[run[first]]
        of = piece[first]
        doc = np.array([k for k, _, _ in pieces])[of]
        shift = np.array([at for _, at, _ in pieces])[of] - (ends - sizes)[of]
        yield doc, first + shift, count, anchor[first] - first, grams[anchor[first]].view(np.int64)


def _groups(batch: pa.RecordBatch, text_at: int, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    start, held, raws = 0, 0, []
    for i, t in enumerate(batch.column(text_at)):
        raws.append((t.as_py() or "").encode("utf-8"))
        held += len(raws[-1])
        if held >= most:
            yield start, raws
            start, held, raws = i + 1, 0, []
    if raws:
        yield start, raws


def _anchors(own: DataFrame) -> DataFrame:
    """(anchor, dg, again) of every anchor of every text: again if it occurs more than once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dg = batch.column(1).to_numpy(zero_copy_only=False)
            for start, raws in _groups(batch, 2):
                parts = [(d, s + a, h) for d, s, _, a, h in segments(raws)]
                if not parts:
                    continue
                doc, place, anchor = (np.concatenate([p[i] for p in parts]) for i in range(3))
                order = np.lexsort((place, anchor, doc))
                doc, place, anchor = doc[order], place[order], anchor[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                # A run cut by two pieces shows the same place twice.
                moved = np.zeros(len(doc), dtype=bool)
                moved[1:] = ~new[1:] & (place[1:] != place[:-1])
                again = np.logical_or.reduceat(moved, at)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(dg[start:][doc[at]]), pa.array(again)], names=["anchor", "dg", "again"])

    return own.mapInArrow(run, "anchor long, dg long, again boolean")


def _filter(repeated: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each anchor, in so many bits."""
    places = F.explode(F.array(F.col("anchor").bitwiseAND(bits - 1), F.shiftrightunsigned("anchor", 29).bitwiseAND(bits - 1)))
    words = repeated.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


_SEGMENT = "key long, off int, w int, ord long, dg long, s long, seg binary"


def _emit(own: DataFrame, sent, bits: int) -> DataFrame:
    """The segments whose anchor passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ords, dg = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start, raws in _groups(batch, 2):
                for doc, s, w, off, anchor in segments(raws):
                    a = anchor.view(np.uint64)
                    hit = np.ones(len(a), dtype=bool)
                    for p in (a & _U(bits - 1), (a >> _U(29)) & _U(bits - 1)):
                        hit &= (known[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == _U(1)
                    at = np.flatnonzero(hit)
                    if not len(at):
                        continue
                    d, b, n = doc[at], s[at], w[at]
                    seg = [raws[i][j : j + m + LENGTH - 1] for i, j, m in zip(d.tolist(), b.tolist(), n.tolist())]
                    arrays = (anchor[at], off[at].astype(np.int32), n.astype(np.int32), ords[start:][d], dg[start:][d], b)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(seg, pa.binary())], names=["key", "off", "w", "ord", "dg", "s", "seg"])

    return own.mapInArrow(run, _SEGMENT)


def _earliest(rows: DataFrame, put) -> tuple[DataFrame, DataFrame]:
    """Marks of all occurrences of equal segments but the earliest; and the earliest ones of keys with several kinds.
    uid, which is stored with the rows, tells rows of one place apart (repeated rows of the input)."""
    # Segments are told by two hashes of different order and seed, 128 bits.
    rows = rows.withColumns({"kind": F.xxhash64("seg", "off"), "kind2": F.xxhash64(F.lit(7), "off", "seg")})
    first = put(rows.groupBy("key", "kind", "kind2").agg(F.min(F.struct("ord", "dg", "s", "uid")).alias("first")), "rep-first")
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    several = put(several, "rep-keys")
    copies = rows.select("key", "kind", "kind2", "ord", "dg", "s", "w").join(first, ["key", "kind", "kind2"]).filter(F.struct("ord", "dg", "s") != F.struct("first.ord", "first.dg", "first.s"))
    marks = copies.select("ord", "dg", F.col("s").alias("lo"), (F.col("s") + F.col("w") + (LENGTH - 1)).alias("hi"))
    flat = first.join(several, "key").select("key", "kind", "kind2", "kinds", "first.uid")
    return marks, rows.join(flat, ["key", "kind", "kind2", "uid"]).drop("kind", "kind2")


def _halved(rows: DataFrame) -> DataFrame:
    """Each segment as two: the strings that reach farther to the left of the anchor, and the others. Each is keyed by
    the bytes that all strings of its half share."""
    mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), (mid - 1).alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))).alias("_h")
    out = rows.select("key", "off", "w", "ord", "dg", "s", "uid", "seg", halves)
    start = F.greatest(F.lit(0), F.col("off") - F.col("_h.hi"))
    end = F.least(F.col("w") - 1, F.col("off") - F.col("_h.lo"))
    out = out.withColumns({"_i": start, "_j": end, "lo": F.col("_h.lo"), "hi": F.col("_h.hi")}).filter("_i <= _j")
    shared = F.substring(F.col("seg"), F.col("off") - F.col("lo") + 1, LENGTH - F.col("hi") + F.col("lo"))
    return out.select(
        F.xxhash64("key", "lo", "hi", shared).alias("key"), (F.col("off") - F.col("_i")).alias("off"), (F.col("_j") - F.col("_i") + 1).alias("w"), "ord", "dg",
        (F.col("s") + F.col("_i")).alias("s"), "uid", F.substring(F.col("seg"), F.col("_i") + 1, F.col("_j") - F.col("_i") + LENGTH).alias("seg"), "lo", "hi",
    )


def sort_shard(rows: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    """Marks (ord, dg, lo, hi) of the strings of a shard's segments that start earlier in another place of the shard.

    Text, segments' columns and marked places are files of the task's scratch folder, which goes with the task; a lost
    task starts anew from the stored segments. The folder stands where Spark itself spills, as it tells its workers."""
    spill = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    with tempfile.TemporaryDirectory(dir=spill[0] if spill else None) as folder:
        files = [open(os.path.join(folder, name), "w+b") for name in ("text", "size", "ord", "dg", "s")]
        for batch in rows:
            segs = batch.column(batch.schema.get_field_index("seg")).to_pylist()
            flat = np.frombuffer(b"\0".join(segs) + b"\0" if segs else b"", dtype=np.uint8).astype("<i2") + 1
            n = np.array([len(x) for x in segs], dtype="<i8")
            flat[np.cumsum(n + 1) - 1] = 0
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("<i8") for c in ("ord", "dg", "s")]
            for f, x in zip(files, (flat, n, *columns)):
                f.write(x.tobytes())
        for f in files:
            f.flush()
        if not os.path.getsize(files[1].name):
            return
        text = np.memmap(files[0], dtype="<i2", mode="r")
        size, ords, dgs, starts = (np.memmap(f, dtype="<i8", mode="r") for f in files[1:])
        base = scratch(folder, len(size), np.int64, memory)
        at = 0
        for lo, hi in pieces(len(size), memory):
            ends = np.cumsum(size[lo:hi] + 1) + at
            base[lo:hi] = ends - size[lo:hi] - 1
            at = int(ends[-1])
        marked = scratch(folder, len(text), bool, memory)
        marked[:] = False

        def settle(pos: np.ndarray, group: np.ndarray) -> None:
            """All but the earliest of each group of equal strings."""
            many = np.bincount(group)[group] > 1
            p, g = pos[many], group[many]
            seg = np.searchsorted(base, p, side="right") - 1
            inside = p - base[seg] + LENGTH <= size[seg]  # others run past the end of their segment
            p, g, seg = p[inside], g[inside], seg[inside]
            if len(p):
                place = starts[seg] + p - base[seg]
                order = np.lexsort((place, dgs[seg], ords[seg], g))
                p, seg, place, g = p[order], seg[order], place[order], g[order]
                later = np.concatenate([[False], g[1:] == g[:-1]])
                # The same place may stand in two segments of one key: it is not earlier than itself.
                lead = np.flatnonzero(~later)[np.cumsum(~later) - 1]
                later &= (place != place[lead]) | (ords[seg] != ords[seg[lead]]) | (dgs[seg] != dgs[seg[lead]])
                marked[p[later]] = True

        held = np.zeros(0, dtype=np.int64)
        for pos, prefix in suffix_order(text, LENGTH, folder, memory):
            group = np.cumsum(prefix < LENGTH)
            if len(held):
                pos, group = np.concatenate([held, pos]), np.concatenate([np.zeros(len(held), dtype=np.int64), group])
            open_ = group == group[-1]  # may go on in the next piece
            settle(pos[~open_], group[~open_])
            held = pos[open_]
        if len(held):
            settle(held, np.zeros(len(held), dtype=np.int64))
        for lo, hi in pieces(len(text), memory):
            # Runs of marked places; strings end before a segment does, so no run goes on into the next one.
            edge = np.diff(np.concatenate([[0], marked[lo:hi].astype(np.int8), [0]]))
            first, stop = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo
            if len(first):
                seg = np.searchsorted(base, first, side="right") - 1
                place = starts[seg] + first - base[seg]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in (ords[seg], dgs[seg], place, place + (stop - first) - 1 + LENGTH)], names=["ord", "dg", "lo", "hi"])
        del text, size, ords, dgs, starts
        for f in files:
            f.close()


def _cut(own: DataFrame) -> DataFrame:
    """own: ord, dg, text, doc_id, marks. The rows of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8")
                spans: list[list[int]] = []
                for m in sorted((x["lo"], x["hi"]) for x in marks.as_py() or ()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                kept, at = hashlib.sha256(), 0
                for lo, hi in spans:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, put, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, filter_bits: int = FILTER_BITS, memory: int = MEMORY) -> tuple[DataFrame, DataFrame]:
    """(texts, marks): rows doc_id, ord, dg, text of docs, and byte spans (ord, dg, lo, hi) to remove, which may overlap.
    put stores a table and returns it read again."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("dg"), text.alias("text"))
    rows = put(own.select("ord", "dg", F.octet_length("text").cast("long").alias("n"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")), "rep-rows")
    first = put(rows.groupBy("digest").agg(F.min("ord").alias("first")), "rep-texts")
    whole = rows.join(first, "digest").filter((F.col("ord") > F.col("first")) & (F.col("n") >= LENGTH))
    marks = [whole.select("ord", "dg", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))]
    one = own.select("ord", "dg", "text")
    counted = _anchors(one).groupBy("anchor").agg(F.min("dg").alias("a"), F.max("dg").alias("b"), F.max("again").alias("again"))
    repeated = put(counted.filter("again OR a < b").select("anchor"), "rep-anchors")
    known = repeated.count()
    if known:
        bits = min(filter_bits, 1 << max(10, (16 * known).bit_length()))
        sent = spark.sparkContext.broadcast(_filter(repeated, bits))
        found = put(_emit(one, sent, bits).withColumn("uid", F.monotonically_increasing_id()), "rep-segments", "zstd")
        sent.unpersist()
        found = found.withColumns({"lo": F.lit(0), "hi": F.lit(WINDOW - 1)})
        cold = []
        while True:
            copies, kept = _earliest(found, put)
            marks.append(copies)
            kept = put(kept, "rep-kinds", "zstd")
            cold.append(kept.filter((F.col("kinds") <= hot) | (F.col("lo") == F.col("hi"))).select("key", "ord", "dg", "s", "seg"))
            large = kept.filter((F.col("kinds") > hot) & (F.col("lo") < F.col("hi"))).drop("kinds")
            if large.isEmpty():
                break
            found = put(_halved(large), "rep-segments", "zstd")
        shard_rows = cold[0]
        for c in cold[1:]:
            shard_rows = shard_rows.unionByName(c)
        size = shard_rows.agg(F.coalesce(F.sum(F.octet_length("seg")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
        marks.append(shard_rows.repartition(shards, "key").mapInArrow(lambda it: sort_shard(it, memory), "ord long, dg long, lo long, hi long"))
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    return own, every


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Removed is each byte covered by a string of 100 bytes that also starts earlier: in a row with a smaller id, or
    earlier in the same text. Defined results: a null text is empty; texts of fewer than 100 bytes stay; rows that share
    an id and a text are one document; rows that share an id only are ordered by the texts' hashes; rows with a null id
    come after all others; an empty table gives no rows.
    """
    put = Scratch(docs.sparkSession)
    own, marks = repeated_spans(docs, put, **how)
    # Rows that are repeated give equal marks, which are met once in each task already.
    by_row = marks.groupBy("ord", "dg").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    by_row = put(by_row, "rep-marks")
    put.close(by_row)
    return _cut(own.join(by_row, ["ord", "dg"], "left").select("doc_id", "text", "marks"))


def op8(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
