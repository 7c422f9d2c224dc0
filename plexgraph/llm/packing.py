"""Packing token pieces into sequences: best fit, then swap-based local search.

Documents longer than a sequence are cut into full pieces plus a shorter first piece. Full pieces are sequences by
themselves. The rest are dealt into groups of bounded size by a salted number, so no key can crowd a group. In each
group, best fit decreasing opens bins; then bins short of tokens take from the emptiest bins whatever brings them
nearest to full: one document moved, one exchanged for one, or two for one, each raising the sum of squared fills,
until none does. Pieces in bins that are still not full go on to a next, smaller round with those of other groups, as
long as rounds fill bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import stash, table

END_ID = 2
_SPECIAL = "<|endoftext|>"
_loaded: dict[str, object] = {}


def _fast():
    """The byte-level vocabulary in its fastest form; the ids are those of the JSON tokenizer."""
    if "fast" not in _loaded:
        import base64

        import public_tokenizers as public
        import tiktoken

        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded["fast"] = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded["fast"]


def _exact():
    if "exact" not in _loaded:
        import public_tokenizers as public
        from tokenizers import Tokenizer

        _loaded["exact"] = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return _loaded["exact"]


def token_ids(text: str | None) -> np.ndarray:
    """The ids of a text and the end id. Texts that spell the special token need the JSON tokenizer, which knows it."""
    text = text or ""
    ids = np.asarray(_exact().encode(text, add_special_tokens=False).ids, dtype="<u4") if _SPECIAL in text else _fast().encode_to_numpy(text)
    return np.append(ids.astype("<u4", copy=False), np.uint32(END_ID))


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: full pieces but for the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6 if keep_ids else 5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py())
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + n]
                    for column, value in zip(out, (doc_id, k, start, n, zlib.crc32(part.tobytes()), part.astype("<i4"))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds)], names=list(names[: len(out)]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing. Bins as lists of item numbers; the free spaces are bits of one integer."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        fits = mask >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - sizes[i]
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange documents between bins that are not full until no exchange raises the sum of squared fills.

    Each round goes through the bins as donors, the emptiest first. All other open bins at once are asked what they would
    take: one of the donor's documents, one for a smaller one of theirs, or two for one; the exchange that leaves the
    least space is made, and the donor goes on until none is left. Bins that lose all documents are dropped. Every
    exchange raises a sum that is bounded, so the rounds end by themselves.
    """
    size, count = np.array(sizes, dtype=np.int64), len(bins)
    where = np.zeros(len(sizes), dtype=np.int64)
    for k, members in enumerate(bins):
        where[members] = k
    fill = np.bincount(where, weights=size, minlength=count).astype(np.int64)
    gained = True
    while gained:
        gained = False
        for d in sorted(np.flatnonzero((fill > 0) & (fill < capacity)).tolist(), key=lambda k: (fill[k], k)):
            while 0 < fill[d] < capacity:
                open_ = (fill > 0) & (fill < capacity)
                open_[d] = False
                takers = np.flatnonzero(open_)
                if not len(takers):
                    break
                own = np.flatnonzero(where == d)
                own = own[np.argsort(size[own], kind="stable")]
                # Two documents of one size are as good as any more of them.
                own = own[(np.arange(len(own)) < 2) | (size[own] != np.roll(size[own], 2))]
                one, two = np.triu_indices(len(own), 1)
                given = np.concatenate([size[own], size[own[one]] + size[own[two]]])
                theirs = np.flatnonzero(open_[where])
                back, taker = np.concatenate([np.zeros(len(takers), dtype=np.int64), size[theirs]]), np.concatenate([takers, where[theirs]])
                room, least = capacity - fill[taker], np.maximum(fill[d] - fill[taker], 0)
                space, o, y = capacity, 0, 0
                for lo in range(0, len(given), 64):  # so many offers at a time
                    gain = given[lo : lo + 64, None] - back
                    good = (gain > least) & (gain <= room)
                    good[max(0, len(own) - lo) :, : len(takers)] = False
                    left = np.where(good, room - gain, capacity)
                    at = int(left.argmin())
                    if left.flat[at] < space:
                        space, (o, y) = int(left.flat[at]), divmod(at, len(back))
                        o += lo
                if space == capacity:
                    break
                a, gain = int(taker[y]), int(given[o] - back[y])
                moved = [own[o]] if o < len(own) else [own[one[o - len(own)]], own[two[o - len(own)]]]
                where[moved] = a
                if y >= len(takers):
                    where[theirs[y - len(takers)]] = d
                fill[a] += gain
                fill[d] -= gain
                gained = True
    out: list[list[int]] = [[] for _ in range(count)]
    for i, k in enumerate(where.tolist()):
        out[k].append(i)
    return [b for b in out if b]


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


_PLACED = "uid long, sequence_id long, offset long, full boolean"


def _pack_round(rows: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        sizes, uids, group = pdf["length"].tolist(), pdf["uid"].tolist(), int(pdf["_group"].iloc[0])
        out = []
        for k, members in enumerate(pack_group(sizes, capacity)):
            at, total = 0, sum(sizes[i] for i in members)
            for i in members:
                out.append((uids[i], (number << 56) | (group << 24) | k, at, total == capacity))
                at += sizes[i]
        return pd.DataFrame(out, columns=["uid", "sequence_id", "offset", "full"])

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(one, _PLACED)


def pack(docs: DataFrame, capacity: int = 1024, group_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all rows of docs into sequences of at most capacity tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).
    group_rows bounds what one task packs at a time. Defined results: a null or empty text is one piece that holds only
    the end id; null ids and repeated rows are packed like any row; an empty table gives no rows. Other columns of docs
    are not read.
    """
    found = stash(pieces(docs, capacity, id_col, text_col, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    whole = found.filter(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.filter(F.col("length") < capacity).select("uid", "length")
    placed, left, number = whole, rest.count(), 0
    while left:
        groups = -(-left // group_rows)
        tried = stash(_pack_round(rest, groups, number, capacity), "pack-round")
        open_ = tried.filter(~F.col("full")).count()
        # Bins that are not full meet those of other groups once at least, and on while a tenth of the pieces find a place.
        again = groups > 1 and (number == 0 or 10 * open_ <= 9 * left)
        done = tried.filter("full") if again else tried
        placed = placed.unionByName(done.select("uid", "sequence_id", "offset"))
        if not again:
            break
        rest = rest.join(tried.filter(~F.col("full")).select("uid"), "uid", "left_semi")
        left, number = open_, number + 1
    return found.join(placed, "uid").drop("uid")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
