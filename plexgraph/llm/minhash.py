"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets become one node, so
copies cost one row. SuperMinHash gives each element a random permutation of the signature's slots and fills the j-th
slot with a rank in [j, j+1): ranks of one element are correlated, which lowers the variance, and once every slot is
below j no later step can matter, so a document of n elements takes about m ln(m) / n steps instead of m. All documents
of a batch take their j-th step together in numpy.

Nodes that share a band are candidates. Instead of all pairs of a bucket, each round verifies its nodes against one
leader; nodes that are linked form components; buckets that still hold several components get another leader. What is
left after the rounds is verified across components, block against block, in tasks of bounded size that emit links
only: every node outside the largest component of its bucket against all of the bucket, or of all buckets that hang
together where that is less work. So no link between different texts is lost that banding finds: with 42 bands of 6
rows a pair at 0.8 is missed with probability 3e-6. Before any text moves, a candidate must be likely by its signature
(see least_matches); a link counts only once the shingles of both texts have been compared as words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexgraph.llm.common import TABLE_WORDS, Scratch, bits_of, filter_of, passes, table, unused
from plexgraph.llm.components import UnionFind, components

BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS  # at most 256: slot numbers are bytes, ranks have 8 bits for the step
LEADERS = 1
#: What one side of a block holds at most: nodes, and shingles unless one document has more.
BLOCK_NODES, BLOCK_ITEMS = 512, 200_000
#: Rows of a table of buckets that may be broadcast (24 bytes each); beyond, it is joined by shuffle.
FEW = 100_000
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Longer words are hashed by a digest: a polynomial modulo 2**64 has known collisions from 1,024 bytes on, none this short.
LONG_WORD = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_FACTOR = mixed(np.arange(1, 65, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: bytes, slice_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of raw (letters A-Z lowered) and where each starts. Works in slices cut at white space."""
    raw = raw.translate(_LOWER)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + slice_bytes)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        b = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edge[::2], edge[1::2]
        up, down = _powers_to(len(b) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
        found = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            found[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        hashes.append(found)
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of k words, or the whole sequence where it has fewer."""
    return _sets_of([(t or "").encode("utf-8") for t in texts], k)


def _sets_of(raws: list[bytes], k: int) -> list[np.ndarray]:
    words, places = word_hashes(b"\n".join(raws))
    bounds = np.searchsorted(places, np.cumsum([0] + [len(r) + 1 for r in raws]))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w, n = words[a:b], b - a
        if n == 0:
            out.append(w)
        elif n < k:
            out.append(mixed((w * _FACTOR[:n]).sum(keepdims=True, dtype=np.uint64) + np.full(1, n, np.uint64) * _FACTOR[63]))
        else:
            total = w[: n - k + 1] * _FACTOR[0]
            for j in range(1, k):
                total = total + w[j : n - k + 1 + j] * _FACTOR[j]
            out.append(np.unique(mixed(total)))
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS, at_once: int = 60_000) -> np.ndarray:
    """Signatures (sets, slots) of ranks: the step in the top 8 bits, a random fraction below."""
    sig = np.full((len(sets), slots), 0xFFFFFFFF, dtype=np.uint32)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = sig.reshape(-1)
    for at in range(0, len(elements), at_once):
        x, doc = elements[at : at + at_once], owner[at : at + at_once]
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1)).reshape(-1)
        row = np.arange(len(x)) * slots
        for j in range(slots):
            h = mixed(x + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = row + j + (((h >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64)
            slot = order[k]
            order[k] = order[row + j]
            np.minimum.at(flat, doc * slots + slot, (_U(j << 24) | (h & _U(0xFFFFFF))).astype(np.uint32))
            if j + 1 < slots:
                # Early stop: a document whose slots all hold ranks of earlier steps is done.
                here = np.arange(doc[0], doc[-1] + 1)
                going = sig[here].max(axis=1) >= (j + 1) << 24
                if not going.all():
                    live = going[doc - here[0]]
                    x, doc, row = x[live], doc[live], row[live]
                    if not len(x):
                        break
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.shape[1] // bands
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    total = np.zeros(parts.shape[:2], dtype=np.uint64)
    for r in range(rows):
        total = mixed(total + (parts[:, :, r] + _U(1)) * _FACTOR[r])
    return mixed(total + np.arange(bands, dtype=np.uint64) * _FACTOR[62]).view(np.int64)


def _batches(batch: pa.RecordBatch, text_at: int, most: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """Runs of a batch's texts, each of about so many characters at most."""
    start, held, texts = 0, 0, []
    for i, t in enumerate(batch.column(text_at)):
        texts.append(t.as_py())
        held += len(texts[-1] or "")
        if held >= most:
            yield start, texts
            start, held, texts = i + 1, 0, []
    if texts:
        yield start, texts


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))


def sketches(own: DataFrame, k: int) -> DataFrame:
    """own: (doc_id, txt, text). doc_id, txt, n_shingles, digest (of the set), bands and sig (the last byte of each slot)
    of every row; empty sets have no digest, bands or sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _batches(batch, 2):
                sets = shingle_sets(texts, k)
                slots = super_minhash(sets)
                some = [bool(len(s)) for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                low = (slots & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                        _lists(band_keys(slots)[some].reshape(-1), [BANDS if s else 0 for s in some]), pa.array([b.tobytes() if s else None for b, s in zip(low, some)], pa.binary()),
                    ],
                    names=["doc_id", "txt", "n_shingles", "digest", "bands", "sig"],
                )

    return own.mapInArrow(run, "doc_id long, txt binary, n_shingles long, digest binary, bands array<long>, sig binary")


def _several(rows: DataFrame, known) -> DataFrame:
    """rows with those of their bands that pass the filter; rows without any go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            at = batch.schema.get_field_index("bands")
            flat, sizes = batch.column(at).flatten().to_numpy(), batch.column(at).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hit = passes(words, flat)
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
            out = batch.set_column(at, batch.schema.field(at), _lists(flat[hit], left.tolist()))
            yield out.filter(pa.array(left > 0))

    return rows.mapInArrow(run, rows.schema)


def _lowered(own: DataFrame, known) -> DataFrame:
    """own: (key, txt, text). (key, txt, raw) of the rows whose key passes the filter, once for each in a partition;
    raw is the text's bytes with A-Z lowered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = known.value, set()
        for batch in batches:
            at = []
            for i in np.flatnonzero(passes(words, batch.column(0).to_numpy(zero_copy_only=False))).tolist():
                one = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if one not in seen:
                    seen.add(one)
                    at.append(i)
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                raws = [(batch.column(2)[i].as_py() or "").encode("utf-8").translate(_LOWER) for i in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), pa.array(raws, pa.binary())], names=["key", "txt", "raw"])

    return own.mapInArrow(run, "key long, txt binary, raw binary")


def least_matches(percent: int) -> int:
    """Slots in which two sets of that similarity agree at least, but for a chance below 1e-7 (six deviations of
    independent slots; those of SuperMinHash vary less): little next to what the bands miss."""
    p = percent / 100
    return max(0, int(SLOTS * p - 6 * math.sqrt(SLOTS * p * (1 - p))))


def _estimated(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the similarity, by their sizes and signatures."""
    one = sigs.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("sig").alias("_sb"))
    two = sigs.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("sig").alias("_sa"))
    both = pairs.join(one, "b").join(two, "a").filter(percent * F.greatest("_na", "_nb") <= 100 * F.least("_na", "_nb")).select("a", "b", "_sa", "_sb")
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def shingles(raw: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a lowered text, as words."""
    words = _WORDS.findall(raw)
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)} if words else set()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, by their shingles as words. A leader's pairs come one after the
    other, so its shingles are made once; those of a leader with very many are split by Spark's skew join."""
    one = texts.select(F.col("node").alias("b"), F.col("raw").alias("_rb"))
    two = texts.select(F.col("node").alias("a"), F.col("raw").alias("_ra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            good = []
            for a, ra, rb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, x = a, shingles(ra.as_py(), k)
                y = shingles(rb.as_py(), k)
                both = len(x & y)
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "b").join(two, "a").select("a", "b", "_ra", "_rb").mapInArrow(run, "a long, b long")


def overlaps(one: list[np.ndarray], two: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one with all of two, by products of incidence matrices over the
    elements that both sides hold."""
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (one, two)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for items, row in sides:
        at = np.searchsorted(both, items)
        ok = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == items) if len(both) else np.zeros(len(items), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        placed.append((at[ok][order], row[ok][order]))
    for first in range(0, len(both), wide):
        grids = []
        for (at, row), s in zip(placed, (one, two)):
            lo, hi = np.searchsorted(at, [first, first + wide])
            g = np.zeros((len(s), wide), dtype=np.float32)
            g[row[lo:hi], at[lo:hi] - first] = 1
            grids.append(g)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _blocks(known: DataFrame, payload: DataFrame, block_items: int, meet, schema: str, stash) -> DataFrame:
    """meet(u, a) for pairs of blocks of nodes that may be linked across components. known: (key, node, n, root), buckets
    with several components; payload: what is sent along with a node.

    A cell is a bucket or, where that is less work, all buckets that hang together. In each cell the nodes outside its
    largest component meet all its nodes, in blocks.
    """
    star = known.join(stash(known.groupBy("key").agg(F.min("node").alias("first")), "dup-first"), "key")
    hang = components(star.select(F.col("node").alias("a"), F.col("first").alias("b")), stash=stash)
    placed = stash(known.join(hang.select("node", F.col("root").alias("group")), "node"), "dup-placed")

    def sized(rows: DataFrame, keys: list[str]) -> DataFrame:
        one = rows.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        whole = one.groupBy(*keys).agg(F.sum("c").alias("na"), F.sum("s").alias("sa"), F.max(F.struct("c", "root", "s")).alias("top"))
        return whole.select(*keys, "na", "sa", (F.col("na") - F.col("top.c")).alias("nu"), (F.col("sa") - F.col("top.s")).alias("su"), F.col("top.root").alias("top"))

    whole = placed.select("group", "node", "n", "root").distinct()
    of_group, of_key = stash(sized(whole, ["group"]), "dup-cells"), stash(sized(placed, ["group", "key"]), "dup-cells")
    cost = of_key.groupBy("group").agg(F.sum(F.col("na") * F.col("nu")).alias("_split"))
    chosen = of_group.join(cost, "group").select("group", (F.col("na") * F.col("nu") <= F.col("_split")).alias("_whole"))
    chosen = stash(chosen, "dup-chosen")
    one = whole.join(of_group.join(chosen.filter("_whole"), "group").drop("_whole"), "group").withColumn("cell", F.xxhash64("group")).drop("group")
    two = placed.join(of_key.join(chosen.filter("NOT _whole"), "group").drop("_whole"), ["group", "key"]).withColumn("cell", F.col("key")).drop("group", "key")

    def blocks(nodes: str, items: str):
        return F.greatest(F.ceil(F.col(items) / block_items), F.ceil(F.col(nodes) / BLOCK_NODES), F.lit(1)).cast("int")

    cells = one.unionByName(two.select(one.columns)).filter("nu > 0").withColumns({"_a": blocks("na", "sa"), "_u": blocks("nu", "su")})
    h = F.xxhash64("node")
    every = cells.select("cell", "node", "root", F.pmod(h, F.col("_a")).cast("int").alias("ab"), F.explode(F.sequence(F.lit(0), F.col("_u") - 1)).alias("ub"), F.lit(False).alias("asks"))
    asks = cells.filter(F.col("root") != F.col("top")).select("cell", "node", "root", F.explode(F.sequence(F.lit(0), F.col("_a") - 1)).alias("ab"), F.pmod(h, F.col("_u")).cast("int").alias("ub"), F.lit(True).alias("asks"))

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        u, a = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        return meet(u, a) if len(u) and len(a) else pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in schema.split(", ")})

    return every.unionByName(asks).join(payload, "node").groupBy("cell", "ub", "ab").applyInPandas(both, schema)


def _across(known: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int, stash) -> DataFrame:
    """Links between nodes of different components; known as in _blocks. Signatures tell which nodes may have a partner
    in another component; the sets of those alone meet block against block."""
    least = least_matches(percent)

    def apart(u: pd.DataFrame, a: pd.DataFrame) -> np.ndarray:
        return u["root"].to_numpy()[:, None] != a["root"].to_numpy()[None, :]

    def near(u: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.frombuffer(b"".join(s["sig"]), dtype=np.uint8).reshape(-1, SLOTS) for s in (u, a))
        same = np.zeros((len(x), len(y)), dtype=np.uint16)
        for j in range(SLOTS):
            same += x[:, j, None] == y[None, :, j]
        i, j = np.nonzero((same >= least) & apart(u, a))
        return pd.DataFrame({"node": np.unique(np.concatenate([u["node"].to_numpy()[i], a["node"].to_numpy()[j]]))})

    def meet(u: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        x, y = ([np.asarray(v, dtype=np.int64) for v in s["items"]] for s in (u, a))
        both = overlaps(x, y)
        nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
        alike = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & apart(u, a)
        rows, sets_ = [], UnionFind()
        un, an, ur, ar = (c.tolist() for c in (u["node"], a["node"], u["root"], a["root"]))
        for i, j in np.argwhere(alike).tolist():
            # One link for each two components that meet here is enough.
            if sets_.find(ur[i]) != sets_.find(ar[j]):
                sets_.union(ur[i], ar[j])
                rows.append((min(un[i], an[j]), max(un[i], an[j])))
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    asked = stash(_blocks(known, sigs.select("node", "sig"), 1 << 62, near, "node long", stash).distinct(), "dup-asked")
    some = known.join(asked, "node", "left_semi")
    split = some.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter(F.col("_lo") < F.col("_hi")).select("key")
    some = stash(some.join(split, "key").select("key", "node", "n", "root"), "dup-known")
    if some.isEmpty():
        return known.sparkSession.createDataFrame([], "a long, b long")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = _sets_of(part.column(1).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], names=["node", "items"])

    sets = stash(texts.join(asked, "node", "left_semi").select("node", "raw").mapInArrow(items, "node long, items array<long>"), "dup-sets")
    return _blocks(some, sets, BLOCK_ITEMS, meet, "a long, b long", stash)


#: Stands for a missing id: after all others.
LAST = (1 << 63) - 1


def text_key(id_col, text_col):
    """(key, txt): what a row is told by. txt is the digest of its text, key a hash of that and of its id."""
    txt = F.unhex(F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.xxhash64(F.coalesce(id_col.cast("long"), F.lit(LAST)), txt), txt


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = True, one_by_id: bool = False, keep: Scratch | None = None) -> DataFrame:
    """A stored row for each row of docs: uid (a number of its own), doc_id, txt, n_shingles, root (tells its group of
    near duplicates; null for a row without words) and first (the least id in the group, nulls counting as LAST).

    null_ids: whether rows without an id take part. one_by_id: whether rows that share an id are linked. keep: what
    stores the result; all other tables of the call are deleted.
    """
    spark = docs.sparkSession
    stash = Scratch(spark)
    key, txt = text_key(F.col(id_col), F.col(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), txt.alias("txt"), F.col(text_col).alias("text"))
    rows = stash(sketches(own, k).withColumn("uid", F.monotonically_increasing_id()), "dup-sketches")
    some = rows.filter("digest IS NOT NULL" if null_ids else "digest IS NOT NULL AND doc_id IS NOT NULL")
    ord_ = F.coalesce("doc_id", F.lit(LAST))
    # Rows with equal sets are one node, named by the least of their numbers.
    nodes = stash(some.groupBy("digest").agg(F.min("uid").alias("node"), F.min(ord_).alias("first")), "dup-nodes")
    named = nodes.select("digest", "node")
    banded = some.select("digest", F.col("uid").alias("node"), "bands").join(named, ["digest", "node"]).select("node", F.explode("bands").alias("key"))
    leads = banded.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).filter(F.col("lead") < F.col("_last"))
    leads = stash(leads.select("key", "lead"), "dup-leads")
    sent = spark.sparkContext.broadcast(filter_of(leads, "key"))
    slim = some.select("digest", F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "sig", "bands")
    sigs = stash(_several(slim, sent).join(named, ["digest", "node"]).select("node", "n", "sig", "bands"), "dup-sigs")
    sent.unpersist()
    known = stash(sigs.select("node", "n", F.explode("bands").alias("key")).join(leads, "key"), "dup-members")
    stash.drop(leads)
    tested = pairs = stash(known.filter(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "dup-pairs")
    members = known.select("key", "node", "n")
    # The texts of nodes that share a band: a filter of bounded size keeps the others where they are.
    at = F.xxhash64(ord_, "txt")
    wanted = stash(some.select(F.col("uid").alias("node"), at.alias("key"), "txt").join(members.select("node").distinct(), "node"), "dup-wanted")
    sent = spark.sparkContext.broadcast(filter_of(wanted, "key"))
    found = _lowered(docs.select(key.alias("key"), txt.alias("txt"), F.col(text_col).alias("text")), sent)
    # A row that is repeated may come once from each partition.
    once = found.groupBy("key", "txt").agg(F.any_value("raw").alias("raw"))
    texts = stash(once.join(wanted, ["key", "txt"]).select("node", "raw"), "dup-texts", "zstd")
    sent.unpersist()
    links = stash(_verified(stash(_estimated(pairs, sigs, percent), "dup-likely"), texts, k, percent), "dup-links")
    if one_by_id:
        shared = some.groupBy("doc_id").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).filter(F.col("_lo") < F.col("_hi")).select("doc_id")
        of = stash(some.select("doc_id", "digest").join(shared, "doc_id").join(named, "digest").select("doc_id", "node").distinct(), "dup-shared")
        links = links.unionByName(of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")))
    groups = components(links, stash=stash)

    for turn in range(LEADERS + 1):
        known = stash(members.join(groups, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "dup-known")
        lead = F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root"))
        split = known.groupBy("key").agg(lead.alias("l"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter(F.col("_lo") < F.col("_hi"))
        split = stash(split.select("key", F.col("l.node").alias("lead"), F.col("l.root").alias("lead_root")), "dup-split")
        if split.isEmpty():
            break
        known = stash(known.join(F.broadcast(split) if split.count() <= FEW else split, "key"), "dup-members")
        members = known.select("key", "node", "n")
        if turn < LEADERS:
            new = known.filter(F.col("root") != F.col("lead_root")).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
            new = stash(new.join(tested, ["a", "b"], "left_anti"), "dup-pairs")
            tested = tested.unionByName(new)
            likely = stash(_estimated(new, sigs, percent), "dup-likely")
        else:
            likely = stash(_across(known.select("key", "node", "n", "root"), sigs, texts, k, percent, stash), "dup-likely")
        if not likely.isEmpty():
            links = links.unionByName(stash(_verified(likely, texts, k, percent), "dup-links"))
            groups = components(links, stash=stash)
    placed = stash(nodes.join(groups, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first"), "dup-groups")
    of_digest = placed.select("digest", "root").join(placed.groupBy("root").agg(F.min("first").alias("first")), "root")
    kept = ("uid", "doc_id", "txt", "n_shingles")
    # Rows without words stay out of the join, in which they would all meet in one task.
    out = some.select(*kept, "digest").join(of_digest, "digest").select(*kept, "root", "first")
    alone = rows.filter("digest IS NULL" if null_ids else "digest IS NULL OR doc_id IS NULL")
    out = (keep or Scratch(spark))(out.unionByName(alone.select(*kept, F.lit(None).cast("long").alias("root"), ord_.alias("first"))), "dup-rows")
    stash.close()
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links) and kept (doc_id = component_id) of every row.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles. Defined
    results: a null or empty text, or one without words, has an empty set and no links; fewer than k words are one
    shingle; rows that share an id are one document for links, whether or not their texts differ; a row with a null id is
    never linked to and has itself no component (kept is true); an empty table gives no rows. percent below 80 lowers
    the recall of the bands.
    """
    found = grouped(docs, k, percent, id_col, text_col, null_ids=False, one_by_id=True)
    component = F.when(F.col("doc_id").isNotNull(), F.col("first"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates; all columns as they are.

    Decided by row, not by id: different texts that share an id, or have none, are different documents. The kept row is
    the one with the least id (nulls last), then the least digest of its text; of rows equal in both, the one whose
    columns hash least. Rows without words are linked with nothing and all stay. Texts are not moved, but for those of
    rows that a filter of bounded size cannot tell from rows to be dropped.
    """
    spark = docs.sparkSession
    stash = Scratch(spark)
    found = grouped(docs, k, percent, id_col, text_col, keep=stash)
    ord_ = F.coalesce("doc_id", F.lit(LAST))
    words = found.filter("root IS NOT NULL").select("root", "first", "txt", ord_.alias("ord"))
    best = stash(words.filter("ord = first").groupBy("root").agg(F.min("txt").alias("_best")), "dup-best")
    # A row for each different (id, text): is it the kept one, and is it there more than once?
    each = words.groupBy("root", "first", "ord", "txt").agg(F.count(F.lit(1)).alias("n"))
    told = each.join(best, "root").select(F.xxhash64("ord", "txt").alias("_key"), F.col("txt").alias("_txt"), ((F.col("ord") == F.col("first")) & (F.col("txt") == F.col("_best"))).alias("_kept"), "n")
    told = stash(told.filter("NOT _kept OR n > 1").select("_key", "_txt", "_kept"), "dup-told")
    stash.drop(found, best)
    key, txt = text_key(F.col(id_col), F.col(text_col))
    k_, t_, b_, w_, m_ = (unused(docs, n) for n in ("__key", "__txt", "__bits", "__word", "__kept"))
    bits = bits_of(told, "_key").select(F.col("word").alias(w_), F.col("bits").alias(b_))
    word = F.shiftrightunsigned(k_, 6).bitwiseAND(F.lit(TABLE_WORDS - 1).cast("long"))
    keyed = docs.withColumn(k_, key).withColumn(t_, txt)
    keyed = keyed.join(F.broadcast(bits), word == F.col(w_), "left")
    maybe = F.coalesce(F.expr(f"(shiftrightunsigned(`{b_}`, CAST(`{k_}` & 63 AS INT)) & 1) = 1"), F.lit(False))
    of = told.select(F.col("_key").alias(k_), F.col("_txt").alias(t_), F.col("_kept").alias(m_))
    asked = keyed.filter(maybe).join(of, [k_, t_], "left")
    out = keyed.filter(~maybe).select(*docs.columns).unionByName(asked.filter(F.col(m_).isNull()).select(*docs.columns))
    if not told.filter("_kept").isEmpty():
        hashed = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
        once = asked.filter(F.col(m_)).groupBy(k_, t_).agg(F.min_by(F.struct(*docs.columns), hashed).alias(b_))
        out = out.unionByName(once.select(*[F.col(b_)[c].alias(c) for c in docs.columns]))
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
