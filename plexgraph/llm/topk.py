"""Exact top-k search by inner product: a Voronoi join.

Equal vectors are first reduced to one row with their smallest ids, so a vector that many rows share costs one row. A
bounded sample gives pivots; every vector belongs to the cell of its nearest pivot. Cells are summarised: their size,
radius, and how far their members reach along the pivot and across it. Each query has a threshold of its own, the score
that k partners in the sample reach, and the summaries bound what any member of a cell can score with it. A query goes
only to the blocks, cells or parts of cells of bounded size, whose bound reaches its threshold; a block's vectors go only
where queries wait for them. Each pair of a block and a chunk of queries is solved locally, and what reaches the
thresholds is merged. Results depend neither on the pivots nor on the cells.

What the driver holds is the sample, the pivots and a summary of each cell and block, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import Scratch, table

_EXACT = float(2**52)


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, ints) with each component as floor(scale * x); rows with a null, a null component or a component
    that is not finite are left out, as are those with a null id."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)).alias("ints"))


def _matrix(column, width: int) -> np.ndarray:
    """Lists of integers as rows, short ones filled up with zeros, which leaves every inner product as it is."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for k, x in enumerate(column):
        out[k, : len(x)] = x
    return out


def _packed(column, width: int, code: str) -> np.ndarray:
    """Packed vectors as rows."""
    return np.frombuffer(b"".join(column), dtype=code).reshape(len(column), width).astype(np.int64)


def _code(most: int) -> str:
    """The narrowest integers that hold values up to most."""
    return next(f"<i{n}" for n in (1, 2, 4, 8) if n == 8 or most < 1 << (8 * n - 1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can be rounded, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _split(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along each pivot's direction, and each direction's length of the pivot (0 for a pivot at the origin)."""
    length = np.sqrt((pivots**2).sum(1))
    return x @ (pivots / np.maximum(length, 1e-300)[:, None]).T, length


def _cells(rows: DataFrame, pivots: np.ndarray, code: str) -> DataFrame:
    """rows with vec (ints, packed), cell, dist (to the pivot), norm, along and across (the pivot)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", vec binary, cell int, dist double, norm double, along double, across double"
    width, centre = pivots.shape[1], pivots.astype(np.float64)
    half = (centre**2).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = _matrix(pdf["ints"], width)
            x = whole.astype(np.float64)
            square = (x**2).sum(1)
            cell = (half - 2 * (x @ centre.T)).argmin(1).astype(np.int32)
            dist = np.sqrt(((x - centre[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            along = _split(x, centre)[0][np.arange(len(x)), cell] if len(x) else np.zeros(0)
            yield pdf.assign(vec=[v.tobytes() for v in whole.astype(code)], cell=cell, dist=dist, norm=np.sqrt(square), along=along, across=np.sqrt(np.maximum(square - along**2, 0)))

    return rows.mapInPandas(run, schema)


def _bounds(q: np.ndarray, pivots: np.ndarray, cells: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """What each query can score at most with a member of each cell. stats: radius, norm, least and most along, most across.

    With x = p + d, q.x <= q.p + |q| |d|; with both split along the pivot and across it, q.x <= q1 x1 + |q2| |x2|.
    """
    p = pivots[cells].astype(np.float64)
    size = np.sqrt((q**2).sum(1))[:, None]
    along, _ = _split(q, p)
    radius, _, low, high, across = stats.T
    ball = q @ p.T + size * radius
    slab = np.maximum(along * low, along * high) + np.sqrt(np.maximum(size**2 - along**2, 0)) * across
    # Room for rounding, which is relative to the sizes that are added up.
    return np.minimum(ball, slab) + 1e-6 * (1 + size * (1 + stats[:, 1]))


def _thresholds(q: np.ndarray, sample: np.ndarray, keep: int) -> np.ndarray:
    """A score that `keep` different vectors of the sample reach at least, for each query."""
    if len(sample) < keep:
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ sample.T
        out[at : at + 256] = np.partition(scores, len(sample) - keep, axis=1)[:, len(sample) - keep]
    return out - 1e-6 * (1 + np.abs(out))


def _units(pivots: np.ndarray, counts: dict[int, int], block_rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first block, blocks) of each cell, and the number of blocks. Small cells whose pivots are near share a block."""
    left, order = sorted(counts), []
    while left:
        f = pivots[left].astype(np.float64)
        near = ((f - pivots[order[-1]]) ** 2).sum(1).argmin() if order else 0
        order.append(left.pop(int(near)))
    of, block, held = {}, 0, 0
    for c in order:
        if held and held + counts[c] > block_rows:
            block, held = block + 1, 0
        many = max(1, -(-counts[c] // block_rows))
        of[c] = (block, many)
        block, held = (block + many, 0) if many > 1 else (block, held + counts[c])
    return of, block + (held > 0)


def routes(unlike: DataFrame, sample: np.ndarray, centres: np.ndarray, cells: np.ndarray, stats: np.ndarray, keep: int, code: str) -> DataFrame:
    """Query vectors (vec) with their threshold (low) and the numbers of the cells that may hold a partner (needs)."""
    width = centres.shape[1]
    sent = unlike.sparkSession.sparkContext.broadcast(sample.astype(code))  # bounded by the sample's size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value.astype(np.float64)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                pdf = whole.iloc[at : at + 2000]
                ints = _matrix(pdf["ints"], width)
                q = ints.astype(np.float64)
                low = _thresholds(q, known, keep)
                reach = _bounds(q, centres, cells, stats) >= low[:, None]
                yield pd.DataFrame({"vec": [v.tobytes() for v in ints.astype(code)], "low": low, "needs": [cells[r].tolist() for r in reach]})

    return unlike.select("ints").mapInPandas(run, "vec binary, low double, needs array<int>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 256, chunk: int = 2000, sample: int = 20_000, block_rows: int | None = None, seed: int = 7) -> DataFrame:
    """Each query's k partners with the highest inner product: query_id, rank, vec_id, score.

    vectors, queries: (vec_id, ints), queries being some of vectors. A query is not its own partner; ties go to the
    smaller id. Fewer partners than k give fewer rows. Missing components count as 0 where lengths differ; empty vectors
    score 0; rows that repeat an id count once; no queries or vectors give no rows. sample bounds the vectors from which
    pivots and thresholds are drawn; pivots, chunk and block_rows bound the cells, the queries and the vectors that one
    task holds (block_rows by itself: a 64th of all, from 2,000 to 20,000). They change the cost, never the result.
    """
    spark = vectors.sparkSession
    stash = Scratch(spark)
    width, most = vectors.agg(F.max(F.size("ints")), F.max(F.greatest(F.array_max("ints"), -F.array_min("ints")))).first()
    width, code = width or 1, _code(most or 0)
    keep = k + 1
    # The k+1 smallest ids of each vector: one of them may be the query itself.
    first = Window.partitionBy("ints").orderBy("vec_id")
    few = (
        vectors.dropDuplicates(["vec_id", "ints"])
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= keep)
        .groupBy("ints")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    distinct = stash(few, "knn-vectors")
    total = distinct.count()
    asked = stash(queries.dropDuplicates(["vec_id", "ints"]), "knn-queries")
    if not total or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Pivots: from a hash sample of bounded size, spread out by farthest-point steps.
    share = min(1.0, sample / total)
    drawn = distinct.filter(F.pmod(F.xxhash64("ints", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("ints").collect()
    x = _matrix(sorted(r["ints"] for r in drawn), width)
    centres = _spread(x, min(pivots, len(x))) if len(x) else np.zeros((1, width), dtype=np.int64)

    data = stash(_cells(distinct, centres, code).drop("ints"), "knn-cells")
    stash.drop(distinct)
    sums = data.groupBy("cell").agg(F.max("dist"), F.max("norm"), F.min("along"), F.max("along"), F.max("across"), F.count(F.lit(1))).collect()
    sums.sort()
    cells = np.array([r[0] for r in sums], dtype=np.int32)
    stats = np.array([r[1:6] for r in sums], dtype=np.float64)
    block_rows = block_rows or max(2000, min(20_000, total // 64))
    units, _ = _units(centres, {r[0]: r[6] for r in sums}, block_rows)
    at = F.create_map(*[F.lit(v) for c, (u, _) in sorted(units.items()) for v in (c, u)])
    many = F.create_map(*[F.lit(v) for c, (_, n) in sorted(units.items()) for v in (c, n)])

    unlike = asked.select("ints").distinct()
    routed = stash(routes(unlike, x, centres, cells, stats, keep, code), "knn-routes")
    chunks = -(-routed.count() // chunk)
    each = F.array_distinct(F.flatten(F.transform("needs", lambda c: F.sequence(at[c], at[c] + many[c] - 1))))
    own = routed.select("vec", "low", F.explode(each).alias("unit"), F.pmod(F.xxhash64("vec"), F.lit(chunks)).cast("int").alias("chunk"))
    waiting = stash(own.select("unit", "chunk").distinct(), "knn-waiting")
    unit = at[F.col("cell")] + F.pmod(F.xxhash64("vec"), many[F.col("cell")]).cast("int")
    sent = data.select(unit.alias("unit"), "cell", "vec", "ids").join(waiting, "unit")

    def solve(key_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not len(left) or not len(right):
            return pd.DataFrame(rows, columns=["vec", "vec_ids", "scores"])
        q, low = _packed(left["vec"], width, code), left["low"].to_numpy()
        right = right.sort_values("cell", kind="stable")
        of = right["cell"].to_numpy()
        ids = [np.asarray(i, dtype=np.int64) for i in right["ids"]]
        counts = np.array([len(i) for i in ids], dtype=np.int64)
        v = _packed(right["vec"], width, code)
        here = np.unique(of)
        place = np.searchsorted(cells, here)
        edges = np.append(np.searchsorted(of, here), len(of))
        for start in range(0, len(q), 64):
            part = q[start : start + 64]
            reach = _bounds(part.astype(np.float64), centres, here, stats[place]) >= low[start : start + 64, None]
            # Cells that no query of the slice needs are left out.
            cols = np.concatenate([np.arange(edges[j], edges[j + 1]) for j in np.flatnonzero(reach.any(0))] or [np.zeros(0, dtype=np.int64)])
            if not len(cols):
                continue
            scores = _product(part, v[cols])
            for i, s in enumerate(scores):
                # Vectors alone, each standing for at least one id: those below the (k+1)-th best score cannot matter.
                least = np.partition(s, len(s) - keep)[len(s) - keep] if len(s) > keep else -np.inf
                pool = np.flatnonzero(s >= max(least, low[start + i]))
                if not len(pool):
                    continue
                got = np.repeat(s[pool], counts[cols[pool]])
                who = np.concatenate([ids[j] for j in cols[pool]])
                best = np.lexsort((who, -got))[:keep]
                rows.append((left["vec"].iloc[start + i], who[best].tolist(), got[best].tolist()))
        return pd.DataFrame(rows, columns=["vec", "vec_ids", "scores"])

    solved = own.groupBy("unit", "chunk").cogroup(sent.groupBy("unit", "chunk")).applyInPandas(solve, "vec binary, vec_ids array<bigint>, scores array<bigint>")
    one = solved.select("vec", F.explode(F.arrays_zip("vec_ids", "scores")).alias("_p"))
    best = Window.partitionBy("vec").orderBy(F.col("_p.scores").desc(), "_p.vec_ids")
    ranked = one.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep)
    lists = ranked.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("_n", "_p.vec_ids", "_p.scores"))).alias("_best"))
    found = stash(lists, "knn-found")
    named = stash(_packed_again(asked, width, code), "knn-named")
    zipped = F.filter("_best", lambda p: p["vec_ids"] != F.col("vec_id"))
    ranks = named.join(found, "vec").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(zipped, 1, k)).alias("_at", "_p"))
    out = stash(ranks.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_p.vec_ids").alias("vec_id"), F.col("_p.scores").alias("score")), "knn-ranks")
    stash.close(out)
    return out


def _packed_again(asked: DataFrame, width: int, code: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [v.tobytes() for v in _matrix(pdf["ints"], width).astype(code)]})

    return asked.select("vec_id", "ints").mapInPandas(run, "vec_id long, vec binary")


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    f = x.astype(np.float64)
    picked = [0]
    near = ((f - f[0]) ** 2).sum(1)
    while len(picked) < n:
        j = int(near.argmax())
        if near[j] == 0:
            break
        picked.append(j)
        near = np.minimum(near, ((f - f[j]) ** 2).sum(1))
    return x[picked]


def op1(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.ints AS DOUBLE[]), CAST(d.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
