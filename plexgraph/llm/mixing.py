"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed hash of 52 bits, of its id and text. A source whose target is f times its size takes floor(f) whole repeats of all
its documents and, for the rest, those documents whose hash lies below a threshold: as thresholds grow, the picks are
nested. To find the threshold, words are summed by source and hash bucket; only the bucket in which the budget runs out
is summed again more finely, until it holds one hash. Nothing is sorted by hash, and the main path is DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import WORD, stash, table, unused

HASH_BITS = 52
LEVELS = (13, 26, 39, 52)
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums of the rows before each, and how many those are (_place). Few rows go through one window;
    many are cut into ranges of the order first, whose totals alone meet."""
    totals = {"_place": F.lit(1).cast("long")} | sums
    if rows.count() <= BROADCAST_SOURCES:
        parts = rows.withColumn("_p", F.lit(0))
    else:
        parts = stash(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    ahead = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy("_p").agg(*[F.sum(v).alias(f"_of{n}") for n, v in totals.items()])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(f"_of{n}").over(earlier), F.lit(0)).alias(f"_of{n}") for n in totals])
    out = parts.withColumns({n: F.coalesce(F.sum(v).over(ahead), F.lit(0)) for n, v in totals.items()}).join(F.broadcast(ranges), F.col("_p") == F.col("_q"))
    return out.withColumns({n: F.col(n) + F.col(f"_of{n}") for n in totals}).drop("_p", "_q", *[f"_of{n}" for n in totals])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row for each source: source, source_size, target.

    Weights are dealt by code point order of the source's name, null last. The budget is the sum of all sizes; a target
    stops at most * size, and what is cut off is shared again by weight. Sources in order of cap a weight fill up first,
    so one running sum finds where capping ends.
    """
    by_source = stash(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    named = F.col("source").asc_nulls_last()
    dealt = _before(by_source, [named], {})
    given = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    caps = stash(dealt.select("source", "source_size", given.alias("_w"), (F.col("source_size") * most).alias("_cap")), "mix-caps")
    size, weight = (F.lit(v).cast("long") for v in caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first())
    fill = [(F.col("_cap") / F.col("_w")).asc(), named]
    filled = _before(caps, fill, {"_caps": F.col("_cap"), "_ws": F.col("_w")}).withColumn("_share", (size - F.col("_caps")).cast("double") / (weight - F.col("_ws")))
    filled = stash(filled, "mix-filled")
    level = filled.filter(F.col("_cap") > F.col("_share") * F.col("_w")).agg(F.min(F.struct("_place", "_share"))).first()[0]
    target = F.col("_cap").cast("double")
    if level:
        target = F.when(F.col("_place") >= level["_place"], F.lit(level["_share"]) * F.col("_w")).otherwise(target)
    return filled.select("source", "source_size", target.alias("target"))


def _refined(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, int]:
    """The bucket of _key in which each source's budget runs out, refined until it holds one row or has all bits; and its
    bits. rows: (source, size, _key); state: (source, _budget, _base, ...), _base being the words below all of rows."""
    given = state.columns
    state = state.withColumns({"_bucket": F.lit(0).cast("long"), "_sum": F.lit(0).cast("long"), "_n": F.lit(0).cast("long")})
    known = 0
    for bits in LEVELS:
        cells = rows.select("source", "size", F.shiftright("_key", HASH_BITS - bits).alias("_cell"))
        if known:
            parent = F.shiftright("_cell", bits - known)
            edge = state.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"))
            if state.count() <= BROADCAST_SOURCES:
                edge = F.broadcast(edge)
            cells = cells.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (parent == F.col("_b"))).drop("_s", "_b")
        # a row for each source and bucket: at most 8192 a source
        sums = cells.groupBy(F.col("source").alias("_s"), "_cell").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        joined = sums.join(state.select("source", "_budget", "_base"), F.col("_s").eqNullSafe(F.col("source")))
        upto = F.col("_base") + F.sum("_sum").over(Window.partitionBy("source").orderBy("_cell"))
        crossed = (
            joined.withColumn("_upto", upto)
            .filter(F.col("_upto") > F.col("_budget"))
            .groupBy("source")
            .agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_sum")).alias("_under"), "_sum", "_n")).alias("_edge"))
            .select(F.col("source").alias("_s"), "_edge")
        )
        state = stash(
            state.join(crossed, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                *[c for c in given if c != "_base"],
                F.coalesce(F.col("_edge._under"), F.col("_base")).alias("_base"), F.coalesce(F.col("_edge._cell"), F.lit(1 << bits)).alias("_bucket"),
                F.coalesce(F.col("_edge._sum"), F.lit(0)).alias("_sum"), F.coalesce(F.col("_edge._n"), F.lit(0)).alias("_n"),
            ),
            "mix-edges",
        )
        known = bits
        if state.filter("_n > 1").isEmpty():
            break
    return state, known


def _thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source: repeats of all its documents, and the place (_cut, _cut2) in the order of (_hash, _again) below
    which one more is taken. _again, a hash of the row itself, is looked at only where rows of one hash stand at the
    threshold, which are equal in id and text."""
    repeats = F.when(F.col("source_size") > 0, F.least(F.lit(MOST_REPEATS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    state = sources.select("source", "source_size", "target", repeats.alias("repeats"), (F.col("target") - repeats * F.col("source_size")).alias("_budget"), F.lit(0).cast("long").alias("_base"))
    state, known = _refined(sized.select("source", "size", F.col("_hash").alias("_key")), state)
    cut = F.when(F.col("_base") + F.col("_sum") / 2 <= F.col("_budget"), F.col("_bucket") + 1).otherwise(F.col("_bucket"))
    kept = ("source", "source_size", "target", "repeats")
    many = F.col("_n") > 1
    one = state.filter(~many).select(*kept, F.shiftleft(cut, HASH_BITS - known).alias("_cut"), F.lit(0).cast("long").alias("_cut2"))
    tied = state.filter(many)
    if tied.isEmpty():
        return one
    at = tied.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"))
    rows = sized.join(F.broadcast(at) if at.count() <= BROADCAST_SOURCES else at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_b")))
    split, known = _refined(rows.select("source", "size", F.col("_again").alias("_key")), tied.select(*kept, "_budget", "_base", F.col("_bucket").alias("_cut")))
    return one.unionByName(split.select(*kept, "_cut", F.shiftleft(cut, HASH_BITS - known).alias("_cut2")))


def _hashes(id_col: Column, text_col: Column) -> Column:
    """52 bits of the digest of a row's id and of its text's digest."""
    whole = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _words(text_col: Column) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def _extra(hash_: Column, again: Column, cut: str, cut2: str) -> Column:
    return ((hash_ < F.col(cut)) | ((hash_ == F.col(cut)) & (again < F.col(cut2)))).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many times the mix takes each row of docs.

    Returns doc_id, source, size (words), source_size, target, copies (0 to 3) and taken (words). A source takes words
    within half of one document's size of its target (the document at the threshold is taken if that brings the sum
    nearer). Defined results: a null or empty text has size 0; rows with a null source form one source, weighed last;
    null and shared ids are told apart by text, and of rows equal in both as many are taken as the budget allows; a
    source without words has target 0; an empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _words(F.col(text_col)).alias("size"), _hashes(F.col(id_col), F.col(text_col)).alias("_hash"))
    # The row's number is stored with it, so it is the same whenever it is read.
    sized = stash(sized.withColumn("_again", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)), "mix-sizes")
    sources = stash(source_targets(sized), "mix-targets")
    cuts = stash(_thresholds(sized, sources), "mix-cuts").withColumnRenamed("source", "_s")
    few = cuts.count() <= BROADCAST_SOURCES
    out = sized.join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("repeats") + _extra(F.col("_hash"), F.col("_again"), "_cut", "_cut2")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; its columns as they are. Null, shared and repeated ids,
    null sources and empty tables are treated as mix() states.

    The thresholds of the sources are joined to docs itself, so that texts are not moved. A row is told by its file and
    its place there; docs that are not read from files are stored first.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        docs = stash(docs, "mix-documents")
    row = F.shiftrightunsigned(F.xxhash64("_metadata.file_path", "_metadata.row_index"), 64 - HASH_BITS)
    hashed = _hashes(F.col("doc_id"), F.col("text"))
    sized = stash(docs.select("source", _words(F.col("text")).alias("size"), hashed.alias("_hash"), row.alias("_again")), "mix-sizes")
    sources = stash(source_targets(sized), "mix-targets")
    of, repeats, cut, cut2, again, own = (unused(docs, n) for n in ("__source", "__repeats", "__cut", "__cut2", "__again", "__row"))
    cuts = _thresholds(sized, sources).select(F.col("source").alias(of), F.col("repeats").alias(repeats), F.col("_cut").alias(cut), F.col("_cut2").alias(cut2))
    cuts = stash(cuts, "mix-cuts")
    few = cuts.count() <= BROADCAST_SOURCES
    copies = F.col(repeats) + _extra(hashed, F.col(own), cut, cut2)
    out = docs.withColumn(own, row).join(F.broadcast(cuts) if few else cuts, docs["source"].eqNullSafe(F.col(of)))
    each = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn(again, F.explode(each)).select(*[docs[c] for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS h
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM by_source
), filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS n,
         ((SELECT sum(source_size)::DOUBLE FROM by_source)
           - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(w) FROM weighed)
           - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM weighed
), level AS (
  SELECT n, share FROM filled WHERE cap > share * w ORDER BY n LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN f.n >= (SELECT n FROM level) THEN (SELECT share FROM level) * w ELSE cap END AS target
  FROM filled f
), repeats AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS k FROM targets
), placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (k + CASE WHEN d.before + d.size / 2.0 <= r.target - k * r.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed d
JOIN repeats r ON d.source IS NOT DISTINCT FROM r.source
"""
