"""Sharding by histogram sort.

Rows are ordered by a uniform two-part key (62 bits of the text's hash, then 62 bits of the id's hash), so equal texts
lie side by side. The boundaries come from exact histograms: each round counts bytes and rows below candidate keys in
all partitions at once, and only the cells that hold a boundary are probed more finely. A boundary settles as soon as
it is within tolerance, or no finer key can move it. It falls inside a group of equal texts only if the group is larger than the tolerance. Then the
rows move once, to the part that their key names.

Each shard is cut into parts of near equal row counts, so that no task takes a whole shard; a row's slot is its part's
offset plus its place in the part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexgraph.llm.common import pick, stash, table, unused

BITS = 62
FIRST, NEXT = 12, 8
#: Work units that all shards are cut into: one for so many rows, between these bounds.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1_000_000, 128, 4096


@dataclass
class _Goal:
    """One boundary: so much weight (bytes or rows) is to lie below the key that is found."""

    measure: int
    weight: float
    slack: float
    level: int = 0
    prefix: int = 0
    bits: int = 0
    group: int = -1
    base: float = 0.0
    found: tuple[int, int] | None = None


def _settle(goal: _Goal, cells: list[tuple[int, tuple[int, int]]], width: int) -> None:
    """Walk the goal's cells; keep the nearest edge if near enough, else the cell to refine."""
    at, end = goal.base, (goal.prefix + 1) << width
    for cell, sums in cells:
        if at + sums[goal.measure] >= goal.weight:
            over, under = at + sums[goal.measure] - goal.weight, goal.weight - at
            if min(over, under) <= goal.slack or sums[1] == 1:
                edge = cell if under <= over else cell + 1
                goal.found = (goal.group, edge) if goal.level else (edge, 0)
            goal.prefix, goal.base = cell, at
            return
        at += sums[goal.measure]
        goal.prefix = cell
    goal.found = (goal.group, end) if goal.level else (end, 0)


def find_boundaries(keyed: DataFrame, goals: list[_Goal], first: int = FIRST) -> None:
    """Refine every goal to a key. keyed: _h, _g (keys of 62 bits), _size. What the driver gets is at most 2**first sums
    in the first round, and 256 for each goal that is still open in a later one."""
    while open_ := [g for g in goals if g.found is None]:
        for level, key in ((0, "_h"), (1, "_g")):
            mine = [g for g in open_ if g.level == level]
            for bits in sorted({g.bits for g in mine}):
                batch = [g for g in mine if g.bits == bits]
                step = min((first if not level else FIRST) if bits == 0 else NEXT, BITS - bits)
                shift = BITS - bits - step
                rows = keyed
                if level:
                    rows = rows.filter(F.col("_h").isin(sorted({g.group for g in batch})))
                if bits:
                    rows = rows.filter(F.shiftright(key, BITS - bits).isin(sorted({g.prefix for g in batch})))
                group = F.col("_h") if level else F.lit(-1).cast("long")
                sums = rows.groupBy(group.alias("_group"), F.shiftright(key, shift).alias("_cell")).agg(
                    F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
                )
                by: dict[tuple[int, int], list] = {}
                for r in sorted(sums.collect()):
                    by.setdefault((r["_group"], r["_cell"] >> step if bits else 0), []).append((r["_cell"], (r["_bytes"], r["_rows"])))
                for g in batch:
                    _settle(g, by.get((g.group, g.prefix), []), step)
                    if g.found is not None:
                        # The edge is a prefix of so many bits; as a key it is followed by zeros.
                        a, b = g.found
                        g.found = (a, b << shift) if level else (a << shift, 0)
                        continue
                    g.bits = bits + step
                    if g.bits == BITS:
                        if level:
                            g.found = (g.group, g.prefix)
                        else:
                            g.level, g.group, g.prefix, g.bits = 1, g.prefix, 0, 0


def _key_columns(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text.cast("binary")),
        "_h": F.shiftrightunsigned(F.xxhash64(text), 2), "_g": F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 2),
    }


@dataclass
class _Plan:
    """Where the shards and their parts begin, and the rows before each part in its shard."""

    cuts: list[tuple[int, int]]
    shard_of: list[int]
    offset: list[int]

    def part(self, h: Column, g: Column) -> Column:
        return pick(self.cuts, F.lit, lambda cut: (h < cut[0]) | ((h == cut[0]) & (g < cut[1])))

    def shard(self, part: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.shard_of]), part + 1)

    def slot(self, part: Column, order: list[Column]) -> Column:
        known = F.array(*[F.lit(x).cast("long") for x in self.offset])
        return F.element_at(known, part + 1) + F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1


def _planned(keyed: DataFrame, shards: int, tolerance: float) -> _Plan:
    total, rows = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    goals = [_Goal(0, total * i / shards, tolerance * total / shards) for i in range(1, shards)] if total else []
    parts = max(shards, min(rows // 1000, max(LEAST_PARTS, min(MOST_PARTS, rows // PART_ROWS))))
    finer = [_Goal(1, rows * i / parts, max(0.5, 0.25 * rows / parts)) for i in range(1, parts)] if rows else []
    find_boundaries(keyed, goals + finer, max(FIRST, (16 * parts - 1).bit_length()))
    of_shard = sorted(g.found for g in goals)
    cuts = sorted({g.found for g in goals + finer})
    plan = _Plan(cuts, [sum(s <= c for s in of_shard) for c in [(-1, -1), *cuts]], [])
    counts = {r["_part"]: r["n"] for r in keyed.groupBy(plan.part(F.col("_h"), F.col("_g")).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at: dict[int, int] = {}
    for part, shard in enumerate(plan.shard_of):
        plan.offset.append(at.get(shard, 0))
        at[shard] = plan.offset[-1] + counts.get(part, 0)
    return plan


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal docs into shards of near equal bytes (UTF-8 length plus 1 a row), sorted by text hash.

    Returns doc_id, size, text_crc32, shard, slot. tolerance: how far a boundary may lie from its goal, as a part of a
    shard's bytes. Defined results: a null text has size 1 and the checksum of no bytes; null ids and repeated rows take
    slots like any row; rows equal in text and id are told apart by the number that is stored with them, so that no part
    must hold them all; an empty table gives no rows. Other columns of docs are not read.
    """
    columns = _key_columns(id_col, text_col)
    # The id's hash in the upper 40 bits, the row's number in the others.
    own = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 42)
    columns["_g"] = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 24), 22).bitwiseOR(own)
    keyed = stash(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in columns.items()]), "shard-keys")
    plan = _planned(keyed, shards, tolerance)
    part = F.col("_part")
    dealt = keyed.withColumn("_part", plan.part(F.col("_h"), F.col("_g")))
    return dealt.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), plan.shard(part).alias("shard"), plan.slot(part, ["_h", "_g"]).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs, all columns, as one folder `shard_number=N` a shard, whose files hold the column slot_number too and
    are sorted by it. Names that docs has itself get a trailing underscore.

    Every row goes to the part that its own key names, in one exchange; nothing is joined, so null ids, repeated ids and
    repeated rows are written like any row; rows equal in text and id share a part. An empty table writes no shards.
    """
    keyed = stash(docs.select(*[c.alias(n) for n, c in _key_columns(id_col, text_col).items() if n != "_crc"]), "shard-keys")
    plan = _planned(keyed, shards, tolerance)
    h, g, part, shard, slot = (unused(docs, n) for n in ("__h", "__g", "__part", "shard_number", "slot_number"))
    keys = _key_columns(id_col, text_col)
    dealt = docs.withColumns({h: keys["_h"], g: keys["_g"]}).withColumn(part, plan.part(F.col(h), F.col(g)))
    moved = dealt.repartition(len(plan.shard_of), part)
    placed = moved.withColumns({shard: plan.shard(F.col(part)), slot: plan.slot(F.col(part), [h, g])}).sortWithinPartitions(shard, slot)
    placed.drop(h, g, part).write.partitionBy(shard).parquet(path)


def op7(spark, sf_dir: str) -> DataFrame:
    placed = histogram_sort(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
