"""Symbol resolution as keyed joins.

Every entity registers under several keys; of the entities that share a key the heaviest wins, then the first by (path,
ordinal). A reference tries candidate keys in order. Suffix rules become equi-joins: both sides are keyed by every dotted
suffix instead of compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_symbols(symbols: DataFrame) -> DataFrame:
    """symbols: (key, id, weight, ord). (key, id) of each key's winner: one aggregate, no sort."""
    return symbols.groupBy("key").agg(F.min_by("id", F.struct((-F.col("weight")).alias("w"), "ord")).alias("id"))


def suffix_keys(name: Column) -> Column:
    """Every dotted suffix of a name: a.b.c, b.c, c."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references: (ref, candidates), keys in order of preference. (ref, id) of the first candidate that is known; null
    if none is. References that share a candidate meet its one winner, so no key multiplies rows."""
    tried = references.select("ref", F.posexplode_outer("candidates").alias("_at", "key"))
    hit = tried.join(best_symbols(symbols), "key", "left")
    return hit.groupBy("ref").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("_at"))).alias("id"))


def with_suffixes(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, id) for references (ref, name): the exact name; else the first symbol that ends in .name, or of which the
    name is a longer form. ord settles ties."""
    exact = best_symbols(symbols)
    longer = symbols.select(F.explode(F.slice(suffix_keys(F.col("key")), 2, 1 << 20)).alias("key"), "id", "ord").groupBy("key").agg(F.min_by("id", "ord").alias("longer"))
    parts = references.select("ref", "name", F.posexplode(suffix_keys(F.col("name"))).alias("_at", "key"))
    shorter = parts.filter("_at > 0").join(exact.withColumnRenamed("id", "shorter"), "key").groupBy("ref").agg(F.min_by("shorter", "_at").alias("shorter"))
    out = references.join(exact.select(F.col("key").alias("name"), "id"), "name", "left").join(longer.withColumnRenamed("key", "name"), "name", "left").join(shorter, "ref", "left")
    return out.select("ref", F.coalesce("id", "longer", "shorter").alias("id"))
