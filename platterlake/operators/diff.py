"""Comparing catalogs: full outer joins, overlays and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key: later writes win, and a null order comes before all. Combined before the shuffle."""
    columns = rows.columns
    best = F.max_by(F.struct(*columns), F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order")))
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(best.alias("__row")).select("__row.*")


def compare(prior: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """keys and state (added, removed, modified or unchanged) of two relations, nulls equal to nulls.

    Of rows that repeat their keys the last counts, by the column `order`; without one, that of the greatest values.
    """

    def side(rows: DataFrame, tag: str) -> DataFrame:
        of = F.struct(*values)
        best = F.max(of) if order is None else F.max_by(of, F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order")))
        return rows.groupBy(*(F.col(k).alias(f"{tag}_{k}") for k in keys)).agg(best.alias(tag))

    a, b = side(prior, "a"), side(new, "b")
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("modified")
    return a.join(b, on, "full").select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys), state.alias("state"))


def gate(diff: DataFrame, keys: list[str]) -> DataFrame:
    """files_changed and is_unchanged of every group of a comparison."""
    changed = F.count_if(F.col("state") != "unchanged")
    return diff.groupBy(*keys).agg(changed.alias("files_changed"), (changed == 0).alias("is_unchanged"))


def partition_gate(prior: DataFrame, new: DataFrame, prior_system: DataFrame, new_system: DataFrame, part: list[str], keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """part, comparable, bootability_changed, files_changed and is_unchanged of every partition of two backups.

    Files are rows of (part, keys, values); systems of (part, system), a struct of what boots the partition or null. A side
    without files and without a system is a placeholder: nothing is comparable then, and nothing counts as unchanged.
    """
    states = compare(prior, new, [*part, *keys], values, order)
    files = states.groupBy(*part).agg(F.count_if(F.col("state") != "unchanged").alias("n"), F.count_if(F.col("state") != "added").alias("before"), F.count_if(F.col("state") != "removed").alias("after"))
    one = lambda rows, tag: rows.groupBy(*(F.col(p).alias(f"{tag}_{p}") for p in part)).agg(F.first("system", ignorenulls=True).alias(tag))
    a, b = one(prior_system, "a"), one(new_system, "b")
    both = a.join(b, [F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")) for p in part], "full").select(*(F.coalesce(f"a_{p}", f"b_{p}").alias(f"s_{p}") for p in part), "a", "b")
    joined = files.join(both, [F.col(p).eqNullSafe(F.col(f"s_{p}")) for p in part], "full")
    count = lambda c: F.coalesce(c, F.lit(0))
    comparable = ~((F.col("a").isNull() & (count("before") == 0)) | (F.col("b").isNull() & (count("after") == 0)))
    boot = comparable & ~F.col("a").eqNullSafe(F.col("b"))
    changed = F.when(comparable, count("n")).otherwise(0)
    return joined.select(*(F.coalesce(p, f"s_{p}").alias(p) for p in part), comparable.alias("comparable"), boot.alias("bootability_changed"), changed.alias("files_changed"), (comparable & ~boot & (changed == 0)).alias("is_unchanged"))


def drop_volatile(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files without those that a rule (name, attribute bits, folder) calls volatile; rules are a few rows."""
    hit = (F.upper("name") == F.col("rule_name")) & (F.col("attr").bitwiseAND(F.col("rule_bits")) == F.col("rule_bits")) & (F.upper("folder") == F.col("rule_folder"))
    return files.join(rules, hit, "left_anti")


def collisions(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source whose keys the target has."""
    return source.join(target.select(*keys), keys, "left_semi")


def resolve_conflicts(source: DataFrame, target: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """What a copy leaves in the target: `skip` keeps its rows, `force` the source's, `error` allows no shared key."""
    if policy == "skip":
        return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))
    if policy == "force":
        return source.unionByName(target.join(source.select(*keys), keys, "left_anti"))
    if policy != "error":
        raise ValueError(f"no such policy: {policy}")
    found = collisions(source, target, keys).limit(1).collect()
    if found:
        raise FileExistsError(f"already there: {found[0][keys[0]]}")
    return target.unionByName(source)


def overlay(blocks: DataFrame, journal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, bytes) after the journal (by, seq, block, bytes, good) is replayed up to its first bad transaction; by: columns
    that tell volumes apart."""
    keys = [*by, "block"]
    bad = journal.where(~F.col("good")).groupBy(*by).agg(F.min("seq").alias("stop"))
    # without volumes to tell apart this is one row
    bounded = journal.join(bad, list(by), "left") if by else journal.join(F.broadcast(bad), F.lit(True), "left")
    usable = bounded.where(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
    writes = last_of(usable, keys, "seq").select(*keys, F.col("bytes").alias("new"))
    return blocks.select(*keys, "bytes").join(writes, keys, "full").select(*keys, F.coalesce("new", "bytes").alias("bytes"))
