"""Record lifecycle, temperature tiers, placement and compaction as expressions over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: spans in seconds, ranks of actions
HOT_S, WARM_S, REACCESS_S, GRACE_DAYS = 300, 604_800, 600, 30
ACTIONS = ("Keep", "NeedsManualRefresh", "Archive", "SoftDelete")
TIERS = ("Hot", "Warm", "Cold", "Frozen")


def micros(at: Column) -> Column:
    """Microseconds of a time with or without zone."""
    return F.unix_micros(at.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / 1e6


def with_policies(records: DataFrame, policies: DataFrame, key: str = "collection") -> DataFrame:
    """Each record with its collection's ttl_count and immortal; immortal where there is no policy."""
    joined = records.join(policies.select(key, F.col("ttl_count").alias("_n"), F.col("immortal").alias("_i")), key, "left")
    return joined.withColumn("immortal", F.coalesce("_i", F.lit(True))).withColumn("ttl_count", F.coalesce("_n", F.lit(0))).drop("_n", "_i")


def with_initial_ttl(records: DataFrame, policies: DataFrame, now: Column, key: str = "collection") -> DataFrame:
    """New records with the counter of their collection's policy and the time as its last refresh."""
    return with_policies(records, policies, key).withColumn("last_refresh", now)


def decremented(count: Column, immortal: Column) -> Column:
    """After a replication: one less, not under zero; immortal records keep it."""
    return F.when(immortal, count).otherwise(F.greatest(count - 1, F.lit(0)))


def refreshed(df: DataFrame, hit: Column, count: str, initial: int, stamp: str, now: Column) -> DataFrame:
    """Counters and stamps of the matching records anew."""
    good = F.coalesce(hit, F.lit(False))
    return df.withColumns({count: F.when(good, F.lit(initial)).otherwise(F.col(count)), stamp: F.when(good, now).otherwise(F.col(stamp))})


def action(count: Column, immortal: Column, old_enough: Column, refresh: Column, expire: Column) -> Column:
    """What is due: the stronger of what the refresh policy and the expiry policy ask for, once the counter is spent."""
    rank = F.greatest(F.when(refresh == "Manual", 1).otherwise(0), F.when(expire == "Delete", 3).when(expire == "Archive", 2).otherwise(0))
    return F.when((count > 0) | immortal | ~old_enough, ACTIONS[0]).otherwise(F.element_at(F.array(*map(F.lit, ACTIONS)), rank + 1))


def soft_deleted(records: DataFrame, key: str, deleted_at: Column, reason: Column, days: int = GRACE_DAYS) -> DataFrame:
    return records.select(F.col(key), deleted_at.alias("deleted_at"), (deleted_at + F.expr(f"INTERVAL {days} DAYS")).alias("purge_after"), reason.alias("reason"))


def sweep(pool: DataFrame, now: Column) -> DataFrame:
    """Records whose grace is over."""
    return pool.where(F.col("purge_after") <= now)


def temperature(count: Column, idle_s: Column, immortal: Column | None = None) -> Column:
    spent = (count == 0) if immortal is None else (count == 0) & ~immortal
    return F.when(spent, "Frozen").when(idle_s <= HOT_S, "Hot").when(idle_s <= WARM_S, "Warm").otherwise("Cold")


def accessed_once_more(stats: DataFrame, accessed: DataFrame, now_ns: int) -> DataFrame:
    """Access counters after an access to each of the accessed blocks: the burst goes on within REACCESS_S, else it begins anew."""
    hit = accessed.select("block_id").distinct().withColumn("_hit", F.lit(True))
    soon = (F.lit(now_ns) - F.col("last_access_ns")) <= REACCESS_S * 1_000_000_000
    joined = stats.join(hit, "block_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    recent = F.when(~F.col("_hit"), F.col("access_count_recent")).when(soon, F.col("access_count_recent") + 1).otherwise(1)
    total = F.col("access_count_total") + F.col("_hit").cast("long")
    last = F.when(F.col("_hit"), now_ns).otherwise(F.col("last_access_ns"))
    return joined.select("block_id", last.alias("last_access_ns"), recent.alias("access_count_recent"), total.alias("access_count_total"))


def transition(old: Column, due: Column, hit: Column, recent: Column) -> Column:
    """The next tier: frozen if that is due; else an access lifts cold and frozen to warm, and warm to hot in a burst; else what is due."""
    lifted = F.when(old.isin("Cold", "Frozen"), "Warm").when((old == "Warm") & (recent >= 2), "Hot").otherwise(due)
    return F.when(due == "Frozen", due).when(hit, lifted).otherwise(due)


def rebalance(blocks: DataFrame, stats: DataFrame, ttl: DataFrame, accessed: DataFrame, now_ns: int) -> DataFrame:
    """(block_id, move, tier) for each block (block_id, temperature, last_access_ns).

    stats: last_access_ns and access_count_recent by block_id, else the block's own
    time and no access; ttl: count and immortal, else immortal; accessed: block_ids.
    """
    joined = blocks.join(stats.select("block_id", F.col("last_access_ns").alias("_last"), F.col("access_count_recent").alias("_recent")), "block_id", "left")
    joined = joined.join(ttl.select("block_id", F.col("count").alias("_n"), F.col("immortal").alias("_i")), "block_id", "left")
    joined = joined.join(accessed.select("block_id").distinct().withColumn("_hit", F.lit(True)), "block_id", "left")
    idle = F.greatest(F.lit(now_ns) - F.coalesce("_last", "last_access_ns", F.lit(0)), F.lit(0)) / 1e9
    due = temperature(F.coalesce("_n", F.lit(1)), idle, F.coalesce("_i", F.lit(True)))
    old = F.col("temperature")
    tier = transition(old, due, F.coalesce("_hit", F.lit(False)), F.coalesce("_recent", F.lit(0)))
    place = lambda c: F.array_position(F.array(*map(F.lit, TIERS)), c)
    move = F.when(tier == old, "Noop").when(tier == "Frozen", "Freeze").when(tier == "Cold", "Compress").when(place(tier) < place(old), "Promote").otherwise("Demote")
    return joined.select("block_id", move.alias("move"), tier.alias("tier"))


def colocation_members(records: DataFrame, key: Column, id_field: str) -> DataFrame:
    """(semantic_key, member): what is placed together, a row for each record, so that no key needs one large row."""
    return records.select(key.alias("semantic_key"), F.col(id_field).alias("member"))


def colocation(records: DataFrame, key: Column, id_field: str) -> DataFrame:
    """(semantic_key, members, first_member)."""
    return records.groupBy(key.alias("semantic_key")).agg(F.count("*").alias("members"), F.min(id_field).alias("first_member"))


def compaction_plan(segments: DataFrame) -> DataFrame:
    """Cold and frozen segments, if there are two or more."""
    picked = segments.where(F.col("temperature").isin("Cold", "Frozen")).select("segment_id")
    return picked.where(picked.agg(F.count("*")).scalar() >= 2)


def compact(parts: list[DataFrame], clustering: str, key: str) -> DataFrame:
    """All records by range of the clustering key, sorted; records without one first."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.repartitionByRange(F.asc_nulls_first(clustering), F.asc(key)).sortWithinPartitions(F.asc_nulls_first(clustering), F.asc(key))


def access_bursts(events: DataFrame, user: str, stamp: str, key: str, gap_s: int = REACCESS_S) -> DataFrame:
    """(user, key, burst): 1 where the user's access before was no more than gap_s ago."""
    before = F.lag(stamp).over(Window.partitionBy(user).orderBy(stamp, key))
    gap = micros(F.col(stamp)) - micros(before)
    return events.select(user, key, F.when(gap <= gap_s * 1_000_000, 1).otherwise(0).alias("burst"))


def positions(sorted_rows: DataFrame) -> DataFrame:
    """pos from 1 for rows in range-partitioned order, by counts of the partitions before; no single sort of all rows."""
    laid = sorted_rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row for each partition
    return laid.join(F.broadcast(ahead), "_p").withColumn("pos", (F.col("_ahead") + F.col("_i") + 1).cast("long")).drop("_p", "_i", "_ahead")
