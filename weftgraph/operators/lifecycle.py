"""Data lifecycle: expiry, garbage collection, loss, replication, tiers, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE_SECONDS = 10
TIERS = ("memory", "file")  # fastest first; the store added last is the slowest


def lifetime(specs: DataFrame, now: Column) -> DataFrame:
    """expiration_date, expire_after_use and persist from a specification's lifespan,
    expire_after_use, persist and its alias precious.  A lifespan and expire_after_use
    exclude each other: such rows fail."""
    persist = F.coalesce("persist", "precious", F.lit(False))
    clash = F.col("lifespan").isNotNull() & (F.col("lifespan") != -1) & F.coalesce("expire_after_use", F.lit(False))
    date = F.when(F.col("lifespan").isNotNull() & (F.col("lifespan") != -1), now.cast("double") + F.col("lifespan")).otherwise(F.lit(-1.0))
    return specs.withColumn("persist", persist).withColumn(
        "expiration_date", F.when(clash, F.raise_error(F.lit("lifespan and expire_after_use exclude each other")).cast("double")).otherwise(date),
    ).withColumn("expire_after_use", F.coalesce("expire_after_use", F.lit(False)) & ~F.col("persist"))


def expire_after_use(data: DataFrame, uses: DataFrame, key: str = "oid", finished: str = "finished") -> DataFrame:
    """Ids of completed, unpersisted data whose consumers all are done; data without
    consumers expire at once.  data(key, status, persist, expire_after_use, reading?),
    uses(key, finished)."""
    done = uses.groupBy(key).agg(F.bool_and(F.coalesce(finished, F.lit(False))).alias("all_done"))
    reading = F.coalesce("reading", F.lit(False)) if "reading" in data.columns else F.lit(False)
    ripe = data.where((F.col("status") == "completed") & ~F.col("persist") & F.col("expire_after_use") & ~reading)
    return ripe.join(done, key, "left").where(F.coalesce("all_done", F.lit(True))).select(key)


def expire_lifespan(data: DataFrame, now: Column, key: str = "oid") -> DataFrame:
    """Ids whose expiration date (-1: never) has passed."""
    return data.where((F.col("expiration_date") != -1) & (now > F.col("expiration_date"))).select(key)


def garbage(data: DataFrame) -> DataFrame:
    """What is expired becomes deleted."""
    return data.withColumn("status", F.when(F.col("status") == "expired", "deleted").otherwise(F.col("status")))


def replicas(instances: DataFrame, drops: DataFrame, oid: str = "oid") -> DataFrame:
    """(oid, n, action): lost without replicas, replicate with one, else none."""
    n = instances.groupBy(oid).agg(F.count("*").alias("n"))
    return drops.select(oid).join(n, oid, "left").select(oid, F.coalesce("n", F.lit(0)).alias("n")).withColumn("action", F.when(F.col("n") == 0, "lost").when(F.col("n") == 1, "replicate").otherwise("none"))


def replicate_on_completion(data: DataFrame, free: int) -> DataFrame:
    """The completed data to copy: persistent, no container, and of a size that the slowest
    store has room for; both copies become solid."""
    return data.where((F.col("status") == "completed") & F.col("persist") & ~F.coalesce("container", F.lit(False)) & (F.col("size") <= free)).withColumn("phase", F.lit("SOLID"))


def migrate(data: DataFrame, accesses: DataFrame, now: Column, idle: float = IDLE_SECONDS, key: str = "oid") -> DataFrame:
    """Data idle for over `idle` seconds, to be moved one tier down."""
    last = last_access(accesses, key)
    return data.join(last, key, "left").where(F.coalesce(now.cast("double") - F.col("last_access").cast("timestamp").cast("double") > idle, F.lit(True))).select(key)


def last_access(accesses: DataFrame, key: str = "oid", ts: str = "ts") -> DataFrame:
    """(key, last_access) of everything accessed; what never was has no row (-1 by name)."""
    return accesses.groupBy(key).agg(F.max(ts).alias("last_access"))


class Registry:
    """oid -> uids, phase and accesses, as three DataFrames."""

    def __init__(self, drops: DataFrame, instances: DataFrame, accesses: DataFrame):
        self.drops, self.instances, self.accesses = drops, instances, accesses

    def uids(self, oid: str) -> DataFrame:
        return self.instances.where(F.col("oid") == oid).select("uid")

    def phase(self, oid: str):
        row = self.drops.where(F.col("oid") == oid).select("phase").first()
        return row["phase"] if row else None

    def set_phase(self, oid: str, phase: int) -> Registry:
        return Registry(self.drops.withColumn("phase", F.when(F.col("oid") == oid, F.lit(phase)).otherwise(F.col("phase"))), self.instances, self.accesses)

    def last_access(self, oid: str) -> float:
        row = self.accesses.where(F.col("oid") == oid).agg(F.max("ts").cast("timestamp").cast("double").alias("t")).first()
        return -1 if row["t"] is None else row["t"]
