"""Firing and failure rules as aggregates over an application's inputs.

Inputs are rows (app, input, status, ts) with status completed, error or skipped once the
input is done and anything else before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DONE = ("completed", "error", "skipped")


def barrier(inputs: DataFrame, app: str = "app", status: str = "status") -> DataFrame:
    """(app, n_inputs, n_done, fired): fired once all inputs are done."""
    done = F.col(status).isin(*DONE).cast("long")
    g = inputs.groupBy(app).agg(F.count("*").alias("n_inputs"), F.coalesce(F.sum(done), F.lit(0)).alias("n_done"))
    return g.withColumn("fired", F.col("n_inputs") == F.col("n_done"))


def effective(inputs: DataFrame, n_eff: int, order: list[str], app: str = "app", status: str = "status") -> DataFrame:
    """The first n_eff done inputs of each application in arrival order (-1: all)."""
    if n_eff == 0 or n_eff < -1:
        raise ValueError("the number of effective inputs is -1 or at least 1")
    done = inputs.where(F.col(status).isin(*DONE))
    if n_eff == -1:
        return done
    return done.withColumn("_rn", F.row_number().over(Window.partitionBy(app).orderBy(*order))).where(F.col("_rn") <= n_eff).drop("_rn")


def fire(inputs: DataFrame, n_eff: int, threshold: int, order: list[str], app: str = "app", status: str = "status", block_skip: bool = False) -> DataFrame:
    """(app, n_done, n_error, n_skipped, outcome) of the first n_eff done inputs.

    outcome: waiting below n_eff; error where floor(100 * errors / n_eff) exceeds the
    threshold; skipped where any (block_skip: every) input is skipped; else run.
    """
    if not 0 <= threshold <= 100:
        raise ValueError("the threshold is a percentage")
    totals = inputs.groupBy(app).agg(F.count("*").alias("n_inputs"))
    used = effective(inputs, n_eff, order, app, status).groupBy(app).agg(
        F.count("*").alias("n_done"), F.sum((F.col(status) == "error").cast("long")).alias("n_error"), F.sum((F.col(status) == "skipped").cast("long")).alias("n_skipped"),
    )
    need = F.col("n_inputs") if n_eff == -1 else F.lit(n_eff)
    some = F.col("n_skipped") == F.col("n_done") if block_skip else F.col("n_skipped") > 0
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_done", "n_error", "n_skipped")]
    outcome = (
        F.when(F.col("n_done") < need, "waiting").when(F.floor(100 * F.col("n_error") / need) > threshold, "error").when(some, "skipped").otherwise("run")
    )
    return totals.join(used, app, "left").select(app, "n_inputs", *zero).withColumn("outcome", outcome).drop("n_inputs")


def data_status(producers: DataFrame, data: str = "data", status: str = "status") -> DataFrame:
    """A data node is in error if any producer is, completed when all finished."""
    g = producers.groupBy(data).agg(F.count("*").alias("n"), F.sum((F.col(status) == "error").cast("long")).alias("err"), F.sum((F.col(status) == "finished").cast("long")).alias("fin"))
    return g.select(data, F.when(F.col("err") > 0, "error").when(F.col("fin") == F.col("n"), "completed").otherwise("waiting").alias("status"))


def sized_completion(chunks: DataFrame, expected: int, data: str = "data", seq: str = "seq", size: str = "size") -> DataFrame:
    """The first chunk by which `expected` bytes have been written."""
    total = F.sum(size).over(Window.partitionBy(data).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("written", total).where(F.col("written") >= expected).groupBy(data).agg(F.min(seq).alias("completed_at"))


def latest_status(events: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each id, ties broken by the later order columns."""
    return events.groupBy(by).agg(F.max_by(status, F.struct(*order)).alias(status))


def branch(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows of the true and of the false port; a null condition is false, so the two
    partition the input."""
    c = F.coalesce(condition, F.lit(False))
    return df.where(c), df.where(~c)


def propagate(nodes: DataFrame, edges: DataFrame, initial: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(oid, status) of every node under the rules above, level by level.

    nodes(oid, kind in app/data, threshold), edges(src, dst), initial(oid, status) for roots
    and for applications that fail by themselves.  A node without initial status follows
    its inputs: applications by error threshold and skip, data by their producers.
    """
    from ..shared import cut

    known = cut(nodes.join(initial, "oid", "left").select("oid", "kind", "threshold", "status"), "status")
    todo = known.where("status is null").count()
    for _ in range(rounds):
        if not todo:
            break
        ins = edges.join(known.select(F.col("oid").alias("src"), F.col("status").alias("s")), "src", "left").groupBy(F.col("dst").alias("oid")).agg(
            F.count("*").alias("n"), F.count("s").alias("done"), F.sum((F.col("s") == "error").cast("long")).alias("err"), F.sum((F.col("s") == "skipped").cast("long")).alias("skip"),
        )
        app = F.when(F.floor(100 * F.col("err") / F.col("n")) > F.coalesce("threshold", F.lit(0)), "error").when(F.col("skip") > 0, "skipped").otherwise("completed")
        data = F.when(F.col("err") > 0, "error").when(F.col("skip") == F.col("n"), "skipped").otherwise("completed")
        new = F.when(F.col("n") == F.col("done"), F.when(F.col("kind") == "app", app).otherwise(data))
        known = cut(known.join(ins, "oid", "left").select("oid", "kind", "threshold", F.coalesce("status", new).alias("status")), "status")
        left = known.where("status is null").count()
        if left == todo:
            break
        todo = left
    else:
        if todo:
            raise ValueError(f"deeper than {rounds} levels")
    return known.select("oid", "status")
