"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from limpid.session import stage

MOST_ROUNDS = 60
# small rows that one task writes, about, and how many tasks write at least
TASK_ROWS, FEWEST_TASKS = 200_000, 12


def _hang_on_least(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours, and each link's larger end, on the smallest node around.

    First over both directions, then over links to smaller nodes only; the
    smallest neighbour comes from an aggregate, never from a collected list. Each
    half deals its links by ``u`` once, and aggregate, join and the removal of
    repeats all keep to that. Links may leave it more than once.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    large = hung.repartition("u").distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    # a link to the least neighbour stays, one to another hangs that neighbour on the least
    return large.join(small, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def tasks_for(rows: int) -> int:
    """So many tasks write a table of ``rows`` small rows: small tables take few files, large ones as many as their rows need."""
    return max(FEWEST_TASKS, -(-rows // TASK_ROWS))


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, itself included.

    ``links`` holds pairs ``u``, ``v``. Rounds run until nothing changes, about
    the logarithm of the longest path; each is written to the shared folder, so
    a lost executor costs one round at most. The driver reads a count and a
    checksum per round. The links are written first by so many ``tasks``, later by
    as many as their number needs.
    """
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    state = stage(pairs.coalesce(tasks) if tasks else pairs, "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        state = stage(_hang_on_least(state).coalesce(tasks_for(now[0])), "links")
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
