"""Contracts as rows: proposed from profiles, signed by people, amended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid import schemas, vocabulary as V
from limpid.functions.text import fold


def _no_null() -> Column:
    return F.col("null_count") == 0


def _folded_top() -> Column:
    return F.transform("top", lambda e: fold(e["value"]))


def _clashing_forms(values: DataFrame) -> DataFrame:
    """Per column the forms that several spellings fold to, the hundred with most rows."""
    from limpid.operators.collisions import collision_clusters

    keys = ["table_name", "batch_id", "column_name"]
    order = Window.partitionBy(*keys).orderBy(F.desc("rows"), "form")
    head = collision_clusters(values, keys).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= V.ENUMERABLE_MAX)
    return head.groupBy(*keys).agg(F.sort_array(F.collect_list("form")).alias("_all_clashes"))


def propose(profile: DataFrame, version: int = 1, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clauses and warnings a whole-table profile supports, status ``proposed``.

    With ``values`` (all values, see ``category_values``) the forms of colliding
    spellings beyond the frequent ones count too.

    A closed list is proposed only where every value was seen and no two of
    them are spellings of one: a warning is overlooked, a missing clause is not.
    """
    role = F.col("role")
    p = profile.withColumn("_forms", _folded_top())
    # the frequent values are at most a hundred, so arrays stay small
    p = p.withColumn("_clashes", F.filter(
        F.array_distinct("_forms"),
        lambda f: F.size(F.filter(F.col("_forms"), lambda g: g == f)) > 1,
    ))
    if values is not None:
        p = p.join(_clashing_forms(values), ["table_name", "batch_id", "column_name"], "left").withColumn(
            "_clashes", F.coalesce("_all_clashes", F.col("_clashes"))
        ).drop("_all_clashes")
    clash = F.coalesce(F.size("_clashes") > 0, F.lit(False))
    complete = F.coalesce(F.col("coverage") >= 1.0, F.lit(False)) & F.col("top").isNotNull()
    none_b = F.lit(None).cast("boolean")
    none_d = F.lit(None).cast("double")
    none_v = F.lit(None).cast("array<string>")

    def clause(name: str, when: Column, flag=None, lo=None, hi=None, values=None) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("clause"),
                (F.lit(True) if flag else none_b).alias("bool_arg"),
                (lo if lo is not None else none_d).alias("lo"),
                (hi if hi is not None else none_d).alias("hi"),
                (values if values is not None else none_v).alias("values"),
            ),
        )

    unread = F.coalesce(F.col("numeric_rate") < 1.0, F.lit(False))
    clauses = F.array(
        # the role of a column is kept even where it earns no clause
        clause("role", F.lit(True)),
        clause("unique", role == "identifier", flag=True),
        clause("not_null", (role == "identifier") | ((role != "unknown") & _no_null()), flag=True),
        clause("no_semantic_collisions", role == "categorical", flag=True),
        clause(
            "accepted_values", (role == "categorical") & ~clash & complete,
            values=F.sort_array(F.transform("top", lambda e: e["value"])),
        ),
        clause(
            "between", (role == "numeric") & F.col("numeric_min").isNotNull(),
            lo=F.col("numeric_min"), hi=F.col("numeric_max"),
        ),
    )
    base = [
        "dataset", "table_name", F.lit(version).cast("int").alias("version"),
        F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("approved_by"),
        F.col("batch_id").alias("source_batch_id"), F.col("row_count").alias("source_row_count"),
        "column_name", "role",
    ]
    rows = p.select(
        *base, F.explode(F.filter(clauses, lambda c: c.isNotNull())).alias("c")
    ).select(*[c if isinstance(c, str) else c for c in (
        "dataset", "table_name", "version", "status", "approved_by", "source_batch_id",
        "source_row_count", "column_name", "role", "c.*")])

    def warn(kind: str, when: Column, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))

    copies = F.col("row_count") - F.col("distinct")
    percent = lambda share: F.concat(F.round(share * 100, 0).cast("int"), F.lit("%"))
    warnings = F.array(
        warn("duplicates_observed", (role == "identifier") & (copies > 0),
             F.concat(copies, F.lit(" duplicates among "), F.col("row_count"), F.lit(" rows"))),
        warn("semantic_collision", (role == "categorical") & clash,
             F.concat(F.size("_clashes"), F.lit(" forms with several spellings: "),
                      F.array_join(F.sort_array("_clashes"), " ; "))),
        warn("partial_evidence", (role == "categorical") & F.col("top").isNull(),
             F.lit("no value was measured")),
        warn("partial_evidence", (role == "categorical") & ~clash & ~complete & F.col("top").isNotNull(),
             F.coalesce(F.concat(F.lit("the values seen cover "), percent(F.col("coverage"))),
                        F.lit("unknown coverage"))),
        warn("unreadable_numbers", (role == "numeric") & unread,
             F.concat(percent(1 - F.col("numeric_rate")), F.lit(" of the values do not read as numbers"))),
        warn("no_data", role == "unknown", F.lit("the column is empty, nothing is proposed")),
    )
    warned = p.select(
        "dataset", "table_name", F.lit(version).cast("int").alias("version"), "column_name",
        F.explode(F.filter(warnings, lambda w: w.isNotNull())).alias("w"),
    ).select("dataset", "table_name", "version", "column_name", "w.*")
    return rows.select(*schemas.CONTRACT_CLAUSE.fieldNames()), warned


def listing(contracts: DataFrame) -> DataFrame:
    """Every version on record with its status."""
    return contracts.select("dataset", "table_name", "version", "status").distinct().orderBy(
        "dataset", "table_name", "version"
    )


def in_force(contracts: DataFrame) -> DataFrame:
    """Clauses of the latest approved version per table.

    A newer version that nobody signed has no authority.
    """
    latest = (
        contracts.where(F.col("status") == "approved")
        .groupBy("dataset", "table_name").agg(F.max("version").alias("version"))
    )
    return contracts.where(F.col("status") == "approved").join(
        latest, ["dataset", "table_name", "version"], "left_semi"
    )


def record(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Contracts after writing ``new``: proposals are replaced, signatures kept.

    Raises when a signed version would be overwritten.
    """
    keys = ["dataset", "table_name", "version"]
    signed = existing.where(F.col("status") == "approved").select(*keys).distinct()
    clash = new.select(*keys).distinct().join(signed, keys, "left_semi")
    if not clash.isEmpty():
        raise ValueError("an approved contract version is never overwritten; amend it instead")
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def approve(
    contracts: DataFrame, warnings: DataFrame, dataset: str, table_name: str, by: str,
    accept_warnings: bool = False,
) -> DataFrame:
    """Sign the latest version of a table; unread warnings stop it."""
    if not (by or "").strip():
        raise ValueError("a contract needs the name of who signs it")
    mine = (F.col("dataset") == dataset) & (F.col("table_name") == table_name)
    latest = contracts.where(mine).agg(F.max("version")).first()[0]
    if latest is None:
        raise ValueError(f"no contract for {table_name}")
    this = mine & (F.col("version") == latest)
    if not contracts.where(this & (F.col("status") == "approved")).isEmpty():
        raise ValueError("this version is signed already")
    if not accept_warnings and not warnings.where(this).isEmpty():
        raise ValueError("read the warnings and accept them explicitly")
    return contracts.withColumn("status", F.when(this, "approved").otherwise(F.col("status"))).withColumn(
        "approved_by", F.when(this, F.lit(by)).otherwise(F.col("approved_by"))
    )


def loosened(clauses: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Before and after of every clause the anomalies would loosen.

    Flags are dropped, bounds widened, lists extended; nothing else moves.
    """
    hits = anomalies.select("table_name", F.upper("column_name").alias("_column"), "type",
                            "observed_values", "details").where(F.col("_column").isNotNull())
    number = lambda k: F.try_element_at("details", F.lit(k)).try_cast("double")
    moved = hits.groupBy("table_name", "_column", "type").agg(
        F.min(number("low")).alias("_low"), F.max(number("high")).alias("_high"),
        # intruders are at most a hundred per anomaly
        F.array_distinct(F.flatten(F.collect_set("observed_values"))).alias("_seen"),
    )
    clause_of = F.create_map(*[F.lit(x) for kv in {
        "nulls_interdits": "not_null", "doublons": "unique", "hors_bornes": "between",
        "valeur_non_admise": "accepted_values", "collision_semantique": "no_semantic_collisions",
    }.items() for x in kv])
    moved = moved.withColumn("clause", F.try_element_at(clause_of, F.col("type"))).where(
        F.col("clause").isNotNull()
    )
    j = clauses.withColumn("_column", F.upper("column_name")).join(
        moved, ["table_name", "_column", "clause"]
    )
    added = F.array_sort(F.array_except(F.col("_seen"), F.col("values")))
    between = F.col("clause") == "between"
    listed = F.col("clause") == "accepted_values"
    return (
        j.select(
            "dataset", "table_name", "version", "column_name", "clause",
            (~between & ~listed).alias("dropped"),
            F.col("lo").alias("lo_before"), F.col("hi").alias("hi_before"),
            F.when(between, F.least("lo", "_low")).alias("lo_after"),
            F.when(between, F.greatest("hi", "_high")).alias("hi_after"),
            F.col("values").alias("values_before"),
            F.when(listed, F.array_sort(F.array_union("values", "_seen"))).alias("values_after"),
            F.when(listed, added).alias("added"),
        )
        .where(~listed | (F.size("added") > 0))
    )


def amend(contracts: DataFrame, anomalies: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The next signed version of every contract the anomalies loosen.

    Returns its clauses and the differences; a table without differences gets
    no new version.
    """
    current = in_force(contracts)
    diff = loosened(current, anomalies)
    keys = ["dataset", "table_name", "version"]
    moved = current.join(diff.select(*keys).distinct(), keys, "left_semi")
    j = moved.join(
        diff.select(*keys, "column_name", "clause", "dropped", "lo_after", "hi_after", "values_after"),
        [*keys, "column_name", "clause"], "left",
    ).where(~F.coalesce("dropped", F.lit(False)))
    new = (
        j.withColumn("version", F.col("version") + 1)
        .withColumn("status", F.lit("approved"))
        .withColumn("approved_by", F.lit(by))
        .withColumn("lo", F.coalesce("lo_after", "lo"))
        .withColumn("hi", F.coalesce("hi_after", "hi"))
        .withColumn("values", F.coalesce("values_after", "values"))
        .select(*schemas.CONTRACT_CLAUSE.fieldNames())
    )
    return new, diff


def overview(contracts: DataFrame, warnings: DataFrame, registry: DataFrame) -> DataFrame:
    """Latest version per declared table in numbers, and the total of all.

    A declared table without a contract is shown as such.
    """
    newest = Window.partitionBy("dataset", "table_name")
    latest = contracts.withColumn("_v", F.max("version").over(newest)).where("version = _v")
    per_table = latest.groupBy("dataset", "table_name", "version").agg(
        F.count_distinct("column_name").alias("columns"),
        F.max("source_row_count").alias("reference_rows"),
        F.count_if(F.col("clause") == "unique").alias("keys"),
        F.count_if(F.col("clause").isin(*V.CLAUSES)).alias("clauses"),
        F.max("status").alias("status"),
    )
    warned = warnings.groupBy("dataset", "table_name", "version").agg(
        F.count(F.lit(1)).alias("warnings")
    )
    shown = (
        registry.select("dataset", "table_name", "layer")
        .join(per_table, ["dataset", "table_name"], "left")
        .join(warned, ["dataset", "table_name", "version"], "left")
        .withColumn("status", F.coalesce("status", F.lit("no contract")))
        .withColumn("warnings", F.when(F.col("version").isNotNull(), F.coalesce("warnings", F.lit(0))))
    )
    sums = [F.sum(c).alias(c) for c in ("columns", "reference_rows", "keys", "clauses", "warnings")]
    return shown.rollup("table_name").agg(
        *sums,
        F.when(F.grouping("table_name") == 1, F.lit("total")).otherwise(F.max("status")).alias("status"),
    )


def composition(contracts: DataFrame) -> DataFrame:
    """Columns per role and table, and the columns that identify a row."""
    columns = contracts.groupBy("dataset", "table_name", "version", "column_name").agg(
        F.max("role").alias("role"), F.max((F.col("clause") == "unique").cast("int")).alias("key")
    )
    grain = columns.groupBy("dataset", "table_name", "version").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("key") == 1, F.col("column_name")))), ", "
        ).alias("grain")
    )
    return columns.groupBy("dataset", "table_name", "version", "role").agg(
        F.count(F.lit(1)).alias("columns")
    ).join(grain, ["dataset", "table_name", "version"])


def clause_sentence() -> Column:
    """A clause row in words."""
    some = F.array_join(F.slice("values", 1, 5), ", ")
    more = F.when(
        F.size("values") > 5, F.concat(F.lit(" (+"), F.size("values") - 5, F.lit(")"))
    ).otherwise(F.lit(""))
    c = F.col("clause")
    return (
        F.when(c == "not_null", "must never be empty")
        .when(c == "unique", "every value must be unique")
        .when(c == "between", F.concat(F.lit("must stay between "), "lo", F.lit(" and "), "hi"))
        .when(c == "accepted_values",
              F.concat(F.lit("must be one of "), F.size("values"), F.lit(" values: "), some, more))
        .when(c == "no_semantic_collisions", "one value may not have two spellings")
    )
