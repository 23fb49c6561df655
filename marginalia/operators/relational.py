"""Filters, joins, counts, pages and keyed rewrites over a versioned publishing corpus.

Every operator takes and returns DataFrames and leaves the plan to Catalyst: predicates reach the scan, existence tests are
semi-joins, and no operator acts before its result is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_LIMIT, MOST_ROWS = 20, 100


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters by column name. A value of None adds nothing; a list, tuple or set is a choice."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def contains_any(df: DataFrame, columns: Sequence[str], needle: str | None) -> DataFrame:
    """Rows of which one of the columns holds the string, whatever the case. No character is a wildcard; None or "" adds nothing."""
    if not needle:
        return df
    return df.filter(reduce(Column.__or__, (F.contains(F.lower(c), F.lower(F.lit(needle))) for c in columns)))


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = PAGE_LIMIT, total: str = "total") -> DataFrame:
    """A page in the given order, with the number of all rows. The limit is held to 1 to 100 and the page to 1 or more.

    The total is a scalar subquery with partial counts, not a window over all rows. A page beyond the end has no rows,
    and so shows no total.
    """
    limit, page = min(max(limit, 1), MOST_ROWS), max(page, 1)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit).withColumn(total, df.agg(F.count(F.lit(1))).scalar())


def having(df: DataFrame, related: DataFrame, on: Sequence[str] | Column) -> DataFrame:
    """Rows for which a related row exists. All conditions must hold for the same related row: put them in one filter of it."""
    return df.join(related, on, "left_semi")


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 if none."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that comes last in the order; an aggregation with partial maxima, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position", base: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + F.lit(base - 1))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows whose key isn't among the new ones, and the new rows. The new keys must be unique."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows, and the new rows whose key is not among them."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def delete_with_children(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and each table of children without the given keys."""
    gone = gone.select(key)
    return parents.join(gone, key, "left_anti"), {n: c.join(gone, key, "left_anti") for n, c in children.items()}


def replace_children(old: DataFrame, payload: DataFrame, key: str, items: str, position: str = "position", value: str = "value") -> DataFrame:
    """Children (key, position, value) after a payload of lists: null leaves a parent's children alone, [] clears them, others
    replace them, numbered from 1."""
    given = payload.filter(F.col(items).isNotNull())
    fresh = given.select(key, F.posexplode(items).alias("_p", value)).select(key, (F.col("_p") + 1).alias(position), value)
    return old.join(given.select(key), key, "left_anti").unionByName(fresh.select(old.columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def reference_counts(parents: DataFrame, key: str, **references: DataFrame) -> DataFrame:
    """Per parent the references from each table (each with the column ``key``), and their sum; 0 where none."""
    out = parents
    for name, rows in references.items():
        out = with_count(out, rows, key, name)
    return out.withColumn("total", reduce(Column.__add__, (F.col(n) for n in references)))


def violations(children: DataFrame, parents: DataFrame, unique: Sequence[str], foreign: str) -> DataFrame:
    """code, rows: how many rows break the uniqueness of the key, and how many have no parent."""
    repeated = children.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))
    orphans = children.join(parents, foreign, "left_anti").agg(F.count(F.lit(1)).alias("rows"))
    return repeated.select(F.lit("DUPLICATE").alias("code"), "rows").union(orphans.select(F.lit("NO_PARENT").alias("code"), "rows"))
