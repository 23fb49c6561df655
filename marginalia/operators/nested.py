"""Nested documents: children as ordered lists inside their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest(parents: DataFrame, children: DataFrame, key: str, name: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Parents with a list of their children as structs, in order; [] where there are none."""
    packed = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*fields).alias("item"))
    lists = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["item"]).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def first_of(parents: DataFrame, children: DataFrame, key: str, name: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Parents with the first of their children as a struct, null where there is none."""
    first = children.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias(name))
    return parents.join(first, key, "left")


def listed(items: Column, separator: str = ",") -> Column:
    """A list of values as one string."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), separator)


def renumbered(items: Column, base: int = 0) -> Column:
    """A list with each item's place."""
    return F.transform(items, lambda x, i: F.struct((i + base).alias("position"), x.alias("item")))


def map_blocks(blocks: Column, names: dict[str, str]) -> Column:
    """A list of structs with fields renamed: {new: old}."""
    return F.transform(blocks, lambda b: F.struct(*(b[old].alias(new) for new, old in names.items())))
