"""Itemsets as sorted arrays of distinct strings: their algebra as column functions.

An item is the string "attribute=value", the name as item_name() writes it. Every function keeps results sorted and distinct, so
equal sets are equal arrays and can be join keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.names import column


def item_name(attribute: str) -> str:
    """An attribute's name as it stands in items: = and % are written %3D and %25, so that the first = ends it."""
    return attribute.replace("%", "%25").replace("=", "%3D")


def attribute_name(name: str) -> str:
    """The attribute that item_name() was given."""
    return name.replace("%3D", "=").replace("%25", "%")


def item(attribute: str, value: Column | None = None) -> Column:
    """The item of an attribute's value; null where the value is missing."""
    return F.concat(F.lit(f"{item_name(attribute)}="), column(attribute).cast("string") if value is None else value)


def item_attribute(x: Column) -> Column:
    """The attribute's name as it stands in the item."""
    return F.substring_index(x, "=", 1)


def item_value(x: Column) -> Column:
    return F.substring(x, F.char_length(item_attribute(x)) + 2, F.char_length(x))


def itemset(*items: Column) -> Column:
    """The set of those items that aren't null."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))


def empty_set() -> Column:
    return F.array().cast("array<string>")


def universe(*items: str) -> Column:
    return itemset(*[F.lit(x) for x in items])


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def complement(a: Column, all_items: Column) -> Column:
    return difference(all_items, a)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def count(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def with_item(a: Column, x: Column) -> Column:
    return union(a, F.array(x))


def without_item(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def has_item(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def first_item(a: Column) -> Column:
    """The smallest item, null of an empty set."""
    return F.array_min(a)


def same_set(a: Column, b: Column) -> Column:
    return a == b


def before(a: Column, b: Column) -> Column:
    """Order of sets for lists of them: by items, a prefix first."""
    return a < b


def proper_subsets(a: Column) -> Column:
    """All non-empty proper subsets of a small set, each sorted."""
    n = F.size(a)
    numbers = F.when(n > 1, F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda m: F.filter(a, lambda _, i: F.getbit(m, i) == 1))


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true for none."""
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
