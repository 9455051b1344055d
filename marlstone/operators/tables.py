"""Typed tables: which columns are categories and which are numbers, dictionaries, row masks and splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.names import column
from marlstone.sources.files import written

DISCRETE, CONTINUOUS = "d", "c"
_NUMBERS = (T.DoubleType, T.FloatType)
#: Hex digits of a row's hash that say to which part it goes.
_HASH_DIGITS = 12


def kind(df: DataFrame, name: str) -> str:
    """'d' or 'c': what the field's metadata says, else by type (text is discrete, floating point continuous)."""
    field = df.schema[name]
    known = (field.metadata or {}).get("kind")
    if known:
        return known
    if isinstance(field.dataType, T.StringType):
        return DISCRETE
    if isinstance(field.dataType, _NUMBERS):
        return CONTINUOUS
    raise ValueError(f"column {name} is neither text nor floating point; say which it is with typed()")


def typed(df: DataFrame, discrete: Iterable[str] = (), continuous: Iterable[str] = ()) -> DataFrame:
    """df with these columns only, as text or double, and their kinds as metadata."""
    d, c = list(discrete), list(continuous)
    return df.select(
        *[column(x).cast("string").alias(x, metadata={"kind": DISCRETE}) for x in d],
        *[column(x).cast("double").alias(x, metadata={"kind": CONTINUOUS}) for x in c],
    )


def columns_of(df: DataFrame, which: str) -> list[str]:
    return [x for x in df.columns if kind(df, x) == which]


def position(df: DataFrame, name: str) -> int:
    """A column's place, -1 without it."""
    return df.columns.index(name) if name in df.columns else -1


def require_discrete(df: DataFrame, names: Iterable[str]) -> None:
    """Raises for columns that aren't there or are numbers, which have to be cut first."""
    for x in names:
        if x not in df.columns:
            raise ValueError(f"no column {x}")
        if kind(df, x) != DISCRETE:
            raise ValueError(f"column {x} is continuous; discretise it first")


def empty_like(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def append_row(df: DataFrame, source: DataFrame, condition) -> DataFrame:
    """df with the rows of source that meet a condition."""
    return df.unionByName(source.filter(condition))


def numbered_in_order(df: DataFrame, *order: Column | str, name: str) -> DataFrame:
    """df with consecutive numbers from 0 in an order, without a task that sees all rows.

    Rows are dealt to ranges and sorted within them; the ranges' sizes are added up in a small
    table. The order should be total, so that equal keys can't fill one range. Places are written
    down once (in the shared folder), so they don't change if an executor is lost.
    """
    place, start, part = (fresh(df, x) for x in ("_place", "_start", "_part"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = written(ranged, "ordered").withColumn(part, F.shiftright(place, 33))  # Spark's id is partition * 2^33 + row
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(start))  # a row for each range
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), part).withColumn(name, F.col(start) + within).drop(place, start, part)


def dictionary(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """(attr, value, code): the values of discrete columns, numbered from 0 in the order of their names.

    Values of all columns are numbered together by ranges, so one with very many values is in many tasks; each column's first number is taken off.
    """
    names = list(names) if names is not None else columns_of(df, DISCRETE)
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("attr"), column(x).cast("string").alias("value")) for x in names])).alias("p")
    values = df.select(pairs).select("p.attr", "p.value").filter("value is not null").distinct()
    numbered = numbered_in_order(values, F.col("attr"), F.col("value"), name="n")
    first = numbered.groupBy("attr").agg(F.min("n").alias("first"))  # a row for each column
    return numbered.join(F.broadcast(first), "attr").select("attr", "value", (F.col("n") - F.col("first")).alias("code"))


def encode(df: DataFrame, name: str) -> DataFrame:
    """df with the column's dictionary code in <name>_code; -1 where it is missing. Rows of a value that very many share may be split by adaptive execution, as the dictionary has one row for it."""
    value, code = fresh(df, "_value"), f"{name}_code"
    codes = dictionary(df, [name]).select(F.col("value").alias(value), F.col("code").cast("long").alias(code))
    return df.join(codes, column(name).cast("string") == F.col(value), "left").drop(value).withColumn(code, F.coalesce(column(code), F.lit(-1)))


def unknown_values(df: DataFrame, name: str, domain: DataFrame) -> DataFrame:
    """Distinct values of a column that a dictionary (attr, value) doesn't declare."""
    declared = domain.filter(F.col("attr") == name).select(F.col("value").alias(name))
    return df.select(name).filter(F.col(name).isNotNull()).distinct().join(declared, name, "left_anti")


def random_split(df: DataFrame, ratio: float = 0.9, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Every row to the first part with probability ratio, else to the second, by a seeded hash of its values: however rows are dealt, and equal rows together."""
    first = in_first_part(df, ratio, seed)
    return df.filter(first), df.filter(~first)


def in_first_part(df: DataFrame, ratio: float = 0.9, seed: int = 42) -> Column:
    """Whether a row's hash is in the first ratio of its range."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(column(x).cast("string"), F.lit("?")) for x in df.columns])
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("long") < int(ratio * 16**_HASH_DIGITS)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: name, with underlines behind it as needed."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def distinct_rows(df: DataFrame, names: Iterable[str], count: str = "_n") -> DataFrame:
    """The distinct combinations of columns with their number of rows in count.

    Mining, coverage and entropies depend on nothing else, so categories of billions of rows
    become a table that is as large as the number of combinations that occur.
    """
    return df.groupBy(*map(column, names)).agg(F.count("*").alias(count))


def add_rows(mask: Column, rows: Column) -> Column:
    """Row masks are boolean columns; these four are union, difference, size and reset."""
    return mask | rows


def remove_rows(mask: Column, rows: Column) -> Column:
    return mask & ~rows


def count_rows(mask: Column) -> Column:
    return F.count_if(mask)


def reset_rows(value: bool) -> Column:
    return F.lit(value)
