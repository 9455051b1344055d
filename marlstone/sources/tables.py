"""Tables as typed text, Parquet, and C5 files.

Typed text has a header of name(d) or name(c) for discrete and continuous columns; tokens are
separated by white space, ? is a missing value, and % starts a comment. Lines are parsed by
column functions in parallel; only the header comes to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.tables import CONTINUOUS, DISCRETE, dictionary, kind
from marlstone.sources.files import suffix, write_text

MISSING = "?"
_HEADER = re.compile(r"(.+)\(([dc])\)")
_NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Suffixes of files kept as Parquet; all others are typed text.
BINARY = ("bin", "parquet")


def parse_header(line: str) -> list[tuple[str, str]]:
    """(name, kind) of every token; anything but (d) and (c) is an error."""
    out = []
    for token in line.split():
        m = _HEADER.fullmatch(token)
        if not m:
            raise ValueError(f"header {token}: a column is name(d) or name(c)")
        out.append((m[1], m[2]))
    if len({n for n, _ in out}) < len(out):
        raise ValueError("a column name is repeated")
    return out


def _content(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(line, "%.*$", ""), "\\s+", " "))


def read_typed_text(spark: SparkSession, path: str) -> DataFrame:
    """A typed text table; a row with too few or too many values, or a number that is none, is an error when it is read."""
    lines = spark.read.text(path).select(_content(F.col("value")).alias("line")).filter("line <> ''")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no header")
    header = parse_header(first[0])
    data = lines.filter(F.col("line") != first[0])
    if all(which == DISCRETE for _, which in header):
        # only here can a row look like the header, of which each file has one
        like = lines.filter(F.col("line") == first[0]).select(F.input_file_name().alias("file")).groupBy("file").agg(F.count("*").alias("n"))
        more = like.agg(F.sum(F.col("n") - 1)).first()[0]
        if more:
            data = data.unionByName(spark.range(more).select(F.lit(first[0]).alias("line")))
    cells = data.select(F.split("line", " ").alias("x"))
    ragged = F.raise_error(F.concat(F.lit(f"a row of {path} should have {len(header)} values and has "), F.size("x").cast("string")))
    cells = cells.select(F.when(F.size("x") == len(header), F.col("x")).otherwise(ragged).alias("x"))

    def column(i: int, name: str, which: str) -> Column:
        raw = F.when(F.col("x")[i] != MISSING, F.col("x")[i])
        if which == CONTINUOUS:
            bad = F.raise_error(F.concat(F.lit(f"column {name}: no number: "), raw))
            raw = F.when(raw.isNull(), F.lit(None).cast("double")).when(raw.rlike(_NUMBER), raw.cast("double")).otherwise(bad.cast("double"))
        return raw.alias(name, metadata={"kind": which})

    return cells.select(*[column(i, n, k) for i, (n, k) in enumerate(header)])


def header_of(df: DataFrame) -> list[str]:
    return [f"{x}({kind(df, x)})" for x in df.columns]


def write_typed_text(df: DataFrame, path: str) -> None:
    """A folder of typed text; every part file has the header, which the reader passes over. Values that the format can't hold are an error."""

    def cell(x: str) -> Column:
        c = F.col(x).cast("string")
        if kind(df, x) == CONTINUOUS:
            return F.coalesce(c, F.lit(MISSING))
        bad = c.rlike("[\\s%]") | (c == MISSING) | (c == "")
        return F.when(c.isNull(), MISSING).when(bad, F.raise_error(F.concat(F.lit(f"column {x} can't be written: "), c)).cast("string")).otherwise(c)

    names = header_of(df)
    if any(re.search(r"[\s%]", n) for n in names):
        raise ValueError("column names can't hold white space or %")
    df.select(*[cell(x).alias(n) for x, n in zip(df.columns, names)]).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: Parquet, or typed text. Kinds of columns are kept in both."""
    return spark.read.parquet(path) if suffix(path) in BINARY else read_typed_text(spark, path)


def save_table(df: DataFrame, path: str) -> None:
    if suffix(path) in BINARY:
        df.write.mode("overwrite").parquet(path)
    else:
        write_typed_text(df, path)


def c5_names(df: DataFrame, target: str, class_first: bool = False) -> str:
    """The .names text: the classes themselves in front, or the name of the target among the columns; spaces become underlines."""
    if kind(df, target) != DISCRETE:
        raise ValueError("the target must be discrete")
    values: dict[str, list[str]] = {}
    for r in dictionary(df).orderBy("attr", "code").collect():
        values.setdefault(r["attr"], []).append(r["value"].replace(" ", "_"))
    line = lambda x: f"{x.replace(' ', '_')}: " + ("continuous." if kind(df, x) == CONTINUOUS else ",".join(values.get(x, [])) + ".")
    if class_first:
        head, rest = ",".join(values.get(target, [])) + ".  | Target attribute", [x for x in df.columns if x != target]
    else:
        head, rest = target.replace(" ", "_") + ".  | Target attribute", df.columns
    return head + "\n\n" + "".join(line(x) + "\n" for x in rest)


def c5_rows(df: DataFrame, target: str, class_first: bool = False, ending_dot: bool = False) -> DataFrame:
    """(value): the .data lines; with classes in front the target's value is the last of a row, else it stands in its column."""
    order = [x for x in df.columns if x != target] + [target] if class_first else df.columns
    cells = [F.coalesce(F.translate(F.col(x).cast("string"), " ", "_"), F.lit(MISSING)) for x in order]
    return df.select(F.concat(F.concat_ws(", ", *cells), F.lit("." if ending_dot else "")).alias("value"))


def write_c5(df: DataFrame, path: str, target: str, class_first: bool = False, ending_dot: bool = False) -> None:
    """path.names, a file, and path.data, a folder of text."""
    write_text(df.sparkSession, f"{path}.names", c5_names(df, target, class_first))
    c5_rows(df, target, class_first, ending_dot).write.mode("overwrite").text(f"{path}.data")

