"""Rules: conditions on columns, coverage, and their texts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.itemsets import all_of, attribute_name
from marlstone.functions.names import column
from marlstone.operators.tables import CONTINUOUS, DISCRETE, kind

EQ, NEQ, LE, GT = "=", "<>", "<=", ">"


def number_text(x: float) -> str:
    """A number with all its digits; whole ones without a point."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


@dataclass(frozen=True)
class Literal:
    """attr op value: = and <> for discrete columns, <= and > for numbers."""

    attr: str
    op: str
    value: str | float

    def __post_init__(self) -> None:
        if self.op not in (EQ, NEQ, LE, GT):
            raise ValueError(f"no operator {self.op}")
        object.__setattr__(self, "value", float(self.value) if self.kind == CONTINUOUS else str(self.value))

    @property
    def kind(self) -> str:
        return CONTINUOUS if self.op in (LE, GT) else DISCRETE

    def column(self) -> Column:
        """The condition, never null: a missing value meets only <>."""
        c = column(self.attr)
        if self.op == EQ:
            return c.cast("string").eqNullSafe(F.lit(self.value))
        if self.op == NEQ:
            return ~c.cast("string").eqNullSafe(F.lit(self.value))
        return F.coalesce(c <= self.value if self.op == LE else c > self.value, F.lit(False))

    def negated(self) -> Literal:
        return Literal(self.attr, {EQ: NEQ, NEQ: EQ, LE: GT, GT: LE}[self.op], self.value)

    def __str__(self) -> str:
        return f"{self.attr}{self.op}{self.value if self.kind == DISCRETE else number_text(self.value)}"


@dataclass(frozen=True)
class Rule:
    """A conjunction and what it says; an empty body covers every row."""

    body: tuple[Literal, ...]
    head: Literal
    pos: int = 0
    neg: int = 0

    @property
    def freq(self) -> int:
        return self.pos + self.neg

    @property
    def conf(self) -> float:
        return self.pos / self.freq if self.freq else 0.0

    def covers(self) -> Column:
        return all_of([x.column() for x in self.body])

    def counted(self, pos: int, neg: int) -> Rule:
        return replace(self, pos=int(pos or 0), neg=int(neg or 0))


def parse_item(item: str) -> Literal:
    attr, _, value = item.partition("=")
    return Literal(attribute_name(attr), EQ, value)


def from_mined(rows: Iterable) -> list[Rule]:
    """Rules of mined rows (body, head, pos, neg), best first, then by their items."""
    rules = [Rule(tuple(parse_item(x) for x in sorted(r["body"])), parse_item(r["head"]), int(r["pos"]), int(r["neg"])) for r in rows]
    return sorted(rules, key=lambda r: (*order_key(r), str(r.head), tuple(map(str, r.body))))


def order_key(r: Rule) -> tuple[int, int]:
    """More positives first, then fewer negatives."""
    return -r.pos, r.neg


def coverage(df: DataFrame, rules: list[Rule], where: Column | None = None, weight: str | None = None) -> DataFrame:
    """(rule, pos, neg, freq, conf) of every rule on the rows that meet where; one pass for all rules."""
    rows = df if where is None else df.filter(where)
    spark = df.sparkSession
    every = spark.range(len(rules)).select(F.col("id").cast("int").alias("rule"))
    if rules:  # a row for each rule that covers a row, added up before it is sent on
        met = F.array_compact(F.array(*[F.when(r.covers(), F.struct(F.lit(i).alias("rule"), r.head.column().alias("right"))) for i, r in enumerate(rules)]))
        hits = rows.select((column(weight) if weight else F.lit(1)).alias("w"), F.explode(met).alias("r"))
        found = hits.groupBy("r.rule").agg(F.sum(F.when(F.col("r.right"), F.col("w"))).alias("pos"), F.sum(F.when(~F.col("r.right"), F.col("w"))).alias("neg"))
        every = every.join(found, "rule", "left")
    else:
        every = every.selectExpr("rule", "0L AS pos", "0L AS neg")
    pos, neg = (F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("pos", "neg"))
    freq = F.col("pos") + F.col("neg")
    return every.select("rule", pos, neg).withColumn("freq", freq).withColumn("conf", F.when(freq > 0, F.col("pos") / freq).otherwise(F.lit(0.0)))


def counted(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    rows = {r["rule"]: r for r in coverage(df, rules).collect()} if rules else {}
    return [r.counted(rows[i]["pos"], rows[i]["neg"]) for i, r in enumerate(rules)]


def check(df: DataFrame, rules: Iterable[Rule], class_: str | None = None, need_target: bool = True) -> None:
    """Raises unless every rule's columns are there with fitting kinds, and all heads are of the class."""
    names, kinds = set(df.columns), {}
    for r in rules:
        for x in r.body:
            if x.attr not in names:
                raise ValueError(f"rule {plain_text(r)}: no column {x.attr}")
            if x.attr not in kinds:
                kinds[x.attr] = kind(df, x.attr)
            if kinds[x.attr] != x.kind:
                raise ValueError(f"rule {plain_text(r)}: column {x.attr} is of the other kind")
        if r.head.op != EQ:
            raise ValueError(f"rule {plain_text(r)}: a head is an equality")
        if class_ is not None and r.head.attr != class_:
            raise ValueError(f"rule {plain_text(r)}: its head isn't {class_}")
        if any(x.attr == r.head.attr for x in r.body):
            raise ValueError(f"rule {plain_text(r)}: its head is in its body")
        if need_target and r.head.attr not in names:
            raise ValueError(f"rule {plain_text(r)}: no column {r.head.attr}")


def unknown_values(df: DataFrame, rules: Iterable[Rule]) -> list[Literal]:
    """Discrete conditions on values that no row has; they hold for no row, negated ones for all."""
    wanted = {x for r in rules for x in (*r.body, r.head) if x.kind == DISCRETE and x.attr in df.columns}
    if not wanted:
        return []
    ordered = sorted(wanted, key=str)
    seen = df.agg(*[F.max(F.col(x.attr).cast("string").eqNullSafe(F.lit(x.value))).alias(f"s{i}") for i, x in enumerate(ordered)]).first()
    return [x for i, x in enumerate(ordered) if not seen[f"s{i}"]]


def plain_text(r: Rule) -> str:
    """conf freq a=b & ... => c=d"""
    return f"{r.conf:f} {r.freq} {' & '.join(map(str, r.body))} => {r.head}"


# The layouts of rules as text and as HTML.
FROM, FOLLOWS = "FROM", "FOLLOWS"
HTML_FROM, HTML_FOLLOWS, HTML_END = "<p><font color=blue><b>FROM</b></font> ", "<br><font color=blue><b>FOLLOWS</b></font> ", "</p>"


def words(r: Rule, pos_neg: bool = True, freq_conf: bool = True) -> str:
    """FROM, a line for each condition, FOLLOWS and the head; counts are comments of the text format, each pair if wanted."""
    lines = [FROM, *map(str, r.body), FOLLOWS, str(r.head)]
    lines += [f"%(pos={r.pos},neg={r.neg})"] * pos_neg + [f"%(freq={r.freq},Conf={r.conf:f})"] * freq_conf
    return "\n".join(lines)


def html(r: Rule) -> str:
    """The rule as a paragraph of HTML, conditions with commas between them."""
    return HTML_FROM + ", ".join(escape(str(x), quote=False) for x in r.body) + HTML_FOLLOWS + escape(str(r.head), quote=False) + HTML_END
