"""The predicates of the query language, as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw.functions import dialect


@dataclass(frozen=True)
class Predicate:
    """test(columns or literals) -> Column. binds: the argument that the predicate can give a value to, by bind of the others.

    link: joins two frames on the predicate by equality instead of pair by pair:
    (left, right, left column, right column, flipped) -> DataFrame.
    """

    test: Callable[..., Column]
    binds: int | None = None
    bind: Callable[..., Column] | None = None
    link: Callable[[DataFrame, DataFrame, str, str, bool], DataFrame] | None = None


def segments(name: Column) -> Column:
    """A module name's segments: dots and dashes part them."""
    return F.split(name, r"[-.]")


def corresponds(short: Column, long: Column) -> Column:
    """The segments of short are the last ones of long."""
    a, b = segments(short), segments(long)
    return (F.size(a) <= F.size(b)) & (F.slice(b, F.greatest(F.size(b) - F.size(a) + 1, F.lit(1)), F.size(a)) == a)


def tails(df: DataFrame, c: str) -> DataFrame:
    """df with __tail: a row for each suffix of the name c."""
    s = segments(F.col(c))
    return df.withColumn("__tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, i, F.size(s)), "."))))


def whole(df: DataFrame, c: str) -> DataFrame:
    """df with __tail: the whole name c, written as tails are."""
    return df.withColumn("__tail", F.array_join(segments(F.col(c)), "."))


def link_corresponding(left: DataFrame, right: DataFrame, a: str, b: str, flipped: bool, on: list[str] | None = None) -> DataFrame:
    """left.a corresponds to right.b (flipped: right.b to left.a), by equality with every suffix of the longer name, and of the columns on."""
    x, y = (tails(left, a), whole(right, b)) if flipped else (whole(left, a), tails(right, b))
    return x.join(y, ["__tail", *(on or [])]).drop("__tail")


def one_of(values: Any, v: Column) -> Column:
    return v.isin([str(x) if isinstance(x, str) else x for x in values])


PREDICATES: dict[str, Predicate] = {
    "=": Predicate(lambda a, b: a == b, 0, lambda b: b),
    "not=": Predicate(lambda a, b: a != b),
    "<": Predicate(lambda a, b: a < b),
    ">": Predicate(lambda a, b: a > b),
    "<=": Predicate(lambda a, b: a <= b),
    ">=": Predicate(lambda a, b: a >= b),
    "contains?": Predicate(one_of),
    "starts-with?": Predicate(lambda a, b: F.startswith(a, b)),
    "ends-with?": Predicate(lambda a, b: F.endswith(a, b)),
    "reader-realizes?": Predicate(lambda rn, p, ln: rn == F.concat(p, ln), 0, lambda p, ln: F.concat(p, ln)),
    "module-corresponds?": Predicate(corresponds, link=link_corresponding),
    "value-valid?": Predicate(lambda form, v: dialect.value_valid(form, v)),
    "value-invalid?": Predicate(lambda form, v: ~dialect.value_valid(form, v)),
}


def register(name: str, predicate: Predicate) -> None:
    """Make a predicate known to all queries; prefer built-in functions in it, so that plans stay compiled."""
    PREDICATES[name] = predicate
