"""Sums of doubles that do not depend on the order of rows: integer bins by exponent, one rounding at the end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import scalars as S

# Bits of a bin. 2^38 numbers fit before the sum of a bin passes 64 bits, and then the sum fails, it does not wrap.
BITS = 24
BASE = 1 << BITS
# A double has 53 bits, so it touches four bins at most; the same number of digits decides the rounding.
TOUCHED = 4


def _pow2(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _pieces(df: DataFrame, keys: Sequence[str], value: str, carried: Sequence[str]) -> DataFrame:
    """One row per bin that a value touches; the first one carries the count and what is no finite number."""
    number = F.col("__v")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    rows = df.select(*keys, *carried, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__finite", F.when(finite & (number != 0), number))
    rows = rows.withColumn("__level", F.floor(F.log2(F.abs("__finite")) / BITS).cast("int"))
    half = _pow2(F.col("__level") * -(BITS // 2))  # in two steps, as the factor itself may be beyond a double
    rows = rows.withColumn("__scaled", F.col("__finite") * half * half)

    def piece(i: int) -> Column:
        moved = F.col("__scaled") * float(BASE**i)
        part = (moved if i == 0 else moved % F.lit(float(BASE))).cast("bigint")  # both are exact; the cast cuts towards zero
        return S.record(
            level=F.col("__level") - i,
            part=F.coalesce(part, F.lit(0)).cast("bigint"),
            n=(number.isNotNull() if i == 0 else F.lit(False)).cast("int"),
            special=F.when(~finite, number) if i == 0 else F.lit(None).cast("double"),
        )

    every = F.array(*[piece(i) for i in range(TOUCHED)])
    kept = F.filter(every, lambda p, i: (i == 0) | (p["part"] != 0))
    return rows.select(*keys, *carried, F.explode_outer(kept).alias("__p")).select(*keys, *carried, "__p.*")


def _digits(bins: Column) -> Column:
    """Digits of a sum of bins from the lowest on, each from 0 to BASE - 1, and what is left above them (-1 for a negative sum)."""
    start = S.record(carry=F.lit(0).cast("bigint"), digits=F.array().cast("array<bigint>"))

    def step(state: Column, part: Column) -> Column:
        total = state["carry"] + part
        digit = F.pmod(total, F.lit(BASE).cast("bigint"))
        return S.record(carry=F.shiftright(total, BITS), digits=F.array_append(state["digits"], digit))

    return F.aggregate(bins, start, step)


def _rounded(digits: Column, low: Column) -> Column:
    """The double nearest to the number with these digits, the lowest of which stands for BASE ** low."""

    def from_top(top: Column) -> Column:
        # `top` counts from 1; digits below the first four only tell whether there is anything below.
        head = F.lit(Decimal(0)).cast("decimal(36,0)")
        for i in range(TOUCHED):
            digit = F.coalesce(F.try_element_at(digits, F.greatest(top - i, F.lit(1))), F.lit(0)).cast("decimal(8,0)")
            weight = F.lit(Decimal(2 * BASE ** (TOUCHED - 1 - i)))
            head = head + F.when(top > i, digit * weight).otherwise(F.lit(Decimal(0)))
        below = F.exists(F.slice(digits, F.lit(1), F.greatest(top - TOUCHED, F.lit(0))), lambda d: d != 0)
        doubled = (head + below.cast("int").cast("decimal(1,0)")).cast("double")
        exponent = (low + top - TOUCHED) * BITS - 1
        first = F.floor(exponent / 2).cast("int")
        return doubled * _pow2(first) * _pow2(exponent - first)

    places = F.filter(F.transform(digits, lambda d, i: F.when(d != 0, i + 1)), lambda p: p.isNotNull())
    return F.coalesce(S.let(F.array_max(places), from_top), F.lit(0.0))


def _total(bins: Column) -> Column:
    """The sum that bins (array of level, part) stand for. There are about 90 levels, however many rows."""

    def signed(ordered: Column) -> Column:
        low = ordered[0]["level"]
        places = F.sequence(low, F.element_at(ordered, -1)["level"] + 3)  # 64-bit sums carry into three bins at most

        def choose(parts: Column) -> Column:
            up = _digits(parts)
            down = _digits(F.transform(parts, lambda p: -p))
            sign = S.let(up, lambda d: F.when(d["carry"] >= 0, S.record(negative=F.lit(False), digits=d["digits"])))
            either = F.coalesce(sign, S.let(down, lambda d: S.record(negative=F.lit(True), digits=d["digits"])))
            return S.let(either, lambda e: S.let(_rounded(e["digits"], low), lambda v: F.when(e["negative"], -v).otherwise(v)))

        dense = S.let(F.map_from_entries(ordered), lambda m: F.transform(places, lambda v: F.coalesce(F.try_element_at(m, v), F.lit(0).cast("bigint"))))
        return S.let(dense, choose)

    return F.when(F.size(bins) > 0, S.let(F.array_sort(bins), signed)).otherwise(F.lit(0.0))


def sums(df: DataFrame, keys: Sequence[str], value: str, least: Mapping[str, str] | None = None, most: Mapping[str, str] | None = None) -> DataFrame:
    """keys, sum and count of a number column: the double nearest to the exact sum, whatever the order or partitions of rows.

    Each value is cut into integers by bins of its exponent, exactly; bins are added up as integers with map-side
    combine, so what is shuffled is a key's bins and not its rows. Nulls are not counted and a key without values has
    sum null. NaN and infinities give what double addition gives. Results below the smallest normal double may be one
    place off. `least` and `most` name further columns (result name to column) whose extremes come with it.
    """
    least, most = dict(least or {}), dict(most or {})
    carried = list(dict.fromkeys([*least.values(), *most.values()]))
    named = df.select(*keys, F.col(value).alias("__value"), *[F.col(c).alias(f"__c_{c}") for c in carried])
    pieces = _pieces(named, keys, "__value", [f"__c_{c}" for c in carried])
    low = [F.min(f"__c_{c}").alias(f"__low_{a}") for a, c in least.items()]
    high = [F.max(f"__c_{c}").alias(f"__high_{a}") for a, c in most.items()]
    bins = pieces.groupBy(*keys, "level").agg(F.sum("part").alias("part"), F.sum("n").alias("n"), F.sum("special").alias("special"), *low, *high)
    bin_of = F.when(F.col("level").isNotNull(), F.struct("level", "part"))
    table = bins.groupBy(*keys).agg(
        F.collect_list(bin_of).alias("__bins"), F.sum("n").alias("count"), F.sum("special").alias("__special"),
        *[F.min(f"__low_{a}").alias(a) for a in least], *[F.max(f"__high_{a}").alias(a) for a in most],
    )
    total = F.when(F.col("count") > 0, F.coalesce("__special", _total(F.col("__bins"))))
    return table.select(*keys, total.alias("sum"), "count", *least, *most)
