"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of anything but space and U+0009-U+000D; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, wherever the optimizer moves or copies the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(w: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles of a word array in text order; with fewer words the whole sequence is one, no words give none."""

    def of(x: Column) -> Column:
        n = F.size(x)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < k, F.array(F.xxhash64(x)))
            .otherwise(F.transform(indices(n - (k - 1)), lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(k)])))
        )

    return let(w, of)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: further columns of any name can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def whole(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``df`` as struct ``row`` beside what is computed: no clash, and ``row.*`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)
