"""Plan helpers: checked lookup joins, and filters on costly expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MAX_ROWS = 500_000
MAX_BYTES = 64 << 20

# A key is hot when it holds more than one row in this many, so there are at most as many hot keys.
HOT_SHARE = 1000


def fits_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """True when the table is proven to hold at most ``max_rows`` rows and ``max_bytes``.

    Rows are counted first, which a stored table answers from its footers; only
    a table within the bound is measured.
    """
    if df.count() > max_rows:
        return False
    text = [c for c, t in df.dtypes if t != "binary"]
    width = F.length(F.to_json(F.struct(*text))) if text else F.lit(0)
    for c, t in df.dtypes:
        if t == "binary":
            width = width + F.coalesce(F.length(c), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return size <= max_bytes


def _hot_hashes(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of all keys that hold a large share of the rows.

    An approximate sketch is enough: it decides where rows are processed, not
    which rows there are.
    """
    found = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_SHARE}, {16 * HOT_SHARE})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if not found["n"]:
        return []
    return [r["item"] for r in found["top"] if r["count"] > max(1, found["n"] // HOT_SHARE)]


def spread_join(
    big: DataFrame, other: DataFrame, keys: list[str], how: str = "left", salts: int = 64
) -> DataFrame:
    """A shuffle join of a skewed table to one with unique keys.

    Rows of hot keys get one of ``salts`` numbers, and the few rows of those
    keys on the other side are repeated for each number, so a key that holds a
    third of all rows is many tasks. All other keys join as usual. The number
    depends on the row alone: a retried task sends a row to the same place.
    """
    hot = _hot_hashes(big, keys)
    if not hot:
        return big.join(other, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    plain = [c for c, t in big.dtypes if "map<" not in t and "variant" not in t]
    number = F.when(is_hot, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    # Never null, so the join adds no filter that would compute the number twice.
    spread = big.withColumn("_salt", F.coalesce(number, F.lit(0)))
    numbers = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = other.withColumn("_salt", F.explode(numbers))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str] | str,
    how: str = "left",
    check: DataFrame | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Join a large table to a lookup table with unique keys.

    A lookup side of proven size is broadcast: the large side stays where it is
    and hot keys cost nothing. Beyond the bound both sides are shuffled by
    :func:`spread_join`, with the same result. ``check`` is a cheaper table that
    is at least as large as ``small``, to be measured in its place.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small if check is None else check, max_rows=max_rows):
        return big.join(F.broadcast(small), keys, how)
    return spread_join(big, small, keys, how)


def with_kept(df: DataFrame, name: str, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """Add a costly column and keep the rows whose value passes the test, computing it once.

    A plain filter on a computed column is pushed below the projection and
    computes the column a second time; a generator over a one-element array is not.
    """
    return df.select("*", F.explode(F.filter(F.array(value), test)).alias(name))
