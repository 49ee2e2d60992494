"""Running aggregates along a log, without a window over the whole log.

A window without partitions moves all rows into one task.  Here rows fall into buckets that
follow the order (ranges of positions or of time).  Values run within each bucket in parallel;
bucket totals, a small table, run across buckets; a join on the bucket adds the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20
DAY_SECONDS = 86_400


def position_bucket(position: str = "position", width: int = WIDTH) -> Column:
    return F.floor(F.col(position) / width)


def time_bucket(ts: str, seconds: int = DAY_SECONDS) -> Column:
    """Days (or other spans) of a timestamp with or without time zone."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def balanced_bucket(df: DataFrame, key: str, ties: list[str], parts: int | None = None, width: int = WIDTH) -> Column:
    """A bucket that doesn't decrease along ``key`` and then ``ties``, of about equal numbers of rows.

    Approximate quantiles of the key, found in one aggregation, are the borders.  A key that is more
    than one of them holds too many rows for a bucket; it is cut by ``ties``, of which the last is a
    position and the others are few.  Keys are timestamps or numbers.
    """
    x = F.unix_micros(F.col(key).cast("timestamp")) if dict(df.dtypes)[key].startswith("timestamp") else F.col(key)
    x = x.cast("double")
    parts = parts or min(256, 4 * df.sparkSession.sparkContext.defaultParallelism)
    borders = df.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 50 * parts)).first()[0] or [0.0]
    hot = sorted({b for b, c in zip(borders, borders[1:]) if b == c})
    below = F.size(F.filter(F.lit(sorted(set(borders))), lambda b: b < x))
    is_hot = x.isin(hot) if hot else F.lit(False)
    own = [F.when(is_hot, F.col(t)).otherwise(F.lit(0)).cast("long") for t in ties[:-1]] + [F.when(is_hot, F.floor(F.col(ties[-1]) / width)).otherwise(F.lit(0)).cast("long")]
    return F.struct((2 * below + is_hot.cast("int")).alias("range"), *(c.alias(f"t{k}") for k, c in enumerate(own)))


def running(
    df: DataFrame,
    columns: dict[str, tuple[str, Column | str | None]],
    order: list[str] | None = None,
    by: list[str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds running values in the order of ``order`` within ``by``.

    ``columns`` maps a new name to (kind, value): ``count`` (rows so far, this one included),
    ``sum``, ``max``, ``last`` (the last non-null value so far) or ``lag`` (the value one row
    before).  ``bucket`` must not decrease along the order; the default cuts positions.
    """
    order, by = order or ["position"], by or []
    df = df.withColumn("_bucket", position_bucket(order[0]) if bucket is None else bucket)
    own = Window.partitionBy(*by, "_bucket").orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda v: F.col(v) if isinstance(v, str) else v
    latest = F.struct(*order)
    inner, totals, carried, final = {}, [], [], {}
    for name, (kind, v) in columns.items():
        here, before = F.col(f"_{name}"), F.col(f"_{name}_before")
        if kind in ("count", "sum"):
            one = F.lit(1) if kind == "count" else value(v)
            inner[f"_{name}"] = F.sum(one).over(so_far)
            totals.append(F.sum(one).alias(f"_{name}_total"))
            carry = F.sum(f"_{name}_total")
            final[name] = (here + F.coalesce(before, F.lit(0))).cast("long") if kind == "count" else here + F.coalesce(before, F.lit(0))
        elif kind == "max":
            inner[f"_{name}"] = F.max(value(v)).over(so_far)
            totals.append(F.max(value(v)).alias(f"_{name}_total"))
            carry = F.max(f"_{name}_total")
            final[name] = F.greatest(here, before)
        elif kind in ("last", "lag"):
            inner[f"_{name}"] = F.last(value(v), ignorenulls=True).over(so_far) if kind == "last" else F.lag(F.struct(value(v).alias("v"))).over(own)
            kept = value(v) if kind == "last" else F.struct(value(v).alias("v"))
            totals.append(F.max_by(kept, F.when(kept.isNotNull(), latest)).alias(f"_{name}_total"))
            carry = F.last(f"_{name}_total", ignorenulls=True)
            final[name] = F.coalesce(here, before) if kind == "last" else F.coalesce(here, before)["v"]
        else:
            raise ValueError(kind)
        carried.append(carry.over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{name}_before"))
    keys = [*by, "_bucket"]
    buckets = df.groupBy(*keys).agg(*totals).select(*keys, *carried)
    names = df.columns
    out = df.withColumns(inner).join(buckets, keys)
    return out.withColumns(final).select(*(c for c in names if c != "_bucket"), *columns)
