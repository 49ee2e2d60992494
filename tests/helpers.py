"""Small logs for tests."""

import datetime as dt

from pyspark.sql import functions as F

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "position long, timestamp timestamp, stream_category string, stream_id string, event_number long, event_type string, data binary, metadata binary"


def make_log(spark, events):
    """Events as (category, id, type[, data[, metadata[, timestamp]]]); positions from 1."""
    counts, rows = {}, []
    for k, e in enumerate(events):
        category, id_, kind, data, metadata, ts = (*e, *(b"", b"", None)[len(e) - 3 :])
        n = counts.get((category, id_), 0)
        counts[(category, id_)] = n + 1
        rows.append((k + 1, ts or START + dt.timedelta(seconds=k), category, id_, n, kind, bytearray(data), bytearray(metadata)))
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    """Values of a column in the order of the result."""
    return [r[name] for r in df.select(name).collect()]


def by(df, order, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy(order).collect()]


def effective(text):
    return f'{{"effective_timestamp":"{text}"}}'.encode()


def keyed(spark, rows, schema="position long, k long"):
    return spark.createDataFrame(rows, schema)


__all__ = ["F", "SCHEMA", "START", "UTC", "by", "column", "effective", "keyed", "make_log"]
