"""Every operator as a query over the tables of a folder, with its SQL for a second engine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as names
from tidelog.functions.jsoncompat import json_difference
from tidelog.model import locator
from tidelog.operators import append, batches, clock, diff, merge, reads, shovel, stitch, transform

from tidelog.plans.adapter import LOG_SQL, METADATA_SQL, log, unnumbered, with_metadata
from tidelog.sources import archives, legacy
from tidelog.sources.store import LogStore
from tidelog.sources.tables import shared_folder
from tidelog.streaming.health import Threshold
from tidelog.streaming.subscription import Subscription

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

COLUMNS = ["position", "stream_category", "stream_id", "event_number", "event_type", "data"]
SHOWN = ", ".join(COLUMNS)
#: Columns that don't need event numbers.
PLAIN = ["position", "stream_category", "stream_id", "event_type", "data"]
SHOWN_PLAIN = ", ".join(PLAIN)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may refer to the log as ``ev``."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql if sql.lstrip().startswith("--") else f"WITH {LOG_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {LOG_SQL}{sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def ntz(value: str) -> Column:
    return F.lit(dt.datetime.fromisoformat(value)).cast("timestamp_ntz")


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}"


# Reads

query("read_all_forwards", f"SELECT {SHOWN_PLAIN} FROM ev WHERE position > 5000")(lambda s, d: reads.read_all_forwards(unnumbered(s, d), 5000).select(PLAIN))
query("read_all_backwards", f"SELECT {SHOWN_PLAIN} FROM ev")(lambda s, d: reads.read_all_backwards(unnumbered(s, d)).select(PLAIN))
query("read_all_backwards_from", f"SELECT {SHOWN_PLAIN} FROM ev WHERE position < 700")(lambda s, d: reads.read_all_backwards(unnumbered(s, d), 700).select(PLAIN))
query("read_last_event", f"SELECT {SHOWN_PLAIN} FROM ev ORDER BY position DESC LIMIT 1")(lambda s, d: reads.read_last_event(unnumbered(s, d)).select(PLAIN))
query("read_category_forwards", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category = 'seg1' AND position > 300")(lambda s, d: reads.read_category_forwards(unnumbered(s, d), "seg1", 300).select(PLAIN))
query("read_categories_forwards", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category IN ('seg1', 'seg3') AND position > 100")(lambda s, d: reads.read_categories_forwards(unnumbered(s, d), ["seg1", "seg3", "seg1"], 100).select(PLAIN))
query("read_category_backwards", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category = 'seg2' AND position < 900")(lambda s, d: reads.read_category_backwards(unnumbered(s, d), "seg2", 900).select(PLAIN))
query("last_event_in_category", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category = 'seg3' ORDER BY position DESC LIMIT 1")(lambda s, d: reads.read_last_event_in_category(unnumbered(s, d), "seg3").select(PLAIN))
query("last_event_per_category", f"SELECT {SHOWN_PLAIN} FROM ev QUALIFY row_number() OVER (PARTITION BY stream_category ORDER BY position DESC) = 1")(lambda s, d: reads.last_event_per_category(unnumbered(s, d)).select(PLAIN))
query("read_stream_forwards", f"SELECT {SHOWN} FROM ev WHERE stream_category = 'seg2' AND stream_id = '7' AND event_number > 3")(lambda s, d: reads.read_stream_forwards(log(s, d), "seg2", "7", 3).select(COLUMNS))
query("read_stream_backwards", f"SELECT {SHOWN} FROM ev WHERE stream_category = 'seg2' AND stream_id = '7' AND event_number < 20")(lambda s, d: reads.read_stream_backwards(log(s, d), "seg2", "7", 20).select(COLUMNS))
query("last_event_in_stream", f"SELECT {SHOWN} FROM ev WHERE stream_category = 'seg2' AND stream_id = '7' ORDER BY event_number DESC LIMIT 1")(lambda s, d: reads.read_last_event_in_stream(log(s, d), "seg2", "7").select(COLUMNS))
query("last_event_per_stream", f"SELECT {SHOWN} FROM ev WHERE stream_category = 'seg1' QUALIFY row_number() OVER (PARTITION BY stream_category, stream_id ORDER BY event_number DESC) = 1")(
    lambda s, d: reads.last_event_per_stream(reads.in_categories(log(s, d), "seg1")).select(COLUMNS)
)


@query("stream_existence", "SELECT 'seg2' AS stream_category, '7' AS stream_id, true AS found UNION ALL SELECT 'seg2', '8', false")
def _(s, d):
    ids = [("seg2", "7"), ("seg2", "8")]
    return s.createDataFrame([(c, i, reads.stream_exists(unnumbered(s, d), c, i)) for c, i in ids], "stream_category string, stream_id string, found boolean")


query("stream_versions", "SELECT stream_category, stream_id, max(event_number) AS version FROM ev GROUP BY ALL")(lambda s, d: reads.stream_versions(log(s, d)))
query("version_at_effective_time", "SELECT coalesce(max(position), 0) AS version FROM ev WHERE effective_ts < timestamp '2024-01-02 00:00:00'")(lambda s, d: reads.version_at(unnumbered(s, d), ntz("2024-01-02"), "effective_ts"))
query("locators", "SELECT position, '<' || stream_category || '/' || stream_id || '/' || event_number || '>(' || event_type || ')' AS locator FROM ev")(lambda s, d: log(s, d).select("position", locator().alias("locator")))

# Transformations

query("filter", f"SELECT {SHOWN_PLAIN} FROM ev WHERE event_type = 'error' AND stream_category <> 'seg0'")(lambda s, d: unnumbered(s, d).transform(transform.filtering((F.col("event_type") == "error") & (F.col("stream_category") != "seg0"))).select(PLAIN))
query("filter_last_event", f"SELECT {SHOWN_PLAIN} FROM (SELECT * FROM ev ORDER BY position DESC LIMIT 1) WHERE event_type = 'click'")(lambda s, d: transform.filtered_last_event(unnumbered(s, d), F.col("event_type") == "click").select(PLAIN))
query("filter_event_types", f"SELECT {SHOWN_PLAIN} FROM ev WHERE event_type IN ('signup', 'purchase')")(lambda s, d: unnumbered(s, d).transform(transform.containing_event_types("signup", "purchase")).select(PLAIN))
query("exclude_events_before", f"SELECT {SHOWN_PLAIN} FROM ev WHERE \"timestamp\" >= timestamp '2024-01-02 00:00:00'")(lambda s, d: unnumbered(s, d).transform(transform.excluding_events_before(ntz("2024-01-02"))).select(PLAIN))
query("transform_events", "SELECT position * 10 AS position, upper(event_type) AS event_type, data FROM ev")(
    lambda s, d: unnumbered(s, d).transform(transform.transforming(position=F.col("position") * 10, event_type=F.upper("event_type"))).select("position", "event_type", "data")
)
query("transform_records", "SELECT position, event_type || '!' AS event_type, data FROM ev")(
    lambda s, d: unnumbered(s, d).select("position", "event_type", "data").transform(transform.transforming_records(lambda p: p.assign(event_type=p.event_type + "!")))
)
query("backdate", "SELECT position, CASE WHEN effective_ts < timestamp '2024-01-02 00:00:00' THEN timestamp '1970-01-01 00:00:00' ELSE effective_ts END AS effective_ts FROM ev")(
    lambda s, d: unnumbered(s, d).transform(transform.backdating_column("effective_ts", ntz("2024-01-02"), ntz("1970-01-01"))).select("position", "effective_ts")
)
query(
    "backdate_metadata",
    f"""SELECT position, CASE WHEN effective_ts < timestamp '2024-01-02 00:00:00' THEN '{{"effective_timestamp":"1970-01-01T00:00:00Z"}}' ELSE {METADATA_SQL} END AS metadata FROM ev""",
)(lambda s, d: with_metadata(unnumbered(s, d)).transform(transform.backdating("2024-01-02T00:00:00Z")).select("position", "metadata"))
query("rekey", "SELECT position, 'all' AS stream_category, 'one' AS stream_id, cast(row_number() OVER (ORDER BY position) AS bigint) - 1 AS event_number FROM ev WHERE stream_category = 'seg4'")(
    lambda s, d: unnumbered(s, d).where("stream_category = 'seg4'").transform(transform.rekeying("all", "one", width=4096)).select("position", "stream_category", "stream_id", "event_number")
)
query("rekey_resumed", "SELECT position, cast(row_number() OVER (ORDER BY position) AS bigint) + 41 AS event_number FROM ev WHERE position > 500")(
    lambda s, d: reads.read_all_forwards(unnumbered(s, d), 500).transform(transform.rekeying("all", "one", 41, width=4096)).select("position", "event_number")
)

_REORDERED = """, f AS (SELECT *, max(CASE WHEN effective_ts >= timestamp '{cut}' THEN 1 ELSE 0 END) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS tail FROM ev),
 r AS (SELECT cast(row_number() OVER (ORDER BY tail, CASE WHEN tail = 0 THEN effective_ts END, position) AS bigint) AS rank, position FROM f WHERE (SELECT max(tail) FROM f) = 1)
 SELECT rank, position FROM r"""
query("reorder", _REORDERED.format(cut="2024-01-03 00:00:00"))(lambda s, d: unnumbered(s, d).transform(transform.reordering(ntz("2024-01-03"), "effective_ts")).select("rank", "position"))
query("reorder_without_cutoff", _REORDERED.format(cut="2999-01-01 00:00:00"))(lambda s, d: unnumbered(s, d).transform(transform.reordering(ntz("2999-01-01"), "effective_ts")).select("rank", "position"))
query("reorder_resumed", _REORDERED.format(cut="2024-01-03 00:00:00") + " WHERE rank > (SELECT rank FROM r WHERE position = 60)")(
    lambda s, d: unnumbered(s, d).transform(transform.reordering(ntz("2024-01-03"), "effective_ts", after=60)).select("rank", "position")
)
query("flow", "SELECT position, 'all' AS stream_category, 'errors' AS stream_id, cast(row_number() OVER (ORDER BY position) AS bigint) - 1 AS event_number FROM ev WHERE event_type = 'error' AND \"timestamp\" >= timestamp '2024-01-02 00:00:00'")(
    lambda s, d: unnumbered(s, d)
    .transform(transform.flow(transform.containing_event_types("error"), transform.excluding_events_before(ntz("2024-01-02")), transform.rekeying("all", "errors")))
    .select("position", "stream_category", "stream_id", "event_number")
)
query("single_category_reader", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category = 'seg0'")(lambda s, d: unnumbered(s, d).transform(transform.single_category("seg0")).select(PLAIN))
query("multiple_category_reader", f"SELECT {SHOWN_PLAIN} FROM ev WHERE stream_category IN ('seg0', 'seg4')")(lambda s, d: unnumbered(s, d).transform(transform.several_categories("seg0", "seg4", "seg0")).select(PLAIN))

# Merges


def _inputs(s, d, *categories: str, after: int | None = None) -> list[merge.Input]:
    return [merge.Input(c, reads.in_categories(with_metadata(unnumbered(s, d)), c), after) for c in categories]


def _merged_sql(categories: list[str], key: str, where: str = "true", columns: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT {k} AS input_idx, * FROM ev WHERE stream_category = '{c}'" for k, c in enumerate(categories))
    return f""", u AS (SELECT * FROM ({union}) WHERE {where}),
 k AS (SELECT *, max({key}) OVER (PARTITION BY input_idx ORDER BY position ROWS UNBOUNDED PRECEDING) AS mk FROM u),
 m AS (SELECT cast(row_number() OVER (ORDER BY mk, input_idx, position) AS bigint) AS merge_rank, cast(input_idx AS integer) AS input_idx, position FROM k)
 SELECT merge_rank, input_idx, position{columns} FROM m"""


RANKED = ["merge_rank", "input_idx", "position"]
query("merge_by_effective_time", _merged_sql(["seg1", "seg2"], "effective_ts"))(lambda s, d: merge.merge(_inputs(s, d, "seg1", "seg2"), F.col("effective_ts")).select(RANKED))
query("merge_by_metadata", _merged_sql(["seg1", "seg2", "seg3"], "effective_ts"))(lambda s, d: merge.merge(_inputs(s, d, "seg1", "seg2", "seg3"), merge.by_effective_timestamp()).select(RANKED))


@query("merge_with_fallback", _merged_sql(["seg1", "seg2"], "CASE WHEN event_type = 'view' THEN \"timestamp\" ELSE effective_ts END"))
def _(s, d):
    bare = lambda i: merge.Input(i.name, i.log.withColumn("metadata", F.when(F.col("event_type") == "view", F.lit("{}")).otherwise(F.col("metadata"))))
    return merge.merge([bare(i) for i in _inputs(s, d, "seg1", "seg2")], merge.by_effective_timestamp(fall_back_to_timestamp=True)).select(RANKED)


query("merge_by_stream_index", _merged_sql(["seg3", "seg1", "seg2"], "0"))(lambda s, d: merge.merge(_inputs(s, d, "seg3", "seg1", "seg2"), merge.by_stream_index()).select(RANKED))
query("merge_by_custom_key", _merged_sql(["seg1", "seg2"], "date_trunc('hour', effective_ts)"))(lambda s, d: merge.merge(_inputs(s, d, "seg1", "seg2"), F.date_trunc("hour", "effective_ts").cast("timestamp_ntz")).select(RANKED))
query(
    "merge_with_horizon",
    _merged_sql(["seg1", "seg2"], "effective_ts", "true").replace(
        "WHERE true)", "WHERE true QUALIFY max(CASE WHEN effective_ts > timestamp '2024-01-03 00:00:00' THEN 1 ELSE 0 END) OVER (PARTITION BY input_idx ORDER BY position ROWS UNBOUNDED PRECEDING) = 0)"
    ),
)(lambda s, d: merge.merge([merge.Input(i.name, i.log.withColumn("timestamp", F.col("effective_ts"))) for i in _inputs(s, d, "seg1", "seg2")], F.col("effective_ts"), snapshot=ntz("2024-01-03")).select(RANKED))
query(
    "merge_positions",
    _merged_sql(["seg1", "seg2"], "effective_ts", "position > 100").replace(
        "SELECT merge_rank, input_idx, position FROM m",
        """SELECT merge_rank, coalesce(last_value(CASE WHEN input_idx = 0 THEN position END IGNORE NULLS) OVER (ORDER BY merge_rank ROWS UNBOUNDED PRECEDING), 100) AS position_seg1,
 coalesce(last_value(CASE WHEN input_idx = 1 THEN position END IGNORE NULLS) OVER (ORDER BY merge_rank ROWS UNBOUNDED PRECEDING), 100) AS position_seg2 FROM m""",
    ),
)(lambda s, d: merge.merge(_inputs(s, d, "seg1", "seg2", after=100), F.col("effective_ts"), positions=True).select("merge_rank", F.col("position_seg1").cast("long"), F.col("position_seg2").cast("long")))
query("merge_until_first_dry", _merged_sql(["seg1", "seg2"], "effective_ts", "effective_ts <= timestamp '2024-01-03 00:00:00' - interval 3600 second"))(
    lambda s, d: merge.merge_until_first_dry(_inputs(s, d, "seg1", "seg2"), F.col("effective_ts"), ntz("2024-01-03"), 3600).select(RANKED)
)

# Stitching


def _backfill(s, d) -> DataFrame:
    """Old events under positions of their own."""
    return unnumbered(s, d).where("position <= 400 and event_type <> 'view'").withColumn("position", F.col("position") * 2).select(PLAIN)


_BACKFILL = "b AS (SELECT position * 2 AS position, stream_category, stream_id, event_type, data FROM ev WHERE position <= 400 AND event_type <> 'view')"
_STITCHED = f""", {_BACKFILL}
 SELECT 0 AS part, position || '~~~400' AS stitched, position, event_type FROM b WHERE {{old}}
 UNION ALL SELECT 1, (SELECT max(position) FROM b WHERE {{cat}}) || '~~~' || position, position, event_type FROM ev WHERE position > {{start}} AND {{cat}}"""
STITCHED = ["part", "stitched", "position", "event_type"]
query("stitch", _STITCHED.format(old="true", start=400, cat="true"))(lambda s, d: stitch.stitch(_backfill(s, d), unnumbered(s, d).select(PLAIN), 400).select(STITCHED))
query("stitch_resumed_in_backfill", _STITCHED.format(old="position > 300", start=400, cat="true"))(lambda s, d: stitch.stitch(_backfill(s, d), unnumbered(s, d).select(PLAIN), 400, after_backfill=300).select(STITCHED))
query("stitch_resumed_in_live", _STITCHED.format(old="false", start=450, cat="true"))(lambda s, d: stitch.stitch(_backfill(s, d), unnumbered(s, d).select(PLAIN), 400, after_live=450).select(STITCHED))
query("stitch_category", _STITCHED.format(old="stream_category = 'seg1'", start=400, cat="stream_category = 'seg1'"))(lambda s, d: stitch.stitch_category(_backfill(s, d), unnumbered(s, d).select(PLAIN), "seg1", 400).select(STITCHED))
query("stitch_legacy", f", {_BACKFILL} SELECT position, event_type FROM b WHERE position > 10 UNION ALL SELECT position, event_type FROM ev WHERE position > 400")(lambda s, d: stitch.stitch_legacy(_backfill(s, d), unnumbered(s, d).select(PLAIN), 400, 10).select("position", "event_type"))
query("archive_to_live", f"SELECT {SHOWN_PLAIN} FROM ev WHERE position > 150")(lambda s, d: stitch.archive_to_live(unnumbered(s, d).where("position <= 600"), unnumbered(s, d).where("position > 200"), 600, 150).select(PLAIN))

# Clocks

query("clock_days", "SELECT i AS position, timestamp '2024-02-20 00:00:00' + to_days(cast(i AS integer)) AS at, 'DayPassed' AS event_type FROM range(13) t(i)")(
    lambda s, d: clock.periods(s, dt.date(2024, 2, 20), dt.datetime(2024, 3, 3, 12)).select("position", F.col("timestamp").cast("timestamp_ntz").alias("at"), "event_type")
)
query("clock_months", "SELECT i AS position, cast(date '2024-01-31' + to_months(cast(i AS integer)) AS timestamp) AS at, i AS event_number FROM range(1, 14) t(i)")(
    lambda s, d: clock.periods(s, dt.date(2024, 1, 31), dt.datetime(2025, 2, 28, 0, 0), months=True, after=0).select("position", F.col("timestamp").cast("timestamp_ntz").alias("at"), "event_number")
)
query("clock_ticks", "SELECT 1704067200000 + (i + 1) * 10000 AS position, epoch_ms(1704067200000 + (i + 1) * 10000) AS at, cast(-1 AS bigint) AS event_number FROM range(3599) t(i)")(
    lambda s, d: clock.ticks(s, 1704067200000, 1704067200000 + 35_999_999, 10_000).select("position", F.col("timestamp").cast("timestamp_ntz").alias("at"), "event_number")
)

# Writing


def _split(s, d, at: int = 600) -> tuple[DataFrame, DataFrame]:
    """What is stored, and what is new."""
    whole = log(s, d)
    return whole.where(F.col("position") <= at), whole.where(F.col("position") > at)


@query("append_numbering", "SELECT position, stream_category, stream_id, event_number FROM ev WHERE position > 600")
def _(s, d):
    old, new = _split(s, d)
    fresh = new.select(F.col("position").alias("ord"), "stream_category", "stream_id", "event_type", "data")
    return append.number(old, fresh).select("position", "stream_category", "stream_id", "event_number")


def _requests(s, d) -> tuple[DataFrame, DataFrame]:
    old, new = _split(s, d)
    asked = new.groupBy("stream_category", "stream_id").agg(F.min("event_number").alias("first"), F.min("position").alias("p"))
    return append.split_requests(old, asked.select("stream_category", "stream_id", (F.col("first") - 1 - F.col("p") % 2).alias("expected_version")))


_ASKED = ", q AS (SELECT stream_category, stream_id, min(event_number) - 1 AS current_version, min(event_number) - 1 - min(position) % 2 AS expected_version FROM ev WHERE position > 600 GROUP BY ALL)"
query("write_requests_accepted", f"{_ASKED} SELECT stream_category, stream_id, expected_version FROM q WHERE expected_version = current_version")(lambda s, d: _requests(s, d)[0])
query("write_requests_refused", f"{_ASKED} SELECT stream_category, stream_id, expected_version, current_version FROM q WHERE expected_version <> current_version")(lambda s, d: _requests(s, d)[1])


def _repeated(s, d) -> tuple[DataFrame, DataFrame]:
    whole = log(s, d)
    again = whole.where("position > 500").withColumn("data", F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(F.col("data")))
    return whole.where("position <= 600"), again


query("idempotent_overlap", "SELECT position, event_type <> 'error' AS compatible FROM ev WHERE position > 500 AND position <= 600")(lambda s, d: append.overlap(*_repeated(s, d)).select("position", "compatible"))
query("idempotent_surplus", f"SELECT {SHOWN} FROM ev WHERE position > 600")(lambda s, d: append.surplus(_split(s, d)[0], log(s, d).where("position > 500")).select(COLUMNS))


@query("json_compatibility", "SELECT position, CASE WHEN position % 3 = 0 THEN '/k' END AS difference FROM ev")
def _(s, d):
    current = unnumbered(s, d).select("position", "data")
    new = F.when(F.col("position") % 3 == 0, F.lit('{"other": 1}')).when(F.col("position") % 3 == 1, F.regexp_replace("data", r"\}$", ', "more": [1, null]}')).otherwise(F.regexp_replace("data", ": ", ":  "))
    return current.select("position", json_difference(F.col("data"), new).alias("difference"))


@query("store_write_and_read", f"SELECT {SHOWN} FROM ev")
def _(s, d):
    """Two appends to a new Parquet store, read back."""
    store = LogStore(s, _folder(s, "store"))
    old, new = _split(s, d)
    for part in (old, new):
        binary = [F.col(c).cast("binary").alias(c) for c in ("data",)]
        store.append(part.select(F.col("position").alias("ord"), "stream_category", "stream_id", "event_type", *binary, F.lit(b"").alias("metadata")))
    return store.log.withColumn("data", F.col("data").cast("string")).select(COLUMNS)


@query("store_rewrite", f"SELECT {SHOWN} FROM ev")
def _(s, d):
    """Events with their numbers written to a store, and then all again with half of them stored."""
    store, whole = LogStore(s, _folder(s, "store")), _binary(log(s, d))
    store.write_numbered(whole.where("position <= 600"))
    store.write_numbered(whole)
    return store.log.withColumn("data", F.col("data").cast("string")).select(COLUMNS)


@query("legacy_write", "SELECT position AS version, effective_ts AS effective_timestamp, event_type, data AS body FROM ev")
def _(s, d):
    """Two appends to a table of the older kind, whose versions go on from its largest."""
    store = legacy.LegacyStore(s, _folder(s, "legacy"))
    rows = with_metadata(unnumbered(s, d)).select(F.col("position").alias("ord"), F.lit("all").alias("stream_category"), F.lit("all").alias("stream_id"), "event_type", *(F.col(c).cast("binary").alias(c) for c in ("data", "metadata")))
    store.append(rows.where("ord <= 600"))
    store.append(rows.where("ord > 600"))
    return store.page().select("version", F.col("effective_timestamp").cast("timestamp_ntz").alias("effective_timestamp"), "event_type", F.col("body").cast("string").alias("body"))


query("legacy_page", "SELECT position AS version, event_type FROM ev WHERE position > 300 ORDER BY position LIMIT 500")(
    lambda s, d: unnumbered(s, d).select(F.col("position").alias("version"), "event_type").transform(lambda t: legacy.page(t, 300, 500))
)


@query("legacy_events", "SELECT position, 'all' AS stream_category, 'all' AS stream_id, position - 1 AS event_number, event_type, regexp_replace('{\"effective_timestamp\":\"' || strftime(effective_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"}', '(\\.000000|000)Z', CASE WHEN microsecond(effective_ts) % 1000000 = 0 THEN 'Z' WHEN microsecond(effective_ts) % 1000 = 0 THEN 'Z' ELSE '\\1Z' END) AS metadata FROM ev")
def _(s, d):
    table = unnumbered(s, d).select(F.col("position").alias("version"), F.col("effective_ts").alias("effective_timestamp"), "event_type", F.col("data").cast("binary").alias("body"))
    return legacy.from_legacy(table).withColumn("metadata", F.col("metadata").cast("string")).select("position", "stream_category", "stream_id", "event_number", "event_type", "metadata")


query("legacy_table", "SELECT position AS version, effective_ts AS effective_timestamp, event_type FROM ev")(
    lambda s, d: legacy.to_legacy(with_metadata(unnumbered(s, d))).select("version", F.col("effective_timestamp").cast("timestamp_ntz").alias("effective_timestamp"), "event_type")
)

# Shovelling

_RUNS = """, i AS (SELECT *, CASE WHEN stream_category IS NOT DISTINCT FROM lag(stream_category) OVER (ORDER BY position) THEN 0 ELSE 1 END AS s FROM ev),
 r AS (SELECT *, cast(sum(s) OVER (ORDER BY position ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM i),
 c AS (SELECT *, cast(floor((row_number() OVER (PARTITION BY run ORDER BY position) - 1) / 2) AS bigint) AS chunk FROM r)"""
query("shovel_runs_and_chunks", f"{_RUNS} SELECT position, run, chunk FROM c")(lambda s, d: shovel.runs_and_chunks(unnumbered(s, d), F.col("stream_category"), 2).select("position", "run", "chunk"))
query("shovel_checkpoints", f"{_RUNS} SELECT position, position = max(position) OVER (PARTITION BY run, chunk) AS checkpoint FROM c")(lambda s, d: shovel.with_checkpoints(shovel.runs_and_chunks(unnumbered(s, d), F.col("stream_category"), 2)).select("position", "checkpoint"))


@query(
    "shovel",
    _RUNS.replace("stream_category IS NOT DISTINCT FROM lag(stream_category) OVER (ORDER BY position)", "stream_id IS NOT DISTINCT FROM lag(stream_id) OVER (ORDER BY position)")
    + f""" SELECT position, 'copy' AS stream_category, stream_id, event_number, run, chunk, min(event_number) OVER (PARTITION BY run, chunk) - 1 AS expected_version,
 CASE WHEN position = max(position) OVER (PARTITION BY run, chunk) THEN left({METADATA_SQL}, -1) || ',"shovel_position":"' || position || '"}}' ELSE {METADATA_SQL} END AS metadata FROM c""",
)
def _(s, d):
    return shovel.shovel(with_metadata(log(s, d)), "copy", 2).select("position", "stream_category", "stream_id", "event_number", "run", "chunk", "expected_version", "metadata")


@query("shovel_resume", "SELECT cast(700 AS bigint) AS resume_position, count(*) AS left_over FROM ev WHERE position > 700")
def _(s, d):
    output = shovel.shovel(with_metadata(log(s, d)).where("position <= 700"), "copy")
    at = shovel.resume_position(output, "copy")
    return unnumbered(s, d).where(F.col("position") > at).agg(F.lit(at).cast("long").alias("resume_position"), F.count("*").alias("left_over"))


@query("shovel_copy", f"SELECT position, 'copy' AS stream_category, stream_id, event_number, event_type, data FROM ev")
def _(s, d):
    """A log copied in two runs, the second from the first one's checkpoint."""
    store, whole = LogStore(s, _folder(s, "copy")), _metadata_as_binary(with_metadata(log(s, d)))
    shovel.copy_new(whole.where("position <= 600"), store, "copy")
    shovel.copy_new(whole, store, "copy")
    return store.log.withColumn("data", F.col("data").cast("string")).select(COLUMNS)


def _metadata_as_binary(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("binary") for c in ("data", "metadata")}).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


# Comparing


def _sides(s, d) -> tuple[DataFrame, DataFrame]:
    """A log, and a copy with bodies changed, types changed, and events left out."""
    a = with_metadata(unnumbered(s, d))
    b = a.withColumn("data", F.when(F.col("position") % 10 == 3, F.lit("{}")).otherwise(F.col("data"))).where("position % 97 <> 5")
    return diff.diff_events(a), diff.diff_events(b)


query("diff_events", f"SELECT position, strftime(effective_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts, event_type AS type, data AS body FROM ev")(lambda s, d: diff.diff_events(with_metadata(unnumbered(s, d))))


@query("diff_similarity", "SELECT position, 3 - cast(position % 2 = 0 AS integer) - cast(position % 3 = 0 AS integer) AS same FROM ev")
def _(s, d):
    a = diff.diff_events(with_metadata(unnumbered(s, d)))
    b = a.withColumn("type", F.when(F.col("position") % 2 == 0, "other").otherwise(F.col("type"))).withColumn("body", F.when(F.col("position") % 3 == 0, "other").otherwise(F.col("body")))
    return a.alias("a").join(b.alias("b"), "position").select("position", diff.agreeing().alias("same"))


@query("diff_in_step", "SELECT position - 1 AS seq, CASE WHEN position % 10 = 3 THEN 'similar' ELSE 'matching' END AS class, position AS a_position, position AS b_position FROM ev")
def _(s, d):
    a = diff.diff_events(with_metadata(unnumbered(s, d)))
    b = a.withColumn("body", F.when(F.col("position") % 10 == 3, F.lit("{}")).otherwise(F.col("body")))
    return diff.diff(a, b).select("seq", "class", "a_position", "b_position")


#: The walk of two pointers, a step an iteration, and what each step paired.
_WALK = f"""-- two pointers
WITH RECURSIVE {LOG_SQL},
 la AS MATERIALIZED (SELECT row_number() OVER (ORDER BY position) - 1 AS i, position AS p, strftime(effective_ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts, event_type AS t, data AS body FROM ev),
 lb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p) - 1 AS j, p, ts, t, CASE WHEN p % 10 = 3 THEN '{{}}' ELSE body END AS body FROM la WHERE p % 97 <> 5),
 r AS (SELECT cast(0 AS bigint) AS seq, cast(0 AS bigint) AS i, cast(0 AS bigint) AS j
   UNION ALL SELECT seq + 1, i + cast(c <> 'b' AS bigint), j + cast(c <> 'a' AS bigint) FROM (
     SELECT r.seq, r.i, r.j, CASE WHEN lb.j IS NULL THEN 'a' WHEN la.i IS NULL THEN 'b'
       WHEN cast(la.ts = lb.ts AS integer) + cast(la.t = lb.t AS integer) + cast(la.body = lb.body AS integer) >= 2 THEN 'both' WHEN la.ts <= lb.ts THEN 'a' ELSE 'b' END AS c
     FROM r LEFT JOIN la ON la.i = r.i LEFT JOIN lb ON lb.j = r.j WHERE la.i IS NOT NULL OR lb.j IS NOT NULL)),
 s AS (SELECT seq, i, j, lead(i) OVER (ORDER BY seq) > i AS has_a, lead(j) OVER (ORDER BY seq) > j AS has_b FROM r),
 compared AS (SELECT seq, CASE WHEN NOT has_b THEN 'unmatched_a' WHEN NOT has_a THEN 'unmatched_b' WHEN la.ts = lb.ts AND la.t = lb.t AND la.body = lb.body THEN 'matching' ELSE 'similar' END AS class,
   la.p AS a_position, lb.p AS b_position, la.ts AS a_ts, la.t AS a_type, lb.ts AS b_ts, lb.t AS b_type
   FROM s LEFT JOIN la ON la.i = s.i AND has_a LEFT JOIN lb ON lb.j = s.j AND has_b WHERE has_a OR has_b)"""
query("diff_walk", f"{_WALK} SELECT * FROM compared")(lambda s, d: diff.diff(*_sides(s, d)))
query(
    "diff_summary",
    f"""{_WALK}, sides AS (SELECT seq, class, 'a' AS side, a_type AS type, a_ts AS ts FROM compared WHERE a_position IS NOT NULL UNION ALL SELECT seq, class, 'b', b_type, b_ts FROM compared WHERE b_position IS NOT NULL)
 SELECT class, side, type, count(*) AS n, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts FROM sides GROUP BY class, side, type""",
)(lambda s, d: diff.summary(diff.diff(*_sides(s, d))))
query("diff_samples", f"{_WALK} SELECT * FROM compared QUALIFY row_number() OVER (PARTITION BY class ORDER BY seq) <= 20")(lambda s, d: diff.samples(diff.diff(*_sides(s, d)), 20))

# Archives

_BATCHED = ", b AS (SELECT *, (position - 1) // 128 AS batch FROM ev)"
_STATISTICS = """min(position) AS min_position, max(position) AS max_position, count(*) AS event_count, arg_max("timestamp", position) AS last_timestamp,
 arg_max(stream_category, position) AS last_category, arg_max(stream_id, position) AS last_stream_id, arg_max(event_type, position) AS last_event_type"""
query("archive_batches", f"{_BATCHED} SELECT position, batch FROM b")(lambda s, d: batches.batched(unnumbered(s, d), 128).select("position", "batch"))
query("batch_statistics", f"{_BATCHED} SELECT batch, {_STATISTICS} FROM b GROUP BY batch")(lambda s, d: batches.batch_statistics(batches.batched(unnumbered(s, d), 128)))
query("complete_batches", f"{_BATCHED} SELECT batch, {_STATISTICS} FROM b GROUP BY batch HAVING count(*) = 128")(lambda s, d: batches.complete_batches(batches.batched(unnumbered(s, d), 128), 128))


@query("dead_store_batches", f"{_BATCHED} SELECT batch, {_STATISTICS} FROM b GROUP BY batch")
def _(s, d):
    end = unnumbered(s, d).agg(F.max("position")).first()[0]
    return batches.complete_batches(batches.batched(unnumbered(s, d), 128), 128, end)


query("archive_staleness", "SELECT position AS live, position - 350 AS archived, position > 300 AND 350 > 300 AS stale FROM ev")(
    lambda s, d: unnumbered(s, d).select(F.col("position").alias("live"), (F.col("position") - 350).alias("archived")).withColumn("stale", batches.is_stale(F.col("live"), F.col("archived"), 100))
)
query("archive_keys", "SELECT position, 'store/' || lpad(cast(position AS varchar), 32, '0') || '.gz' AS key, position AS parsed FROM ev")(
    lambda s, d: unnumbered(s, d).select("position", names.archive_key("store", F.col("position")).alias("key")).withColumn("parsed", names.archive_key_position(F.col("key")))
)
query("archive_members", "SELECT position, lpad(lower(to_hex(position + 9)), 8, '0') || '.' || stream_category || '.' || stream_id || '.' || event_number || '.' || event_type || '.data' AS member FROM ev")(
    lambda s, d: archives.cpio_members(log(s, d).withColumn("metadata", F.lit(b"")), 10).select("position", "member")
)


def _binary(df: DataFrame) -> DataFrame:
    return df.withColumn("data", F.col("data").cast("binary")).withColumn("metadata", F.lit(b"")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@query("framed_archive_round_trip", f"SELECT {SHOWN}, \"timestamp\" AS at FROM ev WHERE position > 200 AND position <= (SELECT max(position) FROM ev) // 256 * 256")
def _(s, d):
    folder = _folder(s, "framed")
    archives.write_framed(_binary(log(s, d)), folder, "store", 256).count()
    return archives.read_framed(s, folder, "store", 200).withColumn("data", F.col("data").cast("string")).select(*COLUMNS, F.col("timestamp").cast("timestamp_ntz").alias("at"))


@query("framed_archive_cap", "SELECT position FROM ev WHERE position > 200 AND position <= 512")
def _(s, d):
    folder = _folder(s, "framed")
    archives.write_framed(_binary(log(s, d)), folder, "store", 256).count()
    return archives.read_framed(s, folder, "store", 200, max_position=600).select("position")


@query("framed_archive_last_event", f"SELECT {SHOWN} FROM ev WHERE position = (SELECT max(position) FROM ev) // 256 * 256")
def _(s, d):
    folder = _folder(s, "framed")
    archives.write_framed(_binary(log(s, d)), folder, "store", 256).count()
    return archives.last_framed_event(s, folder, "store").withColumn("data", F.col("data").cast("string")).select(COLUMNS)


@query("cpio_archive_round_trip", "SELECT lpad(lower(to_hex(position - 1)), 8, '0') || '.' || stream_category || '.' || stream_id || '.' || event_number || '.' || event_type AS position, stream_id, event_number, data FROM ev WHERE position > 300")
def _(s, d):
    folder = _folder(s, "cpio")
    archives.write_cpio(_binary(log(s, d)), folder, per_file=700).count()
    after = F.lpad(F.lower(F.hex(F.lit(300))), 8, "0")
    return archives.read_cpio(s, folder).where(F.col("position") >= after).select("position", "stream_id", "event_number", F.col("data").cast("string").alias("data"))


@query("cpio_incremental", "SELECT position AS place, stream_id, event_number FROM ev")
def _(s, d):
    """An archive made in two runs, the second from the boundary that the first left."""
    folder, whole = _folder(s, "cpio"), _binary(log(s, d))
    archives.archive_new_events(whole.where("position <= 600"), folder, create_initial=True, per_file=500)
    archives.archive_new_events(whole, folder, per_file=500)
    place = F.conv(F.substring("position", 1, 8), 16, 10).cast("long") + 1
    return archives.read_cpio(s, folder).select(place.alias("place"), "stream_id", "event_number")


@query("framed_archive_end", "SELECT (SELECT max(position) FROM ev) // 256 * 256 AS max_position")
def _(s, d):
    folder = _folder(s, "framed")
    archives.write_framed(_binary(log(s, d)), folder, "store", 256).count()
    return s.createDataFrame([(archives.max_archived_position(s, folder, "store"),)], "max_position long")


@query("cache_round_trip", f"SELECT {SHOWN}, (SELECT max(position) FROM ev) AS last_position FROM ev")
def _(s, d):
    """A log written as cache files and read back, with the position of the last record."""
    folder = _folder(s, "cache")
    archives.write_cache(_binary(log(s, d)), folder, 500).count()
    last = int(archives.last_cached_position(s, folder))
    rows = archives.read_cache(s, folder).withColumns({"position": F.col("position").cast("long"), "data": F.col("data").cast("string")})
    return rows.select(*COLUMNS, F.lit(last).cast("long").alias("last_position"))


@query("flat_files_round_trip", f"SELECT {SHOWN} FROM ev")
def _(s, d):
    """Two appends to a folder with a file for each event, and its names and contents read back."""
    folder = _folder(s, "flat")
    rows = _binary(unnumbered(s, d)).withColumnRenamed("position", "ord")
    archives.write_flat(rows.where("ord <= 600"), folder)
    archives.write_flat(rows.where("ord > 600"), folder)
    place = F.conv(F.substring("position", 1, 8), 16, 10).cast("long")
    return archives.read_flat(s, folder).withColumns({"position": place, "data": F.col("data").cast("string")}).select(COLUMNS)


@query("archive_then_live", "SELECT position AS event_number_in_log, event_type FROM ev")
def _(s, d):
    folder = _folder(s, "cpio")
    rekeyed = _binary(unnumbered(s, d)).withColumn("stream_category", F.lit("all")).withColumn("stream_id", F.lit("one")).withColumn("event_number", F.col("position"))
    archives.write_cpio(rekeyed.where("position <= 500"), folder, per_file=300).count()
    live = rekeyed.select("position", "timestamp", "stream_category", "stream_id", "event_number", "event_type", "data", "metadata")
    return archives.read_archive_then_live(s, folder, live).select(F.col("event_number").alias("event_number_in_log"), "event_type")


# Subscription and health


@query("subscription", f"SELECT {SHOWN_PLAIN} FROM ev WHERE position > 250 AND event_type <> 'view'")
def _(s, d):
    """A stream over the log's files, decoded and appended to a folder batch by batch."""
    source, out = _folder(s, "stream-in"), _folder(s, "stream-out")
    events = unnumbered(s, d).select(PLAIN)
    events.repartitionByRange(3, "position").write.parquet(source)
    own = Subscription(s, "query", source, [lambda b: b.write.mode("append").parquet(out)], f"{out}-offsets", start_position=250, decode=lambda b: b.where("event_type <> 'view'"), schema=events.schema)
    own.catch_up()
    return s.read.schema(events.schema).parquet(out)


query("health_thresholds", "SELECT position, CASE WHEN position > 300 THEN 'CRITICAL' WHEN position > 30 THEN 'WARNING' ELSE 'OK' END AS status FROM ev")(
    lambda s, d: unnumbered(s, d).select("position", Threshold.ratio(30, 10).column(F.col("position")).alias("status"))
)


@query("orders_and_events_merged", """, u AS (SELECT 0 AS input_idx, position, effective_ts AS k FROM ev UNION ALL SELECT 1, o_orderkey, cast(o_orderdate AS timestamp) FROM orders),
 m AS (SELECT *, max(k) OVER (PARTITION BY input_idx ORDER BY position ROWS UNBOUNDED PRECEDING) AS mk FROM u)
 SELECT cast(row_number() OVER (ORDER BY mk, input_idx, position) AS bigint) AS merge_rank, cast(input_idx AS integer) AS input_idx, position FROM m""")
def _(s, d):
    """Two tables as logs: orders by key, events by id, merged by time."""
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("position"), F.col("o_orderdate").cast("timestamp_ntz").alias("k"))
    return merge.merge([merge.Input("events", unnumbered(s, d).select("position", F.col("effective_ts").alias("k"))), merge.Input("orders", orders)], F.col("k")).select(RANKED)


