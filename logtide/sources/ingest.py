"""Reading raw logs, separating bad lines, idempotent loading, deduplication, layout and retention."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship_package

#: A few typed fields that every raw record may carry; more come as declared by the caller.
BASE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()), T.StructField("ip", T.StringType()), T.StructField("status", T.IntegerType()),
        T.StructField("elapsed", T.LongType()), T.StructField("cache", T.StringType()), T.StructField("resp_bytes", T.LongType()),
        T.StructField("url", T.StringType()), T.StructField("method", T.StringType()), T.StructField("ua", T.StringType()), T.StructField("rid", T.StringType()),
    ]
)

# One-letter codes of the raw log and the words they stand for.
CODES = {
    "c_speed": {
        "B": "broadband", "C": "cable", "D": "dialup", "M": "mobile", "2": "oc12", "3": "oc3", "1": "t1", "T": "t3",
        "S": "satellite", "W": "wireless", "X": "xdsl",
    },
    "p_type": {
        "A": "anonymous", "O": "aol", "K": "blackberry", "P": "consumer-privacy", "C": "corporate", "E": "edu",
        "H": "hosting", "U": "public", "T": "transparent",
    },
    "p_desc": {
        "a": "apple", "c": "cloud", "s": "cloud-security", "d": "dns", "g": "google", "x": "tor-exit", "r": "tor-relay",
        "v": "vpn", "w": "web-browser",
    },
}


#: First bytes of gzip and zstd containers, and bytes that are decoded at a time.
_GZIP, _ZSTD, _PIECE = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", 1 << 20
_OBJECTS = "raw string, _source_file string, codec string, error string, n_bytes long"
#: Packed bytes that one task unpacks: some 50 MB of lines, of which sorts and sets hold several times as much.
_TASK_BYTES = 8 << 20


def _codec(path: str, head: bytes) -> str:
    """How an object is packed: by its first bytes, and where they tell nothing, by its name."""
    if head[:4] == _ZSTD or (head[:2] != _GZIP and path.endswith((".zst", ".zstd"))):
        return "zstd"
    return "gzip" if head[:2] == _GZIP or path.endswith(".gz") else "plain"


def _opened(data: bytes, codec: str) -> io.BufferedIOBase:
    if codec == "gzip":
        return gzip.GzipFile(fileobj=io.BytesIO(data))
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    return io.BytesIO(data)


def _fault(data: bytes, codec: str) -> str | None:
    """Why an object cannot be unpacked to its end."""
    import zstandard

    try:
        if codec == "zstd":
            # A stream that stops short is no error of the reader: the frames must end where the data ends.
            unpacker, rest = zstandard.ZstdDecompressor().decompressobj(), data
            while rest:
                unpacker.decompress(rest)
                if not unpacker.eof:
                    return "the last frame is not complete"
                rest = unpacker.unused_data
                unpacker = zstandard.ZstdDecompressor().decompressobj()
        with _opened(data, codec) as stream:
            while stream.read(_PIECE):
                pass
    except (gzip.BadGzipFile, zlib.error, zstandard.ZstdError, EOFError, OSError) as error:
        return f"{type(error).__name__}: {error}"[:2000]
    return None


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Body of :func:`decode_objects`: batches of whole objects (path, content) to batches of their lines."""

    def rows(lines: list, path: str, codec: str, error: str | None, size: int) -> pa.RecordBatch:
        n = len(lines)
        return pa.record_batch([pa.array(lines, pa.string()), pa.array([path] * n), pa.array([codec] * n), pa.array([error] * n, pa.string()), pa.array([size] * n, pa.int64())], ["raw", "_source_file", "codec", "error", "n_bytes"])

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py() or b""
            codec = _codec(path, data[:4])
            error = _fault(data, codec)
            if error is not None:
                yield rows([None], path, codec, error, len(data))
                continue
            lines: list = []
            with _opened(data, codec) as stream:
                for line in io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"):
                    lines.append(line.rstrip("\r\n"))
                    if len(lines) == 4096:
                        yield rows(lines, path, codec, None, len(data))
                        lines = []
            if lines:
                yield rows(lines, path, codec, None, len(data))


def decode_objects(objects: DataFrame, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Lines of raw objects (path, content): raw, _source_file, codec, error, n_bytes.

    Gzip, zstd and plain text are told by their first bytes.  An object is unpacked to its end before any of its lines is
    given: one that breaks has no lines, only a row with its ``error``, so that it is loaded wholly or not at all.  A task
    holds one packed object, and hands on lines a few thousand at a time; lines that are no UTF-8 keep replacement characters.
    ``change`` (path and content to path and content) runs before, in the same worker: objects that it makes larger never
    wait together for a second one.
    """
    run = decode_batches if change is None else lambda batches: decode_batches(change(batches))
    return objects.select("path", "content").mapInArrow(run, _OBJECTS)


def deal_objects(objects: DataFrame) -> DataFrame:
    """Whole objects (path, length, content) in tasks of some ``_TASK_BYTES`` packed bytes, and at most one object more.

    Scans cut their tasks by packed bytes, up to 128 MB: the lines of so many objects are a task of several million rows.
    Only packed objects are moved; each lies in the task in which it begins when all are laid one after the other by path.
    """
    total = objects.agg(F.sum("length")).first()[0]
    if not total:
        return objects
    tasks = max(-(-total // _TASK_BYTES), objects.sparkSession.sparkContext.defaultParallelism)
    # One row an object, without its content.
    start = F.sum("length").over(Window.orderBy("path")) - F.col("length")
    place = F.least(F.floor(start / F.lit(-(-total // tasks))), F.lit(tasks - 1)).cast("int")
    places = objects.select("path", place.alias("__task"))
    return objects.join(F.broadcast(places), "path").repartitionById(tasks, F.col("__task")).drop("__task")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """:func:`decode_objects` over the files under ``path``, which are log objects of some tens of megabytes."""
    ship_package(spark)
    return decode_objects(deal_objects(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)))


def parse_lines(lines: DataFrame, schema: T.StructType = BASE_SCHEMA) -> DataFrame:
    """Lines (raw, _source_file) against a declared schema; what does not parse keeps its line in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.select("raw", "_source_file").withColumn("j", F.from_json("raw", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("raw", "_source_file", "j.*")


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType = BASE_SCHEMA) -> DataFrame:
    """Raw lines (plain, gzip or zstd, told by their first bytes) of the whole objects under ``path``, parsed; broken
    objects give no rows and are found with :func:`corrupt_container`."""
    return parse_lines(read_objects(spark, path).filter("error IS NULL"), schema)


def quarantine_split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with category ``invalid_json`` or ``missing_timestamp``, their source and raw line)."""
    broken = F.col("_corrupt_record").isNotNull() | F.get_json_object("raw", "$").isNull()
    category = F.when(broken, "invalid_json").when(F.col("timestamp").isNull(), "missing_timestamp")
    rows = parsed.withColumn("category", category)
    good = rows.filter("category IS NULL").drop("category", "raw", "_corrupt_record")
    return good, rows.filter("category IS NOT NULL").select("_source_file", "category", "raw")


def corrupt_container(objects: DataFrame) -> DataFrame:
    """Objects that cannot be unpacked to their end (from :func:`decode_objects`), quarantined whole."""
    return objects.filter("error IS NOT NULL").select("_source_file", F.lit("corrupt_container").alias("category"), "codec", "error", "n_bytes")


def ingest_outcomes(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Valid and malformed rows per source file and whether it loaded wholly, in part or not at all."""
    both = good.select("_source_file", F.lit(1).alias("v"), F.lit(0).alias("m")).unionByName(bad.select("_source_file", F.lit(0).alias("v"), F.lit(1).alias("m")))
    out = both.groupBy("_source_file").agg(F.sum("v").alias("valid"), F.sum("m").alias("malformed"))
    return out.withColumn("outcome", F.when(F.col("malformed") == 0, "successful").when(F.col("valid") == 0, "failed").otherwise("partial"))


def quarantine_summary(bad: DataFrame) -> DataFrame:
    return bad.groupBy("_source_file", "category").agg(F.count("*").alias("rows"), F.sum(F.octet_length("raw")).alias("bytes"))


def decode_codes(df: DataFrame, codes: Mapping[str, Mapping[str, str]] = CODES) -> DataFrame:
    """Words for code letters (unknown values stay), no service prefix on backends, whole ttl and age."""
    for column, words in codes.items():
        if column in df.columns:
            table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
            df = df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
    if "backend" in df.columns:
        df = df.withColumn("backend", F.regexp_replace("backend", "^[^-]*--", ""))
    return df.withColumns({c: F.round(c).cast("int") for c in ("ttl", "age") if c in df.columns})


def replace_by_source(target: DataFrame, new: DataFrame) -> DataFrame:
    """``target`` with all rows of the source files in ``new`` replaced by those of ``new``: loading twice is loading once."""
    kept = target.join(new.select("_source_file").distinct(), "_source_file", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _comparable(df: DataFrame, without: Sequence[str] = ()) -> list[Column]:
    """Columns that can be ordered and hashed: maps as their sorted entries."""
    return [F.array_sort(F.map_entries(c)) if kind.startswith("map<") else F.col(c) for c, kind in df.dtypes if c not in without]


def dedup_natural(df: DataFrame, keys: Sequence[str], order: str = "timestamp") -> DataFrame:
    """First row by ``order`` for each natural key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last(), *_comparable(df, (*keys, order))))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def dedup_rid(df: DataFrame) -> DataFrame:
    """First row by timestamp for each request id; rows without one stay as they are, and never meet in a shuffle."""
    return dedup_natural(df.filter("rid IS NOT NULL"), ["rid"]).unionByName(df.filter("rid IS NULL"))


def lake_union_buffer(lake: DataFrame, fresh: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Committed and fresh rows by column name, with the partition columns dt and timestamp_hour."""
    out = lake.unionByName(fresh, allowMissingColumns=True)
    if start:
        out = out.filter(F.col("timestamp") >= start)
    if end:
        out = out.filter(F.col("timestamp") <= end)
    return out.withColumns({"dt": F.date_format("timestamp", "yyyy-MM-dd"), "timestamp_hour": F.date_format("timestamp", "yyyy-MM-dd-HH")})


def write_facts(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """Parquet in zstd, partitioned by day and hour; rows of an hour are gathered into files of a bounded size.

    An hour is written by as many tasks as it has files' worth of rows: hours are counted first.  A row's task follows from
    its content, so that a stage that is computed again deals rows as before.
    """
    rows = df if "timestamp_hour" in df.columns else lake_union_buffer(df, df.limit(0))
    # One row an hour of the batch: at most some ten thousand a year.
    hours = rows.groupBy("timestamp_hour").agg(F.count("*").alias("__n")).select("timestamp_hour", F.ceil(F.col("__n") / rows_per_file).cast("int").alias("__tasks"))
    names = rows.columns
    rows = rows.join(F.broadcast(hours), "timestamp_hour").withColumn("__lane", F.pmod(F.xxhash64(*_comparable(rows)), F.col("__tasks")).cast("int"))
    salted = rows.repartition("dt", "timestamp_hour", "__lane").select(*names)
    salted.sortWithinPartitions("timestamp").write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).option("partitionOverwriteMode", "dynamic").partitionBy("dt", "timestamp_hour").parquet(path)


def compact_files(df: DataFrame, path: str, files: int, rows_per_file: int = 5_000_000) -> None:
    """Rewrite a table as about ``files`` files in time order, or as many more as it takes for ``rows_per_file``: no task sorts
    much more than a file's rows."""
    tasks = max(files, -(-df.count() // rows_per_file))
    df.repartitionByRange(tasks, "timestamp").sortWithinPartitions("timestamp").write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def retention_delete(df: DataFrame, now: str, days: int, rum_days: int, rum_url: str = "/rum-beacon") -> DataFrame:
    """Rows young enough to stay; telemetry rows have a longer limit of their own."""
    age = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    rum_age = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(rum_days))
    is_rum = F.coalesce(F.col("url").startswith(rum_url), F.lit(False))
    return df.filter(F.when(is_rum, F.col("timestamp") >= rum_age).otherwise(F.col("timestamp") >= age))


def publication_fence(facts: DataFrame, publications: DataFrame) -> DataFrame:
    """Facts of the batches whose latest state is ``visible``."""
    latest = publications.groupBy("batch_id").agg(F.max_by("state", "version").alias("state"))
    return facts.join(latest.filter("state = 'visible'").select("batch_id"), "batch_id", "left_semi")


def facts_from_json(raw: DataFrame, typed: Mapping[str, str], aliases: Mapping[str, str] | None = None, column: str = "raw") -> DataFrame:
    """Typed columns, the cmcd_* fields and all other fields as maps, from one JSON object a row."""
    fields = F.from_json(column, "map<string,string>")
    names = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    fields = F.transform_keys(fields, lambda k, v: F.coalesce(F.try_element_at(names, k), k))
    rows = raw.withColumn("__m", fields)
    out = {n: F.try_element_at("__m", F.lit(n)).try_cast(t) for n, t in typed.items()}
    is_cmcd = lambda k, v: k.startswith("cmcd_")
    rest = F.map_filter("__m", lambda k, v: ~k.startswith("cmcd_") & ~k.isin(*typed))
    return rows.withColumns(out | {"cmcd": F.map_filter("__m", is_cmcd), "custom_fields": rest}).drop("__m")


def event_id(domain: str, *parts: Column) -> Column:
    """The same id for the same source row, however often it is loaded."""
    return F.sha2(F.concat_ws("|", F.lit(domain), *[p.cast("string") for p in parts]), 256)


#: Browser beacons: vitals, events (one of them holds the timings of the navigation), log lines and exceptions.
_BEACON = (
    "meta struct<browser:struct<name:string,mobile:boolean>,os:struct<name:string>,page:struct<url:string>>, page struct<url:string>, "
    "measurements array<struct<type:string,values:map<string,double>,context:struct<rating:string>,meta:struct<rating:string>>>, "
    "events array<struct<name:string,attributes:map<string,string>,values:map<string,string>>>, logs array<struct<level:string>>, "
    "exceptions array<struct<value:string,message:string,stacktrace:struct<frames:array<struct<filename:string,lineno:long,colno:long>>>>>"
)
# The type of measurements that are vitals, and the event that holds navigation timings.
_VITALS, _NAVIGATION = "web-vitals", "faro.performance.navigation"
_ENTRY = "array<struct<metric_name:string,metric_value:double,metric_rating:string>>"


def rum_extract(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(one row per vital, timing, event and log line, one row per exception) of each beacon's JSON payload.

    ``raw`` may carry cid, url, browser and os, which stand in for what the payload lacks.  A beacon without any
    entry is a page view; what is no JSON object counts as an empty payload.  Names of browser and system default to
    Chrome and macOS, the path to ``/``.
    """
    known = {c: F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in ("cid", "url", "browser", "os")}
    rows = raw.withColumn("b", F.from_json(column, _BEACON))
    url = F.coalesce("b.page.url", "b.meta.page.url", known["url"], F.lit(""))
    path = F.nullif(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    rows = rows.select(
        F.sha1(column).alias("req_id"), F.coalesce(known["cid"], F.lit("")).alias("cid"), F.coalesce(path, F.lit("/")).alias("pathname"),
        F.coalesce("b.meta.browser.name", known["browser"], F.lit("Chrome")).alias("browser"), F.coalesce("b.meta.os.name", known["os"], F.lit("macOS")).alias("os"),
        F.when(F.col("b.meta.browser.mobile"), "Mobile").otherwise("Desktop").alias("device"), "b",
    )
    entry = lambda name, value, rating: F.struct(name.alias("metric_name"), value.cast("double").alias("metric_value"), rating.alias("metric_rating"))
    of = lambda m, make: F.transform(F.map_entries(m), lambda e: make(e["key"], e["value"]))
    none = F.array().cast(_ENTRY)
    rating = lambda m: F.coalesce(m["context"]["rating"], m["meta"]["rating"], F.lit(""))
    vitals = F.flatten(F.transform(
        F.filter("b.measurements", lambda m: m["type"] == _VITALS),
        lambda m: F.coalesce(of(F.map_filter(m["values"], lambda k, v: k != "delta"), lambda k, v: entry(k, v, rating(m))), none),
    ))
    timings = lambda e: F.coalesce(e["attributes"], e["values"])
    events = F.flatten(F.transform(
        F.filter("b.events", lambda e: e["name"] != ""),
        lambda e: F.when(e["name"] == _NAVIGATION, F.coalesce(of(timings(e), lambda k, v: entry(k, v.try_cast("double"), F.lit(""))), none))
        .otherwise(F.array(entry(F.concat(F.lit("event_"), e["name"]), F.lit(1.0), F.lit("")))),
    ))
    logs = F.transform("b.logs", lambda x: entry(F.lit("log"), F.lit(1.0), F.coalesce(x["level"], F.lit("info"))))
    entries = F.concat(*[F.coalesce(c, none) for c in (vitals, events, logs)])
    rows = rows.withColumn("entries", entries)
    bare = (F.size("entries") == 0) & (F.coalesce(F.size("b.exceptions"), F.lit(0)) <= 0)
    rows = rows.withColumn("entries", F.when(bare, F.array(entry(F.lit("pageview"), F.lit(1.0), F.lit("")))).otherwise(F.col("entries")))
    base = ["req_id", "cid", "pathname", "browser", "os", "device"]
    metrics = rows.select(*base, F.explode("entries").alias("e")).select(*base, "e.metric_name", "e.metric_value", "e.metric_rating")
    frame = lambda c: F.get("e.stacktrace.frames", F.lit(0))[c]
    errors = rows.select(*base, F.explode("b.exceptions").alias("e")).select(
        *base, F.coalesce("e.value", "e.message", F.lit("Unknown error")).alias("error_message"), F.coalesce(frame("filename"), F.lit("unknown.js")).alias("error_file"),
        F.coalesce(frame("lineno"), F.lit(0)).alias("error_line"), F.coalesce(frame("colno"), F.lit(0)).alias("error_col"),
    )
    return metrics, errors


def rum_query_params(raw: DataFrame, column: str = "url", name: str = "m", value: str = "v") -> DataFrame:
    """Metrics from repeated query parameters, paired by position."""
    pairs = F.split(F.split_part(column, F.lit("?"), F.lit(2)), "&")
    take = lambda key: F.transform(F.filter(pairs, lambda p: p.startswith(f"{key}=")), lambda p: F.try_url_decode(F.substring_index(p, "=", -1)))
    zipped = F.explode(F.arrays_zip(take(name).alias("n"), take(value).alias("v")))
    return raw.withColumn("p", zipped).select(*raw.columns, F.col("p.n").alias("metric_name"), F.col("p.v").try_cast("double").alias("metric_value"))


def cmcd_project(facts: DataFrame) -> DataFrame:
    """One row per request with player telemetry, with a checked country and network number."""
    has = F.size(F.map_keys("cmcd")) > 0
    return facts.filter(has).select("rid", "timestamp", F.when(F.col("country").rlike("^[A-Z]{2}$"), F.col("country")).alias("country"), F.when(F.col("asn") > 0, F.col("asn")).alias("asn"), "cmcd")
