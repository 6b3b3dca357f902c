"""Reading records: single objects, arrays, request envelopes; row numbers and record identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions.scalars import json_text_sql
from tamis.functions.text import ident, quote

# fixed values: field names tried, in this order, as a record's identifier
IDENTIFIER_FIELDS = ["id", "ID", "_id", "uuid", "UUID", "identifier", "recordId", "record_id"]

ENVELOPE = "model_type STRING, payload STRING, data ARRAY<STRING>, threshold DOUBLE"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line, as text in column ``value``; nothing is inferred."""
    return spark.read.text(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as text in column ``value``."""
    return spark.read.text(path, wholetext=True)


def explode_array(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose ``column`` holds a JSON array: one row per element, raw JSON in ``column``, 0-based ``row_index``.

    A null element is a record without any field. A document that is no array gives one row, marked ``unreadable``, with neither
    index nor value, which no decoder accepts, so that no input row vanishes; an empty array has no records.
    """
    rest = [c for c in df.columns if c != column]
    items = F.from_json(F.col(ident(column)), "array<string>")
    parsed = df.select(*rest, F.transform(items, lambda x: F.coalesce(x, F.lit("{}"))).alias("__items"))
    none = F.array(F.lit(None).cast("string"))
    out = parsed.select(*rest, F.col("__items").isNull().alias("unreadable"), F.posexplode(F.coalesce("__items", none)).alias("row_index", column))
    index = F.when(~F.col("unreadable"), F.col("row_index").cast("bigint"))
    return out.select(*rest, index.alias("row_index"), column, "unreadable")


RANGE_ROWS = 50_000  # rows of a range, about, as long as MAX_RANGES allows
MAX_RANGES = 10_000


def _range_sql(bounds: list[float], value: str) -> str:
    """SQL of how many of the sorted ``bounds`` lie below ``value``: first whole chunks of them, then within a chunk, so that a
    row is compared with about 2 * sqrt(n) of n bounds."""
    step = math.isqrt(len(bounds)) or 1
    listed = [f"{b!r}D" for b in bounds]
    chunks = f"size(filter(array({', '.join(listed[step - 1::step])}), b -> b < {value}))"
    within = f"size(filter(slice(array({', '.join(listed)}), c * {step} + 1, {step}), b -> b < {value}))"
    return f"transform(array({chunks}), c -> c * {step} + {within})[0]"


def with_row_index(df: DataFrame, order: str, width: float | None = None, ranges: int | None = None) -> DataFrame:
    """Number rows 0, 1, ... in the order of a unique numeric column, without one global sort in one task.

    Rows are cut into about ``ranges`` ranges (without it, as many as their number asks for) of equally many rows, by quantiles of the order column, so dense, sparse and skewed keys
    do alike; with ``width`` into ranges of that width instead. Each range is numbered on its own and shifted by the number of
    rows in the ranges before it, so the only single-task step sees one row per range. Rows without a key come first.
    """
    at = F.col(ident(order))
    if width is not None:
        cut = df.withColumn("__range", F.floor(at / F.lit(width)))
    else:
        ranges = ranges or min(df.count() // RANGE_ROWS + 1, MAX_RANGES)
        # bounds only balance the work: any bounds give the same numbers
        bounds = sorted(set(df.stat.approxQuantile([order], [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))[0])) if ranges > 1 else []
        where = F.expr(_range_sql(bounds, f"cast({ident(order)} AS DOUBLE)")) if bounds else F.lit(0)
        cut = df.withColumn("__range", F.when(at.isNotNull(), where))
    counts = cut.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(ident(order)))
    return (
        cut.withColumn("__place", place)
        .join(offsets, F.col("__range").eqNullSafe(F.col("__of")))
        .withColumn("row_index", (F.col("__offset") + F.col("__place") - 1).cast("bigint"))
        .drop("__range", "__of", "__place", "__offset")
    )


def record_identifier(column: str = "value", row_index: str = "row_index") -> Column:
    """The first identifier field of the raw record that is present and not null, else ``row_<index>``."""
    return F.expr(identifier_sql(f"try_parse_json({ident(column)})", ident(row_index)))


def identifier_sql(variant: str, row_index: str) -> str:
    found = []
    for name in IDENTIFIER_FIELDS:
        at = f"try_variant_get({variant}, {quote('$.' + name)}, 'variant')"
        found.append(f"if(is_variant_null({at}), NULL, {at})")
    # the lambda names the chosen value once, which keeps the generated code small
    return (f"coalesce(transform(array(coalesce({', '.join(found)})), x -> {json_text_sql('x')})[0],"
            f" concat('row_', {row_index}))")


def typed_identifier(columns: list[str], row_index: str = "row_index") -> Column:
    """Identifier of an already typed row: the first identifier column that is not null, else ``row_<index>``."""
    found = [F.col(ident(c)).cast("string") for c in IDENTIFIER_FIELDS if c in columns]
    return F.coalesce(*found, F.concat(F.lit("row_"), F.col(ident(row_index)).cast("string")))


def read_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse request envelopes ``{model_type, payload | data, threshold}``; records stay raw JSON."""
    rest = [c for c in df.columns if c != column]
    parsed = df.select(*rest, F.from_json(F.col(ident(column)), ENVELOPE).alias("__e"))
    return parsed.select(*rest, "__e.model_type", "__e.payload", "__e.data", "__e.threshold")


def request_records(requests: DataFrame) -> DataFrame:
    """One row per record of each request.

    A request with a non-empty ``data`` array is an array request (strict decoding); any other is a single
    request (lenient decoding), also one whose array is empty. A null element of an array is a record without fields.
    """
    many = F.expr("data IS NOT NULL AND size(data) > 0")
    rest = [c for c in requests.columns if c not in ("payload", "data")]
    return (
        requests.withColumn("is_array", many)
        .select(*rest, "is_array", F.posexplode(
            F.when(F.col("is_array"), F.transform("data", lambda x: F.coalesce(x, F.lit("{}")))).otherwise(F.array("payload"))
        ).alias("row_index", "value"))
        .withColumn("row_index", F.col("row_index").cast("bigint"))
    )
