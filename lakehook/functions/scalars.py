"""Scalar column expressions of the lake.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character set removed from transform names, and the
# characters trimmed from both ends afterwards.
NAME_STRIP_CHARS = '<>:"/\\|?*$&;()[]{}^!#%@'
NAME_TRIM_CHARS = " ."

_KB = 1024
_MB = 1024 ** 2
_GB = 1024 ** 3


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def human_size(size_bytes: Column | str) -> Column:
    """'<n> bytes', or two decimals of KB / MB / GB at 1024 steps.

    ``bround`` (half-even) before formatting reproduces Python's ``:.2f`` on
    the exactly representable quotients n / 1024**k (1152 bytes -> '1.12 KB').
    """
    b = _c(size_bytes)
    return (
        F.when(b < _KB, F.concat(b.cast("string"), F.lit(" bytes")))
        .when(b < _MB, F.format_string("%.2f KB", F.bround(b / F.lit(float(_KB)), 2)))
        .when(b < _GB, F.format_string("%.2f MB", F.bround(b / F.lit(float(_MB)), 2)))
        .otherwise(F.format_string("%.2f GB", F.bround(b / F.lit(float(_GB)), 2)))
    )


def file_extension(name: Column | str) -> Column:
    """text after the last dot (whole name when there is no dot)."""
    return F.element_at(F.split(_c(name), r"\."), -1)


def base_name(path: Column | str) -> Column:
    """last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def force_parquet_extension(path: Column | str) -> Column:
    """replace the last extension by '.parquet' unless already there."""
    p = _c(path)
    return F.when(
        p.endswith(".parquet"), p
    ).otherwise(F.concat(F.regexp_replace(p, r"\.[^.]*$", ""), F.lit(".parquet")))


def dataset_path(root: str, user: Column | str, dataset: Column | str, file: Column | str) -> Column:
    """storage path of a file, '<root>/<user>/<dataset>/<file>'."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), _c(user).cast("string"),
                       _c(dataset).cast("string"), _c(file).cast("string"))


def resource_name(dataset_name: Column | str) -> Column:
    """resource name of a dataset."""
    return F.concat(F.lit("lake:dataset:::"), _c(dataset_name))


def parent_dirs(path: Column | str) -> Column:
    """every ancestor directory of an absolute path, shortest first.

    '/a/b/c.txt' -> ['/a', '/a/b']. Works on the split array; no UDF.
    """
    parts = F.split(_c(path), "/")
    n = F.size(parts)
    return F.when(n >= 3, F.transform(
        F.sequence(F.lit(2), n - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )).otherwise(F.array().cast("array<string>"))


def sanitize_name(name: Column | str) -> Column:
    """delete NAME_STRIP_CHARS, then trim spaces and dots at both ends."""
    cleaned = F.translate(_c(name), NAME_STRIP_CHARS, "")
    return F.btrim(cleaned, F.lit(NAME_TRIM_CHARS))


def iso_timestamp(ts: Column | str) -> Column:
    """ISO-8601 text of a naive timestamp, microseconds only when non-zero
    (the form Python's ``datetime.isoformat`` produces); a date stays a date."""
    text = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.typeof(_c(ts)) == "date", _c(ts).cast("string")).otherwise(
        F.regexp_replace(text, r"\.000000$", ""))


def to_json_object(*cols: Column | str, iso_dates: tuple[str, ...] = ()) -> Column:
    """F8: JSON object text of the given columns; timestamp columns listed in
    ``iso_dates`` are rendered with :func:`iso_timestamp` first. NULL fields are
    written as ``null``."""
    fields = []
    for c in cols:
        name = c if isinstance(c, str) else None
        if name is not None and name in iso_dates:
            fields.append(iso_timestamp(name).alias(name))
        else:
            fields.append(_c(c))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_field(json_text: Column | str, path: str) -> Column:
    """one field from JSON text ('$.k' style path)."""
    return F.get_json_object(_c(json_text), path)


def local_time(ts_utc: Column | str, zone: str = "America/Denver") -> Column:
    """wall-clock time in ``zone`` (default US Mountain), naive, second
    precision, of a naive UTC timestamp."""
    ts = _c(ts_utc)
    ntz = ts.cast("timestamp_ntz") if isinstance(ts_utc, str) else ts
    # convert_timezone works on wall-clock values, independent of the
    # session time zone
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)
    # second precision by formatting and parsing the wall-clock value, so no
    # step passes through the session time zone (date_trunc would)
    return F.to_timestamp_ntz(F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
                              F.lit("yyyy-MM-dd HH:mm:ss"))


def age_days(as_of: Column | str, created: Column | str) -> Column:
    """whole days between two dates."""
    return F.datediff(_c(as_of), _c(created))


def split_tags(text: Column | str) -> Column:
    """comma-separated tags to an array with empty entries removed."""
    return F.filter(F.split(_c(text), ","), lambda x: x != F.lit(""))
