"""Text, number and time formatting as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Display formats and size symbols.
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "HH:mm:ss"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
BYTE_SYMBOLS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]
FILE_SIZE_SYMBOLS = ["B", "KB", "MB", "GB", "TB"]


# --- sizes --------------------------------------------------------------------

def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def fixed(x: Column, digits: int, ties: str = "even") -> Column:
    """Text of a non-negative double with ``digits`` decimals, rounded by its
    exact binary value.  ``format_string`` rounds the printed digits instead,
    which differs on ties and near them.  ``ties`` is "even" or "up"."""
    scale = float(10 ** digits)
    # Rounded product and its exact error, from the halves of the factor.
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    side = (product - whole.cast("double") - 0.5) + error
    up = (side > 0) | ((side == 0) & (F.lit(True) if ties == "up" else whole % 2 == 1))
    n = whole + up.cast("long")
    if not digits:
        return n.cast("string")
    unit = 10 ** digits
    return F.concat_ws(".", F.floor(n / unit).cast("string"), F.lpad((n % unit).cast("string"), digits, "0"))


def bytes_human(n: Column) -> Column:
    """One decimal in the largest fitting unit (``9.8KB``); the fraction is kept."""
    unit, symbol = F.lit(1.0), F.lit(BYTE_SYMBOLS[0])
    for power, name in enumerate(BYTE_SYMBOLS[1:], start=1):
        size = float(1 << 10 * power)
        unit, symbol = F.when(n >= size, size).otherwise(unit), F.when(n >= size, name).otherwise(symbol)
    return F.concat(fixed(n / unit, 1), symbol)


def file_size(n: Column) -> Column:
    """Two decimals, but every step down a unit floors (1536 is ``1.00KB``)."""
    unit, symbol = F.lit(1.0), F.lit(FILE_SIZE_SYMBOLS[0])
    for power, name in enumerate(FILE_SIZE_SYMBOLS[1:], start=1):
        size = float(1 << 10 * power)
        unit, symbol = F.when(n >= size, size).otherwise(unit), F.when(n >= size, name).otherwise(symbol)
    return F.when(n == 0, "0B").otherwise(F.concat(F.floor(n / unit).cast("string"), F.lit(".00"), symbol))


# --- identifier case ----------------------------------------------------------

def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2_147_483_647)))


def to_pascal(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "_"), _capital), "")


def to_lower_camel(s: Column) -> Column:
    parts = F.split(s, "_")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _capital)
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def to_snake(s: Column) -> Column:
    apart = F.regexp_replace(s, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(apart, r"([a-z0-9])([A-Z])", "$1_$2"))


def class_name(s: Column) -> Column:
    """Without underscore only the first letter changes; null becomes ""."""
    words = F.filter(F.split(s, "_"), lambda w: w != "")
    joined = F.array_join(F.transform(words, _capital), "")
    plain = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2_147_483_647))
    return F.when(F.coalesce(s, F.lit("")) == "", "").when(F.contains(s, F.lit("_")), joined).otherwise(plain)


# --- tests --------------------------------------------------------------------

def is_blank(s: Column) -> Column:
    """Empty or spaces only (other white space does not count)."""
    return s.rlike(r"^ *\z")


def is_empty(s: Column) -> Column:
    return s.isNull() | (F.length(s) == 0)


def is_not_empty(s: Column) -> Column:
    return ~is_empty(s)


def is_http(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://")


def is_external(s: Column) -> Column:
    return s.rlike(r"^(https?:|mailto:|tel:)")


def _both(s: Column, text: str, test: Column) -> Column:
    return F.coalesce((F.length(s) > 0) & test, F.lit(False)) if text else F.lit(False)


def equals_ci(s: Column, text: str) -> Column:
    return _both(s, text, F.lower(s) == text.lower())


def equals_any_ci(s: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [equals_ci(s, t) for t in texts], F.lit(False))


def starts_any(s: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_both(s, t, s.startswith(t)) for t in texts], F.lit(False))


def map_ci(mapping: dict[str, str], key: Column) -> Column:
    """First entry whose key matches without case, "" where none does."""
    lowered: dict[str, str] = {}
    for k, v in mapping.items():
        lowered.setdefault(k.lower(), v)
    if not lowered:
        return F.lit("")
    table = F.create_map(*[F.lit(x) for pair in lowered.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(key)), F.lit(""))


# --- time ---------------------------------------------------------------------

def fmt_ts(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)


def minute_fmt(ts: Column) -> Column:
    """To the minute, "" where there is no time."""
    return F.coalesce(F.date_format(ts, MINUTE_FORMAT), F.lit(""))


def unix_to_ts(n: Column) -> Column:
    return F.date_format(F.timestamp_seconds(n), TIMESTAMP_FORMAT)


def format_times(df: DataFrame) -> DataFrame:
    """Every timestamp and date of the frame as text, also inside arrays and structs."""
    def shape(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(col, TIMESTAMP_FORMAT)
        if isinstance(dtype, T.DateType):
            return F.date_format(col, DATE_FORMAT)
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: shape(x, dtype.elementType))
        if isinstance(dtype, T.StructType):
            inner = F.struct(*[shape(col[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(col.isNotNull(), inner)
        return col

    return df.select(*[shape(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _strict(s: Column, pattern: str, fmt: str) -> Column:
    return F.when(s.rlike(pattern), F.try_to_timestamp(s, F.lit(fmt)))


def parse_ts(s: Column) -> Column:
    """Null unless the text is exactly in the timestamp format."""
    return _strict(s, r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s")


def parse_date(s: Column) -> Column:
    return _strict(s, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d").cast("date")


def parse_time(s: Column) -> Column:
    """Time of day as normal text, null when it is none."""
    ok = s.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$")
    parts = F.transform(F.split(s, ":"), lambda p: F.lpad(p, 2, "0"))
    return F.when(ok, F.array_join(parts, ":"))


def parse_rejects(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """Rows whose text is given but does not parse."""
    return df.filter(F.col(column).isNotNull() & parsed.isNull())


# --- requests -----------------------------------------------------------------

def client_ip(forwarded: Column, peer: Column) -> Column:
    """First forwarded address, else the peer's."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(peer)


def process_seconds(s: Column) -> Column:
    return F.regexp_replace(s, "s$", "").try_cast("double")


def handler_label(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


# Longest recorded payload and the marker in its place.
PAYLOAD_LIMIT = 2000
PAYLOAD_MARKER = "请求参数过长"


def truncate_payload(s: Column, limit: int = PAYLOAD_LIMIT, marker: str = PAYLOAD_MARKER) -> Column:
    return F.when(F.length(s) > limit, marker).otherwise(s)


def growth_text(r: Column) -> Column:
    """``-`` for zero, else the absolute percentage without trailing zeros."""
    digits = F.regexp_replace(fixed(F.abs(r * 100.0), 2, ties="up"), r"\.?0+$", "")
    return F.when(r == 0, "-").otherwise(F.concat(digits, F.lit("%")))


def uuid_col() -> Column:
    """Differs per evaluation; write the frame before using it twice."""
    return F.uuid()


# --- passwords ----------------------------------------------------------------

# What a password must have, in the order it is checked.
PASSWORD_RULES = [(".{6}", "length"), (r"\p{Lu}", "upper"), (r"\p{Ll}", "lower"), (r"\p{Nd}", "digit")]


def weak_password(s: Column) -> Column:
    """The first rule a password breaks, null when it is fine."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(PASSWORD_RULES):
        out = F.when(~s.rlike("(?s)" + pattern), name).otherwise(out)
    return out
