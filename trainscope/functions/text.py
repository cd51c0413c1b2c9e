"""Text, number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trainscope.schemas import LOG_TIME, NODE_LIST, WHITE_SPACE


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_rest(blank_trimmed: Column) -> Column:
    """White space left around text already trimmed of blanks.

    Nearly all text then begins and ends with printable ASCII; only the rest
    goes through the slower trim with a list of characters.
    """
    last = F.right(blank_trimmed, F.lit(1))
    plain = (blank_trimmed >= "!") & (blank_trimmed < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(plain, blank_trimmed).otherwise(F.trim(blank_trimmed, F.lit(WHITE_SPACE)))


def trim_space(value: Column | str) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return trim_rest(F.trim(_c(value)))


def digits_to_bigint(digits: Column) -> Column:
    """A run of digits as bigint; NULL if empty or too large.

    A failing ``try_cast`` raises and catches an error per row, so it only sees
    runs that may be too large.
    """
    return (F.when(digits == "", F.lit(None)).when(F.length(digits) <= 18, digits.cast("bigint"))
            .otherwise(digits.try_cast("bigint")))


def text_to_int(text: Column) -> Column:
    """A whole number as int; NULL for any other text.  Empty text takes the quick way."""
    return F.when(text != "", F.when(text.rlike(r"\A-?\d{1,9}\z"), text.cast("int")).otherwise(text.try_cast("int")))


def wrap_int32(number: Column) -> Column:
    """Low 32 bits of a bigint as a signed int, without an overflow error."""
    return F.shiftright(F.shiftleft(number, 32), 32).cast("int")


def extract_number(value: Column | str) -> Column:
    """First run of digits as bigint; NULL where there is none or it is too large."""
    return digits_to_bigint(F.regexp_extract(_c(value), r"\d+", 0))


def compare_rank(left: Column | str, right: Column | str) -> Column:
    """-1, 0 or 1 by the numeric part; 0 when either side has no number."""
    a, b = extract_number(left), extract_number(right)
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def rank_label(number: Column | str) -> Column:
    return F.concat(F.lit("RANK"), _c(number).cast("string"))


def format_rfc3339(ts: Column | str) -> Column:
    """Whole seconds in UTC; an absent time gives the empty string."""
    as_utc = F.to_utc_timestamp(_c(ts), F.current_timezone())
    return F.coalesce(F.date_format(as_utc, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def parse_log_time(value: Column | str, zone: str | None = None) -> Column:
    """Log line time, read as UTC (or as wall time of ``zone``); NULL if it is not one."""
    # The trailing 0 keeps the fraction non-empty when the line has none.  The text
    # occurs once here, so a filter on the result does not repeat its making.
    ts = F.regexp_replace(_c(value), LOG_TIME, "$1 $2.$30Z").try_cast("timestamp")
    return F.to_utc_timestamp(ts, zone) if zone else ts


def parse_time_bound(value: Column | str) -> Column:
    """RFC 3339 text, or the same without a zone, which then means UTC."""
    text = _c(value)
    stamp = r"\d{4}-\d\d-\d\dT\d{1,2}:\d\d:\d\d(?:[.,]\d+)?"
    zoned = text.rlike(rf"\A{stamp}(?:Z|[+-]\d\d:\d\d)\z")
    plain = text.rlike(rf"\A{stamp}\z")
    dotted = F.regexp_replace(text, ",", ".")
    return (F.when(zoned, dotted.try_cast("timestamp"))
            .when(plain, F.concat(dotted, F.lit("Z")).try_cast("timestamp")))


def time_bounds(start: Column | str, end: Column | str, now_ms: Column | int) -> Column:
    """``struct<start_ms, end_ms, reason>`` of two time texts.  Without a start it is 0, without an end ``now_ms``.

    Empty and null texts are absent; for a text that is no time both numbers are NULL, with a reason.
    """
    first, last = (F.coalesce(_c(c), F.lit("")) for c in (start, end))
    ms = lambda text: F.unix_millis(parse_time_bound(text))
    # The texts of the reasons.
    reason = (F.when((first != "") & ms(first).isNull(), F.lit("Invalid start time format"))
              .when((last != "") & ms(last).isNull(), F.lit("Invalid end time format")))
    low = F.when(first == "", F.lit(0).cast("bigint")).otherwise(ms(first))
    high = F.when(last == "", F.lit(now_ms).cast("bigint")).otherwise(ms(last))
    return F.struct(F.when(reason.isNull(), low).alias("start_ms"), F.when(reason.isNull(), high).alias("end_ms"), reason.alias("reason"))


def extract_nodes(value: Column | str) -> Column:
    """Host names of a job description; NULL where it has no node list."""
    text = _c(value)
    inner = F.regexp_extract(text, NODE_LIST, 1)
    bare = F.regexp_replace(inner, r"'|\\[ntr]|\n| ", "")
    trimmed = F.transform(F.transform(F.split(bare, ","), lambda n: F.trim(n)), lambda n: trim_rest(n))
    names = F.filter(trimmed, lambda n: n != "")
    hosts = F.transform(names, lambda n: F.regexp_replace(n, r"(?s)\A[^:]*:", ""))
    return F.when(text.rlike(NODE_LIST), hosts)


def parse_rank_range(value: Column | str) -> Column:
    """``min:max`` text as a struct; both numbers NULL with a reason when it is not one."""
    text = trim_space(value)
    parts = F.split(text, ":")
    number = r"\A[+-]?\d+\z"

    def bound(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        return F.when(part.rlike(number), part.try_cast("int"))

    # The texts of the reasons.
    reason = (F.when(text.startswith("error:"), F.concat(F.lit("rank range script error: "), text))
              .when(F.size(parts) != 2, F.concat(F.lit("Invalid output format: "), text))
              .when(bound(0).isNull(), F.lit("Failed to parse minRank"))
              .when(bound(1).isNull(), F.lit("Failed to parse maxRank")))
    ok = reason.isNull()
    return F.struct(F.when(ok, bound(0)).alias("min_rank"),
                    F.when(ok, bound(1)).alias("max_rank"),
                    reason.alias("reason"))


def environ_value(environ: Column | str, name: str) -> Column:
    """One variable of a NUL separated environment block; '' when it is absent."""
    return F.regexp_extract(_c(environ), rf"(?:\A|[\x00\n]){name}=([^=\x00\n]*)", 1)


def parse_environ(environ: Column | str) -> Column:
    """The block as a map; the first setting of a name wins, values end at a second '='."""
    entries = F.filter(F.split(_c(environ), r"[\x00\n]"), lambda e: F.contains(e, F.lit("=")))
    fields = F.transform(entries, lambda e: F.split(e, "="))
    names = F.array_distinct(F.transform(fields, lambda f: F.get(f, F.lit(0))))

    def first_value(name: Column) -> Column:
        same = F.filter(fields, lambda f: F.get(f, F.lit(0)) == name)
        return F.get(F.get(same, F.lit(0)), F.lit(1))

    return F.map_from_arrays(names, F.transform(names, first_value))


def clean_utf8(value: Column | str) -> Column:
    """Valid text from bytes: bad bytes become U+FFFD, a leading byte order mark goes.

    A UTF-16 mark switches decoding.  Text with a broken surrogate pair stays on
    the UTF-8 path, since the built-in decoder would fail the whole job on it.
    """
    raw = _c(value).cast("binary")
    head = F.hex(F.substring(raw, 1, 3))
    utf8 = F.when(head == "EFBBBF", F.substring(raw, 4, 2147483647)).otherwise(raw)
    fallback = F.make_valid_utf8(utf8.cast("string"))

    units = F.regexp_replace(F.hex(raw), "(.{4})", "$1 ")
    little = F.regexp_replace(units, "(..)(..) ", "$2$1 ")

    def well_formed(aligned: Column) -> Column:
        unpaired = F.regexp_replace(aligned, "D[89AB].. D[C-F].. ", "")
        return (F.length(raw) % 2 == 0) & ~unpaired.rlike(r"(?:\A| )D[89A-F]")

    return (F.when(head.startswith("FEFF") & well_formed(units), F.decode(raw, "UTF-16"))
            .when(head.startswith("FFFE") & well_formed(little), F.decode(raw, "UTF-16"))
            .otherwise(fallback))
