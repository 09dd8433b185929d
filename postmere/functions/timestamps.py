"""Reading timestamps of many layouts as instants, with built-in expressions only.

Each layout is one pattern whose match is rewritten into a common list of fields,
so a value is matched and rewritten once, on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names of mail clients (English, German, French, Norwegian, Spanish, Polish).
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene stycznia",
    2: "feb february februar février févr fevrier febrero lutego",
    3: "mar march märz mrz maerz mars marzo marca",
    4: "apr april avril avr abril abr kwietnia",
    5: "may mai mayo maja",
    6: "jun june juni juin junio czerwca",
    7: "jul july juli juillet juil julio lipca",
    8: "aug august août aout agosto ago sierpnia",
    9: "sep sept september septembre septiembre września",
    10: "oct october okt oktober octobre octubre października",
    11: "nov november novembre noviembre listopada",
    12: "dec december dez dezember décembre desember des diciembre dic grudnia",
}
# Offsets in minutes of the zone names common in mail.
MAIL_ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "bst": 60, "west": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120, "eet": 120, "eest": 180, "msk": 180,
    "jst": 540, "aest": 600, "aedt": 660,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_OFFSET = r"Z|[+-]\d{2}(?::?\d{2})?"
_NAME = r"[A-Za-zÀ-žА-я]+"
# Fields: kind, year, month, day, hour, minute, second, fraction, am/pm, offset or abbreviation, zone name.
_LAYOUTS = (
    ("iso", rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:T|\s+){_CLOCK}\s*({_OFFSET})?(?:\s*\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?)?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("iso", rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:T|\s+){_CLOCK}\s*([A-Z]{{2,5}})$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("iso", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?\s*({_OFFSET})?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("mail", rf"(?i)^(?:[a-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s-]+([a-z]{{3,9}})\.?[\s-]+(\d{{2}}|\d{{4}})\s+{_CLOCK}\s*([+-]\d{{4}}|[A-Z]{{1,5}})?(?:\s*\([^()]*\))?$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("ctime", rf"(?i)^[a-z]{{3}},?\s+([a-z]{{3}})\s+(\d{{1,2}})\s+{_CLOCK}\s+(?:([A-Z]{{2,5}})\s+)?(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7|"),
    ("slash", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}|\d{{4}}),?\s+{_CLOCK}\s*(?:([ap])\.?m\.?)?$", "$3|$1|$2|$4|$5|$6|$7|$8||"),
    ("dots", r"(?i)^(\d{1,2})\.(\d{1,2})\.(\d{2}|\d{4}),?\s+(?:kl\.?\s*|um\s+)?(\d{1,2})[.:](\d{2})(?:[.:](\d{2}))?(?:\s*uhr)?$", "$3|$2|$1|$4|$5|$6||||"),
    ("words", rf"(?i)^(\d{{1,2}})\.?\s+(?:de\s+)?({_NAME})\.?\s+(?:de\s+)?(\d{{4}}),?\s+(?:at\s+|à\s+|kl\.?\s*|um\s+|a las\s+)?(\d{{1,2}})\s?[:h.]\s?(\d{{2}})(?:[:.](\d{{2}}))?(?:\s*([ap])\.?m\.?)?(?:\s*uhr)?$", "$3|$2|$1|$4|$5|$6||$7||"),
)


def parse_fields(text: Column) -> Column:
    """An array of the fields of a timestamp's text: kind, year, month, day, hour, minute, second, fraction,
    a/p, offset or abbreviation, zone name. NULL where no layout fits."""
    s = F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")
    found = F.when(s.rlike(r"^\d{1,20}(\.\d+)?$") & ~s.rlike(r"^(19|20)\d{12}$"), F.array(F.lit("epoch"), s))
    for kind, pattern, fields in _LAYOUTS:
        found = found.when(s.rlike(pattern), F.split(F.regexp_replace(s, pattern, f"{kind}|{fields}"), r"\|"))
    return found


def literal_map(pairs: dict[str, int]) -> Column:
    """A constant map; as one SQL text, since hundreds of literal columns are slow to build."""
    quoted = lambda k: "'" + k.replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {v}" for k, v in pairs.items()) + ")")


def one_of(name: str, values: list[str]) -> Column:
    """Whether the column *name* is one of *values* (plain words), as one SQL text."""
    return F.expr(f"`{name}` IN (" + ", ".join(f"'{v}'" for v in values) + ")")


def where_known(value: Column) -> Column:
    """A generator of *value*, or of no row if it is NULL. A filter would be pushed below the projections and
    have their costly expressions evaluated again."""
    return F.explode(F.array_compact(F.array(value)))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _epoch_us(s: Column) -> Column:
    """A bare number as microseconds since 1970; its unit follows from its length."""
    whole, frac = F.substring_index(s, ".", 1), F.when(s.contains("."), F.substring_index(s, ".", -1)).otherwise("")
    n, digits = whole.cast("decimal(38,0)"), F.length(whole)
    sub = F.rpad(F.substring(frac, 1, 6), 6, "0").cast("long")
    us = (
        F.when(digits <= 11, n * 1_000_000 + sub)
        .when(digits <= 14, n * 1000 + F.rpad(F.substring(frac, 1, 3), 3, "0").cast("long"))
        .when(digits <= 17, n)
        .otherwise((n - n % 1000) / 1000)
    )
    return us.cast("long")


def _offset_min(z: Column) -> Column:
    """Minutes of a numeric offset; NULL if it is none or none that a zone can have."""
    digits = F.regexp_replace(F.substring(z, 2, 6), ":", "")
    h, m = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")), F.lit("0")).cast("int")
    at = F.when(z.startswith("-"), -1).otherwise(1) * (h * 60 + m)
    return F.when(z.rlike(r"^[+-]\d{2}:?(\d{2})?$") & (m < 60) & (F.abs(at) <= 18 * 60), at)


def with_instant(df: DataFrame, fields: str, zone: Column, date_order: Column, own: Column, known_zones: list[str], out: str) -> DataFrame:
    """*df* with the microseconds since 1970 UTC of the column *fields* (:func:`parse_fields`' result), as *out*; rows without an instant fall out.

    *zone*: IANA zone of a value that names none. *date_order*: ``dmy`` or ``mdy`` of digits with slashes.
    *own*: map of the abbreviations (lower case) of that zone to minutes; the common mail zones come after it.
    A wall time that occurs twice is the earlier instant, a skipped one is read with the offset before the
    change: the rule of ``to_utc_timestamp``. The steps are columns of their own, so that none is evaluated
    twice and the generated code stays small.
    """
    keep = df.columns
    f = lambda i: F.get(fields, F.lit(i))
    month_of = literal_map({n: m for m, names in MONTHS.items() for n in names.split()})
    mail = literal_map(MAIL_ZONES)
    swap = (f(0) == "slash") & (date_order != "mdy")
    df = df.select(
        *keep, f(0).alias("_kind"), f(1).alias("_y"), F.when(swap, f(3)).otherwise(f(2)).alias("_m"), _int(F.when(swap, f(2)).otherwise(f(3))).alias("_d"),
        _int(f(4)).alias("_h"), _int(f(5)).alias("_mi"), F.coalesce(_int(f(6)), F.lit(0)).alias("_s"), F.coalesce(f(7), F.lit("")).alias("_frac"),
        F.lower(f(8)).alias("_half"), F.lower(F.coalesce(f(9), F.lit(""))).alias("_z"), F.coalesce(f(10), F.lit("")).alias("_named"), zone.alias("_home"), own.alias("_own"),
    )
    hour = F.when(F.col("_half") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    df = df.withColumns({
        "_year": _int(F.col("_y")) + F.when(F.length("_y") == 2, 2000).otherwise(0),
        "_month": F.when(F.col("_m").rlike(r"^\d"), _int(F.col("_m"))).otherwise(F.try_element_at(month_of, F.lower("_m"))),
        "_hour": hour,
        "_min": F.when(F.col("_z").rlike(r"^[+-]"), _offset_min(F.col("_z"))).when(F.col("_z") != "", F.coalesce(F.try_element_at("_own", F.col("_z")), F.try_element_at(mail, F.col("_z")))),
    })
    fits = (F.col("_hour") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60) & F.col("_month").between(1, 12) & F.col("_d").between(1, 31)
    wall = F.when(fits, F.try_make_timestamp(F.col("_year"), F.col("_month"), F.col("_d"), F.col("_hour"), F.col("_mi"), F.col("_s").cast("decimal(8,6)"), F.lit("UTC")))
    df = df.withColumn("_us", F.unix_micros(wall) + F.rpad(F.substring("_frac", 1, 6), 6, "0").cast("long"))
    df = df.withColumn("_at", F.when(F.col("_named") == "", F.col("_home")).when(one_of("_named", known_zones), F.col("_named")))
    local = F.when(F.col("_z") != "", F.col("_us") - F.col("_min").cast("long") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_us"), F.col("_at"))))
    return df.select(*keep, where_known(F.when(F.col("_kind") == "epoch", _epoch_us(F.col("_y"))).otherwise(local)).alias(out))
