"""Scalar functions over Columns: blanks, slugs, titles, merchant names, parsing, guards."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import fixed

# Python's re rules in java.util.regex: case-insensitive, Unicode classes, '.' stops at \n only.
_NOISE = "(?iUd)" + fixed.MERCHANT_NOISE


def col(c):
    return F.col(c) if isinstance(c, str) else c


def blank(c) -> Column:
    """null -> ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def blank_if_missing(c) -> Column:
    """null, '', 'none' and 'nan' in any case -> ''."""
    c = col(c)
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("none", "nan", ""), "").otherwise(c)


def or_null(c) -> Column:
    """'' -> null, so that coalesce falls through blanks."""
    return F.nullif(col(c), F.lit(""))


def slug(c) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_")
    return F.coalesce(F.regexp_replace(s, "^_+|_+$", ""), F.lit(""))


def normalize_merchant(c) -> Column:
    """A stable merchant key: noise removed, letters only, single spaces."""
    s = F.regexp_replace(F.lower(blank(c)), _NOISE, " ")
    s = F.regexp_replace(s, r"(?U)[^a-z\s]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def contains_word(text, keyword: str) -> Column:
    """keyword stands in (already lower-cased) text with no [a-z0-9] on either side."""
    return col(text).rlike(r"(?<![a-z0-9])" + java_quote(keyword) + r"(?![a-z0-9])")


def java_quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9 _])", r"\\\1", s)


def glob_to_regex(glob: str) -> str:
    """A case-sensitive shell glob (*, ?, [..], [!..]) as an anchored regex."""
    out, i = "", 0
    while i < len(glob):
        ch, i = glob[i], i + 1
        end = glob.find("]", i + 1) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            body = "^" + body[1:] if body[0] == "!" else ("\\" + body if body[0] == "^" else body)
            out, i = out + f"[{body}]", end + 1
        else:
            out += java_quote(ch)
    return f"(?s)^(?:{out})\\z"


def glob_match(c, globs) -> Column:
    """True when the value matches any glob; null never does."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | col(c).rlike(glob_to_regex(g))
    return F.coalesce(hit, F.lit(False))


def title(c) -> Column:
    """FOO_BAR -> Foo Bar."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def humanize_atom(c) -> Column:
    return F.replace(blank(c), F.lit("_"), F.lit(" "))


def humanize_tier2(detailed, primary) -> Column:
    """Leaf name: primary prefix off, _AND_ as ' & ', every _-separated word capitalised."""
    d, p = col(detailed), col(primary)
    suffix = F.when(F.startswith(d, F.concat(p, F.lit("_"))),
                    F.substr(d, F.length(p) + 2)).otherwise(d)
    words = F.filter(F.split(F.replace(suffix, F.lit("_AND_"), F.lit(" & ")), "_"),
                     lambda w: w != "")
    named = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                  F.lower(F.substr(w, F.lit(2)))))
    return (F.when(F.startswith(suffix, F.lit("OTHER_")) | (suffix == "OTHER"), "Other")
            .otherwise(F.array_join(named, " ")))


def parse_date(c) -> Column:
    """The first ten characters as an ISO date; anything else -> null."""
    return F.try_to_date(F.substring(col(c), 1, 10), "yyyy-M-d")


def iso_week(d) -> Column:
    d = col(d)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def last_complete_month(d) -> Column:
    return F.date_format(F.add_months(F.trunc(col(d), "MM"), -1), "yyyy-MM")


def csv_safe(c) -> Column:
    """A quote before text that a spreadsheet would read as a formula."""
    c = col(c)
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_safe_frame(df):
    """csv_safe on every string column; numbers stay numbers."""
    return df.select(*[csv_safe(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def money(c) -> Column:
    """'$1,234.56', "'-$58.28" -> decimal; unreadable -> null."""
    s = F.regexp_replace(col(c), "^'", "")
    return F.trim(F.regexp_replace(s, "[$,]", "")).try_cast("decimal(18,2)")


def ratio_or_zero(num, den) -> Column:
    num, den = col(num), col(den)
    return F.when(F.coalesce(den, F.lit(0)) != 0, num / den).otherwise(F.lit(0.0))


def canonical(c, dtype) -> Column:
    """One text per value, with field names sorted, for hashing nested rows of any schema."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        body = F.concat_ws(",", *[F.concat(F.lit(f.name + ":"), canonical(c[f.name], f.dataType))
                                  for f in fields])
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(c, lambda x: canonical(x, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    elif isinstance(dtype, T.StringType):
        text = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")),
                                              F.lit('"'), F.lit('\\"')), F.lit('"'))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def content_hash(df, columns) -> Column:
    """SHA-256 of the canonical text of the named columns, order of columns irrelevant."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.concat(F.lit(n + ":"), canonical(F.col(n), types[n])) for n in sorted(columns)]
    return F.sha2(F.concat_ws(",", *parts), 256)
