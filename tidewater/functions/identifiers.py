"""Parsers of security identifiers and form names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"

# Filing forms by category.
FORM_CATEGORIES = {
    "annual": ["10-K", "10-KT", "11-K", "20-F", "40-F"],
    "quarterly": ["10-Q", "10-QT"],
    "current": ["6-K", "8-K"],
    "registration": ["424B1", "424B2", "424B3", "424B4", "424B5", "F-1", "F-3", "F-4", "S-1", "S-11", "S-3", "S-4", "S-8"],
    "proxy": ["DEF 14A", "DEF 14C", "DEFA14A", "DEFC14A", "DEFR14A", "PRE 14A", "PRE 14C"],
    "insider": ["3", "3/A", "4", "4/A", "5", "5/A"],
    "institutional": ["13F-HR", "13F-HR/A", "13F-NT", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A"],
    "prospectus": ["485BPOS", "497", "497K", "N-CSR", "N-CSRS", "N-Q", "NPX"],
}
# Separators between root and class by venue.
VENUES = {"canonical": ".", "crsp": ".", "google": "/", "wiki": ".", "yahoo": "-"}


def cusip(code: Column) -> Column:
    """struct(cusip, valid, reason, check_digit) of a nine-character code: digits doubled in turn, added by digit, tens complement."""
    c = F.upper(F.trim(code))
    value = lambda k: F.instr(F.lit(_ALPHABET), c.substr(F.lit(0) + k, F.lit(1))) - 1
    doubled = lambda k: value(k) * F.when(k % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda a, k: (a + F.floor(doubled(k) / 10) + doubled(k) % 10).cast("int"))
    check = ((10 - total % 10) % 10).cast("int")
    shape = c.rlike(r"^[0-9A-Z*@#]{8}[0-9]$")
    reason = F.when(c.isNull() | (c == ""), "empty").when(F.length(c) != 9, "length").when(~shape, "characters").when(check != c.substr(9, 1).try_cast("int"), "check_digit").otherwise("")
    return F.struct(c.alias("cusip"), (reason == "").alias("valid"), reason.alias("reason"), F.when(shape, check).alias("check_digit"))


def occ(symbol: Column, long_strikes: bool = False) -> Column:
    """struct(root, expiry, right, strike) of an option symbol; null if it isn't one.

    A strike has eight digits; ``long_strikes`` reads those of more as well.
    """
    s = F.upper(F.regexp_replace(symbol, " ", ""))
    pattern = r"^([A-Z][A-Z0-9.]{0,5})(\d{2})(\d{2})(\d{2})([CP])(\d{8" + ("," if long_strikes else "") + r"})$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    day = F.try_to_date(F.concat(F.lit("20"), part(2), F.lit("-"), part(3), F.lit("-"), part(4)), "yyyy-MM-dd")
    strike = part(6).try_cast("double") / 1000
    return F.when(s.rlike(pattern) & day.isNotNull() & (strike > 0), F.struct(part(1).alias("root"), day.alias("expiry"), part(5).alias("right"), strike.alias("strike")))


def sec_form(form: Column) -> Column:
    """struct(form, base, amendment, category): white space squeezed, upper case, /A marks an amendment."""
    f = F.upper(F.trim(F.regexp_replace(form, r"\s+", " ")))
    amended = f.endswith("/A")
    base = F.when(amended, F.trim(F.regexp_replace(f, r"/A$", ""))).otherwise(f)
    table = F.create_map(*[F.lit(x) for category, forms in FORM_CATEGORIES.items() for f_ in forms for x in (f_, category)])
    return F.struct(f.alias("form"), base.alias("base"), amended.alias("amendment"), F.coalesce(F.element_at(table, f), F.element_at(table, base), F.lit("other")).alias("category"))


def ticker(symbol: Column) -> Column:
    """struct(root, suffix, permno) of a ticker; null if it can't be read.

    Four to seven digits after a dot are a PERMNO; else the first kind of
    separator found, of . - /, must part exactly a root and a class.
    """
    t = F.upper(F.trim(symbol))
    number = t.rlike(r"^[A-Z0-9./-]+\.\d{4,7}$")
    separator = F.when(t.contains("."), F.lit(".")).when(t.contains("-"), F.lit("-")).when(t.contains("/"), F.lit("/"))
    root, rest = (F.call_function("substring_index", t, separator, F.lit(k)) for k in (1, -1))
    once = F.length(t) - F.length(F.replace(t, separator, F.lit(""))) == 1
    tagged = F.struct(F.regexp_extract(t, r"^(.+)\.(\d{4,7})$", 1).alias("root"), F.lit(None).cast("string").alias("suffix"), F.regexp_extract(t, r"^(.+)\.(\d{4,7})$", 2).try_cast("int").alias("permno"))
    plain = F.struct(t.alias("root"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("int").alias("permno"))
    split = F.struct(root.alias("root"), rest.alias("suffix"), F.lit(None).cast("int").alias("permno"))
    return F.when(~t.rlike(r"^[A-Z0-9./-]+$"), F.lit(None)).when(number, tagged).when(separator.isNull(), plain).when(once & (root != "") & (rest != ""), split)


def ticker_for(symbol: Column, venue: str) -> Column:
    """The ticker as a venue writes it; crsp keeps the PERMNO."""
    p = ticker(symbol)
    named = F.when(p["suffix"].isNotNull(), F.concat(p["root"], F.lit(VENUES[venue]), p["suffix"])).otherwise(p["root"])
    return F.when(p["permno"].isNotNull(), F.concat(p["root"], F.lit("."), p["permno"].cast("string"))).otherwise(named) if venue == "crsp" else named
