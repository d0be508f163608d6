"""Consistency features of recognised text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import let

#: Arabic-Indic and extended (Persian) digits, and their ASCII digits.
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
#: Lower-case letters with diacritics that are rarely stacked in names.
ODD_LETTERS = "ïîìöôòüûùäâàëêèÿ"
LEAST_YEAR, LATEST_YEAR = 1900, 2035
LEAST_AGE, GREATEST_AGE, LATEST_EXPIRY, EARLIEST_BIRTH = 15, 90, 2032, 1925
#: Consecutive dates that fall by more days are in bad order.
FALL_DAYS = 366 * 20
_DMY = r"([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{4})"
_YMD = r"([0-9]{4})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})"
_YEAR = r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, EASTERN_DIGITS, ASCII_DIGITS)


def has_arabic(text: Column) -> Column:
    """Whether a code point of the Arabic block occurs."""
    return text.rlike("[\\u0600-\\u06FF]")


def has_eastern_digits(text: Column) -> Column:
    return text.rlike("[\\u0660-\\u0669\\u06F0-\\u06F9]")


def years(text: Column) -> Column:
    """All 19xx and 20xx tokens, as ints."""
    return F.transform(F.regexp_extract_all(text, F.lit(_YEAR), F.lit(1)), lambda y: y.cast("int"))


def date_parts(text: Column) -> Column:
    """Structs (y, m, d) of day-month-year and then year-month-day tokens, whether or not they are dates."""

    def parsed(pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: x.cast("int")) for i in order)
        return F.transform(F.arrays_zip(y.alias("y"), m.alias("m"), d.alias("d")), lambda x: F.struct(x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d")))

    return F.concat(parsed(_DMY, (3, 2, 1)), parsed(_YMD, (1, 2, 3)))


def valid_dates(parts: Column) -> Column:
    """Those (y, m, d) that are calendar dates of the years 1900 to 2035, as dates."""
    found = F.transform(parts, lambda x: F.try_to_date(F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]), "yyyy-MM-dd"))
    return F.filter(found, lambda x: x.isNotNull() & F.year(x).between(LEAST_YEAR, LATEST_YEAR))


def dates(text: Column) -> Column:
    """Valid dates of a text with ASCII digits."""
    return valid_dates(date_parts(text))


def is_latin(token: Column) -> Column:
    """At least three letters, and at least 60 % of the letters Latin."""
    letters, latin = F.regexp_count(token, F.lit(r"\p{L}")), F.regexp_count(token, F.lit(r"\p{IsLatin}"))
    return (letters >= 3) & (latin * 10 >= letters * 6)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def odd_letters(token: Column) -> Column:
    """Odd lower-case letters of a token."""
    return F.length(token) - F.length(F.translate(token, ODD_LETTERS, ""))


def chronology(found: Column) -> dict[str, Column]:
    """Flags over an array of valid dates in text order; all false with fewer than two.

    The years from the earliest to the latest are under 15 or over 90; the
    latest is after 2032 or the earliest before 1925; one of these, or dates
    in bad order.
    """
    first, last = F.year(F.array_min(found)), F.year(F.array_max(found))
    several = F.size(found) >= 2
    age = several & ((last - first > GREATEST_AGE) | (last - first < LEAST_AGE))
    outside = several & ((last > LATEST_EXPIRY) | (first < EARLIEST_BIRTH))
    return {"implausible_age": age, "future_or_ancient": outside, "chrono_violation": age | outside | (falling_steps(found) > 0)}


def falling_steps(found: Column, days: int = FALL_DAYS) -> Column:
    """Consecutive dates that fall by more than so many days."""
    n = F.size(found)
    pairs = F.zip_with(F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(found, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.datediff(a, b) > days)
    return F.when(n < 2, 0).otherwise(F.size(F.filter(pairs, lambda x: x)))


def year_mismatch(latin: Column, arabic: Column) -> Column:
    """Share of the Latin-script years that are not among the Arabic-script ones; 0 if either side has none."""
    missing = F.size(F.filter(latin, lambda y: ~F.array_contains(arabic, y)))
    return F.when((F.size(latin) == 0) | (F.size(arabic) == 0), 0.0).otherwise(missing / F.size(latin))


def box_stats(heights: Column) -> dict[str, Column]:
    """Coefficient of variation and max over median of box heights; 0 for under four boxes."""
    n = F.size(heights).cast("double")
    ordered = F.array_sort(heights)
    mean = F.aggregate(heights, F.lit(0.0), lambda a, x: a + x) / n
    var = let(mean, lambda m: F.aggregate(heights, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))) / n
    half = F.size(heights)
    median = (F.get(ordered, F.floor((half - 1) / 2).cast("int")) + F.get(ordered, F.floor(half / 2).cast("int"))) / 2
    few = F.size(heights) < 4
    return {"box_h_cv": F.when(few, 0.0).otherwise(F.sqrt(var) / (mean + 1e-6)), "box_h_max_over_med": F.when(few, 0.0).otherwise(F.array_max(heights) / (median + 1e-6))}


def polygon_box(points: Column) -> Column:
    """Struct (x, y, w, h) around an array of [x, y] points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def stem_and_suffix(path: Column) -> tuple[Column, Column]:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))


def typst_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in "#$@*_<>[]`":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def id_probe(df: DataFrame, id_: str = "id", label: str = "label") -> DataFrame:
    """One row: correlation of the id's first eight hexadecimal digits with the label."""
    return df.agg(F.corr(F.conv(F.substring(id_, 1, 8), 16, 10).cast("double"), F.col(label).cast("double")).alias("r"))


#: The names of the feature vector of `consistency_features`, in order.
FEATURES = (
    "n_tokens", "total_text_len", "mean_conf", "min_conf", "frac_conf_lt30", "frac_conf_lt50", "std_conf",
    "n_latin_dates", "n_arabic_date_tokens", "n_valid_dates", "n_distinct_years", "year_span",
    "chrono_violation", "implausible_age", "future_or_ancient", "n_date_pairs_bad_order",
    "has_dual_script", "crossscript_year_mismatch_frac", "crossscript_any_mismatch",
    "name_weird_accent_ct", "name_weird_accent_frac", "n_latin_name_tokens",
    "box_h_cv", "box_h_max_over_med",
)


def consistency_features(items: DataFrame, keys: tuple[str, ...], text: str = "text", score: str = "score", height: str = "height", order: str = "position", script: str | None = None) -> DataFrame:
    """(keys, 24 features): recognised items of a document, one row each, as doubles.

    An item is Arabic if its ``script`` says so or, without one, if it has
    eastern digits. Years of Latin dates are held against the years of Arabic
    items. Each item's text counts as one name token. A null score counts as
    0; items without a box have a null height. What is absent is 0. Items are
    measured row by row; a document gathers only its dates, years and heights.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    arabic = has_eastern_digits(t)
    if script:
        arabic = F.when(F.coalesce(F.col(script), F.lit("")) != "", F.col(script) == "arabic").otherwise(arabic)
    items = items.select(*keys, F.col(order).alias("__o"), F.col(text).alias("__text"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("__s"), F.col(height).cast("double").alias("__h"), t.alias("__t"), arabic.alias("__ar"))
    items = items.withColumn("__parts", date_parts(ascii_digits(F.col("__t")))).withColumn("__latin", is_latin(F.col("__t")))
    years_of = lambda parts: F.transform(parts, lambda x: x["y"])
    found = F.concat(years_of(F.col("__parts")), years(ascii_digits(F.col("__t"))))
    items = items.withColumn("__years", F.when(F.col("__ar"), found))
    latin_dates = F.when(~F.col("__ar") & (F.size("__parts") > 0), F.struct("__o", "__parts"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sum0 = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda limit: F.avg((F.col("__s") < limit).cast("double"))
    whole = items.groupBy(*keys).agg(
        count(F.col("__t") != "").alias("n_tokens"), F.sum(F.length("__t")).alias("total_text_len"),
        F.avg("__s").alias("mean_conf"), F.min("__s").alias("min_conf"), F.stddev_pop("__s").alias("std_conf"),
        share(0.30).alias("frac_conf_lt30"), share(0.50).alias("frac_conf_lt50"),
        F.flatten(F.transform(F.array_sort(F.collect_list(latin_dates)), lambda x: x["__parts"])).alias("__p"),
        F.flatten(F.collect_list("__years")).alias("__ar_years"), count(F.size("__years") > 0).alias("n_arabic_date_tokens"),
        sum0(F.when(F.col("__latin"), odd_letters(F.col("__t")))).alias("name_weird_accent_ct"),
        sum0(F.when(F.col("__latin"), F.regexp_count("__t", F.lit(r"\p{L}")))).alias("__letters"),
        count(F.col("__latin")).alias("n_latin_name_tokens"), F.collect_list("__h").alias("__h"),
    )
    whole = whole.withColumn("__d", valid_dates(F.col("__p"))).withColumn("__y", F.array_distinct(F.transform("__d", F.year)))
    latin_years = years_of(F.col("__p"))
    missing = year_mismatch(latin_years, F.col("__ar_years"))
    dual = (F.size("__p") > 0) & (F.size("__ar_years") > 0)
    values = {
        "n_latin_dates": F.size("__p"), "n_valid_dates": F.size("__d"), "n_distinct_years": F.size("__y"),
        "year_span": F.when(F.size("__y") >= 2, F.array_max("__y") - F.array_min("__y")).otherwise(0),
        **{k: F.coalesce(c, F.lit(False)) for k, c in chronology(F.col("__d")).items()}, "n_date_pairs_bad_order": falling_steps(F.col("__d")),
        "has_dual_script": dual, "crossscript_year_mismatch_frac": missing, "crossscript_any_mismatch": missing > 0,
        "name_weird_accent_frac": F.coalesce(F.try_divide(F.col("name_weird_accent_ct"), F.col("__letters")), F.lit(0.0)),
        **box_stats(F.col("__h")),
    }
    return whole.select(*keys, *[values.get(f, F.col(f)).cast("double").alias(f) for f in FEATURES])
