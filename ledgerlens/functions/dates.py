"""Date parsing and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]

_NAMES = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else m for m in MONTHS) + "|sept)"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[.,]* +)?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:[.]\d+)?)?"
#: After a date: nothing; a time of 24 hours, perhaps with a zone, which is dropped (the wall-clock time counts); a time of 12 hours.
_AFTER = {"": "()", " time": rf"[T ]+({_CLOCK}) *(?:z|utc|gmt|[+-]\d{{2}}:?\d{{2}})?", " am/pm": rf"[T ]+({_CLOCK}) *(?:[ap][.]?m[.]?)"}
#: The shapes of a date and the groups of its year, month and day (0: the first), tried in this order.
_LAYOUTS = {
    "y-m-d": (r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", 1, 3, 4),
    "d-m-y": (r"(\d{1,2})[-/. ]+(\d{1,2})[-/. ]+(\d{4})", 3, 2, 1),
    "d-mon-y": (_WEEKDAY + _DAY + r"[-/. ]*" + _NAMES + r"[-/. ,]*(\d{4})", 3, 2, 1),
    "d-m-yy": (r"(\d{1,2})[-/. ]+(\d{1,2})[-/. ]+(\d{2})", 3, 2, 1),
    "d-mon-yy": (_WEEKDAY + _DAY + r"[-/. ]*" + _NAMES + r"[-/. ,]+(\d{2})", 3, 2, 1),
    "mon-d-y": (_WEEKDAY + _NAMES + r"[-/. ]*" + _DAY + r"[-/. ,]+(\d{4})", 3, 1, 2),
    "y-mon-d": (r"(\d{4})[-/. ]*" + _NAMES + r"[-/. ]*(\d{1,2})", 1, 2, 3),
    "yyyymmdd": (r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
    "y-m": (r"(\d{4})[-/.](\d{1,2})", 1, 2, 0),
    "mon-y": (_NAMES + r"[-/. ,]*(\d{4})", 2, 1, 0),
}
#: A form is a layout and what follows it; only whole days take a time.
FORMS = {layout + kind: (rf"(?i)^{shape}{after}$", *groups, shape.count("(") - shape.count("(?") + 1)
         for kind, after in _AFTER.items() for layout, (shape, *groups) in _LAYOUTS.items() if not kind or groups[-1]}
FORMS["yyyymmddhhmmss"] = (r"(?i)^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})z?$", 1, 2, 3, 0)
# Two-digit years from this on are of the 1900s.
PIVOT = 69


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_form(col) -> Column:
    """The name of the first of FORMS that the text has; null for none."""
    text = F.trim(_c(col).cast("string"))
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, (pattern, *_) in FORMS.items()])


def _parsed(text: Column, form: str) -> Column:
    """The wall-clock time of a text that has the form; null where there is no such day or hour."""
    pattern, year, month, day, time = FORMS[form]
    put = lambda groups: F.regexp_replace(text, pattern, groups)
    rest = f"-${day}" if day else "-1"
    rest += " $4:$5:$6" if form == "yyyymmddhhmmss" else f" ${time}" if time else ""
    if "mon" in form:
        name = F.lower(F.substring(F.regexp_extract(text, pattern, month), 1, 3))
        number = ((F.instr(F.lit("".join(m[:3] for m in MONTHS)), name) + 2) / 3).cast("int").cast("string")
        iso = F.concat(put(f"${year}-"), number, put(rest))
    else:
        iso = put(f"${year}-${month}{rest}")
    if "yy" in form and "yyyy" not in form:
        iso = F.concat(F.when(F.regexp_extract(text, pattern, year) >= str(PIVOT), "19").otherwise("20"), iso)
    moment = iso.try_cast("timestamp_ntz")
    if not form.endswith("am/pm"):
        return moment
    hour, evening = F.hour(moment), text.rlike(r"(?i)p[.]?m[.]?$")
    shift = F.when(evening & (hour < 12), 12).when(~evening & (hour == 12), -12).otherwise(0)
    return F.when(hour.between(1, 12), moment + F.make_dt_interval(F.lit(0), shift))


def parse_of_form(col, form) -> Column:
    """The wall-clock time of a text whose form (`date_form`) is known."""
    form = _c(form)

    def parsed(text: Column) -> Column:
        out = F
        for name in FORMS:
            out = out.when(form == name, _parsed(text, name))
        return out

    return F.get(F.transform(F.array(F.trim(_c(col).cast("string"))), parsed), F.lit(0))


def parse_dayfirst(col, dtype=None, forms=None) -> Column:
    """Lenient day-first parse to a wall-clock timestamp; null when no form fits.

    The text's form (FORMS) decides how it is read: year-month-day; day-month-year
    with a number or a name as the month, an ordinal or a weekday, and a year of four
    or two digits; month-name-day-year; all digits; year and month (its first day);
    most with an optional time of 24 or 12 hours.  A zone is dropped: the written
    time counts.  ``forms`` names the ones to try (as found by `date_form` over the
    column, most frequent first); a text of another form is null then.  Columns that
    already hold dates or timestamps pass through (pass ``dtype``).
    """
    if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
        return _c(col).cast("timestamp_ntz")
    tried = list(FORMS if forms is None else forms)

    def parsed(text: Column) -> Column:
        out = F
        for form in tried:
            out = out.when(text.rlike(FORMS[form][0]), _parsed(text, form))
        return out if tried else F.lit(None).cast("timestamp_ntz")

    # in a lambda the forms stay out of the plan's generated code, which they would make too long to be compiled
    return F.get(F.transform(F.array(F.trim(_c(col).cast("string"))), parsed), F.lit(0))


def parse_iso(col, dtype=None) -> Column:
    """Year-first parse (also of the day-first forms with an unmistakable year), null when invalid."""
    return parse_dayfirst(col, dtype)


def month_start(col) -> Column:
    return F.trunc(_c(col).cast("date"), "MM")


def month_label(col) -> Column:
    """'yyyy-MM' text of the month a date falls in."""
    return F.date_format(_c(col), "yyyy-MM")


def add_time_features(df: DataFrame, date_col: str) -> DataFrame:
    """C11: integer year and month plus the 'yyyy-MM' period label."""
    d = F.col(date_col)
    return df.select("*", F.year(d).alias("year"), F.month(d).alias("month"),
                     month_label(d).alias("year_month"))
