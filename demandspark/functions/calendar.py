"""Calendar, holiday and solar features: pure column expressions, no join and no Python per row."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.times import utc_offset_hours
from demandspark.params import Params

# United States federal holidays, each with the first year this rule is used for.
FIXED_HOLIDAYS = (
    (1, 1, 1938, "New Year's Day"),
    (6, 19, 2021, "Juneteenth National Independence Day"),
    (7, 4, 1938, "Independence Day"),
    (11, 11, 1938, "Veterans Day"),
    (12, 25, 1938, "Christmas Day"),
)
# month, weekday (0 = Monday), which occurrence (-1 = last), first year, name
FLOATING_HOLIDAYS = (
    (1, 0, 3, 1986, "Martin Luther King Jr. Day"),
    (2, 0, 3, 1971, "Washington's Birthday"),
    (5, 0, -1, 1971, "Memorial Day"),
    (9, 0, 1, 1894, "Labor Day"),
    (10, 0, 2, 1971, "Columbus Day"),
    (11, 3, 4, 1942, "Thanksgiving Day"),
)

# Solar geometry constants in degrees.
AXIAL_TILT = 23.44
SUNRISE_ALTITUDE = -0.833


def _occurs(day: Column, month: int, dow: int, nth: int) -> Column:
    """The nth given weekday of a month, -1 for the last one."""
    dom = F.dayofmonth(day)
    week = dom.between(7 * nth - 6, 7 * nth) if nth > 0 else F.month(F.date_add(day, 7)) != month
    return (F.month(day) == month) & (F.weekday(day) == dow) & week


def _shifted(month: int, dom: int, days: int) -> int:
    """Month and day of a neighbouring date as one number; none of the fixed dates is near a leap day."""
    moved = date(2001, month, dom) + timedelta(days=days)
    return moved.month * 100 + moved.day


def _rules(day: Column) -> list[tuple[Column, str]]:
    """Conditions and names. A fixed date on Saturday is also observed the Friday before, one on Sunday the Monday after."""
    key, dow, year = F.month(day) * 100 + F.dayofmonth(day), F.weekday(day), F.year(day)
    rules = []
    for suffix, shift, when in (("", 0, F.lit(True)), (" (observed)", -1, dow == 4), (" (observed)", 1, dow == 0)):
        for month, dom, since, label in FIXED_HOLIDAYS:
            rules.append(((key == _shifted(month, dom, shift)) & when & (year >= since), label + suffix))
    for month, weekday, nth, since, label in FLOATING_HOLIDAYS:
        rules.append((_occurs(day, month, weekday, nth) & (year >= since), label))
    return rules


# Public holidays of other countries. Fixed dates are (month, day, first year, name); movable ones are days
# after Easter Sunday with first year and name; floating ones as for the United States.
OTHER_COUNTRIES = {
    "DE": {
        "fixed": (
            (1, 1, 1949, "Neujahr"), (5, 1, 1949, "Tag der Arbeit"), (10, 3, 1990, "Tag der Deutschen Einheit"),
            (12, 25, 1949, "Erster Weihnachtstag"), (12, 26, 1949, "Zweiter Weihnachtstag"),
        ),
        "easter": ((-2, 1949, "Karfreitag"), (1, 1949, "Ostermontag"), (39, 1949, "Christi Himmelfahrt"), (50, 1949, "Pfingstmontag")),
        "once": ((date(2017, 10, 31), "Reformationstag"),),
    },
    "FR": {
        "fixed": (
            (1, 1, 1811, "Jour de l'an"), (5, 1, 1919, "Fête du Travail"), (5, 8, 1982, "Fête de la Victoire"),
            (7, 14, 1880, "Fête nationale"), (8, 15, 1802, "Assomption"), (11, 1, 1802, "Toussaint"),
            (11, 11, 1922, "Armistice"), (12, 25, 1802, "Noël"),
        ),
        "easter": ((1, 1886, "Lundi de Pâques"), (39, 1802, "Ascension"), (50, 1886, "Lundi de Pentecôte")),
    },
    "GB": {  # England; days that fall on a weekend are made up for on the next working days
        "fixed": ((1, 1, 1975, "New Year's Day"), (12, 25, 1871, "Christmas Day"), (12, 26, 1871, "Boxing Day")),
        "easter": ((-2, 1871, "Good Friday"), (1, 1871, "Easter Monday")),
        "floating": (
            (5, 0, 1, 1978, "Early May Bank Holiday"), (5, 0, -1, 1971, "Spring Bank Holiday"), (8, 0, -1, 1971, "Late Summer Bank Holiday"),
        ),
        "substitutes": True,
        "moved": (date(1995, 5, 1), date(2002, 5, 27), date(2012, 5, 28), date(2020, 5, 4), date(2022, 5, 30)),
        "once": (
            (date(1977, 6, 7), "Silver Jubilee"), (date(1981, 7, 29), "Royal Wedding"), (date(1995, 5, 8), "Early May Bank Holiday"),
            (date(1999, 12, 31), "Millennium"), (date(2002, 6, 3), "Golden Jubilee"), (date(2002, 6, 4), "Spring Bank Holiday"),
            (date(2011, 4, 29), "Royal Wedding"), (date(2012, 6, 4), "Spring Bank Holiday"), (date(2012, 6, 5), "Diamond Jubilee"),
            (date(2020, 5, 8), "Early May Bank Holiday"), (date(2022, 6, 2), "Spring Bank Holiday"), (date(2022, 6, 3), "Platinum Jubilee"),
            (date(2022, 9, 19), "State Funeral"), (date(2023, 5, 8), "Coronation"),
        ),
    },
}
COUNTRIES = ("US", *OTHER_COUNTRIES)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the computus."""

    def whole(x: Column, n: int) -> Column:
        return F.floor(x / n)

    century, golden = whole(year, 100), year % 19
    # Age of the moon on 21 March less the corrections of the centuries, then the way to the Sunday behind the full moon.
    epact = (19 * golden + century - whole(century, 4) - whole(century - whole(century + 8, 25) + 1, 3) + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * whole(year % 100, 4) - epact - (year % 100) % 4) % 7
    late = whole(golden + 11 * epact + 22 * to_sunday, 451)
    since_march = (epact + to_sunday - 7 * late + 22).cast("int")  # as a day of March
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), since_march - 1)


def _substitute(month: int, dom: int, day: Column) -> Column:
    """The next working day for a fixed date on a weekend; the second of two neighbours waits for the first."""
    key, dow = F.month(day) * 100 + F.dayofmonth(day), F.weekday(day)
    if (month, dom) == (12, 25):  # Saturday to Monday 27; Sunday to Tuesday 27, since Monday is the 26th
        return (key == 1227) & dow.isin(0, 1)
    if (month, dom) == (12, 26):  # Saturday to Monday 28; Sunday to Tuesday 28, since Monday makes up for the 25th
        return (key == 1228) & dow.isin(0, 1)
    return ((key == _shifted(month, dom, 2)) | (key == _shifted(month, dom, 1))) & (dow == 0)


def _other_rules(day: Column, country: str) -> list[tuple[Column, str]]:
    rules = OTHER_COUNTRIES[country]
    key, year = F.month(day) * 100 + F.dayofmonth(day), F.year(day)
    held = ~day.isin(*rules["moved"]) if rules.get("moved") else F.lit(True)
    out = [(day == F.lit(on), label) for on, label in rules.get("once", ())]
    out += [((key == month * 100 + dom) & (year >= since), label) for month, dom, since, label in rules["fixed"]]
    after = F.datediff(day, easter(year))
    out += [((after == days) & (year >= since), label) for days, since, label in rules["easter"]]
    for month, weekday, nth, since, label in rules.get("floating", ()):
        out.append((_occurs(day, month, weekday, nth) & (year >= since) & held, label))
    if rules.get("substitutes"):
        out += [(_substitute(month, dom, day) & (year >= since), label + " (substitute)") for month, dom, since, label in rules["fixed"]]
    return out


def known_country(country: str) -> str:
    if country not in COUNTRIES:
        raise ValueError(f"no holiday rules for {country!r}; known are {', '.join(COUNTRIES)}")
    return country


def holiday_name(day: Column, country: str = "US") -> Column:
    """Name of the public holiday on a date, including weekend substitutes, or NULL. An unknown country is an error."""
    rules = _rules(day) if known_country(country) == "US" else _other_rules(day, country)
    return F.coalesce(*[F.when(rule, label) for rule, label in rules])


def is_holiday(day: Column, country: str = "US") -> Column:
    """The same test without names: fixed dates are looked up together, which keeps the generated code small."""
    if known_country(country) != "US":
        return reduce(Column.__or__, [rule for rule, _ in _other_rules(day, country)])
    key, dow = F.month(day) * 100 + F.dayofmonth(day), F.weekday(day)
    hits = []
    for since in sorted({s for _, _, s, _ in FIXED_HOLIDAYS}):
        dates = [(m, d) for m, d, s, _ in FIXED_HOLIDAYS if s == since]
        on, before, after = ([_shifted(m, d, k) for m, d in dates] for k in (0, -1, 1))
        hits.append((key.isin(on) | ((dow == 4) & key.isin(before)) | ((dow == 0) & key.isin(after))) & (F.year(day) >= since))
    for month, weekday, nth, since, _ in FLOATING_HOLIDAYS:
        hits.append(_occurs(day, month, weekday, nth) & (F.year(day) >= since))
    return reduce(Column.__or__, hits)


def holiday_dim(spark: SparkSession, years: Iterable[int], country: str = "US") -> DataFrame:
    """One row per holiday date of the given years."""
    years = sorted(set(int(y) for y in years))
    spans = spark.createDataFrame([(y,) for y in years], "year int")
    days = spans.select(
        F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date")
    )
    return days.select("date", holiday_name(F.col("date"), country).alias("name")).where("name is not null")


def _wave(fn, value: Column, period: float) -> Column:
    return fn(value * (2 * math.pi) / F.lit(period))


def calendar_columns(ts: Column, params: Params) -> dict[str, Column]:
    hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
    holiday = is_holiday(F.to_date(ts), params.holiday_country)
    return {
        "hour": hour,
        "day_of_week": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "is_holiday": holiday.cast("int"),
        "month": month,
        "season": F.floor(month % 12 / 3).cast("int"),
        "hour_sin": _wave(F.sin, hour, 24.0),
        "hour_cos": _wave(F.cos, hour, 24.0),
        "dow_sin": _wave(F.sin, dow, 7.0),
        "dow_cos": _wave(F.cos, dow, 7.0),
    }


def daylight_hours(day_of_year: Column, latitude: float) -> Column:
    """Hours between sunrise and sunset; 0 and 24 in polar night and day."""
    lat, alt = math.radians(latitude), math.radians(SUNRISE_ALTITUDE)
    decl = F.sin((day_of_year - 81) * (2 * math.pi) / 365.0) * math.radians(AXIAL_TILT)
    cosine = (F.lit(math.sin(alt)) - F.sin(decl) * math.sin(lat)) / (F.cos(decl) * math.cos(lat))
    angle = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    return F.degrees(angle) * 2.0 / 15.0


def solar_noon(ts: Column, params: Params) -> Column:
    """Local clock hour of solar noon, from longitude and the real UTC offset."""
    return F.lit(12.0 - params.longitude / 15.0) + utc_offset_hours(ts, params.timezone)


def seasonal_columns(ts: Column, params: Params) -> dict[str, Column]:
    doy = F.dayofyear(ts)
    daylight = daylight_hours(doy, params.latitude)
    noon = solar_noon(ts, params)
    middle = F.hour(ts) + F.lit(0.5)  # an hourly bucket stands for its midpoint
    return {
        "day_of_year_sin": _wave(F.sin, doy, 365.25),
        "day_of_year_cos": _wave(F.cos, doy, 365.25),
        "week_of_year": F.weekofyear(ts),
        "daylight_hours": daylight,
        "is_daylight": ((middle >= noon - daylight / 2) & (middle <= noon + daylight / 2)).cast("int"),
        "hours_from_solar_noon": F.abs(middle - noon),
    }


def add_calendar(df: DataFrame, params: Params, ts: str = "hour_ts") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts), params))


def add_seasonal(df: DataFrame, params: Params, ts: str = "hour_ts") -> DataFrame:
    return df.withColumns(seasonal_columns(F.col(ts), params))
