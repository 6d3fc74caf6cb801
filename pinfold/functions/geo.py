"""Geographic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_195.0
#: Bounding boxes (south, north, west, east) of the states outside the mainland, and of it.
STATE_BOXES = {"HI": (18.5, 22.5, -161.0, -154.0), "AK": (51.0, 72.0, -180.0, -129.0)}
MAINLAND = (24.3, 49.6, -125.0, -66.4)
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle metres; the root is clamped to one."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2.0))
    root = F.sqrt(half(a, c) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * half(b, d))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), root))


def rounded(x: Column | str, places: int) -> Column:
    """Round half up on the binary value: the same in every engine."""
    return F.floor(_col(x) * 10.0**places + 0.5) / 10.0**places


def cell(degrees: Column | str, per_degree: float) -> Column:
    """Grid cell of a coordinate, counted from below."""
    return F.floor(_col(degrees) * per_degree).cast("long")


def cell_toward_zero(degrees: Column | str, per_degree: float) -> Column:
    """Grid cell that truncates: another one for negative coordinates."""
    return (_col(degrees) * per_degree).cast("long")


def coord_key(degrees: Column | str) -> Column:
    """A coordinate to five decimals as a whole number."""
    return F.floor(_col(degrees) * 100000.0 + 0.5).cast("long")


def in_box(lat: Column | str, lon: Column | str, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return _col(lat).between(south, north) & _col(lon).between(west, east)


def in_country(lat: Column | str, lon: Column | str, state: Column | str) -> Column:
    """A known state, and a point in its box or else in the mainland's."""
    known = _col(state).isin(STATES)
    place = F.when(_col(state) == "HI", in_box(lat, lon, STATE_BOXES["HI"])).when(_col(state) == "AK", in_box(lat, lon, STATE_BOXES["AK"])).otherwise(in_box(lat, lon, MAINLAND))
    return F.coalesce(known & place, F.lit(False))


def clean_fips(code: Column | str) -> Column:
    """County codes as five digits, empty if there are none."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(_col(code)), r"\.0$", ""), r"\D", "")
    return F.when(digits == "", F.lit("")).otherwise(F.lpad(digits, 5, "0"))


def valid_county(name: Column | str) -> Column:
    """A county name that is none of the marks for a missing one."""
    n = F.upper(F.trim(_col(name)))
    return F.coalesce(~n.isin("", "NOT AVAILABLE", "N/A"), F.lit(False))


#: Pin sizes by zoom: fixed values.
ZOOM_STOPS = ((2.0, 0.1), (4.0, 1.0), (7.0, 2.8), (9.0, 3.8), (14.0, 5.7), (18.0, 6.0))


def piecewise(x: Column | str, stops: tuple = ZOOM_STOPS) -> Column:
    """Linear between stops, constant outside them."""
    v = _col(x)
    out = F.when(v <= stops[0][0], F.lit(stops[0][1]))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        out = out.when(v <= x1, F.lit(y0) + F.lit(y1 - y0) * ((v - x0) / (x1 - x0)))
    return out.otherwise(F.lit(stops[-1][1]))


def zoom_size(zoom: Column | str) -> Column:
    """Size of a pin; from zoom nine on never below three."""
    size = piecewise(zoom)
    return F.when(_col(zoom) >= 9, F.greatest(F.lit(3.0), size)).otherwise(size)
