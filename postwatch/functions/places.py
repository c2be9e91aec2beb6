"""Location scores, zones and places found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwatch.plans import defaults


def contains_any(col: Column, needles: list[str]) -> Column:
    """The text contains one of the needles.  One regex, so that the expression behind col stands
    in the plan once, also when the optimizer moves the condition into a filter."""
    if not needles:
        return F.lit(False)
    return col.rlike("|".join(rf"\Q{n}\E" for n in needles))


def location_score(
    place: Column,
    remote_pct: Column,
    source: Column,
    rings: list[tuple[int, list[str]]] = defaults.LOCATION_RINGS,
    department: str = defaults.HOME_DEPARTMENT,
    department_name: str = defaults.HOME_DEPARTMENT_NAME,
    prefiltered: list[str] = defaults.PREFILTERED_SOURCES,
) -> Column:
    """0-100, first rule that holds: full remote, gazetteer rings, home department, a postcode
    elsewhere, partly remote, a source that filters by place itself, unknown.

    place: a column that holds the normalized location ('' for none), not the expression, which
    each branch would evaluate again.  Places are found as substrings, spaces read as hyphens."""
    hyphened = F.replace(place, F.lit(" "), F.lit("-"))
    postcode = F.regexp_extract(place, r"(?U)\b(\d{5})\b", 1)
    score = F.when(remote_pct == 100, 100)
    for value, cities in rings:
        score = score.when(contains_any(hyphened, cities), value)
    return (
        score.when(
            place.rlike(rf"(?U)^{department}\s*-|\b{department}\d{{3}}\b")
            | hyphened.contains(department_name),
            60,
        )
        .when((postcode != "") & ~postcode.startswith(department), 30)
        .when(remote_pct >= 50, 70)
        .when(source.isin(prefiltered), 75)
        .otherwise(50)
    )


def haversine_km(
    lat: Column, lon: Column, centre: tuple[float, float] = defaults.ZONE_CENTRE
) -> Column:
    """Great-circle distance to the centre."""
    lat0, lon0 = (F.radians(F.lit(x)) for x in centre)
    half_lat = F.sin((F.radians(lat) - lat0) / 2)
    half_lon = F.sin((F.radians(lon) - lon0) / 2)
    h = half_lat * half_lat + F.cos(lat0) * F.cos(F.radians(lat)) * half_lon * half_lon
    return 2 * defaults.EARTH_RADIUS_KM * F.asin(F.sqrt(h))


def in_radius(
    located: Column,
    latitude: Column,
    longitude: Column,
    place: Column,
    centre: tuple[float, float] = defaults.ZONE_CENTRE,
    radius_km: float = defaults.ZONE_KM,
    departments: list[str] = (defaults.HOME_DEPARTMENT,),
) -> Column:
    """Within the radius when the row has usable coordinates, else by the department code that
    ends the place.  A latitude band is tested first: it is cheaper than the trigonometry."""
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    band = radius_km / 111.0  # a degree of latitude is over 111 km, so the band is wide enough
    near = lat.between(centre[0] - band, centre[0] + band) & (
        haversine_km(lat, lon, centre) <= radius_km
    )
    code = F.regexp_extract(F.coalesce(place, F.lit("")), r"(?U)(\d{2,3}|2[AB])\s*$", 1)
    return F.when(
        F.coalesce(located, F.lit(False)) & lat.isNotNull() & lon.isNotNull(), near
    ).otherwise(code.isin(list(departments)))


def in_zone(
    city: Column,
    postcode: Column,
    remote: Column,
    cities: list[str] = defaults.ZONE_CITIES,
    department: str = defaults.HOME_DEPARTMENT,
) -> Column:
    """Remote, or a postcode of the department, or a city name containing a zone city."""
    return (
        F.coalesce(remote, F.lit(False))
        | F.coalesce(postcode, F.lit("")).startswith(department)
        | contains_any(F.lower(F.coalesce(city, F.lit(""))), cities)
    )


def place_from_text(
    text: Column,
    low: Column,
    cities: list[str] = defaults.ZONE_CITIES,
    department_name: str = "Loire-Atlantique",
) -> Column:
    """First zone city of the list that the text names, else the department, else the first
    postcode in front of a capitalised word, else ''.  low: a column with the lower-cased text,
    which every branch looks at."""
    found = F.coalesce(*[F.when(low.contains(c), F.lit(c.title())) for c in cities])
    named = department_name.lower()
    return F.coalesce(
        found,
        F.when(contains_any(low, [named, named.replace("-", " ")]), F.lit(department_name)),
        F.regexp_extract(text, r"(?U)\b(\d{5})\s+[A-ZÉÈÀ][a-zé]", 1),
    )
