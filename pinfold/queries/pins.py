"""The pin view: deterministic coordinates of table rows, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinfold.runtime import table

#: Names that are dealt to pins by their number, so that name rules have work to do.
SUFFIXES = (
    "Baptist Church", "Elementary School", "Masjid", "Temple Beth", "Zen Center", "Gurdwara", "Foundation", "Cemetery Chapel", "", "Bible Academy", "Hindu Mandir", "Realty LLC",
    "Saint Marys Parish", "Memorial Cemetery", "Academy Chapel", "Publishers", "Mikvah", "Catholic Daughters", "Messianic Council", "Messianic Congregation", "Relief Fund", "Study Group",
    "Ministries Inc", "Kingdom Hall",
)
HAVERSINE = "2*6371000e0*asin(least(1e0, sqrt(pow(sin(radians({c}-{a})/2),2e0) + cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2e0))))"


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


def round_sql(x: str, places: int) -> str:
    return f"floor(({x})*1e{places}+0.5)/1e{places}"


def coordinates(k: str, f: int) -> tuple[str, str]:
    """Latitude and longitude of a key, the same text in both dialects."""
    lat = f"40e0 + (({k}*{k}*31 + {k}*7919 + {f}*1237) % 19997)/100000e0 AS lat"
    lon = f"-75e0 + (({k}*{k}*17 + {k}*10473 + {f}*3571) % 25999)/100000e0 AS lon"
    return lat, lon


def suffix(k: str, dialect: str) -> str:
    values = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"element_at(array({values}), cast({k} % {len(SUFFIXES)} as int) + 1)" if dialect == "spark" else f"list_extract([{values}], ({k} % {len(SUFFIXES)})::INT + 1)"


_SIDES = {
    "customer": ("customer", "c_custkey", "c_nationkey", "c_mktsegment", 0),
    "supplier": ("supplier", "s_suppkey", "s_nationkey", "s_name", 1),
}


def pins(spark: SparkSession, sf_dir: str, side: str = "customer") -> DataFrame:
    """``row_id, name, rel, lat, lon, state, fips, segment`` of customers or suppliers."""
    source, key, nation, segment, f = _SIDES[side]
    rows = table(spark, sf_dir, source).join(table(spark, sf_dir, "nation"), F.col(nation) == F.col("n_nationkey"))
    return rows.selectExpr(
        f"{key} AS row_id", f"trim(concat('P', cast({key} % 7 as string), ' ', {suffix(key, 'spark')})) AS name", f"{nation} % 6 AS rel", *coordinates(key, f),
        "n_name AS state", f"lpad(cast({nation} as string), 5, '0') AS fips", f"{segment} AS segment",
    )


def pins_sql(side: str = "customer") -> str:
    """The same view as a sub-select."""
    source, key, nation, segment, f = _SIDES[side]
    return (
        f"(SELECT {key} AS row_id, trim(concat('P', ({key} % 7)::VARCHAR, ' ', {suffix(key, 'duckdb')})) AS name, {nation} % 6 AS rel, {', '.join(coordinates(key, f))}, n_name AS state,"
        f" lpad({nation}::VARCHAR, 5, '0') AS fips, {segment} AS segment FROM {source} JOIN nation ON {nation} = n_nationkey)"
    )


#: Three boxes in the area of the pins, one with a hole, as rings of [x, y].
POLYGONS = {
    "A": [[[-75.0, 40.0], [-74.9, 40.0], [-74.9, 40.1], [-75.0, 40.1], [-75.0, 40.0]]],
    "B": [
        [[-74.9, 40.0], [-74.76, 40.0], [-74.8, 40.18], [-74.9, 40.18], [-74.9, 40.0]],
        [[-74.86, 40.05], [-74.83, 40.05], [-74.83, 40.08], [-74.86, 40.08], [-74.86, 40.05]],
    ],
    "C": [[[-75.0, 40.12], [-74.93, 40.12], [-74.95, 40.16], [-75.0, 40.17], [-75.0, 40.12]]],
}


def polygons(spark: SparkSession) -> DataFrame:
    """The literal polygons as ``poly_id, rings``."""
    point = lambda p: F.array(F.lit(p[0]), F.lit(p[1]))
    rings = lambda rs: F.array(*[F.array(*[point(p) for p in r]) for r in rs])
    rows = F.array(*[F.struct(F.lit(k).alias("poly_id"), rings(r).alias("rings")) for k, r in POLYGONS.items()])
    return spark.range(1).select(F.inline(rows))


def edges_sql() -> str:
    """The edges of the literal polygons as a VALUES list ``poly_id, x1, y1, x2, y2``."""
    rows = [f"('{k}', {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for k, rs in POLYGONS.items() for r in rs for a, b in zip(r, r[1:])]
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") v(poly_id, x1, y1, x2, y2))"


def nation_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon a nation, ``poly_id, rings``: its customers' pins in order of their
    numbers.  The ring crosses itself, so what is inside is a matter of parity."""
    corner = F.struct("row_id", F.array("lon", "lat").alias("at"))
    rows = pins(spark, sf_dir).groupBy(F.col("state").alias("poly_id")).agg(F.transform(F.array_sort(F.collect_list(corner)), lambda c: c["at"]).alias("ring"))
    return rows.where("size(ring) >= 3").select("poly_id", F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("rings"))


def nation_edges_sql() -> str:
    """The edges of these polygons as a sub-select ``poly_id, x1, y1, x2, y2``."""
    on = lambda c: f"coalesce(lead({c}) OVER w, first_value({c}) OVER w)"
    return (
        f"(SELECT state AS poly_id, lon AS x1, lat AS y1, {on('lon')} AS x2, {on('lat')} AS y2 FROM {pins_sql()} WINDOW w AS (PARTITION BY state ORDER BY row_id)"
        " QUALIFY count(*) OVER (PARTITION BY state) >= 3)"
    )
