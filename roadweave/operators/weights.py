"""Length, speed and directional driving time of edges. Each is one projection, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.geometry import line_length

LENGTH = "decimal(9,4)"  # metres
SECONDS = "decimal(8,2)"
CLOSED = -1

# fixed values: km/h by road dedication
DEDICATION_SPEED = {1301: 130, 1303: 100, 1305: 70, 1306: 50, 1307: 30, 9999: 30}
# fixed values: state codes of a road out of use or under construction
OUT_OF_USE = [2100, 4000]


def set_length(edges: DataFrame) -> DataFrame:
    return edges.withColumn("distance", line_length(F.col("pts")).cast(LENGTH))


def set_speed_authority(edges: DataFrame) -> DataFrame:
    speed = F.lit(None).cast("int")
    for code, kmh in DEDICATION_SPEED.items():
        speed = F.when(F.col("widmung") == code, F.lit(kmh)).otherwise(speed)
    return edges.withColumn("maxspeed", speed)


def community_speed() -> Column:
    """First matching rule wins; the order of the rules is part of their meaning."""
    c = F.col
    given, road, kind, zone = c("maxspeed"), c("highway"), c("maxspeed_type"), c("zone_traffic")
    unset = given.isNull()
    unlimited = given == "none"
    # fixed values: speed rules in their order
    rules = [
        ((unlimited | unset) & (road == "motorway"), "130"),
        ((unlimited | unset) & (road == "motorway_link"), "55"),
        (unset & ((kind == "DE:rural") | (zone == "DE:rural")), "100"),
        (unset & ((kind == "DE:urban") | (zone == "DE:urban")), "50"),
        (unlimited, "130"),
        (unset & (road == "trunk"), "100"),
        (unset & (road == "trunk_link"), "55"),
        (unset & (road == "primary"), "70"),
        (unset & (road == "primary_link"), "50"),
        (unset & (road == "secondary"), "60"),
        (unset & (road == "tertiary"), "50"),
        (unset & road.isin("secondary_link", "tertiary_link"), "40"),
        (unset & (road == "unclassified"), "50"),
        (unset & ((road == "residential") | (kind == "DE:zone30")), "30"),
        (unset & ((road == "service") | (kind == "DE:zone20")), "20"),
        ((unset & (road == "living_street")) | (given == "walk"), "7"),
    ]
    chain = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for condition, kmh in rules[1:]:
        chain = chain.when(condition, F.lit(kmh))
    return chain.otherwise(given)


def set_speed_community(edges: DataFrame) -> DataFrame:
    return edges.withColumn("maxspeed", community_speed())


@dataclass(frozen=True)
class Profile:
    """Which attribute closes which direction of an edge (three Columns, NULL = not closed)."""

    closed_backward: Column
    closed_forward: Column
    closed_both: Column


def authority_profile() -> Profile:
    way = F.col("fahrtrichtung")
    return Profile(way == True, way == False, F.col("zustand").isin(OUT_OF_USE))  # noqa: E712


def community_profile() -> Profile:
    way = F.col("oneway")
    return Profile(way.isin("yes", "true", "1"), way == "-1", F.col("highway") == "construction")


def speed_number(lenient: bool = False) -> Column:
    """Speed as an exact number. Strict by default: text that is no number, or 0, stops the job."""
    speed = F.col("maxspeed").cast("string")
    if not lenient:
        return speed.cast("decimal(9,3)")
    return F.nullif(speed.try_cast("decimal(9,3)"), F.lit(0).cast("decimal(9,3)"))


def travel_seconds(length: Column, speed: Column) -> Column:
    """metres * 3.6 / (km/h), rounded half up to hundredths in exact decimal arithmetic."""
    return (length * F.lit("3.6").cast("decimal(2,1)") / speed).cast(SECONDS)


def set_weights(edges: DataFrame, profile: Profile, lenient: bool = False) -> DataFrame:
    seconds = travel_seconds(F.col("distance"), speed_number(lenient))
    closed = F.lit(CLOSED).cast(SECONDS)
    return edges.withColumns(
        {
            "weights_car": F.when(profile.closed_both | profile.closed_forward, closed).otherwise(seconds),
            "weights_car_reverse": F.when(profile.closed_both | profile.closed_backward, closed).otherwise(seconds),
        }
    )
