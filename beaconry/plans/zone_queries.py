"""Queries on buildings and zones."""

from __future__ import annotations

from beaconry import sinks
from beaconry.operators import zones
from beaconry.plans import inputs
from beaconry.plans.shape import rounded
from beaconry.schemas import BUILDING
from beaconry.session import scratch_path
from beaconry.sources import tables


def assign_zones(spark, sf_dir):
    return zones.assign_zones(inputs.buildings(spark, sf_dir), inputs.zones(spark))


def assign_zones_grid(spark, sf_dir):
    return zones.assign_zones_grid(inputs.buildings(spark, sf_dir), inputs.zones(spark))


def filter_to_zones(spark, sf_dir):
    return zones.filter_to_zones(inputs.buildings(spark, sf_dir), inputs.zones(spark))


def filter_to_zones_dedup(spark, sf_dir):
    return zones.filter_to_zones(inputs.buildings(spark, sf_dir), inputs.zones(spark), keep_multiplicity=False)


def zone_area(spark, sf_dir):
    """Area of each zone beside its buildings."""
    stats = zones.zone_stats(inputs.buildings(spark, sf_dir), inputs.zones(spark)).drop("name")
    return rounded(zones.zone_area(inputs.zones(spark)).join(stats, "zone_id"), area_km2=6)


def zone_stats(spark, sf_dir):
    return zones.zone_stats(inputs.buildings(spark, sf_dir), inputs.zones(spark))


def q1_count(spark, sf_dir):
    return zones.q1_count(inputs.buildings(spark, sf_dir), inputs.zones(spark), inputs.THRESHOLDS)


def q2_area(spark, sf_dir):
    answers = zones.q2_area(inputs.buildings(spark, sf_dir), inputs.zones(spark), inputs.THRESHOLDS)
    return rounded(answers, avg_area=7, total_area=4)


def q3_density(spark, sf_dir):
    answers = zones.q3_density(inputs.buildings(spark, sf_dir), inputs.zones(spark), inputs.THRESHOLDS)
    return rounded(answers, area_km2=6, density_per_km2=6)


def q5_confidence_dist(spark, sf_dir):
    return zones.q5_confidence_dist(inputs.buildings(spark, sf_dir), inputs.zones(spark), inputs.BIN_COUNTS)


def _csv(spark, sf_dir, compression):
    folder = scratch_path(spark, "buildings")
    columns = [f.name for f in BUILDING.fields]
    sinks.write_buildings(inputs.buildings(spark, sf_dir).select(*columns), folder, compression)
    return tables.read_buildings(spark, folder)


def buildings_csv(spark, sf_dir):
    """Buildings written as CSV files and read back."""
    return _csv(spark, sf_dir, None)


def buildings_gzip(spark, sf_dir):
    """Buildings written as compressed CSV files and read back."""
    return _csv(spark, sf_dir, "gzip")


QUERIES = {
    f.__name__: f
    for f in (
        assign_zones,
        assign_zones_grid,
        filter_to_zones,
        filter_to_zones_dedup,
        zone_area,
        zone_stats,
        q1_count,
        q2_area,
        q3_density,
        q5_confidence_dist,
        buildings_csv,
        buildings_gzip,
    )
}
