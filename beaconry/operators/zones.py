"""Points in overlapping zones, and the statistics asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.functions import box_area_km2, in_box
from beaconry.operators.sizes import dimension, is_small
from beaconry.schemas import ZONE

# The five zones and their bounding boxes, in degrees.
ZONES = [
    ("Z1", "Providencia", -33.445, -33.420, -70.640, -70.600),
    ("Z2", "Las Condes", -33.420, -33.390, -70.600, -70.550),
    ("Z3", "Maipu", -33.530, -33.490, -70.790, -70.740),
    ("Z4", "Santiago Centro", -33.460, -33.430, -70.670, -70.630),
    ("Z5", "Pudahuel", -33.470, -33.430, -70.810, -70.760),
]
BOX = ("lat_min", "lat_max", "lon_min", "lon_max")

# Up to this many zones a building is compared with every box on the map side.
MAX_BROADCAST_ZONES = 64
# Grid cells per degree at the finest level; a power of two keeps cell numbers exact.
CELLS_PER_DEGREE = 64
# A zone is at most this many cells long at its level.
CELLS_PER_SIDE = 4


def zone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, ZONE)


def zone_area(zones: DataFrame) -> DataFrame:
    return zones.select("zone_id", "name", box_area_km2(*map(F.col, BOX)).alias("area_km2"))


def assign_zones(buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """Every building once per zone that contains it, with ``zone_id``.

    A short zone table is broadcast after its size has been checked; a longer
    one goes through the grid, with the same result.
    """
    if not is_small(zones, MAX_BROADCAST_ZONES):
        return assign_zones_grid(buildings, zones)
    boxes = F.broadcast(zones.select("zone_id", *BOX))
    inside = in_box(F.col("latitude"), F.col("longitude"), *map(F.col, BOX))
    return buildings.join(boxes, inside).drop(*BOX)


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor(degrees * CELLS_PER_DEGREE / F.pow(F.lit(2.0), level)).cast("long")


def assign_zones_grid(buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """``assign_zones`` as an equi-join on grid cells, for any number of zones.

    A zone sits on the grid level where it spans only a few cells, so wide zones
    stay as cheap as narrow ones. A building looks up one cell per level in use.
    Past the broadcast size a crowded cell is left to the skew handling of the
    adaptive join.
    """
    extent = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    cells_long = F.greatest(extent * CELLS_PER_DEGREE / CELLS_PER_SIDE, F.lit(1.0))
    leveled = zones.select("zone_id", *BOX, F.ceil(F.log2(cells_long)).cast("int").alias("level"))

    def cells(low: str, high: str) -> Column:
        level = F.col("level")
        return F.explode(F.sequence(_cell(F.col(low), level), _cell(F.col(high), level)))

    covered = leveled.select("*", cells("lat_min", "lat_max").alias("row")).select(
        "*", cells("lon_min", "lon_max").alias("column")
    )
    # One small array: there are at most about twenty levels on the globe.
    levels = leveled.agg(F.collect_set("level")).scalar()
    placed = (
        buildings.withColumn("level", F.explode(levels))
        .withColumn("row", _cell(F.col("latitude"), F.col("level")))
        .withColumn("column", _cell(F.col("longitude"), F.col("level")))
    )
    inside = in_box(F.col("latitude"), F.col("longitude"), *map(F.col, BOX))
    # Up to MAX_BROADCAST_ROWS cells the buildings stay where they are.
    joined = placed.join(dimension(covered), ["level", "row", "column"])
    return joined.where(inside).drop("level", "row", "column", *BOX)


def filter_to_zones(buildings: DataFrame, zones: DataFrame, keep_multiplicity: bool = True) -> DataFrame:
    """Buildings inside any zone, without the zone.

    With ``keep_multiplicity`` a building in two zones appears twice; without it
    once.
    """
    if keep_multiplicity:
        return assign_zones(buildings, zones).drop("zone_id")
    if is_small(zones, MAX_BROADCAST_ZONES):
        boxes = F.broadcast(zones.select(*BOX))
        inside = in_box(F.col("latitude"), F.col("longitude"), *map(F.col, BOX))
        return buildings.join(boxes, inside, "left_semi")
    places = buildings.select("latitude", "longitude").distinct()
    kept = assign_zones_grid(places, zones).select("latitude", "longitude").distinct()
    return buildings.join(kept, ["latitude", "longitude"], "left_semi")


def zone_stats(buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """Buildings per zone and, in the row with null ``zone_id``, over all zones.

    A building in two zones counts in both, also in the total.
    """
    counts = assign_zones(buildings, zones).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    per_zone = zones.select("zone_id", "name").join(counts, "zone_id", "left")
    # The rollup runs over one row per zone.
    total = F.sum(F.coalesce("n", F.lit(0))).alias("n_buildings")
    name = F.when(F.grouping("zone_id") == 0, F.min("name")).alias("name")
    return per_zone.rollup("zone_id").agg(name, total)


# --- Threshold and histogram answers --------------------------------------------------
#
# Q1 to Q5 all ask how many buildings of a zone lie at or above some confidence.
# The buildings are first summed per (zone, confidence); the questions are then
# answered from that profile by running totals from the top, so no building meets
# more than one row per question and a hot zone is spread over its confidences.

# Running totals are split into this many slices of [0, 1] per zone.
SLICES = 1024


def zone_profile(zoned: DataFrame, cuts: tuple[float, ...] | None = None) -> DataFrame:
    """Buildings and areas per (zone, confidence); missing confidences (null, NaN) count at minus infinity.

    ``cuts`` names the only confidences that will be asked for. Each building
    then counts at the largest cut at or below its own confidence, which bounds
    the profile by the number of cuts whatever the data holds.
    """
    confidence = F.col("confidence")
    level = F.when(confidence.isNull() | F.isnan(confidence), F.lit(float("-inf")))
    for cut in sorted(set(cuts or ()), reverse=True):
        level = level.when(confidence >= cut, F.lit(float(cut)))
    level = level.otherwise(confidence if cuts is None else F.lit(float("-inf")))
    return zoned.groupBy("zone_id", level.alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("area_in_meters").alias("area"),
        F.count("area_in_meters").alias("area_n"),
    )


def tail_totals(profile: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question with the totals ``n``, ``area`` and ``area_n`` of its zone from a confidence up.

    ``questions`` has ``zone_id``, ``point`` and ``strict`` (true asks for
    confidences above the point only) beside any other columns.
    """
    sums = ("n", "area", "area_n")
    payload = F.struct(*questions.columns)
    # From the top: strict questions before buildings of the same value, others after.
    held = profile.select(
        "zone_id",
        F.coalesce("confidence", F.lit(float("-inf"))).alias("at"),
        F.lit(1).alias("turn"),
        F.lit(None).cast(questions.select(payload.alias("question")).schema["question"].dataType).alias("question"),
        "n",
        F.coalesce("area", F.lit(0.0)).alias("area"),
        "area_n",
    )
    asked = questions.select(
        "zone_id",
        F.col("point").alias("at"),
        F.when(F.col("strict"), 0).otherwise(2).alias("turn"),
        payload.alias("question"),
        *[F.lit(0).cast("double" if c == "area" else "long").alias(c) for c in sums],
    )
    slice_no = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("at"))) * SLICES).cast("int")
    # Never null, and declared so: a null filter pushed into one of the two uses
    # of the line would keep them from sharing one pass over the buildings.
    line = held.unionByName(asked).withColumn("slice", F.coalesce(slice_no, F.lit(0)))

    above = Window.partitionBy("zone_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per zone and slice: at most a few thousand per zone.
    slices = line.groupBy("zone_id", "slice").agg(*[F.sum(c).alias(c) for c in sums])
    carried = slices.select(
        "zone_id", "slice", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in sums]
    )
    within = Window.partitionBy("zone_id", "slice").orderBy(F.desc("at"), "turn")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    running = line.select("zone_id", "slice", "question", *[F.sum(c).over(so_far).alias(c) for c in sums])
    totals = running.where(F.col("question").isNotNull()).join(carried, ["zone_id", "slice"])
    return totals.select("question.*", *[(F.col(c) + F.col(f"{c}_above")).alias(c) for c in sums])


def threshold_totals(profile: DataFrame, asked: DataFrame) -> DataFrame:
    """``n``, ``area`` and ``area_n`` for (zone_id, confidence_min) rows.

    A threshold of zero or less counts every building of the zone, also those
    without a confidence. Zones without buildings give zeros.
    """
    minimum = F.col("confidence_min")
    # Missing confidences stand at minus infinity, so asking from there finds them too.
    point = F.when(minimum > 0, minimum).otherwise(F.lit(float("-inf")))
    questions = asked.select("zone_id", "confidence_min", point.alias("point"), F.lit(False).alias("strict"))
    return tail_totals(profile, questions).select("zone_id", "confidence_min", "n", "area", "area_n")


def _ask(zones: DataFrame, thresholds) -> DataFrame:
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return zones.select("zone_id", F.explode(levels).alias("confidence_min"))


def _zone_totals(buildings: DataFrame, zones: DataFrame, thresholds) -> DataFrame:
    positive = tuple(float(t) for t in thresholds if t > 0)
    profile = zone_profile(assign_zones(buildings, zones), positive)
    return threshold_totals(profile, _ask(zones, thresholds))


def count_answer() -> list[Column]:
    return [F.col("n").alias("count")]


def area_answer() -> list[Column]:
    mean = F.when(F.col("area_n") > 0, F.col("area") / F.col("area_n")).otherwise(0.0)
    return [mean.alias("avg_area"), F.col("area").alias("total_area"), F.col("n")]


def density(count: Column, area_km2: Column) -> Column:
    return F.when(area_km2 > 0, count / area_km2).otherwise(0.0)


def q1_count(buildings: DataFrame, zones: DataFrame, thresholds=(0.0,)) -> DataFrame:
    """Buildings per zone at or above each threshold."""
    totals = _zone_totals(buildings, zones, thresholds)
    return totals.select("zone_id", "confidence_min", *count_answer())


def q2_area(buildings: DataFrame, zones: DataFrame, thresholds=(0.0,)) -> DataFrame:
    """Mean and total area; buildings without an area count in ``n`` only."""
    totals = _zone_totals(buildings, zones, thresholds)
    return totals.select("zone_id", "confidence_min", *area_answer())


def q3_density(buildings: DataFrame, zones: DataFrame, thresholds=(0.0,)) -> DataFrame:
    """Buildings per square kilometre."""
    totals = _zone_totals(buildings, zones, thresholds)
    return totals.join(zone_area(zones), "zone_id").select(
        "zone_id",
        "confidence_min",
        *count_answer(),
        "area_km2",
        density(F.col("n"), F.col("area_km2")).alias("density_per_km2"),
    )


def q4_compare(densities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two zones by density. A tie goes to ``zone_b``.

    ``densities`` is a result of ``q3_density`` that covers the asked thresholds;
    ``pairs`` has zone_a, zone_b and confidence_min beside any other columns.
    """
    first = densities.select(
        F.col("zone_id").alias("zone_a"), "confidence_min", F.col("density_per_km2").alias("density_a")
    )
    second = densities.select(
        F.col("zone_id").alias("zone_b"), "confidence_min", F.col("density_per_km2").alias("density_b")
    )
    joined = pairs.join(first, ["zone_a", "confidence_min"]).join(second, ["zone_b", "confidence_min"])
    winner = F.when(F.col("density_a") > F.col("density_b"), F.col("zone_a")).otherwise(F.col("zone_b"))
    return joined.select(*pairs.columns, "density_a", "density_b", winner.alias("winner"))


def _edge(index: Column, bins: Column) -> Column:
    """Edge of an equal-width bin on [0, 1]: a multiple of the step, the last one exactly 1."""
    return F.when(index == bins, F.lit(1.0)).otherwise(index * (F.lit(1.0) / bins))


def histogram(profile: DataFrame, asked: DataFrame) -> DataFrame:
    """Confidence histogram for distinct (zone_id, bins) rows, empty bins included.

    Bins are half open, the last one closed; values outside [0, 1] and missing
    ones fall in no bin. A bin is the difference of two running totals.
    """
    bucket, bins = F.col("bucket"), F.col("bins")
    buckets = asked.select("zone_id", "bins", F.explode(F.sequence(F.lit(0), bins - 1)).alias("bucket")).select(
        "*", _edge(bucket, bins).alias("min"), _edge(bucket + 1, bins).alias("max")
    )
    at_edges = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("min").alias("point"), F.lit(False).alias("strict")),
        F.struct(F.lit(-1).alias("sign"), F.col("max").alias("point"), (bucket + 1 == bins).alias("strict")),
    )
    totals = tail_totals(profile, buckets.select("*", F.inline(at_edges)))
    return totals.groupBy("zone_id", "bins", "bucket", "min", "max").agg(
        F.sum(F.col("sign") * F.col("n")).alias("count")
    )


def histogram_cuts(bin_counts) -> tuple[float, ...]:
    """Every bin edge, and the next value above 1 so that 1 itself stays apart."""
    import math

    edges = {i * (1.0 / b) for b in bin_counts for i in range(b)} | {1.0, math.nextafter(1.0, 2.0)}
    return tuple(sorted(edges))


def q5_confidence_dist(buildings: DataFrame, zones: DataFrame, bin_counts=(5,)) -> DataFrame:
    """Histogram in long form: one row per zone, bin count and bucket."""
    profile = zone_profile(assign_zones(buildings, zones), histogram_cuts(bin_counts))
    sizes = F.array(*[F.lit(int(b)) for b in bin_counts])
    return histogram(profile, zones.select("zone_id", F.explode(sizes).alias("bins")))


def q5_buckets_nested(long_form: DataFrame) -> DataFrame:
    """One row per (zone, bins) with its buckets as an ordered array; at most ``bins`` per array."""
    bucket = F.struct("bucket", "min", "max", "count")
    return long_form.groupBy("zone_id", "bins").agg(F.array_sort(F.collect_list(bucket)).alias("buckets"))


def bucket_text(histogram_rows: DataFrame) -> DataFrame:
    """Bucket counts of each (zone, bins) as comma-joined text, in bucket order."""
    counts = F.transform("buckets", lambda b: b["count"].cast("string"))
    return q5_buckets_nested(histogram_rows).select(
        "zone_id", "bins", F.array_join(counts, ",").alias("bucket_counts")
    )
