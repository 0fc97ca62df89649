"""Answers to a table of mixed requests, each distinct question computed once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators import zones as Z
from beaconry.operators.requests import DEFAULT_BINS, DEFAULT_CONFIDENCE, param, validate_requests
from beaconry.session import materialize

# Result columns and their types; each request fills those of its query type.
RESULT = {
    "count": "bigint",
    "avg_area": "double",
    "total_area": "double",
    "n": "bigint",
    "area_km2": "double",
    "density_per_km2": "double",
    "density_a": "double",
    "density_b": "double",
    "winner": "string",
    "bucket_counts": "string",
}
# What tells questions apart. A column that a query type does not use is null.
QUESTION = ("query_type", "zone_id", "zone_b", "confidence_min", "bins")


def with_question(requests: DataFrame) -> DataFrame:
    """Replaces type and parameters by the question columns, defaults filled in."""
    kind = F.upper("query_type")
    columns = {
        "query_type": kind,
        "zone_id": F.when(kind == "Q4", param("zone_a")).otherwise(param("zone_id")),
        "zone_b": F.when(kind == "Q4", param("zone_b")),
        "confidence_min": F.when(kind != "Q5", F.coalesce(param("confidence_min"), F.lit(DEFAULT_CONFIDENCE))),
        "bins": F.when(kind == "Q5", F.coalesce(param("bins"), F.lit(DEFAULT_BINS))),
    }
    others = [c for c in requests.columns if c not in ("query_type", "params")]
    return requests.select(*others, *[column.alias(name) for name, column in columns.items()])


def _validated(questions: DataFrame, zones: DataFrame) -> DataFrame:
    as_params = F.struct("zone_id", F.col("zone_id").alias("zone_a"), "zone_b", "confidence_min", "bins")
    return validate_requests(questions.withColumn("params", as_params), zones).drop("params")


def _result(values: dict[str, Column]) -> list[Column]:
    return [values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in RESULT.items()]


def answer_questions(questions: DataFrame, profile: DataFrame, zones: DataFrame) -> DataFrame:
    """Distinct questions with their answers, or with the reason why there is none."""
    checked = _validated(questions, zones)
    valid = checked.where(F.col("error_reason").isNull())
    single = valid.where(F.col("query_type").isin("Q1", "Q2", "Q3"))
    pair = valid.where(F.col("query_type") == "Q4")
    spread = valid.where(F.col("query_type") == "Q5")
    common = [*QUESTION, "error_reason"]

    both = F.when(F.col("query_type") == "Q4", F.array("zone_id", "zone_b")).otherwise(F.array("zone_id"))
    asked = valid.where(F.col("query_type") != "Q5").select(F.explode(both).alias("zone_id"), "confidence_min")
    totals = Z.threshold_totals(profile, asked.distinct()).join(Z.zone_area(zones), "zone_id")
    facts = totals.select(
        "zone_id",
        "confidence_min",
        *Z.area_answer(),
        "area_km2",
        Z.density(F.col("n"), F.col("area_km2")).alias("density_per_km2"),
    )

    def of(kind: str, name: str) -> Column:
        return F.when(F.col("query_type") == kind, F.col(name))

    singles = single.join(facts, ["zone_id", "confidence_min"]).select(
        *common,
        *_result(
            {
                "count": F.coalesce(of("Q1", "n"), of("Q3", "n")),
                "avg_area": of("Q2", "avg_area"),
                "total_area": of("Q2", "total_area"),
                "n": of("Q2", "n"),
                "area_km2": of("Q3", "area_km2"),
                "density_per_km2": of("Q3", "density_per_km2"),
            }
        ),
    )
    compared = Z.q4_compare(facts, pair.withColumnRenamed("zone_id", "zone_a")).withColumnRenamed("zone_a", "zone_id")
    pairs = compared.select(*common, *_result({c: F.col(c) for c in ("density_a", "density_b", "winner")}))
    buckets = Z.bucket_text(Z.histogram(profile, spread.select("zone_id", "bins")))
    spreads = spread.join(buckets, ["zone_id", "bins"]).select(
        *common, *_result({"bucket_counts": F.col("bucket_counts")})
    )
    refused = checked.where(F.col("error_reason").isNotNull()).select(*common, *_result({}))
    return reduce(DataFrame.unionByName, (singles, pairs, spreads, refused))


def answer_requests(requests: DataFrame, buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """Every request with its answer, or with the reason why it has none.

    The requests are read twice, for their distinct questions and for the join
    with the answers, the buildings once, for the profile of the zones. Both
    small tables, and the answers, are written in between (eagerly).
    """
    asked = with_question(requests)
    questions = materialize(asked.select(*QUESTION).distinct(), "questions")
    profile = materialize(Z.zone_profile(Z.assign_zones(buildings, zones)), "profile")
    answers = materialize(answer_questions(questions, profile, zones), "answers")
    same = reduce(Column.__and__, [asked[c].eqNullSafe(answers[c]) for c in QUESTION])
    return asked.join(answers, same).select(
        *[asked[c] for c in asked.columns], *[answers[c] for c in ("error_reason", *RESULT)]
    )


def compare_requests(requests: DataFrame, buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """The valid two-zone requests with their densities and the denser zone."""
    pairs = answer_requests(requests.where(F.upper("query_type") == "Q4"), buildings, zones)
    return pairs.where(F.col("error_reason").isNull()).select(
        "query_id",
        F.col("zone_id").alias("zone_a"),
        "zone_b",
        "confidence_min",
        "density_a",
        "density_b",
        "winner",
    )
