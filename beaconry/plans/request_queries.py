"""Queries on requests and on attempts to answer them."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry import sinks
from beaconry.operators import answers, replay, requests, summary
from beaconry.plans import inputs
from beaconry.plans.shape import rounded
from beaconry.session import scratch_path
from beaconry.sources import messages
from beaconry.streaming import jobs

ANSWER_DIGITS = {
    "avg_area": 7,
    "total_area": 4,
    "area_km2": 6,
    "density_per_km2": 6,
    "density_a": 6,
    "density_b": 6,
}
ROUTED = (
    "query_id",
    "cache_key",
    "mode",
    "route",
    "event",
    "topic",
    "next_retry_count",
    "latency_ms",
    "ttl",
    "failed_us",
)


def cache_key(spark, sf_dir):
    """Keys, and those with a confidence in thousandths, which the two digits of a key round."""
    keyed = requests.with_cache_key(inputs.requests(spark, sf_dir)).withColumnRenamed("cache_key", "coarse")
    fine = F.col("params").withField("confidence_min", (F.col("query_id") % 2001) / F.lit(1000.0))
    both = requests.with_cache_key(keyed.withColumn("params", fine))
    return both.select("query_id", "query_type", F.col("coarse").alias("cache_key"), F.col("cache_key").alias("fine_key"))


def validate_requests(spark, sf_dir):
    checked = requests.validate_requests(inputs.requests(spark, sf_dir), inputs.zones(spark))
    return checked.select("query_id", "query_type", "error_reason")


def q4_compare(spark, sf_dir):
    compared = answers.compare_requests(
        inputs.requests(spark, sf_dir), inputs.buildings(spark, sf_dir), inputs.zones(spark)
    )
    return rounded(compared, density_a=6, density_b=6)


def answer_requests(spark, sf_dir):
    answered = answers.answer_requests(
        inputs.requests(spark, sf_dir), inputs.buildings(spark, sf_dir), inputs.zones(spark)
    )
    columns = ("query_id", "query_type", "error_reason", *answers.RESULT)
    return rounded(answered.select(*columns), **ANSWER_DIGITS)


def _routed(routed):
    failed = F.when(F.col("route").isin("retry", "dlq", "failed"), F.col("error"))
    return routed.select(*ROUTED, failed.alias("error"))


def route_attempts(spark, sf_dir):
    return _routed(requests.route_attempts(inputs.attempts(spark, sf_dir)))


def stream_route_attempts(spark, sf_dir):
    """Attempts written as messages, routed as a stream, read back from the routing log."""
    folder = _routing(spark, sf_dir)
    routed = requests.route_attempts(inputs.attempts(spark, sf_dir))
    return _routed(spark.read.schema(routed.schema).parquet(f"{folder}/out/routed"))


def _routing(spark, sf_dir, batches=3):
    """Attempts routed as a stream of at least so many micro-batches; the folder of what it wrote."""
    folder = scratch_path(spark, "routing")
    rows = inputs.attempts(spark, sf_dir).repartition(max(batches, spark.sparkContext.defaultParallelism))
    sinks.write_json_messages(rows, f"{folder}/attempts")
    files = len(messages.read_folder_once(spark, f"{folder}/attempts").inputFiles())
    query = jobs.start_routing_job(
        messages.read_folder(spark, f"{folder}/attempts", files_per_trigger=max(1, files // batches)),
        f"{folder}/out",
        f"{folder}/checkpoint",
        trigger=jobs.UNTIL_DONE,
    )
    query.awaitTermination()
    return folder


def attempt_events(spark, sf_dir):
    """The events that attempts report, with their timings."""
    routed = requests.route_attempts(inputs.attempts(spark, sf_dir))
    return requests.attempt_events(routed)


def stream_routed_topics(spark, sf_dir):
    """Retry and dead-letter messages of a routing stream, read back from their topics."""
    folder = _routing(spark, sf_dir)
    retry = "query_id long, query_type string, retry_count int, created_us long"
    back = {}
    for topic, schema in ((requests.RETRY_TOPIC, retry), (requests.DEAD_LETTER_TOPIC, f"{retry}, failed_us long, error string")):
        rows = spark.read.schema("value string").text(f"{folder}/out/{topic}")
        back[topic] = rows.select(F.from_json("value", schema).alias("m")).select(F.lit(topic).alias("topic"), "m.*")
    again, dead = back[requests.RETRY_TOPIC], back[requests.DEAD_LETTER_TOPIC]
    return again.unionByName(dead, allowMissingColumns=True)


def _replay_input(spark, sf_dir):
    valid = requests.validate_requests(inputs.requests(spark, sf_dir), inputs.zones(spark))
    return replay.replay_input(requests.with_cache_key(valid.where(F.col("error_reason").isNull())))


def requests_to_fills(spark, sf_dir):
    """Requests with the computed answer, of any attempt, that was valid at their time."""
    fills = replay.fills_of(requests.route_attempts(inputs.attempts(spark, sf_dir)))
    served = replay.requests_to_fills(_replay_input(spark, sf_dir), fills)
    age = F.col("created_us") - F.col("fill_us")
    return served.select("query_id", "key", "created_us", "fill_us", age.alias("age_us"))


def run_throughput(spark, sf_dir):
    return summary.run_throughput(inputs.attempts(spark, sf_dir), F.col("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        cache_key,
        validate_requests,
        q4_compare,
        answer_requests,
        route_attempts,
        stream_route_attempts,
        attempt_events,
        stream_routed_topics,
        requests_to_fills,
        run_throughput,
    )
}
