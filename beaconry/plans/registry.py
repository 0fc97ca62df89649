"""All registered queries by name."""

from beaconry.plans import request_queries, scenario_queries, stream_queries, summary_queries, window_queries, zone_queries

QUERIES = {
    **window_queries.QUERIES,
    **stream_queries.QUERIES,
    **zone_queries.QUERIES,
    **request_queries.QUERIES,
    **summary_queries.QUERIES,
    **scenario_queries.QUERIES,
}
