from beaconry.functions.scalar import (  # noqa: F401
    box_area_km2,
    cache_key,
    can_be_keyed,
    epoch_seconds_to_timestamp,
    in_box,
    iso_utc,
    passes_confidence,
    query_type_name,
    ratio,
    safe_label,
    ttl_seconds,
)
