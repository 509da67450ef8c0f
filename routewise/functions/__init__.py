"""Native scalar column functions."""

from routewise.functions.columns import (
    DELAY_BANDS,
    DISTANCE_BANDS,
    days_between,
    delay_band,
    delay_band_order,
    distance_band,
    dummy_name,
    flag,
    haversine_km,
    right_closed_band,
    safe_ratio,
    weekday_monday0,
)

__all__ = ["DELAY_BANDS", "DISTANCE_BANDS", "days_between", "delay_band", "delay_band_order",
           "distance_band", "dummy_name", "flag", "haversine_km", "right_closed_band",
           "safe_ratio", "weekday_monday0"]
