"""The stored queries as temporary views, for work in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from convoy.operators.features import latest_features, slice_aggregate, temporal_features
from convoy.operators.routes import as_linestring, hop_points, line_points, path_hops


def telemetry_views(telemetry: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register slice averages, features and (given a scorer) the newest predictions.

    Views are lazy: each query on one runs over the telemetry as it then is. ``score`` maps
    the newest features to predictions, such as ``score_rules`` or a bound ``score_hybrid``.
    """
    slice_aggregate(telemetry).createOrReplaceTempView("telemetry_5min_agg")
    features = temporal_features(telemetry)
    features.createOrReplaceTempView("feature_engineering_view_temporal")
    if score is not None:
        score(latest_features(features)).createOrReplaceTempView("enhanced_predictive_view_hybrid_ttf")


def route_views(path_nodes: DataFrame, edges: DataFrame, routes: DataFrame) -> None:
    """Register the routes with their geometry, one row per route."""
    keys = ["entity_id"]
    lines = as_linestring(line_points(hop_points(path_hops(path_nodes, keys), edges, keys), keys), keys)
    named = lines.join(routes.select("entity_id", "route_name", "start_city", "end_city"), "entity_id")
    named.createOrReplaceTempView("route_geometry_detailed")
