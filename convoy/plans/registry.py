"""The registered queries: every operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.numeric import sanitize_nonfinite as sanitize
from convoy.functions.timeslice import epoch_seconds, ntz
from convoy.operators import features as ft
from convoy.operators import fleet, geometry, graph, routes, scoring, series, state, stops, training
from convoy.plans import fixtures as fx
from convoy.plans import parameters as p
from convoy.schemas import MARKERS, PREDICTIONS
from convoy.settings import CLASS_LABELS, MILES_PER_EPOCH, RETENTION_HOURS, scratch_path, staged
from convoy.sources.csv import read_csv
from convoy.sources.records import json_records as to_records
from convoy.sources.store import read_retained
from convoy.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _width(fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return fn(*args, width_minutes=p.WIDTH_MINUTES, **kwargs)


def _features(rows: DataFrame, label: str | None = None, min_records: int = p.MIN_RECORDS) -> DataFrame:
    return ft.temporal_features(
        rows, p.WIDTH_MINUTES, min_records, p.ELEVATED, block_slices=p.BLOCK_SLICES, label=label
    )


def _waypoints(spark: SparkSession, sf: str) -> DataFrame:
    return staged(fx.waypoints(spark, sf), "waypoints")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return staged(fx.edges(spark, sf), "edges")


def _readings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Telemetry up to the cut, and all of it."""
    rows = fx.telemetry(spark, sf)
    return rows.filter(F.col("ts") < ntz(p.CUT)), rows


def _newest(rows: DataFrame) -> Column:
    return rows.select(F.max("ts")).scalar()


def _predictions(rows: DataFrame) -> DataFrame:
    return scoring.score_rules(ft.latest_features(_features(rows)))


class _State:
    """State tables built up to the cut and then brought up to date.

    Each step is written out, as state is between refreshes, so the features behind it are
    computed once however often the state is read.
    """

    def __init__(self, spark: SparkSession, sf: str, with_markers: bool = True):
        self.predictions = state.reset_state(spark, PREDICTIONS)
        self.markers = state.reset_state(spark, MARKERS)
        for rows in _readings(spark, sf):
            newest = _newest(rows)
            scored = _predictions(rows)
            self.predictions = staged(state.prediction_upsert(self.predictions, scored, newest), "predictions")
            if with_markers:
                seconds = epoch_seconds(newest) - epoch_seconds(ntz(p.START))
                epoch = F.floor(seconds / p.SERIES_CLOCK.step_seconds)
                kept = _width(state.marker_maintenance, self.markers, self.predictions, newest, epoch)
                self.markers = staged(kept, "markers")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return _State(spark, sf, with_markers=False).predictions


# --- slices, features, profiles ------------------------------------------------------------


@query
def telemetry_slice_agg(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_width(ft.slice_aggregate, fx.telemetry(spark, sf)))


@query
def features_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_features(fx.telemetry(spark, sf)))


@query
def latest_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.latest_features(_features(fx.telemetry(spark, sf))))


@query
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return ft.latest_snapshot(fx.telemetry(spark, sf))


@query
def training_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_features(fx.training(spark, sf), label="max"))


@query
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    # Every event is a baseline row, those of three kinds are override rows as well.
    kind = F.col("event_type")
    override = F.when(kind.isin("purchase", "signup", "error"), kind)
    names = F.explode(F.array_compact(F.array(F.lit("baseline"), override)))
    return fleet.dataset_profile(fx.with_measures(fx.table(spark, sf, "events")).withColumn("table_name", names))


@query
def chart_data(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_width(fleet.chart_data, fx.telemetry(spark, sf), p.CHART_HOURS))


@query
def chart_data_raw(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_width(fleet.chart_data_raw, fx.telemetry(spark, sf), p.CHART_HOURS))


@query
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    return state.retention_filter(fx.telemetry(spark, sf))


# --- scoring and models --------------------------------------------------------------------


@query
def score_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_predictions(fx.telemetry(spark, sf)))


@query
def prediction_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.prediction_distribution(_predictions(fx.telemetry(spark, sf)))


def _order() -> Column:
    return F.pmod(epoch_seconds(F.col("feature_timestamp")) * 7919 + fx.truck_number() * 104729, F.lit(training.SPLIT_MODULUS))


TIE = ["entity_id", "feature_timestamp"]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return staged(_features(fx.training(spark, sf), label="max"), "training")


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    split = training.stratified_split(_labelled(spark, sf), "failure_type", _order(), TIE)
    return split.select("entity_id", "feature_timestamp", "failure_type", "is_train")


def _parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts of a split, read from a staged table: fitting passes over them many times."""
    kept = staged(split, "split")
    return kept.filter("is_train").drop("is_train"), kept.filter("NOT is_train").drop("is_train")


@query
def train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per class on both sides, rows classified, and whether it beats the commonest class."""
    train, test = _parts(training.stratified_split(_labelled(spark, sf), "failure_type", _order(), TIE))
    guessed = staged(training.train_classifier(train).classify(test), "classified")
    sides = (
        train.select("failure_type", F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
        .unionByName(guessed.select("failure_type", F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("predicted_failure_type").isin(CLASS_LABELS).cast("int").alias("c")))
        .groupBy("failure_type")
        .agg(F.sum("a").alias("train_rows"), F.sum("b").alias("test_rows"), F.sum("c").alias("classified"))
    )
    right = guessed.agg(F.avg((F.col("failure_type") == F.col("predicted_failure_type")).cast("double"))).scalar()
    common = guessed.groupBy("failure_type").count().agg(F.max("count") / F.sum("count")).scalar()
    return sides.withColumn("beats_constant", right > common)


def _regression(train: DataFrame, test: DataFrame, model: training.TtfModel) -> DataFrame:
    """Rows on both sides, estimates within the bounds, and whether it beats the mean of the training rows."""
    mean = train.agg(F.avg("time_to_failure")).scalar()
    error = F.abs(F.col("time_to_failure") - F.col("predicted_ttf"))
    bounds = F.col("predicted_ttf").between(scoring.TTF_LOW, scoring.TTF_HIGH)
    judged = staged(model.estimate(test), "estimated").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.sum(bounds.cast("long")).alias("in_bounds"),
        (F.avg(error) < F.avg(F.abs(F.col("time_to_failure") - mean))).alias("beats_constant"),
    )
    return judged.select(train.select(F.count(F.lit(1))).scalar().alias("train_rows"), "*")


@query
def train_ttf_basic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).filter(F.col("failure_type").isin(scoring.BASIC_CLASSES))
    train, test = _parts(training.plain_split(rows, _order(), TIE))
    return _regression(train, test, training.train_ttf_basic(train))


@query
def train_ttf_temporal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).filter(F.col("failure_type") == "ELECTRICAL_FAILURE")
    train, test = _parts(training.plain_split(rows, _order(), TIE))
    return _regression(train, test, training.train_ttf_temporal(train))


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled slices with the rule scorer's class and hours as the prediction."""
    labelled = _features(fx.training(spark, sf), label="max").withColumnRenamed("feature_timestamp", "prediction_timestamp")
    return scoring.score_rules(labelled, keep=["failure_type", "time_to_failure"])


@query
def score_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The newest features through models trained on labels: who was scored, by the right model, within bounds."""
    labelled = _labelled(spark, sf)
    models = training.train_classifier(labelled), training.train_ttf_basic(labelled), training.train_ttf_temporal(labelled)
    scored = scoring.score_hybrid(ft.latest_features(_features(fx.telemetry(spark, sf))), *models)
    kind, hours, used = F.col("predicted_failure_type"), F.col("predicted_hours_to_failure"), F.col("ttf_model_used")
    wanted = F.when(kind == "ELECTRICAL_FAILURE", scoring.TEMPORAL_MODEL).when(kind == "NORMAL", scoring.NO_MODEL).otherwise(scoring.BASIC_MODEL)
    return scored.select(
        "entity_id",
        "prediction_timestamp",
        *[F.round(c, 6).alias(c) for c in ("current_engine_temp", "current_trans_pressure", "current_battery_voltage")],
        kind.isin(CLASS_LABELS).alias("classified"),
        (used == wanted).alias("routed"),
        F.when(kind == "NORMAL", hours.isNull()).otherwise(hours.between(scoring.TTF_LOW, scoring.TTF_HIGH)).alias("in_bounds"),
    )


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.classification_report(_ruled(spark, sf), "failure_type", "predicted_failure_type"))


@query
def regression_mae(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(training.regression_mae(_ruled(spark, sf), "time_to_failure", "predicted_hours_to_failure"))


# --- state ---------------------------------------------------------------------------------


@query
def prediction_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_stored(spark, sf))


@query
def marker_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    return _State(spark, sf).markers


@query
def breakdown_projection(spark: SparkSession, sf: str) -> DataFrame:
    kept = _State(spark, sf)
    return state.breakdown_projection(kept.markers, kept.predictions, p.MAP_EPOCH, p.PROJECTION_HOURS)


@query
def config_upsert(spark: SparkSession, sf: str) -> DataFrame:
    n = fx.truck_number()
    activations = fx.entities(spark, sf).filter(n.isin(4, 5, 7)).select(
        "entity_id", F.when(n == 5, "engine").otherwise("transmission").alias("failure_type")
    )
    return state.config_upsert(fx.failure_config(spark, sf), activations, p.SERIES_EPOCH)


@query
def cursor_advance(spark: SparkSession, sf: str) -> DataFrame:
    config = fx.failure_config(spark, sf)
    step = state.cursor_advance_step(config, fx.override_seed(spark, sf), p.SERIES_EPOCH + 1)
    backfill = state.cursor_advance_backfill(config, p.SERIES_EPOCH, p.BACKFILL_EPOCHS)
    return (
        step.withColumn("mode", F.lit("STEP"))
        .unionByName(backfill.withColumn("mode", F.lit("BACKFILL")))
        .select("mode", "entity_id", "failure_next_epoch")
    )


# --- fleet ---------------------------------------------------------------------------------


@query
def fleet_status(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.fleet_status(fx.entities(spark, sf), fx.telemetry(spark, sf), _State(spark, sf).markers, p.STATUS_CLOCK)


@query
def prediction_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fleet.prediction_freshness(_stored(spark, sf), fx.telemetry(spark, sf), p.STATUS_CLOCK))


@query
def fleet_counters(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.fleet_counters(fx.telemetry(spark, sf), _stored(spark, sf))


@query
def marker_listing(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.marker_listing(_State(spark, sf).markers)


@query
def active_failures(spark: SparkSession, sf: str) -> DataFrame:
    return series.active_failures(fx.failure_config(spark, sf), fx.override_seed(spark, sf))


# --- series --------------------------------------------------------------------------------


@query
def series_step(spark: SparkSession, sf: str) -> DataFrame:
    return series.series_step(
        fx.baseline_seed(spark, sf),
        fx.override_seed(spark, sf),
        fx.failure_config(spark, sf),
        fx.breakdown_markers(spark, sf),
        p.SERIES_CLOCK,
        p.SERIES_EPOCH + 1,
    )


@query
def series_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return series.series_backfill(
        fx.baseline_seed(spark, sf),
        fx.override_seed(spark, sf),
        fx.failure_config(spark, sf),
        p.SERIES_CLOCK,
        p.BACKFILL_EPOCHS,
    )


@query
def series_backfill_strict(spark: SparkSession, sf: str) -> DataFrame:
    return series.series_backfill_strict(
        fx.baseline_seed(spark, sf),
        fx.override_seed(spark, sf),
        fx.failure_config(spark, sf),
        fx.breakdown_markers(spark, sf),
        p.SERIES_CLOCK,
        p.BACKFILL_EPOCHS,
    )


# --- routes --------------------------------------------------------------------------------


def _trucks(spark: SparkSession, sf: str, kept: _State | None = None, waypoints: DataFrame | None = None) -> DataFrame:
    """Where the map shows each truck."""
    kept = kept or _State(spark, sf)
    return fleet.truck_positions(
        staged(fx.routes(spark, sf), "routes"),
        waypoints or _waypoints(spark, sf),
        kept.markers,
        kept.predictions,
        p.MAP_EPOCH,
    )


def _route_points(spark: SparkSession, sf: str) -> DataFrame:
    key = ["entity_id"]
    hops = routes.path_hops(fx.path_nodes(spark, sf), key)
    return routes.line_points(routes.hop_points(hops, _edges(spark, sf), key), key)


@query
def route_extent(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.route_extent(fx.waypoints(spark, sf))


@query
def truck_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _trucks(spark, sf)


@query
def route_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routes.route_geometry(fx.path_nodes(spark, sf), _edges(spark, sf), fx.routes(spark, sf)))


@query
def route_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return routes.route_lengths(_route_points(spark, sf))


@query
def route_linestring(spark: SparkSession, sf: str) -> DataFrame:
    """One line per route, its coordinates as text in millionths of a degree."""
    lines = routes.route_lines(staged(_route_points(spark, sf), "points"), fx.routes(spark, sf))
    spot = F.transform("geometry.coordinates", lambda c: F.concat_ws(" ", *[F.round(c[i] * 1e6).cast("long").cast("string") for i in (0, 1)]))
    return lines.select("entity_id", "route_name", "distance_miles", "point_count", F.array_join(spot, ",").alias("line"))


@query
def geometry_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = geometry.road_lines(fx.edge_texts(_edges(spark, sf)), fx.nodes(spark, sf))
    points = lines.select("edge_id", "reject", F.posexplode("line").alias("pos", "_c"))
    return rounded(points.select("edge_id", "reject", F.col("pos").cast("long").alias("pos"), F.col("_c")[0].alias("lon"), F.col("_c")[1].alias("lat")))


@query
def geometry_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.rejected_lines(fx.edge_texts(_edges(spark, sf))).select("edge_id", "reject", F.col("geometry").isNotNull().alias("has_text"))


@query
def polyline_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routes.polyline_downsample(_route_points(spark, sf), p.KEEP_EVERY))


@query
def polyline_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routes.polyline_split(_route_points(spark, sf), _trucks(spark, sf)))


@query
def snap_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return routes.snap_nodes(fx.path_nodes(spark, sf), fx.nodes(spark, sf), _waypoints(spark, sf))


@query
def nearest_center(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routes.nearest_center(_trucks(spark, sf), fx.service_centers(spark, sf)))


@query
def service_centers(spark: SparkSession, sf: str) -> DataFrame:
    listed = routes.service_centers(fx.service_centers(spark, sf), fx.nodes(spark, sf))
    coord = F.col("node_coord")
    return rounded(listed.withColumns({"node_lon": coord[0], "node_lat": coord[1]}).drop("node_coord"))


# --- graph and stops -----------------------------------------------------------------------


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shortest_paths(fx.adjacency(_edges(spark, sf)), fx.nodes(spark, sf))


def _detours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.detour_table(_paths(spark, sf), fx.service_centers(spark, sf))


class _Stops:
    """What the stop queries share for one run."""

    def __init__(self, spark: SparkSession, sf: str, with_paths: bool = False, all_drives: bool = False):
        self.kept = _State(spark, sf)
        # These small tables (one row per truck, or per truck and path node) feed several
        # branches each, so they are computed once.
        self.waypoints = _waypoints(spark, sf)
        nodes, path_nodes = fx.nodes(spark, sf), fx.path_nodes(spark, sf)
        self.snapped = staged(routes.snap_nodes(path_nodes, nodes, self.waypoints), "snapped")
        placed = _trucks(spark, sf, self.kept, self.waypoints).select("entity_id", "latitude", "longitude")
        self.trucks = staged(placed, "trucks")
        self.nearest = stops.nearest_path_node(self.trucks, path_nodes, nodes)
        standing = stops.stop_positions(self.trucks, self.waypoints, self.nearest, self.snapped, p.MAP_EPOCH)
        self.positions = staged(standing, "positions")
        if with_paths:
            self.edges = _edges(spark, sf)
            self.centers = fx.service_centers(spark, sf)
            # Drives start at a departure node or at a center; stored lines start anywhere.
            starts = self.departures().select("node_id").unionByName(self.centers.select("node_id"))
            self.paths = graph.shortest_paths(fx.adjacency(self.edges), nodes if all_drives else starts)
            self.detours = graph.detour_table(self.paths, self.centers)

    def departures(self) -> DataFrame:
        return stops.departure_nodes(self.snapped, self.positions, self.nearest)

    def candidates(self) -> DataFrame:
        return stops.reconnect_candidates(self.snapped, self.positions)

    def reconnections(self) -> DataFrame:
        approaches = stops.off_route_approaches(self.departures(), self.detours, self.snapped, self.positions)
        return stops.reconnect_best(approaches, self.candidates(), self.paths)

    def ranking(self) -> DataFrame:
        scored = stops.scored_stops(
            self.departures(), self.detours, self.snapped, self.positions, self.paths, self.kept.predictions
        )
        return stops.service_ranking(scored, self.centers)


@query
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).withColumn("path", graph.path_text())


@query
def detour_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_detours(spark, sf))


@query
def detour_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(graph.detour_candidates(_detours(spark, sf), fx.service_centers(spark, sf)))


def _asked_detours(spark: SparkSession, sf: str, waypoints: DataFrame, paths: DataFrame) -> DataFrame:
    """Detours of every truck to the centers that ask for it."""
    return stops.detour_lookup(
        waypoints,
        fx.routes(spark, sf),
        fx.path_nodes(spark, sf),
        fx.nodes(spark, sf),
        graph.detour_table(paths, fx.service_centers(spark, sf)),
        p.LOOKUP_EPOCH,
        requests=fx.detour_requests(spark, sf),
    )


@query
def detour_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_asked_detours(spark, sf, _waypoints(spark, sf), _paths(spark, sf)))


def _stored_lines(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The line of every drive; drives without one (unit tests) are drawn by the fallbacks."""
    return staged(graph.path_geometry(paths, edges), "geometry")


@query
def detour_geometry(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes, waypoints = _edges(spark, sf), fx.nodes(spark, sf), _waypoints(spark, sf)
    paths = graph.shortest_paths(fx.adjacency(edges), nodes)
    found = staged(_asked_detours(spark, sf, waypoints, paths), "asked")
    miles = fx.routes(spark, sf).select("entity_id", F.lit(p.LOOKUP_EPOCH * MILES_PER_EPOCH).alias("target_miles"))
    spots = fleet.nearest_mile(waypoints, miles).select("entity_id", "latitude", "longitude")
    return rounded(stops.detour_geometry(found, spots, paths, _stored_lines(paths, edges), nodes))


@query
def nearest_path_node(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stops.nearest_path_node(_trucks(spark, sf), fx.path_nodes(spark, sf), fx.nodes(spark, sf)))


@query
def departure_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _Stops(spark, sf).departures()


@query
def reconnect_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_Stops(spark, sf).candidates().withColumn("position", F.col("position").cast("long")))


@query
def reconnect_best(spark: SparkSession, sf: str) -> DataFrame:
    best = _Stops(spark, sf, with_paths=True).reconnections()
    return rounded(best.withColumn("reconnect_path", graph.path_text("reconnect_path")))


@query
def reconnect_geometry(spark: SparkSession, sf: str) -> DataFrame:
    shared = _Stops(spark, sf, with_paths=True, all_drives=True)
    stored = _stored_lines(shared.paths, shared.edges)
    pairs = staged(shared.reconnections().select("center_node", "reconnect_node").distinct(), "pairs")
    return rounded(stops.reconnect_geometry(pairs, shared.paths, stored, fx.nodes(spark, sf)))


@query
def route_segment(spark: SparkSession, sf: str) -> DataFrame:
    shared = _Stops(spark, sf)
    there, here = F.col("road_miles"), F.col("position_miles")
    ends = fx.nodes(spark, sf).select("node_id", F.col("longitude").alias("end_lon"), F.col("latitude").alias("end_lat"))
    segments = (
        shared.snapped.join(fx.service_centers(spark, sf).select("node_id"), "node_id", "left_semi")
        .join(shared.positions, "entity_id")
        .join(ends, "node_id")
        .select(
            "entity_id",
            F.col("node_id").alias("segment_id"),
            here.alias("from_miles"),
            there.alias("to_miles"),
            F.when(F.col("is_return_trip"), there < here).otherwise(~(there > here)).alias("backwards"),
            F.col("longitude").alias("truck_lon"),
            F.col("latitude").alias("truck_lat"),
            "end_lon",
            "end_lat",
        )
    )
    return rounded(routes.route_segments(shared.waypoints, segments))


@query
def service_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = _Stops(spark, sf, with_paths=True).ranking()
    return rounded(ranked.withColumn("rank", F.col("rank").cast("long")))


@query
def option_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """The drives of the ranked options off the route."""
    shared = _Stops(spark, sf, with_paths=True, all_drives=True)
    options = staged(shared.ranking().filter("NOT on_route").select("entity_id", "rank", F.col("departure_node").alias("from_node_id"), F.col("node_id").alias("to_node_id")), "options")
    drawn = stops.drive_geometry(options, shared.paths, _stored_lines(shared.paths, shared.edges), fx.nodes(spark, sf))
    found = options.join(drawn, ["from_node_id", "to_node_id"])
    return rounded(found.select("entity_id", F.col("rank").cast("long").alias("rank"), "from_node_id", "to_node_id", "kind", "pos", "lon", "lat"))


@query
def service_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stops.service_recommendation(_Stops(spark, sf, with_paths=True).ranking()))


# --- streams -------------------------------------------------------------------------------


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a file stream; a single file can only be named through a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _two_runs(spark: SparkSession, sf: str, name: str, run: Callable[[DataFrame, str], None], late: bool = False) -> str:
    """Run a stream twice over a growing folder: events up to the cut, then the rest.

    With ``late`` a third of the events of the day before the cut come with the rest.
    """
    work = scratch_path(spark, name)
    events = fx.table(spark, sf, "events")
    early = F.col("ts") < ntz(p.CUT)
    if late:
        early = early & ~((F.col("ts") >= ntz(p.CUT - timedelta(days=1))) & (F.pmod("event_id", F.lit(3)) == 0))
    for part in (early, ~early):
        events.filter(part).write.mode("append").parquet(f"{work}/events")
        run(fx.with_measures(_stream(spark, f"{work}/events")), work)
    return work


def _prediction_stream(spark: SparkSession, work: str, **parts: bool) -> jobs.PredictionStream:
    rule = jobs.FeatureRule(p.WIDTH_MINUTES, p.MIN_RECORDS, p.ELEVATED, p.BLOCK_SLICES)
    delay = p.OPEN_SLICES * p.WIDTH_MINUTES
    return jobs.PredictionStream(spark, f"{work}/state", p.SERIES_CLOCK, scoring.score_rules, rule, **parts, delay_minutes=delay)


@query
def stream_slice_agg(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_path(spark, "slices")
    readings = fx.with_measures(_stream(spark, f"{sf}/[e]vents.parquet"))
    jobs.run_slice_aggregate(
        readings, f"{work}/slices", f"{work}/checkpoint", p.WIDTH_MINUTES, f"{p.STREAM_DELAY_HOURS} hours"
    )
    return rounded(spark.read.parquet(f"{work}/slices"))


@query
def retention_stream(spark: SparkSession, sf: str) -> DataFrame:
    """What the append stream keeps of two runs, the second with late rows."""

    def run(readings: DataFrame, work: str) -> None:
        jobs.run_retained(readings, f"{work}/kept", f"{work}/checkpoint", RETENTION_HOURS)

    work = _two_runs(spark, sf, "retained", run, late=True)
    return read_retained(spark, f"{work}/kept", RETENTION_HOURS).drop("event_id", "event_type")


@query
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    def run(readings: DataFrame, work: str) -> None:
        jobs.run_latest(readings, jobs.latest_store(spark, f"{work}/latest"), f"{work}/checkpoint")

    work = _two_runs(spark, sf, "latest", run)
    return jobs.latest_store(spark, f"{work}/latest").read("latest")


@query
def stream_features(spark: SparkSession, sf: str) -> DataFrame:
    def run(readings: DataFrame, work: str) -> None:
        _prediction_stream(spark, work, with_predictions=False).run(readings)

    work = _two_runs(spark, sf, "features", run, late=True)
    return rounded(_prediction_stream(spark, work).features())


@query
def stream_prediction_upsert(spark: SparkSession, sf: str) -> DataFrame:
    work = _two_runs(
        spark, sf, "predictions", lambda rows, work: _prediction_stream(spark, work, with_markers=False).run(rows)
    )
    return rounded(_prediction_stream(spark, work).predictions.read())


@query
def stream_markers(spark: SparkSession, sf: str) -> DataFrame:
    work = _two_runs(spark, sf, "markers", lambda rows, work: _prediction_stream(spark, work).run(rows))
    return _prediction_stream(spark, work).markers.read()


# --- text edges ----------------------------------------------------------------------------


@query
def csv_load_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as text with every null marker, then loaded with types."""
    rows = fx.with_measures(fx.table(spark, sf, "events"))
    turn = F.pmod("event_id", F.lit(7))
    measure = (
        F.when(turn == 0, "").when(turn == 1, r"\N").when(turn == 2, r"\\N").when(turn == 3, r'"\N"')
        .otherwise(F.col("engine_temp").cast("string"))
    )
    text = rows.select(
        F.col("entity_id").alias("ENTITY_ID"),
        measure.alias("Engine_Temp"),
        F.col("ts").cast("string").alias("TS"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, r"\N").otherwise(F.col("event_type")).alias("NOTE"),
        (F.pmod("event_id", F.lit(2)) == 0).cast("string").alias("ENABLED"),
    )
    target = scratch_path(spark, "csv")
    text.write.options(header=True, quoteAll=True, escape='"', compression="gzip").csv(target)
    schema = "entity_id STRING, ts TIMESTAMP_NTZ, engine_temp DOUBLE, enabled BOOLEAN, note STRING"
    return read_csv(spark, target, schema, partitions=spark.sparkContext.defaultParallelism)


@query
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.telemetry(spark, sf)
    gap = F.when(F.col("trans_oil_pressure") == 0, float("nan")).otherwise(F.col("engine_temp"))
    return to_records(rows.select("entity_id", "ts", gap.alias("engine_temp"), "trans_oil_pressure"))


@query
def sanitize_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.telemetry(spark, sf)
    level = F.col("trans_oil_pressure")
    broken = (
        F.when(level == 0, float("nan")).when(level == 1, float("inf")).when(level == 2, float("-inf"))
        .otherwise(F.col("engine_temp"))
    )
    return sanitize(rows.select("entity_id", "ts", broken.alias("engine_temp"), "trans_oil_pressure"))
