"""The registered queries again, as plain SQL over the same tables (DuckDB).

Each view below is one common table expression; ``_sql`` prepends the ones a query
needs. They state the semantics directly (joins and windows without regard to
scale), so they check the operators' rewrites.
"""

from __future__ import annotations

from ..operators.evaluate import poisson_one_limits
from .queries import SEED, THRESHOLDS

# name -> (views it needs, SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trips_once": ((), """
        SELECT event_id, ts, user_id, value, props,
               lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
        FROM events"""),
    "raw_trips": (("trips_once",), """
        SELECT ts AS tpep_pickup_datetime, next_ts AS tpep_dropoff_datetime,
               CAST(nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, 0) AS DOUBLE)
                   AS passenger_count,
               value AS trip_distance,
               user_id % 263 + 1 AS pu, event_id % 265 + 1 AS dol,
               unnest(range(CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) AS copy_no
        FROM trips_once"""),
    "base": (("raw_trips",), """
        SELECT tpep_pickup_datetime::TIMESTAMP AS pickup_ts,
               tpep_dropoff_datetime::TIMESTAMP AS dropoff_ts,
               pu::BIGINT AS pu_location_id, dol::BIGINT AS do_location_id,
               trip_distance::DOUBLE AS trip_distance, passenger_count::BIGINT AS passenger_count,
               (epoch(date_trunc('second', tpep_dropoff_datetime))
                - epoch(date_trunc('second', tpep_pickup_datetime))) / 60.0::DOUBLE AS duration_min
        FROM raw_trips"""),
    "trips": (("base",), """
        SELECT pickup_ts, dropoff_ts, pu_location_id, do_location_id, trip_distance,
               passenger_count, duration_min
        FROM base
        WHERE NOT (pu_location_id < 1 OR pu_location_id > 263)
          AND NOT (do_location_id < 1 OR do_location_id > 263)
          AND trip_distance > 0 AND NOT trip_distance > 100
          AND duration_min > 0 AND NOT duration_min > 180
          AND strftime(pickup_ts, '%Y-%m') = '2024-01'
        GROUP BY ALL"""),
    "hourly": (("trips",), """
        SELECT pu_location_id AS zone_id, date_trunc('hour', pickup_ts) AS ts,
               count(*) AS pickups
        FROM trips GROUP BY 1, 2"""),
    "hours": (("hourly",), """
        SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
        FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM hourly)"""),
    "zones": ((), "SELECT range AS zone_id FROM range(1, 264)"),
    "panel": (("zones", "hours", "hourly"), """
        SELECT z.zone_id, h.ts, coalesce(c.pickups, 0) AS pickups
        FROM zones z CROSS JOIN hours h
        LEFT JOIN hourly c ON c.zone_id = z.zone_id AND c.ts = h.ts"""),
    "profile": (("zones", "panel"), """
        SELECT z.zone_id, w.range AS how, coalesce(r.rate, 0.0::DOUBLE) AS rate_per_hour
        FROM zones z CROSS JOIN range(168) w
        LEFT JOIN (
            SELECT zone_id, (isodow(ts) - 1) * 24 + hour(ts) AS how, avg(pickups) AS rate
            FROM panel GROUP BY 1, 2
        ) r ON r.zone_id = z.zone_id AND r.how = w.range"""),
    "weekly": (("profile",), """
        SELECT zone_id, sum(rate_per_hour) AS weekly_pickups FROM profile GROUP BY zone_id"""),
    "weights": (("weekly",), """
        SELECT zone_id,
               CASE WHEN sum(weekly_pickups) OVER () > 0
                    THEN weekly_pickups / sum(weekly_pickups) OVER ()
                    ELSE 1.0::DOUBLE / count(*) OVER () END AS weight
        FROM weekly"""),
    "ladder": (("weights",), """
        SELECT zone_id, sum(weight) OVER (ORDER BY zone_id) AS upto FROM weights"""),
    "ride_times": (("trips_once",), """
        SELECT event_id AS rider_id, user_id AS driver_id, user_id % 263 + 1 AS origin,
               event_id % 263 + 1 AS dest, ts AS pickup, next_ts AS done,
               (event_id % 97)::DOUBLE / 10 AS wait,
               ts - to_microseconds(CAST(round(
                   ((event_id % 97)::DOUBLE / 10 + event_id % 5) * 60000000) AS BIGINT)) AS request,
               ts - to_microseconds((event_id % 5) * 60000000) AS match_at,
               CASE WHEN next_ts IS NULL THEN 'open'
                    WHEN date_diff('second', ts, next_ts) > 180 * 60 THEN 'cancel'
                    WHEN event_id % 101 = 0 THEN 'both'
                    WHEN event_id % 103 = 0 THEN 'swap'
                    ELSE 'plain' END AS way
        FROM trips_once"""),
    "log": (("ride_times",), """
        SELECT rider_id * 8 AS seq, 'RiderRequested' AS kind, request AS ts, rider_id,
               NULL::BIGINT AS driver_id, origin AS zone_id, NULL::BIGINT AS to_zone_id,
               NULL::DOUBLE AS wait_min
        FROM ride_times
        UNION ALL
        SELECT rider_id * 8 + 1, 'RiderMatched', match_at, rider_id, driver_id, NULL, NULL, wait
        FROM ride_times WHERE way <> 'cancel'
        UNION ALL
        SELECT rider_id * 8 + 2, 'RiderCancelled',
               CASE WHEN way = 'cancel' THEN request + INTERVAL 8 MINUTE ELSE match_at END,
               rider_id, NULL, origin, NULL, CASE WHEN way = 'cancel' THEN 8.0 ELSE wait END
        FROM ride_times WHERE way IN ('cancel', 'both')
        UNION ALL
        SELECT rider_id * 8 + 3, 'PickupCompleted',
               CASE WHEN way = 'swap' THEN done + INTERVAL 1 MINUTE ELSE pickup END,
               rider_id, driver_id, NULL, NULL, NULL
        FROM ride_times WHERE way <> 'cancel'
        UNION ALL
        SELECT rider_id * 8 + 4, 'TripCompleted', done, rider_id, driver_id, dest, NULL, NULL
        FROM ride_times WHERE way IN ('both', 'swap', 'plain')"""),
    "centroids": ((), """
        SELECT event_id % 263 + 1 AS zone_id,
               avg(40.5::DOUBLE + ((event_id % 263 + 1) * 7919) % 1000 / 2500.0::DOUBLE
                   + (event_id % 13) / 10000.0::DOUBLE) AS lat,
               avg(-74.2::DOUBLE + ((event_id % 263 + 1) * 104729) % 1000 / 2000.0::DOUBLE
                   + (event_id % 11) / 10000.0::DOUBLE) AS lon
        FROM events GROUP BY 1"""),
    "distances": (("centroids",), """
        SELECT a.zone_id AS zone_a, b.zone_id AS zone_b,
               2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
                   power(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
                   + cos(radians(a.lat)) * cos(radians(b.lat))
                     * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))) AS km
        FROM centroids a CROSS JOIN centroids b"""),
    "riders": ((), """
        SELECT date_trunc('hour', ts) AS tick, event_id AS rider_id,
               user_id % 263 + 1 AS zone, ts AS request_ts
        FROM events WHERE event_type IN ('view', 'click')"""),
    "drivers": ((), """
        SELECT date_trunc('hour', ts) AS tick, event_id AS driver_id,
               event_id * 7 % 263 + 1 AS zone
        FROM events WHERE event_type NOT IN ('view', 'click')"""),
    "reachable": (("riders", "drivers", "distances"), """
        SELECT r.tick, r.rider_id, d.driver_id, x.km,
               row_number() OVER (PARTITION BY r.tick, r.rider_id
                                  ORDER BY x.km, d.driver_id DESC) AS place
        FROM riders r
        JOIN drivers d ON d.tick = r.tick
        JOIN distances x ON x.zone_a = d.zone AND x.zone_b = r.zone AND x.km <= 3.0"""),
    "naive": (("panel",), """
        SELECT zone_id, ts, pickups,
               CAST(lag(pickups, 168) OVER (PARTITION BY zone_id ORDER BY ts) AS DOUBLE)
                   AS forecast
        FROM panel"""),
    "outcome": (("log",), """
        SELECT rider_id, CASE arg_max(kind, (ts, seq))
                   WHEN 'RiderRequested' THEN 'waiting' WHEN 'RiderMatched' THEN 'matched'
                   WHEN 'RiderCancelled' THEN 'cancelled' WHEN 'PickupCompleted' THEN 'picked_up'
                   ELSE 'dropped_off' END AS state
        FROM log GROUP BY rider_id"""),
    "risk": (("outcome",), """
        SELECT rider_id, CAST(state = 'cancelled' AS BIGINT) AS cancelled
        FROM outcome WHERE state IN ('cancelled', 'dropped_off')"""),
    "scored": (("risk",), """
        SELECT r.rider_id, r.cancelled, e.value / (e.value + 50.0::DOUBLE) AS score
        FROM risk r JOIN events e ON e.event_id = r.rider_id"""),
    "lifecycle": (("log",), """
        SELECT rider_id,
               arg_min(kind, (ts, seq)) = 'RiderRequested' AS starts_with_request,
               coalesce(min((ts, seq)) FILTER (kind = 'RiderMatched')
                        < min((ts, seq)) FILTER (kind = 'PickupCompleted'), true)
                   AS match_before_pickup,
               coalesce(min((ts, seq)) FILTER (kind = 'PickupCompleted')
                        < min((ts, seq)) FILTER (kind = 'TripCompleted'), true)
                   AS pickup_before_completion
        FROM log GROUP BY rider_id"""),
    "depths": (("log",), """
        SELECT driver_id, ts, seq, kind,
               sum(CASE kind WHEN 'RiderMatched' THEN 1 ELSE -1 END)
                   OVER (PARTITION BY driver_id ORDER BY ts, seq) AS depth
        FROM log WHERE kind IN ('RiderMatched', 'TripCompleted')"""),
    "spans": (("log",), """
        SELECT m.rider_id, date_diff('microsecond', m.ts, c.ts) AS us,
               date_diff('microsecond', m.ts, c.ts) / 60000000.0::DOUBLE AS minutes
        FROM log m JOIN log c ON c.rider_id = m.rider_id
        WHERE m.kind = 'RiderMatched' AND c.kind = 'TripCompleted'"""),
    "metrics": (("log", "spans"), """
        SELECT requests, rides_completed, cancellations,
               round(cancellations::DOUBLE / requests, 6) AS cancel_rate,
               round(mean_wait, 6) AS mean_wait_min, round(p50, 6) AS median_wait_min,
               round(p90, 6) AS p90_wait_min,
               round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
                   1 - (SELECT sum(minutes) FROM spans)
                       / ((SELECT count(DISTINCT user_id) FROM events) * 43200.0::DOUBLE))), 6)
                   AS driver_idle_pct
        FROM (
            SELECT count(*) FILTER (kind = 'RiderRequested') AS requests,
                   count(*) FILTER (kind = 'TripCompleted') AS rides_completed,
                   count(*) FILTER (kind = 'RiderCancelled') AS cancellations,
                   avg(wait_min) FILTER (kind = 'RiderMatched') AS mean_wait,
                   quantile_cont(wait_min, 0.5) FILTER (kind = 'RiderMatched') AS p50,
                   quantile_cont(wait_min, 0.9) FILTER (kind = 'RiderMatched') AS p90
            FROM log)"""),
    "cancels": (("log",), """
        SELECT r.rider_id, r.zone_id, r.ts AS request_ts, r.ts + INTERVAL 8 MINUTE AS cancel_ts,
               8.0::DOUBLE AS wait_min
        FROM log r
        LEFT JOIN log m ON m.rider_id = r.rider_id AND m.kind = 'RiderMatched'
                       AND m.ts < r.ts + INTERVAL 8 MINUTE
        WHERE r.kind = 'RiderRequested' AND m.rider_id IS NULL"""),
    "moves": (("log",), """
        SELECT 'rider' AS entity, rider_id AS entity_id, seq, ts, kind,
               CASE kind WHEN 'RiderRequested' THEN 'waiting' WHEN 'RiderMatched' THEN 'matched'
                         WHEN 'RiderCancelled' THEN 'cancelled'
                         WHEN 'PickupCompleted' THEN 'picked_up' ELSE 'dropped_off' END AS to_state
        FROM log
        UNION ALL
        SELECT 'driver', driver_id, seq, ts, kind,
               CASE kind WHEN 'RiderMatched' THEN 'to_pickup'
                         WHEN 'PickupCompleted' THEN 'on_trip' ELSE 'idle' END
        FROM log WHERE driver_id IS NOT NULL"""),
    "illegal": (("moves",), """
        SELECT * FROM (
            SELECT entity, entity_id, seq, ts, kind,
                   coalesce(lag(to_state) OVER (PARTITION BY entity, entity_id ORDER BY ts, seq),
                            CASE entity WHEN 'driver' THEN 'idle' END) AS from_state, to_state
            FROM moves)
        WHERE CASE entity
            WHEN 'rider' THEN
                CASE WHEN from_state IS NULL THEN to_state <> 'waiting'
                ELSE (from_state, to_state) NOT IN (('waiting', 'matched'),
                    ('waiting', 'cancelled'), ('matched', 'picked_up'), ('matched', 'cancelled'),
                    ('picked_up', 'dropped_off')) END
            ELSE (from_state, to_state) NOT IN (('idle', 'to_pickup'), ('idle', 'repositioning'),
                ('to_pickup', 'on_trip'), ('to_pickup', 'idle'), ('on_trip', 'idle'),
                ('repositioning', 'idle'), ('repositioning', 'to_pickup')) END"""),
    "units": ((), """
        SELECT * FROM (
            SELECT user_id, user_id % 2 AS arm,
                   avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS pre,
                   avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS post
            FROM events GROUP BY user_id)
        WHERE pre IS NOT NULL AND post IS NOT NULL"""),
}


def _sql(select: str, *views: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in _VIEWS[name][0]:
            visit(needed)
        order.append(name)

    for view in views:
        visit(view)
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name][1]})" for name in order)
    return f"WITH {ctes}\n{select}" if ctes else select


def _u(*key: str) -> str:
    """The draw in [0, 1) of a key, as the generators define it."""
    text = f"concat_ws('|', '{SEED}', {', '.join(key)})"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496)"


def _replicas(key: str) -> str:
    """Replicate draws per event, 100 of them."""
    digest = f"md5(concat_ws('|', '{SEED}', {key}))"
    return f"""
        SELECT *, (w1 + w2 * replica) % 2147483647 AS draw FROM (
            SELECT *, CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % 2147483647 AS w1,
                   CAST('0x' || substr({digest}, 9, 8) AS BIGINT) % 2147483646 + 1 AS w2
            FROM events) e CROSS JOIN (SELECT range AS replica FROM range(1, 101)) r"""


_TRIP_COLUMNS = (
    "pickup_ts, dropoff_ts, pu_location_id, do_location_id, trip_distance, passenger_count, "
    "round(duration_min, 6) AS duration_min"
)
_HISTORY = """
    CAST(lag(pickups, 1) OVER w AS DOUBLE) AS lag_1h,
    CAST(lag(pickups, 24) OVER w AS DOUBLE) AS lag_24h,
    CAST(lag(pickups, 168) OVER w AS DOUBLE) AS lag_168h"""
_ROLLS = """
    round(avg(pickups) OVER (PARTITION BY zone_id ORDER BY ts
        ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS roll_mean_24h,
    round(avg(pickups) OVER (PARTITION BY zone_id ORDER BY ts
        ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 6) AS roll_mean_168h"""
_WINDOW = "WINDOW w AS (PARTITION BY zone_id ORDER BY ts)"


def _holiday(ts: str) -> str:
    """Federal holidays, listed by rule for the day and its observed neighbours."""
    d = f"CAST({ts} AS DATE)"

    def fixed(day: str) -> str:
        return (
            f"(strftime({day}, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25') "
            f"OR (strftime({day}, '%m-%d') = '06-19' AND year({day}) >= 2021))"
        )

    def nth(month: int, dow: int, lo: int, hi: int) -> str:
        return f"(month({d}) = {month} AND isodow({d}) = {dow} AND day({d}) BETWEEN {lo} AND {hi})"

    rules = [
        fixed(d),
        f"(isodow({d}) = 1 AND {fixed(f'({d} - 1)')})",
        f"(isodow({d}) = 5 AND {fixed(f'({d} + 1)')})",
        nth(1, 1, 15, 21),
        nth(2, 1, 15, 21),
        nth(5, 1, 25, 31),
        nth(9, 1, 1, 7),
        nth(10, 1, 8, 14),
        nth(11, 4, 22, 28),
    ]
    return "(" + " OR ".join(rules) + ")"


_CALENDAR = (
    "hour(ts) AS hour, isodow(ts) - 1 AS dow, " + _holiday("ts") + " AS is_holiday"
)
_SPLIT_FROM = """(
    SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {ts}) - 1 AS pos FROM {table})"""


def _cutoff(ts: str, table: str) -> str:
    return f"""(SELECT min({ts}) FILTER (pos = least(greatest(
        CAST(floor(n * 0.8::DOUBLE) AS BIGINT), 1), n - 1)) FROM {_SPLIT_FROM.format(ts=ts, table=table)})"""


_ETA = f"""
    SELECT pickup_ts, pu_location_id, do_location_id, hour(pickup_ts) AS hour,
           isodow(pickup_ts) - 1 AS dow, trip_distance, passenger_count,
           round(date_diff('second', pickup_ts, dropoff_ts) / 60.0::DOUBLE, 6) AS duration_min,
           CASE WHEN pickup_ts < {_cutoff('pickup_ts', 'trips')} THEN 'train' ELSE 'holdout' END
               AS split
    FROM trips"""


def _rule(rule: str, column: str, failed: str, table: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", "
        f"count(*) FILTER ({failed}) AS failures FROM {table}"
    )


_DIRTY = """
    SELECT DISTINCT pickup_ts, dropoff_ts, pu_location_id, do_location_id,
           CASE WHEN passenger_count = 6 THEN 'NaN'::DOUBLE ELSE trip_distance END
               AS trip_distance, passenger_count, duration_min
    FROM base"""
_TEXT = """
    SELECT CAST(event_id AS VARCHAR) AS event_id,
           CASE WHEN event_id % 9 = 0 THEN 'zone ' || event_id
                ELSE CAST(event_id % 265 AS VARCHAR) END AS zone,
           CASE WHEN event_id % 11 = 0 THEN 'n/a'
                ELSE CAST(event_id % 100 - 1 AS VARCHAR) END AS amount
    FROM events"""


def _text_rule(rule: str, column: str, failed: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", "
        f"count(*) FILTER ({failed}) AS failures, max({column}) FILTER ({failed}) AS sample "
        "FROM text_trips"
    )


def _check_coerce() -> str:
    rows = [
        _text_rule("coerce", "event_id", "try_cast(event_id AS BIGINT) IS NULL"),
        _text_rule("not_null", "event_id", "event_id IS NULL"),
        _text_rule("coerce", "zone", "try_cast(zone AS BIGINT) IS NULL"),
        _text_rule("not_null", "zone", "zone IS NULL"),
        _text_rule("in_range[1,263]", "zone", "try_cast(zone AS BIGINT) NOT BETWEEN 1 AND 263"),
        _text_rule("coerce", "amount", "try_cast(amount AS DOUBLE) IS NULL"),
        _text_rule("not_null", "amount", "amount IS NULL"),
        _text_rule("ge[0]", "amount", "try_cast(amount AS DOUBLE) < 0"),
    ]
    return f"WITH text_trips AS ({_TEXT})\n" + "\nUNION ALL\n".join(rows)


def _null_failures(column: str) -> str:
    return f"{column} IS NULL" + (
        f" OR isnan({column})" if column in ("trip_distance", "duration_min") else ""
    )


def _check_nulls() -> str:
    columns = (
        "pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id", "trip_distance",
        "duration_min",
    )
    rows = [_rule("not_null", c, _null_failures(c), f"({_DIRTY})") for c in columns]
    return _sql("\nUNION ALL\n".join(rows), "base")


_RANGES = (
    ("in_range[1,263]", "pu_location_id", "pu_location_id NOT BETWEEN 1 AND 263"),
    ("in_range[1,263]", "do_location_id", "do_location_id NOT BETWEEN 1 AND 263"),
    ("in_range(0.0,100.0]", "trip_distance",
     "NOT isnan(trip_distance) AND NOT (trip_distance > 0 AND trip_distance <= 100)"),
    ("ge[0]", "passenger_count", "passenger_count < 0"),
    ("in_range(0.0,180.0]", "duration_min", "NOT (duration_min > 0 AND duration_min <= 180)"),
)


def _check_ranges() -> str:
    rows = [_rule(rule, c, failed, f"({_DIRTY})") for rule, c, failed in _RANGES]
    return _sql("\nUNION ALL\n".join(rows), "base")


def _check_report() -> str:
    rows = [
        "SELECT 'missing_column' AS rule, 'duration_min' AS \"column\", 1 AS failures",
        "SELECT 'extra_column', 'minutes', 1",
    ]
    for c in (
        "pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id", "trip_distance",
        "passenger_count",
    ):
        rows.append(_rule("coerce", c, "false", "trips"))
        if c != "passenger_count":
            rows.append(_rule("not_null", c, _null_failures(c), "trips"))
    rows += [_rule(rule, c, failed, "trips") for rule, c, failed in _RANGES if c != "duration_min"]
    body = "\nUNION ALL\n".join(rows)
    return _sql(
        f'SELECT rule, "column", CAST(failures AS BIGINT) AS failures, '
        f"CAST(NULL AS VARCHAR) AS sample FROM ({body})",
        "trips",
    )


def _threshold_sweep() -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
    return _sql(
        f"""
        SELECT threshold, tp, fp, fn, tn,
               round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
               round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
               round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
               5.0::DOUBLE * fn + fp AS cost
        FROM (
            SELECT threshold,
                   count(*) FILTER (score >= threshold AND cancelled = 1) AS tp,
                   count(*) FILTER (score >= threshold AND cancelled = 0) AS fp,
                   count(*) FILTER (score < threshold AND cancelled = 1) AS fn,
                   count(*) FILTER (score < threshold AND cancelled = 0) AS tn
            FROM scored CROSS JOIN (VALUES {values}) t(threshold) GROUP BY threshold)""",
        "scored",
    )


def _ab(table: str, metric: str) -> str:
    return f"""
        SELECT n_control, n_treatment, round(mean_control, 6) AS mean_control,
               round(mean_treatment, 6) AS mean_treatment,
               round(diff, 6) AS diff, round(se, 6) AS se,
               round(diff - 1.96 * se, 6) AS ci_low, round(diff + 1.96 * se, 6) AS ci_high,
               round(diff / se, 6) AS t
        FROM (
            SELECT *, mean_treatment - mean_control AS diff,
                   sqrt(v0 / n_control + v1 / n_treatment) AS se
            FROM (
                SELECT count({metric}) FILTER (arm = 0) AS n_control,
                       count({metric}) FILTER (arm = 1) AS n_treatment,
                       avg({metric}) FILTER (arm = 0) AS mean_control,
                       avg({metric}) FILTER (arm = 1) AS mean_treatment,
                       var_samp({metric}) FILTER (arm = 0) AS v0,
                       var_samp({metric}) FILTER (arm = 1) AS v1
                FROM {table}))"""


def _peeking() -> str:
    return f"""
        WITH span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
        draws AS ({_replicas('event_id')}),
        sums AS (
            SELECT replica, least(CAST(floor((epoch_us(ts) - lo) * 10 / (hi - lo)::DOUBLE) AS BIGINT)
                       + 1, 10) AS look,
                   count(value) FILTER (draw % 2 = 0) AS n0, count(value) FILTER (draw % 2 = 1) AS n1,
                   coalesce(sum(value) FILTER (draw % 2 = 0), 0) AS s0,
                   coalesce(sum(value) FILTER (draw % 2 = 1), 0) AS s1,
                   coalesce(sum(value * value) FILTER (draw % 2 = 0), 0) AS q0,
                   coalesce(sum(value * value) FILTER (draw % 2 = 1), 0) AS q1
            FROM draws CROSS JOIN span GROUP BY 1, 2),
        total AS (
            SELECT replica, look, sum(n0) OVER w::DOUBLE AS n0, sum(n1) OVER w::DOUBLE AS n1,
                   sum(s0) OVER w AS s0, sum(s1) OVER w AS s1,
                   sum(q0) OVER w AS q0, sum(q1) OVER w AS q1,
                   look = max(look) OVER (PARTITION BY replica) AS is_last
            FROM sums WINDOW w AS (PARTITION BY replica ORDER BY look)),
        hits AS (
            SELECT replica, is_last,
                   coalesce(abs((s1 / n1 - s0 / n0) / sqrt(
                       (q0 - s0 * s0 / n0) / (n0 - 1) / n0 + (q1 - s1 * s1 / n1) / (n1 - 1) / n1))
                       > 1.96, false) AS hit
            FROM total),
        per_replica AS (
            SELECT replica, bool_or(hit) AS any_hit, bool_or(hit AND is_last) AS last_hit
            FROM hits GROUP BY replica)
        SELECT count(*) AS replicas, round(avg(last_hit::INT), 6) AS single_rate,
               round(avg(any_hit::INT), 6) AS peeking_rate
        FROM per_replica"""


def _bootstrap() -> str:
    weight = " + ".join(
        f"(CASE WHEN u > {limit!r}::DOUBLE THEN 1 ELSE 0 END)" for limit in poisson_one_limits()
    )
    return f"""
        WITH draws AS ({_replicas('event_id')}),
        means AS (
            SELECT replica, sum(w * value) / sum(w) AS m
            FROM (SELECT replica, value, ({weight})::DOUBLE AS w
                  FROM (SELECT *, draw / 2147483647.0::DOUBLE AS u FROM draws))
            GROUP BY replica)
        SELECT count(m) AS replicas, round(avg(m), 6) AS mean,
               round(quantile_cont(m, 0.025), 6) AS ci_low,
               round(quantile_cont(m, 0.975), 6) AS ci_high
        FROM means"""


_SLICES = """
    SELECT s.zone_id, s.slice_start, s.minutes,
           coalesce(p.rate_per_hour, 0) / 60 * s.minutes AS expected
    FROM (
        SELECT z.zone_id, greatest(h, lo) AS slice_start,
               date_diff('microsecond', greatest(h, lo), least(h + INTERVAL 1 HOUR, hi))
                   / 60000000.0::DOUBLE AS minutes
        FROM zones z CROSS JOIN (
            SELECT lo, hi, unnest(generate_series(date_trunc('hour', lo),
                date_trunc('hour', hi - INTERVAL 1 MICROSECOND), INTERVAL 1 HOUR)) AS h
            FROM (SELECT TIMESTAMP '{lo}' AS lo, TIMESTAMP '{hi}' AS hi)) b) s
    LEFT JOIN profile p ON p.zone_id = s.zone_id
        AND p.how = (isodow(s.slice_start) - 1) * 24 + hour(s.slice_start)"""


def _sample_arrivals() -> str:
    key = ("zone_id", "epoch_us(slice_start)", "piece")
    return _sql(
        f""", slices AS ({_SLICES.format(lo='2024-01-01', hi='2024-02-01')}),
        cut AS (
            SELECT zone_id, slice_start, minutes, expected,
                   CAST(ceil(expected / 16.0::DOUBLE) AS INT) AS cuts
            FROM slices WHERE expected > 0),
        pieces AS (
            SELECT zone_id, slice_start, minutes / cuts AS piece_min, expected / cuts AS mean,
                   unnest(range(cuts)) AS piece
            FROM cut),
        drawn AS (SELECT *, {_u(*key)} AS u FROM pieces),
        cdf AS (
            SELECT zone_id, slice_start, piece, piece_min, u, k.range AS k,
                   sum(exp(-mean + k.range * ln(mean) - lgamma(k.range + 1)))
                       OVER (PARTITION BY zone_id, slice_start, piece ORDER BY k.range) AS p
            FROM drawn CROSS JOIN range(0, 90) k),
        counts AS (
            SELECT zone_id, slice_start, piece, any_value(piece_min) AS piece_min,
                   count(*) FILTER (p < u) AS n
            FROM cdf GROUP BY zone_id, slice_start, piece),
        arrivals AS (
            SELECT zone_id, slice_start, piece, piece_min, unnest(range(1, n + 1)) AS i
            FROM counts WHERE n > 0)
        SELECT zone_id, slice_start + to_microseconds(CAST(round(
                   (piece + {_u(*key, 'i')}) * piece_min * 60000000.0::DOUBLE) AS BIGINT)) AS ts
        FROM arrivals""",
        "zones",
        "profile",
    ).replace("\n, slices AS", ",\nslices AS")


def _pick(u: str) -> str:
    return (
        f"coalesce((SELECT min(zone_id) FROM ladder WHERE upto > {u}), "
        "(SELECT arg_max(zone_id, (upto, zone_id)) FROM ladder))"
    )


ORACLES: dict[str, str] = {
    "scan_raw_trips": _sql(
        "SELECT pickup_ts, dropoff_ts, pu_location_id, do_location_id, "
        "round(trip_distance, 6) AS trip_distance, passenger_count FROM base", "base"),
    "clean_trips": _sql(f"SELECT {_TRIP_COLUMNS} FROM trips", "trips"),
    "dedupe_trips": _sql(f"SELECT DISTINCT {_TRIP_COLUMNS} FROM base", "base"),
    "clean_months": """
        WITH raw AS (
            SELECT l_shipdate + to_minutes(l_orderkey % 1440) AS pickup_ts,
                   l_shipdate + to_minutes(l_orderkey % 1440 + l_partkey % 200) AS dropoff_ts,
                   l_suppkey % 265 + 1 AS pu_location_id, l_partkey % 265 + 1 AS do_location_id,
                   l_quantity * 2.5::DOUBLE AS trip_distance,
                   CAST(nullif(l_linenumber % 7, 0) AS BIGINT) AS passenger_count,
                   (l_partkey % 200)::DOUBLE AS duration_min,
                   CASE WHEN l_orderkey % 97 = 0 THEN '1995-01'
                        ELSE strftime(l_shipdate, '%Y-%m') END AS month
            FROM lineitem)
        SELECT DISTINCT * FROM raw
        WHERE strftime(pickup_ts, '%Y-%m') = month
          AND month BETWEEN '1995-01' AND '2001-12'
          AND duration_min > 0 AND duration_min <= 180
          AND trip_distance > 0 AND trip_distance <= 100
          AND pu_location_id BETWEEN 1 AND 263 AND do_location_id BETWEEN 1 AND 263""",
    "check_coerce": _check_coerce(),
    "check_nulls": _check_nulls(),
    "check_ranges": _check_ranges(),
    "check_report": _check_report(),
    "hourly_counts": _sql("SELECT * FROM hourly", "hourly"),
    "dense_grid": _sql("SELECT * FROM panel", "panel"),
    "calendar_features": (
        f"SELECT ts, {_CALENDAR} FROM "
        "(SELECT DISTINCT CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)"),
    "demand_lags": _sql(f"SELECT zone_id, ts, pickups, {_HISTORY} FROM panel {_WINDOW}", "panel"),
    "demand_rolls": _sql(f"SELECT zone_id, ts, pickups, {_ROLLS} FROM panel", "panel"),
    "demand_features": _sql(
        f"SELECT zone_id, ts, pickups, {_CALENDAR}, {_HISTORY}, {_ROLLS} FROM panel {_WINDOW}",
        "panel"),
    "time_split": f"""
        SELECT event_id, ts, CASE WHEN ts < {_cutoff('ts', 'events')}
                                  THEN 'train' ELSE 'holdout' END AS split
        FROM events""",
    "eta_features": _sql(_ETA, "trips"),
    "split_balance": _sql(
        f"SELECT split, count(*) AS n, min(pickup_ts) AS first_ts, max(pickup_ts) AS last_ts "
        f"FROM ({_ETA}) GROUP BY split", "trips"),
    "demand_profile": _sql(
        "SELECT zone_id, how, round(rate_per_hour, 6) AS rate_per_hour FROM profile", "profile"),
    "weekly_totals": _sql(
        "SELECT zone_id, round(weekly_pickups, 6) AS weekly_pickups FROM weekly", "weekly"),
    "active_zones": _sql(
        "SELECT zone_id, round(weekly_pickups, 6) AS weekly_pickups FROM weekly "
        "WHERE weekly_pickups > 0", "weekly"),
    "zone_weights": _sql("SELECT zone_id, round(weight, 6) AS weight FROM weights", "weights"),
    "arrival_rate": _sql(
        """SELECT e.event_id, e.ts, e.user_id % 300 AS zone_id,
                  round(coalesce(p.rate_per_hour, 0) / 60, 6) AS rate_per_min
           FROM events e LEFT JOIN profile p ON p.zone_id = e.user_id % 300
            AND p.how = (isodow(e.ts) - 1) * 24 + hour(e.ts)""", "profile"),
    "expected_arrivals": _sql(
        "SELECT zone_id, slice_start, round(minutes, 6) AS minutes, round(expected, 6) AS expected "
        f"FROM ({_SLICES.format(lo='2024-01-01 00:30:30', hi='2024-01-31 23:52:45')})",
        "zones", "profile"),
    "zone_lookup": """
        WITH z AS (SELECT zone_id, zone, borough FROM (
                       SELECT p_partkey % 263 + 1 AS zone_id, p_name AS zone, p_brand AS borough,
                              row_number() OVER (PARTITION BY p_partkey % 263
                                                 ORDER BY p_name, p_brand) AS place
                       FROM part) WHERE place = 1)
        SELECT e.event_id, e.user_id % 300 AS zone_id, z.zone AS zone_name, z.borough,
               b.id_of_name
        FROM events e
        LEFT JOIN z ON z.zone_id = e.user_id % 300
        LEFT JOIN (SELECT zone, max(zone_id) AS id_of_name FROM z GROUP BY zone) b
               ON b.zone = z.zone""",
    "zone_distances": _sql(
        "SELECT zone_a, zone_b, round(km, 6) AS km FROM distances", "distances"),
    "travel_time": _sql(
        """SELECT b.pickup_ts, b.pu_location_id, b.do_location_id, round(d.km, 6) AS km,
                  round(d.km / 24.0::DOUBLE * 60, 6) AS travel_min
           FROM base b LEFT JOIN distances d
             ON d.zone_a = b.pu_location_id AND d.zone_b = b.do_location_id""",
        "base", "distances"),
    # distances are computed once and looked up by one number per pair of zones
    "leg_times": _sql(
        """, legs AS MATERIALIZED (SELECT zone_a * 1000 + zone_b AS pair, km FROM distances),
           rides AS MATERIALIZED (
               SELECT event_id AS rider_id, user_id * 7 % 263 + 1 AS driver_zone,
                      user_id % 263 + 1 AS origin, event_id % 263 + 1 AS dest, ts AS match_ts
               FROM events)
           SELECT rider_id, driver_zone, origin, dest, match_ts,
                  round(pickup_km, 6) AS pickup_km, round(to_pickup_min, 6) AS to_pickup_min,
                  round(trip_km, 6) AS trip_km, round(trip_min, 6) AS trip_min,
                  match_ts + to_microseconds(CAST(round(to_pickup_min * 60000000) AS BIGINT))
                      AS pickup_ts,
                  match_ts + to_microseconds(CAST(round(to_pickup_min * 60000000) AS BIGINT))
                      + to_microseconds(CAST(round(trip_min * 60000000) AS BIGINT)) AS done_ts,
                  dest AS next_driver_zone
           FROM (
               SELECT r.*, a.km AS pickup_km, a.km / 24.0::DOUBLE * 60 AS to_pickup_min,
                      b.km AS trip_km, b.km / 24.0::DOUBLE * 60 AS trip_min
               FROM rides r
               LEFT JOIN legs a ON a.pair = r.driver_zone * 1000 + r.origin
               LEFT JOIN legs b ON b.pair = r.origin * 1000 + r.dest)""",
        "distances").replace("\n, legs AS", ",\nlegs AS"),
    "drivers_in_radius": _sql(
        """SELECT r.tick, r.rider_id, count(x.driver_id) AS reachable_drivers,
                  round(min(x.km), 6) AS nearest_km
           FROM riders r LEFT JOIN reachable x ON x.tick = r.tick AND x.rider_id = r.rider_id
           GROUP BY r.tick, r.rider_id""", "riders", "reachable"),
    "nearest_driver": _sql(
        "SELECT tick, rider_id, driver_id, round(km, 6) AS pickup_km FROM reachable "
        "WHERE place = 1", "reachable"),
    "closest_drivers": _sql(
        "SELECT tick, rider_id, place AS nth, driver_id, round(km, 6) AS pickup_km FROM reachable "
        "WHERE place <= 3", "reachable"),
    "assign_fifo": _sql(
        """, ranked AS (
               SELECT tick, rider_id,
                      row_number() OVER (PARTITION BY tick ORDER BY request_ts, rider_id) AS rn
               FROM riders),
           step(tick, rn, taken, rider_id, driver_id, km) AS (
               SELECT DISTINCT tick, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT,
                      NULL::DOUBLE
               FROM riders
               UNION ALL
               SELECT tick, rn,
                      CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END,
                      rider_id, pick, pick_km
               FROM (
                   SELECT r.tick, r.rn, s.taken, r.rider_id,
                          arg_min(x.driver_id, (x.km, -x.driver_id)) AS pick,
                          min(x.km) AS pick_km
                   FROM step s
                   JOIN ranked r ON r.tick = s.tick AND r.rn = s.rn + 1
                   LEFT JOIN reachable x ON x.tick = r.tick AND x.rider_id = r.rider_id
                        AND NOT list_contains(s.taken, x.driver_id)
                   GROUP BY r.tick, r.rn, s.taken, r.rider_id))
           SELECT tick, rider_id, driver_id, round(km, 6) AS pickup_km
           FROM step WHERE driver_id IS NOT NULL""",
        "riders", "reachable").replace("\n, ranked AS", ",\nranked AS").replace(
            "WITH ", "WITH RECURSIVE ", 1),
    "event_union": _sql("SELECT * FROM log", "log"),
    "event_order": _sql(
        "SELECT driver_id, ts, seq, row_number() OVER (PARTITION BY driver_id ORDER BY ts, seq) "
        "AS position FROM log WHERE driver_id IS NOT NULL", "log"),
    "lifecycle_order": _sql(
        "SELECT *, starts_with_request AND match_before_pickup AND pickup_before_completion "
        "AS in_order FROM lifecycle", "lifecycle"),
    "rider_outcome": _sql(
        "SELECT rider_id, state, state IN ('dropped_off', 'cancelled') AS is_terminal "
        "FROM outcome", "outcome"),
    "risk_label": _sql("SELECT * FROM risk", "risk"),
    "patience_cancels": _sql("SELECT * FROM cancels", "cancels"),
    "ride_spans": _sql(
        "SELECT rider_id, count(*) AS pairs, CAST(sum(us) AS BIGINT) AS busy_us FROM spans "
        "GROUP BY rider_id", "spans"),
    "double_booking": _sql(
        """SELECT driver_id, count(*) AS n_events, CAST(min(depth) AS BIGINT) AS min_depth,
                  CAST(max(depth) AS BIGINT) AS max_depth,
                  count(*) FILTER (depth NOT IN (0, 1)) AS bad_events
           FROM depths GROUP BY driver_id""", "depths"),
    "illegal_transitions": _sql("SELECT * FROM illegal", "illegal"),
    "invariants": _sql(
        """SELECT 'completed_and_cancelled' AS invariant, count(*) AS violations FROM (
               SELECT rider_id FROM log WHERE kind = 'TripCompleted'
               INTERSECT SELECT rider_id FROM log WHERE kind = 'RiderCancelled')
           UNION ALL
           SELECT 'matched_and_cancelled', count(*) FROM (
               SELECT rider_id FROM log WHERE kind = 'RiderMatched'
               INTERSECT SELECT rider_id FROM log WHERE kind = 'RiderCancelled')
           UNION ALL
           SELECT 'lifecycle_out_of_order', count(*) FROM lifecycle WHERE NOT (
               starts_with_request AND match_before_pickup AND pickup_before_completion)
           UNION ALL
           SELECT 'driver_double_booked', count(DISTINCT driver_id) FROM depths
           WHERE depth NOT IN (0, 1)
           UNION ALL
           SELECT 'driver_outside_fleet', count(*) FROM (
               SELECT driver_id FROM log WHERE driver_id IS NOT NULL
               EXCEPT SELECT user_id FROM events WHERE user_id % 10 <> 0)""",
        "lifecycle", "depths"),
    "ride_metrics": _sql("SELECT * FROM metrics", "metrics"),
    "sample_arrivals": _sample_arrivals(),
    "place_fleet": _sql(
        f"SELECT c_custkey AS driver_id, {_pick('u')} AS zone_id FROM "
        f"(SELECT c_custkey, {_u('c_custkey')} AS u FROM customer)", "ladder"),
    "draw_destinations": _sql(
        f"""SELECT rider_id, origin, CASE WHEN d1 <> origin THEN d1 ELSE d2 END AS dest FROM (
                SELECT rider_id, origin, {_pick('u1')} AS d1, {_pick('u2')} AS d2 FROM (
                    SELECT event_id AS rider_id, user_id % 263 + 1 AS origin,
                           {_u('event_id', "'first'")} AS u1, {_u('event_id', "'again'")} AS u2
                    FROM events))""", "ladder"),
    "live_hourly_counts": (
        "SELECT user_id % 263 + 1 AS zone_id, date_trunc('hour', ts) AS ts, count(*) AS pickups "
        "FROM events GROUP BY 1, 2"),
    "live_patience_cancels": _sql("SELECT * FROM cancels", "cancels"),
    "seasonal_naive": _sql("SELECT * FROM naive", "naive"),
    "backtest_folds": _sql(
        """, base_weeks AS (
               SELECT *, date_diff('hour', (SELECT min(ts) FROM naive), ts) // 168 AS week
               FROM naive),
           folds AS (
               SELECT week, min(ts) AS test_start, max(ts) AS test_end, count(*) AS test_rows,
                      count(DISTINCT ts) AS n_hours, avg(abs(forecast - pickups)) AS mae
               FROM base_weeks GROUP BY week)
           SELECT f.week AS fold, min(b.ts) AS train_start, max(b.ts) AS train_end,
                  count(*) AS train_rows, f.test_start, f.test_end, f.test_rows,
                  round(f.mae, 6) AS test_mae, max(b.ts) < f.test_start AS leak_free
           FROM folds f JOIN base_weeks b ON b.week < f.week
           WHERE f.n_hours = 168
           GROUP BY f.week, f.test_start, f.test_end, f.test_rows, f.mae""",
        "naive").replace("\n, base_weeks AS", ",\nbase_weeks AS"),
    "forecast_errors": _sql(
        """SELECT zone_id, count(*) AS n, round(avg(abs(e)), 6) AS mae,
                  round(avg(abs(e) / nullif(pickups, 0)), 6) AS mape,
                  round(avg(e), 6) + 0.0 AS bias, round(sqrt(avg(e * e)), 6) AS rmse
           FROM (SELECT *, forecast - pickups AS e FROM naive WHERE forecast IS NOT NULL)
           GROUP BY zone_id""", "naive"),
    "conformal": _sql(
        """SELECT hour, min(s) FILTER (place = ceil((n + 1) * (1.0::DOUBLE - 0.01)))
                      AS half_width
           FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY s) AS place,
                        count(*) OVER (PARTITION BY hour) AS n
                 FROM (SELECT hour(ts) AS hour, abs(pickups - forecast) AS s FROM naive
                       WHERE forecast IS NOT NULL))
           GROUP BY hour""", "naive"),
    "coverage": _sql(
        """, scores AS (
               SELECT *, abs(pickups - forecast) AS s FROM naive WHERE forecast IS NOT NULL),
           width AS (
               SELECT min(s) FILTER (place = ceil((n + 1) * (1.0::DOUBLE - 0.02))) AS h
               FROM (SELECT s, row_number() OVER (ORDER BY s) AS place, count(*) OVER () AS n
                     FROM scores)),
           c AS (
               SELECT count(*) AS n,
                      avg((pickups BETWEEN forecast - h AND forecast + h)::INT) AS observed
               FROM scores CROSS JOIN width)
           SELECT n, round(observed, 6) AS observed_coverage,
                  round((observed - 0.98) * 100, 6) + 0.0 AS gap_pp,
                  round(abs(observed - 0.98) * 100, 9) <= 5 AS passes
           FROM c""", "naive").replace("\n, scores AS", ",\nscores AS"),
    "training_set": _sql(
        f"""SELECT * FROM (
                SELECT zone_id, ts, pickups, {_CALENDAR}, {_HISTORY}, {_ROLLS}
                FROM panel {_WINDOW})
            WHERE lag_1h IS NOT NULL AND lag_24h IS NOT NULL AND lag_168h IS NOT NULL""",
        "panel"),
    "weather_features": _sql(
        """SELECT p.*, round(w.precip, 6) AS precip,
                  round(w.precip * hour(p.ts), 6) AS precip_x_hour
           FROM panel p LEFT JOIN (
               SELECT date_trunc('hour', ts) AS ts, avg(value) AS precip
               FROM events WHERE event_type = 'error' GROUP BY 1) w ON w.ts = p.ts""", "panel"),
    "threshold_sweep": _threshold_sweep(),
    "calibration_bins": _sql(
        """SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n,
                  round(avg(score), 6) AS mean_score, round(avg(cancelled), 6) AS observed_rate
           FROM scored GROUP BY 1""", "scored"),
    "ab_test": _ab("(SELECT user_id % 2 AS arm, value FROM events)", "value"),
    "ab_power": """
        SELECT event_type, count(value) AS pilot_n, round(var_samp(value), 6) AS variance,
               CAST(ceil(round(7.84 * 2 / 0.25 * var_samp(value), 6)) AS BIGINT) AS n_per_arm
        FROM events GROUP BY event_type""",
    "cuped": _sql(
        _ab("""(SELECT arm, post - (SELECT covar_samp(post, pre) / var_samp(pre) FROM units)
                   * (pre - (SELECT avg(pre) FROM units)) AS adjusted FROM units)""", "adjusted"),
        "units"),
    "cuped_report": _sql(
        """SELECT count(post) AS n, round(covar_samp(post, pre) / var_samp(pre), 6) + 0.0 AS theta,
                  round(corr(post, pre), 6) + 0.0 AS rho, round(var_samp(post), 6) AS variance,
                  round(var_samp(post) * (1 - power(corr(post, pre), 2)), 6) AS adjusted_variance
           FROM units""", "units"),
    "peeking_inflation": _peeking(),
    "bootstrap_mean": _bootstrap(),
    "off_policy_value": """
        SELECT count(r) AS n, round(avg(r), 6) AS logged_mean, round(avg(w * r), 6) AS ips,
               round(sum(w * r) / sum(w), 6) AS snips,
               round(avg(103.0::DOUBLE + w * (r - q)), 6) AS doubly_robust
        FROM (SELECT value AS r,
                     CASE WHEN event_type IN ('purchase', 'signup') THEN 0.8::DOUBLE / 0.4::DOUBLE
                          ELSE 0.2::DOUBLE / 0.6::DOUBLE END AS w,
                     CASE WHEN event_type IN ('purchase', 'signup') THEN 105.0::DOUBLE
                          ELSE 95.0::DOUBLE END AS q
              FROM events)""",
    "psi": """
        SELECT count(*) AS bins, round(sum(term), 6) + 0.0 AS psi,
               CASE WHEN sum(term) < 0.1 THEN 'stable' WHEN sum(term) <= 0.25 THEN 'moderate'
                    ELSE 'significant' END AS shift
        FROM (
            SELECT (q - p) * ln(q / p) AS term FROM (
                SELECT greatest(ref::DOUBLE / sum(ref) OVER (), 0.000001) AS p,
                       greatest(cur::DOUBLE / sum(cur) OVER (), 0.000001) AS q
                FROM (SELECT least(floor(value / 10), 20) AS bin,
                             count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS ref,
                             count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS cur
                      FROM events GROUP BY 1)))""",
    "latency": """
        SELECT round(quantile_cont(value, 0.5), 6) AS p50,
               round(min(value) FILTER (place = ceil(0.99::DOUBLE * n)), 6) AS p99
        FROM (SELECT value, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS n
              FROM events)""",
    "verify_files": """
        SELECT CAST(page_id AS VARCHAR) AS name, strlen(html) AS length,
               sha256(html) AS sha256,
               CASE WHEN page_id % 7 = 1 THEN repeat('0', 64)
                    WHEN page_id % 7 IN (2, 3) THEN NULL ELSE sha256(html) END AS expected,
               CASE WHEN page_id % 7 = 3 THEN 'unlisted' WHEN page_id % 7 = 2 THEN 'unverified'
                    WHEN page_id % 7 = 1 THEN 'mismatch' ELSE 'ok' END AS status
        FROM pages""",
}
ORACLES["scan_multi"] = ORACLES["scan_raw_trips"]
ORACLES["union_months"] = ORACLES["clean_trips"]
ORACLES["live_unique_trips"] = ORACLES["clean_trips"]
ORACLES["live_ride_metrics"] = ORACLES["ride_metrics"]
ORACLES["live_illegal_transitions"] = ORACLES["illegal_transitions"]
ORACLES["extended_features"] = ORACLES["demand_features"]
