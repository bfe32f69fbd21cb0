"""Limits and vocabularies that results depend on (fixed values)."""

# Zone domain and cleaning limits.
ZONE_MIN, ZONE_MAX = 1, 263
MAX_DURATION_MIN = 180.0
MAX_TRIP_MILES = 100.0

# Demand history features: hours back, and strictly-past window lengths.
LAG_HOURS = {"lag_1h": 1, "lag_24h": 24, "lag_168h": 168}
ROLL_HOURS = {"roll_mean_24h": 24, "roll_mean_168h": 168}

HOLDOUT_FRACTION = 0.2
HOURS_PER_WEEK = 168
EARTH_RADIUS_KM = 6371.0088

# Scenario defaults of the dispatch domain.
PATIENCE_MIN = 8.0
SPEED_KMH = 24.0
RADIUS_KM = 3.0

# Event kinds.
REQUESTED = "RiderRequested"
MATCHED = "RiderMatched"
CANCELLED = "RiderCancelled"
PICKED_UP = "PickupCompleted"
COMPLETED = "TripCompleted"
REPOSITIONED = "DriverRepositioned"

# Event kind -> state the rider / driver is in afterwards.
RIDER_STATE = {
    REQUESTED: "waiting",
    MATCHED: "matched",
    CANCELLED: "cancelled",
    PICKED_UP: "picked_up",
    COMPLETED: "dropped_off",
}
DRIVER_STATE = {
    MATCHED: "to_pickup",
    PICKED_UP: "on_trip",
    COMPLETED: "idle",
    REPOSITIONED: "repositioning",
}

# Legal moves (from, to).
RIDER_MOVES = (
    ("waiting", "matched"),
    ("waiting", "cancelled"),
    ("matched", "picked_up"),
    ("matched", "cancelled"),
    ("picked_up", "dropped_off"),
)
DRIVER_MOVES = (
    ("idle", "to_pickup"),
    ("idle", "repositioning"),
    ("to_pickup", "on_trip"),
    ("to_pickup", "idle"),
    ("on_trip", "idle"),
    ("repositioning", "idle"),
    ("repositioning", "to_pickup"),
)
RIDER_END_STATES = ("dropped_off", "cancelled")
