"""Closed vocabularies and rule constants.

FIXED VALUES — these must equal the source system's values for results to
match; they are stated here once, in natural order, and used everywhere as
Spark map literals (``create_map``) or small broadcast dimensions.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- FIXED VALUES: tokens that mean "missing" in the raw feed -------------
NULL_TOKENS = ["NULL", "null", "None", "none", "N/A", "n/a", "\\N", ""]

# --- FIXED VALUES: raw cause token -> canonical cause ---------------------
CAUSE_MAP = {
    "vehicle_breakdown": "vehicle_breakdown",
    "accident": "accident",
    "tree_fall": "tree_fall",
    "water_logging": "water_logging",
    "pot_holes": "pot_holes",
    "public_event": "public_event",
    "construction": "construction",
    "flood": "flood",
    "procession": "procession",
    "vip_movement": "vip_movement",
    "protest": "protest",
    "congestion": "congestion",
    "road_conditions": "road_conditions",
    "others": "other",
    "other": "other",
}

# --- FIXED VALUES: cause risk weight (model feature), default 1 -----------
CAUSE_WEIGHT = {
    "accident": 3, "flood": 3, "vip_movement": 3, "protest": 3,
    "water_logging": 2, "tree_fall": 2, "public_event": 2, "procession": 2,
    "construction": 2,
    "pot_holes": 1, "vehicle_breakdown": 1, "congestion": 1,
    "road_conditions": 1, "other": 1,
}

# --- FIXED VALUES: severity score parts -----------------------------------
PRIORITY_SCORE = {"High": 2, "Medium": 1, "Low": 0}
CAUSE_SEVERITY_SCORE = {
    "accident": 2, "flood": 2, "vip_movement": 2, "protest": 2,
    "water_logging": 1, "tree_fall": 1, "public_event": 1, "procession": 1,
    "construction": 1,
    "vehicle_breakdown": 0, "pot_holes": 0, "congestion": 0,
    "road_conditions": 0, "other": 0,
}
SEVERITY_HIGH_AT = 4
SEVERITY_MEDIUM_AT = 2
VALID_PRIORITIES = ["High", "Medium", "Low"]

# --- FIXED VALUES: vehicle ordinal (unknown/other -> last) ----------------
VEH_TYPE_ORDER = ["heavy_vehicle", "ksrtc_bus", "bmtc_bus", "private_bus",
                  "lcv", "private_car", "two_wheeler", "unknown"]

# --- FIXED VALUES: semantic text types, first match wins ------------------
SEMANTIC_PATTERNS = [
    ("sports_event", r"cricket|match|stadium|chinnaswamy|ಕ್ರಿಕೆಟ್|ಪಂದ್ಯ|ಕ್ರೀಡಾ"),
    ("vip_movement", r"\bvip\b|\bvvip\b|minister|cm\b|convoy|ಗಣ್ಯ|ಸಚಿವ"),
    ("protest", r"protest|dharna|strike|bandh|agitation|ಪ್ರತಿಭಟನೆ|ಧರಣಿ|ಮುಷ್ಕರ"),
    ("procession", r"procession|rally|march|festival|jatre|ಮೆರವಣಿಗೆ|ಜಾತ್ರೆ|ಹಬ್ಬ"),
    ("utility_work", r"bwssb|kride|bescom|bbmp|cement|drainage|chamber|pipe|"
                     r"ಒಳಚರಂಡಿ|ಸಿಮೆಂಟ್|ಪೈಪ್|ಕೆಲಸ|ವರ್ಕ್|ಕಾಮಗಾರಿ"),
    ("tree_fall", r"tree\s*fall|tree\s*fell|fallen tree|ಮರ\s*ಬಿದ್ದ|ಮರ ಬಿದ"),
    ("water_logging", r"water\s*logg|woter|flood|drainage leak|ನೀರು|ಮಳೆ|ಜಲ"),
    ("accident", r"accident|collision|crash|hit|ಅಪಘಾತ|ಡಿಕ್ಕಿ"),
    ("vehicle_breakdown", r"break\s*down|breakdown|broke|offload|off road|off\s* road|"
                          r"mechanic|clutch|gear\s*box|punctur|panchar|ಪಂಚರ್|tyre|tyear|"
                          r"tire|blost|blast|ಕೆಟ್ಟು|ಬ್ರೇಕ್\s*ಡೌನ್|ವೆಹಿಕಲ್"),
    ("pothole", r"pot\s*hole|pothole|gundi|ಗುಂಡಿ"),
    ("congestion", r"congest|traffic jam|slow mov|ನಿಧಾನ|ಜಾಮ್"),
]
ANON_PLACEHOLDER = r"\[(LOCATION|PERSON|PHONE|EMAIL)\]"
SEMANTIC_TYPE_ORDER = ["other", "congestion", "pothole", "vehicle_breakdown",
                       "water_logging", "tree_fall", "accident", "utility_work",
                       "procession", "protest", "vip_movement", "sports_event"]

# --- FIXED VALUES: resource rules (config defaults) -----------------------
PEAK_HOURS = [0, 1, 2, 3, 4, 5, 6, 7, 19, 20, 21, 22, 23]
BASE_PERSONNEL = {"Low": 2, "Medium": 3, "High": 5}
PEAK_HOUR_BONUS = 1
ROAD_CLOSURE_BONUS = 1
HIGH_RISK_CAUSE_BONUS = 1
HIGH_RISK_CAUSES = ["accident", "flood", "water_logging", "protest",
                    "vip_movement", "procession"]
BARRICADE_CAUSES = ["accident", "tree_fall", "flood", "water_logging", "protest",
                    "vip_movement", "procession", "public_event"]
DIVERSION_MIN_SEVERITY = "High"
CLOSURE_PROB_BARRICADE_THRESHOLD = 0.15
PRIORITY_FLAGS = {"High": "URGENT", "Medium": "PRIORITY", "Low": "ROUTINE"}
CLEARANCE_FALLBACK = {"median": 57.0, "p25": 30.0, "p75": 120.0}

# --- FIXED VALUES: cost of an unmet officer by severity; cost units per km -
UNMET_PENALTY = {"High": 9000, "Medium": 3000, "Low": 1000}
TRAVEL_SCALE = 10

# --- FIXED VALUES: zone -> police stations (first = nearest) --------------
ZONE_STATIONS = {
    "North Zone 1": ["Hebbala", "Hennuru", "Byatarayanapura"],
    "North Zone 2": ["Kodigehalli", "Byatarayanapura", "Hebbala"],
    "Bengaluru North Corporation": ["Hebbala", "Byatarayanapura", "Hennuru"],
    "Central Zone 1": ["Sadashivanagar", "Cubbon Park", "Halasur"],
    "Central Zone 2": ["Cubbon Park", "Sadashivanagar", "Halasur"],
    "Bengaluru Central Corporation": ["Cubbon Park", "Sadashivanagar", "Halasur"],
    "South Zone 1": ["Jayanagara", "Wilson Garden", "Madiwala"],
    "South Zone 2": ["Madiwala", "Jayanagara", "HSR Layout"],
    "Bengaluru South Corporation": ["Jayanagara", "Madiwala", "Wilson Garden"],
    "East Zone 1": ["K.R. Pura", "Mahadevapura", "Hennuru"],
    "East Zone 2": ["Mahadevapura", "K.R. Pura", "Halasur"],
    "Bengaluru East Corporation": ["K.R. Pura", "Mahadevapura"],
    "West Zone 1": ["Peenya", "Kengeri", "Byatarayanapura"],
    "West Zone 2": ["Kengeri", "Peenya", "Byatarayanapura"],
    "Bengaluru West Corporation": ["Peenya", "Kengeri"],
    "Unknown": ["Cubbon Park"],
}
FALLBACK_ZONE = "Unknown"

# --- FIXED VALUES: cause display labels -----------------------------------
CAUSE_DISPLAY = {
    "vehicle_breakdown": "Vehicle Breakdown", "accident": "Accident",
    "tree_fall": "Tree Fall", "water_logging": "Water Logging",
    "pot_holes": "Pot Holes", "public_event": "Public Event",
    "procession": "Procession", "vip_movement": "VIP Movement",
    "protest": "Protest", "construction": "Construction",
    "congestion": "Congestion", "road_conditions": "Road Conditions",
    "flood": "Flood", "other": "Other",
}

# --- FIXED VALUES: planned-event retrieval ---------------------------------
PLANNED_CAUSES = ["procession", "vip_movement", "protest", "public_event"]
PLANNED_OBSTRUCTIONS = ["construction"]
PLANNABLE_EVENTS = PLANNED_CAUSES + PLANNED_OBSTRUCTIONS
ANALOG_MIN_LOCAL = 3

# --- FIXED VALUES: road classes (link ramps fold to their parent) --------
ROAD_CLASS_RANK = {
    "motorway": 6, "motorway_link": 6,
    "trunk": 5, "trunk_link": 5,
    "primary": 4, "primary_link": 4,
    "secondary": 3, "secondary_link": 3,
    "tertiary": 2, "tertiary_link": 2,
    "unclassified": 1, "residential": 1, "living_street": 1, "service": 1,
}
DEFAULT_LANES_BY_RANK = {6: 6, 5: 4, 4: 4, 3: 3, 2: 2, 1: 2, 0: 1}
EARTH_RADIUS_M = 6371000.0
ROAD_MATCH_MAX_M = 120.0
UNMATCHED_ROAD_CLASS = "minor_or_unknown"

# --- FIXED VALUES: spatial parameters --------------------------------------
EARTH_RADIUS_KM = 6371.0
DBSCAN_EPS_KM = 0.2
DBSCAN_MIN_SAMPLES = 5
CLUSTER_BUFFER_KM = 0.2
KDE_BANDWIDTH = 0.04
KDE_GRID = 60
KDE_PAD_DEG = 0.02
KDE_MIN_WEIGHT = 0.08
MORAN_K = 8
MORAN_SIGNIFICANCE = 0.05
HOLDOUT_CELL_KM = 0.5
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON_EQ = 111.320
HOLDOUT_THRESHOLDS = [3, 5, 8, 12, 20, 35, 60]
HOLDOUT_TARGET_AREA = 0.05
BBOX_LAT = (12.5, 13.5)
BBOX_LON = (77.2, 77.9)
REQUIRED_COLUMNS = ["id", "latitude", "longitude", "start_datetime", "event_cause", "status"]
MAX_DURATION_MINUTES = 10080

# --- FIXED VALUES: impact score ---------------------------------------------
IMPACT_WEIGHTS = {"closure": 0.40, "corridor": 0.25, "road": 0.20, "window": 0.15}
CORRIDOR_SOFT_CAP = 30
LANES_SOFT_CAP = 6
ROAD_NEUTRAL = 0.5

# --- FIXED VALUES: roster ---------------------------------------------------
DEFAULT_OFFICERS_PER_STATION = 6

# --- FIXED VALUES: why a detour cannot be planned ----------------------------
NO_ROADS = "no mapped roads near the incident"
NO_THROUGH_ROUTE = "no through-route around the closure (dead-end or single approach)"
NO_ALTERNATE = "no alternate route within the mapped area"


def map_lit(d: dict) -> Column:
    """A dict as a Spark map literal (folded into the plan, no join)."""
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def lookup(d: dict, key: Column, default=None) -> Column:
    v = map_lit(d)[key]  # missing key -> NULL
    return v if default is None else F.coalesce(v, F.lit(default))
