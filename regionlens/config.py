"""Parameters of the transforms and the fixed name lists they work with."""

from __future__ import annotations

from dataclasses import dataclass, field

AGE_COLUMNS = ("age_0_18", "age_19_40", "age_41_60", "age_60_plus")
DEDUP_KEYS = ("date", "state", "district")
CATEGORY_COLUMNS = ("state", "district", "pincode")

# Accepted header names per canonical column, first present wins
# (compared without regard to case).
COLUMN_ALIASES = {
    "date": ["date", "timestamp", "enrolment_date"],
    "state": ["state", "state_name"],
    "district": ["district", "district_name"],
    "pincode": ["pincode", "pin", "postal_code"],
    "enrolment_count": ["enrolment_count", "enrolments", "total_enrolments"],
    "update_count": ["update_count", "updates", "total_updates"],
}

# Regular expressions tried in order on column names when the
# schema is unknown (matched without regard to case).
COLUMN_PATTERNS = {
    "date": ["date", "timestamp", "enrolment_date", "enrollment_date", "time"],
    "state": ["state", "state_name", "region", "location"],
    "district": ["district", "district_name", "area", "zone"],
    "pincode": ["pincode", "pin", "postal_code", "postal", "zip"],
    "enrolment_count": [
        "enrolment", "enrollment", "enrolments", "enrollments",
        "count", "total", "volume", "number",
    ],
    "update_count": ["update", "updates", "modification", "change", "correction"],
    "age_0_18": ["age_0_18", "age0_18", "age_0_to_18", "0_18", "under_18", "minor", "children"],
    "age_19_40": ["age_19_40", "age19_40", "age_19_to_40", "19_40", "adult", "young_adult", "young"],
    "age_41_60": ["age_41_60", "age41_60", "age_41_to_60", "41_60", "middle_age", "middle", "mid_age"],
    "age_60_plus": ["age_60_plus", "age60_plus", r"age_60\+", "60_plus", "senior", "elderly", "old"],
}

# Words that mark a numeric column as a count.
COUNT_WORDS = ("total", "count", "sum", "number")

# Words that mark a column as numeric when types are standardised.
NUMERIC_WORDS = ("count", "sum", "total", "number", "age")

# Spellings of a region replaced by its current name.
REGION_ALIASES = {
    "DELHI": "NCT of Delhi",
    "NEW DELHI": "NCT of Delhi",
    "PONDICHERRY": "Puducherry",
    "ORISSA": "Odisha",
    "UTTARANCHAL": "Uttarakhand",
    "JAMMU & KASHMIR": "Jammu and Kashmir",
}

# Coordinates of regions shown on the map, and the map centre.
REGION_COORDINATES = [
    ("Maharashtra", 19.7515, 75.7139),
    ("Uttar Pradesh", 26.8467, 80.9462),
    ("Karnataka", 15.3173, 75.7139),
    ("Tamil Nadu", 11.1271, 78.6569),
    ("Delhi", 28.7041, 77.1025),
    ("Gujarat", 22.2587, 71.1924),
    ("Rajasthan", 27.0238, 74.2179),
    ("West Bengal", 22.9868, 87.8550),
    ("Bihar", 25.0961, 85.3131),
    ("Telangana", 18.1124, 79.0193),
]
MAP_CENTRE = (20.5937, 78.9629)

# Weight of each risk component.
RISK_WEIGHTS = {
    "volume_risk": 0.15,
    "anomaly_frequency_risk": 0.25,
    "anomaly_severity_risk": 0.25,
    "volatility_risk": 0.15,
    "consistency_risk": 0.10,
    "update_pattern_risk": 0.10,
}

# Raw value at which a component reaches 1.
RISK_FULL_SCALE = {
    "volume_risk": 10_000_000.0,
    "anomaly_frequency_risk": 1.0,
    "anomaly_severity_risk": 1.0,
    "volatility_risk": 0.5,
    "consistency_risk": 1.0,
    "update_pattern_risk": 0.3,
}

# Lowest score of each level, and the display of a level.
RISK_CUTS = (("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.4), ("LOW", 0.2))
BLEND_CUTS = (("CRITICAL", 0.7), ("HIGH", 0.5), ("MEDIUM", 0.3), ("LOW", 0.1))
LOWEST_LEVEL = "VERY_LOW"
RISK_COLOURS = {
    "CRITICAL": "#DC3545",
    "HIGH": "#FD7E14",
    "MEDIUM": "#FFC107",
    "LOW": "#28A745",
    "VERY_LOW": "#6C757D",
}
RISK_ICONS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "VERY_LOW": "⚫"}
BLEND_ICONS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢", "VERY_LOW": "🔵"}


# Date formats tried after ISO, month before day where both would fit.
DATE_FORMATS = (
    "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy",
)
# Texts that stand for a missing value in a numeric column.
MISSING = ("", "n/a", "na", "nan", "null", "none", "-")


@dataclass(frozen=True)
class CleanCfg:
    """Bounds of the cleaning rules.

    ``as_of`` is the newest accepted date; ``None`` means the time of the run.
    ``order_by`` names a column with a total order of the input rows, used to
    keep the first of repeated rows.
    """

    min_date: str = "2009-01-01"
    as_of: str | None = None
    cap: float = 1_000_000.0
    ratio: float = 5.0
    tol: float = 1.1
    null_share: float = 0.5
    order_by: str = "seq"
    date_formats: tuple[str, ...] = DATE_FORMATS
    accuracy: int | None = None


@dataclass(frozen=True)
class ForestCfg:
    trees: int = 100
    sample: int = 256
    contamination: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class LofCfg:
    neighbours: int = 20
    contamination: float = 0.1
    leaf_rows: int = 2048


@dataclass(frozen=True)
class ClusterCfg:
    k: int = 5
    restarts: int = 10
    max_iter: int = 300


@dataclass(frozen=True)
class RiskCfg:
    weights: dict = field(default_factory=dict)
    cuts: tuple = RISK_CUTS
