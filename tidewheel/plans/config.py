"""Fixed values of the behaviour model: event vocabularies, bucket sizes and feature groups."""

from __future__ import annotations

# Event types.
STUDENT_EVENTS = (
    "write new recipe", "write new experience", "write new reflection", "edit recipe", "edit experience", "edit reflection",
    "receive feedback", "request feedback", "log in", "be inactive", "add image",
)
STAFF_EVENTS = (
    "receive feedback request", "send feedback response", "communicate", "add class file", "create new recipe",
    "create new experience", "log in",
)
NEW = ("write new recipe", "write new experience")
WRITE = (*NEW, "edit recipe", "edit experience")
RECIPE = ("write new recipe", "edit recipe")
EXPERIENCE = ("write new experience", "edit experience")
REFLECTION = ("write new reflection", "edit reflection")
NEW_R = (*NEW, "write new reflection")
EDIT_R = ("edit recipe", "edit experience", "edit reflection")
WRITE_R = (*WRITE, *REFLECTION)
WRITE_R_IMAGE = (*WRITE_R, "add image")
QUIET = ("be inactive", "receive feedback")

# Notification type of staff events, and which side of it acts.
STAFF_NOTIFICATIONS = {
    "feedback response": ("send feedback response", "sender"),
    "communication": ("communicate", "sender"),
    "feedback request": ("receive feedback request", "recipient"),
    "classfile added": ("add class file", "sender"),
    "new experience": ("create new experience", "sender"),
    "new recipe": ("create new recipe", "sender"),
}

# Buckets of a dense series by time unit.
CAPACITY = {
    "semester": 2, "moy": 12, "biweek": 27, "woy": 53, "doy": 366,
    "complete_semester": 6, "complete_moy": 36, "complete_biweek": 81, "complete_woy": 156, "complete_doy": 1095,
    "semester_moy": 6, "semester_biweek": 13, "semester_woy": 26, "semester_doy": 182,
}

# Groups of features that are clustered together.
FEATURE_GROUPS = {
    "effort": {"features": ["total_duration", "writing_events"], "metric": "dtw"},
    "consistency": {"features": ["average_duration_session", "total_duration_norm", "writing_events_norm"], "metric": "dtw"},
    "quality": {"features": ["image_ratio", "average_reflection", "tags_ratio", "ingredients_ratio"], "metric": "dtw"},
    "feedback": {"features": ["request_feedback_ratio", "response_request_ratio"], "metric": "dtw"},
    "regularity": {"features": ["pwd_biweek", "fdh", "fwh"], "metric": "euclidean"},
}
FEATURE_GROUPS_WEEKLY = FEATURE_GROUPS | {"regularity": {"features": ["pwd", "fdh", "fwh"], "metric": "euclidean"}}

# Grids of the parameter searches.
GAMMAS = [round(0.3 + 0.1 * i, 1) for i in range(16)]
WINDOWS = {"dtw": list(range(13)), "euclidean": [1]}
CLUSTERS = [2, 3, 4, 5]
PRODUCT_GAMMAS, PRODUCT_WINDOWS, PRODUCT_CLUSTERS = [0.7, 0.9, 1.0, 1.1, 1.3], [0, 1, 2, 3, 4], [2, 3, 4]
SWEEP_CLUSTERS = list(range(2, 10))
PROFILE_CLUSTERS = [2, 3, 4, 5, 6]

PERIOD_KEYS = {"yearly": ["calendar_year", "school_year"], "semester": ["calendar_year", "school_year", "semester"]}
SERIES_RUNS = [(p, u) for p in ("semester", "yearly") for u in ("biweek", "woy")]


def time_unit(period: str, unit: str) -> str:
    """A unit's column: within the semester for the period ``semester``."""
    return f"semester_{unit}" if period == "semester" else unit


def least_group(cohort_size: int, factor: float) -> int:
    """The smallest group worth keeping: the cohort's size over ``factor``, rounded up."""
    return -int(-cohort_size // factor)
