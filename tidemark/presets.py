"""Default clinical settings. All of them are parameters of the operators that use them."""

from __future__ import annotations

from tidemark.operators.codes import Code, CodeBook

# Event codes per vital sign.
HEART_RATE_CODES = [211, 220045]
MAP_CODES = [456, 52, 6702, 443, 220052, 220181, 225312]
RESP_RATE_CODES = [618, 615, 220210, 224690]
SPO2_CODES = [646, 220277]
TEMPERATURE_CELSIUS_CODES = [676, 223762]
TEMPERATURE_FAHRENHEIT_CODES = [678, 223761]

# Inclusive valid ranges in feature units.
VITAL_RANGES = {
    "heart_rate": (20.0, 250.0),
    "map": (20.0, 200.0),
    "resp_rate": (4.0, 80.0),
    "spo2": (50.0, 100.0),
    "temperature_c": (25.0, 45.0),
}

# Age cap, window lengths and split defaults.
AGE_CAP_ABOVE = 89.0
AGE_CAP_TO = 90.0
WINDOW_HOURS = 6
EARLY_WINDOW_HOURS = 48
EARLY_MIN_HOURS = 48
BOUNDED_MEAN_HOURS = (24, 48)
BASE_SEED = 42
TEST_SIZE = 0.20
FOLDS = 5
REPEATS = 30
CLIP_QUANTILES = (0.01, 0.99)
THRESHOLD = 0.5

VITALS = CodeBook(
    codes=[
        *[Code(c, "heart_rate") for c in HEART_RATE_CODES],
        *[Code(c, "map") for c in MAP_CODES],
        *[Code(c, "resp_rate") for c in RESP_RATE_CODES],
        *[Code(c, "spo2") for c in SPO2_CODES],
        *[Code(c, "temperature_c") for c in TEMPERATURE_CELSIUS_CODES],
        *[Code(c, "temperature_c", offset=32.0, scale=5.0 / 9.0) for c in TEMPERATURE_FAHRENHEIT_CODES],
    ],
    ranges=VITAL_RANGES,
)
