"""Labels, limits and lists that results depend on. Plain data, no logic."""

# Event category by event type (lower case); anything else is "other".
EVENT_CATEGORY = {
    "engagement": ["page_view", "click", "scroll"],
    "search": ["search"],
    "commerce": ["add_to_cart", "remove_from_cart", "purchase"],
    "authentication": ["login", "logout", "signup"],
}

# Region by country code; anything else is "Other".
REGION = {
    "North America": ["US", "CA", "MX"],
    "Europe": ["UK", "DE", "FR"],
    "Oceania": ["AU"],
    "Asia": ["JP", "IN"],
    "South America": ["BR"],
}

# Time zone by country code; anything else is "UTC".
TIMEZONE = {
    "America/New_York": ["US"],
    "Europe/London": ["UK"],
    "Europe/Berlin": ["DE"],
    "Asia/Tokyo": ["JP"],
    "Australia/Sydney": ["AU"],
}

# Merchant type by merchant category (lower case); anything else is "other".
MERCHANT_TYPE = {
    "food_beverage": ["grocery", "restaurant"],
    "automotive": ["gas_station"],
    "retail": ["retail", "online", "electronics"],
    "travel": ["hotel", "airline"],
    "healthcare": ["pharmacy"],
}

# Sensor category by sensor type (lower case); anything else is "other".
SENSOR_CATEGORY = {
    "environmental": ["temperature", "humidity", "pressure"],
    "security": ["motion", "sound"],
    "industrial": ["vibration", "power", "flow_rate"],
    "comfort": ["air_quality", "light"],
}

# Location category by a word the location contains, first hit wins; else "other".
LOCATION_CATEGORY = {
    "warehouse": "storage",
    "office": "office",
    "production": "manufacturing",
    "server": "it_infrastructure",
}

# Lower bounds of the bands, highest first, with the label below them all last.
RISK_BANDS = ([(0.8, "high"), (0.5, "medium"), (0.2, "low")], "very_low")
AMOUNT_BANDS = ([(1000.0, "large"), (100.0, "medium"), (10.0, "small")], "micro")
BATTERY_BANDS = ([(80.0, "excellent"), (50.0, "good"), (20.0, "low")], "critical")

# Value bands by sensor type as (below, below, up to, up to).
VALUE_BANDS = {
    "temperature": (10.0, 18.0, 26.0, 35.0),
    "humidity": (20.0, 30.0, 70.0, 85.0),
}

# Alert limits by sensor type as (low, high); no entry means no limit.
ALERT_LIMITS = {
    "temperature": (-40.0, 85.0),
    "humidity": (0.0, 100.0),
    "pressure": (0.0, 10.0),
    "vibration": (None, 50.0),
    "light": (0.0, 100000.0),
    "air_quality": (None, 500.0),
    "sound": (None, 130.0),
    "power": (0.0, 1000.0),
    "flow_rate": (0.0, 1000.0),
}

# How far beyond the limit counts as severity 1, by sensor type; else severity is 0.6.
SEVERITY_SPAN = {"temperature": 20.0, "humidity": 50.0}

# Usual amounts by merchant category as (min, max, fraud multiplier).
MERCHANT_LIMITS = {
    "grocery": (15.0, 200.0, 2.0),
    "gas_station": (20.0, 80.0, 1.5),
    "restaurant": (10.0, 150.0, 3.0),
    "retail": (25.0, 500.0, 4.0),
    "online": (5.0, 1000.0, 5.0),
    "atm": (20.0, 400.0, 2.0),
    "hotel": (80.0, 400.0, 3.0),
    "airline": (150.0, 1500.0, 2.0),
    "pharmacy": (5.0, 100.0, 1.5),
    "electronics": (50.0, 2000.0, 6.0),
}

# Readings by sensor type as (unit, normal low, normal high, critical low, critical high).
SENSOR_RANGES = {
    "temperature": ("celsius", 18.0, 26.0, -10.0, 50.0),
    "humidity": ("percent", 30.0, 70.0, 0.0, 100.0),
    "pressure": ("hPa", 1000.0, 1030.0, 950.0, 1080.0),
    "light": ("lux", 100.0, 1000.0, 0.0, 50000.0),
    "motion": ("boolean", 0.0, 1.0, 0.0, 1.0),
    "air_quality": ("ppm", 50.0, 150.0, 0.0, 1000.0),
    "vibration": ("mm/s", 0.5, 3.0, 0.0, 20.0),
    "sound": ("dB", 30.0, 60.0, 0.0, 120.0),
    "power": ("watts", 100.0, 500.0, 0.0, 2000.0),
    "flow_rate": ("liters/min", 10.0, 50.0, 0.0, 200.0),
}

# Sensor locations.
LOCATIONS = [
    "warehouse_a", "warehouse_b", "office_floor_1", "office_floor_2", "production_line_1",
    "production_line_2", "server_room", "loading_dock", "cafeteria", "parking_garage",
]

# Countries of the events, and those that count as risky.
COUNTRIES = ["US", "UK", "DE", "FR", "CA", "AU", "JP", "IN", "BR", "MX"]
HIGH_RISK_COUNTRIES = ["RU", "CN", "NG", "PK"]

# Parts of a transaction's risk score.
RISK_WEIGHTS = {
    "amount_factor": 3, "amount": 0.3, "night_until": 6, "night": 0.2, "risky_country": 0.4, "other_country": 0.1,
    "other_category": 0.1, "within_minute": 0.3, "within_five_minutes": 0.1, "magnetic_stripe": 0.1,
    "per_prior_fraud": 0.1, "most_prior_frauds": 0.3,
}

# What lowers a reading's data quality from 1.
QUALITY_WEIGHTS = {
    "battery_low": 20, "low": 0.3, "battery_half": 50, "half": 0.1, "calibration_days": 90, "calibration": 0.2,
    "per_error": 0.02, "most_errors": 0.3, "anomaly": 0.1,
}

# Sources and the status of alerts.
ALERT_SOURCES = {"fraud": "CEP-FRAUD-DETECTION", "anomaly": "ANOMALY-DETECTION"}
ALERT_STATUS = "ACTIVE"

# Alerts by type as (title, pattern of the description); the types are fixed values, the wording is this library's own.
ALERT_TEXTS = {
    "VELOCITY_FRAUD": ("Many payments in a row", "%d payments, %.2f in all, within %d min"),
    "STRUCTURING_FRAUD": ("Large payment, then small ones", "payment of %.2f, then %d small ones of %.2f in all"),
    "GEOGRAPHIC_ANOMALY": ("Payments far apart", "payment in %s, then in %s, within %d min"),
    "TESTING_ATTACK": ("Card tried until it worked", "%d refused payments, then one of %.2f went through"),
    "OFF_HOURS_HIGH_RISK": ("Risky payment at night", "payment of %.2f, risk %.2f, at %s"),
    "STATISTICAL_ANOMALY": ("Reading far from the usual", "reading %.2f is %.2f deviations from the mean %.2f"),
    "THRESHOLD_VIOLATION": ("Reading beyond its limits", "%s reading %.2f %s beyond its limits"),
    "RAPID_CHANGE": ("Reading jumped", "reading moved by %.2f percent, %.2f to %.2f, in %.1f s"),
    "MISSING_DATA": ("Gap in readings", "silent for %.1f min"),
    "SENSOR_OFFLINE": ("Sensor silent", "silent for more than %.1f min"),
    "CORRELATION_ANOMALY": ("Reading unlike its neighbours", "reading %.2f lies %.2f from the mean %.2f of its location"),
}

# The table of a document by the id it carries; others belong to "user-events".
INDEXES = {"transactionId": "transaction-events", "sensorId": "iot-sensor-events"}

# Message kind by topic; anything else is "unknown".
TOPIC_KINDS = {
    "user-events": "user_event",
    "transaction-events": "transaction_event",
    "iot-sensor-events": "iot_sensor_event",
    "aggregated-events": "aggregation",
    "dashboard-metrics": "metrics",
}

# Time ranges of the dashboard filter.
TIME_RANGES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "24h": "24 hours"}
