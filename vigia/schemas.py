"""Table schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# --- enumerations (fixed values) ---------------------------------------------------------
CHANNELS = ("web", "api", "telegram", "whatsapp")
ACTION_CLICK = "pinchar_enlace"
ACTION_CALL = "llamar"
ACTION_TRANSFER = "transferir"
ACTION_INSTALL = "instalar_app"
ACTION_CODE = "dar_codigo"
ACTION_CREDENTIALS = "introducir_credenciales"
ACTION_NONE = "ninguna"
LEVEL_SCAM = "estafa"
LEVEL_UNCERTAIN = "no_puedo_confirmarlo"
TYPE_PHISHING = "phishing"
TYPE_SPAM = "spam"
TYPE_TRANSACTIONAL = "transaccional"
TYPE_PERSONAL = "personal"
TYPE_UNKNOWN = "desconocido"
CRITICAL, WARNING, INFO = "critical", "warning", "info"
HIT, MISS, ERROR = "hit", "miss", "error"
TIMEOUT, NOT_APPLICABLE, SUPPRESSED = "timeout", "not_applicable", "suppressed"
FIRED, NOT_FIRED = "fired", "not_fired"

# --- parameters with their defaults ------------------------------------------------------
RULESET_VERSION = "2026.08.4"
SIGNALSET_VERSION = "2026.08.4"
FEED_STALE_HOURS = 6
CT_MIN_CONFIDENCE = 0.5
ML_THRESHOLD = 0.70
CAMPAIGN_WINDOW_DAYS = 30
MIN_ARTIFACT_TYPES = 2
RATE_LIMIT_ANALYSES = 30
RATE_LIMIT_FEEDBACK = 60
RETENTION_HOURS = 24
SCAM_SCORE = 70
TEXT_SIMILARITY = 0.90
TYPO_SIMILARITY = 0.82
PROVIDER_CONSENSUS = 2

# --- tables ------------------------------------------------------------------------------
MESSAGES = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("channel", T.StringType()),
    T.StructField("user_hash", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("body_redacted", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("purged_at", T.TimestampType()),
])

# One evidence row; `value` is JSON text, `domain` is the domain the row speaks about.
SIGNAL = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("weight", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("hard_rule", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("domain", T.StringType()),
])

ARTIFACTS = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("campaign_id", T.StringType()),
    T.StructField("artifact_type", T.StringType()),
    T.StructField("value_hash", T.StringType()),
    T.StructField("value_public", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

CAMPAIGNS = T.StructType([
    T.StructField("campaign_id", T.StringType(), False),
    T.StructField("simhash", T.LongType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("hits", T.LongType()),
    T.StructField("entity", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("confirmed", T.BooleanType()),
    T.StructField("cluster_method", T.StringType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("snapshot_id", T.StringType(), False),
    T.StructField("provider", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("entry_count", T.LongType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("succeeded", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
])

INDICATORS = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("indicator_type", T.StringType()),
    T.StructField("value_hash", T.StringType()),
    T.StructField("value_public", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
])

REVIEWS = T.StructType([
    T.StructField("dedupe_key", T.StringType(), False),
    T.StructField("message_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("resolved_at", T.TimestampType()),
])

OBSERVATIONS = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("indicator_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("retrieved_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("version", T.StringType()),
    T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    T.StructField("retryable", T.BooleanType()),
])

EVALUATION_CASES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("expected_level", T.StringType()),
    T.StructField("required_signals", T.ArrayType(T.StringType())),
    T.StructField("language", T.StringType()),
    T.StructField("scam_type", T.StringType()),
    T.StructField("lure", T.StringType()),
    T.StructField("campaign_id", T.StringType()),
    T.StructField("observed_at", T.DateType()),
    T.StructField("source", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("notes", T.StringType()),
])

CERTIFICATES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name_value", T.StringType()),
    T.StructField("issuer_name", T.StringType()),
    T.StructField("common_name", T.StringType()),
    T.StructField("entry_timestamp", T.StringType()),
    T.StructField("not_before", T.StringType()),
    T.StructField("not_after", T.StringType()),
])
