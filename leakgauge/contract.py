"""Names, fixed values and schemas shared by every part of the library."""

from pyspark.sql import types as T

# Header spellings accepted on input and the column they stand for.
HEADER_ALIASES = {
    "src_ip": "src_ip",
    "source_ip": "src_ip",
    "dst_ip": "dst_ip",
    "destination_ip": "dst_ip",
    "requested_server_name": "requested_server_name",
    "domain": "requested_server_name",
    "query": "requested_server_name",
    "timestamp": "timestamp",
    "start_time": "timestamp",
    "query_type": "query_type",
    "label": "label",
    "source": "source",
}

# Public suffixes of more than one label.
TWO_LABEL_SUFFIXES = (
    "in-addr.arpa", "ip6.arpa", "compute.internal", "ec2.internal",
    "co.uk", "org.uk", "gov.uk", "ac.uk",
    "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "com.au", "net.au", "org.au", "edu.au",
    "co.jp", "ne.jp", "ac.jp",
    "com.br", "org.br", "net.br",
    "com.cn", "net.cn", "org.cn",
    "co.nz", "net.nz", "org.nz",
    "com.sg", "edu.sg",
)
THREE_LABEL_SUFFIXES = (
    "sa-east-1.compute.internal", "us-east-1.compute.internal", "us-west-2.compute.internal",
)

# Columns that may never be model inputs.
FORBIDDEN_INPUTS = frozenset((
    "src_ip", "source_ip", "dst_ip", "destination_ip", "timestamp", "raw_timestamp",
    "start_time", "end_time", "epoch_time", "requested_server_name", "domain", "query", "source",
))

# Column orders of the published tables.
DATASET_COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "requested_server_name", "dns_query_length",
    "dns_query_entropy", "dns_subdomain_count", "dns_numerical_ratio", "label", "source",
)
CLEANED_COLUMNS = (
    "timestamp", "epoch_time", "src_ip", "dst_ip", "requested_server_name", "apex_domain",
    "subdomain", "tld", "label_count", "longest_label", "longest_label_length",
    "subdomain_length", "query_type", "label", "source",
)
LEXICAL_FEATURES = (
    "query_length", "longest_label_length", "number_of_labels", "entropy",
    "digit_ratio", "special_char_ratio", "subdomain_length",
)
WINDOW_FEATURES = ("query_frequency", "unique_subdomains", "time_interval")
MODEL_FEATURES = LEXICAL_FEATURES + WINDOW_FEATURES
RULE_FEATURES = ("query_length", "entropy", "query_frequency", "unique_subdomains")

# Thresholds of the frozen voting rule, and what each flag is called in a report.
FROZEN_RULE = {
    "query_length": 52.0,
    "entropy": 4.309101,
    "query_frequency": 41.0,
    "unique_subdomains": 41.0,
}
FROZEN_VOTES = 2
REASON_TEXT = {
    "entropy": "high entropy",
    "query_length": "long query",
    "query_frequency": "query burst",
    "unique_subdomains": "many unique subdomains",
}
# A count of one is only the current query, so these features start at two.
THRESHOLD_FLOORS = {"query_frequency": 2.0, "unique_subdomains": 2.0}
CANDIDATE_QUANTILES = (0.0, 0.10, 0.25, 0.50, 0.75, 0.90, 1.0)

WINDOW_SECONDS = 60.0
FIRST_INTERVAL = -1.0
GROUP_KEYS = ("src_ip", "apex_domain")
FAST_GAP_SECONDS = 0.05
SWEEP_GAPS_MS = (1, 5, 10, 20, 35, 50, 100, 250, 1000)
RETIME_ORIGIN_US = 1_700_000_000 * 1_000_000
SCORE_THRESHOLDS = tuple(round(0.5 + i / 100, 3) for i in range(50)) + (0.995, 0.999)

UPLOAD_DEFAULTS = {"src_ip": "127.0.0.1", "dst_ip": "8.8.8.8", "query_type": "A", "source": "CSV Upload"}

QUERY_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("timestamp", "src_ip", "dst_ip", "requested_server_name", "query_type", "source", "capture_id")
])
BATCH_SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField("queries", T.ArrayType(QUERY_SCHEMA)),
])
SENSOR_SCHEMA = T.StructType([
    T.StructField("batch_seq", T.LongType()),
    T.StructField("capture_id", T.StringType()),
    T.StructField("queries", T.ArrayType(QUERY_SCHEMA)),
])
PACKET_SCHEMA = T.StructType([
    T.StructField("packet_number", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("is_dns", T.BooleanType()),
    T.StructField("qr", T.IntegerType()),
    T.StructField("transport", T.StringType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("qdcount", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("qname", T.StringType()),
    T.StructField("qtype", T.IntegerType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("input_row_id", T.LongType()),
    T.StructField("apex_domain", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("attack_probability", T.DoubleType()),
])


class LeakageError(ValueError):
    """A forbidden column was offered as a model input."""


class DataError(ValueError):
    """The input breaks a rule that the calling job may not ignore."""


def check_model_inputs(names):
    """Raise if any of the names, trimmed and lower-cased, may not be a model input."""
    found = sorted({n.strip().lower() for n in names} & FORBIDDEN_INPUTS)
    if found:
        raise LeakageError(f"not allowed as model inputs: {', '.join(found)}")


check_model_inputs(MODEL_FEATURES)
