"""Decoded packets to query events, with a count for every reason a packet is left out."""

from pyspark.sql import functions as F

from leakgauge.functions.domain import fqdn_problem, normalize_domain, with_domain_parts
from leakgauge.functions.net import is_valid_ip
from leakgauge.operators.dedup import keep_first

PREFIX_REACHED = "packet_limit_reached"
REASONS = ("non_query_packets", "unsupported_transport", "unsupported_question_or_network", "invalid_records")
COUNTERS = ("packets", "dns_query_packets", *REASONS, "duplicate_events", "accepted_queries")
EVENT_KEY = ("epoch_us", "src_ip", "dst_ip", "requested_server_name", "query_type")


def with_packet_reason(packets):
    """Why a packet is no usable query: null for usable ones. The first failing rule counts."""
    name = normalize_domain(F.col("qname"))
    known = F.coalesce(F.col("qr") == 0, F.lit(False)) & F.coalesce("is_dns", F.lit(False))
    usable_network = F.coalesce(F.col("ip_version").isin(4, 6) & (F.col("qdcount") == 1), F.lit(False))
    ascii_name = F.coalesce(F.col("qname").rlike(r"^[\x00-\x7F]*\z"), F.lit(False))
    valid = ascii_name & F.col("ts").isNotNull() & is_valid_ip(F.col("src_ip")) & is_valid_ip(F.col("dst_ip"))
    return packets.withColumn("requested_server_name", name).withColumn(
        "reason",
        F.when(~known, "non_query_packets")
        .when(F.lower(F.coalesce("transport", F.lit(""))) != "udp", "unsupported_transport")
        .when(~usable_network, "unsupported_question_or_network")
        .when(~valid | fqdn_problem(F.col("requested_server_name")).isNotNull(), "invalid_records"),
    )


def packet_prefix(packets, max_packets=None):
    if max_packets is None:
        return packets
    if max_packets < 1:
        raise ValueError("max_packets must be positive")
    return packets.where(F.col("packet_number") <= max_packets)


def packet_events(packets, source, label=0, max_packets=None):
    """Valid queries, one per (time, client, resolver, name, type): the first packet of each."""
    usable = with_packet_reason(packet_prefix(packets, max_packets)).where("reason IS NULL")
    events = usable.select(
        F.col("packet_number").alias("row_id"),
        F.unix_micros("ts").alias("epoch_us"),
        "src_ip", "dst_ip", "requested_server_name",
        F.col("qtype").cast("string").alias("query_type"),
        F.lit(label).alias("label"),
        F.lit(source).alias("source"),
    )
    return with_domain_parts(keep_first(events, EVENT_KEY))


def packet_counts(packets, max_packets=None):
    """One row per counter, in the shape (counter, packets)."""
    flagged = with_packet_reason(packet_prefix(packets, max_packets)).select(
        F.coalesce("reason", F.lit("usable")).alias("reason"),
        F.when(F.col("reason").isNull(), F.struct(
            F.unix_micros("ts"), "src_ip", "dst_ip", "requested_server_name", "qtype"
        )).alias("event"),
    )
    # Copies collapse before they are counted, so a much repeated event is no hot group.
    per_reason = (
        flagged.groupBy("reason", "event").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("reason").agg(F.sum("n").alias("n"), F.count("event").alias("events"))
    )
    summary = per_reason.agg(
        F.sum("n").alias("packets"),
        F.coalesce(F.sum(F.when(F.col("reason") != "non_query_packets", F.col("n"))), F.lit(0)).alias("dns_query_packets"),
        *(
            F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(r)
            for r in REASONS
        ),
        F.coalesce(F.sum(F.when(F.col("reason") == "usable", F.col("n") - F.col("events"))), F.lit(0)).alias("duplicate_events"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("accepted_queries"),
    )
    if max_packets is not None:
        more = packets.agg((F.max("packet_number") > max_packets).cast("bigint").alias("more")).scalar()
        summary = summary.withColumn(PREFIX_REACHED, F.coalesce(more, F.lit(0)))
    return summary.unpivot([], summary.columns, "counter", "packets")


def import_table(events):
    """The published seven columns; the time is printed as epoch seconds with six decimals."""
    return events.select(
        (F.col("epoch_us").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)").cast("string").alias("timestamp"),
        "src_ip", "dst_ip", "requested_server_name", "query_type", "label", "source",
    )


def import_summary(events, counts=None):
    """Rows, domains and time span of the imported events, with the packet counters of the import if given."""
    summary = events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("apex_domain").alias("distinct_apex_domains"),
        ((F.max("epoch_us") - F.min("epoch_us")) / 1e6).alias("time_span_seconds"),
    )
    if counts is None:
        return summary
    wide = counts.groupBy().pivot("counter", list(COUNTERS)).agg(F.first("packets"))
    return summary.crossJoin(wide)  # one row by one row


__all__ = [
    "EVENT_KEY", "import_summary", "import_table", "packet_counts", "packet_events", "packet_prefix",
    "with_packet_reason",
]
