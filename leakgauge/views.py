"""DNS views over the given event and page tables.

Every event is one query: the client comes from the user, the name from a page address, the capture from the
kind of event. ``label`` marks errors; ``host_label`` marks hosts with a hyphen and is used where a class must
belong to whole hosts.
"""

from pyspark.sql import functions as F

from leakgauge.contract import GROUP_KEYS
from leakgauge.plans.cleaning import derive_features, parse_lenient
from leakgauge.plans.ordered import layout_if_small
from leakgauge.sources.csv import canonical

CLIENT = "concat('10.', (user_id div 65536) % 256, '.', (user_id div 256) % 256, '.', user_id % 256)"


def read_table(spark, sf_dir, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """Rows of a scan with fewer splits than cores (a small file) dealt out, since parsing costs more than moving them;
    a large table has more splits than cores and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_queries(spark, sf_dir):
    """Query rows as text, the way a log would hold them."""
    return typed_queries(spark, sf_dir).drop("epoch_us")


def typed_queries(spark, sf_dir):
    """The same rows with the exact time that the event table brings."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    events = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    size = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    return events.withColumn("page_id", F.col("event_id") % size).join(pages, "page_id").select(
        F.col("event_id").alias("row_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.expr(CLIENT).alias("src_ip"),
        F.lit("8.8.8.8").alias("dst_ip"),
        F.col("url").alias("requested_server_name"),
        F.when(F.col("event_type") == "error", "1").otherwise("0").alias("label"),
        F.col("event_type").alias("capture_id"),
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("epoch_us"),
    )


def scored(spark, sf_dir, threshold=0.5):
    """Parsed query rows with a score between 0 and 1 (many ties) and a prediction."""
    raw = typed_queries(spark, sf_dir)
    rows = canonical(raw, extra=["value", "epoch_us"]).withColumn("score", F.col("value") / (F.col("value") + 50))
    return parse_lenient(rows).withColumns({
        "host_label": F.contains("requested_server_name", F.lit("-")).cast("int"),
        "prediction": (F.col("score") >= threshold).cast("int"),
    })


def dns(spark, sf_dir):
    """Parsed query rows."""
    return scored(spark, sf_dir).drop("value", "score", "prediction")


# What features are made from; window jobs carry every column of a row through a sort.
NARROW = (
    "row_id", "capture_id", "src_ip", "apex_domain", "subdomain", "epoch_us", "requested_server_name", "label",
    "host_label", "label_count", "longest_label_length", "subdomain_length",
)


def features(spark, sf_dir, window_seconds=21600, **options):
    client = F.expr(CLIENT) if "src_ip" in options.get("keys", GROUP_KEYS) else None
    options.setdefault("layout", layout_if_small(read_table(spark, sf_dir, "events"), part=client))
    return derive_features(dns(spark, sf_dir).select(*NARROW), window_seconds=window_seconds, **options)


def host_features(spark, sf_dir, window_seconds=21600):
    """Features with the host in the role of the domain and the host label in the role of the class."""
    return features(spark, sf_dir, window_seconds).withColumns({
        "apex_domain": F.col("requested_server_name"),
        "label": F.col("host_label"),
        "entropy": F.round("entropy", 9),
    })


def logged_features(spark, sf_dir, window_seconds=21600):
    """Features as they come out of the text of the log: times parsed from it, its own apex domains and labels, nothing rounded."""
    layout = layout_if_small(read_table(spark, sf_dir, "events"), part=F.expr(CLIENT))
    parsed = parse_lenient(canonical(raw_queries(spark, sf_dir)))
    return derive_features(parsed.select(*(c for c in NARROW if c != "host_label")), window_seconds=window_seconds, layout=layout)
