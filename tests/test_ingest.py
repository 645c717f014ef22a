import gzip
import json

import pytest
from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.operators import dedup, links, metrics, quality, validate
from leakgauge.plans import cleaning
from leakgauge.sources import captures, csv, packets, sinks
from leakgauge.sources import json as batches

HEAD = "timestamp,src_ip,dst_ip,requested_server_name,label\n"


def raw(spark, tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return csv.read_raw(spark, str(path))


def test_aliases_defaults_and_row_numbers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(" Start_Time ,source_ip,Destination_IP,Query,domain\n1, 10.0.0.1 ,8.8.8.8,first.com, second.com \n2,10.0.0.2,8.8.8.8,,\n")
    rows = csv.read_raw(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, r.timestamp, r.src_ip, r.requested_server_name, r.query_type, r.source, r.label) for r in rows] == [
        (1, "1", "10.0.0.1", "second.com", "A", "Unknown", 0), (2, "2", "10.0.0.2", "", "A", "Unknown", 0),
    ]
    limited = csv.read_raw(spark, str(path), max_rows=1)
    assert [r.row_id for r in limited.collect()] == [1]


def test_row_numbers_follow_the_file_across_blocks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text(HEAD + "".join(f"{i},10.0.0.1,8.8.8.8,n{i}.com,0\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = csv.read_raw(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert df.where(F.col("timestamp").cast("bigint") != F.col("row_id")).count() == 0
        assert df.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strict_load(spark, tmp_path):
    good = HEAD + "10,10.0.0.1,8.8.8.8,Q.Example.COM.,1\n10,10.0.0.1,8.8.8.8,q.example.com,1\n11,10.0.0.1,8.8.8.8,w.example.com,0\n"
    table = raw(spark, tmp_path, good)
    kept = cleaning.load_strict(table)
    assert [r.row_id for r in kept.orderBy("row_id").collect()] == [1, 3]
    assert [r.row_id for r in dedup.removed_ids(table, kept).collect()] == [2]
    for body, message in (
        ("10,10.0.0.1,8.8.8.8,q.example.com,0\n10,10.0.0.1,8.8.8.8,q.example.com,1\n", "two labels"),
        ("10,10.0.0.1,8.8.8.8,q.example.com,0.5\n", "row 1: bad_label"),
        ("10,10.0.0.1,8.8.8.8,q.example.com,1\nx,10.0.0.1,8.8.8.8,q.example.com,1\n", "row 2: bad_timestamp"),
        ("", "no rows"),
    ):
        with pytest.raises(DataError, match=message):
            cleaning.load_strict(raw(spark, tmp_path, HEAD + body, f"{abs(hash(body))}.csv"))


def test_report_counts_duplicates_across_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,10.0.0.1,8.8.8.8,A.com,0\n2,bad,8.8.8.8,b.com,0\n")
    (tmp_path / "b.csv").write_text(HEAD + "1,10.0.0.1,8.8.8.8,a.com,0\n3,10.0.0.1,8.8.8.8,c.com,1\n")
    table = csv.read_raw(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    report = validate.validation_report(validate.with_problem(table)).first()
    assert tuple(report) == (4, 2, 1, 1, 1, 1, False)
    cleaned = cleaning.clean(table)
    assert {(r.file_ord, r.row_id) for r in cleaned.collect()} == {(0, 1), (1, 2)}
    assert [r.requested_server_name for r in cleaning.chronological(cleaned).collect()] == ["a.com", "c.com"]


def test_copies_in_a_hot_group_collapse(spark):
    df = spark.range(3000).select(
        (F.col("id") + 1).alias("row_id"), F.lit(0).alias("file_ord"), F.lit("1").alias("timestamp"), F.lit("10.0.0.1").alias("src_ip"),
        F.lit("8.8.8.8").alias("dst_ip"), F.when(F.col("id") % 3 == 0, "hot.com").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".com"))).alias("requested_server_name"),
        F.lit(0).alias("label"),
    )
    kept = dedup.drop_repeated_rows(df)
    assert kept.count() == 2001 and kept.where("requested_server_name = 'hot.com'").first()["row_id"] == 1


def test_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("timestamp,src_ip,query\n,10.0.1.5,first.com\n2026-10-12 14:00:00.123456, ,second.com\n,10.0.1.5,third.com\nnever,10.0.1.5,fourth.com\n")
    filled = validate.with_timestamp_fallback(csv.read_upload(spark, str(path), "cap"), 1_000_000)
    rows = filled.orderBy("row_id").collect()
    assert [r.ts_fallback for r in rows] == ["ingestion_time", None, "previous_row", None]
    assert rows[2].epoch_us == 1791813600123000 and rows[0].epoch_us == 1_000_000
    assert [r.problem for r in rows] == [None, None, None, "bad_timestamp"]
    assert (rows[1].src_ip, rows[1].dst_ip, rows[1].source) == ("127.0.0.1", "8.8.8.8", "CSV Upload")
    with pytest.raises(DataError):
        csv.upload_columns(spark.createDataFrame([("1",)], "timestamp string"))


def test_json_batches_and_reports(spark, tmp_path):
    q = {"timestamp": "1", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "requested_server_name": "a.com"}
    (tmp_path / "b.json").write_text(json.dumps({"capture_id": "c", "queries": [q, {**q, "capture_id": "own"}]}, indent=1))
    rows = batches.read_batches(spark, str(tmp_path / "b.json")).orderBy("seq").collect()
    assert [(r.seq, r.capture_id, r.alert_capture_id, r.query_type) for r in rows] == [(0, "c", "c", "A"), (1, "c", "own", "A")]
    (tmp_path / "r.json").write_text('{\n"decision_threshold": 0.9\n}')
    report = batches.read_report(spark, str(tmp_path / "r.json"), {"decision_threshold": 0.5, "evaluation_records": 7}).first()
    assert (report.decision_threshold, report.evaluation_records) == (0.9, 7)


def test_packets(spark):
    rows = [
        (1, 10, True, 0, "UDP", 4, 1, "a.com."), (2, 11, True, 0, "udp", 6, 1, "b.com"), (3, 12, True, 1, "udp", 4, 1, "a.com"),
        (4, 13, True, 0, "tcp", 4, 1, "a.com"), (5, 10, True, 0, "udp", 4, 1, "A.com"), (6, 14, None, None, None, None, None, None),
        (7, 15, True, 0, "udp", 4, 2, "a.com"), (8, 16, True, 0, "udp", 4, 1, "ä.com"),
    ]
    df = spark.createDataFrame(rows, "packet_number bigint, s int, is_dns boolean, qr int, transport string, ip_version int, qdcount int, qname string")
    df = df.select("*", F.timestamp_seconds("s").alias("ts"), F.lit("10.0.0.1").alias("src_ip"), F.lit("::1").alias("dst_ip"), F.lit(1).alias("qtype")).drop("s")
    counts = {r.counter: r.packets for r in packets.packet_counts(df).collect()}
    assert counts == {
        "packets": 8, "dns_query_packets": 6, "non_query_packets": 2, "unsupported_transport": 1,
        "unsupported_question_or_network": 1, "invalid_records": 1, "duplicate_events": 1, "accepted_queries": 2,
    }
    assert [r.row_id for r in packets.packet_events(df, "x").orderBy("row_id").collect()] == [1, 2]
    assert {r.counter: r.packets for r in packets.packet_counts(df, 2).collect()}["packet_limit_reached"] == 1
    with pytest.raises(ValueError):
        packets.packet_prefix(df, 0)


def test_captures_must_match_their_provenance(spark, tmp_path):
    path = str(tmp_path / "c.csv.gz")
    with gzip.open(path, "wt") as out:
        out.write(HEAD + "1,10.0.0.1,8.8.8.8,a.com,0\n")
    found = metrics.fingerprint(csv.read_raw(spark, path).drop("file_ord")).first()
    columns = "path string, rows bigint, fingerprint string, capture_key string"
    assert captures.read_capture(spark, path, spark.createDataFrame([(path, found["rows"], found["fingerprint"], "k")], columns)).count() == 1
    with pytest.raises(DataError, match="recorded content"):
        captures.read_capture(spark, path, spark.createDataFrame([(path, 1, "0", "k")], columns))
    twice = spark.createDataFrame([("a", 1, "0", "k"), ("b", 1, "0", "k")], columns)
    with pytest.raises(DataError, match="more than once"):
        captures.require_distinct_captures(twice)


def test_sinks(spark, tmp_path):
    table = cleaning.clean(raw(spark, tmp_path, HEAD + "1750000000.1185,10.0.0.1,8.8.8.8,x.acme.co.uk,1\n"))
    sinks.write_cleaned_csv(table, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert back.epoch_time == f"{1750000000.1185:.3f}" and back.apex_domain == "acme.co.uk"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_cleaned_csv(table, str(tmp_path / "out"))
    sinks.write_cleaned(table, str(tmp_path / "store"))
    assert (tmp_path / "store" / "event_date=2025-06-15").exists()
    sinks.write_report(spark.createDataFrame([(2.0, None)], "b double, a string"), str(tmp_path / "rep"))
    line = next((tmp_path / "rep").glob("*.json")).read_text().strip()
    assert line == '{"a":null,"b":2.0}'
    with pytest.raises(DataError):
        sinks.write_report(spark.createDataFrame([(float("nan"),)], "b double"), str(tmp_path / "rep2"))


def test_printed_epoch_rounds_like_the_double(spark):
    from leakgauge.functions.clock import printed_seconds

    values = [1704103775118500 + 1000 * i for i in range(300)] + [1704103775999500, 1704103775062500, 1_100_000_000_000_001]
    df = spark.createDataFrame([(v,) for v in values], "us bigint")
    assert [r[0] for r in df.select(printed_seconds(F.col("us"))).collect()] == [f"{v / 1e6:.3f}" for v in values]


def test_linked_tables_are_checked(spark):
    rows = spark.createDataFrame([(1, "a.com", 0), (2, "a.com", 1), (3, "b.com", 0)], "row_id bigint, apex_domain string, label int")
    saved = spark.createDataFrame([(1, 0), (2, 1)], "row_id bigint, prediction int")
    assert links.join_predictions(saved, rows).count() == 2
    with pytest.raises(DataError, match="more than one"):
        links.join_predictions(saved.unionAll(saved), rows)
    with pytest.raises(DataError, match="no source row"):
        links.join_predictions(spark.createDataFrame([(9, 0)], saved.schema), rows)
    with pytest.raises(DataError, match="differ"):
        links.require_same_rows(rows, rows.where("row_id < 3"))
    with pytest.raises(DataError, match="several parts"):
        links.require_disjoint(rows.withColumn("split", F.col("row_id") % 2))
    with pytest.raises(DataError, match="labels other"):
        quality.require_single_class(rows, 0)


def test_dataset_contracts(spark):
    from leakgauge.contract import DATASET_COLUMNS
    from leakgauge.functions.lexical import dataset_features

    rows = [(f"2025-06-13 10:00:0{i}.000", f"10.0.0.{i}", f"8.8.8.{i}", f"x{i}.d{i}.net") for i in range(4)]
    df = spark.createDataFrame(rows, "timestamp string, src_ip string, dst_ip string, requested_server_name string")
    df = df.withColumns(dataset_features(F.col("requested_server_name"))).withColumns({"label": F.lit(1), "source": F.lit("s")}).select(*DATASET_COLUMNS)
    bounds = (1749800000_000000, 1749900000_000000)
    assert quality.attack_contract(df, *bounds).first()["passed"]
    assert not quality.attack_contract(df, 0, 1).first()["passed"]
    assert not quality.attack_contract(df.unionAll(df.limit(1)), *bounds).first()["passed"]
    assert not quality.benign_contract(df).first()["passed"]
    assert quality.benign_contract(df.withColumn("label", F.lit(0)), rows=4).first()["passed"]
