import ipaddress
import math
import random
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from leakgauge.contract import LeakageError, check_model_inputs
from leakgauge.functions import clock, domain, lexical, net, verdict


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {
        "ExAmPLe.CoM": "example.com",
        "sub.domain.org...": "sub.domain.org",
        '"test.com"': "test.com",
        "https://sub.example.com/api/v1?token=123": "sub.example.com",
        "sub.example.com:53": "sub.example.com",
        "  'a.b.c'  ": "a.b.c",
        "\u00a0\x1fx.y\u2003": "x.y",
        "..lead.com": "lead.com",
        "a.com#frag?x/y": "a.com",
        "a.com /path": "a.com",
        "ftp+x://h.org:8080": "h.org",
        "1http://h.org": "1http:",
        "": "",
        "   ": "",
        "...": "",
        None: "",
    }
    assert column(spark, list(cases), domain.normalize_domain) == list(cases.values())


def test_fqdn_problems(spark):
    cases = {
        "sub.example.com": None,
        "8.8.8.8.in-addr.arpa": None,
        "_dmarc.a_b.com": None,
        "": "empty_name",
        "localhost": "single_label",
        "sub..example.com": "empty_label@1",
        "a" * 64 + ".com": "label_too_long@0",
        "-sub.example.com": "hyphen_at_edge@0",
        "sub-.example.com": "hyphen_at_edge@0",
        "ok.b!d.-x.com": "bad_characters@1",
        "abc." * 65 + "com": "name_too_long",
        "a" * 63 + ".com": None,
        "exämple.com": "bad_characters@0",
    }
    assert column(spark, list(cases), domain.fqdn_problem) == list(cases.values())


def test_decompose(spark):
    cases = {
        "s.wphamt5t5bjr6k2pwa32h2u4.data-relay.info":
            (4, "info", "data-relay.info", "s.wphamt5t5bjr6k2pwa32h2u4", 26, "wphamt5t5bjr6k2pwa32h2u4", 24),
        "portal.acme.co.uk": (4, "co.uk", "acme.co.uk", "portal", 6, "portal", 6),
        "8.8.8.8.in-addr.arpa": (6, "in-addr.arpa", "8.in-addr.arpa", "8.8.8", 5, "in-addr", 7),
        "co.uk": (2, "uk", "co.uk", "", 0, "co", 2),
        "acme.co.uk": (3, "co.uk", "acme.co.uk", "", 0, "acme", 4),
        "ip-1.us-east-1.compute.internal":
            (4, "us-east-1.compute.internal", "ip-1.us-east-1.compute.internal", "", 0, "us-east-1", 9),
        "us-east-1.compute.internal": (3, "compute.internal", "us-east-1.compute.internal", "", 0, "us-east-1", 9),
        "host": (1, "host", "host", "", 0, "host", 4),
        "ab.cd.e": (3, "e", "cd.e", "ab", 2, "ab", 2),
        "": (0, "", "", "", 0, "", 0),
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, requested_server_name string")
    got = domain.with_domain_parts(df).orderBy("i").select(
        "label_count", "tld", "apex_domain", "subdomain", "subdomain_length", "longest_label", "longest_label_length"
    )
    assert [tuple(r) for r in got.collect()] == list(cases.values())


def test_label_array_and_flatten(spark):
    df = spark.createDataFrame([("a.b.c",), ("",)], "d string").withColumn("labels", domain.label_array(F.col("d")))
    assert [r.labels for r in df.collect()] == [["a", "b", "c"], []]
    flat = domain.flatten_labels(df)
    assert flat.columns == ["d", "labels_joined"]
    assert [r.labels_joined for r in flat.collect()] == ["a.b.c", ""]


def test_base_domain_and_scorable_hosts(spark):
    assert column(spark, ["x.acme.co.uk", "a.b", "a"], domain.base_domain) == ["co.uk", "a.b", "a"]
    hosts = ["a.com", "localhost", "printer.local", "10.0.0.1", "fe80::1.x", "nodot", "", None]
    assert column(spark, hosts, domain.is_scorable_host) == [True] + [False] * 7


def python_time(text):
    """Independent expectation built on the standard library."""
    text = text.strip()
    try:
        number = float(text)
        return datetime.fromtimestamp(number / 1000 if number > 1e11 else number, tz=timezone.utc)
    except ValueError:
        pass
    except OverflowError:
        return None
    for shape in ("%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S"):
        for tail in (".%f", ""):
            try:
                return datetime.strptime(text.replace("Z", "").replace("T", " "), shape + tail).replace(tzinfo=timezone.utc)
            except ValueError:
                continue
    try:
        parsed = datetime.fromisoformat(text)
    except ValueError:
        return None
    return parsed.replace(tzinfo=timezone.utc) if parsed.tzinfo is None else parsed.astimezone(timezone.utc)


def test_timestamps(spark):
    texts = [
        "2025-06-13 09:31:25.564", "2025-06-13T09:31:25.123Z", "1750000000.5", "1750000000500", "20250613",
        "2025/06/13 09:31:25", "13-06-2025 09:31:25.5", "2025-6-3 9:1:2", "2025-06", "2025-06-13",
        "2025-06-13T09:31", "2025-06-13T09", "2025-06-13 09:31:25+02:00", "2025-06-13T09:31:25.5-0530",
        "20250613T093125", "20250613T0931", "2025-06-13T09:3125", "2025-06-13 09:31:25.1234567", "2025-13-01 00:00:00",
        "2025-02-30 00:00:00", "2025-06-13 24:00:00", "2025-06-13 23:59:60", "1e3", "-1.5", "1_000", "nan", "inf",
        "1d", "0x10", "not a time", "", "  2025-06-13   09:31:25  ", "99999999999999", "1e300", "2025-06-13T09:31Z",
        "1700000000.0000005", "1700000000.123456789", "2025/06-13 01:02:03", "2025-06-13 09:31:25,5",
    ]
    rng = random.Random(5)
    texts += [f"{rng.uniform(0, 4e9):.{rng.randrange(9)}f}" for _ in range(100)]
    texts += [datetime.fromtimestamp(rng.uniform(0, 4e9), tz=timezone.utc).isoformat() for _ in range(50)]
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    expected = []
    for text in texts:
        moment = python_time(text)
        expected.append(None if moment is None else (moment - epoch) // (moment - moment).__class__(microseconds=1))
    got = column(spark, texts, clock.parse_epoch_micros)
    assert {t: g for t, g in zip(texts, got)} == {t: e for t, e in zip(texts, expected)}


def test_standard_text_truncates(spark):
    df = spark.createDataFrame([(1749807085564999,)], "us bigint")
    assert df.select(clock.standard_text(F.col("us"))).first()[0] == "2025-06-13 09:31:25.564"


def test_rebase_keeps_gaps(spark):
    df = spark.createDataFrame([(5_000,), (7_000,), (12_000,)], "epoch_us bigint")
    assert [r.epoch_us for r in clock.rebase(df, 100).orderBy("epoch_us").collect()] == [100, 2_100, 7_100]


def test_ip_addresses_agree_with_the_standard_library(spark):
    texts = [
        "8.8.8.8", " 10.0.0.1 ", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "", "::", "::1", "1::", "fe80::1%eth0",
        "fe80::1%", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1::2::3", "12345::",
        "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.400", ":::", ":1", "1:", "g::",
        "1:2:3:4:5:6::1.2.3.4", "1:2:3:4:5::1.2.3.4", "2001:DB8::A", "1.2.3.4%x",
    ]
    rng = random.Random(2)
    for _ in range(400):
        texts.append("".join(rng.choice(["1", "ab", ":", ":", "::", "f"]) for _ in range(rng.randrange(1, 18))))

    def valid(text):
        try:
            ipaddress.ip_address(text.strip())
            return True
        except ValueError:
            return False

    assert column(spark, texts, net.is_valid_ip) == [valid(t) for t in texts]


def test_lexical_features(spark):
    names = ["12345.example.com", "my-test_domain.example.com", "", "a", "aab.b", "é漢٣.com", "x" * 60 + "²½.io"]

    def entropy(text):
        return sum(-c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())

    df = spark.createDataFrame([(i, v) for i, v in enumerate(names)], "i int, requested_server_name string")
    rows = lexical.with_lexical_features(df).orderBy("i").collect()
    for name, row in zip(names, rows):
        size = len(name) or 1
        assert row.query_length == len(name)
        assert row.entropy == pytest.approx(entropy(name), abs=1e-12)
        assert row.digit_ratio == pytest.approx(sum(c in "0123456789" for c in name) / size)
        assert row.special_char_ratio == pytest.approx(sum(not c.isalnum() for c in name) / size)
        assert row.number_of_labels == (len(name.split(".")) if name else 0)
        assert row.longest_label_length == max(map(len, name.split(".")))
    assert rows[0].digit_ratio == pytest.approx(5 / 17)
    assert rows[1].special_char_ratio == pytest.approx(4 / 26)


def test_tiers(spark):
    df = spark.createDataFrame([(v,) for v in (.10, .499, .50, .85, .889, .89, .99)], "s double")
    got = [r[0] for r in df.select(verdict.risk_tier(F.col("s"), 0.89)).collect()]
    assert got == ["LOW"] * 2 + ["ELEVATED"] * 3 + ["CRITICAL"] * 2


def test_indicators_and_reasons(spark):
    df = spark.createDataFrame([(60, 4.5, 1, 1), (10, 1.0, 50, 1)], "query_length int, entropy double, query_frequency int, unique_subdomains int")
    df = df.withColumn("rule_indicators", verdict.rule_indicators())
    first, second = df.withColumn("why", verdict.indicator_reasons()).collect()
    assert tuple(first.rule_indicators) == (True, True, False, False, 2, True)
    assert first.why == ["high entropy", "long query"]
    assert tuple(second.rule_indicators) == (False, False, True, False, 1, False)
    assert second.why == ["query burst"]
    bare = spark.range(1).withColumn("rule_indicators", verdict.rule_indicators(columns=["id"]))
    assert tuple(bare.first().rule_indicators) == (False, False, False, False, 0, False)


def test_rule_votes(spark):
    rule = {"query_length": 40, "entropy": 4.0, "query_frequency": 5, "unique_subdomains": 5}
    df = spark.createDataFrame([(45, 4.2, 1, 1), (45, 3.0, 1, 1)], "query_length int, entropy double, query_frequency int, unique_subdomains int")
    assert [r[0] for r in df.select(verdict.rule_prediction(rule, 2)).collect()] == [1, 0]
    for votes in (0, 5):
        with pytest.raises(ValueError):
            verdict.rule_prediction(rule, votes)


def test_alert_ids_are_stable(spark):
    df = spark.createDataFrame([("c", 1), ("c", 2), ("c", 1)], "c string, i int")
    a, b, again = [r[0] for r in df.select(verdict.alert_id(F.col("c"), F.col("i"))).collect()]
    assert a == again != b and a.startswith("alt_") and len(a) == 4 + 64


def test_forbidden_inputs():
    check_model_inputs(["entropy"])
    with pytest.raises(LeakageError):
        check_model_inputs(["entropy", " Src_IP "])
