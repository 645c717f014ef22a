"""The same questions in plain SQL, written for another engine and without the library's methods.

Window counts use a RANGE frame over (time, tie number) instead of a sweep, rank statistics use
ROW_NUMBER instead of value counts, and so on, so that agreement means something.
"""

from leakgauge.contract import MODEL_FEATURES, THREE_LABEL_SUFFIXES, TWO_LABEL_SUFFIXES

TIES = 4096


def _list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _parts(name="name"):
    """Domain parts of a normalised name as select items; ``labels`` must be in scope."""
    return f"""
      CASE WHEN {name} = '' THEN 0 ELSE len(labels) END AS label_count,
      CASE WHEN len(labels) >= 4 AND array_to_string(labels[-3:], '.') IN {_list(THREE_LABEL_SUFFIXES)} THEN 3
           WHEN len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN {_list(TWO_LABEL_SUFFIXES)} THEN 2
           ELSE 1 END AS suffix_size"""


DNS = f"""
raw AS (
  SELECT e.event_id AS row_id, e.ts, epoch_us(e.ts) AS epoch_us,
    '10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS src_ip,
    '8.8.8.8' AS dst_ip, p.url, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    event_type AS capture_id, value, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
),
split_names AS (SELECT *, lower(host) AS name, string_split(lower(host), '.') AS labels FROM raw),
sized AS (SELECT *, {_parts()} FROM split_names),
dns AS (
  SELECT *, array_to_string(labels[-(suffix_size + 1):], '.') AS apex_domain,
    array_to_string(labels[:-(suffix_size + 2)], '.') AS subdomain,
    CASE WHEN contains(name, '-') THEN 1 ELSE 0 END AS host_label,
    value / (value + 50) AS score
  FROM sized
)"""


def _shares(text):
    return f"""list_transform(list_distinct(string_split({text}, '')),
      lambda c: (length({text}) - length(replace({text}, c, ''))) / length({text})::DOUBLE)"""


def _entropy(text):
    return f"coalesce(list_sum(list_transform({_shares(text)}, lambda p: -p * log2(p))), 0.0)"


def lexical(source="dns", name="name"):
    return f"""
lex AS (
  SELECT *, length({name})::INTEGER AS query_length,
    list_max(list_transform(labels, lambda l: length(l)))::INTEGER AS longest_label_length,
    label_count::INTEGER AS number_of_labels, {_entropy(name)} AS entropy,
    length(regexp_replace({name}, '[^0-9]', '', 'g')) / length({name})::DOUBLE AS digit_ratio,
    length(regexp_replace({name}, '[a-zA-Z0-9]', '', 'g')) / length({name})::DOUBLE AS special_char_ratio,
    length(subdomain)::INTEGER AS subdomain_length
  FROM {source}
)"""


def windows(seconds, keys="src_ip, apex_domain", source="dns", arrival="row_id", name="win"):
    width = int(seconds * 1_000_000) * 2 * TIES + TIES - 1
    return f"""
{name}_tied AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, epoch_us ORDER BY {arrival}) - 1 AS tie FROM {source}
),
{name}_keyed AS (
  SELECT *, (epoch_us - (SELECT min(epoch_us) FROM {source})) * {2 * TIES} + tie AS k FROM {name}_tied
),
{name} AS (
  SELECT *, (count(*) OVER w)::INTEGER AS query_frequency,
    (count(DISTINCT subdomain) OVER w)::INTEGER AS unique_subdomains,
    coalesce(epoch_us / 1e6 - lag(epoch_us) OVER (PARTITION BY {keys} ORDER BY epoch_us, {arrival}) / 1e6, -1.0) AS time_interval
  FROM {name}_keyed
  WINDOW w AS (PARTITION BY {keys} ORDER BY k RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)
)"""


def query(*ctes, select):
    return "WITH " + ",".join(ctes) + "\n" + select


def features(seconds=21600):
    return (DNS, lexical(), windows(seconds, source="lex"))


RATES = """
  coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0.0) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision,
  coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall,
  coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0.0) AS false_positive_rate"""


def rates(source, name="rated"):
    return f"""
{name}_half AS (SELECT *, {RATES} FROM {source}),
{name} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM {name}_half)"""


ROUND_RATES = ", ".join(f"round({c}, 9) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "false_positive_rate"))


def confusion(label="label", prediction="prediction"):
    return f"""
  count(*) FILTER ({label} = 1 AND {prediction} = 1) AS tp, count(*) FILTER ({label} <> 1 AND {prediction} <> 1) AS tn,
  count(*) FILTER ({label} <> 1 AND {prediction} = 1) AS fp, count(*) FILTER ({label} = 1 AND {prediction} <> 1) AS fn"""


def predicted(threshold):
    return f"predicted AS (SELECT *, (score >= {threshold}::DOUBLE)::INTEGER AS prediction FROM dns)"


def flags(q=22.0, e=3.5, f=2.0, u=2.0):
    return (
        f"(query_length >= {q})::INTEGER + (entropy >= {e}::DOUBLE)::INTEGER + "
        f"(query_frequency >= {f})::INTEGER + (unique_subdomains >= {u})::INTEGER"
    )


def kinds(*options, value="text"):
    """A CASE over the row number, mirroring the rewritten inputs."""
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE row_id % {len(options)} {whens} END AS {value}"


HOST = """
hosts AS (SELECT * REPLACE (name AS apex_domain, host_label AS label) FROM dns)"""

HOST_FEATURES = (
    *features(),
    """
hf AS (SELECT * REPLACE (name AS apex_domain, host_label AS label, round(entropy, 9) AS entropy) FROM win)""",
)


def shuffled(source, key="row_id"):
    return f"""
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || {key}), {key}) AS place,
    count(*) OVER (PARTITION BY label) AS total FROM {source}
),
parted AS (
  SELECT *, CASE WHEN place <= floor(total * 0.6::DOUBLE) THEN 'train'
    WHEN place <= floor(total * 0.6::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM shuffled
)"""


def folds(n, source="hosts"):
    return f"""
domain_sizes AS (
  SELECT apex_domain, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack, count(*) AS rows
  FROM {source} GROUP BY ALL
),
ranked_domains AS (
  SELECT *, CASE WHEN attack > benign THEN 1 ELSE 0 END AS majority,
    row_number() OVER (PARTITION BY attack > benign ORDER BY rows DESC, md5('42:' || apex_domain), apex_domain) - 1 AS r
  FROM domain_sizes
),
fold_map AS (
  SELECT apex_domain, benign, attack, rows, majority,
    CASE WHEN (r // {n}) % 2 = 1 THEN {n} - 1 - r % {n} ELSE r % {n} END::INTEGER AS fold
  FROM ranked_domains
)"""


def long_features(names, source, keep):
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS feature, {n}::DOUBLE AS v FROM {source}" for n in names)


RULE_NAMES = ("query_length", "entropy", "query_frequency", "unique_subdomains")

CANDIDATES = f"""
train AS (SELECT * FROM parted WHERE split = 'train'),
long AS ({long_features(RULE_NAMES, 'train', 'label')}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY v) - 1 AS place0,
  count(*) OVER (PARTITION BY label, feature) AS n FROM long),
asked AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS q),
floors AS (SELECT unnest(['query_frequency', 'unique_subdomains']) AS feature),
offered AS (
  SELECT DISTINCT feature, v AS threshold FROM ordered, asked WHERE place0 = round_even((n - 1) * q, 0)::BIGINT
),
reaching AS (SELECT * FROM offered WHERE feature NOT IN (SELECT feature FROM floors) OR threshold >= 2),
cuts AS (SELECT * FROM reaching UNION ALL SELECT feature, 2.0 FROM floors WHERE feature NOT IN (SELECT feature FROM reaching)),
counted AS (
  SELECT c.feature, c.threshold, count(*) FILTER (label = 1 AND v >= threshold) AS tp,
    count(*) FILTER (label = 0 AND v < threshold) AS tn, count(*) FILTER (label = 0 AND v >= threshold) AS fp,
    count(*) FILTER (label = 1 AND v < threshold) AS fn
  FROM cuts c JOIN long l USING (feature) GROUP BY ALL
),
{rates('counted', 'cut_rates')},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, false_positive_rate, recall DESC, threshold)::INTEGER AS place
  FROM cut_rates
),
chosen AS (SELECT * FROM placed WHERE place <= 3)"""

GRID = f"""
grid AS (
  SELECT a.threshold AS t1, b.threshold AS t2, c.threshold AS t3, d.threshold AS t4, v.votes,
    a.place * 10000 + b.place * 1000 + c.place * 100 + d.place * 10 + v.votes AS trial
  FROM chosen a, chosen b, chosen c, chosen d, (SELECT unnest([2, 3, 4]) AS votes) v
  WHERE a.feature = 'query_length' AND b.feature = 'entropy' AND c.feature = 'query_frequency' AND d.feature = 'unique_subdomains'
),
tried AS (
  SELECT trial, t1, t2, t3, t4, votes, label,
    ((query_length >= t1)::INTEGER + (entropy >= t2)::INTEGER + (query_frequency >= t3)::INTEGER
      + (unique_subdomains >= t4)::INTEGER >= votes)::INTEGER AS prediction
  FROM grid, parted WHERE split = 'validation'
),
trials AS (SELECT trial, t1, t2, t3, t4, votes, {confusion()} FROM tried GROUP BY ALL),
{rates('trials', 'trial_rates')},
best AS (SELECT * FROM trial_rates ORDER BY f1 DESC, false_positive_rate, recall DESC, precision DESC, trial LIMIT 1)"""

DIRTY = """
broken AS (
  SELECT row_id * 2 + copy AS row_id, capture_id, copy,
    CASE WHEN row_id % 31 = 0 THEN '' WHEN row_id % 37 = 0 THEN '2025-06' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts_text,
    CASE WHEN row_id % 41 = 0 THEN '' WHEN row_id % 43 = 0 THEN '10.0.0.300' ELSE src_ip END AS src_ip,
    CASE WHEN row_id % 47 = 0 THEN '' WHEN row_id % 53 = 0 THEN 'dns' ELSE dst_ip END AS dst_ip,
    CASE WHEN row_id % 59 = 0 THEN '' WHEN row_id % 61 = 0 THEN 'https://local/x' ELSE url END AS name_text,
    CASE WHEN row_id % 67 = 0 THEN 2 WHEN row_id % 71 = 0 THEN -1 ELSE label END AS label,
    epoch_us, host, apex_domain, subdomain, row_id AS source_row
  FROM dns, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR row_id % 20 = 0
),
judged AS (
  SELECT *, CASE WHEN ts_text = '' THEN 'empty_timestamp' WHEN src_ip = '' THEN 'empty_src_ip' WHEN dst_ip = '' THEN 'empty_dst_ip'
    WHEN name_text = '' THEN 'empty_requested_server_name' WHEN label NOT IN (0, 1) THEN 'bad_label'
    WHEN ts_text = '2025-06' THEN 'bad_timestamp' WHEN src_ip = '10.0.0.300' THEN 'bad_src_ip' WHEN dst_ip = 'dns' THEN 'bad_dst_ip'
    WHEN name_text = 'https://local/x' THEN 'bad_name:single_label' END AS problem
  FROM broken
),
kept AS (SELECT * FROM judged WHERE problem IS NULL
  QUALIFY row_number() OVER (PARTITION BY ts_text, src_ip, dst_ip, lower(name_text), label ORDER BY row_id) = 1)"""

PACKETS = """
pk AS (
  SELECT row_id * 2 + copy + 1 AS packet_number, row_id, epoch_us, src_ip, host, apex_domain,
    CASE WHEN row_id % 29 = 0 OR row_id % 11 = 0 THEN 'non_query_packets' WHEN row_id % 13 = 0 THEN 'unsupported_transport'
      WHEN row_id % 17 = 0 OR row_id % 19 = 0 THEN 'unsupported_question_or_network' WHEN row_id % 23 = 0 THEN 'invalid_records' END AS reason
  FROM dns, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR row_id % 50 = 0
),
ev AS (SELECT min(packet_number) AS row_id, epoch_us, src_ip, host, apex_domain FROM pk WHERE reason IS NULL GROUP BY ALL)"""


def packet_counters(source, extra=""):
    reasons = " ".join(
        f"UNION ALL SELECT '{r}', count(*) FROM {source} WHERE reason = '{r}'"
        for r in ("non_query_packets", "unsupported_transport", "unsupported_question_or_network", "invalid_records")
    )
    event = "(epoch_us, src_ip, host)"
    return f"""SELECT 'packets' AS counter, count(*) AS packets FROM {source}
      UNION ALL SELECT 'dns_query_packets', count(*) FROM {source} WHERE reason IS DISTINCT FROM 'non_query_packets' {reasons}
      UNION ALL SELECT 'duplicate_events', count(*) - count(DISTINCT {event}) FROM {source} WHERE reason IS NULL
      UNION ALL SELECT 'accepted_queries', count(DISTINCT {event}) FROM {source} WHERE reason IS NULL {extra}"""


WINDOW_OUT = "row_id, query_frequency, unique_subdomains, round(time_interval, 6) AS time_interval"
MODEL_OUT = ", ".join(
    f"round({f}, {6 if f == 'time_interval' else 9}) AS {f}" if f in ("entropy", "digit_ratio", "special_char_ratio", "time_interval") else f
    for f in MODEL_FEATURES
)

ORACLES = {}


def _add(name, *ctes, select):
    ORACLES[name] = query(*ctes, select=select)


_add("csv_alias_scan", DNS, select="""SELECT row_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, src_ip, dst_ip,
  url AS requested_server_name, 'A' AS query_type, 'Unknown' AS source, label::INTEGER AS label FROM dns""")
_add("row_limited_scan", DNS, select="SELECT row_id + 1 AS row_id, src_ip FROM dns WHERE row_id < 500")
_add("rule_table_scan", *features(), select="""SELECT row_id, query_length::DOUBLE AS query_length, round(entropy, 9) AS entropy,
  query_frequency::DOUBLE AS query_frequency, unique_subdomains::DOUBLE AS unique_subdomains, label::INTEGER AS label FROM win""")
_add("upload_scan", DNS, select="""SELECT row_id, capture_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
  CASE WHEN row_id % 5 = 0 THEN '127.0.0.1' ELSE src_ip END AS src_ip, CASE WHEN row_id % 7 = 0 THEN '8.8.8.8' ELSE dst_ip END AS dst_ip,
  url AS requested_server_name, 'A' AS query_type, 'CSV Upload' AS source FROM dns""")
_add("json_batch_scan", DNS, select="""SELECT row_id // 1000 AS batch_seq, 'batch_' || (row_id // 1000) AS capture_id, row_id % 1000 AS seq,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, src_ip, dst_ip, url AS requested_server_name, 'A' AS query_type, 't' AS source,
  CASE WHEN row_id % 3 = 0 THEN capture_id ELSE 'batch_' || (row_id // 1000) END AS alert_capture_id FROM dns""")
_add("packet_counters", DNS, PACKETS, select=packet_counters("pk"))
_add("packet_prefix_counters", DNS, PACKETS, "pf AS (SELECT * FROM pk WHERE packet_number <= 700)",
     select=packet_counters("pf", "UNION ALL SELECT 'packet_limit_reached', (SELECT (max(packet_number) > 700)::BIGINT FROM pk)"))
_add("packet_event_table", DNS, PACKETS, select="""SELECT row_id, epoch_us, src_ip, host AS requested_server_name, '1' AS query_type, apex_domain FROM ev""")
_add("capture_import_summary", DNS, PACKETS, select="""SELECT count(*) AS rows, count(DISTINCT apex_domain) AS distinct_apex_domains,
  round((max(epoch_us) - min(epoch_us)) / 1e6, 6) AS time_span_seconds, (SELECT count(*) FROM pk) AS packets,
  (SELECT count(*) FROM pk WHERE reason IS DISTINCT FROM 'non_query_packets') AS dns_query_packets,
  (SELECT count(*) FROM pk WHERE reason = 'non_query_packets') AS non_query_packets,
  (SELECT count(*) FROM pk WHERE reason = 'unsupported_transport') AS unsupported_transport,
  (SELECT count(*) FROM pk WHERE reason = 'unsupported_question_or_network') AS unsupported_question_or_network,
  (SELECT count(*) FROM pk WHERE reason = 'invalid_records') AS invalid_records,
  (SELECT count(*) FROM pk WHERE reason IS NULL) - count(*) AS duplicate_events, count(*) AS accepted_queries FROM ev""")
_add("capture_import_table", DNS, PACKETS, select="""SELECT (epoch_us // 1000000) || '.' || lpad((epoch_us % 1000000)::VARCHAR, 6, '0') AS timestamp, src_ip,
  '8.8.8.8' AS dst_ip, host AS requested_server_name, '1' AS query_type, 0::INTEGER AS label, 'capture' AS source FROM ev""")
_add("normalized_names", DNS, select=f"SELECT row_id, {kinds('host', 'host', 'host', 'host', 'host', 'host', repr(''), repr(''), value='name')} FROM dns")
_add("fqdn_problems", DNS, select="SELECT row_id, " + kinds(
    "NULL", "'empty_name'", "'single_label'", "'empty_label@1'", "'label_too_long@0'", "'hyphen_at_edge@1'", "'hyphen_at_edge@0'",
    "'bad_characters@0'", "'name_too_long'", "NULL", value="problem") + " FROM dns")
_add("domain_parts", DNS, "given AS (SELECT row_id, " + kinds(
    "host", "array_to_string(labels[:2], '.') || '.co.uk'", "labels[1] || '.us-east-1.compute.internal'", "'8.8.8.8.in-addr.arpa'",
    "'co.uk'", "'us-east-1.compute.internal'", "''", value="n") + " FROM dns)",
    f"cut AS (SELECT *, string_split(n, '.') AS labels FROM given), sz AS (SELECT *, {_parts('n')} FROM cut)", select="""
SELECT row_id, n AS requested_server_name, label_count::INTEGER AS label_count, array_to_string(labels[-suffix_size:], '.') AS tld,
  array_to_string(labels[-(suffix_size + 1):], '.') AS apex_domain,
  list_reduce(labels, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest_label,
  CASE WHEN len(labels) > suffix_size + 1 THEN array_to_string(labels[1:len(labels) - suffix_size - 1], '.') ELSE '' END AS subdomain,
  list_max(list_transform(labels, lambda l: length(l)))::INTEGER AS longest_label_length,
  length(CASE WHEN len(labels) > suffix_size + 1 THEN array_to_string(labels[1:len(labels) - suffix_size - 1], '.') ELSE '' END)::INTEGER AS subdomain_length,
  n AS labels_joined FROM sz""")
_add("parsed_timestamps", DNS, "given AS (SELECT row_id, " + kinds(
    "epoch_us", "epoch_us - epoch_us % 1000", "epoch_us - epoch_us % 1000000", "epoch_us", "epoch_us - epoch_us % 1000000",
    "epoch_us - epoch_us % 1000000", "epoch_us - epoch_us % 1000000 - 7200000000", "epoch_us - epoch_us % 86400000000", "NULL",
    "20250613000000", "epoch_us", "NULL", value="epoch_us") + " FROM dns)",
    select="SELECT row_id, epoch_us, strftime(make_timestamp(epoch_us), '%Y-%m-%d %H:%M:%S.%g') AS standard FROM given")
_add("ip_validity", DNS, select="SELECT row_id, " + kinds(
    "true", "false", "false", "true", "true", "true", "false", "(row_id % 400) < 256", "false", value="valid") + " FROM dns")
_add("lexical_features", DNS, lexical(), select="""SELECT row_id, query_length, longest_label_length, number_of_labels, round(entropy, 9) AS entropy,
  round(digit_ratio, 9) AS digit_ratio, round(special_char_ratio, 9) AS special_char_ratio, subdomain_length FROM lex""")
_add("dataset_columns", DNS, select=f"""SELECT row_id, length(url)::INTEGER AS dns_query_length, round({_entropy('url')}, 9) AS dns_query_entropy,
  len(string_split(url, '.'))::INTEGER AS dns_subdomain_count,
  round(length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url)::DOUBLE, 9) AS dns_numerical_ratio FROM dns""")
_add("label_coercion", DNS, select=f"SELECT row_id, ({kinds('1', '0', '1', '0', '-1', '-1', '1', value='x').removesuffix(' AS x')})::INTEGER AS label FROM dns")
_add("risk_tiers", DNS, predicted(0.5), select="""SELECT CASE WHEN score >= 0.8::DOUBLE THEN 'CRITICAL' WHEN score >= 0.5::DOUBLE THEN 'ELEVATED' ELSE 'LOW' END AS risk_label,
  CASE WHEN prediction = 1 THEN 'suspicious' ELSE 'benign' END AS verdict, count(*) AS rows FROM predicted GROUP BY ALL""")
_add("rule_indicators", *features(), select=f"""SELECT row_id, query_length >= 22 AS query_length_flag, entropy >= 3.5::DOUBLE AS entropy_flag,
  query_frequency >= 2 AS query_frequency_flag, unique_subdomains >= 2 AS unique_subdomains_flag, ({flags()})::INTEGER AS agreeing_indicators_count,
  ({flags()}) >= 2 AS baseline_flagged,
  concat_ws('|', CASE WHEN entropy >= 3.5::DOUBLE THEN 'high entropy' END, CASE WHEN query_length >= 22 THEN 'long query' END,
    CASE WHEN query_frequency >= 2 THEN 'query burst' END, CASE WHEN unique_subdomains >= 2 THEN 'many unique subdomains' END) AS reasons FROM win""")
_add("scorable_hosts", DNS, select="SELECT row_id, " + kinds("true", "false", "false", "false", "false", "false", value="scorable") + ", " + kinds(
    "apex_domain", "array_to_string(string_split(src_ip, '.')[-2:], '.')", "labels[1]", "labels[1] || '.local'", "'localhost'", "'fe80::1.2'",
    value="base_domain") + " FROM dns")
_add("rebased_times", DNS, select="SELECT row_id, 1800000000000000 + epoch_us - (SELECT min(epoch_us) FROM dns) AS epoch_us FROM dns")

_add("validation_problems", DNS, DIRTY, select="SELECT problem, count(*) AS rows FROM judged WHERE problem IS NOT NULL GROUP BY ALL")
_add("problem_rows", DNS, DIRTY, select="SELECT capture_id, 0::INTEGER AS file_ord, row_id, problem FROM judged WHERE problem IS NOT NULL")
_add("problem_sample", DNS, DIRTY, select="SELECT 0::INTEGER AS file_ord, row_id, problem FROM judged WHERE problem IS NOT NULL ORDER BY row_id LIMIT 5")
_add("validation_report", DNS, DIRTY, select="""SELECT count(*) AS total_records, (SELECT count(*) FROM kept) AS valid_records,
  count(problem) AS invalid_records, count(*) - count(problem) - (SELECT count(*) FROM kept) AS duplicate_records,
  (SELECT count(*) FROM kept WHERE label = 0) AS label_0, (SELECT count(*) FROM kept WHERE label = 1) AS label_1,
  count(problem) = 0 AND (SELECT count(*) FROM kept) > 0 AS is_successful FROM judged""")
_add("cleaned_table", DNS, DIRTY, select="""SELECT strftime(make_timestamp(epoch_us), '%Y-%m-%d %H:%M:%S.%g') AS timestamp,
  printf('%.3f', epoch_us / 1e6) AS epoch_time, src_ip, dst_ip, host AS requested_server_name, apex_domain, subdomain,
  split_part(host, '.', -1) AS tld, len(string_split(host, '.'))::INTEGER AS label_count,
  list_reduce(string_split(host, '.'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest_label,
  list_max(list_transform(string_split(host, '.'), lambda l: length(l)))::INTEGER AS longest_label_length,
  length(subdomain)::INTEGER AS subdomain_length, 'A' AS query_type, label::INTEGER AS label, 'Unknown' AS source FROM kept""")
_add("raw_duplicates_removed", DNS, DIRTY, select="SELECT 0::INTEGER AS file_ord, row_id FROM broken WHERE copy = 1")
_add("raw_duplicates_of_two_files", DNS, DIRTY, select="SELECT 1::INTEGER AS file_ord, source_row AS row_id FROM broken WHERE copy = 1")
_add("strict_load", DNS, select="SELECT row_id * 2 AS row_id, epoch_us, src_ip, host AS requested_server_name, label::INTEGER AS label FROM dns")
_add("event_duplicates_removed", DNS, select="SELECT row_id * 2 + 1 AS row_id FROM dns WHERE row_id % 10 = 0")
_add("conflicting_events", DNS, select="SELECT row_id * 2 AS row_id, 0::INTEGER AS lowest, 1::INTEGER AS highest FROM dns WHERE row_id % 10 = 0 AND (row_id * 2 + 1) % 200 = 1")

CONTRACT = f"""
ds AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, src_ip, dst_ip, host, label, epoch_us,
  length(host) AS len, {_entropy('host')} AS ent, len(string_split(host, '.')) AS parts FROM dns)"""
MISSING = ", ".join(f"0::BIGINT AS missing_{c}" for c in (
    "timestamp", "src_ip", "dst_ip", "requested_server_name", "dns_query_length", "dns_query_entropy", "dns_subdomain_count",
    "dns_numerical_ratio", "label", "source"))
_add("benign_contract", DNS, CONTRACT, select=f"""SELECT count(*) AS rows, {MISSING}, 0::BIGINT AS other_labels, count(DISTINCT host) AS distinct_names,
  10::INTEGER AS columns, true AS columns_match, count(*) - count(DISTINCT (timestamp, src_ip, host)) AS duplicate_rows,
  count(*) = count(DISTINCT (timestamp, src_ip, host)) AS passed FROM ds WHERE label = 0""")
_add("attack_contract", DNS, CONTRACT, select=f"""SELECT count(*) AS rows, {MISSING}, 0::BIGINT AS other_labels,
  count(*) FILTER (epoch_us NOT BETWEEN 1704067200000000 AND 1705276800000000) AS outside_time_bounds, 0::BIGINT AS name_limit_violations,
  count(*) FILTER (contains(host, '-')) AS length_mismatches, 0::BIGINT AS entropy_mismatches, 0::BIGINT AS label_count_mismatches,
  0::BIGINT AS digit_share_mismatches, count(DISTINCT host) AS distinct_names,
  count(DISTINCT array_to_string(string_split(host, '.')[-2:], '.')) AS distinct_base_domains, count(DISTINCT src_ip) AS distinct_sources,
  count(DISTINCT dst_ip) AS distinct_resolvers, min(len + contains(host, '-')::INTEGER)::INTEGER AS min_length,
  max(len + contains(host, '-')::INTEGER)::INTEGER AS max_length, round(min(ent), 4) AS min_entropy, round(max(ent), 4) AS max_entropy,
  true AS columns_match, count(*) - count(DISTINCT (timestamp, src_ip, host)) AS duplicate_rows, false AS passed FROM ds WHERE label = 1""")
_add("timestamp_fallback", DNS, """holes AS (SELECT row_id, capture_id, row_id < 40 OR row_id % 9 = 0 AS blank,
    CASE WHEN row_id < 40 OR row_id % 9 = 0 OR row_id % 14 = 0 THEN NULL ELSE epoch_us END AS us FROM dns),
  carried AS (SELECT *, last_value(us - us % 1000 IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM holes)""",
     select="""SELECT row_id, CASE WHEN blank THEN coalesce(c, 1700000000000000) ELSE us END AS epoch_us,
  CASE WHEN blank AND c IS NOT NULL THEN 'previous_row' WHEN blank THEN 'ingestion_time' END AS ts_fallback,
  CASE WHEN NOT blank AND us IS NULL THEN 'bad_timestamp' END AS problem FROM carried""")
_add("fast_gap_rows", *features(), select="SELECT row_id, round(time_interval, 6) AS time_interval FROM win WHERE label = 0 AND time_interval >= 0 AND time_interval < 3600")

_add("chronological_positions", DNS, select="""SELECT row_id, row_number() OVER (ORDER BY epoch_us - epoch_us % 3600000000, src_ip, host, label, row_id) AS position FROM dns""")
_add("newest_alerts", DNS, select="SELECT row_id AS alert_seq, host AS requested_server_name, src_ip FROM dns WHERE score >= 0.8::DOUBLE ORDER BY row_id DESC LIMIT 50")
_add("false_positive_examples", DNS, select="SELECT row_id, epoch_us, host AS requested_server_name, round(score, 9) AS score FROM dns WHERE label = 0 AND score >= 0.8::DOUBLE ORDER BY epoch_us, row_id LIMIT 10")
_add("distinct_apexes", DNS, select="SELECT DISTINCT apex_domain FROM dns WHERE label = 1")

_add("window_features_minute", DNS, windows(60), select=f"SELECT {WINDOW_OUT} FROM win")
_add("window_features_six_hours", DNS, windows(21600), select=f"SELECT {WINDOW_OUT} FROM win")
_add("window_features_with_ties", DNS, "coarse AS (SELECT * REPLACE (epoch_us - epoch_us % 21600000000 AS epoch_us) FROM dns)",
     windows(43200, source="coarse"), select=f"SELECT {WINDOW_OUT} FROM win")
_add("window_features_per_capture", DNS, windows(86400, "capture_id, src_ip, apex_domain"), select=f"SELECT {WINDOW_OUT} FROM win")
_add("window_features_hot_groups", DNS, windows(21600, "apex_domain"), select=f"SELECT {WINDOW_OUT} FROM win")
_add("order_violations", DNS, """arrived AS (SELECT row_id, epoch_us, lag(epoch_us) OVER (PARTITION BY src_ip, apex_domain
  ORDER BY (row_id * 7919) % 10007 * 1000000 + row_id) AS before FROM dns)""", select="SELECT row_id FROM arrived WHERE before > epoch_us")
_add("retimed_queries", DNS, select="""SELECT row_id, 1700000000000000 + 5000 * (row_number() OVER (PARTITION BY src_ip, apex_domain ORDER BY epoch_us, row_id) - 1) AS epoch_us FROM dns""")
_add("model_feature_table", *features(), select=f"SELECT row_id, src_ip, apex_domain, {MODEL_OUT} FROM win")
_add("enriched_table", *features(), select=f"SELECT row_id, src_ip, {MODEL_OUT} FROM win")
_add("suspicious_pairs", *features(), f"fl AS (SELECT *, (({flags()}) >= 3)::INTEGER AS hit FROM win)",
     select="SELECT src_ip, apex_domain, count(*) AS queries, sum(hit)::BIGINT AS flagged FROM fl GROUP BY ALL HAVING sum(hit) > 0")

_add("confusion_metrics", DNS, predicted(0.5), f"cm AS (SELECT capture_id, {confusion()} FROM predicted GROUP BY ALL)", rates("cm"),
     select=f"SELECT capture_id, tp, tn, fp, fn, {ROUND_RATES} FROM rated")
_add("ranking_metrics", DNS, """steps AS (SELECT score, count(*) FILTER (host_label = 1) AS pos, count(*) FILTER (host_label = 0) AS neg FROM dns GROUP BY ALL),
  walked AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM steps)""",
     select="""SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, round(sum((tp - pos / 2.0) * neg) / (max(p) * max(n)), 9)::DOUBLE AS roc_auc,
  round(sum(pos / p::DOUBLE * tp / (tp + fp)), 9) AS average_precision FROM walked""")
_add("domain_errors", DNS, predicted(0.5), select="""SELECT host AS requested_server_name, count(*) AS rows, count(*) FILTER (host_label = 0) AS benign,
  count(*) FILTER (host_label = 1) AS attack, count(*) FILTER (host_label = 0 AND prediction = 1) AS false_positives,
  count(*) FILTER (host_label = 1 AND prediction = 0) AS false_negatives,
  round(count(*) FILTER (host_label = 0 AND prediction = 1) / nullif(count(*) FILTER (host_label = 0), 0)::DOUBLE, 9) AS false_positive_rate,
  round(1 - count(*) FILTER (host_label = 1 AND prediction = 0) / nullif(count(*) FILTER (host_label = 1), 0)::DOUBLE, 9) AS recall
  FROM predicted GROUP BY ALL""")
_add("policy_summary", DNS, predicted(0.5), f"""pooled AS (SELECT {confusion('host_label')} FROM predicted)""", rates("pooled", "pr"),
     f"by_fold AS (SELECT length(host) % 3 AS fold, {confusion('host_label')} FROM predicted GROUP BY ALL)", rates("by_fold", "fr"),
     """doms AS (SELECT host, count(*) FILTER (host_label = 0) AS benign, count(*) FILTER (host_label = 0 AND prediction = 1) AS fp FROM predicted GROUP BY ALL),
  big AS (SELECT count(*) AS c, coalesce(max(fp / benign::DOUBLE), 0.0) AS w FROM doms WHERE benign >= 20)""",
     select=f"""SELECT tp, tn, fp, fn, {ROUND_RATES}, (SELECT round(avg(recall), 9) FROM fr) AS mean_fold_recall, (SELECT round(avg(f1), 9) FROM fr) AS mean_fold_f1,
  (SELECT round(max(false_positive_rate), 9) FROM fr) AS worst_fold_fpr, (SELECT round(w, 9) FROM big) AS worst_large_domain_fpr,
  (SELECT c FROM big) AS checked_benign_domains FROM pr""")
_add("nearest_rank_quantiles", *HOST_FEATURES, """ordered AS (SELECT label, entropy, row_number() OVER (PARTITION BY label ORDER BY entropy) - 1 AS place0,
  count(*) OVER (PARTITION BY label) AS n FROM hf), asked AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS q)""",
     select="SELECT label::INTEGER AS label, q AS quantile, entropy AS value FROM ordered, asked WHERE place0 = round_even((n - 1) * q, 0)::BIGINT")
_add("linear_quantiles", DNS, "asked AS (SELECT unnest([0.0, 0.5, 0.95, 1.0]::DOUBLE[]) AS q)", """
  lists AS (SELECT label, list_sort(list(score)) AS l FROM dns GROUP BY ALL),
  spots AS (SELECT label, q, l, (len(l) - 1) * q AS p FROM lists, asked)""",
     select="""SELECT label::INTEGER AS label, q AS quantile,
  round(l[floor(p)::BIGINT + 1] + (l[ceil(p)::BIGINT + 1] - l[floor(p)::BIGINT + 1]) * (p - floor(p)), 9) AS value FROM spots""")
_add("feature_medians", *features(), f"lf AS ({long_features(MODEL_FEATURES, 'win', 'label')})", "asked AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q)",
     "lists AS (SELECT label, feature, list_sort(list(v)) AS l FROM lf GROUP BY ALL), spots AS (SELECT label, feature, q, l, (len(l) - 1) * q AS p FROM lists, asked)",
     select="""SELECT label::INTEGER AS label, feature, q AS quantile,
  round(l[floor(p)::BIGINT + 1] + (l[ceil(p)::BIGINT + 1] - l[floor(p)::BIGINT + 1]) * (p - floor(p)), 6) AS value FROM spots""")
_add("label_distribution", DNS, select="SELECT label::INTEGER AS label, count(*) AS rows FROM dns GROUP BY ALL")
_add("split_summary", DNS, select="""SELECT capture_id, count(*) AS rows, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack,
  count(DISTINCT apex_domain) AS apex_domains, count(DISTINCT apex_domain) FILTER (label = 1) AS attack_apex_domains, min(epoch_us) AS earliest_us,
  max(epoch_us) AS latest_us FROM dns GROUP BY ALL""")
_add("attack_domains", DNS, select="SELECT DISTINCT capture_id, host AS apex_domain FROM dns WHERE host_label = 1")
_add("distinct_counts", DNS, select="""SELECT count(DISTINCT host) AS distinct_requested_server_name, count(DISTINCT src_ip) AS distinct_src_ip,
  count(DISTINCT dst_ip) AS distinct_dst_ip, count(DISTINCT apex_domain) AS distinct_apex_domain FROM dns""")
_add("traffic_statistics", DNS, predicted(0.5), select="""SELECT count(*) AS total_processed, count(*) FILTER (prediction = 1) AS total_suspicious,
  count(*) FILTER (prediction = 0) AS total_benign, round(count(*) FILTER (prediction = 1) / count(*)::DOUBLE, 9) AS suspicious_rate,
  least(count(*) FILTER (prediction = 1), 500) AS active_alerts_retained, count(*) > 0 AS has_live_data FROM predicted""")
_add("masked_false_positive_rate", DNS, predicted(0.5), select="""SELECT count(*) AS queries, count(*) FILTER (prediction = 1) AS false_positives,
  round(count(*) FILTER (prediction = 1) / count(*)::DOUBLE, 9) AS false_positive_rate FROM predicted WHERE apex_domain = 'example.com'""")
_add("fast_gap_share", *features(), select="""SELECT label::INTEGER AS label, count(*) AS rows,
  round(count(*) FILTER (time_interval >= 0 AND time_interval < 3600) / count(*)::DOUBLE, 9) AS share_of_fast_gaps FROM win GROUP BY ALL""")
_add("gap_profile", *features(), "lists AS (SELECT label, list_sort(list(time_interval)) AS l FROM win WHERE time_interval >= 0 GROUP BY ALL)",
     "spots AS (SELECT label, l, q, (len(l) - 1) * q AS p FROM lists, (SELECT unnest([0.0, 0.01]::DOUBLE[]) AS q))",
     select="""SELECT label::INTEGER AS label, q AS quantile,
  round(l[floor(p)::BIGINT + 1] + (l[ceil(p)::BIGINT + 1] - l[floor(p)::BIGINT + 1]) * (p - floor(p)), 6) AS value FROM spots""")
_add("flagged_share", DNS, predicted(0.5), select="SELECT apex_domain, round(avg(prediction), 9) AS recall FROM predicted WHERE label = 1 GROUP BY ALL")
_add("feature_ranges", DNS, lexical(), select="""SELECT min(query_length)::DOUBLE AS min_query_length, max(query_length)::DOUBLE AS max_query_length,
  round(min(entropy), 4) AS min_entropy, round(max(entropy), 4) AS max_entropy, round(min(digit_ratio), 4) AS min_digit_ratio,
  round(max(digit_ratio), 4) AS max_digit_ratio FROM lex""")
_add("capture_span", DNS, select="SELECT round((max(epoch_us) - min(epoch_us)) / 1e6, 6) AS time_span_seconds, count(DISTINCT apex_domain) AS distinct_apex_domains FROM dns")
_add("content_fingerprint", DNS, select="""SELECT count(*) AS rows,
  sum(('0x' || left(md5(concat_ws(chr(31), epoch_us, label, host, row_id, src_ip)), 15))::BIGINT)::VARCHAR AS fingerprint FROM dns""")

_add("prediction_join", DNS, select="SELECT row_id, (score >= 0.7::DOUBLE)::INTEGER AS prediction, label::INTEGER AS label, apex_domain FROM dns WHERE score >= 0.6::DOUBLE")
_add("row_mismatches", DNS, select="""SELECT row_id, CASE WHEN row_id % 97 = 0 THEN 'missing_left' WHEN row_id % 89 = 0 THEN 'missing_right' ELSE 'different' END AS mismatch
  FROM dns WHERE (row_id % 97 = 0 OR row_id % 89 = 0 OR row_id % 83 = 0) AND NOT (row_id % 97 = 0 AND row_id % 89 = 0)""")
_add("excluded_domains", DNS, select="SELECT host AS requested_server_name, count(*) AS rows FROM dns WHERE host NOT IN (SELECT host FROM dns WHERE host_label = 1) GROUP BY ALL")
_add("fold_join", DNS, select="SELECT (length(host) % 5)::INTEGER AS fold, count(*) AS rows FROM dns GROUP BY ALL")
_add("known_domains", DNS, select="""SELECT host IN (SELECT host FROM dns WHERE capture_id = 'view' AND row_id % 5 = 0) AS known_domain,
  count(*) AS rows, count(DISTINCT host) AS domains FROM dns GROUP BY 1""")
_add("captures_united", DNS, select="SELECT CASE label WHEN 0 THEN 'first' ELSE 'second' END AS capture_id, count(*) AS rows, count(*) FILTER (label = 1) AS with_tld FROM dns GROUP BY 1")
_add("fold_complement", DNS, select="SELECT (length(host) % 5)::INTEGER AS fold, count(*) AS rows FROM dns WHERE length(host) % 5 <> 3 GROUP BY ALL")
_add("shared_domains", DNS, select="SELECT host AS requested_server_name, count(DISTINCT capture_id) AS parts FROM dns GROUP BY ALL HAVING count(DISTINCT capture_id) > 1")
_add("incomplete_histories", DNS, """ev AS (SELECT row_id, host FROM dns WHERE host_label = 1 AND row_id % 11 <> 0),
  src AS (SELECT row_id FROM dns WHERE row_id % 13 <> 0 AND host IN (SELECT host FROM ev))""",
     select="""SELECT row_id, 'not_evaluated' AS problem FROM src WHERE row_id NOT IN (SELECT row_id FROM ev)
  UNION ALL SELECT row_id, 'not_in_source' FROM ev WHERE row_id NOT IN (SELECT row_id FROM src)""")
REQUESTS = """
rq AS (SELECT * REPLACE (coalesce(CASE WHEN row_id // 1000 % 3 > 0 THEN 'shared' END, 'batch_' || sha256('requests.json#' || row_id // 1000)) AS capture_id),
  'requests.json#' || row_id // 1000 AS request_id, row_id % 1000 AS seq FROM dns)"""
_add("new_alerts", DNS, REQUESTS, select="""SELECT 'alt_' || sha256(concat_ws(chr(31), capture_id, request_id, seq)) AS alert_id, request_id, seq,
  host AS requested_server_name FROM rq WHERE score >= 0.7::DOUBLE AND request_id NOT IN ('requests.json#0', 'requests.json#3')""")
_add("request_histories", DNS, REQUESTS, windows(86400, "request_id, apex_domain", "rq", "seq"),
     select="SELECT request_id, seq, query_frequency, unique_subdomains, round(time_interval, 6) AS time_interval FROM win")

_add("stratified_split", DNS, shuffled("dns"), select="SELECT row_id, label::INTEGER AS label, split FROM parted")
_add("domain_folds", DNS, HOST, folds(3), select="SELECT apex_domain, benign, attack, rows, majority::INTEGER AS majority, fold FROM fold_map")
_add("domain_split", DNS, HOST, folds(5), select="""SELECT row_id AS input_row_id,
  CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, apex_domain FROM hosts JOIN fold_map USING (apex_domain)""")
_add("candidate_thresholds", *HOST_FEATURES, shuffled("hf"), CANDIDATES, select="SELECT feature, threshold, place, tp, fp, round(f1, 9) AS f1 FROM chosen")
_add("selected_thresholds", *HOST_FEATURES, shuffled("hf"), CANDIDATES, GRID, select=f"""SELECT t1::DOUBLE AS t_query_length,
  t2::DOUBLE AS t_entropy, t3::DOUBLE AS t_query_frequency, t4::DOUBLE AS t_unique_subdomains, votes::INTEGER AS votes, tp, tn, fp, fn, {ROUND_RATES} FROM best""")
_add("rule_evaluation", *HOST_FEATURES, shuffled("hf"), CANDIDATES, GRID, f"""
  judged AS (SELECT label, ((query_length >= t1)::INTEGER + (entropy >= t2)::INTEGER + (query_frequency >= t3)::INTEGER + (unique_subdomains >= t4)::INTEGER >= votes)::INTEGER AS prediction
    FROM parted, best WHERE split = 'test'), cm AS (SELECT {confusion()} FROM judged)""", rates("cm"),
     select=f"SELECT tp, tn, fp, fn, {ROUND_RATES} FROM rated")
_add("threshold_trials", *HOST_FEATURES, f"""grid AS (SELECT * FROM (SELECT unnest([20.0, 24.0]::DOUBLE[]) AS t1), (SELECT unnest([3.4, 3.7]::DOUBLE[]) AS t2),
    (SELECT unnest([2.0, 3.0]::DOUBLE[]) AS t3), (SELECT unnest([2, 3, 4]) AS votes)),
  tried AS (SELECT t1, t2, t3, votes, label, ((query_length >= t1)::INTEGER + (entropy >= t2)::INTEGER + (query_frequency >= t3)::INTEGER
    + (unique_subdomains >= 2)::INTEGER >= votes)::INTEGER AS prediction FROM grid, hf),
  cm AS (SELECT t1, t2, t3, votes, {confusion()} FROM tried GROUP BY ALL)""", rates("cm"),
     select=f"""SELECT t1 AS t_query_length, t2 AS t_entropy, t3 AS t_query_frequency, 2.0::DOUBLE AS t_unique_subdomains, votes::INTEGER AS votes,
  tp, tn, fp, fn, {ROUND_RATES} FROM rated""")
_add("rule_detector", *features(), select=f"SELECT row_id, ({flags()})::INTEGER AS votes, (({flags()}) >= 3)::INTEGER AS prediction FROM win")
_add("policy_trials", DNS, HOST, f"""tr AS (SELECT t AS trial_id, length(apex_domain) % 3 AS fold, apex_domain, label, CASE t WHEN 1 THEN score ELSE score * score END AS s
    FROM hosts, (SELECT unnest([1, 2]) AS t)),
  th AS (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.9]::DOUBLE[]) AS threshold),
  pr AS (SELECT *, (s >= threshold)::INTEGER AS prediction FROM tr, th),
  cm AS (SELECT trial_id, threshold, {confusion()} FROM pr GROUP BY ALL)""", rates("cm"),
     f"cf AS (SELECT trial_id, threshold, fold, {confusion()} FROM pr GROUP BY ALL)", rates("cf", "fr"),
     """fm AS (SELECT trial_id, threshold, avg(recall) AS mean_fold_recall, avg(f1) AS mean_fold_f1, max(false_positive_rate) AS worst_fold_fpr FROM fr GROUP BY ALL),
  dm AS (SELECT trial_id, threshold, apex_domain, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 0 AND prediction = 1) AS dfp FROM pr GROUP BY ALL),
  wd AS (SELECT trial_id, threshold, max(dfp / benign::DOUBLE) AS worst_large_domain_fpr, count(*) AS checked_benign_domains FROM dm WHERE benign >= 20 GROUP BY ALL)""",
     select=f"""SELECT trial_id::INTEGER AS trial_id, threshold, tp, tn, fp, fn, {ROUND_RATES}, round(mean_fold_recall, 9) AS mean_fold_recall,
  round(mean_fold_f1, 9) AS mean_fold_f1, round(worst_fold_fpr, 9) AS worst_fold_fpr, round(worst_large_domain_fpr, 9) AS worst_large_domain_fpr,
  checked_benign_domains, false_positive_rate <= 0.4::DOUBLE AND worst_large_domain_fpr <= 0.6::DOUBLE AS eligible
  FROM rated JOIN fm USING (trial_id, threshold) JOIN wd USING (trial_id, threshold)""")
_add("held_out_rows", DNS, HOST, folds(3), select="SELECT row_id, CASE fold WHEN 1 THEN 'evaluation' ELSE 'training' END AS part FROM hosts JOIN fold_map USING (apex_domain)")
_add("timing_sweep", DNS, """gaps AS (SELECT unnest([1, 50, 20000, 60000, 90000]) AS gap_ms),
  re AS (SELECT * REPLACE (1700000000000000 + gap_ms * 1000 * (row_number() OVER (PARTITION BY gap_ms, src_ip, apex_domain ORDER BY epoch_us, row_id) - 1) AS epoch_us)
    FROM dns, gaps WHERE host_label = 1)""", lexical("re"), windows(60, "gap_ms, src_ip, apex_domain", "lex"),
     select=f"""SELECT gap_ms::INTEGER AS gap_ms, round(avg((({flags()}) >= 3)::INTEGER), 9) AS recall,
  round(avg((({flags(f=4.0)}) >= 4)::INTEGER), 9) AS previous_recall FROM win GROUP BY ALL""")
_add("detector_comparison", *features(), f"""both_d AS (SELECT 'rule' AS detector, label, (({flags()}) >= 3)::INTEGER AS prediction FROM win
    UNION ALL SELECT 'model', label, (score >= 0.7::DOUBLE)::INTEGER FROM win), cm AS (SELECT detector, {confusion()} FROM both_d GROUP BY ALL)""", rates("cm"),
     select=f"SELECT detector, tp, tn, fp, fn, {ROUND_RATES} FROM rated")
_add("alert_table", DNS, lexical(), windows(21600, source="lex"), select="""SELECT 'alt_' || sha256(concat_ws(chr(31), capture_id, row_id)) AS alert_id, row_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp, host AS requested_server_name, src_ip, 'CRITICAL' AS risk_label, round(score, 9) AS attack_score, capture_id,
  ((query_length >= 52)::INTEGER + (entropy >= 4.309101::DOUBLE)::INTEGER + (query_frequency >= 41)::INTEGER + (unique_subdomains >= 41)::INTEGER)::INTEGER AS agreeing_indicators_count
  FROM win WHERE score >= 0.8::DOUBLE""")
_add("sensor_replay", DNS, """arr AS (SELECT * REPLACE ('10.0.0.1' AS src_ip), row_id // 100 + CASE WHEN row_id % 9 = 0 THEN 3 ELSE 0 END AS batch_seq FROM dns),
  hi AS (SELECT *, max(epoch_us) OVER (PARTITION BY apex_domain ORDER BY batch_seq, epoch_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM arr),
  ok AS (SELECT * FROM hi WHERE highest IS NULL OR epoch_us >= highest)""", windows(21600, "apex_domain", "ok", "batch_seq, row_id"),
     select=f"""SELECT row_id, 'accepted' AS status, query_frequency, unique_subdomains, round(time_interval, 6) AS time_interval FROM win
  UNION ALL SELECT row_id, 'rejected', NULL, NULL, NULL FROM hi WHERE epoch_us < highest""")
_add("live_totals", DNS, predicted(0.5), select="""SELECT capture_id, count(*) AS total_processed, count(*) FILTER (prediction = 1) AS total_suspicious,
  count(*) FILTER (prediction = 0) AS total_benign FROM predicted GROUP BY ALL""")
_add("alert_digest", DNS, "al AS (SELECT * FROM dns WHERE score >= 0.7::DOUBLE)", select="""SELECT count(*) AS alerts,
  (SELECT string_agg(apex_domain, ',' ORDER BY m) FROM (SELECT apex_domain, min(row_id) AS m FROM al GROUP BY ALL ORDER BY m LIMIT 3)) AS domains,
  (SELECT string_agg(src_ip, ',' ORDER BY m) FROM (SELECT src_ip, min(row_id) AS m FROM al GROUP BY ALL ORDER BY m LIMIT 3)) AS hosts FROM al""")

TOTALS = "count(*) FILTER (label = 1) AS attacks, count(*) FILTER (label = 0) AS benign"
_add("forest_selection", DNS, HOST, shuffled("hosts"), select=f"""SELECT c::INTEGER AS candidate, threshold, {TOTALS}
  FROM parted, (SELECT unnest([0, 1]) AS c), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS threshold) WHERE split = 'validation' GROUP BY ALL""")
_add("group_selection", DNS, HOST, folds(3), f"""sizes AS (SELECT fold, count(*) AS rows FROM hosts JOIN fold_map USING (apex_domain) GROUP BY ALL),
  whole AS (SELECT {TOTALS} FROM hosts)""", select="""SELECT 1::INTEGER AS trial_id, threshold, attacks, benign, fold, s.rows AS rows
  FROM whole, sizes s, (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.9]::DOUBLE[]) AS threshold)""")
_add("nested_evaluation", DNS, HOST, folds(2), select="""SELECT row_id AS input_row_id, apex_domain, label::INTEGER AS label, fold AS outer_fold,
  true AS is_probability FROM hosts JOIN fold_map USING (apex_domain)""")
_add("held_out_experiment", DNS, HOST, folds(3), f"""held AS (SELECT * FROM hosts JOIN fold_map USING (apex_domain) WHERE fold = 1),
  big AS (SELECT apex_domain FROM held GROUP BY ALL ORDER BY count(*) DESC, apex_domain LIMIT 1),
  scoped AS (SELECT 'pooled' AS scope, label FROM held UNION ALL SELECT 'big_domain', label FROM held WHERE apex_domain = (FROM big))""",
     select=f"SELECT scope, model, {TOTALS} FROM scoped, (SELECT unnest(['before', 'after']) AS model) GROUP BY ALL")
_add("replay_checks", DNS, select="""SELECT count(*) AS rows, true AS labels_identical, true AS predictions_identical, true AS scores_identical,
  true AS complete_histories, true AS metrics_identical, 0::BIGINT AS changed_features FROM dns""")
_add("fast_burst_run", DNS, select="""SELECT -1::INTEGER AS gap_ms, count(*) AS rows, count(DISTINCT host) AS domains, true AS recalls_are_shares
  FROM dns WHERE host_label = 1 UNION ALL SELECT unnest([1, 250])::INTEGER, NULL, NULL, true""")
_add("csv_log_scan", DNS, "sizes AS (SELECT label, count(*) AS rows FROM dns GROUP BY ALL)", select="""SELECT label::INTEGER AS label, s.rows AS rows, true AS has_names,
  (SELECT count(*) FROM dns) AS numbers, 1::BIGINT AS first, (SELECT count(*) FROM dns) AS last FROM sizes s""")
_add("stored_predictions", DNS, select="""SELECT row_id::BIGINT AS input_row_id, apex_domain, label::INTEGER AS label, (score >= 0.7::DOUBLE)::INTEGER AS prediction,
  round(score, 6) AS attack_probability FROM dns""")
_add("model_input_table", *features(), select="SELECT row_id, " + ", ".join(
    f"round({f}, {6 if f == 'time_interval' else 9})::DOUBLE AS {f}" for f in MODEL_FEATURES) + " FROM win")
_add("accepted_benign_capture", DNS, HOST, folds(3), select="""SELECT apex_domain, count(*) AS rows FROM hosts JOIN fold_map USING (apex_domain)
  WHERE hosts.label = 0 AND fold <> 1 GROUP BY ALL""")
