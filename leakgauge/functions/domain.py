"""Domain names: cleaning, validity and decomposition as native column expressions."""

from pyspark.sql import functions as F

from leakgauge.contract import THREE_LABEL_SUFFIXES, TWO_LABEL_SUFFIXES

# Every character that counts as white space in Unicode text, plus the four ASCII separators.
SPACES = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
_LABEL = "[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
_NAME = rf"^{_LABEL}(\.{_LABEL})+\z"


def stripped(col):
    """Text without outer white space of any kind."""
    return F.btrim(col, F.lit(SPACES))


def normalize_domain(col):
    """Lower-case host name without quotes, scheme, path, port and outer dots; null becomes ''.

    A name that is clean already, the usual case in a query log, is recognised by one pattern.
    """
    given = F.coalesce(col.cast("string"), F.lit(""))
    # Each step uses the one before once; a condition that named it twice would double the work per step.
    text = F.btrim(F.btrim(F.btrim(given, F.lit(SPACES)), F.lit("\"'")), F.lit(SPACES))
    text = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    for stop in "/?#":
        text = F.substring_index(text, stop, 1)
    text = F.btrim(F.lower(F.regexp_replace(text, r"(?d):\p{Nd}+$", "")), F.lit(SPACES))
    text = F.ltrim(F.rtrim(text, F.lit(".")), F.lit("."))
    return F.when(given.rlike(r"^[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\z"), given).otherwise(text)


def label_count(domain):
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    return F.when(domain == "", 0).otherwise(dots + 1).cast("int")


def fqdn_problem(domain):
    """Null for a valid name, else the code of the first broken rule.

    A single pattern settles valid names, so labels are looked at one by one only for the others.
    """
    def label_problem(label, index):
        code = (
            F.when(label == "", "empty_label")
            .when(F.length(label) > 63, "label_too_long")
            .when(label.startswith("-") | label.endswith("-"), "hyphen_at_edge")
            .when(~label.rlike(f"(?d)^{_LABEL}$"), "bad_characters")
        )
        return F.when(code.isNotNull(), F.concat_ws("@", code, index.cast("string")))

    problems = F.filter(F.transform(F.split(domain, r"\."), label_problem), lambda p: p.isNotNull())
    return (
        F.when((F.length(domain) <= 253) & domain.rlike(_NAME), F.lit(None).cast("string"))
        .when(F.coalesce(domain, F.lit("")) == "", "empty_name")
        .when(F.length(domain) > 253, "name_too_long")
        .when(label_count(domain) < 2, "single_label")
        .otherwise(F.get(problems, F.lit(0)))
    )


def is_valid_fqdn(domain):
    return fqdn_problem(domain).isNull()


def _suffix_size(domain, count):
    three = (count >= 4) & F.substring_index(domain, ".", -3).isin(*THREE_LABEL_SUFFIXES)
    two = (count >= 3) & F.substring_index(domain, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    return three, two


def longest_label(domain):
    """The first of the longest labels."""
    return F.reduce(
        F.split(domain, r"\."),
        F.lit(""),
        lambda best, label: F.when(F.length(label) > F.length(best), label).otherwise(best),
    )


def with_domain_parts(df, name="requested_server_name"):
    """Add apex, subdomain, suffix and label columns for an already normalised name.

    The helper columns are separate projections so that each is computed once per row.
    """
    domain = F.col(name)
    count = label_count(domain)
    three, two = _suffix_size(domain, F.col("label_count"))
    return (
        df.withColumn("label_count", count)
        .withColumn("__suffix", F.when(three, 3).when(two, 2).otherwise(1))
        .withColumns({
            "tld": F.when(F.col("__suffix") == 3, F.substring_index(domain, ".", -3))
            .when(F.col("__suffix") == 2, F.substring_index(domain, ".", -2))
            .otherwise(F.substring_index(domain, ".", -1)),
            "apex_domain": F.when(F.col("__suffix") == 3, F.substring_index(domain, ".", -4))
            .when(F.col("__suffix") == 2, F.substring_index(domain, ".", -3))
            .otherwise(F.substring_index(domain, ".", -2)),
            "longest_label": longest_label(domain),
        })
        .withColumns({
            "subdomain": F.when(
                F.length(domain) > F.length("apex_domain"),
                F.left(domain, F.length(domain) - F.length("apex_domain") - 1),
            ).otherwise(""),
            "longest_label_length": F.length("longest_label"),
        })
        .withColumn("subdomain_length", F.length("subdomain"))
        .drop("__suffix")
    )


def label_array(domain):
    return F.when(domain == "", F.array().cast("array<string>")).otherwise(F.split(domain, r"\."))


def flatten_labels(df, labels="labels", joined="labels_joined"):
    """Replace the label array by a dot-joined string."""
    return df.withColumn(joined, F.array_join(labels, ".")).drop(labels)


def base_domain(domain):
    """The last two labels, whatever the suffix."""
    return F.substring_index(domain, ".", -2)


def is_scorable_host(host):
    """A name that needs a DNS lookup: dotted, not an IP literal, not local."""
    return F.coalesce(
        F.contains(host, F.lit("."))
        & ~host.rlike(r"^[0-9.]+\z")
        & ~F.contains(host, F.lit(":"))
        & ~host.endswith(".local")
        & (host != "localhost"),
        F.lit(False),
    )
