"""The seven features that come from the name alone."""

import string

from pyspark.sql import functions as F

from leakgauge.functions.domain import with_domain_parts


def entropy(text):
    """Shannon entropy in bits per character; summed in order of first appearance."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    # Two steps, so that each share is worked out once: lambda bodies share no subexpressions.
    shares = F.transform(chars, lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    bits = F.reduce(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(size == 0, F.lit(0.0)).otherwise(bits)


def digit_ratio(text):
    """Share of ASCII digits."""
    size = F.length(text)
    digits = size - F.length(F.translate(text, string.digits, ""))
    return F.when(size == 0, F.lit(0.0)).otherwise(digits / size)


def special_char_ratio(text):
    """Share of characters that are neither letters nor numbers in any script."""
    size = F.length(text)
    rest = F.translate(text, string.ascii_letters + string.digits, "")
    special = F.length(F.regexp_replace(rest, r"[\p{L}\p{N}]", ""))
    return F.when(size == 0, F.lit(0.0)).otherwise(special / size)


def with_lexical_features(df, name="requested_server_name"):
    """Add the per-query features; domain parts are added first when absent."""
    if not {"label_count", "longest_label_length", "subdomain_length"} <= set(df.columns):
        df = with_domain_parts(df, name)
    text = F.col(name)
    return df.withColumns({
        "query_length": F.length(text),
        "number_of_labels": F.col("label_count"),
        "entropy": entropy(text),
        "digit_ratio": digit_ratio(text),
        "special_char_ratio": special_char_ratio(text),
    })


def dataset_features(text):
    """The four columns of the published raw dataset, over the name as written."""
    size = F.length(text)
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    return {
        "dns_query_length": size,
        "dns_query_entropy": entropy(text),
        "dns_subdomain_count": (size - F.length(F.replace(text, F.lit("."), F.lit(""))) + 1).cast("int"),
        "dns_numerical_ratio": F.when(size == 0, F.lit(0.0)).otherwise(digits / size),
    }
