"""Verdict columns: voting rule, tiers, reasons and alert identity."""

from pyspark.sql import functions as F

from leakgauge.contract import FROZEN_RULE, FROZEN_VOTES, REASON_TEXT, RULE_FEATURES

_ABSENT = {"query_length": 0.0, "entropy": 0.0, "query_frequency": 1.0, "unique_subdomains": 1.0}


def rule_votes(rule=None, columns=None):
    """How many features reach their threshold; a missing feature takes its neutral value."""
    rule = rule or FROZEN_RULE
    votes = F.lit(0)
    for name in RULE_FEATURES:
        present = columns is None or name in columns
        value = F.coalesce(F.col(name).cast("double"), F.lit(_ABSENT[name])) if present else F.lit(_ABSENT[name])
        votes = votes + (value >= float(rule[name])).cast("int")
    return votes


def rule_prediction(rule=None, votes=FROZEN_VOTES, columns=None):
    if not 1 <= votes <= len(RULE_FEATURES):
        raise ValueError(f"votes must lie between 1 and {len(RULE_FEATURES)}")
    return (rule_votes(rule, columns) >= votes).cast("int")


def rule_indicators(rule=None, columns=None):
    """Struct of the four flags, the number that agree and the verdict of the rule."""
    rule = rule or FROZEN_RULE
    flags = []
    for name in RULE_FEATURES:
        present = columns is None or name in columns
        value = F.coalesce(F.col(name).cast("double"), F.lit(_ABSENT[name])) if present else F.lit(_ABSENT[name])
        flags.append((value >= float(rule[name])).alias(f"{name}_flag"))
    votes = rule_votes(rule, columns)
    return F.struct(
        *flags,
        votes.alias("agreeing_indicators_count"),
        (votes >= FROZEN_VOTES).alias("baseline_flagged"),
    )


def indicator_reasons(indicators="rule_indicators"):
    """Readable reasons of the raised flags, in fixed order."""
    flags = F.col(indicators) if isinstance(indicators, str) else indicators
    return F.array_compact(F.array(*(
        F.when(flags[f"{name}_flag"], F.lit(text)) for name, text in REASON_TEXT.items()
    )))


def risk_tier(score, threshold):
    return F.when(score >= threshold, "CRITICAL").when(score >= 0.5, "ELEVATED").otherwise("LOW")


def verdict_text(label):
    return F.when(label == 1, "suspicious").otherwise("benign")


# What names a scored row, from the outside in; a table has some of these.
ROW_IDENTITY = ("capture_id", "request_id", "file_ord", "batch_seq", "row_id", "seq")
SEPARATOR, NO_VALUE = "\u001f", "\u001e"


def alert_id(*row_key):
    """Stable identity, so that a retried write gives the same alert.

    The whole digest is kept, because an alert whose id was seen is not reported; a null part counts as one.
    """
    parts = (F.coalesce(k.cast("string"), F.lit(NO_VALUE)) for k in row_key)
    return F.concat(F.lit("alt_"), F.sha2(F.concat_ws(SEPARATOR, *parts), 256))


def row_alert_id(columns):
    """The alert id of a scored row of a table with these columns."""
    return alert_id(*(F.col(c) for c in ROW_IDENTITY if c in columns))
