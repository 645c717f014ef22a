"""Registered queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from . import audit, contamination, language, mixing, quality, recipes, repeats, shards, simhash, tokens, toxicity, warc, whitening
from .simhash_sql import simhash_groups_sql
from .store import table


def op1_quality_scores(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeat_removal(spark, sf_dir):
    return repeats.removal_report(table(spark, sf_dir, "documents"))


def op3_warc_archives(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op4_simhash_groups(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_weighted_mix(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_jump_shards(spark, sf_dir):
    return shards.placed(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return recipes.exact_groups(table(spark, sf_dir, "documents"))


def op9_languages(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


def op10_contamination(spark, sf_dir):
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_quality_scores, op2_repeat_removal, op3_warc_archives, op4_simhash_groups, op5_token_counts, op6_weighted_mix,
    op7_jump_shards, op8_exact_dedup, op9_languages, op10_contamination, op11_filter_audit, op12_whitening, op13_toxicity,
)}
ORACLES = {
    "op2_repeat_removal": repeats.SQL, "op3_warc_archives": warc.SQL, "op4_simhash_groups": simhash_groups_sql(),
    "op6_weighted_mix": mixing.SQL, "op7_jump_shards": shards.SQL, "op8_exact_dedup": recipes.SQL,
    "op11_filter_audit": audit.SQL,
}
