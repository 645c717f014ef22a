"""Deterministic splits: rows per class, and whole domains per fold.

Order within a split comes from MD5 of seed and key, which every engine computes alike.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakgauge.contract import DataError
from leakgauge.plans.ordered import ROWS_PER_TASK, running_sum, with_running


def shuffle_key(seed, *columns):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def _any_of(conditions):
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def _cuts(df, seed, ratios, row_id):
    """Per class, the shuffle key of the last row below each cut point.

    Keys are uniform, so one pass counts rows per key prefix, and a second one ranks only the rows whose
    prefix holds a cut. At most one row per class and cut comes back.
    """
    keyed = df.select("label", row_id, shuffle_key(seed, row_id).alias("k")).withColumn("p", F.left("k", F.lit(4)))
    counts = keyed.groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).persist()
    if not counts.where(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).isEmpty():
        raise DataError("labels must be 0 or 1")
    by_label = W.partitionBy("label")  # at most 65,536 prefixes each
    total = F.sum("n").over(by_label)
    train = (total * ratios[0]).cast("bigint")
    wanted = F.array(
        F.struct(F.lit(0).alias("place"), train.alias("position")),
        F.struct(F.lit(1).alias("place"), (train + (total * ratios[1]).cast("bigint")).alias("position")),
    )
    upto = F.sum("n").over(by_label.orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "wanted": wanted}).select(
        "label", "p", "n", "upto", F.explode("wanted").alias("w")
    )
    holders = ranked.where((F.col("upto") >= F.col("w.position")) & (F.col("upto") - F.col("n") < F.col("w.position")))
    places = holders.select(
        "label", "p", F.col("w.place").alias("place"),
        (F.col("w.position") - F.col("upto") + F.col("n")).alias("nth"),
    ).collect()
    if not places:
        return {}
    inside = keyed.where(_any_of((F.col("label") == r["label"]) & (F.col("p") == r["p"]) for r in places))
    numbered = with_running(inside, ["label", "p"], ["k", row_id], __nth=running_sum(F.lit(1)))
    hits = numbered.where(_any_of(
        (F.col("label") == r["label"]) & (F.col("p") == r["p"]) & (F.col("__nth") == r["nth"]) for r in places
    )).collect()
    key_at = {(r["label"], r["p"], r["__nth"]): r["k"] for r in hits}
    return {(r["label"], r["place"]): key_at[r["label"], r["p"], r["nth"]] for r in places}


def stratified_split(df, ratios=(0.6, 0.2), seed=42, row_id="row_id"):
    """train / validation / test per class, with exactly int(n * ratio) rows in the first two parts.

    The rows are labelled by two comparisons; nothing is sorted or shuffled.
    """
    if min(ratios) <= 0 or sum(ratios) >= 1:
        raise ValueError("ratios must be positive and add up to less than one")
    cuts = _cuts(df, seed, ratios, row_id)
    key = shuffle_key(seed, row_id)

    def below(place):
        return _any_of((F.col("label") == label) & (key <= cuts.get((label, place), "")) for label in (0, 1))

    return df.withColumn("split", F.when(below(0), "train").when(below(1), "validation").otherwise("test"))


def domain_folds(df, folds=5, seed=42, group="apex_domain", limit=ROWS_PER_TASK):
    """Fold number of every domain.

    Domains are ranked by size within their majority class and dealt back and forth over the folds, so
    folds differ by at most one domain per class and large domains spread out. Domains stay whole.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    sizes = df.groupBy(group).agg(
        F.count_if(F.col("label") == 0).alias("benign"),
        F.count_if(F.col("label") == 1).alias("attack"),
        F.count(F.lit(1)).alias("rows"),
    ).persist()  # one row per domain, read by each of the checks below
    if not sizes.where("benign + attack <> rows").isEmpty():
        raise DataError("labels must be 0 or 1")
    domains = sizes.withColumns({
        "majority": F.when(F.col("attack") > F.col("benign"), 1).otherwise(0),
        "__size": -F.col("rows"),
        "__tie": shuffle_key(seed, group),
    })
    per_class = {r["majority"]: r["n"] for r in domains.groupBy("majority").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(per_class.get(0, 0), per_class.get(1, 0)) < folds:
        raise DataError(f"each class needs at least {folds} domains")
    ranked = with_running(domains, ["majority"], ["__size", "__tie", group], limit=limit, __rank=running_sum(F.lit(1)))
    place = (F.col("__rank") - 1) % folds
    back = F.floor((F.col("__rank") - 1) / folds) % 2 == 1
    return ranked.select(
        group, "benign", "attack", "rows", "majority",
        F.when(back, folds - 1 - place).otherwise(place).cast("int").alias("fold"),
    )


def require_both_classes(fold_map):
    """Every fold must hold rows of both classes."""
    sums = fold_map.groupBy("fold").agg(F.sum("benign").alias("benign"), F.sum("attack").alias("attack"))
    bad = sums.where("benign = 0 OR attack = 0").limit(1).collect()
    if bad:
        raise DataError(f"fold {bad[0]['fold']} does not hold both classes")
    return fold_map


def split_by_domain(df, seed=42, group="apex_domain"):
    """Domain-disjoint split over five folds: fold 0 tests, fold 1 validates, the rest trains."""
    fold_map = require_both_classes(domain_folds(df, 5, seed, group))
    named = fold_map.select(
        group,
        F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "validation").otherwise("train").alias("split"),
    )
    return df.join(named, group).select(*df.columns, "split")
