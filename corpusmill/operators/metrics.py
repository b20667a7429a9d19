"""Calibration and metrics over scores.

Rows are first counted per distinct score (and group), so ranks and curves see a
score once, and cumulated in buckets where a whole table is ordered.
Labels are 0 and 1; rows with another label are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import running_totals
from corpusmill.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg)."""
    pos, neg = F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg")
    return df.filter(F.col("label").isin(0, 1) & F.col("score").isNotNull()).groupBy(*(by or []), "score").agg(pos, neg)


def curve(df: DataFrame) -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg, n_pos, n_neg) from the highest score down."""
    c = materialize(counts(df), "scores")  # a row for each distinct score; read for the bounds, the totals and the sums
    total = c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return running_totals(c, "score", ["pos", "neg"], descending=True).crossJoin(F.broadcast(total))  # one row on the right


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null for a single class."""
    if by:
        c = counts(df, by)
        below = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("__below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
        area = F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / F.lit(2.0).cast("double")))
        return c.groupBy(*by).agg(F.round(_ratio(area, F.sum("pos") * F.sum("neg")), 9).alias("auc"))
    c = curve(df)
    area = F.sum(F.col("pos") * (F.col("n_neg") - F.col("cum_neg") + F.col("neg") / F.lit(2.0).cast("double")))
    return c.agg(F.round(_ratio(area, F.max("n_pos") * F.max("n_neg")), 9).alias("auc"))


def _points(df: DataFrame) -> DataFrame:
    """fpr, tpr and the point before, for each distinct score."""
    c = curve(df)
    x, y = _ratio(F.col("cum_neg"), F.col("n_neg")), _ratio(F.col("cum_pos"), F.col("n_pos"))
    x0, y0 = _ratio(F.col("cum_neg") - F.col("neg"), F.col("n_neg")), _ratio(F.col("cum_pos") - F.col("pos"), F.col("n_pos"))
    return c.select("score", x.alias("fpr"), y.alias("tpr"), x0.alias("fpr0"), y0.alias("tpr0"))


def partial_auc(df: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """Standardised partial area up to max_fpr (McClish)."""
    p = _points(df).filter(F.col("fpr0") < max_fpr)
    right = F.least("fpr", F.lit(max_fpr))
    share = F.when(F.col("fpr") > F.col("fpr0"), (right - F.col("fpr0")) / (F.col("fpr") - F.col("fpr0"))).otherwise(F.lit(0.0))
    y = F.col("tpr0") + share * (F.col("tpr") - F.col("tpr0"))
    area, least = F.sum((right - F.col("fpr0")) * (F.col("tpr0") + y) / 2), max_fpr * max_fpr / 2
    return p.agg(F.round(F.lit(0.5) * (1 + (area - least) / (max_fpr - least)), 9).alias("pauc"))


def average_precision(df: DataFrame) -> DataFrame:
    c = curve(df)
    return c.agg(F.round(F.sum(_ratio(F.col("pos"), F.col("n_pos")) * _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))), 9).alias("ap"))


def threshold_at(df: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """(by, cut): the negative score at place floor(target * n) from the top; alarms are scores strictly above it.

    Null where target * n reaches all negatives: then every score is an alarm.
    """
    c = counts(df, by).filter("neg > 0")
    keys = by or []
    if by:
        w = Window.partitionBy(*by)
        c = c.withColumns({"cum_neg": F.sum("neg").over(w.orderBy(F.col("score").desc())), "n_neg": F.sum("neg").over(w)})
    else:
        c = materialize(c, "scores")
        total = c.agg(F.sum("neg").alias("n_neg"))
        c = running_totals(c, "score", ["neg"], descending=True).crossJoin(F.broadcast(total))  # one row on the right
    place = F.floor(F.col("n_neg") * target)
    return c.groupBy(*keys).agg(F.max(F.when((F.col("cum_neg") > place) & (F.col("cum_neg") - F.col("neg") <= place), F.col("score"))).alias("cut"))


def confusion(df: DataFrame, alarm: Column, by: list[str] | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn, fpr, tpr, precision, f1, accuracy, balanced); rates without a base are null, precision without alarms is 0."""
    d = df.withColumn("__a", alarm).filter(F.col("label").isin(0, 1))
    cell = lambda y, a: F.sum(((F.col("label") == y) & (F.col("__a") == a)).cast("long"))
    g = d.groupBy(*(by or [])).agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    fpr, tpr = _ratio(fp, fp + tn), _ratio(tp, tp + fn)
    r = lambda c: F.round(c, 9)
    return g.withColumns({
        "fpr": r(fpr), "tpr": r(tpr), "precision": r(F.coalesce(_ratio(tp, tp + fp), F.lit(0.0))), "f1": r(F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))),
        "accuracy": r(_ratio(tp + tn, tp + fp + fn + tn)), "balanced": r((tpr + 1 - fpr) / 2),
    })


def with_cut(df: DataFrame, cut: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with the alarm of each row under its threshold (a row for each group, or one row)."""
    d = df.join(F.broadcast(cut), by, "left") if by else df.crossJoin(F.broadcast(cut))
    return d.withColumn("alarm", F.when(F.col("score").isNotNull(), F.coalesce(F.col("score") > F.col("cut"), F.lit(True))))  # no score, no verdict


def multiclass(df: DataFrame) -> DataFrame:
    """(accuracy, balanced, macro_f1) of label and predicted, over the labels that occur."""
    c = df.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    rows = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    j = rows.join(cols, "label", "left").withColumn("called", F.coalesce("called", F.lit(0)))
    return j.agg(
        F.round(_ratio(F.sum("tp"), F.sum("support")), 9).alias("accuracy"),
        F.round(F.avg(_ratio(F.col("tp"), F.col("support"))), 9).alias("balanced"),
        F.round(F.avg(_ratio(2 * F.col("tp"), F.col("support") + F.col("called"))), 9).alias("macro_f1"),
    )


def recall_at_fpr(df: DataFrame, target: float) -> DataFrame:
    """(interpolated, at_or_below): recall at a false-positive rate, on the line between the curve's points around it, and at the last point that doesn't pass it."""
    p = materialize(_points(df), "curve")
    last = p.filter(F.col("fpr") <= target).agg(F.max(F.struct("fpr", "tpr")).alias("a"))
    after = p.filter(F.col("fpr") > target).agg(F.min(F.struct("fpr", "tpr")).alias("b"))
    j = last.crossJoin(F.broadcast(after))  # one row on each side
    x0, y0 = F.coalesce("a.fpr", F.lit(0.0)), F.coalesce("a.tpr", F.lit(0.0))
    line = y0 + (F.lit(target) - x0) * (F.col("b.tpr") - y0) / (F.col("b.fpr") - x0)
    return j.select(F.round(F.coalesce(line, y0), 9).alias("interpolated"), F.round(y0, 9).alias("at_or_below"))


def class_gap(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, cut): the midpoint between the highest negative and the lowest positive score; null where the classes overlap or one is missing."""
    g = df.groupBy(*by).agg(F.max(F.when(F.col("label") == 0, F.col("score"))).alias("__n"), F.min(F.when(F.col("label") == 1, F.col("score"))).alias("__p"))
    return g.select(*by, F.round(F.when(F.col("__n") < F.col("__p"), (F.col("__n") + F.col("__p")) / 2), 9).alias("cut"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """(label, predicted, n) for each pair of labels that occurs, and each label's recall."""
    c = df.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    whole = c.groupBy("label").agg(F.sum("n").alias("__s"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("__tp"))
    return c.join(whole, "label").select("label", "predicted", "n", F.round(_ratio(F.col("__tp"), F.col("__s")), 9).alias("recall"))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """(n, top) of rows (id, label, scores: array<struct<name, score>>): the share whose label is among the k highest scores, ties to the later name. Nothing is shuffled but counts."""
    best = F.slice(F.array_sort(F.transform("scores", lambda x: F.struct((-x["score"]).alias("score"), x["name"].alias("name"))), lambda a, b: F.when(a["score"] < b["score"], -1).when(a["score"] > b["score"], 1).when(a["name"] > b["name"], -1).when(a["name"] < b["name"], 1).otherwise(0)), 1, k)
    hit = F.exists(best, lambda x: x["name"] == F.col("label"))
    return df.agg(F.count("*").alias("n"), F.round(_ratio(F.count_if(hit), F.count("*")), 9).alias("top"))


def selection_score(df: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """(score): 0.7 of the standardised partial area and 0.3 of the whole."""
    both = partial_auc(df, max_fpr).crossJoin(F.broadcast(roc_auc(df)))  # one row on each side
    return both.select(F.round(0.7 * F.col("pauc") + 0.3 * F.col("auc"), 9).alias("score"))
