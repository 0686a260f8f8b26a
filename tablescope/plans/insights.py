"""Findings drawn from analysis results, one row each.

All functions return ``position, code, subject, detail, value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablescope.functions.stats import strength_word

INSIGHTS = "position int, code string, subject string, detail string, value double"
CLASS_IMBALANCE = 3


def _rows(spark, rows) -> DataFrame:
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], INSIGHTS)


def correlation_insights(x: str, y: str, result: DataFrame, extremes: DataFrame) -> DataFrame:
    """Direction and strength, then the groups with extreme means."""
    r, e = result.first(), extremes.first()
    direction = "direct" if r["coefficient"] > 0 else "inverse"
    rows = [("relation", f"{x} ~ {y}", f"{strength_word(r['coefficient'])} {direction}", r["coefficient"])]
    if e and e["lowest_label"] is not None:
        rows.append(("highest_group", y, e["highest_label"], e["highest_y"]))
        rows.append(("lowest_group", y, e["lowest_label"], e["lowest_y"]))
    rows.append(("not_causal", f"{x} ~ {y}", "correlation does not prove a cause", None))
    return _rows(result.sparkSession, rows)


def regression_insights(x: str, y: str, result: DataFrame, extremes: DataFrame) -> DataFrame:
    r, e = result.first(), extremes.first()
    rows = [("slope", f"{x} -> {y}", r["direction"], r["slope"]), ("fit", f"{x} -> {y}", r["fit"], r["r2"])]
    if e and e["highest_label"] is not None:
        rows.append(("highest_group", y, e["highest_label"], e["highest_y"]))
    return _rows(result.sparkSession, rows)


def ranking_insights(target: str, ranking: DataFrame, method: str = "pearson") -> DataFrame:
    top = ranking.take(3)
    if not top:
        return _rows(ranking.sparkSession, [("nothing_found", target, method, None)])
    best = top[0]
    direction = "direct" if best["coefficient"] >= 0 else "inverse"
    rows = [("strongest", best["feature"], direction, best["coefficient"]), ("method", target, method, None)]
    if len(top) == 3:
        rows.append(("first_candidates", target, ",".join(r["feature"] for r in top), None))
    return _rows(ranking.sparkSession, rows)


def model_verdict(
    metrics: DataFrame,
    importance: DataFrame,
    class_distribution: DataFrame | None = None,
) -> DataFrame:
    """Best model, class imbalance and the most important feature."""
    classify = "balanced_accuracy" in metrics.columns
    score = "balanced_accuracy" if classify else "r2"
    best = max(metrics.select("model", score).collect(), key=lambda r: r[score])  # two models
    rows = [("best_model", best["model"], score, best[score])]
    if classify and class_distribution is not None:
        counts = class_distribution.selectExpr("max(rows_count) hi", "min(rows_count) lo").first()
        if counts["lo"] and counts["hi"] / counts["lo"] >= CLASS_IMBALANCE:
            rows.append(("class_imbalance", "", "prefer balanced accuracy and macro F1", counts["hi"] / counts["lo"]))
    top = importance.first()
    if top:
        rows.append(("top_feature", top["feature"], "importance", top["importance"]))
    return _rows(metrics.sparkSession, rows)
