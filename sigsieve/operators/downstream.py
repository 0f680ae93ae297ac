"""Downstream model comparison (V19, V20) with pyspark.ml.

Each preset pipeline yields one feature vector per file (V18); files carry a
binary label; a balanced 200-tree random forest is scored with stratified k-fold
cross-validation (k = min(5, smallest class)).  Folds are dealt by
``validate.deal_folds``; each fold is one distributed fit.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .validate import balanced, deal_folds


def evaluate_table(tab: DataFrame, pipeline: str, label: str = "label", seed: int = 42, trees: int = 200) -> dict:
    feats = [c for c in tab.columns if c not in (label, "file", "pipeline")]
    counts = {r[label]: r["n"] for r in tab.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_files = sum(counts.values())
    if n_files == 0:
        return {"pipeline": pipeline, "status": "no_data"}
    if len(counts) < 2:
        return {"pipeline": pipeline, "status": "only_one_class", "n_files": n_files}
    min_class = min(counts.values())
    if n_files < 6 or min_class < 2:
        return {"pipeline": pipeline, "status": "too_few_files_for_cv", "n_files": n_files}
    k = min(5, int(min_class))
    # mean-impute and clean infinities per column, as before model fitting
    means = tab.agg(*[F.avg(c).alias(c) for c in feats]).first()
    x = tab.select("file", label, *[F.coalesce(F.col(c), F.lit(means[c] if means[c] is not None else 0.0)).alias(c)
                                    for c in feats])
    x = deal_folds(x, ["file"], k, label).withColumnRenamed("fold", "_fold")
    x = materialize(VectorAssembler(inputCols=feats, outputCol="features").transform(x).select(
        F.col(label).cast("double").alias("label"), "features", "_fold"))
    acc, f1, auc = [], [], []
    for fold in range(k):
        train, test = balanced(x.where(F.col("_fold") != fold), "label"), x.where(F.col("_fold") == fold)
        rf = RandomForestClassifier(weightCol="weight", numTrees=trees, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=1)
        pred = rf.fit(train).transform(test)
        m = pred.agg(F.count_if(F.col("prediction") == F.col("label")).alias("ok"), F.count(F.lit(1)).alias("n"),
                     F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("tp"),
                     F.count_if((F.col("prediction") == 1) & (F.col("label") == 0)).alias("fp"),
                     F.count_if((F.col("prediction") == 0) & (F.col("label") == 1)).alias("fn")).first()
        acc.append(m["ok"] / m["n"])
        den = 2 * m["tp"] + m["fp"] + m["fn"]
        f1.append(2 * m["tp"] / den if den else 0.0)
        try:
            auc.append(BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(pred))
        except Exception:  # noqa: BLE001  (a fold with one class has no AUC)
            auc.append(float("nan"))

    def ms(v):
        v = [a for a in v if not math.isnan(a)]
        if not v:
            return None, None
        mu = sum(v) / len(v)
        return mu, math.sqrt(sum((a - mu) ** 2 for a in v) / len(v))

    (am, asd), (fm, fsd), (um, usd) = ms(acc), ms(f1), ms(auc)
    return {"pipeline": pipeline, "status": "ok", "n_files": n_files, "n_features": len(feats), "n_splits": k,
            "accuracy_mean": am, "accuracy_std": asd, "f1_mean": fm, "f1_std": fsd, "auc_mean": um, "auc_std": usd}
