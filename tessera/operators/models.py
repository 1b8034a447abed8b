"""Candidate models, out-of-fold stacking and distillation with pyspark.ml. Driver loops run over models and folds, never rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import classification as MC
from pyspark.ml import clustering as ML
from pyspark.ml import regression as MR
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.split import class_weight, k_fold, stratified_split
from tessera.sources.shared import written


def classifiers(seed: int) -> dict:
    """The pool by name: each takes `features`, `y` and the balanced `weight`."""
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    return {
        "forest": MC.RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "boosted": MC.GBTClassifier(maxIter=8, maxDepth=3, seed=seed, **common),
        "logistic": MC.LogisticRegression(regParam=0.01, maxIter=20, **common),
        "tree": MC.DecisionTreeClassifier(maxDepth=5, seed=seed, **common),
    }


def regressors(seed: int) -> dict:
    common = {"featuresCol": "features", "labelCol": "y"}
    return {
        "forest": MR.RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed, **common),
        "boosted": MR.GBTRegressor(maxIter=10, maxDepth=4, seed=seed, **common),
        "boosted_abs": MR.GBTRegressor(maxIter=10, maxDepth=4, lossType="absolute", seed=seed, **common),
        "ridge": MR.LinearRegression(regParam=1.0, elasticNetParam=0.0, **common),
        "lasso": MR.LinearRegression(regParam=1.0, elasticNetParam=1.0, **common),
        "elastic": MR.LinearRegression(regParam=1.0, elasticNetParam=0.5, **common),
        "huber": MR.LinearRegression(loss="huber", regParam=0.1, **common),
        "poisson": MR.GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, maxIter=25, **common),
    }


@dataclass(frozen=True)
class LogTarget:
    """A regressor of log(1 + y), its predictions taken back; for targets that are never negative."""

    inner: object

    def fit(self, df: DataFrame) -> LogTargetModel:
        return LogTargetModel(self.inner.fit(df.withColumn("y", F.log1p(F.col("y").cast("double")))))


@dataclass(frozen=True)
class LogTargetModel:
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", F.expm1("prediction"))


def with_log_targets(pool: dict, first: int = 5) -> dict:
    """The pool and, after it, the first ones on a logarithmic target."""
    return pool | {f"log1p_{n}": LogTarget(m) for n, m in list(pool.items())[:first]}


def assembled(df: DataFrame, features: list[str], scale: bool = False) -> DataFrame:
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    if scale:
        out = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True).fit(out).transform(out).drop("features").withColumnRenamed("_scaled", "features")
    return out


def from_array(df: DataFrame, values: str) -> DataFrame:
    """features: the whole array, each place standardised over the table; its width is what the rows have."""
    out = df.withColumn("_raw", array_to_vector(F.col(values).cast("array<double>")))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(out).transform(out).drop("_raw", values)


def scored(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and p: the positive class's probability, or the prediction of a regressor."""
    out = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*keep, p.alias("p"))


def together(tasks: dict, workers: int = 4) -> tuple[dict, dict]:
    """(results, errors) of functions by key, some of them at a time: each starts Spark jobs of its own, and one that raises stops no other."""
    results, errors = {}, {}
    with ThreadPoolExecutor(max_workers=max(1, workers)) as threads:
        inherit = inheritable_thread_target(SparkSession.getActiveSession())
        running = {key: threads.submit(inherit(task)) for key, task in tasks.items()}
        for key, future in running.items():
            try:
                results[key] = future.result()
            except Exception as e:  # noqa: BLE001 - whatever a model raises
                errors[key] = e
    return results, errors


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200]


def scored_wide(models: dict, df: DataFrame, keep: list[str], log: list[tuple[str, str]] | None = None) -> DataFrame:
    """keep and a column of scores a model, each row under all of them in one pass; one that cannot predict has no column, and goes with why into log, if given, else it is an error."""
    names, out = [], df
    for i, (name, model) in enumerate(models.items()):
        try:
            out = scored(model, out, [*out.columns]).withColumnRenamed("p", f"_score{i}")
        except Exception as e:  # noqa: BLE001 - a model that cannot predict
            if log is None:
                raise
            log.append((name, _reason(e)))
            continue
        names.append(F.col(f"_score{i}").alias(name))
    return out.select(*keep, *names)


def fit_pool(pool: dict, fit: DataFrame, other: DataFrame, keep: list[str], log: list[tuple[str, str]] | None = None, workers: int = 4) -> DataFrame:
    """Long predictions (keep, model, p) on `other` by each model of the pool, fitted `workers` at a time.

    One that cannot be fitted is left out, and goes with why into log, if given; if none can be, it is an error.
    """
    fitted, errors = together({name: (lambda e=estimator: e.fit(fit)) for name, estimator in pool.items()}, workers)
    out = None
    for name in pool:
        if name in fitted:
            try:
                part = scored(fitted[name], other, keep).withColumn("model", F.lit(name))
            except Exception as e:  # noqa: BLE001 - a model that cannot predict
                errors[name] = e
                continue
            out = part if out is None else out.unionByName(part)
    if log is not None:
        log += [(name, _reason(errors[name])) for name in pool if name in errors]
    if out is None:
        raise ValueError(f"no model could be fitted: {({n: _reason(e) for n, e in errors.items()})}")
    return out


def candidate_table(predictions: DataFrame, by: list[str]) -> DataFrame:
    """auc, brier and log_loss of each model and split: one pass a metric for all of them."""
    return M.roc_auc(predictions, by=by).join(M.probability_scores(predictions, by=by), by)


def out_of_fold(pool: dict, df: DataFrame, row_id: str, k: int, seed: int, target: str | None = "y", log: list[tuple[str, str]] | None = None, workers: int = 4) -> DataFrame:
    """Long predictions (row_id, y, model, p) where each row's model never saw the row's fold; models and folds are fitted `workers` at a time.

    A model that cannot be fitted on some fold is left out of all, and goes with why into log, if given.
    """
    folded = written(k_fold(df, k, seed, row_id, target), "folds")
    fitted, errors = together({(name, fold): (lambda e=e, fold=fold: e.fit(folded.where(F.col("fold") != fold))) for name, e in pool.items() for fold in range(k)}, workers)
    failed = {name: e for (name, _), e in reversed(errors.items())}
    if log is not None:
        log += [(name, _reason(failed[name])) for name in pool if name in failed]
    out = None
    for (name, fold), model in fitted.items():
        if name not in failed:
            part = scored(model, folded.where(F.col("fold") == fold), [row_id, "y"]).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no model could be fitted on all folds: {({n: _reason(e) for n, e in failed.items()})}")
    return written(out, "out-of-fold")


def out_of_fold_wide(pool: dict, df: DataFrame, row_id: str, k: int, seed: int, target: str | None = "y", log: list[tuple[str, str]] | None = None, workers: int = 4) -> DataFrame:
    """The same as a table with a column a model: the models of a fold score its rows in one pass, so nothing is pivoted."""
    folded = written(k_fold(df, k, seed, row_id, target), "folds")
    fitted, errors = together({(name, fold): (lambda e=e, fold=fold: e.fit(folded.where(F.col("fold") != fold))) for name, e in pool.items() for fold in range(k)}, workers)
    failed = {name: e for (name, _), e in reversed(errors.items())}
    if log is not None:
        log += [(name, _reason(failed[name])) for name in pool if name in failed]
    names = [n for n in pool if n not in failed]
    if not names:
        raise ValueError(f"no model could be fitted on all folds: {({n: _reason(e) for n, e in failed.items()})}")
    out = None
    for fold in range(k):
        part = scored_wide({n: fitted[n, fold] for n in names}, folded.where(F.col("fold") == fold), [row_id, "y"])
        out = part if out is None else out.unionByName(part)
    return written(out, "out-of-fold")


def wide(long: DataFrame, row_id: str, models: list[str]) -> DataFrame:
    return long.groupBy(row_id, "y").pivot("model", models).agg(F.first("p"))


def meta_classifier(train: DataFrame, names: list[str], regularisation: float = 0.01):
    """A balanced logistic meta model on prediction columns of a table with y."""
    return MC.LogisticRegression(featuresCol="features", labelCol="y", regParam=regularisation, maxIter=20, weightCol="weight").fit(class_weight(assembled(train, names), "y"))


def tuned_meta_classifier(train: DataFrame, names: list[str], row_id: str, k: int = 5, repeats: int = 1, seed: int = 42, grid: tuple[float, ...] = (0.1, 0.01, 0.001)):
    """The same with the strength of regularisation of the least log loss over (repeated) stratified folds."""
    table_ = written(assembled(train, names), "meta-features")
    losses = dict.fromkeys(grid, 0.0)
    for repeat in range(repeats):
        folded = written(k_fold(class_weight(table_, "y"), k, seed + repeat, row_id, "y"), "meta-folds")
        for c in grid:
            parts = None
            for fold in range(k):
                model = MC.LogisticRegression(featuresCol="features", labelCol="y", regParam=c, maxIter=20, weightCol="weight").fit(folded.where(F.col("fold") != fold))
                part = scored(model, folded.where(F.col("fold") == fold), ["y"])
                parts = part if parts is None else parts.unionByName(part)
            losses[c] += M.probability_scores(parts).first()["log_loss"]
    return meta_classifier(train, names, min(grid, key=lambda c: (losses[c], -c)))


def _bases(pool: dict, fit: DataFrame, test: DataFrame, row_id: str, k: int, seed: int, target: str | None) -> tuple[list[str], DataFrame, DataFrame]:
    """(names of the bases that could be fitted throughout, their out-of-fold predictions, those on test), a column a base; fitted one by one, so that sums come in the same order each time."""
    log: list[tuple[str, str]] = []
    oof = out_of_fold_wide(pool, fit, row_id, k, seed, target, log, workers=1)
    names = [n for n in pool if n not in dict(log)]
    fitted, errors = together({n: (lambda e=pool[n]: e.fit(fit)) for n in names}, workers=1)
    on_test = scored_wide({n: fitted[n] for n in names if n in fitted}, test, [row_id, "y"], log)
    names = [n for n in names if n in on_test.columns[2:]]
    if not names:
        raise ValueError(f"no model could be fitted: {dict(log) | {n: _reason(e) for n, e in errors.items()}}")
    return names, oof.select(row_id, "y", *names), on_test


def stack(pool: dict, fit: DataFrame, test: DataFrame, row_id: str, k: int = 5, seed: int = 42, tune: bool = True) -> DataFrame:
    """row_id, y, p on test: a logistic meta model on out-of-fold probabilities, bases refitted on all of fit.

    Test labels are carried but never used, so changing them changes nothing else. Out-of-fold predictions are a written
    table, as the meta model reads them several times. Bases that cannot be fitted are left out; stacking.stack_binary
    names them, scales, searches, calibrates and sets a threshold.
    """
    names, oof, on_test = _bases(pool, fit, test, row_id, k, seed, "y")
    meta = tuned_meta_classifier(oof, names, row_id, k, seed=seed) if tune else meta_classifier(oof, names)
    return scored(meta, assembled(on_test, names), [row_id, "y"])


def stack_regression(pool: dict, fit: DataFrame, test: DataFrame, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The same with a ridge meta model."""
    names, oof, on_test = _bases(pool, fit, test, row_id, k, seed, None)
    meta = MR.LinearRegression(featuresCol="features", labelCol="y", regParam=1.0).fit(assembled(oof, names))
    return scored(meta, assembled(on_test, names), [row_id, "y"])


def stack_given(train: DataFrame, test: DataFrame, names: list[str], row_id: str, regression: bool = False) -> DataFrame:
    """row_id, y, p of a meta model on given prediction columns: balanced logistic or ridge; a single column passes through."""
    if len(names) == 1:
        return test.select(row_id, "y", F.col(names[0]).alias("p"))
    if regression:
        meta = MR.LinearRegression(featuresCol="features", labelCol="y", regParam=1.0).fit(assembled(train, names))
    else:
        meta = meta_classifier(train, names)
    return scored(meta, assembled(test, names), [row_id, "y"])


def stack_cached(val: DataFrame, test: DataFrame, names: list[str], row_id: str, cut: float = 0.995, most: int = 5) -> tuple[list[str], DataFrame]:
    """(columns taken, stack_given by them): cached predictions in ranked order, without near copies of one taken before; fitted on validation."""
    from tessera.operators.tables import greedy_uncorrelated

    taken = greedy_uncorrelated(val, names, cut, most)
    return taken, stack_given(val, test, taken, row_id)


def class_probabilities(model, df: DataFrame, keep: list[str], classes: int) -> DataFrame:
    """keep and p, the array of class probabilities."""
    return model.transform(df).select(*keep, F.slice(vector_to_array("probability"), 1, classes).alias("p"))


def multiclass_pool(seed: int) -> dict:
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    return {
        "forest": MC.RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "logistic": MC.LogisticRegression(family="multinomial", regParam=0.01, maxIter=20, **common),
        "tree": MC.DecisionTreeClassifier(maxDepth=5, seed=seed, **common),
    }


def fit_multiclass(pool: dict, fit: DataFrame, other: DataFrame, keep: list[str], classes: int) -> DataFrame:
    """Long predictions (keep, model, p: an array a class) on `other`."""
    out = None
    for name, estimator in pool.items():
        part = class_probabilities(estimator.fit(fit), other, keep, classes).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stack_multiclass(pool: dict, fit: DataFrame, test: DataFrame, row_id: str, classes: int, k: int = 5, seed: int = 42) -> DataFrame:
    """row_id, y, p (array) and label on test: blocks of class probabilities of out-of-fold bases feed a multinomial meta model.

    y is a class code from 0 to classes - 1; codes are the places of p, so bases that miss a class in a fold stay aligned.
    """
    folded, oof = written(k_fold(fit, k, seed, row_id, "y"), "folds"), None
    for fold in range(k):
        part = fit_multiclass(pool, folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold), [row_id, "y"], classes)
        oof = part if oof is None else oof.unionByName(part)

    def blocks(long: DataFrame) -> DataFrame:
        pivoted = long.groupBy(row_id, "y").pivot("model", list(pool)).agg(F.first("p"))
        padded = lambda m: F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0.0)))
        return pivoted.withColumn("features", array_to_vector(F.flatten(F.array(*[padded(m) for m in pool])))).drop(*pool)

    train = written(class_weight(blocks(oof), "y"), "stack-features")
    meta = MC.LogisticRegression(family="multinomial", featuresCol="features", labelCol="y", weightCol="weight", regParam=0.01, maxIter=30).fit(train)
    out = class_probabilities(meta, blocks(fit_multiclass(pool, fit, test, [row_id, "y"], classes)), [row_id, "y"], classes)
    return out.withColumn("label", F.array_position("p", F.array_max("p")).cast("int") - 1)


def repeated_holdout(df: DataFrame, score, row_id: str, target: str, repeats: int, seed: int, val_size: float = 0.25) -> DataFrame:
    """repeat and score(train, val) over stratified re-splits of a development set, seeds from `seed`."""
    rows = []
    for r in range(repeats):
        parts = written(stratified_split(df, target, val_size, seed + r, row_id, ("train", "val")), "holdout")
        rows.append((r, float(score(parts.where("split = 'train'"), parts.where("split = 'val'")))))
    return df.sparkSession.createDataFrame(rows, "repeat int, score double")


def revise(base: dict, neighbours: list[dict], score, higher: bool = True) -> tuple[dict, list[tuple[dict, float, bool]]]:
    """(parameters kept, every try with its score and whether it was kept): a neighbour is kept only if it improves the validation score."""
    best, tried = base, [(base, float(score(base)), True)]
    value = tried[0][1]
    for change in neighbours:
        candidate = best | change
        found = float(score(candidate))
        better = found > value if higher else found < value
        tried.append((candidate, found, better))
        if better:
            best, value = candidate, found
    return best, tried


def first_usable(candidates: list[tuple[str, object]], build, usable, fallback: list[tuple[str, object]]) -> tuple[str, object, list[tuple[str, str]]]:
    """(name, result, log) of the first ranked candidate that builds and is usable; then of the fallback ones; an error if none is.

    The log has a row a candidate that was tried: used, unusable, or its error.
    """
    log: list[tuple[str, str]] = []
    for name, candidate in [*candidates, *fallback]:
        try:
            result = build(candidate)
        except Exception as e:  # noqa: BLE001 - a candidate that fails is passed over
            log.append((name, type(e).__name__))
            continue
        if usable(result):
            log.append((name, "used"))
            return name, result, log
        log.append((name, "unusable"))
    raise ValueError(f"no candidate is usable: {log}")


def with_and_without(df: DataFrame, base: list[str], added: list[str], row_id: str, keys: dict[str, str], seed: int = 42) -> DataFrame:
    """keys, method (base, generated), accuracy: the same model fitted on the training rows without and with added features."""
    out = None
    for method, features in (("base", base), ("generated", [*base, *added])):
        parts = written(assembled(df, features).select(row_id, "y", "split", "features"), "method")
        model = MC.RandomForestClassifier(numTrees=10, maxDepth=4, seed=seed, featuresCol="features", labelCol="y").fit(parts.where("split <> 'test'"))
        row = M.confusion(scored(model, parts.where("split = 'test'"), [row_id, "y"])).select("accuracy")
        row = row.select(*[F.lit(v).alias(k) for k, v in keys.items()], F.lit(method).alias("method"), "accuracy")
        out = row if out is None else out.unionByName(row)
    return out


def distill(teacher: DataFrame, student, fit: DataFrame, test: DataFrame, row_id: str) -> DataFrame:
    """row_id, y, p of a student that learns the teacher's hard labels (p >= 0.5), or the true ones if those are all alike."""
    labelled = fit.drop("y").join(teacher.select(row_id, (F.col("p") >= 0.5).cast("int").alias("y")), row_id)
    kinds = labelled.agg(F.count_distinct("y")).first()[0]
    return scored(student.fit(labelled if kinds > 1 else fit), test, [row_id, "y"])


def distill_regression(teacher: DataFrame, student, fit: DataFrame, test: DataFrame, row_id: str, share: float = 0.5) -> DataFrame:
    """The student learns (1 - share) * y + share * teacher."""
    mixed = fit.join(teacher.select(row_id, F.col("p").alias("_t")), row_id).withColumn("y", (1 - share) * F.col("y") + share * F.col("_t")).drop("_t")
    return scored(student.fit(mixed), test, [row_id, "y"])


def clusterers(k: int, seed: int) -> dict:
    return {
        "kmeans": ML.KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label"),
        "bisecting": ML.BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="label"),
        "mixture": ML.GaussianMixture(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="label"),
    }


def light_clusterers(k: int, seed: int) -> dict:
    """Clusterers that see a row once or less."""
    from tessera.operators.batches import Birch, MiniBatchKMeans

    return {"minibatch": MiniBatchKMeans(k, seed), "birch": Birch(k, seed)}


def teacher_candidates(fit: DataFrame, val: DataFrame, truth: str, sizes: list[int], seed: int) -> DataFrame:
    """candidate, k, ari, nmi, rand on validation of every clusterer and size; the input of a ranking."""
    out = None
    for k in sizes:
        for name, estimator in (clusterers(k, seed) | light_clusterers(k, seed)).items():
            labelled = estimator.fit(fit).transform(val)
            row = M.label_scores(M.contingency(labelled, truth, "label"), truth, "label").select(F.lit(name).alias("candidate"), F.lit(k).alias("k"), "ari", "nmi", "rand")
            out = row if out is None else out.unionByName(row)
    return out


def raw_or_scaled(df: DataFrame, raw: str, truth: str, k: int, seed: int) -> tuple[str, DataFrame]:
    """(raw or scaled, ari of both): standardised features only if k-means agrees better with the truth on them."""
    out = None
    for name in ("raw", "scaled"):
        v = df.withColumnRenamed(raw, "features") if name == "raw" else StandardScaler(inputCol=raw, outputCol="features", withMean=True).fit(df).transform(df)
        labelled = clusterers(k, seed)["kmeans"].fit(v).transform(v)
        row = M.label_scores(M.contingency(labelled, truth, "label"), truth, "label").select(F.lit(name).alias("features"), "ari")
        out = row if out is None else out.unionByName(row)
    out = written(out, "features-ari")
    return out.orderBy(F.desc("ari"), "features").first()["features"], out


def importances(df: DataFrame, features: list[str], seed: int = 42) -> dict[str, float]:
    """A forest's importance of each feature of a table with y."""
    model = MC.RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, featuresCol="features", labelCol="y").fit(assembled(df, features))
    return dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))
