"""Training: a logistic baseline on MLlib and boosted trees, with imbalance-aware weights and a threshold from the validation rows."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .boosting import Boosted, Options, boost
from .features import LABEL, categorical, feature_names, select_features

MOST_DAMPED = 50.0


def class_weight(negatives: int, positives: int, mode: str = "ratio") -> float:
    """Weight of a positive row: negatives / positives, its root (at most 50), or 1; 1 without positives."""
    if mode not in ("ratio", "sqrt_damping", "unweighted"):
        raise ValueError(f"unknown weighting {mode}")
    if mode == "unweighted" or not positives:
        return 1.0
    ratio = negatives / positives
    return min(math.sqrt(ratio), MOST_DAMPED) if mode == "sqrt_damping" else ratio


def _pipeline(kind: str, numeric: list[str], strings: list[str]) -> Pipeline:
    imputed, index, hot = [f"{c}__i" for c in numeric], [f"{c}__x" for c in strings], [f"{c}__h" for c in strings]
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=imputed)] if numeric else []
    if strings:
        stages.append(StringIndexer(inputCols=strings, outputCols=index, handleInvalid="keep"))
    if kind == "logistic":
        if strings:
            stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"))
        if numeric:
            stages += [VectorAssembler(inputCols=imputed, outputCol="__numeric"), StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True)]
        stages += [VectorAssembler(inputCols=["__scaled"] * bool(numeric) + hot, outputCol="__features"), LogisticRegression(featuresCol="__features", labelCol=LABEL, weightCol="__weight", maxIter=1000)]
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=stages)


@dataclass
class Model:
    dataset: str
    features: list[str]
    kind: str
    threshold: float = 0.5
    version: str = "v1.0"
    report: dict = field(default_factory=dict)
    stages: PipelineModel | Boosted | None = None

    def _ready(self, df: DataFrame) -> DataFrame:
        if self.stages is None:
            raise ValueError("the model isn't fitted")
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"{len(missing)} features are missing: {missing[:5]}")
        strings = categorical(self.features)
        if self.kind == "boosted":  # nulls stay
            return df
        return df.withColumns({c: F.coalesce(F.col(c), F.lit("missing")) if c in strings else F.col(c).cast("double") for c in self.features} | {"__weight": F.lit(1.0)})

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """All columns of `df` with probability (of label 1) and prediction at the given or the fitted threshold."""
        ready = self._ready(df)
        if isinstance(self.stages, Boosted):
            scored, p = ready, self.stages.probability()
        else:
            scored, p = self.stages.transform(ready), vector_to_array("probability")[1]
        return scored.select(*df.columns, p.alias("__p")).withColumnsRenamed({"__p": "probability"}).withColumn("prediction", (F.col("probability") >= (self.threshold if threshold is None else threshold)).cast("int"))

    def evaluate(self, df: DataFrame, threshold: float | None = None) -> dict:
        return metrics.evaluate(self.predict(df).select(LABEL, "probability"), LABEL, "probability", self.threshold if threshold is None else threshold)

    def save(self, path: str) -> None:
        """The stages and, beside them, their description as JSON; any file system that Spark writes to."""
        spark = SparkSession.getActiveSession()
        about = asdict_without_stages(self)
        if isinstance(self.stages, Boosted):
            about["boosted"] = self.stages.to_dict()
        else:
            self.stages.write().overwrite().save(f"{path}/stages")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def asdict_without_stages(m: Model) -> dict:
    stages, m.stages = m.stages, None
    try:
        return {k: v for k, v in asdict(m).items() if k != "stages"}
    finally:
        m.stages = stages


def load_model(spark: SparkSession, path: str) -> Model:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    trees = about.pop("boosted", None)
    return Model(**about, stages=Boosted.from_dict(trees) if trees else PipelineModel.load(f"{path}/stages"))


def fit(train: DataFrame, valid: DataFrame | None, dataset: str, kind: str = "logistic", weighting: str = "ratio", include_tier_b: bool = False, names=None, criterion: str = "f1", beta: float = 1.0, options: Options | None = None) -> Model:
    """A fitted model; its threshold is the best on `valid`, or 0.5 without it. options: of the boosted trees."""
    names = list(names or feature_names(dataset, include_tier_b))
    strings = categorical(names)
    counts = dict(select_features(train, dataset, names=names).groupBy(LABEL).count().collect())
    weight = class_weight(counts.get(0, 0), counts.get(1, 0), weighting)
    m = Model(dataset, names, kind)
    rows = select_features(train, dataset, names=names).where(F.col(LABEL).isNotNull())
    numeric = [c for c in names if c not in strings]
    if kind == "boosted":
        rows = rows.withColumn("__weight", F.when(F.col(LABEL) == 1, weight).otherwise(1.0))
        m.stages = boost(rows, numeric, strings, LABEL, "__weight", options)
    else:
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("missing")) if c in strings else F.col(c).cast("double") for c in names} | {"__weight": F.when(F.col(LABEL) == 1, weight).otherwise(1.0)})
        m.stages = _pipeline(kind, numeric, strings).fit(rows)
    m.report = {"weight": weight, "train": m.evaluate(train, 0.5)}
    if valid is not None:
        scored = m.predict(valid).select(LABEL, "probability").persist()
        m.threshold, m.report["valid"] = metrics.find_threshold(scored, LABEL, "probability", criterion, beta)
        scored.unpersist()
    return m


def ablate(train: DataFrame, valid: DataFrame, **options) -> dict[str, dict]:
    """Reports of two fits on the ledger, alike but for the features of tier B."""
    return {name: fit(train, valid, "ledger", include_tier_b=b, **options).report for name, b in (("tier_a", False), ("tier_ab", True))}
