"""The scorers as Spark ML stages that are fitted, stored and loaded.

A scorer is a ``Transformer`` from ``inputCol`` (text) to ``outputCol`` (the
annotation array of ``schemas.ANNOTATION``), so it stands in a ``Pipeline``
with any other stage, and a loaded ``PipelineModel`` is a scorer for
``score_posts`` and for the stream. Parameters are stored as Spark ML stores
them, fitted weights as a table beside them, so a model lies wherever Spark
writes and is read by any session.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader
from pyspark.sql import DataFrame

from postlens.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS, LexiconScorer, NaiveBayesModel, NaiveBayesScorer


class _Scorer(HasInputCol, HasOutputCol):
    """Reads ``text`` and writes ``sentiment`` unless told otherwise."""

    def _defaults(self) -> None:
        self._setDefault(inputCol="text", outputCol="sentiment")

    @property
    def output_col(self) -> str:
        return self.getOutputCol()


class LexiconStage(Transformer, _Scorer, DefaultParamsReadable, DefaultParamsWritable):
    """Scorer A as a stage: the word lists are its parameters."""

    positive = Param(Params._dummy(), "positive", "words that count for the text", TypeConverters.toListString)
    negative = Param(Params._dummy(), "negative", "words that count against the text", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, positive=None, negative=None, inputCol=None, outputCol=None):
        super().__init__()
        self._defaults()
        self._setDefault(positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return LexiconScorer(self.getOrDefault("positive"), self.getOrDefault("negative"), self.getInputCol(),
                             self.getOutputCol()).transform(dataset)


class _WeightsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        rows = sorted(self.instance.weights.items())
        self.sparkSession.createDataFrame(rows, "token string, weight double").coalesce(1).write.parquet(f"{path}/weights")


class _WeightsReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.kind.__module__}.{self.kind.__name__}")
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        rows = self.sparkSession.read.schema("token string, weight double").parquet(f"{path}/weights").collect()
        model.weights = {r.token: r.weight for r in sorted(rows)}
        return model


class NaiveBayesStage(Model, _Scorer, DefaultParamsWritable):
    """Scorer B as a stage: the weights of its vocabulary and the prior log-odds."""

    bias = Param(Params._dummy(), "bias", "prior log-odds", TypeConverters.toFloat)
    decimals = Param(Params._dummy(), "decimals", "decimals of the score", TypeConverters.toInt)

    def __init__(self, weights: dict[str, float] | None = None, bias: float = 0.0):
        super().__init__()
        self._defaults()
        self._setDefault(decimals=6)
        self._set(bias=bias)
        self.weights = dict(sorted((weights or {}).items()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return NaiveBayesModel(self.weights, self.getOrDefault("bias"), self.getInputCol(), self.getOutputCol(),
                               self.getOrDefault("decimals")).transform(dataset)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.weights = dict(self.weights)
        return out

    def write(self) -> _WeightsWriter:
        return _WeightsWriter(self)

    @classmethod
    def read(cls) -> _WeightsReader:
        return _WeightsReader(cls)

    @classmethod
    def load(cls, path: str) -> NaiveBayesStage:
        return cls.read().load(path)


class NaiveBayesEstimator(Estimator, _Scorer, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits scorer B (``NaiveBayesScorer``) on rows of a text and a 0/1 label."""

    minDocs = Param(Params._dummy(), "minDocs", "documents that hold a token of the model, at least", TypeConverters.toInt)
    minZ = Param(Params._dummy(), "minZ", "two-proportion statistic of a token of the model, at least", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, minDocs=None, minZ=None, inputCol=None, labelCol=None, outputCol=None):
        super().__init__()
        self._defaults()
        self._setDefault(minDocs=5, minZ=4.0, labelCol="toxic")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NaiveBayesStage:
        scorer = NaiveBayesScorer(self.getOrDefault("minDocs"), self.getOrDefault("minZ"), self.getInputCol(), self.getLabelCol())
        n1, n0 = scorer.class_totals(dataset)
        stage = NaiveBayesStage()
        if n1 and n0:
            rows = scorer.statistics(dataset, n1, n0).select("token", "w").collect()
            stage = NaiveBayesStage({r.token: float(r.w) for r in rows}, math.log(n1 / n0))
        stage._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return stage
