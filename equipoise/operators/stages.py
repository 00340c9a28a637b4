"""The column transformer as a stage of ``pyspark.ml`` pipelines.

``CodedFeatures`` learns the scaling and the level codes of ``CodedPreprocessor``;
its model adds the sparse feature vector. Both can be written and read, so a
``PipelineModel`` of the model and any fitted classifier is saved as one folder and
scores new rows after loading. The levels, of any number, are saved as a table;
settings of one entry per column go to the stage's metadata.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame

from equipoise.operators.models import FEATURES
from equipoise.operators.preprocess import CodedModel, CodedPreprocessor


class CodedFeatures(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns ``num_cols`` (mean, range) and ``cat_cols`` (levels, mode) from a table."""

    num_cols = Param(Params._dummy(), "num_cols", "numeric columns", TypeConverters.toListString)
    cat_cols = Param(Params._dummy(), "cat_cols", "categorical columns", TypeConverters.toListString)

    def __init__(self, num_cols: list[str] | None = None, cat_cols: list[str] | None = None):
        super().__init__()
        self._set(num_cols=list(num_cols or []), cat_cols=list(cat_cols or []))

    def _fit(self, dataset: DataFrame) -> "CodedFeaturesModel":
        return CodedFeaturesModel(CodedPreprocessor(self.getOrDefault(self.num_cols),
                                                    self.getOrDefault(self.cat_cols)).fit(dataset))


class CodedFeaturesModel(Model, MLReadable, MLWritable):
    """Adds the feature vector; the coded columns become numbers and codes, and all
    other columns pass through. Null numbers count as the mean and null levels as the
    mode; a level not seen at the fit has no indicator."""

    def __init__(self, coded: CodedModel):
        super().__init__()
        self.coded = coded

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = {*self.coded.num_cols, *self.coded.cat_cols}
        kept = [c for c in dataset.columns if c not in own]
        return self.coded.vectors(self.coded.transform(dataset, kept), FEATURES)

    def write(self) -> "_CodedWriter":
        return _CodedWriter(self)

    @classmethod
    def read(cls) -> "_CodedReader":
        return _CodedReader()


_SETTINGS = ("num_cols", "cat_cols", "num_params", "sizes", "modes")


class _CodedWriter(MLWriter):
    def __init__(self, stage: CodedFeaturesModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        coded = self.stage.coded
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession,
                                         {"coded": {k: getattr(coded, k) for k in _SETTINGS}})
        coded.levels.write.parquet(f"{path}/levels")


class _CodedReader(MLReader):
    def load(self, path: str) -> CodedFeaturesModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        stage = CodedFeaturesModel(CodedModel(levels=spark.read.parquet(f"{path}/levels"), **meta["coded"]))
        stage._resetUid(meta["uid"])
        return stage
