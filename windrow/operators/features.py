"""Feature matrices as a fitted model: pixel bounds, components and feature bounds are learnt once, saved, and applied alike.

A FeatureAssembler learns from windows with an array of pixels and plain columns; its FeatureModel adds the
reconstruction error of the pixels, drops rows that lack a feature, and scales the features to [0, 1].
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, scaled
from . import joins, linalg, ranking

#: The feature that the model computes; it may stand anywhere among the others.
SCORE = "ae_score"
DATA = "name string, place int, numbers array<double>"


def matched(windows: DataFrame, triggers: DataFrame, at: str, of: str, tolerance: int, keys: list[str], fields: list[str], *, places: int = 0) -> DataFrame:
    """windows, the first of those whose times round alike, with fields of the trigger of the same time, else of the first within the tolerance; NaN where there is none.

    windows need window_id, triggers trigger_id, which tell their order. places: as of round, so -3 rounds microseconds to milliseconds.
    """
    once = joins.keep_first(windows, [*[F.col(k) for k in keys], F.bround(F.col(at), places)], F.col("window_id"))
    met = joins.exact_then_tolerance(once.select("window_id", at, *keys), triggers.select(*keys, of, "trigger_id", *fields), at, of, tolerance, keys, "trigger_id")
    found = met.select("window_id", *[F.coalesce(F.col(f"match.{f}").cast("double"), F.lit(float("nan"))).alias(f) for f in fields])
    return once.join(found, "window_id")


class _Params(Params):
    pixels = Param(Params._dummy(), "pixels", "column of equally long arrays", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "columns in order, with ae_score among them or not", TypeConverters.toListString)
    components = Param(Params._dummy(), "components", "components kept; -1: as many as explain the share", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "share of the variance that is explained at least", TypeConverters.toFloat)
    low = Param(Params._dummy(), "low", "percentile of all pixels that becomes 0", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "percentile of all pixels that becomes 1", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(pixels="x", components=-1, share=0.95, low=0.01, high=0.99)

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


def _images(df: DataFrame, pixels: str, width: int, bounds: np.ndarray) -> DataFrame:
    """df with _x: pixels scaled by the bounds; null where they are not width finite numbers."""
    x = F.col(f"`{pixels}`")
    whole = (F.size(x) == width) & F.forall(x, lambda v: finite(v.cast("double")))
    return df.withColumn("_x", F.when(whole, F.transform(x, lambda v: scaled(v.cast("double"), F.lit(float(bounds[0])), F.lit(float(bounds[1]))))))


class FeatureAssembler(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, pixels: str = "x", features: list[str] | None = None, components: int = -1, share: float = 0.95, low: float = 0.01, high: float = 0.99) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> FeatureModel:
        """The bounds of all finite pixels, the components of whole rows, the bounds of the features of whole rows. No whole row: a ValueError."""
        pixels, wanted = self._get("pixels"), self._get("components")
        row = df.select(F.mode(F.size(f"`{pixels}`")).alias("n")).first()  # the commonest width
        values = df.select(F.explode(f"`{pixels}`").alias("v")).select(F.col("v").cast("double")).filter(finite(F.col("v")))
        bounds = ranking.quantiles(values, [], "v", [self._get("low"), self._get("high")]).first()
        if bounds is None or bounds["q"] is None or bounds["q"][0] is None:
            raise ValueError("no pixels to learn from")
        model = FeatureModel()
        self._copyValues(model)
        model.pixel_bounds, model.width = np.array(bounds["q"]), int(row["n"])
        images = _images(df, pixels, model.width, model.pixel_bounds).filter("_x is not null")
        mean, components, shares = linalg.pca(images, "_x", model.width)
        kept = linalg.components_for(shares, self._get("share")) if wanted < 0 else wanted
        model.mean, model.basis, model.shares = mean, components[:kept], shares[:kept]
        names = self._get("features")
        raw = model.assembled(df)
        spans = raw.agg(*[f(F.col("features_raw")[k]).alias(f"{n}{k}") for k in range(len(names)) for n, f in (("l", F.min), ("h", F.max))]).first()
        if spans is None or spans["l0"] is None:
            raise ValueError("no row has all features")
        model.feature_bounds = np.array([[spans[f"{n}{k}"] for k in range(len(names))] for n in "lh"], float)
        return model


class FeatureModel(Model, _Params, MLReadable, MLWritable):
    """pixel_bounds: two numbers; mean and basis (component x pixel) of scaled pixels, with the shares of variance; feature_bounds: least and greatest of each feature."""

    width: int
    pixel_bounds: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    shares: np.ndarray
    feature_bounds: np.ndarray

    def assembled(self, df: DataFrame) -> DataFrame:
        """df with ae_score and features_raw; rows that lack a feature, or have one that is not finite, go."""
        images = _images(df, self._get("pixels"), self.width, self.pixel_bounds)
        scored = linalg.reconstruction_error(images, "_x", self.mean, self.basis, SCORE)
        raw = F.array(*[F.col(f"`{f}`").cast("double") for f in self._get("features")])
        return scored.withColumn("features_raw", raw).filter(F.forall("features_raw", finite)).drop("_x")

    def _transform(self, df: DataFrame) -> DataFrame:
        """df with ae_score, features_raw and features, scaled by the bounds of fitting; other data may exceed [0, 1] and are clipped."""
        low, high = self.feature_bounds
        raw = F.col("features_raw")
        each: list[Column] = [scaled(raw[k], F.lit(float(a)), F.lit(float(b))) for k, (a, b) in enumerate(zip(low, high, strict=True))]
        return self.assembled(df).withColumn("features", F.array(*each))

    def latents(self, df: DataFrame) -> DataFrame:
        """df with latent: coordinates along the components; null where the pixels are not whole."""
        images = _images(df, self._get("pixels"), self.width, self.pixel_bounds)
        return images.withColumn("latent", F.when(F.col("_x").isNotNull(), linalg.projected(F.col("_x"), self.mean, self.basis))).drop("_x")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: FeatureModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        """Parameters as metadata with the numbers of what was learnt, the arrays as a table: a row a component."""
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"width": m.width, "n_components": len(m.basis), "explained": float(m.shares.sum())})
        rows = [("pixel_bounds", 0, m.pixel_bounds), ("mean", 0, m.mean), ("shares", 0, m.shares), *[("basis", k, b) for k, b in enumerate(m.basis)], *[("feature_bounds", k, b) for k, b in enumerate(m.feature_bounds)]]
        data = self.sparkSession.createDataFrame([(n, k, [float(v) for v in x]) for n, k, x in rows], DATA)
        data.write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> FeatureModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = FeatureModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        rows = self.sparkSession.read.schema(DATA).parquet(f"{path}/data").orderBy("name", "place").collect()  # a row a component
        parts: dict[str, list[list[float]]] = {}
        for r in rows:
            parts.setdefault(r["name"], []).append(r["numbers"])
        model.width = int(metadata["width"])
        model.pixel_bounds, model.mean, model.shares = (np.array(parts[k][0], float) for k in ("pixel_bounds", "mean", "shares"))
        model.basis = np.array(parts.get("basis", np.zeros((0, model.width))), float)
        model.feature_bounds = np.array(parts["feature_bounds"], float)
        return model
