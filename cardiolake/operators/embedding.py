"""Window encoders: the plug-in contract and the statistical encoder that ships with it."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSION = 1024

# Windows that an encoder gets and a worker holds results of at a time, however many a batch has.
_AT_ONCE = 256

# Module of a worker process that keeps loaded models.
_LOADED = "cardiolake_loaded_models"

# An encoder maps (prepared windows [b, width], seeds [b]) to embeddings [b, 1024].
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]


def statistical_encoder(prepared: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Seeded normals with nine leading statistics, scaled to unit length.

    Dimensions 0-3 are mean, deviation, range and median, 4-8 the first five magnitudes of the
    discrete Fourier transform.
    """
    x = prepared.astype(np.float64)
    out = np.empty((len(x), DIMENSION), dtype=np.float32)
    for row, seed in enumerate(seeds):
        generator = np.random.default_rng(int(seed) & 0xFFFFFFFF)
        out[row] = generator.standard_normal(DIMENSION, dtype=np.float32)
    out[:, 0] = x.mean(axis=1)
    out[:, 1] = x.std(axis=1)
    out[:, 2] = np.ptp(x, axis=1)
    out[:, 3] = np.median(x, axis=1)
    waves = np.exp(-2j * np.pi * np.outer(np.arange(x.shape[1]), np.arange(5)) / x.shape[1])
    out[:, 4:9] = np.abs(x @ waves)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-8, out / np.maximum(norm, 1e-8), out).astype(np.float32)


class ModelEncoder:
    """An encoder whose model is loaded from files that are shipped to the workers.

    ``load`` gets the local paths of ``files`` and returns a function from prepared windows to
    embeddings. A worker process loads once, whatever number of batches and tasks it runs, and the model
    sees at most ``batch_size`` windows at a time.
    """

    def __init__(self, spark: SparkSession, files: Sequence[str], load: Callable[[list[str]], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64):
        self.names = []
        for file in files:
            spark.sparkContext.addFile(file)
            self.names.append(file.rstrip("/").rpartition("/")[2])
        self.load, self.batch_size, self.key = load, batch_size, uuid.uuid4().hex

    def __call__(self, prepared: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        model = _model_of(self)
        parts = [prepared[at : at + self.batch_size] for at in range(0, len(prepared), self.batch_size)]
        return np.concatenate([np.asarray(model(part), np.float32) for part in parts]) if parts else np.zeros((0, DIMENSION), np.float32)


def _model_of(encoder: ModelEncoder) -> Callable[[np.ndarray], np.ndarray]:
    """The loaded model of an encoder, kept by the worker process under the encoder's key."""
    # This module travels by value and is made anew for each task; what sys.modules holds stays.
    held = sys.modules.setdefault(_LOADED, ModuleType(_LOADED)).__dict__
    if encoder.key not in held:
        held[encoder.key] = encoder.load([SparkFiles.get(name) for name in encoder.names])
    return held[encoder.key]


def _encoded(encoder: Encoder, prepared: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = np.asarray(encoder(prepared, seeds))
    if out.shape != (len(prepared), DIMENSION):
        raise ValueError(f"embedding must be {DIMENSION}-dimensional, got {out.shape[1:]}")
    return out.astype(np.float32)


def embed(
    windows: DataFrame,
    encoder: Encoder = statistical_encoder,
    is_mock: bool = True,
    seed_columns: tuple[str, ...] = ("record_id", "start_idx"),
    isolate: bool = False,
) -> DataFrame:
    """Add ``embedding`` and ``is_mock`` to prepared windows, in Arrow batches.

    Seeds come from the window key, so the result does not depend on process or partition. The encoder gets
    a few hundred windows at a time, so a worker's memory does not grow with its rows. A window
    that the encoder fails on fails the job; with ``isolate`` those windows are tried again row by row,
    and the failing rows get a NULL embedding and the reason in ``error``.
    """

    def tried(prepared: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[np.ndarray | None, str | None]]:
        try:
            yield from ((row, None) for row in _encoded(encoder, prepared, seeds))
        except Exception as problem:
            if not isolate:
                raise
            if len(prepared) == 1:
                yield None, f"{type(problem).__name__}: {problem}"
                return
            for k in range(len(prepared)):
                yield from tried(prepared[k : k + 1], seeds[k : k + 1])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prepared, seeds in batches:
            for at in range(0, max(len(prepared), 1), _AT_ONCE):
                some, keys = prepared.to_numpy()[at : at + _AT_ONCE], seeds.to_numpy()[at : at + _AT_ONCE]
                found = [row for row, _ in tried(np.stack(some), keys)] if len(some) else []
                yield pd.Series(found, dtype=object)

    @F.pandas_udf("string")
    def reasons(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prepared, seeds in batches:
            yield pd.Series(
                [None if p is None else next(tried(p[None, :], np.array([s])))[1] for p, s in zip(prepared, seeds)], dtype=object
            )

    # A deterministic function would be copied into filters on its result and run again there.
    run, reasons = run.asNondeterministic(), reasons.asNondeterministic()
    seed = F.xxhash64(*seed_columns)
    out = windows.withColumns({"embedding": run("prepared", seed), "is_mock": F.lit(is_mock)})
    if isolate:  # only failing windows are sent again, for their reason
        out = out.withColumn("error", reasons(F.when(F.col("embedding").isNull(), F.col("prepared")), seed))
    return out
