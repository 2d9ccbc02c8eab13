"""WAV bytes to sample arrays."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.functions.arrays import peak_normalise
from tonemark.functions.labels import file_stem
from tonemark.schema import SAMPLE_RATE

DECODED = "clip_id string, path string, samples array<double>, sr int, error string"


def scan_wav(spark: SparkSession, root: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.wav")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return decode(
        files.select(file_stem(F.col("path")).alias("clip_id"), "path", "content")
    )


def _read(content: bytes) -> np.ndarray:
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError(f"{8 * w.getsampwidth()}-bit samples are not supported")
        if w.getframerate() != SAMPLE_RATE:
            raise ValueError(f"expected {SAMPLE_RATE} Hz, got {w.getframerate()}")
        frames = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
        return (frames.astype(np.float64) / 32768.0).reshape(-1, w.getnchannels()).mean(axis=1)


def decode(files: DataFrame) -> DataFrame:
    """Mono, peak-normalised samples; undecodable files keep a row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            samples, errors = [], []
            for content in batch["content"]:
                try:
                    samples.append(_read(content))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - reported per file
                    samples.append(None)
                    errors.append(str(exc) or type(exc).__name__)
            yield pd.DataFrame(
                {
                    "clip_id": batch["clip_id"],
                    "path": batch["path"],
                    "samples": samples,
                    "sr": SAMPLE_RATE,
                    "error": errors,
                }
            )

    decoded = files.select("clip_id", "path", "content").mapInPandas(run, DECODED)
    return decoded.withColumn("samples", peak_normalise(F.col("samples")))


def require_decoded(decoded: DataFrame, show: int = 10) -> DataFrame:
    """Raise with the failed files, or return the decoded clips."""
    bad = decoded.where(F.col("error").isNotNull()).select("path", "error")
    shown = bad.limit(show).collect()
    if shown:
        listed = "; ".join(f"{r[0]}: {r[1]}" for r in shown)
        raise ValueError(f"{bad.count()} file(s) failed to load: {listed}")
    return decoded.drop("error")
