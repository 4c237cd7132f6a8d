"""Pixel operators on decoded arrays: rows of gray images, vectorised inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Windows of local statistics, and the disparity from which a pixel counts as anomalous.
SMALL, LARGE, DISPARITY = 11, 45, 0.40


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square window around each pixel by an integral image; borders repeat the edge."""
    r = size // 2
    padded = np.pad(image.astype(np.float64), ((r + 1, r), (r + 1, r)), mode="edge")
    total = padded.cumsum(0).cumsum(1)
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def residual(image: np.ndarray) -> np.ndarray:
    """What a 5x5 mean takes away."""
    return np.abs(image.astype(np.float64) - box_mean(image, 5))


def noise_statistics(image: np.ndarray) -> tuple[float, float, float]:
    """Mean residual, share of pixels whose local noise departs from their surroundings', and the score (95th percentile, at most 1)."""
    res = residual(image)
    spread = np.sqrt(np.maximum(box_mean(res**2, SMALL) - box_mean(res, SMALL) ** 2, 0))
    around = box_mean(spread, LARGE)
    disparity = np.abs(spread - around) / (around + 1e-6)
    return float(res.mean()), float((disparity > DISPARITY).mean()), float(min(np.percentile(disparity, 95), 1.0))


def noise(images: DataFrame) -> DataFrame:
    """image_id, mean_residual, anomalous and score for rows (image_id, height, width, pixels as bytes). Images whose bytes don't fit their size give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                fits = row.pixels is not None and row.height * row.width == len(row.pixels) > 0
                found = noise_statistics(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)) if fits else (None, None, None)
                out.append((row.image_id, *found))
            yield pd.DataFrame(out, columns=["image_id", "mean_residual", "anomalous", "score"])

    return images.select("image_id", "height", "width", "pixels").mapInPandas(run, "image_id long, mean_residual double, anomalous double, score double")
