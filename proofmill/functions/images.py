"""Image quality over decoded pixels, vectorised with numpy; and what a body that is no image says."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below these an image is dark, blurred or blank.
DARK, BLUR, FLAT = 15, 50.0, 8.0

#: What a body says when access is denied.
PRIVATE = (
    "accessdenied", "access denied", "signaturedoesnotmatch", "invalidaccesskeyid", "expiredtoken",
    "request has expired", "requesttimetooskewed", "authenticationrequired", "not authorized", "forbidden",
)


def _measure(data: bytes, height: int, width: int, channels: int) -> tuple[float, float, float]:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    gray = a[..., 0] if channels == 1 else np.floor(a[..., 2] * 0.299 + a[..., 1] * 0.587 + a[..., 0] * 0.114 + 0.5)  # rows are BGR
    # The Laplacian inside the border: each pixel's neighbours above, below and beside it, less four times itself.
    h, w = max(0, height - 2), max(0, width - 2)
    lap = sum(weight * gray[y : y + h, x : x + w] for y, x, weight in ((0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, -4))) if h and w else np.zeros(0)
    return round(float(gray.mean()), 1), round(float(gray.std()), 1), round(float(lap.var()) if lap.size else 0.0, 1)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("brightness", "contrast_std", "blur_laplacian_var")]))
def image_metrics(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    rows = [_measure(*x) for x in zip(data, height, width, channels)]
    return pd.DataFrame(rows, columns=["brightness", "contrast_std", "blur_laplacian_var"])


def judge(m: str = "m") -> Column:
    """The messages. Reason text by the first rule that fails, on the rounded metrics."""
    c = lambda n: F.col(f"{m}.{n}")
    return (
        F.when(c("brightness") < DARK, F.concat(F.lit("image effectively black (brightness "), c("brightness"), F.lit(")")))
        .when(c("blur_laplacian_var") < BLUR, F.concat(F.lit("image too blurry (focus "), c("blur_laplacian_var"), F.lit(")")))
        .when(c("contrast_std") < FLAT, F.concat(F.lit("image blank / no content (contrast "), c("contrast_std"), F.lit(")")))
        .otherwise("image quality acceptable")
    )


def quality(images: DataFrame) -> DataFrame:
    """``origin, width, height, m, reason, passed`` for rows of Spark's ``image`` source."""
    i = "image"
    m = image_metrics(f"{i}.data", f"{i}.height", f"{i}.width", f"{i}.nChannels")
    out = images.select(f"{i}.origin", f"{i}.width", f"{i}.height", m.alias("m")).withColumn("reason", judge())
    return out.withColumn("passed", F.col("reason") == "image quality acceptable")


def diagnose_body(body: Column, content_type: Column) -> Column:
    """Why a fetched body is no image; empty if it looks like a damaged image."""
    head, kind = F.lower(F.substring(body, 1, 800)), F.lower(F.coalesce(content_type, F.lit("")))
    has = lambda *marks: F.array_contains(F.transform(F.array(*map(F.lit, marks)), lambda m: F.contains(head, m)), True)
    return (
        F.when(has(*PRIVATE), "image URL is private / access denied — the link needs a valid signature or permission")
        .when(F.contains(kind, F.lit("html")) | has("<html") | F.ltrim(head).startswith("<!doctype html"), "image URL returned a web page, not an image (likely a private/expired/login link)")
        .when(F.contains(kind, F.lit("xml")) | has("<?xml", "<error"), "image URL returned an error response, not an image (likely a private/expired link)")
        .otherwise("")
    )
