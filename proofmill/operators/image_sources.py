"""The bytes behind an image reference, from wherever it points, or why there are none."""

from __future__ import annotations

import base64
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images, text
from ..sources.scratch import materialise
from ..sources.sinks import get_blobs
from .keyed import KeyedTable

#: How image files begin and, where a format has a last mark, how they end.
FORMATS = {
    "png": ("89504E470D0A1A0A", "49454E44AE426082"), "jpeg": ("FFD8FF", "FFD9"), "gif": ("47494638", "3B"), "bmp": ("424D", ""), "tiff": ("49492A00", ""),
    "tiff, big-endian": ("4D4D002A", ""), "webp": ("52494646", ""),
}
BYTES = "key string, content binary, content_type string, error string"


def origin(source: Column) -> Column:
    """``none``, ``blob``, ``data-uri``, ``url`` or ``file``."""
    s = text.strip(source)
    return (
        F.when(F.coalesce(source, F.lit("")) == "", "none").when(s.startswith("blob:"), "blob").when(s.startswith("data:"), "data-uri")
        .when(F.lower(s).rlike("^https?://"), "url").otherwise("file")
    )


def decode_data_uris(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key in batch["key"]:
            try:
                out.append((key, base64.b64decode(key.split(",", 1)[1]), None, None))
            except Exception as e:  # the row says what is wrong with it
                out.append((key, None, None, f"could not read image source ({type(e).__name__}: {e})"))
        yield pd.DataFrame(out, columns=["key", "content", "content_type", "error"])


def fetcher(timeout: int = 30):
    """A function for ``mapInPandas`` that fetches the addresses in ``key``."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key in batch["key"]:
                content, kind, why = None, None, None
                try:
                    with urllib.request.urlopen(urllib.request.Request(key, headers={"User-Agent": "proofmill"}), timeout=timeout) as answer:
                        content, kind = answer.read(), answer.headers.get("Content-Type", "")
                except urllib.error.HTTPError:
                    why = "HTTPError"
                except (TimeoutError, urllib.error.URLError) as e:
                    why = "ReadTimeout" if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError) else "ConnectionError"
                except Exception as e:
                    why = type(e).__name__
                # One row at a time, as a body may be large.
                yield pd.DataFrame([(key, content, kind, why and f"could not download image ({why})")], columns=["key", "content", "content_type", "error"])

    return fetch


def unreadable(content: Column) -> Column:
    """Null for the bytes of a whole image file; ``UnidentifiedImageError`` for another beginning, ``OSError`` if the end is missing.

    Pixels are not decoded here: a damaged middle is found by whoever decodes.
    """
    size = F.length(content)
    starts = lambda mark: F.hex(F.substring(content, 1, len(mark) // 2)) == mark
    ends = lambda mark: F.hex(F.expr(f"substring(content, greatest(1, length(content) - {len(mark) // 2 - 1}), {len(mark) // 2})")) == mark
    out = F.when(size == 0, "UnidentifiedImageError")
    for begin, end in FORMATS.values():
        out = out.when(starts(begin), F.when(~ends(end), "OSError") if end else F.lit(None).cast("string"))
    return out.otherwise("UnidentifiedImageError")


def load_images(rows: DataFrame, source: str = "source", store: str | None = None, index: DataFrame | None = None, files: str | None = None, timeout: int = 30) -> DataFrame:
    """``rows`` with ``origin, content, error``: the image's bytes, else the reason why there is none (``content`` stays for damaged ones).

    Every different reference is read once. ``blob:`` references are looked up in ``store`` (as written by ``sinks.put_blobs``); one that
    has been evicted is fetched from the ``source_url`` that ``index(sha256, source_url)`` has for it. Paths are found
    among ``files``, a folder that Spark scans (which passes over empty files, so these are not found); addresses are fetched
    by the executors, data URIs decoded.
    """
    spark = rows.sparkSession
    blank = spark.createDataFrame([], BYTES)
    asked = rows.select(origin(F.col(source)).alias("kind"), text.strip(F.col(source)).alias("ref")).where("kind <> 'none'").distinct()
    sha = F.substring("ref", 6, 64)
    blobs = asked.where("kind = 'blob'").select("ref", sha.alias("sha256"))
    held = blobs.join(get_blobs(blobs.select("sha256"), store) if store else spark.createDataFrame([], "sha256 string, content binary"), "sha256", "left")
    known = index.select("sha256", F.nullif("source_url", F.lit("")).alias("live")) if index is not None else spark.createDataFrame([], "sha256 string, live string")
    held = held.join(known, "sha256", "left").withColumn("live", F.when(F.col("content").isNull(), F.col("live")))
    of_blobs = held.where("live IS NULL").select(F.col("ref").alias("key"), "content", F.lit(None).cast("string").alias("content_type"), F.when(F.col("content").isNull(), "prefetched image no longer in blob store").alias("error"))
    healed = held.where("live IS NOT NULL").select("ref", "live")
    urls = asked.where("kind = 'url'").select(F.col("ref").alias("key")).unionByName(healed.select(F.col("live").alias("key"))).distinct()
    # Written, so that nothing is fetched twice.
    fetched = materialise(urls.repartition(spark.sparkContext.defaultParallelism).mapInPandas(fetcher(timeout), BYTES))
    by_data = asked.where("kind = 'data-uri'").select(F.col("ref").alias("key")).mapInPandas(decode_data_uris, BYTES)
    paths = asked.where("kind = 'file'").select(F.col("ref").alias("key"))
    if files:
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        absolute = F.when(F.col("key").startswith("/"), F.col("key")).otherwise(F.concat(F.lit(files.removeprefix("file://").rstrip("/") + "/"), F.col("key")))
        paths = paths.join(scan, absolute == F.col("path"), "left").select("key", "content")
    else:
        paths = paths.withColumn("content", F.lit(None).cast("binary"))
    of_files = paths.select("key", "content", F.lit(None).cast("string").alias("content_type"), F.when(F.col("content").isNull(), F.concat(F.lit("image file not found ("), "key", F.lit(")"))).alias("error"))
    again = healed.join(fetched.withColumnRenamed("key", "live"), "live").select(F.col("ref").alias("key"), "content", "content_type", "error", F.lit("url").alias("came"))
    came = lambda df, kind: df.withColumn("came", F.lit(kind))
    every = came(of_blobs, "blob").unionByName(came(by_data, "data-uri")).unionByName(came(fetched, "url")).unionByName(came(of_files, "file")).unionByName(again)
    keyed = rows.withColumns({"origin": origin(F.col(source)), "__ref": text.strip(F.col(source))})
    out = keyed.join(every.withColumnRenamed("key", "__key"), (F.col("__ref") == F.col("__key")) & (F.col("origin") != "none"), "left")
    bad, live = unreadable(F.col("content")), F.col("came") == "url"
    said = F.when(live, F.nullif(images.diagnose_body(F.substring("content", 1, 800).cast("string"), F.col("content_type")), F.lit("")))
    error = (
        F.when(F.col("origin") == "none", "no image source provided").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.length("content") == 0, F.concat(F.lit("empty image payload from "), "came"))
        .when(bad.isNotNull(), F.coalesce(said, F.concat(F.lit("unreadable/corrupt image ("), bad, F.lit(")")))).otherwise("")
    )
    return out.withColumn("error", error).drop("__ref", "__key", "came", "content_type")


def touched(index: KeyedTable, shas: DataFrame, at: Column, batch: str) -> None:
    """Set ``last_used`` in a blob index (with the key ``sha256`` and the largest ``last_used`` kept) for the blobs of ``shas`` that it has."""
    rows = index.read().join(shas.select("sha256").distinct(), "sha256", "left_semi")
    index.write(rows.withColumn("last_used", at), batch)
