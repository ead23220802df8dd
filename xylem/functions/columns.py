"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake_case(name: Column) -> Column:
    """Each capital becomes an underscore and its lower case; leading underscores go."""
    return F.ltrim(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), F.lit("_"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def has_extension(name: Column, extension: str) -> Column:
    return F.lower(name).endswith(extension.lower())


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def slice_key(image: Column, n_slices: Column, slice_no: Column) -> Column:
    return F.format_string("processed/%d/%s/%s_%d.png", n_slices, image, image, slice_no)


def result_key(job: Column, algorithm: Column) -> Column:
    return F.concat(F.lit("app/results/"), job, F.lit("_"), algorithm, F.lit(".png"))


def public_url(domain: str, key: Column, bucket: str | None = None) -> Column:
    return F.concat(F.lit(f"https://{bucket + '.' if bucket else ''}{domain}/"), key)


def status_of(message: Column) -> Column:
    return F.when(message.contains("SUCCESS"), "SUCCESS").when(message.contains("WARNING"), "WARNING").otherwise("ERROR")


def megabytes_of(message: Column) -> Column:
    return F.regexp_extract(message, r"Total size: ([0-9.]+) MB", 1).try_cast("double")


def finite(x: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def luma(b: Column, g: Column, r: Column) -> Column:
    return F.rint(r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def blend(a: Column, wa: float, b: Column, wb: float) -> Column:
    """Weighted sum, rounded half to even and held within a byte."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(a * wa + b * wb))).cast("int")


def nearest_edge(cx: Column, cy: Column, width: Column, height: Column, margin: int = 10) -> Column:
    return F.least(cx, width - cx, cy, height - cy).cast("int") - margin


def farthest_corner(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    return F.sqrt(F.pow(F.greatest(cx, width - cx), F.lit(2)) + F.pow(F.greatest(cy, height - cy), F.lit(2))).cast("int")


def space_saved(original: Column, kept: Column) -> Column:
    return F.when(original > 0, 100.0 * (original - kept) / original).otherwise(0.0)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def uniform(seed: Column, salt: str) -> Column:
    """A number in [0, 1) that hangs on seed alone."""
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def ramp(i: Column, n: Column) -> Column:
    """Colour of ring i of n: (b, g, r) from blue to red."""
    t = F.when(n > 1, i / (n - 1)).otherwise(0.0)
    return F.struct(F.rint(255 * (1 - t)).cast("int").alias("b"), F.lit(64).alias("g"), F.rint(255 * t).cast("int").alias("r"))
