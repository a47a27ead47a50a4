"""Names, resource identifiers and version tokens: checks on single values, and their column forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakevec.errors import Validation

REGION, ACCOUNT = "us-east-1", "000000000000"
#: Fixed limits of the interface.
NAME_CHARS, PREFIX_CHARS, KEY_CHARS, MAX_DIMENSION = (3, 63), (1, 63), (1, 1024), 4096
MAX_TOP_K, MAX_BATCH, PAGE_DEFAULT, PAGE_MAX = 100, 500, 100, 500
METRICS = ("cosine", "euclidean")


def sized(value: str, what: str, limits: tuple[int, int]) -> str:
    if not limits[0] <= len(value) <= limits[1]:
        raise Validation(f"{what} must have {limits[0]} to {limits[1]} characters")
    return value


def page_size(n: int | None) -> int:
    return PAGE_DEFAULT if n is None else min(max(n, 1), PAGE_MAX)


def top_k(k: int) -> int:
    if not 1 <= k <= MAX_TOP_K:
        raise Validation(f"topK must be 1 to {MAX_TOP_K}")
    return k


def metric(name: str) -> str:
    if name not in METRICS:
        raise Validation(f"distance metric must be one of {', '.join(METRICS)}")
    return name


def index_spec(name: str, dimension: int, distance_metric: str, dtype: str = "float32") -> dict:
    """A new index: its name, dimension, metric and data type, checked."""
    if dtype != "float32":
        raise Validation(f"data type must be float32, not {dtype}")
    if not 1 <= dimension <= MAX_DIMENSION:
        raise Validation(f"dimension must be 1 to {MAX_DIMENSION}")
    return {"name": sized(name, "index name", NAME_CHARS), "dimension": dimension, "metric": metric(distance_metric), "dtype": dtype}


def vector_arn(bucket: str, index: str | None = None) -> str:
    return f"arn:aws:s3vectors:{REGION}:{ACCOUNT}:bucket/{bucket}" + (f"/index/{index}" if index else "")


def parse_vector_arn(arn: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"arn:[^:]*:s3vectors:[^:]*:[^:]*:bucket/([^/]+)(?:/index/([^/]+))?", arn)
    if not m:
        raise Validation(f"not a vector resource: {arn}")
    return m[1], m[2]


def table_arn(bucket: str, table_id: str | None = None) -> str:
    return f"arn:aws:s3tables:{REGION}:{ACCOUNT}:bucket/{bucket}" + (f"/table/{table_id}" if table_id else "")


def parse_table_arn(arn: str) -> tuple[str, str | None]:
    m = re.fullmatch(r"arn:[^:]*:s3tables:[^:]*:[^:]*:bucket/([^/]+)(?:/table/([^/]+))?", arn)
    if not m:
        raise Validation(f"not a table resource: {arn}")
    return m[1], m[2]


def iso_time(at: Column) -> Column:
    """A timestamp in the form of ISO 8601 with nine digits of a second and Z; the session's time zone is UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def target(index_arn: str | None = None, bucket: str | None = None, index: str | None = None) -> tuple[str, str]:
    """(bucket, index) from an index ARN alone, or from both names alone."""
    if index_arn and not bucket and not index:
        found = parse_vector_arn(index_arn)
        if found[1]:
            return found
    elif not index_arn and bucket and index:
        return bucket, index
    raise Validation("give either the index ARN or the bucket and index names")


def arn_parts(arn: Column) -> dict[str, Column]:
    """bucket and index of an ARN column; null where it is not one."""
    pattern = r"^arn:[^:]*:s3vectors:[^:]*:[^:]*:bucket/([^/]+)(?:/index/([^/]+))?$"
    part = lambda n: F.when(F.regexp_extract(arn, pattern, n) != "", F.regexp_extract(arn, pattern, n))
    return {"bucket": part(1), "index_name": part(2)}


def version_token(location: str) -> str:
    """Leading digits of the metadata file's name, and a 64-bit polynomial hash (factor 31) of the whole location."""
    digits = re.match(r"\d*", location.rpartition("/")[2])[0]
    h = 0
    for byte in location.encode():
        h = (h * 31 + byte) % 2**64
    return f"{digits or '0'}-{h:016x}"
