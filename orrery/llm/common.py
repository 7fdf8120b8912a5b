"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.staging import discard, reclaim, scratch_path, staged  # noqa: F401

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(column, step: int = 512):
    """The values of an Arrow column, a few rows at a time as Python objects."""
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()


def released() -> None:
    """Give memory that a finished task has freed back to the system, as workers live on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def crc_part(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo: the fixed folds of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, taken by exact position so that clashing extra names do no harm.

    Of two columns with the same name the first is used.
    """
    fields = [f.name for f in df.schema.fields]
    if len({n.lower() for n in fields}) == len(fields):
        return df.select(*[F.col(f"`{n}`") for n in names])
    seen: dict[str, int] = {}
    fresh = [f"__c{i}" for i in range(len(fields))]
    for i, n in enumerate(fields):
        seen.setdefault(n, i)
    renamed = df.toDF(*fresh)
    return renamed.select(*[F.col(fresh[seen[n]]).alias(n) for n in names])


def tokenizer_path(name: str, root: str | None = None) -> str:
    """Place of a public vocabulary file; the folder is a parameter (ORRERY_TOKENIZERS or root)."""
    base = root or os.environ.get("ORRERY_TOKENIZERS")
    if base:
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)
