"""Ranges of ledger numbers for writers that work at the same time.

Each range is one small file in ``<ledger>/_claims``: its name is the first number, its
content how many.  The file is created only where none of that name exists, so of two
writers who want the same number one gets it and the other asks for the next.  Claims
stay: they are what later ones go on from, also when rows are gone.
"""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.session import located

FOLDER = "_claims"
#: Seconds to wait for a claim whose writer has made the file and not yet filled it.
PATIENCE = 30.0


def _created(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call made the file, with its content."""
    store, at = located(spark, path)
    if store.getScheme() == "file":
        # here "create unless it exists" is two steps in Hadoop; a link to a filled file is one
        target = Path(at.toUri().getPath())
        filled = target.with_name(f".{uuid.uuid4().hex}")
        filled.write_text(content)
        try:
            os.link(filled, target)
            return True
        except FileExistsError:
            return False
        finally:
            filled.unlink()
    try:
        out = store.create(at, False)
    except Exception as failed:
        if "AlreadyExists" not in str(failed):
            raise
        return False
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _content(spark: SparkSession, path: str) -> str:
    store, at = located(spark, path)
    stream = store.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _firsts(spark: SparkSession, path: str) -> list[str]:
    store, at = located(spark, f"{path}/{FOLDER}")
    store.mkdirs(at)
    return sorted(x.getPath().getName() for x in store.listStatus(at) if x.getPath().getName().isdigit())


def next_number(spark: SparkSession, path: str) -> int | None:
    """The number after all claimed ones; None where nothing is claimed yet."""
    firsts = _firsts(spark, path)
    if not firsts:
        return None
    until = time.monotonic() + PATIENCE
    while not (size := _content(spark, f"{path}/{FOLDER}/{firsts[-1]}")):
        if time.monotonic() > until:
            raise RuntimeError(f"claim {firsts[-1]} of {path} was never filled: write how many numbers it takes, one at least, into it")
        time.sleep(0.05)
    return int(firsts[-1]) + int(size.split()[0])


def claim(spark: SparkSession, path: str, n: int, existing: int = 0, label: str = "") -> int:
    """The first of ``n`` numbers (one at least) that no other writer gets.  The first
    claim goes on from ``existing`` rows; a ``label`` stays with it."""
    while True:
        first = next_number(spark, path) or existing + 1
        if _created(spark, f"{path}/{FOLDER}/{first:019d}", f"{n} {label}"):
            return first


def claim_of_batch(spark: SparkSession, path: str, n: int, stream: str, batch: int) -> int:
    """As :func:`claim` for a stream's batch, which gets the numbers it had when it is
    run again.  Claims are read backwards, up to the stream's batch before."""
    for name in reversed(_firsts(spark, path)):
        size, _, label = _content(spark, f"{path}/{FOLDER}/{name}").partition(" ")
        of, _, number = label.rpartition(" ")
        if of == stream and int(number) <= batch:
            if int(number) < batch:
                break
            if int(size) != n:
                raise RuntimeError(f"batch {batch} has {n} rows now and claimed {size} numbers before")
            return int(name)
    return claim(spark, path, n, label=f"{stream} {batch}")


def claims(spark: SparkSession, path: str) -> DataFrame:
    """first, last of every claimed range."""
    read = spark.read.text(f"{path}/{FOLDER}", wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(\d+)$", 1).cast("long").alias("first"), F.substring_index("value", " ", 1).cast("long").alias("n"))
    return read.select("first", (F.col("first") + F.col("n") - 1).alias("last"))


def unfilled(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """first, last, rows of claimed ranges of which ``rows`` (a row's range in ``first``)
    has fewer: their writer failed or is at work, or rows are in quarantine."""
    counted = rows.groupBy("first").agg(F.count("*").alias("rows"))
    out = claims(spark, path).join(counted, "first", "left").select("first", "last", F.coalesce("rows", F.lit(0)).alias("rows"))
    return out.where(F.col("rows") < F.col("last") - F.col("first") + 1)
