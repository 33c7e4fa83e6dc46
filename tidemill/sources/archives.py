"""Archives stored as a Parquet table: written once by ingestion, read by every fetch after it.

A folder holds ``rows``, partitioned by archive and by spans of rows so that the archive and the
window of a fetch prune files, sorted by series and time inside each file so that they prune row
groups; and ``definition``, the database's description and its last update as one row of text.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.script import Source
from ..schema import Archive, Database, DataSource

#: Rows of one series in one span of an archive.
SPAN_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address below the one that the cluster names in spark.checkpoint.dir. Only a
    local session may go without, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/tidemill-{uuid.uuid4().hex}"


def local_path(address: str) -> str:
    """The path of a shared folder that is mounted: files of other formats than Spark's are written to it."""
    path = address.removeprefix("file://") if address.startswith("file:") else address
    if "://" in path:
        raise ValueError(f"{address} is no mounted folder")
    path = path.removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def definition(db: Database) -> str:
    return json.dumps(asdict(db))


def defined(text: str) -> Database:
    d = json.loads(text)
    return Database(d["step"], tuple(DataSource(**s) for s in d["sources"]), tuple(Archive(**a) for a in d["archives"]), d["start"], d["last_update"])


def _span(points: DataFrame, db: Database) -> DataFrame:
    seconds = F.create_map(*[F.lit(x) for i, a in enumerate(db.archives) for x in (i, a.pdp_per_row * db.step * SPAN_ROWS)])
    return points.withColumn("span", F.floor(F.col("ts") / seconds[F.col("rra")]).cast("long"))


def store(points: DataFrame, db: Database, folder: str) -> None:
    """points: keys, series, rra, ts, v."""
    rows = _span(points, db)
    keys = [c for c in points.columns if c not in ("rra", "ts", "v", "cf")]
    ranged = rows.repartitionByRange("rra", "span", *keys, "ts").sortWithinPartitions("rra", "span", *keys, "ts")
    ranged.write.partitionBy("rra", "span").parquet(f"{folder}/rows")
    points.sparkSession.createDataFrame([(definition(db),)], "definition string").coalesce(1).write.parquet(f"{folder}/definition")


def load(spark: SparkSession, folder: str) -> Source:
    db = defined(spark.read.parquet(f"{folder}/definition").first()[0])
    return Source(db, spark.read.parquet(f"{folder}/rows"))


def append(source: Source, points: DataFrame, last_update: int, folder: str) -> None:
    """Later rows of the same database, and its new last update."""
    db = replace(source.db, last_update=last_update)
    _span(points, db).write.mode("append").partitionBy("rra", "span").parquet(f"{folder}/rows")
    points.sparkSession.createDataFrame([(definition(db),)], "definition string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/definition")
