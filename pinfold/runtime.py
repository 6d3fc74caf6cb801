"""Session helpers shared by every operator: reading tables and cutting lineage.

Lineage is cut by writing Parquet into the shared folder that the cluster names in
``spark.checkpoint.dir`` and reading it back, so a lost executor never takes an
intermediate result with it.  A private folder is used only where the setting is unset,
as in tests.
"""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()
_folders: dict[str, str] = {}
_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch where the session has Spark's default.
BATCH_BYTES = str(16 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application, gone when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _folders[app] = f"{shared.rstrip('/')}/{app}" if shared else tempfile.mkdtemp(prefix="pinfold-")
        files, path = _hadoop(spark, _folders[app])
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def ship_package(spark: SparkSession) -> None:
    """Give the workers of this application the package, once: they may run elsewhere, or
    in a folder from which it cannot be imported."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="pinfold-code-")) / "pinfold_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package, in batches of ``BATCH_BYTES``:
    texts are held several times on either side.  The size is a setting of the session; one
    that was set by anyone else is left alone."""
    ship_package(df.sparkSession)
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(_BATCH):
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{next(_serial)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinfold_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialise`` that nothing reads any more."""
    path = getattr(df, "_pinfold_path", None)
    if path:
        files, place = _hadoop(df.sparkSession, path)
        files.delete(place, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: of compressed files and exploded rows
    Spark knows only a size that is many times too small, and the driver would hold them."""
    return df.hint("merge")


#: Bytes of strings and keys up to which a side of a join is broadcast.
BROADCAST_BYTES = 8 << 20


def broadcast_checked(df: DataFrame, *sized: str) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows, else as it is.

    ``sized`` names string or array columns; every row counts 64 bytes besides.  ``df``
    should be a materialised table, as it is read once to measure it.
    """
    bytes_ = F.lit(64)
    for c in sized:
        bytes_ = bytes_ + F.coalesce((F.octet_length(c) if df.schema[c].dataType.typeName() in ("string", "binary") else 8 * F.size(c)), F.lit(0))
    total = df.agg(F.coalesce(F.sum(bytes_.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
