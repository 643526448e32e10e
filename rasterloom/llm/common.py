"""What the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word patterns see it: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Bytes of a batch that a Python worker gets at once, about; a longer row is a batch of its own.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset on one machine, as in tests, a temporary folder is made and set; on a
    cluster it is an error, since executors would not see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; a lost executor loses none of it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of documents, with null texts empty; other columns are pruned."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From now on the session hands Python workers batches of about ``most`` bytes, unless it has a lower limit; no row is cut."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < held <= most:
        spark.conf.set(name, str(most))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, or with ``_`` after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
