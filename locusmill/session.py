"""What a session needs before the library's Python code runs on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows in a batch that goes to Python. Texts are long: Spark's own 10,000 rows are tens of MB, several times over.
ARROW_ROWS = "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, for workers whose PYTHONPATH doesn't have it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":  # left as it is where it has been set
        spark.conf.set(name, ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="locusmill-"), "locusmill.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("locusmill", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local master may go without that setting."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="locusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/locusmill-{context.applicationId}/{name}-{uuid.uuid4().hex}"
