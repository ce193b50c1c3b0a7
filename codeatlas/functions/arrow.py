"""Arrow batches in tasks."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, unless the session says otherwise: 10,000 rows of long texts take much memory, on either side and twice.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors, once per application."""
    sc = df.sparkSession.sparkContext
    if _sent.get("application") != sc.applicationId:
        package = Path(__file__).parent.parent
        with zipfile.ZipFile(Path(tempfile.mkdtemp()) / f"{package.name}.zip", "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(z.filename)
        _sent["application"] = sc.applicationId
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: dict[str, str] = {}
