"""Python workers may not have this package on their path: it is sent to them once for each application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code with the application, unless that was done."""
    context = spark.sparkContext
    if getattr(context, "_attesto_sent", False):
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="attesto-code-")) / "attesto_code.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(name))
    context._attesto_sent = True
