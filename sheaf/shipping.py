"""Makes this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def shipped(spark: SparkSession) -> None:
    """Once for each context: sends the package to the workers, unless their PYTHONPATH has it anyway."""
    context = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_sheaf_shipped", False):
        return
    # The driver serves the file itself, so its place on the driver's disk is enough.
    archive = Path(tempfile.mkdtemp(prefix="sheaf-package-")) / "sheaf.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted((_ROOT / "sheaf").rglob("*.py")):
            out.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(archive))
    context._sheaf_shipped = True
