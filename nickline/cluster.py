"""Getting this package to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Puts this package on the path of the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="nickline-code-")) / "nickline.zip"
    with zipfile.ZipFile(at, "w") as out:
        for p in sorted(here.rglob("*.py")):
            out.write(p, p.relative_to(here.parent))
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)
