"""Make this package importable in Python workers that do not start in the repository."""

from __future__ import annotations

import os
import shutil
import tempfile
from functools import lru_cache, wraps

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@lru_cache(maxsize=8)
def _ship(application: str, context) -> None:
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), f"ledgerlynx-{application}"), "zip", ROOT, "ledgerlynx")
    context.addPyFile(archive)


def shipped(query):
    """The query, after its package has been sent to the workers unless their path has it."""

    @wraps(query)
    def run(spark, sf_dir):
        paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths and os.getcwd() != ROOT:
            _ship(spark.sparkContext.applicationId, spark.sparkContext)
        return query(spark, sf_dir)

    return run
