"""Waveform and connectivity analytics on PySpark."""

from __future__ import annotations


def ship(spark) -> None:
    """Send this package to the session's executors, once for each context: their workers import the functions that
    Python stages name, and neither their working folder nor their path need have it."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_wavespark_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # else this is the archive that was sent
        at = os.path.join(tempfile.mkdtemp(prefix="wavespark-"), "wavespark_package.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, files in os.walk(here):
                for f in sorted(files):
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.join("wavespark", os.path.relpath(path, here)))
        sc.addPyFile(at)
    sc._wavespark_sent = True
