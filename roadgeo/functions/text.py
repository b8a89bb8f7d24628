"""File name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column | str) -> Column:
    """File name without directory and without any suffix: ``/x/a.osm.pbf`` -> ``a``.

    A leading dot belongs to the name, so ``.bashrc`` stays.
    """
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^(\.*[^.]*)", 1)


def without_last_suffix(name: Column | str) -> Column:
    """File name without its last suffix: ``a.b.gpx`` -> ``a.b``."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
