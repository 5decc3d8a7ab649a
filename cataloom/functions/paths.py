"""Column functions on document paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Folder of a path, empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def joined(folder: Column, path: Column) -> Column:
    """Corpus-relative form of a path given relative to a folder, or absolute with a leading slash; ``.`` and ``..`` resolved."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none,
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(kept, "/")


#: Two or three version numbers in front of the ending (``Name.1.5.cdm.json``): a snapshot of the unversioned document.
VERSIONED = r"\.\d+\.\d+(\.\d+)?\.cdm\.json$"


def is_live_document(path: Column) -> Column:
    """Documents that take part in name resolution: no manifests, no versioned snapshots."""
    return F.endswith(path, F.lit(".cdm.json")) & ~F.endswith(path, F.lit(".manifest.cdm.json")) & ~F.rlike(path, F.lit(VERSIONED))


def is_entity_document(path: Column) -> Column:
    """Unversioned entity documents: live ones but for the hubs of imports."""
    return is_live_document(path) & (basename(path) != "_allImports.cdm.json")
