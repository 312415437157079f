from .clustered import store_clustered, write_clustered
from .metadata import Bounds, load_bounds, load_subjects
from .publish import Published, current, publish
from .sinks import write_outputs
from .tables import ClinicalTables

__all__ = [
    "Bounds",
    "ClinicalTables",
    "Published",
    "current",
    "load_bounds",
    "load_subjects",
    "publish",
    "store_clustered",
    "write_clustered",
    "write_outputs",
]
