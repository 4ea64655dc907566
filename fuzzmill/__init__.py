"""Fuzzy c-means clustering on Spark."""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside tasks (Arrow kernels) are
# pickled by value, so executors need no install of the package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .plans.fcm import fcm, fcm_chunked, seed_centers  # noqa: E402
from .plans.job import run_job  # noqa: E402
from .plans.kmeans import assign, describe_clusters, fuzzy_kmeans, kmeans  # noqa: E402
from .plans.sweep import sweep, write_sweep  # noqa: E402
from .plans.two_level import merge_fcm, partial_fcm, polish, two_level_fcm  # noqa: E402
from .sources.points import (  # noqa: E402
    points_from_columns,
    read_centers,
    read_grid,
    read_points,
    read_weighted_centers,
    write_centers,
    write_points,
)
from .streaming.stream_fcm import stream_fcm  # noqa: E402

__all__ = [
    "assign", "describe_clusters", "fcm", "fcm_chunked", "fuzzy_kmeans", "kmeans",
    "merge_fcm", "partial_fcm", "points_from_columns", "polish", "read_centers",
    "read_grid", "read_points", "read_weighted_centers", "run_job", "seed_centers",
    "stream_fcm", "sweep", "two_level_fcm", "write_centers", "write_points", "write_sweep",
]
