"""The whole clustering job from delimited text to centre files.

    points text --SRC-1--> two-level FCM (IT-7) --SNK-2--> <output>/merged
                                                --SNK-3--> <output>/final

The seeding sample is keyed on the points themselves, so it does not
depend on how files are packed into splits.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.passes import centers_df
from ..sources.points import read_points, write_centers
from .two_level import BLOCK_ROWS, TwoLevelResult, two_level_fcm


def run_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    k: int,
    dims: int,
    eps: float = 1e-3,
    m: float = 2.0,
    sep: str = " ",
    sample_rows: int = 10_000,
    max_iter: int = 100,
    *,
    seed=0,
    seeds=None,
    block_rows: int | None = BLOCK_ROWS,
    blocks: int | None = None,
    round_weights: bool = True,
    strict: bool = True,
) -> TwoLevelResult:
    points = read_points(spark, input_path, dims, sep, strict, with_id=False)
    res = two_level_fcm(
        points, "features", k, m, eps, max_iter, order_col="features", seeds=seeds, blocks=blocks,
        round_weights=round_weights, sample_rows=sample_rows, seed=seed, block_rows=block_rows, dims=dims,
    )
    write_centers(
        centers_df(spark, res.merged_centers, res.merged_weights),
        f"{output_path}/merged", "text", weights=True, mode="overwrite",
    )
    write_centers(
        centers_df(spark, res.centers), f"{output_path}/final", "text", weights=False,
        mode="overwrite",
    )
    return res
