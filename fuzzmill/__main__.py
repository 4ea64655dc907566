"""Command line, for running the two jobs the same way as before:

  python -m fuzzmill job   INPUT OUTPUT CENTERS DIMS EPS FUZZINESS SEP COUNT ITERATIONS
  python -m fuzzmill sweep INPUT OUTPUT DIMS CENTERS EPS FUZZINESS SEP COUNT ITERATIONS \
                           SAMPLES SAMPLE_ROWS REPEATS EPS_LIST CENTERS_LIST

``job`` clusters delimited text (two-level FCM; COUNT is the seeding
sample size) and writes OUTPUT/merged and OUTPUT/final.  ``sweep`` runs
the timing grid over samples of INPUT (grids read from one-value-per-line
files) and appends the result table to OUTPUT, one folder per varied
parameter, row by row as the runs end (COUNT bounds the rows that seed
the two-level form).  The positional order is fixed.  The session comes from spark-submit / the environment.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.job import run_job
from .plans.sweep import sweep
from .sources.points import read_grid, read_points


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="fuzzmill")
    sub = ap.add_subparsers(dest="cmd", required=True)
    j = sub.add_parser("job")
    for name, kind in [
        ("input", str), ("output", str), ("centers", int), ("dims", int), ("eps", float),
        ("fuzziness", float), ("sep", str), ("count", int), ("iterations", int),
    ]:
        j.add_argument(name, type=kind)
    s = sub.add_parser("sweep")
    for name, kind in [
        ("input", str), ("output", str), ("dims", int), ("centers", int), ("eps", float),
        ("fuzziness", float), ("sep", str), ("count", int), ("iterations", int),
        ("samples", int), ("sample_rows", int), ("repeats", int), ("eps_list", str),
        ("centers_list", str),
    ]:
        s.add_argument(name, type=kind)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"fuzzmill-{a.cmd}").getOrCreate()
    if a.cmd == "job":
        res = run_job(
            spark, a.input, a.output, a.centers, a.dims, a.eps, a.fuzziness, a.sep,
            a.count, a.iterations,
        )
        print(res.input_weight)
        return
    # keyed on the points themselves, as the job is: samples do not depend on splits
    pts = read_points(spark, a.input, a.dims, a.sep, with_id=False)
    res = sweep(
        pts, "features", id_col="features", dims=a.dims,
        ks=read_grid(spark, a.centers_list, "int"), epsilons=read_grid(spark, a.eps_list),
        k=a.centers, eps=a.eps, samples=a.samples, sample_rows=a.sample_rows,
        repeats=a.repeats, m=a.fuzziness, max_iter=a.iterations, seed_rows=a.count, path=a.output,
    )
    print(res.count())


if __name__ == "__main__":
    main()
