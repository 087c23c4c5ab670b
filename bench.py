"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (test tables), BENCH_CPUS (local cores), BENCH_RUNS
(timed runs per query, after one warm-up). Each time is the median over the
runs of building, planning and fully executing one query. ``raw_*`` start from
the sales tables and include their joins; ``stored_*`` read the counts and moves
as ingest has stored them; ``ingest_*`` are single runs of the two ingests.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from moveatlas import schema as S
from moveatlas.catalog import all_queries
from moveatlas.catalog.sql import YEAR
from moveatlas.operators.aggregates import summary_stats
from moveatlas.operators.geo import transform_coordinates
from moveatlas.operators.lookups import reconcile_admin_codes
from moveatlas.operators.ranking import rank_rows, top_k, top_ranked
from moveatlas.plans import bedtown, flows, hotness, mart, visits
from moveatlas.session import local_session, scratch_path
from moveatlas.sources import counts as C
from moveatlas.sources import moves as M
from moveatlas.sources import sales_view as V

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

RAW = [
    "q02_hotness_top30",
    "q05_bedtown_place_top30",
    "q06_bedtown_district_top30",
    "q12_filled_scores_top30",
    "q14_row_features",
    "q16_young_shop_tour_top30",
    "q20_women_share_top30",
    "q22_teens_twenties_top30",
    "q23_mean_by_purpose",
    "q27_bedtown_against_hotplace",
    "mart_all_indicators",
    "k06_top_destinations",
    "st04_reconcile_admin_codes",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> float:
    started = time.perf_counter()
    run(build())
    return time.perf_counter() - started


def stored_queries(spark, counts_path: str, moves_path: str) -> dict:
    counts, moves = C.scan_counts(spark, counts_path), spark.read.parquet(moves_path)
    history = V.code_history(spark, SF_DIR)
    place = S.PLACE
    return {
        "q02_hotness_top30": lambda: top_ranked(
            hotness.annual_hotness(counts, YEAR), "ANNUAL_HOTNESS", place, 30
        ),
        "q05_bedtown_place_top30": lambda: bedtown.bedtown_top(counts, YEAR),
        "q07_bedtown_ranking": lambda: bedtown.bedtown_ranking(counts, YEAR),
        "q08_ratio_distribution": lambda: summary_stats(
            bedtown.return_ratio(counts, YEAR), "RETURN_RATIO"
        ),
        "q12_filled_scores_top30": lambda: top_ranked(
            visits.fill_zero_scores(visits.ratio_scores(counts, YEAR)),
            "RATIO_SCORE_FILLED", place, 30,
        ),
        "q16_young_shop_tour_top30": lambda: top_k(
            hotness.young_shop_tour(counts, YEAR), "HOTNESS2", place, 30
        ),
        "mart_all_indicators": lambda: mart.indicator_mart(counts, YEAR),
        "k04_rank_places": lambda: rank_rows(
            visits.annual_visitors(counts, YEAR), "YEAR_TOTAL_VISITORS", place
        ),
        "q27_place_profile": lambda: flows.compare_places(flows.place_profile(moves)),
        "k06_top_destinations": lambda: flows.top_destinations(moves, 5),
        "st04_reconcile": lambda: reconcile_admin_codes(moves, history),
        "st05_transform": lambda: transform_coordinates(moves),
    }


def main() -> None:
    spark = local_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = all_queries()
    times: dict[str, float] = {}

    def measure(name: str, build) -> None:
        timed(build)
        times[name] = round(statistics.median(timed(build) for _ in range(RUNS)), 4)

    for name in RAW:
        measure(f"raw_{name}", lambda name=name: catalog[name](spark, SF_DIR))

    counts_path, moves_path = scratch_path(spark, "counts"), scratch_path(spark, "moves")
    started = time.perf_counter()
    C.write_by_month(C.standardise_counts(V.purpose_counts(spark, SF_DIR)), counts_path)
    times["ingest_counts"] = round(time.perf_counter() - started, 4)
    started = time.perf_counter()
    M.optimise_layout(V.moves(spark, SF_DIR), moves_path)
    times["ingest_moves"] = round(time.perf_counter() - started, 4)

    for name, build in stored_queries(spark, counts_path, moves_path).items():
        measure(f"stored_{name}", build)

    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
