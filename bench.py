"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from demandry.operators import analytics as A  # noqa: E402
from demandry.operators import build as B  # noqa: E402
from demandry.operators import ets as E  # noqa: E402
from demandry.operators import forecast as FC  # noqa: E402
from demandry.operators import policy as P  # noqa: E402
from demandry.operators import sqlapi as Q  # noqa: E402
from demandry.plans import choose, load  # noqa: E402
from demandry.session import build, fresh_path, materialize  # noqa: E402
from demandry.sources import files, tpch  # noqa: E402
from suite import builders, common  # noqa: E402


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    # The driver's machine is given to Spark; on a cluster this is set at submission.
    spark = build(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = fresh_path(spark, "bench")
    # Inputs as a user has them: the ledger as CSV files, the same as one Parquet table.
    files.write_csv(tpch.raw_ledger(spark, sf), f"{root}/ledger")
    yearly = tpch.ledger(spark, sf, "year", "month_no", "product_id", "kind", "qty", "org_id")
    for y in range(1995, 2002):
        files.write_csv(yearly.where(F.col("year") == y), f"{root}/org/raw/data_{y}.csv")
    ledger = materialize(tpch.balanced_ledger(spark, sf, "year", "month_no"), "ledger")
    demand = materialize(B.demand_monthly(ledger), "demand")
    stock = materialize(B.stock_monthly(ledger), "stock")
    series = materialize(B.complete_series(demand), "series")
    best = materialize(FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(series)))), "best")

    def csv_to_monthly() -> None:
        r = load.run(spark, [f"{root}/ledger"])
        run(r.demand_monthly)
        run(r.stock_monthly)

    def six_years_sql() -> None:
        schema = "year int, month_no int, product_id string, kind string, qty double, org_id string"
        found, _ = files.load_years(spark, root, "org", list(range(1995, 2002)), schema=schema)
        union = " UNION ALL ".join(f"SELECT * FROM data_{y}" for y in found)
        run(Q.query(spark, f"SELECT year, sum(qty) AS qty, count(*) AS n FROM ({union}) GROUP BY year"))

    def filtered_sum() -> None:
        run(ledger.where((F.col("month_no") == 1) & (F.col("year") == 1998)).agg(F.sum("qty")))

    jobs = {
        "csv_to_monthly_tables": csv_to_monthly,
        "six_year_files_sql": six_years_sql,
        "filtered_sum": filtered_sum,
        "demand_monthly": lambda: run(common.demand(spark, sf)),
        "running_balance_and_stock": lambda: run(common.stock(spark, sf)),
        "guide_reconciliation": lambda: run(builders.components(spark, sf)),
        "abc": lambda: run(A.abc(demand)),
        "backtest_all_products": lambda: run(FC.metrics(FC.backtest_baselines(series))),
        "ets_backtest_all_products": lambda: run(E.backtest_ets(series)),
        "policy_replay_all_products": lambda: run(P.comparison_kpis(P.replay_comparison(series, stock, best))),
        "recommendations_all_products": lambda: run(choose.recommend(series, demand, stock)),
    }
    times = {}
    for name, job in jobs.items():
        t = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
