"""Physical-plan summary of the headline queries, as they would plan at
scale: automatic broadcast joins are switched off so every data-dependent
join shows its shuffle form (explicit, size-bounded broadcasts remain).

    python scripts/plan_report.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])
from margincast import get_spark  # noqa: E402
from margincast.plans.catalog import REGISTRY  # noqa: E402

HEADLINE = ["f5_sales_lines", "a1_weekly_cube", "e2_batch_features", "e3_service_features",
            "e4_dense_features", "a11_product_analysis", "a8_kpis", "p5_grid_search",
            "p8_optimization_report", "w10_row_split"]


def own_plan(plan: str) -> str:
    """Drop the subtrees under InMemoryRelation: a cached frame's plan is
    printed inside every consumer but runs once."""
    keep, skip_indent = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skip_indent is not None and indent > skip_indent:
            continue
        skip_indent = None
        keep.append(line)
        if "InMemoryRelation" in line:
            skip_indent = indent
    return "\n".join(keep)


def summarize(plan: str) -> dict:
    plan = own_plan(plan)
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "bloom": len(re.findall(r"bloom_filter", plan, re.I)),
        "python_udf": len(re.findall(r"BatchEvalPython|ArrowEvalPython", plan)),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan))),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16,
                      extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    print("# Physical plans of the headline queries (auto-broadcast off)\n")
    print("| query | shuffles | single-partition exchanges | broadcasts | sort-merge joins | "
          "windows | runtime bloom filters | Python UDFs |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    pushed = {}
    from margincast.operators.cube import weekly_cube_from_sources
    from margincast.plans.common import sources
    from margincast.sources.driver_tables import DELIVERED
    builders = {"cube_build (not materialized)": lambda: weekly_cube_from_sources(
        sources(spark, sf), DELIVERED, "fashion_", materialize=False)}
    builders.update({n: (lambda n=n: REGISTRY[n][0](spark, sf)) for n in HEADLINE})
    for name, build in builders.items():
        df = build()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        pushed[name] = s["pushed"]
        print(f"| {name} | {s['shuffles']} | {s['single_partition']} | {s['broadcasts']} | {s['smj']} | "
              f"{s['windows']} | {s['bloom']} | {s['python_udf']} |")
    print("\n## Filters pushed into parquet scans\n")
    for name, p in pushed.items():
        print(f"* `{name}`: " + "; ".join(f"`[{x}]`" for x in p if x))


if __name__ == "__main__":
    main()
