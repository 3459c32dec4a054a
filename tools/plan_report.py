"""Summarise the final (adaptive) physical plan of every query of the catalog.

    python tools/plan_report.py [sf_dir] > PLANS.md

Each query is run once, and AQE's final plan of that run is reported: fact
scans, exchanges, join strategies, top-n limits, partial aggregates, Python
workers and the filters pushed to the lineitem scan.  Of every adaptive plan in
the text, those of cached frames too, only the final part counts, and a cached
frame that several branches read counts once.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfsense.plans.catalog import QUERIES  # noqa: E402
from shelfsense.session import build_session  # noqa: E402


def _column(line: str) -> int:
    """Where a line of a plan's tree begins, after the branches drawn before it."""
    return len(line) - len(line.lstrip(" :|+-"))


def _below(lines: list[str], at: int) -> int:
    """The line after the subtree that starts at line ``at``."""
    end = at + 1
    while end < len(lines) and (not lines[end].strip() or _column(lines[end]) > _column(lines[at])):
        end += 1
    return end


def final_parts(plan: str) -> str:
    """The plan without what AQE replaced, and without repeats of cached frames."""
    lines, out, seen, at = plan.splitlines(), [], set(), 0
    while at < len(lines):
        line = lines[at].strip(" :|+-")
        if line.startswith("== Initial Plan =="):
            # its tree stands below, at the same column or further right
            column = _column(lines[at])
            at += 1
            while at < len(lines) and _column(lines[at]) >= column and not lines[at].strip(" :|+-").startswith("== "):
                at += 1
            continue
        if line.startswith("InMemoryRelation"):
            end = _below(lines, at)
            tree = "\n".join(x[_column(lines[at]):] for x in lines[at:end])
            if tree in seen:
                at = end
                continue
            seen.add(tree)
        out.append(lines[at])
        at += 1
    return "\n".join(out)


def summary(plan: str) -> dict:
    pushed = re.findall(r"lineitem\.parquet.*?PushedFilters: \[([^\]]*)\]", plan, flags=re.S)
    return {
        "lineitem scans": plan.count("lineitem.parquet"),
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "partial aggs": len(re.findall(r"(?:Hash|Sort)Aggregate\([^\n]*partial_", plan)),
        "top-n limits": plan.count("WindowGroupLimit"),
        "Python": len(re.findall(r"MapInArrow|MapInPandas|FlatMapGroups|ArrowEvalPython|BatchEvalPython", plan)),
        "lineitem pushed filters": pushed[0][:90] if pushed else "",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    rows = []
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        # collect() runs the frame's own query execution, whose plan is then final
        df.collect()
        plan = final_parts(df._jdf.queryExecution().executedPlan().toString())
        assert "isFinalPlan=false" not in plan, name
        rows.append((name, summary(plan)))
    cols = list(rows[0][1])
    print("# Final physical plans (AQE) of the catalog's queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf_dir}`. Composite queries read a cached")
    print("store-level base, which counts once however many branches read it.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
