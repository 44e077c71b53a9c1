"""List plan shapes that do not scale, over every job a query starts: python tools/plans.py sf0.001 [name ...]."""

from __future__ import annotations

import re
import sys

from pyspark.sql.classic.dataframe import DataFrame

from sievemark.plans import catalog
from sievemark.session import build_session

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def shapes(plan: str) -> list[str]:
    found = [b for b in BAD if b in plan]
    for line in plan.splitlines():
        # a window whose partition list is empty gathers everything in one task
        if re.search(r"\bWindow \[", line) and re.search(r"\], \[[^\]]* (ASC|DESC)[^\]]*\]$", line) and "windowspecdefinition(" in line:
            inside = line.split("windowspecdefinition(", 1)[1]
            # one row per partition (column _part) is a bounded table
            if re.match(r"[^,]* (ASC|DESC)", inside) and not inside.startswith("_part#"):
                found.append("Window without partition: " + line.strip()[:160])
    return found


def main() -> None:
    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session("plans", 8)
    log: list[str] = []
    plain = DataFrame.checkpoint

    def noting(self, *args, **kwargs):
        log.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args, **kwargs)

    DataFrame.checkpoint = noting
    flagged = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and name not in wanted:
            continue
        log.clear()
        df = fn(spark, folder)
        log.append(df._jdf.queryExecution().executedPlan().toString())
        found = sorted({f for plan in log for f in shapes(plan)})
        flagged += bool(found)
        if found:
            print(name, found, flush=True)
    print(f"{flagged} flagged")


if __name__ == "__main__":
    main()
