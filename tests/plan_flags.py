"""Red flags in physical plans."""

from __future__ import annotations

import re

FLAGS = {
    "cartesian product": r"CartesianProduct",
    "nested loop join": r"BroadcastNestedLoopJoin",
    "row-at-a-time Python": r"BatchEvalPython",
    "window over everything in one task": r"Window \[[^\n]*\n?[^\n]*SinglePartition",
    "unpartitioned window": r"Window \[[^\]]*\], \[[^\]]*ASC|Window \[.*windowspecdefinition\((?!.*,).*\)",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def red_flags(df) -> list[str]:
    plan = plan_of(df)
    found = [name for name, rx in list(FLAGS.items())[:3] if re.search(rx, plan)]
    # a window whose child exchange gathers all rows
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and any("SinglePartition" in x for x in lines[i + 1:i + 6] if "Exchange" in x):
            found.append("window in one task")
    return found
