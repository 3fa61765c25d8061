"""Text of executed plans, for tests that look at them."""

import re


def executed(df) -> list[str]:
    """Lines of the plan as it ran, without the plans adaptive execution replaced."""
    df.collect()
    out, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        start = re.search(r"[^ :|+\-*]", line)
        indent = start.start() if start else 0
        if hidden is not None and indent >= hidden:
            continue
        hidden = None
        if "== Initial Plan ==" in line:
            hidden = line.index("==")
            continue
        out.append(line)
    return out


def count(df, node: str) -> int:
    return sum(node in line for line in executed(df))


def executions(spark, job) -> list[tuple[int, str]]:
    """Number and plan of each query that a job has run. Spark keeps a bounded number of past ones."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()

    def listed():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return [found.apply(i) for i in range(max(0, found.size() - 60), found.size())]

    last = max((x.executionId() for x in listed()), default=-1)
    job()
    return [(x.executionId(), x.physicalPlanDescription()) for x in listed() if x.executionId() > last]
