"""Write PLANS.md: what Spark ran for the headline queries.

Usage: python tools/explain_plans.py [sf_dir] [query ...]

Runs each query through the no-op sink with Spark's event log on and reads the
final adaptive plan of every execution it caused from the log, those that write
an intermediate table included. Prints, for each execution, its scans (columns
read, filters pushed) and its operators in the order of the plan.
"""

import json
import os
import re
import sys
import tempfile
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from tessera.plans.registry import all_queries  # noqa: E402
from tessera.session import build_session, drop_cuts  # noqa: E402

SHOWN = re.compile(r"Exchange|Join|Aggregate|Window|Sort\b|Sort$|Generate|Arrow|Pandas|Expand|Union|TakeOrdered|Limit")
SKIPPED = re.compile(r"QueryStage|AQEShuffleRead|ReusedExchange|InputAdapter|WholeStageCodegen|AdaptiveSparkPlan")


def operators(node: dict, out: list[str]) -> list[str]:
    name = node["nodeName"].split(" (")[0].strip()
    if SHOWN.search(name) and not SKIPPED.search(name):
        keys = re.search(r"(?:hashpartitioning|rangepartitioning)\(([^()]*)", node["simpleString"])
        out.append(name + (f"[{re.sub(r'#[0-9]+L?|, ENSURE.*', '', keys[1])}]" if keys and "Exchange" in name else ""))
    elif name.startswith("Scan"):
        meta = node.get("metadata", {})
        columns = re.sub(r"struct<(.*)>", r"\1", meta.get("ReadSchema", ""))
        path = meta.get("Location", "").rsplit("/", 1)[-1].rstrip("]")
        pushed = meta.get("PushedFilters", "[]")
        out.append(f"scan {re.sub('cut-[0-9a-f]+', 'intermediate table', path)} ({columns})" + (f" pushed {pushed}" if pushed != "[]" else ""))
    elif name.startswith("ReusedExchange"):
        out.append("reused exchange")
    for child in node["children"] if not name.startswith("ReusedExchange") else ():
        operators(child, out)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or HEADLINE
    log = tempfile.mkdtemp(prefix="tessera-events-")
    spark = build_session("local[8]", app_name="tessera-plans", shuffle_partitions=16, extra_conf={
        "spark.driver.memory": "12g", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false", "spark.sql.maxMetadataStringLength": "400"})
    for name in names:
        spark.sparkContext.setJobDescription(name)
        all_queries()[name].build(spark, sf).write.format("noop").mode("overwrite").save()
    drop_cuts(spark)
    spark.stop()
    plans, of = {}, {}
    for file in os.listdir(log):
        for line in open(os.path.join(log, file), errors="replace"):
            e = json.loads(line)
            if "sparkPlanInfo" in e:
                plans[e["executionId"]] = e["sparkPlanInfo"]  # the last one is the one that ran
                if e.get("description") in names:
                    of[e["executionId"]] = e["description"]
    text = ["# Executed plans", "", f"Final adaptive plans at {os.path.basename(sf)} on local[8], read from Spark's event log by "
            "`tools/explain_plans.py`: every execution of a query, those that write an intermediate table included. "
            "Joins are broadcast here where tables of this size allow it.", ""]
    for name in names:
        runs = [plans[i] for i in sorted(plans) if of.get(i) == name]
        lists = [operators(p, []) for p in runs]
        total = Counter(re.split(r"[\[ ]", x)[0] for ops in lists for x in ops)
        text += [f"## {name}", "", f"{len(runs)} executions; exchanges {total['Exchange']}, broadcasts {total['BroadcastExchange']}, "
                 f"sort-merge joins {total['SortMergeJoin']}, windows {total['Window']}, Python "
                 f"{total['MapInPandas'] + total['MapInArrow'] + total['ArrowEvalPython']}", ""]
        text += [f"{k + 1}. " + " < ".join(ops) for k, ops in enumerate(lists) if ops] + [""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(text))


if __name__ == "__main__":
    main()
