"""Write PLANS.md: the physical plan tree of each headline query at an sf folder.

Usage: python scripts/plans.py [sf_dir]
Sink and stream queries are left out (their plans run while building them).
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from postlens.plans.registry import QUERIES  # noqa: E402
from postlens.session import build_session  # noqa: E402

SHOWN = ["clean_text", "score_posts", "top_posts_per_keyword", "analyze_keywords",
         "agreement_by_keyword", "sentiment_by_keyword", "posts_per_keyword", "train_nb",
         "title_join_fanout", "title_join_labels", "newest_posts", "flair_counts", "score_join_by_id"]


def tree(df) -> str:
    """Operator tree with long expressions shortened."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in text.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        lines.append(line if len(line) <= 160 else line[:157] + "...")
    return "\n".join(lines)


def summary(df) -> dict:
    """Counts of the operators that move data, from the physical plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {
        "scans": len(re.findall(r"FileScan \w+ \[", text)) + text.count("Scan ExistingRDD"),
        "hash": text.count("Exchange hashpartitioning"),
        "range": text.count("Exchange rangepartitioning"),
        "round robin": text.count("Exchange RoundRobinPartitioning"),
        "single": text.count("Exchange SinglePartition"),
        "broadcast": text.count("BroadcastExchange"),
        "joins": ", ".join(sorted({m for m in re.findall(r"(\w+Join)\b", text)})) or "-",
        "partial agg": "yes" if "partial_" in text else "-",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8)
    out = ["# PLANS", "",
           f"Physical plans (before adaptive re-planning) of the headline queries at `{Path(sf).name}`,",
           "written by `scripts/plans.py`. Expression lists are cut at 160 characters.", ""]
    rows = []
    for name, query in QUERIES.items():
        rows.append((name, summary(query(spark, sf))))
    cols = list(rows[0][1])
    out += ["## Summary of every registered query", "",
            "Exchanges in the physical plan (before adaptive re-planning): `hash`/`range`",
            "are shuffles by key or range, `round robin` is the spread of a one-split",
            "input, `single` moves rows to one partition, `broadcast` ships a side",
            "that Spark's size check admitted (or the bounded row-index offsets).", "",
            "| query | " + " | ".join(cols) + " |", "|" + " --- |" * (len(cols) + 1)]
    out += [f"| {name} | " + " | ".join(str(v[c]) for c in cols) + " |" for name, v in rows]
    out.append("")
    for name in SHOWN:
        out += [f"## {name}", "", "```text", tree(QUERIES[name](spark, sf)), "```", ""]
    (ROOT / "PLANS.md").write_text("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
