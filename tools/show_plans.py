"""Print ``explain("formatted")`` of registered queries (default sf0.001).

usage: python tools/show_plans.py [sf_dir] query [query ...]
Look for: ReadSchema / PushedFilters at the scans, BroadcastHashJoin only on
bounded sides (vocabulary, per-range totals), WindowGroupLimit before the
shuffle of per-group samples, no CartesianProduct / BroadcastNestedLoopJoin.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    names = [a for a in args if not a.startswith("/")] or ["scored_messages"]
    from threatlens.plans.queries import QUERIES
    from threatlens.session import build_session

    spark = build_session("local[4]")
    for n in names:
        print(f"===== {n} =====")
        QUERIES[n](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
