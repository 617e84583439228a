"""Print the plan lines that show the scale properties of the headline reports.

Lands the derived tables of ``sf_dir`` (order tables bucketed by order id),
then prints, per report, every operator line of the executed plan. Usage::

    python tools/plan_excerpts.py [/root/testdata/sf0.1]
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopframe.plans.registry import load_all  # noqa: E402
from shopframe.session import get_session, scratch_path  # noqa: E402
from shopframe.sources.fixtures import land  # noqa: E402

REPORTS = ["seller_leaderboard", "seller_scorecard", "catalogue_page", "public_comments", "seller_orders",
           "trailing_attempts_hour", "latest_code", "ratings", "moderation_list", "blog_listing"]

def main():
    sf_dir = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1").rstrip("/")
    spark = get_session("local[8]", 8)
    land(spark, sf_dir, scratch_path(spark, f"landed-plans-{uuid.uuid4().hex[:8]}"),
         buckets={"order_items": ("order_id", 8), "shop_orders": ("id", 8)})
    qs = load_all()
    for name in REPORTS:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # final adaptive plan
        text = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {name}\n```")
        for line in text.split("+- == Initial Plan ==")[0].splitlines():
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: \S+ \[[^\]]*\]", "Location: ...", line)
            print(line[:200])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
