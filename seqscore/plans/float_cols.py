"""Regenerate ``float_columns.json``: the floating-point output columns of every
registered query, so the oracle SQL rounds them exactly as the Spark side does.

    python -m seqscore.plans.float_cols [--sf DIR]
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql.types import DoubleType, FloatType

OUT = os.path.join(os.path.dirname(__file__), "float_columns.json")


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    a = ap.parse_args(argv)
    from seqscore.plans import all_queries
    from seqscore.session import get_spark
    spark = get_spark("local[4]", 4)
    qs, _ = all_queries()
    cur = json.load(open(OUT)) if os.path.exists(OUT) else {}
    for name, fn in qs.items():
        schema = fn(spark, a.sf).schema
        cur[name] = [f.name for f in schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    with open(OUT, "w") as fh:
        json.dump(dict(sorted(cur.items())), fh, indent=1)
    print(f"wrote {len(cur)} entries to {OUT}")


if __name__ == "__main__":
    main()
