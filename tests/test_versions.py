"""Nearest versions against a search through all of them, and without pairs."""

import random

from pyspark.sql import functions as F

from codeweft.operators import versions as V
from codeweft.plans.registry import QUERIES


def order(version):
    return [(0, -int(p), "") if p.isdigit() else (1, 0, p) for p in version.replace("/", ".").split(".")]


def test_nearest_versions(spark):
    rng = random.Random(4)
    rows = [(i, f"lib{i % 3}", ".".join(str(rng.randint(0, 12)) for _ in range(rng.randint(1, 3))) + rng.choice(["", "-rc"])) for i in range(90)] + [(90, "lib0", "2.3"), (91, "alone", "2.3")]
    at = spark.createDataFrame(rows, "artifact_id long, coordinate string, version string").withColumn("k", V.version_key(F.col("version")))
    for r in V.nearest_versions(at).collect():
        have = sorted({v for _, c, v in rows if c == next(x[1] for x in rows if x[0] == r.id)}, key=order)
        wanted = order(f"{r.id % 11}.3")
        assert r.after == next((v for v in have if order(v) >= wanted), None)
        assert r.before == next((v for v in reversed(have) if order(v) < wanted), None)


def test_no_pairs_of_a_library_are_built(spark):
    for name in ("join11_nearest_version", "ver02_ceiling_of_version"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "(coordinate" not in "".join(line for line in plan.splitlines() if "Join" in line)
