"""Registered queries against their SQL twins, and the pipeline end to end."""

import pytest
from conftest import SMALL

from codeweft.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck, ORACLES[name])


def test_names():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as P

    from codeweft.llm.common import cut, table

    docs = table(spark, SMALL, "documents")
    names, held = docs.columns, [docs.count()]
    for at, (_, stage) in enumerate(P.STAGES):
        docs = cut(stage(spark, docs, SMALL))
        held.append(docs.count())
        assert docs.columns == names + ["copies"] * (at == len(P.STAGES) - 1)
    assert held[0] > held[1] > held[2] >= held[3] == held[4] >= held[5] > 0


def test_pipeline_leaves_one_table(spark):
    import os

    import corpus_pipeline as P

    from codeweft.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = {x for x in os.listdir(folder) if x.startswith("codeweft-")}
    docs = P.run(spark, SMALL)
    left = {x for x in os.listdir(folder) if x.startswith("codeweft-")} - before
    assert len(left) == 1 and docs.count() > 0


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as P

    from codeweft.llm.common import cut, table

    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, SMALL))
    assert docs.count() == 0
