"""Components of long chains, stars and pairs."""

import random

from strata.llm.components import components
from strata.llm.staging import Stage


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    ids = list(range(70))
    rng.shuffle(ids)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:], strict=False)]
    edges += [(2000, 2000 + k) for k in range(1, 50)] + [(3001, 3000), (3000, 3001), (4000, 4000)]
    stage = Stage(spark, "components")
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), stage, "c").collect()}
    assert got == {i: 0 for i in ids} | {2000 + k: 2000 for k in range(50)} | {3000: 3000, 3001: 3000}
    stage.clear()
