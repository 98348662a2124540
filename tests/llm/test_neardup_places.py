"""Where members of a pivot's group are placed: no link between components is lost, and what most members hold stays in their rows."""

import random
from collections import defaultdict

import numpy as np

from symloom.llm import neardup
from symloom.llm.common import Stages, arrow_map

PIVOT = -1


def placed(spark, sets, comp, pivot):
    """apart and its places for sets of positive numbers around a pivot set."""
    raw = [(PIVOT, n, comp[n], np.array(sorted(pivot), dtype=np.uint64).tobytes(), np.array(sorted(x), dtype=np.uint64).tobytes()) for n, x in sets.items()]
    both = spark.createDataFrame(raw, "pivot long, node long, comp long, sp binary, sx binary")
    stages = Stages(spark, "places")
    apart = stages.keep(arrow_map(both, "pivot long, node long, comp long, n int, s int, a long, most int, elements array<long>", neardup._differences(80)), "apart").filter("most > 0")
    return stages, apart


def test_what_most_members_hold_is_not_dealt_by_element(spark):
    pivot = set(range(1, 101))
    # All lack 1, 2 and 3 of the pivot; each two of different components have a number of their own, each two of the same another.
    sets = {n: (pivot - {1, 2, 3}) | {1000 + n // 2, 2000 + n % 20, 3000 + n} for n in range(40)}
    comp = {n: n % 20 for n in sets}
    stages, apart = placed(spark, sets, comp, pivot)
    rare, common = neardup._held(stages, apart)
    assert {(r["e"], r["held"]) for r in rare.collect()} == {(1000 + n // 2, 2) for n in sets}
    assert [(r["pivot"], sorted(r["common"])) for r in common.collect()] == [(PIVOT, [1, 2, 3])]


def test_members_that_link_meet_early(spark):
    pick = random.Random(5)
    pivot = set(range(1, 121))
    sets = {}
    for n in range(220):
        x = set(pivot) - set(pick.sample(range(1, 121), pick.choice([4, 10, 14, 18]))) - {1, 2, 3, 4} | set(pick.sample(range(200, 240), pick.choice([4, 8, 12])))
        if n % 3 == 0:
            x = x | set(range(500, 512)) - set(pick.sample(range(500, 512), 3))
        sets[n] = x
    like = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    comp = {n: PIVOT if like(x, pivot) else n for n, x in sets.items()}
    stages, apart = placed(spark, sets, comp, pivot)
    places = defaultdict(dict)
    for r in neardup._places(stages, apart).collect():
        places[r["node"]][r["key"]] = (r["s"], r["a"], r["pos"])
    links = [(x, y) for x in sets for y in sets if x < y and comp[x] != comp[y] and like(sets[x], sets[y])]
    assert len(links) > 50
    for x, y in links:
        met = [(places[x][k], places[y][k]) for k in places[x].keys() & places[y].keys()]
        assert any(2 * 180 * min(s - p, t - q) >= a + b for (s, a, p), (t, b, q) in met), (x, y)
