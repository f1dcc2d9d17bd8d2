"""Two-level medians: one pass over the rows, the same values as medians of all rows."""

import math
import random
import statistics

import pytest

from rankloom.operators import marts as M

SCHEMA = "run_id string, domain string, canonical_url_hash string, x double, y bigint, flag boolean"


def made_rows(varied, seed):
    rng = random.Random(seed)
    out = [("r", None, None, 1.5, 2, True), ("r", None, None, 2.5, 7, None), ("r", "d0", None, None, None, None)]
    for page in range(60):
        for i in range(rng.randrange(1, 7)):
            own = page < varied
            x = rng.choice([None, 1.0, 2.5, -3.0, 1e300]) if own else (page / 3 if page % 4 else None)
            out.append(("r", f"d{page % 5}", f"p{page}", x, rng.randrange(9) if own else page, rng.choice([True, False, None])))
    return out


def two_levels(rows):
    middle = lambda v: statistics.median(v) if (v := [x for x in v if x is not None]) else None
    mean = lambda v: sum(v) / len(v) if (v := [x for x in v if x is not None]) else None
    pages, groups = {}, {}
    for r in rows:
        pages.setdefault(r[:3], []).append(r[3:])
    for (run, domain, _), values in pages.items():
        x, y, flag = zip(*values)
        groups.setdefault((run, domain), []).append((middle(x), middle(y), mean(flag)))
    return {k: tuple(f(c) for f, c in zip((middle, middle, mean), zip(*v))) for k, v in groups.items()}


@pytest.mark.parametrize("varied", [0, 12, 60])
@pytest.mark.parametrize("limit", [None, 20, 4_000_000])
def test_same_as_medians_of_all_rows(spark, varied, limit):
    rows = made_rows(varied, varied)
    got = {(r.run_id, r.domain): (r.x, r.y, r.flag) for r in M.two_level(spark.createDataFrame(rows, SCHEMA), ["x", "y"], ["flag"], limit=limit).collect()}
    want = two_levels(rows)
    assert got.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(got[key], values):
            assert a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-12), (key, got[key], values)


def test_rows_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = made_rows(0, 3)
    frame = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    M.two_level(frame, ["x", "y"], ["flag"]).collect()
    assert read.value == len(rows)


def test_not_a_number_and_infinities(spark):
    rows = [("r", "d", "p", x, 1, True) for x in (math.nan, math.nan, math.nan)] + [("r", "e", "p", x, 1, True) for x in (math.inf, 1.0)]
    got = {r.domain: r.x for r in M.two_level(spark.createDataFrame(rows, SCHEMA), ["x"], []).collect()}
    assert math.isnan(got["d"]) and got["e"] == math.inf
