"""Probes of many columns in one pass."""

import random

from dipsift.operators import models, probes


def test_many_columns_as_one_by_one(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(i % 2, "val" if i % 4 == 3 or i % 4 == 0 else "train", i % 2 + r.gauss(0, 0.3), r.gauss(0, 1), None if i else 1.0)
                                  for i in range(800)], "label int, split string, tells double, noise double, gone double").cache()
    specs = [(3, "tells", False), (5, "noise", False), (8, "gone", True), (9, "tells", True)]
    got = {r["probe"]: r.asDict() for r in probes.single_columns(rows, specs).collect()}
    alone = [probes.single_column(rows, n, c, reported_only=only).first().asDict() for n, c, only in specs[:3]]
    assert [got[n] for n in (3, 5, 8)] == alone
    assert got[3]["verdict"] == "FAIL" and got[9]["verdict"] == "REPORTED" and got[9]["gate"] is None
    assert (got[8]["verdict"], got[8]["n"], got[8]["value"]) == ("SKIP", 0, None)


def test_fits_keep_their_order():
    assert models.side_by_side(lambda i: i * i, range(9)) == [i * i for i in range(9)]
