"""Borders that rows touch: exactly at the tolerance, and none behind the last one."""

from chronoweave.operators import planning


def test_touches_at_the_tolerance_and_up_to_the_last_border(spark):
    rows = [(1, "wiring", 30, 104), (1, "wiring", 96, 130), (2, "wiring", 105, 140), (3, "writing", 196, 304), (4, "writing", 396, 405), (5, "wiring", None, 100), (6, "wiring", 100, None)]
    frame = spark.createDataFrame(rows, "entity long, action string, first_s long, last_s long")
    got = {(r.entity, r.border_s): (r.before, r.after, r.bridged) for r in planning.edge_touches(frame, 100, 4, last=300).collect()}
    assert got == {(1, 100): (1, 1, True), (3, 200): (0, 1, False), (3, 300): (1, 0, False), (5, 100): (1, 0, False), (6, 100): (0, 1, False)}
    assert (4, 400) in {(r.entity, r.border_s) for r in planning.edge_touches(frame, 100, 4).collect()}
