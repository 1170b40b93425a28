"""Regions and frames: against all pairs, with no more comparisons than they need."""

import random

import pyarrow as pa

from foliant.operators import regions as rg


def all_pairs(boxes, gap):
    group = list(range(len(boxes)))
    for _ in boxes:
        group = [min(group[j] for j in range(len(boxes)) if rg.touch(a, boxes[j], gap)) for a in boxes]
    return [[i for i, g in enumerate(group) if g == k] for k in sorted(set(group))]


def test_groups_are_those_of_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        boxes = [(x, y, x + r.randrange(30), y + r.randrange(30)) for x, y in ((r.randrange(100), r.randrange(100)) for _ in range(r.randrange(12)))]
        assert rg.groups_of(boxes, 4.0) == all_pairs(boxes, 4.0)


def test_lines_far_apart_are_not_compared(monkeypatch):
    asked, touch = [], rg.touch
    monkeypatch.setattr(rg, "touch", lambda a, b, gap: asked.append(1) or touch(a, b, gap))
    assert len(rg.groups_of([(100.0 * i, 0.0, 100.0 * i + 10, 5.0) for i in range(3_000)], 4.0)) == 3_000
    assert not asked
    drawn = [("rect", 100.0, 100.0, 300.0, 150.0), ("line", 200.0, 100.0, 200.0, 150.0)]
    assert rg.grid_regions(drawn, [], 600, 800) == [] and not asked


def test_frames_no_larger_than_the_best_are_not_filled(monkeypatch):
    filled, fill = [], rg.band_html
    monkeypatch.setattr(rg, "band_html", lambda *a: filled.append(a[0]) or fill(*a))
    drawn = [("rect", x, 10.0, 990.0, 790.0) for x in (10.0, 16.0)] + [("line", 10.0, 400.0, 990.0, 400.0)]
    box, html = rg.container(drawn, [((60.0, 60.0, 100.0, 80.0), "a")], [], 1000, 800)
    assert box == (6.0, 6.0, 994.0, 794.0) and html == "<table><tr><td><p>a</p></td></tr><tr><td></td></tr></table>"
    assert len(filled) == 2


def test_values_of_columns():
    kind = pa.struct([("n", pa.int32()), ("x", pa.float64()), ("s", pa.string())])
    rows = [[{"n": 1, "x": 2.5, "s": "a"}, {"n": None, "x": 3.0, "s": None}], [], [{"n": 7, "x": 0.0, "s": "z"}]]
    column = pa.array([[], *rows, [{"n": 9, "x": 9.0, "s": "9"}]], pa.list_(kind))
    assert rg.values(column.slice(1, 3)) == rows
    for other in (pa.array([None, rows[0]], pa.list_(kind)), pa.array([None, rows[0][0]], kind), pa.array([[None, rows[0][0]]], pa.list_(kind)), pa.array([1, None]), pa.array([True, False]), pa.array([0], pa.timestamp("us"))):
        assert rg.values(other) == other.to_pylist()
