"""Many turns judged at once: the scores of one model a turn, in a fraction of its time, and waiting rows that are sorted a few times only."""

from time import process_time

import numpy as np
import pandas as pd
import pytest

from plumbline.streaming import forests
from plumbline.streaming.ordered import Fold, InEventOrder

RNG = np.random.default_rng(5)


def points(n, d=2):
    """Numbers of which many are equal, and a few far away."""
    x = RNG.integers(0, 40, (n, d)) / 4.0
    x[RNG.random(n) < 0.02] *= 1e9
    return x


def turns_of(kind, x):
    """Turns of a session, the last of them cut short."""
    ends = np.stack([x[:kind.back].min(0), x[:kind.back].max(0)])
    return [forests.Turn(k, x[max(0, k * kind.turn - kind.back):k * kind.turn], ends if k else None, x[k * kind.turn:(k + 1) * kind.turn])
            for k in range(0 if kind.early else 1, -(-len(x) // kind.turn))]


def same(kind, turns):
    one = [kind.start(t.number, t.before, t.ends).judge(t.x) for t in turns]
    return all((a == b).all() and (g == h).all() and len(a) == len(b) for (a, g), (b, h) in zip(one, kind.judged(turns), strict=True))


def faster(kind, turns, times):
    def timed(work):
        start = process_time()
        work()
        return process_time() - start

    one = timed(lambda: [kind.start(t.number, t.before, t.ends).judge(t.x) for t in turns])
    return min(timed(lambda: kind.judged(turns)) for _ in range(2)) * times < one


@pytest.mark.parametrize("d", [1, 2, 4])
def test_cut_lanes_are_cut_trees(d):
    for kind in (forests.robust_random_cut_forest(20, 0.2, 9, 50), forests.robust_random_cut_forest(2, 0.2, 12, 30)):
        assert same(kind, turns_of(kind, points(1_030, d)))
    assert same(forests.robust_random_cut_forest(20, 0.2, 9, 50), turns_of(kind, np.full((200, d), 3.0)))


def test_cut_lanes_are_faster():
    kind = forests.robust_random_cut_forest(40, 0.2, 6, 160)
    assert faster(kind, turns_of(kind, points(16_000)), 2.5)


def test_endless_numbers_are_judged_one_by_one():
    x = points(900)
    x[5::97] = 1e200
    kind = forests.robust_random_cut_forest(10, 0.2, 8, 30)
    assert same(kind, turns_of(kind, x))


class Map(dict):
    def updateValue(self, key, value):
        self[key] = value

    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def test_overlapping_pages_are_sorted_a_few_times(monkeypatch):
    """Runs that all reach over the whole time, as files of many sources bring them."""
    told = []

    def advance(state, pdf):
        told.append(pdf)
        return (1,), pd.DataFrame({"event_id": pdf["event_id"]})

    order = InEventOrder([("event_id", "bigint"), ("x", "array<double>"), ("t_us", "bigint")], Fold("n long", "event_id long", advance, 1))
    order.init(Handle())
    for k in range(150):
        order.store(pd.DataFrame({"event_id": np.arange(3_000) * 150 + k, "x": [np.array([i, 1.0]) for i in range(3_000)], "t_us": np.arange(3_000) * 1_000_000 + k}))
    rows, sort = [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda df, *a, **b: rows.append(len(df)) or sort(df, *a, **b))
    out = pd.concat(list(order.sweep("a", 10 ** 15)))
    assert (out["event_id"].to_numpy() == np.arange(450_000)).all() and not order.pages
    assert sum(rows) < 4 * 450_000


@pytest.mark.parametrize("d", [1, 2, 3])
def test_half_spaces_of_many_turns(d):
    for kind in (forests.half_space_trees(50, 0.7, 15, 6), forests.half_space_trees(20, 0.5, 7, 3)):
        assert same(kind, turns_of(kind, points(1_230, d)))


def test_half_spaces_of_many_turns_are_faster():
    kind = forests.half_space_trees(50, 0.7, 15, 6)
    assert faster(kind, turns_of(kind, points(16_000)), 3)


@pytest.mark.parametrize("d", [1, 2, 4])
def test_isolation_lanes_are_isolation_trees(d):
    for window in (2, 20, 63, 64):
        kind = forests.windowed_forest(window, 0.15, 5)
        assert same(kind, turns_of(kind, points(window * 12 + 1, d)))
    assert same(kind, turns_of(kind, np.full((200, d), 3.0)))


def test_isolation_lanes_are_faster():
    kind = forests.windowed_forest(50, 0.15, 30)
    assert faster(kind, turns_of(kind, points(4_000)), 6)
