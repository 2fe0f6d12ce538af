"""The models of ``forests`` for many turns at once. A tree of a turn is a lane, and all lanes take each step together, in arrays; draws and
arithmetic are those of one tree in plain Python, so the scores are the same to the last bit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


# -- random cut trees ---------------------------------------------------------
def total(sides: np.ndarray) -> np.ndarray:
    """Row sums as ``sum`` makes them, which carries along what rounding loses."""
    hi, lost = sides[:, 0], 0.0
    for k in range(1, sides.shape[1]):
        x = sides[:, k]
        both = hi + x
        lost = lost + np.where(np.abs(hi) >= np.abs(x), (hi - both) + x, (x - both) + hi)
        hi = both
    return hi + lost if sides.shape[1] > 2 else hi


class CutLanes:
    """Cut trees as lanes of flat arrays. A node is a number; those of lane k are k * room to (k + 1) * room - 1. Points and boxes are
    rows of the numbers and of the same negated, so that the least of them are a box's low and, negated, high ends."""

    def __init__(self, rngs: Sequence[np.random.Generator], window: int, d: int):
        lanes, room = len(rngs), 2 * window
        self.rngs, self.window = rngs, window
        self.up, self.left, self.right = (np.full(lanes * room, -1) for _ in range(3))
        self.axis, self.n, self.cut = np.zeros(lanes * room, int), np.zeros(lanes * room, int), np.zeros(lanes * room)
        self.box, self.d = np.zeros((lanes * room, 2 * d)), d
        self.free = np.arange(lanes * room).reshape(lanes, room)[:, ::-1].copy()
        self.top, self.root, self.leaves = np.full(lanes, room), np.full(lanes, -1), np.zeros((lanes, window), int)
        self.drawn = np.stack([r.random(8 * window) for r in rngs])
        self.at = np.arange(lanes) * 8 * window

    def refill(self) -> None:
        """A point takes a draw a level at most, and a tree is never deeper than its points."""
        lanes, size = self.drawn.shape
        used = self.at - np.arange(lanes) * size
        for k in np.nonzero(used > size - self.window - 1)[0]:
            self.drawn[k, :size - used[k]] = self.drawn[k, used[k]:].copy()
            self.drawn[k, size - used[k]:] = self.rngs[k].random(used[k])
            self.at[k] = k * size

    def take(self, lane: np.ndarray) -> np.ndarray:
        self.top[lane] = top = self.top.take(lane) - 1
        return self.free.take(lane * self.free.shape[1] + top)

    def instead(self, lane: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        """``new`` takes the place that ``old`` has below the node above it, or as the root."""
        above = self.up.take(old)
        self.up[new] = above
        first = above < 0
        self.root[lane[first]] = new[first]
        above, old, new = above[~first], old[~first], new[~first]
        left = self.left.take(above) == old
        self.left[above[left]] = new[left]
        self.right[above[~left]] = new[~left]

    def delete(self, lane: np.ndarray, name: int) -> None:
        leaf = self.leaves[lane, name]
        copies = self.n.take(leaf) > 1
        node = leaf[copies]
        while node.size:
            self.n[node] -= 1
            node = self.up.take(node)
            node = node[node >= 0]
        lane, leaf = lane[~copies], leaf[~copies]
        above = self.up.take(leaf)
        left = self.left.take(above)
        self.instead(lane, above, np.where(left == leaf, self.right.take(above), left))
        for gone in (leaf, above):
            self.free[lane, self.top[lane]] = gone
            self.top[lane] += 1
        node = self.up.take(above)
        kept = node >= 0
        node, point = node[kept], self.box.take(leaf[kept], 0)
        edge = np.ones(len(node), bool)
        while node.size:
            self.n[node] -= 1
            some = np.nonzero(edge)[0]
            at = node[some]
            edge[some] = touched = (point.take(some, 0) == self.box.take(at, 0)).any(1)
            at = at[touched]
            self.box[at] = np.minimum(self.box.take(self.left.take(at), 0), self.box.take(self.right.take(at), 0))
            node = self.up.take(node)
            kept = np.nonzero(node >= 0)[0]
            node, point, edge = node[kept], point.take(kept, 0), edge[kept]

    def leaf(self, lane: np.ndarray, name: int, point: np.ndarray) -> np.ndarray:
        new = self.take(lane)
        self.box[new], self.n[new], self.up[new], self.left[new], self.right[new] = point, 1, -1, -1, -1
        self.leaves[lane, name] = new
        return new

    def insert(self, lane: np.ndarray, name: int, point: np.ndarray) -> None:
        d, node = self.d, self.root[lane]
        empty = node < 0
        if empty.any():
            self.root[lane[empty]] = self.leaf(lane[empty], name, point[empty])
            lane, node, point = lane[~empty], node[~empty], point[~empty]
        while lane.size:
            was = self.box.take(node, 0)
            now = np.minimum(point, was)
            sides = -(now[:, :d] + now[:, d:])
            whole = total(sides)
            same = whole == 0  # a copy of this leaf's point
            if same.any():
                self.leaves[lane[same], name] = node[same]
                self.n[node[same]] += 1
                kept = np.nonzero(~same)[0]
                lane, node, whole = lane[kept], node[kept], whole[kept]
                point, was, now, sides = (a.take(kept, 0) for a in (point, was, now, sides))
            at = self.at.take(lane)
            drawn = self.drawn.take(at) * whole
            self.at[lane] = at + 1
            place, ahead, side = np.arange(len(lane)) * (2 * d), sides[:, 0], sides[:, 0]
            short = ahead <= drawn
            for k in range(1, d):
                place, ahead, side = place + short, np.where(short, ahead + sides[:, k], ahead), np.where(short, sides[:, k], side)
                short &= ahead <= drawn
            least = now.take(place)
            cut = np.minimum(np.maximum(least + drawn - (ahead - side), least), np.nextafter(-now.take(place + d), -np.inf))
            parts = (cut >= -was.take(place + d)) | (cut < was.take(place))  # the point from the box
            on, out = np.nonzero(~parts)[0], np.nonzero(parts)[0]
            if out.size:
                p, old, at, c, mine = point.take(out, 0), node[out], place[out], cut[out], lane[out]
                new, above = self.leaf(mine, name, p), self.take(mine)
                self.axis[above], self.cut[above], self.box[above] = at % (2 * d), c, now.take(out, 0)
                self.n[above] = self.n.take(old) + 1
                left = point.take(at) <= c
                self.left[above], self.right[above] = np.where(left, new, old), np.where(left, old, new)
                self.instead(mine, old, above)
                self.up[old] = self.up[new] = above
            lane, node, point = lane[on], node[on], point.take(on, 0)
            self.box[node] = now.take(on, 0)
            self.n[node] += 1
            left = point.take(np.arange(len(on)) * (2 * d) + self.axis.take(node)) <= self.cut.take(node)
            node = np.where(left, self.left.take(node), self.right.take(node))

    def displacement(self, lane: np.ndarray, name: int) -> np.ndarray:
        node, most, row = self.leaves[lane, name], np.zeros(len(lane)), np.arange(len(lane))
        n = self.n.take(node)
        while row.size:
            node = self.up.take(node)
            kept = np.nonzero(node >= 0)[0]
            node, row, n = node[kept], row[kept], n[kept]
            above = self.n.take(node)
            most[row] = np.maximum(most[row], (above - n) / n)
            n = above
        return most


def displacements(turns: Sequence[tuple[np.ndarray, int]], window: int, trees: int, seeds: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """For each turn, points in order and the number of them that are not judged: mean displacement of the others, each judged among the last
    ``window`` points up to it."""
    order = sorted(range(len(turns)), key=lambda k: -len(turns[k][0]))  # the turns that are not over yet come first
    lengths = np.array([len(turns[k][0]) for k in order])
    skipped = np.array([turns[k][1] for k in order])
    points = np.zeros((len(turns), lengths[0], turns[0][0].shape[1]))
    for row, k in zip(points, order, strict=True):
        row[:len(turns[k][0])] = turns[k][0]
    points = np.concatenate([points, -points], 2)
    forest = CutLanes([np.random.default_rng([*seeds[k], tree]) for k in order for tree in range(trees)], window, points.shape[2] // 2)
    scores = np.zeros(points.shape[:2])
    for i in range(lengths[0]):
        running = int((lengths > i).sum())
        lane = np.arange(running * trees)
        forest.refill()
        if i >= window:
            forest.delete(lane, i % window)
        forest.insert(lane, i % window, points[:running, i].repeat(trees, 0))
        judged = np.nonzero(skipped[:running] <= i)[0]
        if judged.size:
            lane = (judged[:, None] * trees + np.arange(trees)).ravel()
            scores[judged, i] = forest.displacement(lane, i % window).reshape(-1, trees).mean(1)
    out: list[np.ndarray] = [np.zeros(0)] * len(turns)
    for row, k in enumerate(order):
        out[k] = scores[row, skipped[row]:lengths[row]]
    return out


# -- isolation trees ------------------------------------------------------------
#: Points of a window whose sets fit a word of bits.
MOST = 63


def last_bit(sets: np.ndarray) -> np.ndarray:
    """Places of the highest bits."""
    for by in (1, 2, 4, 8, 16, 32):
        sets = sets | (sets >> np.uint64(by))
    return np.bitwise_count(sets).astype(int) - 1


class Draws:
    """What ``choice`` and ``uniform`` of a lane's generator draw: words of 64 bits, of which a choice takes a half and leaves the other for
    the next choice."""

    def __init__(self, rngs: Sequence[np.random.Generator], words: int):
        kept = [r.bit_generator.state for r in rngs]
        self.words = np.stack([r.bit_generator.random_raw(words) for r in rngs])
        self.at = np.arange(len(rngs)) * words
        self.has = np.array([s["has_uint32"] for s in kept], bool)
        self.half = np.array([s["uinteger"] for s in kept], np.uint64)

    def word(self, lane: np.ndarray) -> np.ndarray:
        at = self.at.take(lane)
        self.at[lane] = at + 1
        return self.words.take(at)

    def uniform(self, lane: np.ndarray) -> np.ndarray:
        return (self.word(lane) >> np.uint64(11)) * (1.0 / 9007199254740992.0)

    def below(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A whole number below each ``n``, which is 2 at least."""
        out, todo = np.zeros(len(lane), int), np.arange(len(lane))
        while todo.size:
            mine, has = lane[todo], self.has.take(lane[todo])
            bits = self.half.take(mine)
            fresh = mine[~has]
            word = self.word(fresh)
            bits[~has] = word & np.uint64(0xFFFFFFFF)
            self.half[fresh] = word >> np.uint64(32)
            self.has[mine] = ~has
            size = n[todo].astype(np.uint64)
            product = bits * size
            out[todo] = product >> np.uint64(32)
            todo = todo[(product & np.uint64(0xFFFFFFFF)) < np.uint64(0x100000000) % size]
        return out


class IsolationLanes:
    """Isolation trees over windows of equally many points, ``trees`` for each, grown depth first. The points of a node are a set of bits for
    each number, in the order of that number."""

    def __init__(self, windows: np.ndarray, rngs: Sequence[np.random.Generator], limit: int, path: Sequence[float]):
        turns, n, d = windows.shape
        lanes, self.trees, one = len(rngs), len(rngs) // turns, np.uint64(1)
        order = windows.argsort(1, kind="stable").transpose(0, 2, 1)
        values = np.full((turns, d, MOST + 1), np.inf)
        values[:, :, :n] = np.take_along_axis(windows.transpose(0, 2, 1), order, 2)
        bits = one << order.argsort(2, kind="stable").astype(np.uint64)
        # (turn, f, p, g): the p least points by number f as bits of number g.
        least = np.zeros((turns, d, n + 1, d), np.uint64)
        for f in range(d):
            for g in range(d):
                least[:, f, 1:, g] = np.take_along_axis(bits[:, g], order[:, f], 1).cumsum(1, dtype=np.uint64)
        least = least.reshape(-1, d)
        self.room = min(2 * n - 1, 2 ** (limit + 1) - 1)
        size = lanes * self.room
        self.feature, self.split, self.value, self.right = np.zeros(size, int), np.full(size, np.nan), np.zeros(size), np.arange(size)
        draws = Draws(rngs, n + n // 2 + 18)
        height = limit + 2
        sets, depth, above = np.zeros((lanes * height, d), np.uint64), np.zeros(lanes * height, int), np.full(lanes * height, -1)
        sets[::height] = (one << np.uint64(n)) - one
        lane, top = np.arange(lanes), np.zeros(lanes, int)
        paths = np.array(path)
        for step in range(self.room):
            place = lane * height + top
            held, deep, up, node = sets.take(place, 0), depth.take(place), above.take(place), lane * self.room + step
            self.right[up[up >= 0]] = node[up >= 0]
            count = np.bitwise_count(held[:, 0]).astype(int)
            base = (lane // self.trees)[:, None] * (d * (MOST + 1)) + np.arange(d) * (MOST + 1)
            some = np.where(held > 0, held, one)
            low = values.take(base + np.bitwise_count((some & -some) - one))
            high = values.take(base + last_bit(some))
            spread = high > low
            ways = spread.sum(1)
            inner = (deep < limit) & (count > 1) & (ways > 0)
            end, on = np.nonzero(~inner)[0], np.nonzero(inner)[0]
            self.value[node[end]] = deep[end] + paths.take(count[end])
            if on.size:
                mine, ways, spread = lane[on], ways[on], spread.take(on, 0)
                nth, several = np.zeros(len(on), int), np.nonzero(ways > 1)[0]
                nth[several] = draws.below(mine[several], ways[several])
                f = (spread.cumsum(1) > nth[:, None]).argmax(1)
                pick = on * d + f
                least_value = low.take(pick)
                t = least_value + (high.take(pick) - least_value) * draws.uniform(mine)
                start, p = base.take(pick), np.zeros(len(on), int)
                for by in (32, 16, 8, 4, 2, 1):
                    p += by * (values.take(start + p + (by - 1)) <= t)
                self.feature[node[on]], self.split[node[on]] = f, t
                part = least.take(((mine // self.trees) * d + f) * (n + 1) + p, 0)
                here, mark = place[on], held.take(on, 0)
                sets[here], depth[here], above[here] = mark & ~part, deep[on] + 1, node[on]
                sets[here + 1], depth[here + 1], above[here + 1] = mark & part, deep[on] + 1, -1
            top = top + np.where(inner, 1, -1)
            lane, top = lane[top >= 0], top[top >= 0]
            if not lane.size:
                break
        self.limit = limit

    def totals(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums over the trees of a turn (``of``) of the depth where each point ends."""
        first = np.arange(len(x)) * x.shape[1]
        base = of * (self.trees * self.room)
        out = np.zeros(len(x))
        for tree in range(self.trees):
            at = base + tree * self.room
            for _ in range(self.limit):
                left = x.take(first + self.feature.take(at)) <= self.split.take(at)
                at = np.where(left, at + 1, self.right.take(at))
            out += self.value.take(at)
        return out


# -- half-space trees -------------------------------------------------------------
def walk(feature: np.ndarray, split: np.ndarray, unit: np.ndarray, levels: int) -> np.ndarray:
    """(level, tree, point): the nodes that points pass."""
    trees, inner = feature.shape
    base, first = np.arange(trees)[:, None] * inner, np.arange(len(unit)) * unit.shape[1]
    at = np.zeros((trees, len(unit)), int)
    out = [at]
    for _ in range(levels):
        node = base + at
        at = 2 * at + 1 + (unit.take(first + feature.take(node)) >= split.take(node))
        out.append(at)
    return np.stack(out)


def mass_scores(feature: np.ndarray, split: np.ndarray, levels: int, before: np.ndarray, befores: Sequence[int], unit: np.ndarray, sizes: Sequence[int], window: int) -> list[np.ndarray]:
    """Scores of points by the masses of the points before their turn: 1 / (1 + density against an even spread), where a tree stops at
    the first node of few points. ``befores`` and ``sizes`` are the numbers of points of each turn."""
    trees, nodes = len(feature), 2 * feature.shape[1] + 1

    def places(x: np.ndarray, counts: Sequence[int]) -> np.ndarray:
        turn = np.arange(len(counts)).repeat(counts)
        return walk(feature, split, x, levels) + (turn * trees + np.arange(trees)[:, None]) * nodes

    mass = np.bincount(places(before, befores).ravel(), minlength=len(befores) * trees * nodes).take(places(unit, sizes))
    few = mass <= 0.1 * window
    few[-1] = True
    level = few.argmax(0)
    end = np.take_along_axis(mass, level[None], 0)[0]
    return np.split(1 / (1 + (end * 2.0 ** level).mean(0) / window), np.cumsum(sizes)[:-1])
