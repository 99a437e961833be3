"""Hierarchical Pitman-Yor restaurants of one bucket of contexts, by Gibbs sampling of Chinese-restaurant seatings.

Level 2 has a restaurant for each context, level 1 one for each class of contexts; the contexts of a class share its
restaurant as parent, and all classes, of all buckets, share the root, where each word has one table. A customer of a
restaurant is a token after that context, or a table of a child; of a cell (restaurant, dish) the state is its
customers c and tables t. The root's probabilities are given: the buckets' tables are brought together outside.

A Gibbs move takes a customer of a cell out and seats it anew, given all else: it was alone at its table with the
probability U(c, t), a ratio of generalised Stirling numbers (for many customers by a saddle point), and it opens
a new table in proportion to (theta + d * tables) * P(dish | parent), or joins one in proportion to c - 1 - d * t.
All cells of a level move at once, as in approximate distributed Gibbs sampling; a sweep goes from the contexts to the
classes. A cell of many customers makes c / STEP moves at a time, their outcomes binomial, so that a sweep moves a
share of the customers of every cell; sweeps start from customers seated in order, by growing groups, and go on until
the numbers of tables have settled. Predictive probabilities are averaged over the samples that are kept then.

A context too large for one bucket is split by dish. Its parts are restaurants that know the whole's customers, take
their own tables as their share of the whole's, and have the root as parent.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

STRENGTH, SMALL, CHUNK = 1.0, 128, 1 << 13
STEP, GROWTH, SETTLED, MOST_SWEEPS = 16, 1.15, 0.005, 24
BURN, KEPT, ROUNDS = 4, 4, 4


def discount(counts: np.ndarray) -> float:
    """The usual estimate from the numbers of ones and twos."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


@functools.cache
def alone(d: float) -> np.ndarray:
    """U(c, t) for up to SMALL customers: the probability that a given one of c customers at t tables sits alone."""
    log_s = np.full((SMALL + 1, SMALL + 1), -np.inf)
    log_s[0, 0] = 0
    t = np.arange(1, SMALL + 1)
    for c in range(1, SMALL + 1):
        seated = c - 1 - d * t
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where((t < c) & (seated > 0), log_s[c - 1, 1:] + np.log(np.maximum(seated, 1e-300)), -np.inf)
        log_s[c, 1:] = np.logaddexp(log_s[c - 1, :-1], stay)
    out = np.zeros_like(log_s)
    for c in range(1, SMALL + 1):
        out[c, 1 : c + 1] = np.exp(log_s[c - 1, :c] - log_s[c, 1 : c + 1])
    return out


@functools.cache
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / t), ascending, and c / t times the share of customers that sit alone, where tables are many."""
    log_y = np.linspace(-1e-6, -60, 8000)
    y = np.exp(log_y)
    share = d * (1 - y) / -np.expm1(d * log_y)
    return np.log(share) + (d - 1) * log_y, share


def alone_of_many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """U(c, t) for many customers: within 3 % for 3,000 of them, at discounts of 0.3 and over."""
    at, share = _saddle(d)
    return (t - 1) / c * np.interp(np.log(c / t), at, share)


class Level:
    """Cells of one level: restaurant and dish of each, sparse; c and t change.

    fixed: tables that each restaurant has besides, of cells that never move; scale: its tables over those seen here.
    """

    def __init__(self, rooms: int, room: np.ndarray, dish: np.ndarray, d: float, fixed: np.ndarray | float = 0.0, scale: np.ndarray | float = 1.0):
        self.rooms, self.room, self.dish, self.d, self.fixed, self.scale = rooms, room, dish, d, fixed, scale
        self.c = np.zeros(len(room), np.int64)
        self.t = np.zeros(len(room), np.int64)
        self._of, self._plan = None, ()

    def tables(self) -> np.ndarray:
        return (self.fixed + np.bincount(self.room, self.t, self.rooms)) * self.scale

    def seat(self, c: np.ndarray) -> None:
        """New numbers of customers; tables are kept as far as they can be."""
        self.c = c
        self.t = np.clip(self.t, np.minimum(c, 1), c)

    def begin(self, c: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> None:
        """Seats c customers a cell in order: the first alone, then groups that grow by GROWTH."""
        self.c, self.t = c, np.minimum(c, 1)
        here = self.t.copy()
        top = int(c.max(initial=1))
        sizes = np.unique(np.r_[(GROWTH ** np.arange(int(np.log(top) / np.log(GROWTH)) + 1)).astype(np.int64), top])
        tables, scale = self.fixed + np.bincount(self.room, self.t, self.rooms), np.broadcast_to(self.scale, self.rooms)
        order = np.argsort(-c, kind="stable")
        falling = -c[order]
        for size in sizes:
            # cells of which a second customer has come by now
            those = order[: np.searchsorted(falling, -2 * (1 - 1e-9) * top / size, "right")]
            come = (c[those] * (size / top)).astype(np.int64) if size < top else c[those]
            more = come > here[those]
            live, come = those[more], come[more]
            room, old, t = self.room[live], here[live], self.t[live]
            group = come - old
            fresh = (STRENGTH + self.d * tables[room] * scale[room]) * parent[live]
            stay = np.maximum(old + (group - 1) / 2 - self.d * t, 1e-12)
            new = rng.binomial(group, fresh / (fresh + stay))
            self.t[live] = t + new
            np.add.at(tables, room, new)
            here[live] = come

    def _moving(self) -> tuple:
        """What moves() needs of the customers, which sweeps change on level 1 only."""
        if self._of is not self.c:
            live, still = np.flatnonzero(self.c > 1), np.flatnonzero(self.c <= 1)
            fixed = self.fixed + np.bincount(self.room[still], self.t[still], self.rooms)
            # cells are taken in chunks that a processor's cache holds
            whole, chunks = self.c[live].astype(float), []
            for i in range(0, len(live), CHUNK):
                c = whole[i : i + CHUNK]
                big, lots = np.flatnonzero(c > SMALL), np.flatnonzero(c >= 2 * STEP)
                chunks.append((slice(i, i + CHUNK), c, np.minimum(c, SMALL) * (SMALL + 1), big, lots, (c[lots] // STEP).astype(np.int64)))
            self._of, self._plan = self.c, (live, self.room[live], fixed, chunks)
        return self._plan

    def moves(self, parent: np.ndarray, rng: np.random.Generator, rounds: int) -> None:
        """parent: P(dish | parent) of each cell."""
        live, room, fixed, chunks = self._moving()
        low, t, table, d = parent[live], self.t[live].astype(float), alone(round(self.d, 3)).ravel(), round(self.d, 3)
        for _ in range(rounds):
            # all chunks see the tables as they were before the round
            tables = (fixed + np.bincount(room, t, self.rooms)) * self.scale
            for own, c, row, big, lots, many in chunks:
                before = t[own]
                p = table.take((row + np.minimum(before, SMALL)).astype(np.intp))
                p[big] = alone_of_many(c[big], before[big], d)
                # nobody sits alone at a cell's only table: p is 0 there
                gone = (rng.random(len(c)) < p).astype(float)
                # of several moves, each sees the tables without its own customer's
                gone[lots] = p[lots]
                left = before - gone
                fresh = tables.take(room[own])
                fresh -= gone
                fresh *= self.d
                fresh += STRENGTH
                fresh *= low[own]
                stay = c - 1 - self.d * left
                stay = np.maximum(stay, 1e-12, out=stay)
                stay += fresh
                left += rng.random(len(c)) * stay < fresh
                if len(lots):
                    t_lots = before[lots]
                    out = np.minimum(rng.binomial(many, np.clip(p[lots], 0, 1)), t_lots - 1)
                    left[lots] = t_lots - out + rng.binomial(many, fresh[lots] / stay[lots])
                np.minimum(left, c, out=before)
        self.t[live] = t


@dataclass
class Bucket:
    """The cells of a bucket's contexts, by context; class_of: of each context, SPLIT for parts of a split one.

    customers and scale: of each context; what split ones have in all parts, and how many times their own cells.
    """

    room: np.ndarray
    dish: np.ndarray
    count: np.ndarray
    class_of: np.ndarray
    customers: np.ndarray
    scale: np.ndarray
    dishes: int


#: The class of parts of split contexts.
SPLIT = -1


@dataclass
class Samples:
    """Sums over samples, and what pairs that no training document has need of each.

    seen: the share of each cell of level 2, with its class's; rest: the share of the root by context; back, own1 and
    back1: the parent's share by context, each cell's share in level 1, the root's share by class.
    """

    seen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    back: list[np.ndarray] = field(default_factory=list)
    own1: list[np.ndarray] = field(default_factory=list)
    back1: list[np.ndarray] = field(default_factory=list)


def class_cells(bucket: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, the number of each context's class, cells of level 1, the place of each cell's parent among these); -1: none.

    Level 1 has a cell for each class and dish that a context of the class has: the class's number * dishes + the dish.
    """
    number = np.full(len(bucket.class_of), -1)
    classes, number[bucket.class_of != SPLIT] = np.unique(bucket.class_of[bucket.class_of != SPLIT], return_inverse=True)
    key = number[bucket.room]
    whole = (number >= 0).all()
    inner = slice(None) if whole else np.flatnonzero(key >= 0)
    key = key if whole else key[inner]
    key *= bucket.dishes
    key += bucket.dish[inner]
    cells, where = distinct(key, len(classes) * bucket.dishes)
    if whole:
        return classes, number, cells, where
    up = np.full(len(bucket.room), -1, np.int32)
    up[inner] = where
    return classes, number, cells, up


def first_tables(bucket: Bucket) -> np.ndarray:
    """sent_up() before any sweep, of one table a cell."""
    _, _, cells, up = class_cells(bucket)
    return np.bincount(cells % max(1, bucket.dishes), minlength=bucket.dishes) + np.bincount(bucket.dish[up < 0], minlength=bucket.dishes)


class Restaurants:
    """Both levels of a bucket. Cells of one customer never move: their tables are counted once, and only the others
    (live, live1) have a state; c1, t1 and t2 are of all cells."""

    def __init__(self, bucket: Bucket):
        self.bucket = bucket
        rooms = len(bucket.class_of)
        self.live = np.flatnonzero(bucket.count > 1)
        single = bucket.count == 1
        fixed = np.bincount(bucket.room[single], minlength=rooms).astype(float)
        self.two = Level(rooms, bucket.room[self.live].astype(np.intp), bucket.dish[self.live].astype(np.intp), discount(bucket.count), fixed, bucket.scale)
        self.classes, self.class_number, self.cells, self.up = class_cells(bucket)
        inner = slice(None) if (self.class_number >= 0).all() else np.flatnonzero(self.up >= 0)
        above = self.up[inner]
        tokens = np.bincount(above, bucket.count[inner], len(self.cells))
        self.live1 = np.flatnonzero(tokens > 1)
        lone = np.bincount(self.cells[tokens == 1] // max(1, bucket.dishes), minlength=len(self.classes)).astype(float)
        del tokens
        classes, dishes = np.divmod(self.cells[self.live1], max(1, bucket.dishes))
        children = np.bincount(above, minlength=len(self.cells))
        self.one = Level(len(self.classes), classes, dishes, discount(children), lone)
        del children
        self.single1 = np.bincount(above[single[inner]], minlength=len(self.cells))[self.live1]
        # what of the live cells of level 2 has a parent, and its place among the live ones of level 1
        parent = self.up[self.live]
        self.inner = np.flatnonzero(parent >= 0)
        self.parent = np.searchsorted(self.live1, parent[self.inner])
        self.class_of_live = classes[self.parent]

    @property
    def c1(self) -> np.ndarray:
        return _but_ones(len(self.cells), self.live1, self.one.c)

    @property
    def t1(self) -> np.ndarray:
        return _but_ones(len(self.cells), self.live1, self.one.t)

    @property
    def t2(self) -> np.ndarray:
        return _but_ones(len(self.up), self.live, self.two.t)

    def _customers(self) -> np.ndarray:
        """Of level 1: the tables of level 2."""
        return self.single1 + np.bincount(self.parent, self.two.t[self.inner], len(self.live1)).astype(np.int64)

    def _class_share(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of a class's own tables in each live cell of level 1, share of its parent by class, customers by class)."""
        one = self.one
        whole = STRENGTH + one.fixed + np.bincount(one.room, one.c, one.rooms)
        return (one.c - one.d * one.t) / whole[one.room], (STRENGTH + one.d * one.tables()) / whole, whole

    def _parent(self, prior: np.ndarray) -> np.ndarray:
        """P(dish | parent) of the cells of level 2 that move; prior: P(dish | root) of these."""
        own, rest, _ = self._class_share()
        given = prior.copy()
        given[self.inner] = own[self.parent] + rest[self.class_of_live] * given[self.inner]
        return given

    def sweeps(self, prior: np.ndarray, seed: int, keep: int = 0, burn: int = BURN, most: int = MOST_SWEEPS, rounds: int = ROUNDS) -> Samples:
        """Sweeps until the tables have settled; then `keep` samples, as shares() takes them. prior: P(dish | root)."""
        rng = np.random.default_rng(seed)
        low, given = prior[self.one.dish], prior[self.two.dish]
        self.two.begin(self.bucket.count[self.live].astype(np.int64), given, rng)
        self.one.begin(self._customers(), low, rng)
        sweep, before, end = 0, None, None
        kept = Samples(np.zeros(len(self.up)), np.zeros(len(self.bucket.class_of))) if keep else Samples()
        while end is None or sweep < end:
            self.two.moves(self._parent(given), rng, rounds)
            self.one.seat(self._customers())
            self.one.moves(low, rng, rounds)
            after = np.array([self.two.t.sum(), self.one.t.sum()])
            settled = before is not None and (abs(after - before) <= SETTLED * after).all()
            before = after
            if end is None and (sweep >= burn - 1 and settled or sweep >= most):
                end = sweep + 1 + keep
            elif end is not None:
                self._add(kept, self._sample())
            sweep += 1
        return kept

    def _sample(self) -> tuple:
        """(share of own tables by live cell of level 2, share of the parent by context, the same of level 1, by cell and class)."""
        two, whole = self.two, STRENGTH + self.bucket.customers
        own = (two.c - two.d * two.t) / whole[two.room]
        live1, back1, whole1 = self._class_share()
        # classes follow each other in cells; a last 0 stands for a cell that isn't there
        ends = np.searchsorted(self.cells, np.arange(1, len(whole1) + 1) * np.int64(self.bucket.dishes))
        own1 = np.repeat(np.append((1 - self.one.d) / whole1, 0).astype(np.float32), np.append(np.diff(ends, prepend=0), 1))
        own1[self.live1] = live1
        return own, (STRENGTH + two.d * two.tables()) / whole, own1, back1

    def _add(self, kept: Samples, sample: tuple) -> None:
        own, back, own1, back1 = sample
        alone = (1 - self.two.d) / (STRENGTH + self.bucket.customers)
        # 1 stands for the share that a context without a class passes on
        passed = np.append(back1, 1)
        for i in range(0, len(self.up), 32 * CHUNK):
            part = slice(i, i + 32 * CHUNK)
            room = self.bucket.room[part]
            kept.seen[part] += back[room] * own1[self.up[part]] + np.where(self.bucket.count[part] == 1, alone[room], 0)
        kept.seen[self.live] += own
        kept.rest += back * passed[self.class_number]
        kept.back.append(back)
        kept.own1.append(own1)
        kept.back1.append(back1)

    def sent_up(self) -> np.ndarray:
        """The root's customers by dish: tables of classes and of split contexts."""
        split, dishes = np.flatnonzero(self.up < 0), self.bucket.dishes
        up = np.bincount(self.cells % max(1, dishes), self.t1, dishes)
        if len(split):
            up += np.bincount(self.bucket.dish[split], self.t2[split], dishes)
        return up.astype(np.int64)

    def close(self) -> None:
        """Lets the seatings go, of which shares() needs none."""
        del self.two, self.one, self.live, self.live1, self.single1, self.inner, self.parent, self.class_of_live, self.up

    @functools.cached_property
    def _keys(self) -> np.ndarray:
        return self.bucket.room * np.int64(self.bucket.dishes) + self.bucket.dish

    def shares(self, kept: Samples, room: np.ndarray, kind: np.ndarray, dish: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Averages over samples for pairs: P = share + rest * P(dish | root).

        room: numbers of contexts, -1 of unknown ones; kind: their classes; then for each pair the place of its
        context in these (at) and its dish, -1 of unknown ones. rest comes by context.
        """
        number, n = _found(self.classes, kind), len(kept.back)
        number[kind == SPLIT] = -1
        share, dishes = np.zeros(len(at)), self.bucket.dishes
        known = np.flatnonzero((dish >= 0) & (room[at] >= 0))
        cell = _found(self._keys, room[at[known]] * np.int64(dishes) + dish[known])
        share[known[cell >= 0]] = kept.seen[cell[cell >= 0]]
        # pairs that no training document has: only their class may know the dish
        missing = (dish >= 0) & (number[at] >= 0)
        missing[known[cell >= 0]] = False
        missing = np.flatnonzero(missing)
        up = _found(self.cells, number[at[missing]] * np.int64(dishes) + dish[missing])
        missing, up = missing[up >= 0], up[up >= 0]
        above = room[at[missing]]
        rest = np.full(len(room), float(n))
        rest[number >= 0] = sum(kept.back1)[number[number >= 0]]
        rest[room >= 0] = kept.rest[room[room >= 0]]
        for back, own1 in zip(kept.back, kept.own1):
            share[missing] += np.append(back, 1)[above] * own1[up]
        return share / n, rest / n


def _but_ones(n: int, live: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1 for each cell but the live ones, which have their values once they are seated."""
    out = np.ones(n, np.int64)
    if values.any():
        out[live] = values
    return out


def ordered(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their places before) of long keys from 0 to top; equal keys stay in order. The array is used up."""
    bits = len(keys).bit_length()
    if int(top).bit_length() + bits > 62:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    # the place stands below the key, so that a plain sort will do
    keys <<= bits
    keys |= np.arange(len(keys))
    keys.sort()
    order = (keys & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
    keys >>= bits
    return keys, order


def distinct(keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys in order, the place of each key among these) of keys from 0 to top."""
    keys, order = ordered(keys, top)
    head = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=head[1:])
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(head, dtype=np.int32) - 1
    return keys[head], where


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in ascending keys, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
