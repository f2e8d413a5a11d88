"""Gibbs sampling of Chinese-restaurant seatings for hierarchical Pitman-Yor models.

A *family* is a dish of a middle restaurant (previous word, word) with the
dishes that draw from it (one for each word before the previous one). Families
are independent given the totals of restaurants and the root's counts, so that
many of them take a step together in arrays, and a family with far more
customers than the others goes on alone in a plain loop. In both, a customer
leaves, its table vanishes if empty, then one of the family's parent customers
leaves too, and it sits down again given everybody else.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np

#: Below this number of families with a customer left to seat, plain loops are faster.
WIDTH = 48
#: Draws at once for rejected picks: a step with few families tries several times in one go, ``TRIES`` in all and 16 for each at most.
TRIES = 512
#: Families that take their steps side by side: what they touch stays in a core's cache.
BLOCK = 1 << 13
#: Families with more customers are not laid out in arrays, which would take memory; a sweep reseats every customer of theirs too.
SCAN = 1 << 18


@dataclass
class Params:
    """Discount and strength of the root, middle and lowest level."""

    discount: tuple[float, float, float] = (0.7, 0.8, 0.8)
    strength: tuple[float, float, float] = (1.0, 1.0, 1.0)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start .. start + size of each, one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _narrow(x: np.ndarray, more: int) -> np.ndarray:
    """A copy of half the width, where the numbers stay small with ``more`` on top."""
    return x.astype(np.int32 if int(x.max(initial=0)) + more < 1 << 31 else np.int64)


class Seating:
    """Seats of all families of a bucket.

    ``family[i]`` and ``context[i]`` of dish i, its customers ``count[i]``; of
    family f its middle restaurant ``middle[f]``. ``root_c`` and ``root_t`` are
    customers and tables of the family's word at the root, among them
    ``root_own`` customers that this family had sent there. ``extra_*`` hold
    customers and tables of restaurants elsewhere, for restaurants dealt out
    over several buckets. With ``flat`` there is no middle level: every dish
    has that probability, and only ``tables`` and ``sizes`` tell.
    """

    def __init__(self, family, context, count, middle, params: Params, rng, extra_low=None, extra_mid=None, flat: float | None = None):
        self.family, self.context, self.count, self.middle = family, context, count.astype(np.int64), middle
        self.params, self.rng, self.flat, self._laid = params, rng, flat, None
        families, contexts, middles = len(middle), int(context.max(initial=-1)) + 1, int(middle.max(initial=-1)) + 1
        zero = lambda n: (np.zeros(n, np.int64), np.zeros(n, np.int64))
        self.extra_low, self.extra_mid = extra_low or zero(contexts), extra_mid or zero(middles)
        self.low_customers = np.bincount(context, weights=self.count, minlength=contexts).astype(np.int64) + self.extra_low[0]
        self.held = np.bincount(family, weights=self.count, minlength=families).astype(np.int64)
        # Sizes of tables, one dish after another; with no freedom left, the seat of a single customer is fixed.
        self.tables = (self.count > 0).astype(np.int64)
        self._sizes = self.count[self.count > 0]
        self.up_tables = (self.held > 0).astype(np.int64)
        self.up_customers = np.bincount(family, weights=self.tables, minlength=families).astype(np.int64)
        self._up_sizes = self.up_customers[self.up_customers > 0]
        self.root_c = self.root_t = self.root_own = np.zeros(families, np.int64)
        self.root, self.vocabulary = (0, 0), 1

    # Sweeps go on where the last one left the seats; sizes are told from them when they are asked for.

    @property
    def sizes(self) -> np.ndarray:
        if self._sizes is None:
            self._sizes = self._laid.gather(self)
        return self._sizes

    @sizes.setter
    def sizes(self, x: np.ndarray) -> None:
        kept = self.up_sizes
        self._sizes, self._up_sizes, self._laid = x, kept, None

    @property
    def up_sizes(self) -> np.ndarray:
        if self._up_sizes is None:
            self._up_sizes = self._laid.gather_up(self)
        return self._up_sizes

    @up_sizes.setter
    def up_sizes(self, x: np.ndarray) -> None:
        kept = self.sizes
        self._sizes, self._up_sizes, self._laid = kept, x, None

    def know_root(self, c, t, own, total: tuple[int, int], vocabulary: int) -> None:
        self.root_c, self.root_t, self.root_own, self.root, self.vocabulary = c.astype(np.int64), t.astype(np.int64), own.astype(np.int64), total, vocabulary

    def _totals(self) -> None:
        self.low_tables = np.bincount(self.context, weights=self.tables, minlength=len(self.extra_low[0])).astype(np.int64) + self.extra_low[1]
        n = len(self.extra_mid[0])
        self.mid_customers = np.bincount(self.middle, weights=self.up_customers, minlength=n).astype(np.int64) + self.extra_mid[0]
        self.mid_tables = np.bincount(self.middle, weights=self.up_tables, minlength=n).astype(np.int64) + self.extra_mid[1]

    def _p_root(self, f, tables):
        (d, *_), (s, *_) = self.params.discount, self.params.strength
        c = self.root_c[f] - self.root_own[f] + tables
        back = (s + d * self.root[1]) / self.vocabulary
        return (np.maximum(c - d * np.minimum(self.root_t[f], c), 0.0) + back) / (s + self.root[0])

    def predictive(self) -> np.ndarray:
        """Probability of each dish in its lowest restaurant."""
        self._totals()
        (_, d1, d2), (_, s1, s2) = self.params.discount, self.params.strength
        mid = (self.up_customers - d1 * self.up_tables + (s1 + d1 * self.mid_tables[self.middle]) * self._p_root(slice(None), self.up_tables)) / (s1 + self.mid_customers[self.middle])
        return (self.count - d2 * self.tables + (s2 + d2 * self.low_tables[self.context]) * mid[self.family]) / (s2 + self.low_customers[self.context])

    def sweep(self, enter: bool = False) -> None:
        """Reseats customers one by one; with ``enter`` the places are empty and all sit down in turn."""
        if enter or self._laid is None:
            self._laid = _Laid(self, enter)
        self._laid.sweep(self, enter)
        self._sizes = self._up_sizes = None


class _Laid:
    """The families with at least two customers, laid out, and passes over them. It doesn't keep the seating, which keeps it: both go at once."""

    def __init__(self, s: Seating, enter: bool):
        active = np.nonzero(s.held > 1)[0]
        active = active[np.argsort(-s.held[active], kind="stable")]
        hot = int(np.searchsorted(-s.held[active], -SCAN, "left"))  # families beyond SCAN are not laid out
        dishes_at = np.searchsorted(s.family, np.arange(len(s.held) + 1))  # dishes of a family lie side by side
        first, up_first = (np.cumsum(x) - x for x in (s.tables, s.up_tables))
        if enter:
            s.tables[(s.held > 1)[s.family]] = 0
            s.up_customers[active] = s.up_tables[active] = 0
        # Of families that are not laid out, the sizes of the tables of each dish and of the family's own.
        self.alone = {f: range(dishes_at[f], dishes_at[f + 1]) for f in active[:hot].tolist()}
        self.alone_sizes = {d: [] if enter else s.sizes[first[d] : first[d] + s.tables[d]].tolist() for own in self.alone.values() for d in own}
        self.alone_up = {f: [] if enter else s.up_sizes[up_first[f] : up_first[f] + s.up_tables[f]].tolist() for f in self.alone}

        self.fam = fam = active[hot:]
        held = s.held[fam]
        number = dishes_at[fam + 1] - dishes_at[fam]
        self.dishes = dishes = _ragged(dishes_at[fam], number)
        count, total = s.count[dishes], int(held.sum())
        begin, start = np.cumsum(count) - count, np.cumsum(held) - held  # customers, and places for tables, of family k lie at start[k] .. + held[k]
        self.who = np.repeat(np.arange(len(dishes), dtype=np.int32), count)  # the dish of each customer
        tables, up_c, up_t = s.tables[dishes], s.up_customers[fam], s.up_tables[fam]
        self.table, self.size = np.zeros(total, np.int32), np.zeros(total, np.int32)
        # Places that are free: a stack for each dish, a stack for each family, which end before end - tables.
        self.free = np.arange(total, dtype=np.int32)
        if s.flat is None:
            self.up_size, self.up_table, self.up_free = np.zeros(total, np.int32), np.zeros(total, np.int32), np.arange(total, dtype=np.int32)
            if not enter:
                at = _ragged(start, up_t)
                self.up_size[at] = s.up_sizes[_ragged(up_first[fam], up_t)]
                self.up_table[_ragged(start, up_c)] = np.repeat(at, self.up_size[at])
                self.up_free[_ragged(start, held - up_t)] = _ragged(start + up_t, held - up_t)
        self.held, self.start, self.offset = held, start, np.cumsum(number) - number
        self.end = begin + count
        self.count, self.tables, self.context = (x.astype(np.int32) for x in (count, tables, s.context[dishes]))
        self.up_c, self.up_t, self.middle = up_c, up_t, s.middle[fam]
        self.given = None if enter else s.sizes[_ragged(first[dishes], tables)]

    def _line_up(self, sizes: np.ndarray) -> None:
        """Tables of these sizes take the first places of their dishes, and customers go by tables: the order of a sweep."""
        begin, tables = self.end - self.count, self.tables.astype(np.int64)
        at = _ragged(begin, tables).astype(np.int32)
        self.size[:] = 0
        self.size[at] = sizes
        self.table = np.repeat(at, sizes)
        self.free[_ragged(begin, self.count - tables)] = np.nonzero(self.size == 0)[0]

    def sweep(self, s: Seating, enter: bool) -> None:
        if not enter:
            self._line_up(self.size[self.size > 0] if self.given is None else self.given)
        self.given = None
        s._totals()
        more = int(s.held.sum())
        self.low_t, self.mid_t, self.mid_c = (_narrow(x, more) for x in (s.low_tables, s.mid_tables, s.mid_customers))
        self.rnd = _randoms(s.rng).__next__
        for f, own in self.alone.items():
            s.tables[own.start : own.stop], s.up_customers[f], s.up_tables[f] = self._far(s, f, own, enter)
        self._together(s, enter)
        self.low_t = self.mid_t = self.mid_c = self.rnd = None
        s.tables[self.dishes], s.up_customers[self.fam], s.up_tables[self.fam] = self.tables, self.up_c, self.up_t

    # Families in arrays -------------------------------------------------

    def _together(self, s: Seating, enter: bool) -> None:
        rng, flat = s.rng, s.flat
        (_, d1, d2), (_, s1, s2) = s.params.discount, s.params.strength
        who, table, size, free, tables, count, end, context = self.who, self.table, self.size, self.free, self.tables, self.count, self.end, self.context
        low_t, mid_t, mid_c = self.low_t, self.mid_t, self.mid_c
        wide = lambda x: x.astype(np.int64)  # noqa: E731  # an index of this type is not cast at each use, and ``at`` is 30 times as fast if no type has to be cast
        low_1, mid_t_1, mid_c_1 = (x.dtype.type(1) for x in (low_t, mid_t, mid_c))
        if flat is None:
            up_table, up_size, up_free = self.up_table, self.up_size, self.up_free
        ahead_all, root_t_all = (s.root_c - s.root_own)[self.fam].astype(np.float64), s.root_t[self.fam].astype(np.float64)
        root_d, root_s = s.params.discount[0], s.params.strength[0]
        back, root_all = (root_s + root_d * s.root[1]) / s.vocabulary, root_s + s.root[0]

        def pick(low, n, skip, of, by, discount):
            """A table of ``of`` with its customers less the discount as weight, among customers low .. low + n without ``skip``."""
            out = open_ = None
            while True:
                m = len(low)
                tries = min(16, TRIES // m)
                if tries < 2:
                    r = low + (rng.random(m) * n).astype(np.int64)
                    if skip is not None:
                        r += r >= skip
                    k = wide(of[r])
                    ok = rng.random(m) * by[k] >= discount
                else:  # the first of several tries that is not rejected
                    r = low[:, None] + (rng.random((m, tries)) * n[:, None]).astype(np.int64)
                    if skip is not None:
                        r += r >= skip[:, None]
                    k = wide(of[r])
                    ok = rng.random((m, tries)) * by[k] >= discount
                    at = np.arange(0, m * tries, tries) + ok.argmax(1)
                    k, ok = k.ravel()[at], ok.ravel()[at]
                if out is None:
                    out = k
                else:
                    out[open_] = k
                bad = np.nonzero(~ok)[0]
                if not len(bad):
                    return out
                open_ = bad if open_ is None else open_[bad]
                low, n = low[bad], n[bad]
                skip = None if skip is None else skip[bad]

        everything = self.held, self.start, self.start + self.held, ahead_all, root_t_all, self.middle, self.up_c, self.up_t
        for block in range(0, len(self.fam), BLOCK):
            # Views, so that what a block writes is in place.
            held, start, up_end, ahead, root_t, middle, up_c, up_t = (x[block : block + BLOCK] for x in everything)
            below = -held
            width, j = len(held), 0
            while width >= WIDTH or (width and j < 2):
                i = start[:width] + j
                dish = wide(who[i])
                of, in_all, m = wide(context[dish]), count[dish], middle[:width]
                if not enter:
                    old = wide(table[i])
                    left = size[old] - 1
                    size[old] = left
                    g = np.nonzero(left == 0)[0]
                    if len(g):
                        x = dish[g]
                        t = tables[x]
                        free[end[x] - t] = old[g]
                        tables[x] = t - 1
                        np.subtract.at(low_t, of[g], low_1)
                        if flat is None:
                            np.subtract.at(mid_c, m[g], mid_c_1)
                            at, n = start[g], up_c[g]
                            r = at + (rng.random(len(g)) * n).astype(np.int64)
                            up = wide(up_table[r])
                            n -= 1
                            up_c[g] = n
                            up_table[r] = up_table[at + n]
                            left = up_size[up] - 1
                            up_size[up] = left
                            e = np.nonzero(left == 0)[0]
                            if len(e):
                                g = g[e]
                                t = up_t[g]
                                up_free[up_end[g] - t] = up[e]
                                up_t[g] = t - 1
                                np.subtract.at(mid_t, m[g], mid_t_1)
                if flat is None:
                    c0 = ahead[:width] + up_t[:width]
                    p0 = (np.maximum(c0 - root_d * np.minimum(root_t[:width], c0), 0.0) + back) / root_all
                    fresh_up = (s1 + d1 * mid_t[m]) * p0
                    all_up = fresh_up + (up_c[:width] - d1 * up_t[:width])
                    p1 = all_up / (s1 + mid_c[m])
                else:
                    p1 = flat
                seated = (i - end[dish] + in_all) if enter else in_all - 1
                fresh = (s2 + d2 * low_t[of]) * p1
                new = (rng.random(width) * (fresh + (seated - d2 * tables[dish])) < fresh) | (seated == 0)
                o = np.nonzero(~new)[0]
                if len(o):
                    x, at = dish[o], i[o]
                    t = pick(end[x] - in_all[o], seated[o], None if enter else at, table, size, d2)
                    table[at] = t
                    size[t] += 1
                g = np.nonzero(new)[0]
                if len(g):
                    x = dish[g]
                    t = tables[x] + 1
                    tables[x] = t
                    t = wide(free[end[x] - t])
                    table[i[g]] = t
                    size[t] = 1
                    np.add.at(low_t, of[g], low_1)
                    if flat is None:
                        np.add.at(mid_c, m[g], mid_c_1)
                        n = up_c[g]
                        new_up = (rng.random(len(g)) * all_up[g] < fresh_up[g]) | (n == 0)
                        up_c[g] = n + 1
                        e = np.nonzero(~new_up)[0]
                        if len(e):
                            at, n_e = start[g[e]], n[e]
                            t = pick(at, n_e, None, up_table, up_size, d1)
                            up_table[at + n_e] = t
                            up_size[t] += 1
                        e = np.nonzero(new_up)[0]
                        if len(e):
                            a = g[e]
                            t = up_t[a] + 1
                            up_t[a] = t
                            t = wide(up_free[up_end[a] - t])
                            up_table[start[a] + n[e]] = t
                            up_size[t] = 1
                            np.add.at(mid_t, m[a], mid_t_1)
                j += 1
                width = int(np.searchsorted(below, -j, "left"))
            # What the widest families still have to seat.
            for k in range(block, block + width):
                self._near(s, k, j, enter)

    # One family -----------------------------------------------------------

    def _near(self, s: Seating, k: int, done: int, enter: bool) -> None:
        """Customers of a laid-out family from the ``done``-th on."""
        low, high = int(self.start[k]), int(self.start[k] + self.held[k])
        a = int(self.offset[k])
        b = int(self.offset[k + 1]) if k + 1 < len(self.offset) else len(self.dishes)
        a += int(np.searchsorted(self.end[a:b], low + done, "right"))  # dishes before have had their turn
        begin = int(self.end[a] - self.count[a])
        seats, own = (self.table[begin:high] - begin).tolist(), self.size[begin:high].tolist()
        contexts, up_c, up_t = self.context[a:b], int(self.up_c[k]), int(self.up_t[k])
        lows, tables = self.low_t[contexts].tolist(), self.tables[a:b].tolist()
        if s.flat is None:
            ups = (self.up_table[low : low + up_c] - low).tolist(), self.up_size[low:high].tolist(), (self.up_free[low : high - up_t] - low).tolist()
        else:
            ups = [], [], []

        begins = (self.end[a:b] - self.count[a:b] - begin).tolist()
        up_t = self._alone(s, int(self.fam[k]), self.count[a:b].tolist(), lows, tables, lambda n, _: (begins[n], seats, own), low + done - begin, *ups, up_t, enter)
        self.low_t[contexts], self.tables[a:b] = lows, tables
        self.table[begin:high], self.size[begin:high] = np.array(seats, np.int32) + begin, own
        frees = self.count[a:b] - self.tables[a:b]
        self.free[_ragged(self.end[a:b] - self.count[a:b], frees)] = np.nonzero(self.size[begin:high] == 0)[0] + begin
        if s.flat is None:
            up_table, up, spare = ups
            self.up_c[k], self.up_t[k] = len(up_table), up_t
            self.up_table[low : low + len(up_table)], self.up_size[low:high], self.up_free[low : low + len(spare)] = np.array(up_table, np.int32) + low, up, np.array(spare, np.int32) + low

    def _far(self, s: Seating, f: int, dishes: range, enter: bool):
        """All customers of a family that is not laid out, one dish at a time; its tables, and customers and tables of its own."""
        up = self.alone_up[f]
        up_table = array("i", np.repeat(np.arange(len(up), dtype=np.int32), up).tobytes()) if up else array("i")
        counts, contexts = s.count[dishes.start : dishes.stop].tolist(), s.context[dishes.start : dishes.stop]
        lows, tables = self.low_t[contexts].tolist(), s.tables[dishes.start : dishes.stop].tolist()
        last = []

        def keep():
            for d, own in last:
                self.alone_sizes[d] = [x for x in own if x]
            last.clear()

        def lay(n, count):
            keep()
            own = np.zeros(count, np.int32)
            own[: tables[n]] = self.alone_sizes[dishes[n]]
            seats, own = array("i", np.repeat(np.arange(count, dtype=np.int32), own).tobytes()), array("i", own.tobytes())
            seats.extend([0] * (count - len(seats)))
            last.append((dishes[n], own))
            return 0, seats, own

        up_t = self._alone(s, f, counts, lows, tables, lay, 0, up_table, up, [], len(up), enter)
        keep()
        self.low_t[contexts] = lows
        self.alone_up[f] = [x for x in up if x]
        return tables, len(up_table), up_t

    def _alone(self, s, f, counts, lows, all_tables, lay, done, up_table, up, up_spare, up_t, enter) -> int:
        """Customers of one family from the ``done``-th on, in a plain loop; ``lay(n, count)`` tells where dish n begins, seats and sizes."""
        rnd, flat = self.rnd, s.flat
        (_, d1, d2), (_, s1, s2) = s.params.discount, s.params.strength
        m = int(s.middle[f])
        mid_t, mid_c, up_c = int(self.mid_t[m]), int(self.mid_c[m]), len(up_table)
        ahead, root_t = int(s.root_c[f] - s.root_own[f]), int(s.root_t[f])
        root_d, root_s = s.params.discount[0], s.params.strength[0]
        back, root_all = (root_s + root_d * s.root[1]) / s.vocabulary, root_s + s.root[0]
        fresh_up = old_up = 0.0
        for n, count in enumerate(counts):
            if not count:
                continue
            begin, seats, own = lay(n, count)
            low_t, tables = lows[n], all_tables[n]
            # Free places as in the arrays, last ones first: the order of tables, in which a sweep goes, is the same.
            spare, top = [], begin + count
            if count > 1 and tables:
                spare = [k for k in range(begin, top) if not own[k]]
                top = begin
            skip = done - begin if done > begin else 0
            seated, moved = skip if enter else count - 1, True  # moved: tables have changed since they were weighed
            for i in range(begin + skip, begin + count):
                if not enter:
                    k = seats[i]
                    own[k] -= 1
                    if not own[k]:
                        moved = True
                        spare.append(k)
                        tables -= 1
                        low_t -= 1
                        if flat is None:
                            mid_c -= 1
                            r = int(rnd() * up_c)
                            u = up_table[r]
                            up_table[r] = up_table[-1]
                            up_table.pop()
                            up_c -= 1
                            up[u] -= 1
                            if not up[u]:
                                up_spare.append(u)
                                up_t -= 1
                                mid_t -= 1
                if moved:
                    moved = False
                    if flat is None:
                        c0 = ahead + up_t
                        p0 = c0 - root_d * (root_t if root_t < c0 else c0)
                        p0 = ((p0 if p0 > 0.0 else 0.0) + back) / root_all
                        fresh_up, old_up = (s1 + d1 * mid_t) * p0, up_c - d1 * up_t
                        fresh = (s2 + d2 * low_t) * (old_up + fresh_up) / (s1 + mid_c) if seated else 0.0
                    else:
                        fresh = (s2 + d2 * low_t) * flat
                if seated and rnd() * (fresh + seated - d2 * tables) >= fresh:
                    while True:
                        r = begin + int(rnd() * seated)
                        k = seats[r if enter or r < i else r + 1]
                        if rnd() * own[k] >= d2:
                            break
                    own[k] += 1
                else:
                    if spare:
                        k = spare.pop()
                    else:
                        k = top = top - 1
                    own[k], moved = 1, True
                    tables += 1
                    low_t += 1
                    if flat is None:
                        mid_c += 1
                        if up_c and rnd() * (fresh_up + old_up) >= fresh_up:
                            while True:
                                u = up_table[int(rnd() * up_c)]
                                if rnd() * up[u] >= d1:
                                    break
                            up[u] += 1
                        else:
                            if up_spare:
                                u = up_spare.pop()
                                up[u] = 1
                            else:
                                u = len(up)
                                up.append(1)
                            up_t += 1
                            mid_t += 1
                        up_c += 1
                        up_table.append(u)
                seats[i] = k
                seated += enter
            lows[n], all_tables[n] = low_t, tables
        self.mid_t[m], self.mid_c[m] = mid_t, mid_c
        return up_t

    # Sizes ----------------------------------------------------------------

    def gather(self, s: Seating) -> np.ndarray:
        """Sizes of all tables, dish after dish: at rest a dish has one customer."""
        first, out = np.cumsum(s.tables) - s.tables, np.ones(int(s.tables.sum()), np.int64)
        out[_ragged(first[self.dishes], s.tables[self.dishes])] = self.size[self.size > 0]
        for d, x in self.alone_sizes.items():
            out[first[d] : first[d] + len(x)] = x
        return out

    def gather_up(self, s: Seating) -> np.ndarray:
        first, out = np.cumsum(s.up_tables) - s.up_tables, np.ones(int(s.up_tables.sum()), np.int64)
        if s.flat is None:
            out[_ragged(first[self.fam], s.up_tables[self.fam])] = self.up_size[self.up_size > 0]
            for f, x in self.alone_up.items():
                out[first[f] : first[f] + len(x)] = x
        return out


def _randoms(rng, n: int = 4096):
    """Uniform numbers from the generator, drawn by the thousand."""
    return chain.from_iterable(iter(lambda: rng.random(n).tolist(), None))


def seat_root(customers: np.ndarray, base: float, tables: float, params: Params, rng, sweeps: int) -> np.ndarray:
    """Tables of each dish of the root, whose parent is the uniform base: ``tables`` is what the restaurant holds about."""
    discount, strength = params.discount[0], params.strength[0]
    n = len(customers)
    # The root as a lowest level: one family for each dish, and the base above it.
    other = max(0, int(tables) - int((customers > 0).sum()))
    one = Params((1.0, 0.0, discount), (0.0, 1.0, strength))
    s = Seating(np.arange(n), np.zeros(n, np.int64), customers, np.zeros(n, np.int64), one, rng, extra_low=(np.zeros(1, np.int64), np.array([other])), flat=base)
    for k in range(1 + sweeps):
        s.sweep(enter=k == 0)
    return s.tables
