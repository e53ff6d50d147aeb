"""Optimal one-to-one assignment: as many pairs as possible, of the least summed distance, with a dual bound as certificate.

A block (pairs of different blocks share no entity) of at most `part` entities is solved by one task, by shortest augmenting paths
in a dense matrix: a path starts at any entity that is free and ends at the nearest free one of the other side, so after each path
the pairs so far are the best of their number. Entities may stand for classes of equal ones: then a path carries as many units as
all its classes have, and work and memory grow with the classes, whatever their sizes. `gap` is how far the total may lie over the
dual bound of the final potentials; it is infinite if the pairs were fewer than a cover of the block.

A larger block is auctioned between its entities. The problem is doubled so that every side is matched in full: persons are all a
and a mirror of all b, objects all b and a mirror of all a. A pair (a, b) is worth bonus + most - distance both ways, and each
entity may take its own mirror for nothing. The bonus is over the summed distances of a block, so one more pair always counts for
more. Both ways give an assignment; the better one stays. Persons bid for the object of the best value less price, and raise its
price by the lead over the second best plus epsilon, which falls by FALL from phase to phase; prices stay. Tasks bid for their own
persons against prices as of the last round, the highest bid for an object wins (a group by object and max_by), and who was outbid
bids again in the next round, until no person is free and the next phase begins. Prices and owners are written after each round.

Certificate of the auction: for any prices the sum of all prices and of each person's best value less price is at least twice the best total;
`gap` is how far a block's total may lie under it, at most `tolerance` for each of its persons and less if the bound is tight.

Defined results: pairs that occur several times count with their least distance; null ids or distances are left out; an empty table
gives an empty result. Of equally good assignments any may be returned, the same one in each run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import forget, keep
from . import tiles
from .ranked import running

PART, FALL = 4096, 6.0
#: Bids of a task in a round at most.
BIDS = 200_000
_STATE = "block long, object long, price double, owner long"
_NAMES = ["block", "object", "price", "owner"]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]


def _epsilons(most: float, last: float) -> list[float]:
    out = [max(most, last) / FALL]
    while out[-1] > last:
        out.append(max(out[-1] / FALL, last))
    return out


class _Auction:
    """The persons of a task, the objects that they may take, and their bids."""

    def __init__(self, person, obj, value, price, owner):
        self.persons, begins = np.unique(person, return_index=True)
        self.objects, place = np.unique(obj, return_inverse=True)
        ends = np.append(begins[1:], len(person))
        self.choices = [(place[a:b], value[a:b]) for a, b in zip(begins, ends, strict=True)]
        self.price, self.holder, self.changed = np.zeros(len(self.objects)), np.full(len(self.objects), -1), np.zeros(len(self.objects), dtype=bool)
        self.price[place] = price
        row = np.searchsorted(self.persons, owner)
        mine = (owner >= 0) & (self.persons[np.minimum(row, len(self.persons) - 1)] == owner)
        self.holder[place[mine]] = row[mine]

    def bid(self, epsilon: float, most: int):
        holds = np.zeros(len(self.persons), dtype=bool)
        holds[self.holder[self.holder >= 0]] = True
        free = np.flatnonzero(~holds).tolist()
        while free and most:
            i = free.pop()
            at, value = self.choices[i]
            net = value - self.price[at]
            k = int(net.argmax())
            lead = net[k]
            net[k] = -np.inf
            # a person without another choice raises the price by epsilon alone; no other bidder can make it lose by that
            self.price[at[k]] += (lead - net.max() if len(net) > 1 else 0.0) + epsilon
            if self.holder[at[k]] >= 0:
                free.append(int(self.holder[at[k]]))
            self.holder[at[k]] = i
            self.changed[at[k]] = True
            most -= 1


def _bids(epsilon: float):
    """Rows sorted by block, part, person in; changed objects of each block and part out."""

    def solved(rows: list[np.ndarray]):
        block, _, person, obj, value, price, owner = rows
        a = _Auction(person, obj, value, price, owner)
        a.bid(epsilon, BIDS)
        at = np.flatnonzero(a.changed)
        taken = a.holder[at]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([np.full(len(at), block[0]), a.objects[at], a.price[at], np.where(taken >= 0, a.persons[taken], -1)], _TYPES, strict=True)], names=_NAMES)

    def run(frames: Iterator[pa.RecordBatch]):
        waiting: list[np.ndarray] | None = None
        for f in frames:
            rows = [f.column(i).to_numpy() for i in range(7)]
            if waiting is not None:
                rows = [np.concatenate(x) for x in zip(waiting, rows, strict=True)]
            cuts = [0, *(np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from solved([x[a:b] for x in rows])
            waiting = [x[cuts[-1] :] for x in rows]
        if waiting is not None and len(waiting[0]):
            yield from solved(waiting)

    return run


def _round(edges: DataFrame, state: DataFrame | None, epsilon: float) -> DataFrame:
    """block, object, price, owner of the objects that got bids; of several the highest, of equals the least person's."""
    if state is None:
        rows = edges.withColumns({"price": F.lit(0.0), "owner": F.lit(-1).cast("long")})
    else:
        rows = edges.join(state, ["block", "object"], "left").withColumns({"price": F.coalesce("price", F.lit(0.0)), "owner": F.coalesce("owner", F.lit(-1).cast("long"))})
    rows = rows.select("block", "part", "person", "object", "value", "price", "owner").repartition("block", "part").sortWithinPartitions("block", "part", "person", "object")
    bids = rows.mapInArrow(_bids(epsilon), _STATE)
    best = bids.groupBy("block", "object").agg(F.max_by(F.struct("price", "owner"), F.struct("price", -F.col("owner"))).alias("x"))
    return best.select("block", "object", "x.price", "x.owner")


def _dealt(edges: DataFrame, persons: int, most: float, last: float) -> DataFrame:
    """The final state of blocks that are dealt to several tasks."""
    state = None
    for epsilon in _epsilons(most, last):
        if state is not None:
            before, state = state, keep(state.withColumn("owner", F.lit(-1).cast("long")), "auction-phase")
            forget(before)
        while True:
            new = _round(edges, state, epsilon)
            if state is not None:
                new = state.join(new.withColumnsRenamed({"price": "_price", "owner": "_owner"}), ["block", "object"], "full")
                new = new.select("block", "object", F.coalesce("_price", "price").alias("price"), F.coalesce("_owner", "owner").alias("owner"))
            before, state = state, keep(new, "auction-round")
            if before is not None:
                forget(before)
            if state.filter("owner >= 0").count() == persons:
                break
    return state


def _cheapest(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray):
    """The flow of most units and least cost from rows to columns (cost inf: no way): rows, columns, units, and its gap."""
    m, n = cost.shape
    u, v, sink = np.zeros(m), np.zeros(n), 0.0  # potentials; cost + u - v is never negative, and u is 0 in rows with units left
    free, want, flow = supply.copy(), demand.copy(), [{} for _ in range(n)]
    who = cost.argmin(axis=0)
    near = cost[who, np.arange(n)]  # of the rows with units left
    while True:
        far, before, done = near - v, who.copy(), np.zeros(n, dtype=bool)
        apart, via = np.where(free > 0, 0.0, np.inf), np.full(m, -1)
        open_ = far.copy()  # inf where done
        while True:
            j = int(open_.argmin())
            d = open_[j]
            if d == np.inf:
                break
            done[j], open_[j] = True, np.inf
            if want[j]:
                break
            for i in flow[j]:
                if apart[i] == np.inf:
                    apart[i], via[i] = d, j
                    new = np.maximum(cost[i] + (d + u[i]) - v, d)
                    better = np.flatnonzero((new < far) & ~done)
                    far[better] = open_[better] = new[better]
                    before[better] = i
        if d == np.inf:
            break
        u += np.minimum(apart, d)
        v += np.minimum(far, d)
        sink += d
        path, i = [(j, int(before[j]))], int(before[j])
        while not free[i]:
            path.append((int(via[i]), int(before[via[i]])))
            i = path[-1][1]
        units = min(want[j], free[i], *[flow[c][r] for (_, r), (c, _) in zip(path, path[1:], strict=False)])
        want[j] -= units
        free[i] -= units
        for k, (c, r) in enumerate(path):
            flow[c][r] = flow[c].get(r, 0) + units
            if k:
                r = path[k - 1][1]
                flow[c][r] -= units
                if not flow[c][r]:
                    del flow[c][r]
        if not free[i]:
            left, lost = np.flatnonzero(free), np.flatnonzero(who == i)
            if len(left):
                who[lost] = left[cost[np.ix_(left, lost)].argmin(axis=0)]
                near[lost] = cost[who[lost], lost]
            else:
                near[:] = np.inf
    rows, columns, units = (np.array(x, dtype=np.int64) for x in zip(*((r, c, k) for c, of in enumerate(flow) for r, k in sorted(of.items())), strict=True))
    cover = supply[apart == np.inf].sum() + demand[done].sum()
    beta = np.maximum(sink - v, 0.0)
    alpha = np.array([max(x, (sink - row - beta).max()) for x, row in zip(u, cost, strict=True)])
    bound = sink * units.sum() - (supply * alpha).sum() - (demand * beta).sum()
    return rows, columns, units, max((cost[rows, columns] * units).sum() - bound, 0.0) if units.sum() == cover else np.inf


_FLOW = "block long, a long, b long, d double, n long, at_a long, at_b long, gap double"


def _solved(frames: Iterator[pa.RecordBatch]):
    """block, a, b, d, na, nb, sorted by block, in; units of each pair of classes, and the numbers of their first members, out."""

    def solve(block: int, parts: list[list[np.ndarray]]):
        a, b, d, na, nb = (np.concatenate(x) for x in zip(*parts, strict=True))
        (left, at_a, i), (right, at_b, j) = (np.unique(x, return_index=True, return_inverse=True) for x in (a, b))
        cost = np.full((len(left), len(right)), np.inf)
        cost[i, j] = d
        r, c, n, gap = _cheapest(cost, na[at_a], nb[at_b])
        begins = []
        for of in (r, c):
            order = np.argsort(of, kind="stable")
            sums, ids = np.cumsum(n[order]) - n[order], of[order]
            first = np.searchsorted(ids, ids)
            begins.append(np.empty(len(of), dtype=np.int64))
            begins[-1][order] = sums - sums[first]
        values = [np.full(len(r), block), left[r], right[c], cost[r, c], n, *begins, np.full(len(r), gap)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=[x.split()[0] for x in _FLOW.split(", ")])

    parts, now = [], None
    for f in frames:
        block, *rows = (f.column(k).to_numpy() for k in range(6))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if parts and block[x] != now:
                yield solve(now, parts)
                parts = []
            now = int(block[x])
            parts.append([c[x:y] for c in rows])
    if parts:
        yield solve(now, parts)


def _members(own: DataFrame | None, found: DataFrame, key: str) -> DataFrame:
    """id, of, number: the members of each class, counted from 0; without classes each entity is its own."""
    if own is None:
        return found.select(F.col(key).alias("id"), F.col(key).alias("of")).distinct().withColumn("number", F.lit(0).cast("long"))
    own = own.toDF("id", "of").select(*[F.col(c).cast("long").alias(c) for c in ("id", "of")])
    return keep(running(own, ["of"], ["id"], {"number": F.lit(1)}), "assign-members")


def _member(of: DataFrame, key: str, number: str) -> DataFrame:
    return of.select(F.col("of").alias(key), F.col("number").alias(number), F.col("id").alias(f"{key}_id"))


def _expanded(flows: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """Pairs of members for the units of flows between classes."""
    units = flows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumns({"x": F.col("at_a") + F.col("k"), "y": F.col("at_b") + F.col("k")})
    found = units.join(_member(of_a, "a", "x"), ["a", "x"]).join(_member(of_b, "b", "y"), ["b", "y"])
    return found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("d").alias("distance"), "block", "gap")


def assignment(pairs: DataFrame, a: str, b: str, distance: str, block: str, tolerance: float = 1e-9, part: int = PART, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """a, b, distance, block, gap: the optimal one-to-one pairs of each block; a, b and block are longs, distances are not negative.

    left and right, if given, list the members of the classes that pairs are of, as (a, its class) and (b, its class), each a once."""
    least = pairs.select(F.col(block).cast("long").alias("block"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(distance).cast("double").alias("d")).na.drop()
    least = keep(least.groupBy("block", "a", "b").agg(F.min("d").alias("d")), "assign-pairs")
    of_a, of_b = _members(left, least, "a"), _members(right, least, "b")
    sizes = [t.groupBy(F.col("of").alias(k)).agg(F.count(F.lit(1)).alias(f"n{k}")) for t, k in ((of_a, "a"), (of_b, "b"))]
    large = keep(least.groupBy("block").agg((F.count_distinct("a") + F.count_distinct("b")).alias("n")).filter(F.col("n") > part).select("block"), "assign-large")
    some = not large.isEmpty()
    small = (least.join(large, "block", "left_anti") if some else least).join(sizes[0], "a").join(sizes[1], "b").select("block", "a", "b", "d", "na", "nb")
    # a block is work, not bytes: no two of them are put together for being small
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flows = keep(small.repartition(tasks, "block").sortWithinPartitions("block", "a", "b").mapInArrow(_solved, _FLOW), "assign-flows")
    found = _expanded(flows, of_a, of_b)
    if not some:
        return found
    entities = least.join(large, "block", "left_semi").join(_member(of_a, "a", "x"), "a").join(_member(of_b, "b", "y"), "b")
    return found.unionByName(_auctioned(keep(entities.select("block", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "d"), "auction-pairs"), tolerance, part))


def _carried(edges: list[list[tuple[int, int]]], supply: list[int], demand: list[int], most: int, v: list[int], held: list[tuple[int, int, int, int]]):
    """Units of rows sent to columns at least cost; a unit may stay at home for `most`. All costs are integers, so nothing is rounded.

    edges: (column, cost) of each row; v: prices to start with, and held: row, column, units, cost of an older flow, kept where it is tight.
    Returns u, v and the flow of each column; no edge costs less than u + v, and all that carry units cost just that."""
    u = [min(min((c - v[j] for j, c in e), default=most), most) for e in edges]
    free, want, flow, home = list(supply), list(demand), [{} for _ in demand], [0] * len(edges)
    for i, j, units, c in held:
        if c - v[j] == u[i]:
            flow[j][i] = units
            free[i] -= units
            want[j] -= units
    left, steps, later = [i for i in range(len(edges)) if free[i]], 20 * len(edges), []
    while left and steps:
        # rows take their best column, at the price of their second best
        i = left.pop()
        while free[i] and steps:
            steps -= 1
            first, second, at = most, most, -1
            for j, c in edges[i]:
                x = c - v[j]
                if x < first:
                    first, second, at = x, first, j
                elif x < second:
                    second = x
            u[i] = first
            if at < 0:
                home[i] += free[i]
                free[i] = 0
            elif want[at]:
                units = min(free[i], want[at])
                flow[at][i] = flow[at].get(i, 0) + units
                free[i] -= units
                want[at] -= units
            elif second > first and free[i] + flow[at].get(i, 0) >= demand[at]:
                v[at] -= second - first
                u[i] = second
                for r, units in flow[at].items():
                    free[r] += units
                    if r != i:
                        left.append(r)
                flow[at] = {i: demand[at]}
                free[i] -= demand[at]
            else:
                later.append(i)
                break
    for start in [*later, *left]:
        while free[start]:
            apart, via, best, before, done, heap = {start: 0}, {}, {}, {}, {}, []
            limit, last, rows, d = None, None, [start], 0
            while True:
                for i in rows:
                    base = d - u[i]
                    if limit is None or base + most < limit:
                        limit, last = base + most, -1 - i
                    for j, c in edges[i]:
                        x = base + c - v[j]
                        if x < limit and (j not in best or x < best[j]):
                            best[j], before[j] = x, i
                            if want[j]:
                                limit, last = x, j
                            else:
                                heapq.heappush(heap, (x, j))
                while heap and heap[0][1] in done:
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= limit:
                    break
                d, j = heapq.heappop(heap)
                done[j], rows = d, [i for i in flow[j] if i not in apart]
                for i in rows:
                    apart[i], via[i] = d, j
            for i, x in apart.items():
                u[i] += limit - x
            for j, x in done.items():
                v[j] -= limit - x
            path, i = [], -1 - last if last < 0 else before[last]
            while i != start:
                path.append((via[i], i))
                i = before[via[i]]
            units = min([free[start], *(flow[j][i] for j, i in path), *([want[last]] if last >= 0 else [])])
            for j, i in path:
                flow[j][i] -= units
                if not flow[j][i]:
                    del flow[j][i]
                flow[j][before[j]] = flow[j].get(before[j], 0) + units
            if last < 0:
                home[-1 - last] += units
            else:
                flow[last][before[last]] = flow[last].get(before[last], 0) + units
                want[last] -= units
            free[start] -= units
    if sum(supply) == sum(demand) and not any(home) and v:
        # all is carried, so prices may move together; a price over 0 would be no bound
        top = max(v)
        u, v = [x + top for x in u], [x - top for x in v]
    return u, v, flow, home


#: What goes into a block's task and comes out of it, by kind: edges (a, b, cost c), rows (a, units n, c is u), columns (b, n, v), flow (a, b, n, cost), how far the cost lies over the bound of the prices (c).
_BLOCK = "kind int, block string, a long, b long, c long, n long"
_EDGE, _ROW, _COLUMN, _CARRIED, _OVER = range(5)


def _block_solved(rows: pa.Table) -> pa.Table:
    kind, a, b, c, n = (rows[k].combine_chunks().fill_null(0).to_numpy() for k in ("kind", "a", "b", "c", "n"))
    of = [np.flatnonzero(kind == k) for k in range(4)]
    of[_ROW], of[_COLUMN] = of[_ROW][np.argsort(a[of[_ROW]])], of[_COLUMN][np.argsort(b[of[_COLUMN]])]
    ids, others = a[of[_ROW]], b[of[_COLUMN]]
    supply, demand, v = (x.tolist() for x in (n[of[_ROW]], n[of[_COLUMN]], c[of[_COLUMN]]))
    e = of[_EDGE][np.lexsort((b[of[_EDGE]], c[of[_EDGE]], a[of[_EDGE]]))]
    edges: list[list[tuple[int, int]]] = [[] for _ in supply]
    for i, j, x in zip(np.searchsorted(ids, a[e]).tolist(), np.searchsorted(others, b[e]).tolist(), c[e].tolist(), strict=True):
        edges[i].append((j, x))
    h = of[_CARRIED]
    held = list(zip(np.searchsorted(ids, a[h]).tolist(), np.searchsorted(others, b[h]).tolist(), n[h].tolist(), c[h].tolist(), strict=True))
    if not sum(supply) == sum(demand) == sum(x[2] for x in held):
        v, held = [0] * len(demand), []  # a column with a price that stays free would spoil the bound
    # one more pair counts for more than all distances
    most = 10**9 * (min(sum(supply), sum(demand)) + 1)
    u, v, flow, home = _carried(edges, supply, demand, most, v, held)
    if held and any(home):
        u, v, flow, home = _carried(edges, supply, demand, most, [0] * len(demand), [])
    costs = [dict(x) for x in edges]
    out = [(_ROW, i, None, x, s) for i, x, s in zip(ids.tolist(), u, supply, strict=True)]
    out += [(_COLUMN, None, j, x, d) for j, x, d in zip(others.tolist(), v, demand, strict=True)]
    out += [(_CARRIED, int(ids[i]), int(others[j]), costs[i][j], k) for j, x in enumerate(flow) for i, k in sorted(x.items())]
    total = most * sum(home) + sum(costs[i][j] * k for j, x in enumerate(flow) for i, k in x.items())
    bound = sum(s * x for s, x in zip(supply, u, strict=True)) + sum(d * x for d, x in zip(demand, v, strict=True))
    valid = max(v, default=0) <= 0 and max(u, default=0) <= most
    out.append((_OVER, None, None, total - bound if valid else 2**62, None))
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(columns[0], pa.int32()), pa.array([rows["block"][0].as_py()] * len(out), pa.string()), *(pa.array(x, pa.int64()) for x in columns[1:])], names=[x.split()[0] for x in _BLOCK.split(", ")])


def _by_prices(left: DataFrame, right: DataFrame, sizes: tuple[DataFrame, DataFrame], near: int, more: int) -> DataFrame:
    """kind, block, a, b, c, n: the optimal flow of blocks too large for all pairs, and its prices."""
    spark, null = left.sparkSession, F.lit(None).cast("long")
    row = lambda t, kind, a=null, b=null, c=null, n=null: t.select(F.lit(kind).alias("kind"), F.col("_block").alias("block"), a.alias("a"), b.alias("b"), c.alias("c"), n.alias("n"))
    cost = F.round(F.col("distance") * 1e9).cast("long")
    of = left.select("_block", "a")
    pairs = tiles.nearest_few(left, right, "a", "b", near).unionByName(tiles.nearest_few(right, left, "b", "a", near))
    edges = [keep(row(pairs.distinct().join(of, "a"), _EDGE, F.col("a"), F.col("b"), cost), "assign-edges")]
    zero = F.lit(0).cast("long")
    state = row(left.join(sizes[0], "a"), _ROW, F.col("a"), null, zero, F.col("na")).unionByName(row(right.join(sizes[1], "b"), _COLUMN, null, F.col("b"), zero, F.col("nb")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        every = state.filter(F.col("kind") != _OVER)
        for e in edges:
            every = every.unionByName(e)
        state = keep(every.repartition(tasks, "block").groupBy("block").applyInArrow(_block_solved, _BLOCK), "assign-state")
        price = lambda side, k, kind: side.join(state.filter(F.col("kind") == kind).select(k, F.col("c").alias("price")), k)  # noqa: B023, E731
        under = keep(tiles.underpriced(price(left, "a", _ROW), price(right, "b", _COLUMN), "a", "b", more), "assign-under")
        if under.isEmpty():
            return state
        edges.append(keep(row(under.join(of, "a"), _EDGE, F.col("a"), F.col("b"), cost), "assign-edges"))


def assignment_of_sides(left: DataFrame, right: DataFrame, of_a: DataFrame, of_b: DataFrame, part: int = PART, near: int = 8, more: int = 4) -> DataFrame:
    """a, b, distance, gap: the optimal one-to-one pairs of two sides of classes and their members, as `tiles.classes` gives them.

    Blocks of at most `part` classes are solved over all their pairs. In larger ones a class has edges to its `near` nearest at first.
    A task finds the best flow over a block's edges and its prices, then tiles look through all pairs for those under their prices,
    which become edges too; when there are none the flow is the best over all pairs, and prices are its certificate. Memory of a
    task grows with a block's classes and edges, and nothing keeps a row for each pair."""
    count = lambda t: t.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    large = keep(count(left).unionByName(count(right)).groupBy("_block").agg(F.sum("n").alias("n")).filter(F.col("n") > part).select("_block"), "assign-large")
    if large.isEmpty():
        return _over_all(left, right, of_a, of_b, part)
    of = lambda t, how: keep(t.join(large, "_block", how), "assign-side")
    members = _members(of_a, left, "a"), _members(of_b, right, "b")
    sizes = tuple(t.groupBy(F.col("of").alias(k)).agg(F.count(F.lit(1)).alias(f"n{k}")) for t, k in zip(members, "ab", strict=True))
    state = _by_prices(of(left, "left_semi"), of(right, "left_semi"), sizes, near, more)
    over = state.filter(F.col("kind") == _OVER).select("block", (F.col("c") / 1e9).alias("gap"))
    flow = state.filter(F.col("kind") == _CARRIED).select("block", "a", "b", "c", "n")
    # where a flow's units begin among the members of both its classes
    begin = lambda k, o: F.coalesce(F.sum("n").over(Window.partitionBy(k).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"at_{k}")
    flows = flow.select("*", begin("a", "b"), begin("b", "a")).join(over, "block").withColumn("d", F.col("c") / 1e9)
    return _over_all(of(left, "left_anti"), of(right, "left_anti"), of_a, of_b, part).unionByName(_expanded(flows, *members).select("a", "b", "distance", "gap"))


def _over_all(left: DataFrame, right: DataFrame, of_a: DataFrame, of_b: DataFrame, part: int) -> DataFrame:
    of = lambda t, s, k: t.join(s.select(F.col(k).alias("_of")), "_of", "left_semi").select(k, "_of")
    met = tiles.distances(left, right, "a", "b").join(left.select("a", F.xxhash64("_block").alias("block")), "a")
    return assignment(met, "a", "b", "distance", "block", part=part, left=of(of_a, left, "a"), right=of(of_b, right, "b")).select("a", "b", "distance", "gap")


def _auctioned(least: DataFrame, tolerance: float, part: int) -> DataFrame:
    sizes = least.groupBy("block").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.max("d").alias("most"))
    sizes = keep(sizes.withColumn("parts", F.ceil((F.col("na") + F.col("nb")) / part)).withColumn("bonus", F.col("most") * F.least("na", "nb") + 1), "auction-blocks")
    valued = least.join(sizes.select("block", "most", "bonus", "parts"), "block").withColumn("value", F.col("bonus") + F.col("most") - F.col("d"))
    person_a, mirror_b, object_b, mirror_a = F.col("a") * 2, F.col("b") * 2 + 1, F.col("b") * 2, F.col("a") * 2 + 1
    edge = lambda t, p, o, v: t.select("block", "parts", p.alias("person"), o.alias("object"), v.alias("value"))
    none = F.lit(0.0)
    edges = edge(valued, person_a, object_b, F.col("value")).unionByName(edge(valued, mirror_b, mirror_a, F.col("value")))
    edges = edges.unionByName(edge(valued, person_a, mirror_a, none).distinct()).unionByName(edge(valued, mirror_b, object_b, none).distinct())
    edges = keep(edges.withColumn("part", F.pmod(F.xxhash64("person"), F.col("parts"))).drop("parts"), "auction-edges")
    n, most = sizes.agg(F.sum(F.col("na") + F.col("nb")), F.max(F.col("bonus") + F.col("most"))).first()
    return _certified(least, edges, keep(_dealt(edges, n, most, tolerance), "auction-state"))


def _certified(least: DataFrame, edges: DataFrame, state: DataFrame) -> DataFrame:
    prices = state.groupBy("block").agg(F.sum("price").alias("prices"))
    best = edges.join(state.select("block", "object", "price"), ["block", "object"], "left").withColumn("net", F.col("value") - F.coalesce("price", F.lit(0.0)))
    bound = best.groupBy("block", "person").agg(F.max("net").alias("net")).groupBy("block").agg(F.sum("net").alias("nets")).join(prices, "block")
    bound = bound.select("block", ((F.col("nets") + F.col("prices")) / 2).alias("bound"))
    taken = state.withColumnRenamed("owner", "person").join(edges.select("block", "person", "object", "value"), ["block", "person", "object"]).filter("(person + object) % 2 = 0")
    way = F.col("person") % 2
    first, second = F.floor(F.col("person") / 2), F.floor(F.col("object") / 2)
    found = taken.select("block", way.alias("way"), F.when(way == 0, first).otherwise(second).alias("a"), F.when(way == 0, second).otherwise(first).alias("b"), "value")
    better = found.groupBy("block", "way").agg(F.sum("value").alias("total")).groupBy("block").agg(F.max_by("way", F.struct("total", -F.col("way"))).alias("way"), F.max("total").alias("total"))
    gaps = better.join(bound, "block").select("block", "way", F.greatest(F.col("bound") - F.col("total"), F.lit(0.0)).alias("gap"))
    return found.join(gaps, ["block", "way"]).join(least, ["block", "a", "b"]).select("a", "b", F.col("d").alias("distance"), "block", "gap")
