"""Communities by modularity after the Leiden scheme, in rounds that give the same labels in one task and by joins.

A level has three parts. Nodes move to the neighbouring community of the largest gain. Each community is then refined
from single nodes: a node that is well connected to its community joins one of the well-connected groups inside it that
it gains from, chosen at random in favour of gain. The refined groups become the nodes of the next level, which starts
from the communities found, until a refinement merges nothing.

Moves are made in rounds. In a fast round a part of the nodes, by hash of id and round, moves at once; if that does not
raise the quality it is taken back, and a round without conflicts follows: of the moves that touch a community only the
largest is made, so every one counts as if it were alone. A phase ends when no move is left (or after ROUNDS).

Components of the graph are independent. Those of at most LOCAL_PAIRS pairs, a bound that fits one task, are worked out
in one task each; larger ones, however large, by joins and grouped sums that end in written tables. Weights are whole
millionths, sums are whole numbers, gains are the same double arithmetic, and chance is xxhash64 of ids and rounds, so
where a component is worked out does not show in its labels.

Defined cases: fewer than two pairs give no communities; weights below half a millionth count as one; a pair of a node
with itself counts as its own weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import components
from lodegraph.session import checkpointed

LOCAL_PAIRS, UNIT, ROUNDS, CHANCE = 200_000, 1_000_000, 200, 1 << 20
FOUND = "id long, label long"

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(*columns: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    seed = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            x = np.asarray(c, np.int64).astype(np.uint64)
            h = _turned((seed + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            seed = h ^ (h >> np.uint64(32))
    return seed.astype(np.int64)


class _Local:
    """One level of a component: nodes 0 to n - 1 in order of their ids, directed edges without loops, own weights."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: int) -> None:
        self.ids, self.n, self.m2, self.pairs = ids, len(ids), m2, (a, b, w)
        self.own = self._sum(a, w) + self._sum(b, w)
        apart = a != b
        self.i, self.j = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]])
        self.w = np.concatenate([w[apart], w[apart]])

    def _sum(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        np.add.at(out, at, w)
        return out

    def quality(self, label: np.ndarray) -> int:
        a, b, w = self.pairs
        inside = self._sum(label[a], np.where(label[a] == label[b], w, 0))
        total = self._sum(label, self.own)
        return sum(2 * self.m2 * x - k * k for x, k in zip(inside.tolist(), total.tolist(), strict=True) if k)

    def _to(self, label: np.ndarray, within: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, neighbouring label and the weight between them."""
        i, j, w = self.i, self.j, self.w
        if within is not None:
            same = within[i] == within[j]
            i, j, w = i[same], j[same], w[same]
        key, at = np.unique(i * self.n + label[j], return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, at, w)
        return key // self.n, key % self.n, out

    def _share(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(float) * b.astype(float) / float(self.m2)

    def _best(self, node: np.ndarray, to: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of each node's largest score, ties by least label."""
        order = np.lexsort((to, -score, node))
        return order[np.flatnonzero(np.diff(node[order], prepend=-1))]

    def moves(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """node, label to move to and what it gains, of every node that gains."""
        node, to, w = self._to(label, None)
        total = self._sum(label, self.own)
        held = np.zeros(self.n, np.int64)
        here = to == label[node]
        held[node[here]] = w[here]
        stay = held.astype(float) - self._share(self.own, total[label] - self.own)
        node, to, w = node[~here], to[~here], w[~here]
        gain = w.astype(float) - self._share(self.own[node], total[to])
        at = self._best(node, to, gain)
        delta = gain[at] - stay[node[at]]
        some = delta > 1e-9
        return node[at][some], to[at][some], delta[some]

    def merges(self, group: np.ndarray, label: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for well-connected single nodes and well-connected groups within a community, chosen with chance."""
        node, to, w = self._to(group, label)
        total, whole = self._sum(group, self.own), self._sum(label, self.own)
        outside = np.zeros(self.n, np.int64)  # of each group, to the rest of its community
        other = group[node] != to
        np.add.at(outside, group[node[other]], w[other])
        of = np.zeros(self.n, np.int64)
        of[group] = label
        well = outside.astype(float) >= self._share(total, whole[of] - total)
        single = np.bincount(group, minlength=self.n)[group] == 1
        ok = other & single[node] & well[group[node]] & well[to]
        node, to, w = node[ok], to[ok], w[ok]
        gain = w.astype(float) - self._share(self.own[node], total[to])
        some = gain > 1e-9
        node, to, gain = node[some], to[some], gain[some]
        chance = (xxhash64(self.ids[node], self.ids[to], turn) % CHANCE).astype(float) / CHANCE
        at = self._best(node, to, gain * (chance + 0.5))
        return node[at], to[at], gain[at]

    def settle(self, start: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Labels after moves, or groups within the given labels after merges."""
        now, best = start.copy(), self.quality(start)
        for turn in range(ROUNDS):
            node, to, gain = self.moves(now) if label is None else self.merges(now, label, turn)
            if not len(node):
                break
            on = xxhash64(self.ids, turn) % 2 == 0
            fast = on[node] if label is None else on[node] & ~(on[to] & (np.bincount(now, minlength=self.n)[to] == 1))
            new = now.copy()
            new[node[fast]] = to[fast]
            value = self.quality(new) if fast.any() else best
            if value <= best:
                order = np.lexsort((self.ids[node], -gain))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first = np.full(self.n, len(order))
                np.minimum.at(first, now[node], rank)
                np.minimum.at(first, to, rank)
                alone = (first[now[node]] == rank) & (first[to] == rank)
                new = now.copy()
                new[node[alone]] = to[alone]
                value = self.quality(new)
            now, best = new, value
        return now


def solve(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: int) -> np.ndarray:
    """Label (least id) of each of ids, which ascend; a, b: places in ids; w: whole weights; m2: twice the whole graph's."""
    at, label = np.arange(len(ids)), np.arange(len(ids))  # each id's node at this level, each node's community
    names = ids
    while True:
        level = _Local(names, a, b, w, m2)
        label = level.settle(label)
        group = level.settle(np.arange(level.n), label)
        group = _least(group)
        kept, new = np.unique(group, return_inverse=True)
        if len(kept) == level.n:
            break
        label = _least(label[kept], np.arange(len(kept)))
        names, at, a, b = names[kept], new[at], new[a], new[b]
    found = label[at]
    least = np.full(found.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, found, ids)
    return least[found]


def _least(label: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Labels renamed to the least place that has them."""
    places = np.arange(len(label)) if places is None else places
    _, at = np.unique(label, return_inverse=True)
    least = np.full(at.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, places)
    return least[at]


def _share(a: Column, b: Column, m2: int) -> Column:
    return a.cast("double") * b.cast("double") / F.lit(float(m2))


class _Joined:
    """The same level as tables: pairs (a, b, w), both (i, j, w) without loops, own (id, own)."""

    def __init__(self, pairs: DataFrame, m2: int) -> None:
        self.pairs, self.m2 = pairs, m2
        self.own = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("own")))
        apart = pairs.where("a <> b")
        self.both = checkpointed(apart.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(apart.select(F.col("b").alias("i"), F.col("a").alias("j"), "w")))

    def quality(self, labels: DataFrame) -> int:
        end = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        inside = self.pairs.join(end("a"), "a").join(end("b"), "b").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("w").alias("x"))
        total = labels.join(self.own, "id").groupBy("label").agg(F.sum("own").alias("k"))
        whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
        return int(total.join(inside, "label", "left").agg(F.sum(whole("x") * F.lit(2 * self.m2).cast("decimal(19,0)") - whole("k") * whole("k"))).first()[0] or 0)

    def _to(self, labels: DataFrame, within: DataFrame | None) -> DataFrame:
        """id, to, w: the weight between a node and a neighbouring label."""
        both = self.both
        if within is not None:
            side = lambda c: within.select(F.col("id").alias(c), F.col("label").alias(f"w{c}"))
            both = both.join(side("i"), "i").join(side("j"), "j").where("wi = wj").select("i", "j", "w")
        return both.join(labels.select(F.col("id").alias("j"), F.col("label").alias("to")), "j").groupBy(F.col("i").alias("id"), "to").agg(F.sum("w").alias("w"))

    def moves(self, labels: DataFrame) -> DataFrame:
        """id, label, to, gain of every node that gains."""
        total = labels.join(self.own, "id").groupBy("label").agg(F.sum("own").alias("total"))
        to = checkpointed(self._to(labels, None))
        here = labels.join(self.own, "id")
        held = to.select("id", F.col("to").alias("label"), F.col("w").alias("held"))
        stay = here.join(total, "label").join(held, ["id", "label"], "left").select("id", "label", "own", (F.coalesce("held", F.lit(0)).cast("double") - _share(F.col("own"), F.col("total") - F.col("own"), self.m2)).alias("stay"))
        near = to.join(stay, "id").where("to <> label").join(total.select(F.col("label").alias("to"), "total"), "to")
        gain = F.col("w").cast("double") - _share(F.col("own"), F.col("total"), self.m2)
        best = near.withColumn("g", gain).groupBy("id", "label", "stay").agg(F.max(F.struct(F.col("g"), (-F.col("to")).alias("minus"))).alias("b"))
        return best.select("id", "label", (-F.col("b.minus")).alias("to"), (F.col("b.g") - F.col("stay")).alias("gain")).where("gain > 1e-9")

    def merges(self, groups: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        own = groups.withColumnRenamed("label", "group").join(self.own, "id").join(labels, "id")
        whole = own.groupBy("label").agg(F.sum("own").alias("whole"))
        sized = own.groupBy("group", "label").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("n"))
        to = checkpointed(self._to(groups, labels).join(groups.withColumnRenamed("label", "group"), "id").where("group <> to"))
        outside = to.groupBy("group").agg(F.sum("w").alias("outside"))
        known = sized.join(whole, "label").join(outside, "group", "left")
        well = known.where(F.coalesce("outside", F.lit(0)).cast("double") >= _share(F.col("total"), F.col("whole") - F.col("total"), self.m2)).select("group", "total", "n")
        well = checkpointed(well)
        near = to.join(well.where("n = 1").select("group", F.col("total").alias("own")), "group").join(well.select(F.col("group").alias("to"), "total"), "to")
        near = near.withColumn("g", F.col("w").cast("double") - _share(F.col("own"), F.col("total"), self.m2)).where("g > 1e-9")
        chance = F.pmod(F.xxhash64("id", "to", F.lit(turn).cast("long")), F.lit(CHANCE)).cast("double") / CHANCE
        best = near.withColumn("s", F.col("g") * (chance + 0.5)).groupBy("id", F.col("group").alias("label")).agg(F.max(F.struct("s", (-F.col("to")).alias("minus"), F.col("g"))).alias("b"))
        return best.select("id", "label", (-F.col("b.minus")).alias("to"), F.col("b.g").alias("gain"))

    def settle(self, start: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        now, best = start, self.quality(start)
        for turn in range(ROUNDS):
            moves = checkpointed(self.moves(now) if labels is None else self.merges(now, labels, turn))
            if moves.isEmpty():
                break
            on = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn).cast("long")), F.lit(2)) == 0  # noqa: B023, E731
            fast = moves.where(on("id"))
            if labels is not None:
                sizes = now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "to")
                fast = fast.join(sizes, "to").where(~(on("to") & (F.col("n") == 1)))
            new = self._moved(now, fast)
            value = self.quality(new)
            if value <= best:
                key = F.struct(F.col("gain"), (-F.col("id")).alias("minus"))
                first = moves.select(F.explode(F.array("label", "to")).alias("at"), key.alias("key")).groupBy("at").agg(F.max("key").alias("key"))
                alone = moves.withColumn("key", key).join(first.select(F.col("at").alias("label"), F.col("key").alias("k1")), "label").join(first.select(F.col("at").alias("to"), F.col("key").alias("k2")), "to").where("key = k1 and key = k2")
                new = self._moved(now, alone)
                value = self.quality(new)
            now, best = new, value
        return now

    def _moved(self, labels: DataFrame, moves: DataFrame) -> DataFrame:
        return checkpointed(labels.join(moves.select("id", "to"), "id", "left").select("id", F.coalesce("to", "label").alias("label")))


def _named(labels: DataFrame) -> DataFrame:
    """Labels renamed to the least id that has them."""
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    return checkpointed(labels.join(least, "label").select("id", F.col("least").alias("label")))


def _distributed(pairs: DataFrame, m2: int) -> DataFrame:
    """id and label over pairs (a, b, w) of any number."""
    at = labels = None
    while True:
        level = _Joined(pairs, m2)
        alone = level.own.select("id", F.col("id").alias("label"))
        at = checkpointed(alone.select("id", F.col("id").alias("node"))) if at is None else at
        labels = level.settle(alone if labels is None else labels)
        groups = _named(level.settle(alone, labels))
        if groups.where("id <> label").isEmpty():
            break
        end = lambda c: groups.select(F.col("id").alias(c), F.col("label").alias(f"g{c}"))  # noqa: B023, E731
        pairs = checkpointed(pairs.join(end("a"), "a").join(end("b"), "b").groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("w").alias("w")))
        labels = _named(labels.join(groups.where("id = label").select("id"), "id"))
        at = checkpointed(at.join(groups.select(F.col("id").alias("node"), "label"), "node").select("id", F.col("label").alias("node")))
    return _named(at.join(labels.withColumnRenamed("id", "node"), "node").select("id", "label"))


def communities(pairs: DataFrame, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """id and label (the community's least id) of each node of pairs (a, b, w), each pair of nodes once."""
    pairs = checkpointed(pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.greatest(F.round(F.col("w") * UNIT).cast("long"), F.lit(1)).alias("w")))
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("m")).first()
    if total.n < 2:
        return pairs.sparkSession.createDataFrame([], FOUND)
    m2 = 2 * total.m
    found = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    pairs = checkpointed(pairs.join(found.withColumnRenamed("id", "a"), "a").select("a", "b", "w", "component"))
    sizes = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = checkpointed(sizes.where(F.col("n") > local_pairs).select("component"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        return pd.DataFrame({"id": ids, "label": solve(ids, a, b, pdf["w"].to_numpy(np.int64), m2)})

    small = pairs.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, FOUND)
    if large.isEmpty():
        return small
    return small.unionByName(_distributed(checkpointed(pairs.join(large, "component", "left_semi").select("a", "b", "w")), m2))
