"""Links within groups of sets, exact, without comparing every two of a group.

Over a reference set B each set A is its difference d = A xor B, and |A xor A'| = |d| + |d'| - 2 |d and d'|: two sets whose differences have nothing
in common are |d| + |d'| apart. With Jaccard similarity num/den or more meaning (num + den) |A xor A'| <= (den - num)(|A| + |A'|), put
g = (num + den)|d| - (den - num)|A|. Then g + g' <= 0 links two sets whatever they share, and all sets that are linked so
to any are linked to that of the least g: one star of links stands for them. Every other link is between sets that share at least
(g + g') / 2(num + den) > 0 elements of their differences, which an inverted index over the differences finds. B is
what more than half of a group have, so copies with changes of their own share few such elements: a family is
linear in its size, whether its members are just above the threshold or just below.

Groups of more than MEMBERS sets or TOKENS elements meet in no task. Their reference comes from a sample (any reference gives the
same links), the star from an aggregate, and the sets that it leaves meet again in groups named by one element that their differences share:
prefixes of the differences, sorted by how often the sample has an element, are enough (Chaudhuri et al., 2006). No such element is in much more than
half of the group, so groups of groups end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_batches, small, written
from .components import components

#: What a task compares as one group: sets, and elements of them all.
MEMBERS, TOKENS = 2048, 1 << 22
#: Elements of the sample that a large group's reference is made of. It decides how fast the group falls apart, not what is linked.
SAMPLED = 1 << 17
#: Groups of groups: each has about half as many sets as the last at most.
LEVELS = 48
#: Longs of sketches that a task holds as one group.
LONGS = 1 << 22
#: Rows of a key that are dealt beside their least id, which an aggregate finds; a sample of one in so many keys' ids shows those keys.
HOT, SAMPLE = 8192, 64


class Sets:
    """Union-find within a task."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x, y) -> bool:
        """True if the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def reference(place: np.ndarray, n_values: int, members: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets have each value, and which values more than half of them have."""
    counts = np.bincount(place, minlength=n_values)
    return counts, counts * 2 > members


def linked(ids: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of ids, enough to join all whose sets (of distinct values) have a Jaccard similarity of num/den or more."""
    k, sizes = len(ids), np.array([len(s) for s in sets], dtype=np.int64)
    if k < 2:
        return []
    owner = np.repeat(np.arange(k), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    _, usual = reference(place, len(values), k)
    own = ~usual[place]
    # The usual values that a set lacks: k times their number is less than twice all elements.
    at = np.cumsum(usual) - 1
    lacks = np.ones((k, int(usual.sum())), dtype=bool)
    lacks[owner[~own], at[place[~own]]] = False
    lacking, which = np.nonzero(lacks)
    member = np.concatenate([owner[own], lacking])
    token = np.concatenate([place[own], np.flatnonzero(usual)[which]])
    g = (num + den) * np.bincount(member, minlength=k) - (den - num) * sizes
    star = int(g.argmin())
    hub = g + g[star] <= 0
    out, joined = [], Sets()
    for j in np.flatnonzero(hub).tolist():
        if j != star and joined.join(star, j):
            out.append((ids[star], ids[j]))
    rest = np.flatnonzero(~hub)
    if not len(rest):
        return out
    order = np.argsort(token, kind="stable")
    token, sorted_member = token[order], member[order]
    heads = np.searchsorted(token, np.arange(len(values) + 1))
    order = np.argsort(member, kind="stable")
    begins = np.searchsorted(member[order], np.arange(k + 1))
    of_member = np.concatenate([place[own], np.flatnonzero(usual)[which]])[order]
    for i in rest.tolist():
        mine = of_member[begins[i] : begins[i + 1]]
        n = heads[mine + 1] - heads[mine]
        if n.sum() <= len(mine):
            continue
        pick = np.repeat(heads[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(sorted_member[pick], minlength=k)
        good = 2 * (num + den) * both >= g + g[i]
        good[i] = False
        for j in np.flatnonzero(good & (both > 0)).tolist():
            if joined.join(i, j):
                out.append((ids[i], ids[j]))
    return out


#: Turns a column into the sets of its rows, each an array of distinct longs.
Reader = Callable[[pa.Array], Iterator[np.ndarray]]


def arrays(lists: pa.Array) -> Iterator[np.ndarray]:
    """The reader of columns that hold the sets themselves."""
    values, ends = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
    return (values[a:z] for a, z in zip(ends, ends[1:], strict=False))


def _of_groups(batches: Iterator[pa.RecordBatch], read: Reader) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(group, ids, sets) from batches of group, id, holder that are sorted by group and id; a repeated id counts once."""
    now, ids, sets = None, [], []
    for batch in batches:
        for group, id_, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), read(batch.column(2)), strict=True):
            if group != now:
                if ids:
                    yield now, ids, sets
                now, ids, sets = group, [], []
            if id_ not in ids[-1:]:
                ids.append(id_)
                sets.append(values)
    if ids:
        yield now, ids, sets


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _compared(members: DataFrame, read: Reader, num: int, den: int) -> DataFrame:
    """Links a, b of groups that fit a task. members: group, id, holder."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, ids, sets in _of_groups(batches, read):
            out += linked(ids, sets, num, den)
            if len(out) > 8192:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    dealt = members.select("group", "id", "holder").repartition("group").sortWithinPartitions("group", "id")
    return in_batches(dealt).mapInArrow(compare, "a bigint, b bigint")


def _references(sample: DataFrame) -> DataFrame:
    """group, usual (values of more than half of the sampled sets), often and counts (of the other values that several of them have)."""

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, sets in _of_groups(batches, arrays):
            values, place = np.unique(np.concatenate(sets), return_inverse=True)
            counts, usual = reference(place, len(values), len(sets))
            # A usual value counts for the sets that lack it.
            counts = np.where(usual, len(sets) - counts, counts)
            often = counts > 1
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (values[usual], values[often], counts[often])]
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), *lists], ["group", "usual", "often", "counts"])

    dealt = sample.select("group", "id", "values").repartition("group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(refer, "group bigint, usual array<bigint>, often array<bigint>, counts array<bigint>")


def _differences(members: DataFrame, references: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """A written table of group, id, g, and the set's difference from its group's reference, what is rare in the sample first."""
    parts = F.ceil(F.col("tokens") / TOKENS).cast("int")
    left = references.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("bigint").alias("id"), F.col("usual").alias("values"), "often", "counts")
    none = F.lit(None).cast("array<bigint>")
    right = members.join(small(sizes), "group").select("group", F.pmod(F.xxhash64("id", "group"), parts).cast("int").alias("part"), "id", "values", none.alias("often"), none.alias("counts"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = often = counts = np.zeros(0, np.int64)
        for batch in batches:
            ids, out = batch.column(2).to_pylist(), []
            for i, id_ in enumerate(ids):
                values = batch.column(3)[i].values.to_numpy()
                if id_ is None:  # a part begins with its group's reference
                    usual, often, counts = values, *(batch.column(c)[i].values.to_numpy() for c in (4, 5))
                    continue
                d = np.setxor1d(values, usual)
                near = np.minimum(np.searchsorted(often, d), max(len(often) - 1, 0))
                seen = np.where(often[near] == d, counts[near], 0) if len(often) else np.zeros(len(d), np.int64)
                out.append((batch.column(0)[i].as_py(), id_, (num + den) * len(d) - (den - num) * len(values), d[np.lexsort((d, seen))]))
            arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["group", "id", "g", "d"])

    dealt = left.unionByName(right).repartition("group", "part").sortWithinPartitions("group", "part", F.col("id").asc_nulls_first())
    return written(dealt.mapInArrow(differ, "group bigint, id bigint, g bigint, d array<bigint>"))


def _sets(holders: DataFrame, read: Reader) -> DataFrame:
    """A written table of id, values of the holders."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(read(batch.column(1))), pa.list_(pa.int64()))], ["id", "values"])

    return written(in_batches(holders.select("id", "holder")).mapInArrow(own, "id bigint, values array<bigint>"))


def links(groups: DataFrame, nodes: DataFrame, holders: DataFrame, num: int, den: int, read: Reader = arrays) -> DataFrame:
    """Pairs a, b of ids, enough to join within each group all whose sets have a Jaccard similarity of num/den or more.

    groups: group, id (longs, distinct); nodes: id, n (the set's size), both written tables. holders: id, and what ``read`` makes the set of,
    which goes to a task for each group of its id; an id may have several rows that hold the same.
    """
    found: list[DataFrame] = []
    for _ in range(LEVELS):
        sizes = groups.join(nodes.select("id", "n"), "id").groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.min("id").alias("first"))
        large = cut(sizes.where((F.col("members") > MEMBERS) | (F.col("tokens") > TOKENS)))
        if large.isEmpty():
            return _together([*found, _compared(holders.join(small(groups), "id"), read, num, den)])
        named = small(large.select(F.col("group").alias("_group")))
        at = F.col("group") == F.col("_group")
        found.append(cut(_compared(holders.join(small(cut(groups.join(named, at, "left_anti"))), "id"), read, num, den)))
        groups = cut(groups.join(named, at, "left_semi"))
        sets = _sets(holders.join(small(cut(groups.select("id").distinct())), "id"), read)
        holders, read = sets.withColumnRenamed("values", "holder"), arrays
        members = sets.join(small(groups), "id")
        some = (F.pmod(F.xxhash64("group", "id"), F.ceil(F.col("tokens") / SAMPLED)) == 0) | (F.col("id") == F.col("first"))
        each = _differences(members, _references(members.join(small(large), "group").where(some)), large, num, den)
        # The star: the least g of a group, and what it links.
        least = cut(each.groupBy("group").agg(F.min(F.struct("g", "id")).alias("star")).select("group", F.col("star.id").alias("star"), F.col("star.g").alias("least")))
        starred = each.join(small(least), "group")
        found.append(cut(starred.where("g + least <= 0 and id <> star").select(F.col("star").alias("a"), F.col("id").alias("b"))))
        rest = cut(starred.where("g + least > 0").groupBy("group").agg(F.min("g").alias("other")))
        starred = starred.join(small(rest), "group")
        # A set of the star has links left only to sets outside it, one outside to all.
        shared = F.greatest(F.lit(1), F.ceil((F.col("g") + F.when(F.expr("g + least <= 0"), F.col("other")).otherwise(F.col("least"))) / (2 * (num + den))))
        prefix = F.slice("d", F.lit(1), F.greatest(F.lit(0), F.size("d") - shared + 1).cast("int"))
        keyed = cut(starred.select("group", "id", F.expr("g + least > 0").alias("outside"), F.explode(prefix).alias("token")).select(F.xxhash64("group", "token").alias("group"), "id", "outside").distinct())
        kept = cut(keyed.groupBy("group").agg(F.count("*").alias("_n"), F.bool_or("outside").alias("_any")).where("_n > 1 and _any").select(F.col("group").alias("_group")))
        groups = without_subsets(cut(keyed.join(kept, F.col("group") == F.col("_group"), "left_semi").select("group", "id")))
    raise RuntimeError(f"groups of sets do not fall apart in {LEVELS} levels")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)  # of signed numbers it would count the absolute value's bits


def parities(h: np.ndarray, at: np.ndarray, least: int = 512) -> list[np.ndarray]:
    """Of each row of hashes that begin at ``at`` a sketch, as longs: the parities of how many fall on each of its bits, of which there are
    ``least`` or, if that is more, the next power of two after their number. Halves laid over each other are the sketch of half as many bits."""
    sizes = np.diff(at)
    bits = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    cell = np.repeat(ends - bits, sizes) + ((h >> np.uint64(20)).astype(np.int64) & (np.repeat(bits, sizes) - 1))
    odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.split(np.packbits(odd, bitorder="little").view(np.int64), ends[:-1] // 64) if len(sizes) else []


class Sketches:
    """Sketches of any lengths that are powers of two, and in how many bits two of them differ."""

    def __init__(self, rows: list[np.ndarray]):
        self.lens = np.array([len(r) for r in rows], dtype=np.int64)
        groups = {int(k): (at := np.flatnonzero(self.lens == k), np.concatenate([rows[i] for i in at]).reshape(len(at), k)) for k in np.unique(self.lens)}
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in groups:
            place, parts, n = np.zeros(len(rows), np.int64), [], 0
            for long, (at, longs) in groups.items():
                if long >= k:
                    parts.append(np.bitwise_xor.reduce(longs.reshape(len(at), long // k, k), axis=1))
                    place[at] = n + np.arange(len(at))
                    n += len(at)
            self.folded[k] = place, np.concatenate(parts)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, least = np.zeros(len(i), dtype=np.int64), np.minimum(self.lens[i], self.lens[j])
        for k in np.unique(least):
            at, (place, rows) = np.flatnonzero(least == k), self.folded[int(k)]
            out[at] = _ones(rows[place[i[at]]] ^ rows[place[j[at]]]).sum(1)
        return out

    def may_be(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
        """False only where two sets cannot be similar: sketches differ in no more bits than sets in elements."""
        apart = np.maximum(self.apart(i, j), np.abs(sizes[i] - sizes[j]))
        return (num + den) * apart <= (den - num) * (sizes[i] + sizes[j])


def met_by(up: np.ndarray, i: int, others: np.ndarray, first: int = 0) -> None:
    """Joins place i with the others, all from ``first`` to i: ``up`` has the least place that each is joined with."""
    met = np.unique(up[others])
    if len(met):
        up[i] = min(met[0], up[i])
        if len(met) > 1:
            here = up[first : i + 1]
            here[np.isin(here, met)] = up[i]


def possible(sizes: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Of each row the least place that rows which may be similar join it with.

    What is reached is compared with what is not reached yet, so most of a family leaves with its first row; only strangers are compared two by two.
    """
    up, left, held = np.arange(len(sizes)), np.arange(len(sizes)), Sketches(sketches)
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        reached = [first]
        while reached and len(left):
            near = held.may_be(np.full(len(left), reached.pop()), left, sizes, num, den)
            up[left[near]] = first
            reached += left[near].tolist()
            left = left[~near]
    return up


def sharpened(groups: DataFrame, nodes: DataFrame, num: int, den: int, parted: int | None = None) -> DataFrame:
    """A written table of groups, parted where sketches (``odd`` of ``nodes``) show that no link can lead across, and then united where they overlap.

    What is left of a group holds together by pairs that look similar, so the united groups are little more than components, and an id is in one
    of them. Groups of more than ``parted`` (MEMBERS, if not given) sets or of more than LONGS longs of sketches stay as they are, beside these.
    """
    rows = groups.join(nodes.select("id", "n", "odd"), "id").select("group", "id", "n", "odd")
    most, room = parted or MEMBERS, LONGS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(group, head, id_):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (group, head, id_)], ["group", "head", "id"])

        def closed(group: int, ids: list[int], sizes: list[int], odd: list[np.ndarray]) -> pa.RecordBatch:
            root = possible(np.array(sizes), odd, num, den)
            several = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1).tolist()
            return put([group] * len(several), [ids[root[i]] for i in several], [ids[i] for i in several])

        def rest(group: int, ids: list[int], sizes: list[int], odd: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
            if whole:
                yield put([group] * len(ids), [None] * len(ids), ids)
            elif len(ids) > 1:
                yield closed(group, ids, sizes, odd)

        now, ids, sizes, odd, longs, whole = None, [], [], [], 0, False
        for batch in batches:
            for group, id_, n, sketch in zip(*(batch.column(i).to_pylist() for i in range(3)), arrays(batch.column(3)), strict=True):
                if group != now:
                    yield from rest(now, ids, sizes, odd, whole)
                    now, ids, sizes, odd, longs, whole = group, [], [], [], 0, False
                ids.append(id_)
                longs += len(sketch)
                whole = whole or len(ids) > most or longs > room
                if not whole:
                    sizes.append(n)
                    odd.append(sketch)
                elif odd or len(ids) >= 8192:  # goes through as it comes
                    yield from rest(now, ids, sizes, odd, whole)
                    ids, sizes, odd = [], [], []
        yield from rest(now, ids, sizes, odd, whole)

    dealt = rows.repartition("group").sortWithinPartitions("group", "id")
    found = cut(in_batches(dealt).mapInArrow(part, "group bigint, head bigint, id bigint"))
    united = components(found.where("head is not null").select(F.col("head").alias("a"), F.col("id").alias("b")))
    whole = without_subsets(cut(found.where("head is null").select("group", "id")))
    return cut(united.select(F.xxhash64("root", F.lit("united")).alias("group"), F.col("node").alias("id")).unionByName(whole))


def without_subsets(groups: DataFrame) -> DataFrame:
    """A written table: groups (a written table of group, id, distinct) without those that lie within another one, which their first id is in too."""
    sizes = cut(groups.groupBy("group").agg(F.count("*").alias("members"), F.min("id").alias("first")))
    others = groups.join(sizes.select("group", F.col("members").alias("_members")), "group").select(F.col("group").alias("_in"), F.col("id").alias("_id"), "_members")
    larger = F.expr("_in <> group and (_members > members or _members = members and _in < group)")
    asked = cut(sizes.join(others, F.col("first") == F.col("_id")).where(larger).select(F.col("group").alias("_group"), "members", "_in"))
    rows = groups.join(asked, F.col("group") == F.col("_group")).select("_group", "members", "_in", "id")
    held = rows.join(groups.select(F.col("group").alias("_g"), F.col("id").alias("_i")), (F.col("_in") == F.col("_g")) & (F.col("id") == F.col("_i")))
    gone = cut(held.groupBy("_group", "_in").agg(F.count("*").alias("n"), F.first("members").alias("members")).where("n = members").select("_group").distinct())
    return cut(groups.join(small(gone), F.col("group") == F.col("_group"), "left_anti"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def homes(keyed: DataFrame, sample: DataFrame) -> DataFrame:
    """A written table of group, id: ids that share a key share a group, which is the least id of the key and is in it.

    keyed: id, key. The rows of a key follow each other in a task, and none are held. Keys that a sample of one id in SAMPLE shows to be
    hot have their least id found by a partial aggregate instead, and their rows stay where they are.
    """
    hot = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > HOT)
    hot = cut(hot.select(F.col("key").alias("_hot")))
    warm = None
    if not hot.isEmpty():
        least = cut(keyed.join(small(hot), F.col("key") == F.col("_hot")).groupBy("key").agg(F.min("id").alias("group")).select(F.col("key").alias("_key"), "group"))
        warm = keyed.join(small(least), F.col("key") == F.col("_key")).where("group <> id").select("group", "id")
        keyed = keyed.join(small(hot), F.col("key") == F.col("_hot"), "left_anti")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now = home_now = None
        for batch in batches:
            key, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.append(key[0] != key_now, key[1:] != key[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            home = np.where(head >= 0, id_[head], home_now if home_now is not None else 0)
            key_now, home_now = key[-1], home[-1]
            kept = home != id_
            pairs = np.unique(np.stack([home[kept], id_[kept]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["group", "id"])

    found = keyed.select("key", "id").repartition("key").sortWithinPartitions("key", "id").mapInArrow(gather, "group bigint, id bigint")
    pairs = cut((found if warm is None else found.unionByName(warm)).distinct())
    return cut(pairs.unionByName(pairs.select("group", F.col("group").alias("id")).distinct()))
