"""N-gram Jaccard join by universe partition and pigeonhole.

Sets are grouped by size band. A band fixes a partition of the hashed universe into segments and an allocation of 1 or
2 to each, with sum H + 1 + spare, where H bounds the symmetric difference of any pair that the band must find. Of
such a pair some segment of allocation 1 is equal, or some of allocation 2 differs by one element at most, which the
segment's own signature and those of its one-deletion neighbourhood find. Up to ``spare`` empty segments of allocation 1
can be left out, as those that are equal are empty in both sets. The allocation is the cheapest by a cost model of entries
and false candidates. More than one segment of a linked pair must agree if fewer are empty than were spared; sets that
share less than that are no candidates. Candidates are verified exactly on whole sets of 64-bit hashes of shingles, which stand
for their texts but for collisions.

Copies of a set are one node (a 96-bit digest). The nodes of a signature form a group with its most central node, the one
whose signatures have the most nodes; groups with one centre are joined, so near copies of a text meet once. A small
group is one tile. Of a large one every node meets the centre first: nodes linked with it are in its component, so only
nodes that aren't have to meet the others. One minus Jaccard is a metric: a node more than two link distances from the centre
is linked with none that the centre is linked with, so it needn't meet these. Nodes that stand apart from the centre, if they
are too many for a tile, form new groups by their prefixes: linked sets share an element among the rarest of each, as many as
a set can lack of the other and one more. These groups are handled in the same way. Tiles have bounded size and compare by products of
incidence matrices, which give all intersections exactly; a tile returns one row for each linked node, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .mixing import WORD
from .scratch import Scratch
from .skew import Identified, join_split
from .textbytes import batch_bytes, mix, shingle_hashes, slices

RATIO = 1.25
#: Most nodes and elements of a block; a tile compares two blocks.
BLOCK_NODES, BLOCK_ELEMENTS = 1000, 1_000_000
#: How often the nodes that stand apart form new groups; after that blocks of them meet each other.
ROUNDS = 4
#: Type of a node's label: the key and text hash of its first row (see ``Identified``).
LABEL = "struct<k:long,u:long>"


class Scheme:
    """Bands, segments and allocations for Jaccard >= num / den over about ``rows`` sets."""

    def __init__(self, num: int, den: int, rows: int, share: float = 1e-5, verify: float = 20.0):
        self.num, self.den, self.rows, self.share, self.verify = num, den, rows, share, verify
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * RATIO)))
        self.parts: dict[int, tuple[int, int, int]] = {}

    def top(self, band: int) -> int:
        """The largest size that a set of this band can be linked with."""
        return (self.low[band + 1] - 1) * self.den // self.num

    def bands(self, n: int) -> list[int]:
        """The bands whose partition a set of n elements uses: its own, and lower ones that it can reach."""
        b = int(np.searchsorted(self.low, n, "right")) - 1
        out = [b]
        while b and self.top(b - 1) >= n:
            b -= 1
            out.append(b)
        return out

    def part(self, band: int) -> tuple[int, int, int]:
        """Numbers of segments of allocation 1 and 2 (these of double width) and of empty ones to spare, by least cost.

        Cost of a set: its entries, and ``verify`` times the false candidates among the band's rows (an eighth of all):
        sets with more empty segments than there are to spare meet in these, and two sets share an element with
        probability ``share``. Element counts of segments are Poisson.
        """
        x, y = self.low[band + 1] - 1, self.top(band)
        need = (x + y) * (self.den - self.num) // (self.den + self.num) + 1
        if need == 1:
            return 1, 0, 0

        def cost(choice: tuple[int, int]) -> float:
            spare, twos = choice
            ones = need + spare - 2 * twos
            z = self.low[band] / (need + spare)
            mean = ones * math.exp(-z)
            over = max(
                0.0, 1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(spare + 1))
            ) if mean > 0 else 0.0
            equal = lambda z: math.exp(-(1 - self.share) * z) - math.exp(-z)
            false = over**2 + ones * equal(z) + twos * (equal(2 * z) * (1 + 2 * z) + math.exp(-4 * z))
            return ones + twos * (1 + 2 * z) + self.verify * self.rows / 8 * false

        spares = sorted(
            {k for k in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64) if k <= need} | {need // 8, need // 4}
        )
        spare, twos = min(
            ((e, t) for e in spares for t in sorted({(need + e) // 2 * k // 8 for k in range(9)})), key=cost,
        )
        return need + spare - 2 * twos, twos, spare

    def signatures(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signatures of a set of distinct 64-bit elements, and for each (band << 16) + how many of that band's the
        set shares with any set that it is linked with there: at least that many, or one."""
        out, needs = [], []
        for band in self.bands(len(x)):
            ones, twos, spare = self.parts.get(band) or self.parts.setdefault(band, self.part(band))
            salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            y = mix(x ^ salt)
            seg = ((y >> np.uint64(32)) * np.uint64(ones + 2 * twos) >> np.uint64(32)).astype(np.int64)
            if twos:
                seg = np.where(seg < ones, seg, ones + (seg - ones) // 2)
            y = mix(y)
            m = ones + twos
            high = np.bincount(seg, (y >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
            total = (high << np.uint64(32)) + np.bincount(
                seg, (y & np.uint64(0xFFFFFFFF)).astype(np.float64), m,
            ).astype(np.uint64)
            count = np.bincount(seg, minlength=m).astype(np.uint64)
            name = lambda s, t, c, salt=salt: mix(
                t + mix(s.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + salt + (c << np.uint64(40)))
            )
            full = name(np.arange(m), total, count)
            empty = np.flatnonzero(count[:ones] == 0)
            least = 1 + spare - len(empty) if len(empty) <= spare else 1
            least = -(-least // 2) if twos else least
            if 0 < len(empty) <= spare:
                full = np.delete(full, empty)
            out.append(full)
            if twos:
                s = seg[seg >= ones]
                out.append(name(s, total[s] - y[seg >= ones], count[s] - np.uint64(1)))
            needs.append(np.full(sum(map(len, out)) - sum(map(len, needs)), band << 16 | min(least, 0xFFFF), np.int32))
        sig, first = np.unique(np.concatenate(out), return_index=True)
        return sig, np.concatenate(needs)[first]


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    out = []
    for x in sets:
        a, b = mix(x ^ np.uint64(0x1234567)), mix(x + np.uint64(0x7654321))
        n = np.array([len(x)], np.uint64)
        out.append(
            np.concatenate(
                (mix(a.sum(dtype=np.uint64, keepdims=True) + n), mix(b.sum(dtype=np.uint64, keepdims=True) ^ n))
            ).tobytes()[:12]
        )
    return out


def links_of(sets: list[np.ndarray], num: int, den: int, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all pairs of sets with Jaccard >= num / den, exactly, from intersections by matrix products."""
    sizes = np.array([len(x) for x in sets], np.int64)
    row, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # other elements are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], number[code[keep]]
    o = np.argsort(code, kind="stable")
    row, code = row[o], code[o]
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    times = np.bincount(code, minlength=1)
    starts = np.concatenate(([0], np.cumsum(times)))[:-1]
    for c in range(2, 9):  # elements of few sets: their pairs
        at = starts[times == c]
        for i in range(c if len(at) else 0):
            for j in range(i + 1, c):
                pairs = np.bincount(row[at + i] * m + row[at + j], minlength=m * m).reshape(m, m)
                both += pairs + pairs.T
    often = times[code] > 8
    row, code = row[often], (np.cumsum(times > 8) - 1)[code[often]]
    for a in range(0, int((times > 8).sum()), columns):
        x, y = np.searchsorted(code, (a, a + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[row[x:y], code[x:y] - a] = 1
        both += m @ m.T
    both = np.rint(both).astype(np.int64)
    return np.nonzero(np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1))


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of n reaches by the links i-j."""
    low = np.arange(n)
    while True:
        m = low.copy()
        np.minimum.at(m, i, low[j])
        np.minimum.at(m, j, low[i])
        m = m[m]
        if (m == low).all():
            return low
        low = m


def _candidates(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """One pass over the texts: rows of documents (kind 2), and nodes (kind 0 and 1) of signatures that others may share.

    A map task forwards a signature once under its own key, where a reducer sees whether other tasks have it, and all
    nodes that share it inside the task under keys of their own: no key gathers more than one row a task.
    """

    def sign(batches):
        seen: set[bytes] = set()
        held, n = [], 0
        for batch in batches:
            rids, ids, us = (batch.column(i).to_numpy() for i in (0, 2, 3))
            data, offsets = batch_bytes(batch.column(1))
            for a, b in slices(offsets):
                sets = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                nodes = _digests(sets)
                key = mix(rids[a:b].astype(np.uint64) ^ np.uint64(77)).astype(np.int64)
                sizes = np.array([len(x) for x in sets], np.int32)
                yield _rows(2, key, rids[a:b], sig=us[a:b], id=ids[a:b], node=nodes, n=sizes)
                for x, node, k in zip(sets, nodes, rids[a:b].tolist()):
                    if len(x) and node not in seen:
                        seen.add(node)
                        held.append((*scheme.signatures(x), k))
                        n += len(held[-1][0])
            if n > 2_000_000:
                yield from first_of_each(held)
                held, n, seen = [], 0, set()
        yield from first_of_each(held)

    def first_of_each(held):
        if not held:
            return
        sig, need = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        k = np.repeat(np.array([x[2] for x in held]), [len(x[0]) for x in held])
        o = np.argsort(sig, kind="stable")
        sig, need, k = sig[o], need[o], k[o]
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        several = ~head
        several[:-1] |= ~head[1:]
        for pick, kind in ((np.flatnonzero(head), 0), (np.flatnonzero(several), 1)):
            for a in range(0, len(pick), 100_000):
                z = pick[a : a + 100_000]
                name = sig[z].astype(np.int64)
                if kind:  # known to share its signature: travels under a key of its own
                    yield _rows(
                        1, mix(sig[z] ^ mix(k[z].astype(np.uint64))).astype(np.int64), k[z], sig=name, need=need[z],
                    )
                else:
                    yield _rows(0, name, k[z], need=need[z])

    def _rows(kind, p, k, sig=None, need=None, id=None, node=None, n=None):
        column = lambda x, t: pa.nulls(len(p), t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(p), kind, np.int8)), pa.array(p), pa.array(k), column(sig, pa.int64()),
                column(need, pa.int32()), column(id, pa.int64()), column(node, pa.binary()), column(n, pa.int32()),
            ],
            names=["kind", "p", "k", "sig", "need", "id", "node", "n"],
        )

    found = docs.mapInArrow(sign, "kind byte, p long, k long, sig long, need int, id long, node binary, n int")
    nodes_here = F.count(F.when(F.col("kind") == 0, 1)).over(Window.partitionBy("p"))
    shared = found.withColumn("here", nodes_here).where((F.col("kind") > 0) | (F.col("here") > 1))
    return shared.select("kind", F.coalesce("sig", "p").alias("sig"), "k", "need", "id", "node", "n")


def _linked(
    groups: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch, done: int = 0, met: list | None = None,
) -> DataFrame:
    """(a, b), labels: for every node linked in a tile of its group, the first node of the tile that it reaches.

    ``done`` counts the rounds before this one; ``met`` receives the number of rows that each step deals to tiles.
    """
    members = scratch.write(groups.join(sets, "node").select("lead", "node", "label", "x"))
    size = members.groupBy("lead").agg(F.count("*").alias("m"), F.sum(F.length("x") / 8).alias("e"))
    blocks = F.greatest(
        F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("e") / BLOCK_ELEMENTS),
    ).cast("int").alias("blocks")
    size = scratch.write(size.where("m > 1").select("lead", "m", blocks))
    total = members.count()
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def tiles(rows: DataFrame, compare) -> DataFrame:
        dealt = rows.repartition(F.col("lead"), F.col("i"), F.col("j")).sortWithinPartitions("lead", "i", "j", "label")
        if met is not None:
            met.append(rows.count())
        return dealt.select("lead", "i", "j", "label", "x", "first").mapInArrow(
            _by_tile(compare), f"a {LABEL}, b {LABEL}, near boolean",
        )

    def all_pairs(labels, held, first):
        return [(labels[a], labels[b]) for a, b in enumerate(lowest(len(labels), *links_of(held, num, den)).tolist()) if a != b]

    def with_first(labels, held, first):
        """Links (node, centre) of the centre, which is in every tile of its group, and (node, centre, True) of nodes
        that aren't linked with it but within two link distances."""
        c = first.index(True)
        linked = set(linked_with(held, c, num, den).tolist())
        near = set(linked_with(held, c, 2 * num - den, den).tolist()) - linked
        return [(labels[x], labels[c]) for x in sorted(linked)] + [(labels[x], labels[c], True) for x in sorted(near)]

    def across(labels, held, first):
        """All links of nodes that aren't linked with the centre."""
        i, j = links_of(held, num, den)
        pick = np.array(first, bool)
        pick = pick[i] | pick[j]
        low = lowest(len(labels), i[pick], j[pick]).tolist()
        return [(labels[a], labels[b]) for a, b in enumerate(low) if a != b]

    dealt = join_split(members, size, ["lead"], "m", total).withColumn("i", block)
    small = dealt.where("blocks = 1").withColumns({"j": F.lit(0), "first": F.lit(False)})
    small = scratch.write(tiles(small, all_pairs)).drop("near")
    many = members.where("lead = node").join(size.where("blocks > 1"), "lead")
    many = scratch.write(many.select("lead", "node", "label", "x", "m", "blocks", F.col("label").alias("centre")))
    if many.isEmpty():
        scratch.drop(members, size, many)
        return small
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = join_split(
        members.where("lead <> node"), many.select("lead", "m", "blocks", "centre"), ["lead"], "m", total,
    ).withColumn("i", block)
    tile = [F.col(c) for c in ("lead", "label", "x")]
    star = large.select(*tile, "i", F.lit(False).alias("first")).unionByName(
        many.select(*tile, each.alias("i"), F.lit(True).alias("first"))
    )
    star = scratch.write(tiles(star.withColumn("j", F.lit(0)), with_first))
    of, one = [F.col("a").alias("label"), F.col("b").alias("centre")], ["label", "centre"]
    linked, near = star.where("not near").select(*of), star.where("near").select(*of)
    apart = scratch.write(
        large.join(linked, one, "left_anti").select("lead", "node", "label", "x", "blocks", "i", "centre").withColumn("first", F.lit(True))
    )
    per = apart.groupBy("lead").agg(F.count("*").alias("few")).join(many.select("lead", "m"), "lead")
    per = scratch.write(per.select("lead", "m", "few", F.ceil(F.col("few") / BLOCK_NODES).cast("int").alias("rest")))
    out = [small, star.where("not near").drop("near")]
    # nodes apart, in blocks, and the nodes linked with the centre, if they may be linked with these
    copies = F.explode(F.sequence(F.lit(0), F.col("rest") - 1))
    deal = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest")).cast("int")
    apart_of = join_split(apart, per.select("lead", "rest", "few"), ["lead"], "few", total).withColumn("mine", deal)
    facing = apart_of.join(near, one, "left_semi").select(*tile, "first", each.alias("i"), F.col("mine").alias("j"))
    if not near.isEmpty():
        others = large.join(linked, one, "left_semi").select("lead", "label", "x", "i").withColumn("first", F.lit(False))
        others = join_split(
            others, per.select("lead", "m", "rest"), ["lead"], "m", total,
        ).select(*tile, "first", "i", copies.alias("j"))
        out.append(scratch.write(tiles(others.unionByName(facing), across)).drop("near"))
    # nodes apart meet each other: in a tile, by their prefixes, or at last in all pairs of blocks
    again = F.col("rest") > 1 if done < ROUNDS else F.lit(False)
    among = apart_of.where(~again).withColumn("other", copies).select(
        *tile, "first", (-1 - F.greatest("mine", "other")).alias("i"), F.least("mine", "other").alias("j"),
    )
    out.append(scratch.write(tiles(among, across)).drop("near"))
    if done < ROUNDS and not per.where("rest > 1").isEmpty():
        groups = scratch.write(_by_prefix(apart_of.where("rest > 1").select("lead", "node", "x"), num, den, scratch))
        out.append(_linked(groups, sets, num, den, scratch, done + 1, met))
    scratch.drop(members, size, many)
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    return links


def _by_prefix(rows: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(lead, node): groups of the nodes of a group of ``rows`` (lead, node, x) that share an element of their prefixes.

    The elements of a group's sets are ordered by how many of its sets have them. Sets with Jaccard >= num / den share
    num / den of the elements of each at least, so the first elements of each, as many as it can lack and one more, have
    one in common. The lead is the least node of a new group.
    """

    def elements(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column(2))
            n = np.diff(offsets) // 8
            row = np.repeat(np.arange(len(n)), n)
            flat = np.frombuffer(data.tobytes(), np.int64)
            for a in range(0, len(flat), 100_000):
                z = slice(a, a + 100_000)
                at = pa.array(row[z])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(n[row[z]]), pa.array(flat[z])],
                    names=["lead", "node", "n", "h"],
                )

    each = scratch.write(rows.mapInArrow(elements, "lead binary, node binary, n long, h long"))
    times = each.groupBy("lead", "h").agg(F.count("*").alias("weight"), F.count("*").alias("c")).where("c > 1")
    met = join_split(each, scratch.write(times), ["lead", "h"], "weight", each.count())
    own = Window.partitionBy("lead", "node")
    alone = F.col("n") - F.count("*").over(own)  # elements of no other set come first
    place = F.row_number().over(own.orderBy("c", "h")) + alone
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    first = scratch.write(met.withColumns({"place": place, "prefix": prefix}).where("place <= prefix").select("lead", "h", "node"))
    leads = first.groupBy("lead", "h").agg(F.min("node").alias("least"), F.count("*").alias("weight")).where("weight > 1")
    out = join_split(first, scratch.write(leads), ["lead", "h"], "weight", first.count())
    return out.select(F.col("least").alias("lead"), "node").distinct()


def linked_with(sets: list[np.ndarray], c: int, num: int, den: int) -> np.ndarray:
    """Numbers of the other sets that set ``c`` is linked with."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.searchsorted(sets[c], flat)
    inside = np.concatenate(([0], np.cumsum(sets[c][np.minimum(at, len(sets[c]) - 1)] == flat)))
    ends = np.cumsum(sizes)
    both = inside[ends] - inside[ends - sizes]
    found = den * both >= num * (sizes + sizes[c] - both)
    found[c] = False
    return np.flatnonzero(found)


def _by_tile(compare):
    """A map over rows sorted by (lead, i, j, label): ``compare`` on the labels, sets and marks of each tile."""

    def run(batches):
        at, labels, held, marks = None, [], [], []
        for batch in batches:
            out = []
            ks, us = (batch.column(3).field(i).to_pylist() for i in (0, 1))
            for lead, i, j, k, u, x, first in zip(*(batch.column(c).to_pylist() for c in range(3)), ks, us, *(batch.column(c).to_pylist() for c in (4, 5))):
                if at != (lead, i, j):
                    out += compare(labels, held, marks) if len(labels) > 1 else []
                    at, labels, held, marks = (lead, i, j), [], [], []
                labels.append((k, u))
                held.append(np.frombuffer(x, np.uint64))
                marks.append(first)
            yield pairs(out)
        yield pairs(compare(labels, held, marks) if len(labels) > 1 else [])

    def pairs(out):
        near = pa.array([len(p) > 2 for p in out], pa.bool_())
        half = lambda q: pa.StructArray.from_arrays(
            [pa.array([p[q][i] for p in out], pa.int64()) for i in (0, 1)], names=["k", "u"],
        )
        return pa.RecordBatch.from_arrays([half(0), half(1), near], names=["a", "b", "near"])

    return run


def _components_of_rows(rows: DataFrame, scratch: Scratch, words: int, num: int, den: int, count: int) -> DataFrame:
    """Of each of ``rows`` (k, u, t): k, u, n shingles, and for n > 0 c, the label of its component."""
    scheme = Scheme(num, den, count)
    texts = rows.select(F.xxhash64("k", "u").alias("r"), "t", "k", "u")
    table = scratch.write(_candidates(texts, words, scheme))
    enough = lambda rows, who: rows.groupBy(who, "need").agg(F.count("*").alias("have")).where(
        F.col("have") >= F.col("need").bitwiseAND(0xFFFF)
    ).select(who, "need")
    own = table.where("kind = 2").select("k", F.col("id"), F.col("sig").alias("u"), "node", "n")
    # a node's label is its first row; exact copies are one node
    labels = own.where("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("id").alias("k"), "u")).alias("label"),
        F.min(F.struct("id", "u", "k")).getField("k").alias("r"), F.count("*").alias("copies"),
    )
    labels = scratch.write(labels)
    sharing = table.where("kind < 2").select("sig", "k", "need")
    sharing = sharing.join(enough(sharing, "k"), ["k", "need"])
    sharing = scratch.write(
        sharing.join(own.select("k", "node").distinct(), "k").select("sig", "node", "need").distinct()
    )
    times = sharing.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").withColumn("weight", F.col("c"))
    counted = scratch.write(join_split(sharing, times, ["sig"], "weight", sharing.count()))
    scratch.drop(sharing)
    counted = counted.join(enough(counted, "node"), ["node", "need"]).select("sig", "node", "c")
    central = counted.groupBy("node").agg(F.sum("c").alias("weight"))
    leads = counted.join(central, "node").groupBy("sig").agg(
        F.max(F.struct("weight", "node")).getField("node").alias("lead"), F.count("*").alias("weight"),
    )
    groups = scratch.write(
        join_split(counted, scratch.write(leads), ["sig"], "weight", counted.count()).select("lead", "node").distinct()
    )
    wanted = labels.join(groups.select("node").distinct(), "node").select("r", "node", "label")

    def build(batches):
        for batch in batches:
            data, offsets = batch_bytes(batch.column(0))
            for a, b in slices(offsets):
                sets = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                nodes = batch.column(1).slice(a, b - a).to_pylist()
                real = np.flatnonzero([d == w for d, w in zip(_digests(sets), nodes)])
                part = batch.slice(a, b - a).take(pa.array(real))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([sets[i].tobytes() for i in real], pa.binary())],
                    names=["node", "label", "x"],
                )

    sets = texts.select("r", "t").join(wanted, "r").select("t", "node", "label").mapInArrow(
        build, f"node binary, label {LABEL}, x binary",
    )
    sets = scratch.write(sets.dropDuplicates(["node"]))
    links = _linked(groups, sets, num, den, scratch)
    scratch.drop(sets)
    parts = components(links, scratch).select(F.col("node").alias("label"), "component")
    facts = labels.join(parts, "label", "left").select("node", F.coalesce("component", "label").alias("c"), "copies")
    # copies of a text may be a third of all rows
    with_words = join_split(
        own.where("n > 0"), scratch.write(facts), ["node"], "copies", own.count(),
    ).select(F.col("id").alias("k"), "u", "n", "c")
    return with_words.unionByName(
        own.where("n = 0").select(F.col("id").alias("k"), "u", "n", F.lit(None).cast(LABEL).alias("c"))
    )


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text",
    rows: int | None = None,
) -> DataFrame:
    """Components of rows linked at Jaccard >= num / den of distinct ``words``-word shingles: ``key``, n_shingles, component_id.

    Words are runs of bytes other than space and 0x09 to 0x0D, A-Z in lower case. A text with fewer words is one shingle
    of all its words; null texts and such without words have no shingle and are linked with nothing. ``component_id`` is
    the smallest key reachable. Rows with equal sets are linked, repeated rows too; rows without words keep their own
    key; null keys come last; keys may be of any type that sorts. ``rows`` (else the table's count) only steers the
    allocation's cost model.
    """
    scratch = Scratch(docs.sparkSession)
    known = Identified(docs, key, text, scratch)
    out = _components_of_rows(
        known.rows.select("k", "u", "t"), scratch, words, num, den, docs.count() if rows is None else rows,
    )
    out = out.select(
        "k", "u", F.col("n").cast("long").alias("_n"), F.coalesce("c.k", "k").alias("_ck"),
        F.coalesce("c.u", "u").alias("_cu"),
    )
    out = known.named(known.named(out, "k", "u", "_own"), "_ck", "_cu", "_component")
    return out.select(
        F.col("_own").alias(key), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
    )


def keep_one_each(
    docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text",
    rows: int | None = None,
) -> DataFrame:
    """One row of ``docs`` of each component, the first by key (null keys last); all rows without words.

    Every row is judged by its own text: rows that share a key, or have none, are separate documents unless their texts
    are linked too. Of rows equal in key and text one stays, the least by a hash of its columns.
    """
    scratch = Scratch(docs.sparkSession)
    all_rows = Identified(docs, key, text, scratch).rows
    worded = F.coalesce(F.col("t").rlike(WORD), F.lit(False))
    parts = _components_of_rows(
        all_rows.select("k", "u", "t"), scratch, words, num, den, docs.count() if rows is None else rows,
    )
    first = parts.where((F.col("n") > 0) & (F.struct("k", "u") == F.col("c"))).select("k", "u").distinct()
    columns = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    one = all_rows.where(worded).groupBy("k", "u").agg(F.min_by("row", F.xxhash64(*columns)).alias("row"))
    return one.join(first, ["k", "u"]).select("row.*").union(all_rows.where(~worded).select("row.*"))
