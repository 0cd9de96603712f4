"""Embedding near-duplicates with a hierarchical navigable small-world graph per shard.

Shards are parts of one label of bounded size. Every shard queries every shard of its label, in tiles of a few shards,
so that a hot label is spread like any other; a block's beams double until audited queries reach the recall asked for.
Where audits keep failing until a beam costs as much as the shard's scan, the block is scanned, which is exact. Found
pairs are verified by cosine in double precision and joined to components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .ngramjoin import lowest
from .skew import Keys, join_split
from .textbytes import mix

#: Vectors of a shard, and shards on each side of a tile.
SHARD, SIDE = 8192, 4
#: A node is known by its smallest key's number and a hash of its label and vector.
NODE = "struct<id:long,h:long>"


def _spread(candidates: np.ndarray, sims: np.ndarray, unit: np.ndarray, m: int) -> np.ndarray:
    """Per row, up to m candidates by falling similarity, none closer to a chosen one than to the row; then the nearest rest."""
    o = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, o, 1), np.take_along_axis(sims, o, 1)
    rows, width = candidates.shape
    v = unit[np.maximum(candidates, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    valid = (candidates >= 0) & np.isfinite(sims)
    chosen, covered, count = np.zeros((rows, width), bool), np.full((rows, width), -np.inf, np.float32), np.zeros(rows, int)
    for c in range(width):
        take = valid[:, c] & (count < m) & (sims[:, c] >= covered[:, c])
        chosen[:, c] = take
        count += take
        covered = np.maximum(covered, np.where(take[:, None], among[:, c], -np.inf))
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(valid, candidates, -1), order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


class Graph:
    """The graph of one shard over unit vectors; ``layers[i]``: the nodes of level i and up, and their neighbour lists."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.layers = unit, layers

    @classmethod
    def build(cls, unit: np.ndarray, m: int = 12, ef: int = 48, step: int = 512) -> Graph:
        n = len(unit)
        u = (mix(np.arange(n, dtype=np.uint64) + np.uint64(99)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(m)), 4).astype(int)
        graph, width = cls(unit, []), 2 * m
        for depth in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= depth)
            links = np.full((n, width), -1, np.int32)
            graph.layers.insert(0, (nodes, links))
            done = 0
            while done < len(nodes):
                b = nodes[done : done + max(64, min(done, step))]
                inner = unit[b] @ unit[b].T
                np.fill_diagonal(inner, -np.inf)
                k = min(32, len(b) - 1)
                near = np.argpartition(-inner, k, axis=1)[:, :k] if k else np.zeros((len(b), 0), int)
                cand, sims = b[near], np.take_along_axis(inner, near, 1)
                if done:
                    found, fs, _ = graph.search(unit[b], ef, layers=graph.layers, known=nodes[:done])
                    cand, sims = np.concatenate((cand, found), 1), np.concatenate((sims, fs), 1)
                links[b] = _spread(cand, sims.astype(np.float32), unit, width)
                graph._back(links, b)
                done += len(b)
        return graph

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Adds the links' other directions; a full list keeps a spread of the old and the new."""
        src, dst = np.repeat(new, links.shape[1]), links[new].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        owners, first, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(owners), 512):
            w, f, c = owners[a : a + 512], first[a : a + 512], np.minimum(count[a : a + 512], 64)
            more = np.full((len(w), int(c.max())), -1, np.int64)
            at = np.arange(more.shape[1])
            inside = at < c[:, None]
            more[inside] = src[(f[:, None] + at)[inside]]
            old = links[w].astype(np.int64)
            more[(more[:, :, None] == old[:, None, :]).any(2) | (more == w[:, None])] = -1
            cand = np.concatenate((old, more), 1)
            sims = np.einsum("ijk,ik->ij", self.unit[np.maximum(cand, 0)], self.unit[w])
            links[w] = _spread(cand, np.where(cand >= 0, sims, -np.inf), self.unit, links.shape[1])

    def search(self, queries: np.ndarray, ef: int, layers=None, known=None, radius: float = 2.0):
        """Beams of ``ef`` nodes of the lowest layer, their similarities, and all (query, node) seen at ``radius`` or above.

        A beam that has ``ef`` nodes within the radius is full: its query stops, for a wider beam to take up.
        """
        layers = layers or self.layers
        entry = layers[-1][0][:1] if known is None or len(layers) > 1 else known[:1]
        beam = np.repeat(entry[None], len(queries), 0)
        hits = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for depth in range(len(layers) - 1, -1, -1):
            beam, sims, hits = self._layer(
                queries, beam, layers[depth][1], ef if depth == 0 else 4, radius if depth == 0 else 2.0,
            )
        return beam, sims, hits

    def _layer(self, queries, entry, links, ef, radius, opened_at_once: int = 4):
        b, n = len(queries), len(self.unit)
        row = np.arange(b)[:, None]
        seen, sims, closed = np.zeros((b, n), bool), np.full((b, n), -np.inf, np.float32), np.zeros((b, n), bool)
        entry = np.asarray(entry)
        ok = entry >= 0
        e = np.maximum(entry, 0)
        s = np.einsum("ijk,ik->ij", self.unit[e], queries)
        seen[np.broadcast_to(row, e.shape)[ok], e[ok]] = True
        sims[np.broadcast_to(row, e.shape)[ok], e[ok]] = s[ok]
        beam, bs = np.where(ok, e, -1), np.where(ok, s, -np.inf).astype(np.float32)
        live = np.arange(b)
        hq, hn = [np.broadcast_to(row, e.shape)[ok & (s >= radius)]], [e[ok & (s >= radius)]]
        within = np.bincount(hq[0], minlength=b)
        while len(live):
            bl, sl = beam[live], bs[live]
            open_ = (bl >= 0) & ~closed[live[:, None], np.maximum(bl, 0)]
            score = np.where(open_, sl, -np.inf)
            k = min(opened_at_once, score.shape[1])
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(open_, pick, 1)
            go = ok.any(1)
            live, pick, ok, bl = live[go], pick[go], ok[go], bl[go]
            if not len(live):
                break
            nodes = np.where(ok, np.take_along_axis(bl, pick, 1), -1)
            r = np.broadcast_to(live[:, None], nodes.shape)
            closed[r[nodes >= 0], nodes[nodes >= 0]] = True
            near = np.where(
                nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1,
            ).reshape(len(live), -1).astype(np.int64)
            r = np.broadcast_to(live[:, None], near.shape)
            new = (near >= 0) & ~seen[r, np.maximum(near, 0)]
            q, v = r[new], near[new]
            code = np.unique(q * n + v)
            q, v = code // n, code % n
            seen[q, v] = True
            s = np.einsum("ij,ij->i", self.unit[v], queries[q]).astype(np.float32)
            sims[q, v] = s
            hit = s >= radius
            hq.append(q[hit])
            hn.append(v[hit])
            within += np.bincount(q[hit], minlength=b)
            # merge the new ones into the beams
            where = np.searchsorted(live, q)
            count = np.bincount(where, minlength=len(live))
            wide = int(count.max(initial=0))
            if wide:
                fresh, fs = np.full((len(live), wide), -1), np.full((len(live), wide), -np.inf, np.float32)
                at = np.arange(len(q)) - np.concatenate(([0], np.cumsum(count)))[:-1][where]
                fresh[where, at], fs[where, at] = v, s
                allb, alls = np.concatenate((beam[live], fresh), 1), np.concatenate((bs[live], fs), 1)
                if allb.shape[1] > ef:
                    top = np.argpartition(-alls, ef - 1, axis=1)[:, :ef]
                    allb, alls = np.take_along_axis(allb, top, 1), np.take_along_axis(alls, top, 1)
                if allb.shape[1] > beam.shape[1]:
                    pad = allb.shape[1] - beam.shape[1]
                    beam, bs = np.pad(beam, ((0, 0), (0, pad)), constant_values=-1), np.pad(
                        bs, ((0, 0), (0, pad)), constant_values=-np.inf,
                    )
                beam[live, : allb.shape[1]], bs[live, : allb.shape[1]] = allb, alls
            live = live[within[live] < ef]
        return beam, bs, (np.concatenate(hq), np.concatenate(hn))


def near_pairs(
    graph: Graph, queries: np.ndarray, radius: float, recall: float = 0.99, ef: int = 32, step: int = 512,
    audit: int = 16, links: int = 32,
):
    """(query, node) with float similarity >= radius, and [audited links, those the beams met, queries scanned].

    The beams of a block double until its audited queries reach the recall; full beams double by themselves. Audited are
    ``audit`` queries of a block, then more, up to an eighth, until they have ``links`` links. Only after a beam failed,
    and the next would be a sixteenth of the shard and cost as much as its scan, is the block scanned.
    """
    n, out_q, out_n, facts = len(graph.unit), [], [], [0, 0, 0]

    def scan(rows):
        for a in range(0, len(rows), step):
            q, v = np.nonzero(queries[rows[a : a + step]] @ graph.unit.T >= radius)
            out_q.append(rows[a : a + step][q])
            out_n.append(v)

    for a in range(0, len(queries), step):
        todo, width = np.arange(a, min(a + step, len(queries))), ef
        count = min(audit, len(todo))
        while True:
            sample = todo[:: max(1, len(todo) // count)]
            truth = queries[sample] @ graph.unit.T >= radius
            if truth.sum() >= links or 8 * count >= len(todo):
                break
            count *= 2
        while len(todo):
            if width > ef and width * 16 > n:
                scan(todo)
                facts[2] += len(todo)
                break
            _, _, (q, v) = graph.search(queries[todo], width, radius=radius)
            met = np.bincount(q, minlength=len(todo))
            checked = np.isin(sample, todo)
            full = met >= width
            # a full beam is searched again in any case, so it isn't audited yet
            checked &= ~np.isin(sample, todo[full])
            want, got = int(truth[checked].sum()), int(np.isin(todo[q], sample[checked]).sum())
            width *= 2
            if got < recall * want:
                continue  # the audit failed: the whole block again with wider beams
            facts[0], facts[1] = facts[0] + want, facts[1] + got
            keep = ~full[q]
            out_q.append(todo[q[keep]])
            out_n.append(v[keep])
            todo = todo[full]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_n), facts


def near_duplicates(
    embeddings: DataFrame, threshold: float = 0.98, shard: int = SHARD, recall: float = 0.99, key: str = "vec_id", vector: str = "embedding", label: str = "label", audits: list | None = None
) -> DataFrame:
    """Rows of one label linked at cosine >= threshold: ``key``, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components, null labels and null keys are linked with nothing;
    nor are vectors of other dimensions. Equal vectors of a label are one node: a row's links are the other keys of its
    node and those of linked nodes, so groups of copies cost one row. Rows equal in all are one vector; a key with
    several vectors is one node for each, and its rows' links are those of their own. An empty table gives an empty
    result. ``component_id`` is the smallest key reachable, ``kept`` whether it is the row's own; for a null key the first is null
    and the second false. Keys and labels may be
    of any type that sorts. ``audits`` receives a table (audited, met, scanned) with a row for each pair of shards.
    """
    scratch = Scratch(embeddings.sparkSession)
    keys = Keys(embeddings, key, scratch)
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = embeddings.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        F.col(f"`{label}`").cast("string").alias("g"),
    )
    usable = x.isNotNull() & F.col("g").isNotNull() & F.col("key").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda e: e != 0)
    rows = keys.numbered(rows).withColumnRenamed("k", "id").withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = rows.where("usable").groupBy("g", "v").agg(
        F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.count("*").alias("rows"),
    )
    nodes = scratch.write(nodes.withColumn("h", F.xxhash64("g", "v")).withColumn("dim", F.size("v")))
    of_label = nodes.groupBy("g", "dim").agg(
        F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.count("*").alias("weight"),
    )
    dealt = join_split(nodes, of_label, ["g", "dim"], "weight", nodes.count()).withColumn(
        "shard", F.pmod(F.xxhash64("id", "h"), F.col("shards")).cast("int"),
    )

    def build(t: pa.Table) -> pa.Table:
        ids, hs, copies = (t.column(c).to_numpy() for c in ("id", "h", "copies"))
        o = np.lexsort((hs, ids))
        dim = t.column("dim")[0].as_py()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)[o]
        top = np.abs(v).max(axis=1, keepdims=True)
        unit = v / np.linalg.norm(v / top, axis=1, keepdims=True) / top
        layers = Graph.build(unit.astype(np.float32)).layers
        return pa.table({
            **{c: t.column(c)[:1] for c in ("g", "dim", "shard", "shards")},
            "ids": [ids[o].tobytes()], "hs": [hs[o].tobytes()], "copies": [copies[o].tobytes()],
            "unit": [unit.tobytes()], "nodes": [[a.astype(np.int64).tobytes() for a, _ in layers]],
            "links": [[b[a].tobytes() for a, b in layers]],
        })

    shards = dealt.select("g", "dim", "shard", "shards", "id", "h", "copies", "v").groupBy("g", "dim", "shard").applyInArrow(
        build, "g string, dim int, shard int, shards int, ids binary, hs binary, copies binary, unit binary, nodes array<binary>, links array<binary>"
    )
    shards = scratch.write(shards)
    # tiles of a few shards on either side; a shard goes to the tiles of its row and of its column
    side, last = F.floor(F.col("shard") / SIDE).cast("int"), F.floor((F.col("shards") - 1) / SIDE).cast("int")
    queries = shards.select(
        "g", "dim", side.alias("i"), F.explode(F.sequence(side, last)).alias("j"),
        *[F.col(c).alias(f"q_{c}") for c in ("shard", "ids", "hs", "copies", "unit")]
    )
    others = shards.withColumn("j", side).withColumn("i", F.explode(F.sequence(F.lit(0), side)))
    meets = queries.join(others, ["g", "dim", "i", "j"]).where("q_shard <= shard")

    def meet(batches):
        for batch in batches:
            for z in range(batch.num_rows):
                (r,) = batch.slice(z, 1).to_pylist()
                yield one(r)

    def one(r):
        unit = np.frombuffer(r["unit"]).reshape(-1, r["dim"])
        q_unit = np.frombuffer(r["q_unit"]).reshape(-1, r["dim"])
        ids, hs, copies, q_ids, q_hs, q_copies = (
            np.frombuffer(r[c], np.int64) for c in ("ids", "hs", "copies", "q_ids", "q_hs", "q_copies")
        )
        layers = []
        for a, b in zip(r["nodes"], r["links"]):
            a = np.frombuffer(a, np.int64)
            full = np.full((len(ids), 24), -1, np.int32)
            full[a] = np.frombuffer(b, np.int32).reshape(len(a), -1)
            layers.append((a, full))
        q, v, facts = near_pairs(
            Graph(unit.astype(np.float32), layers), q_unit.astype(np.float32), threshold - 1e-5, recall,
        )
        own = r["q_shard"] == r["shard"]
        if own:
            q, v = np.minimum(q, v), np.maximum(q, v)
            q, v = q[q != v], v[q != v]
        code = np.unique(q * len(ids) + v)
        q, v = code // max(1, len(ids)), code % max(1, len(ids))
        good = np.zeros(len(q), bool)
        for a in range(0, len(q), 50_000):
            good[a : a + 50_000] = np.einsum(
                "ij,ij->i", q_unit[q[a : a + 50_000]], unit[v[a : a + 50_000]],
            ) >= threshold
        q, v = q[good], v[good]
        q_links = np.bincount(q, copies[v], len(q_ids)).astype(np.int64)
        links = np.bincount(v, q_copies[q], len(ids)).astype(np.int64)
        first = np.arange(0 if own else len(q_ids))
        both = lambda x, y: y if own else np.concatenate((x, y))
        id_of, h_of, counts = both(q_ids, ids), both(q_hs, hs), q_links + links if own else np.concatenate((q_links, links))
        i, j = (q, v) if own else (q, v + len(first))
        # the smallest node of a component of this pair of shards
        o = np.lexsort((h_of, id_of))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o))
        low = o[lowest(len(o), rank[i], rank[j])[rank]]
        m = np.flatnonzero(counts > 0)
        name = lambda z: pa.StructArray.from_arrays(
            [pa.array(id_of[z]), pa.array(h_of[z])], names=["id", "h"],
        )
        some = len(m) > 0  # the audit's facts ride on the first row
        node, low_of = (m, low[m]) if some else (np.zeros(1, np.int64), np.zeros(1, np.int64))
        told = [pa.array([f] + [None] * (len(node) - 1), pa.int64()) for f in facts]
        return pa.RecordBatch.from_arrays(
            [name(node), pa.array(counts[node]), name(low_of), *told],
            names=["node", "links", "low", "audited", "met", "scanned"],
        )

    found = scratch.write(
        meets.mapInArrow(meet, f"node {NODE}, links long, low {NODE}, audited long, met long, scanned long")
    )
    scratch.drop(shards)
    if audits is not None:
        audits.append(found.where("audited is not null").select("audited", "met", "scanned"))
    found = found.where("links > 0")
    parts = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch)
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.withColumn("node", F.struct("id", "h")).join(linked, "node", "left").join(parts, "node", "left")
    facts = facts.select(
        "g", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component.id", "id").alias("component"), F.col("rows").alias("weight"),
    )
    # a group of copies may be a third of all rows
    valid = rows.where("usable")
    out = join_split(valid, scratch.write(facts), ["g", "v"], "weight", valid.count()).select(
        "id", (F.col("copies") - 1 + F.col("links")).alias("_links"), "component",
    )
    out = out.unionByName(
        rows.where("not usable").select("id", F.lit(0).cast("long").alias("_links"), F.col("id").alias("component"))
    )
    out = out.withColumn("_kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    out = keys.named(keys.named(out, "id", "_own"), "component", "_component")
    return out.select(
        F.col("_own").alias(key), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
        F.col("_kept").alias("kept"),
    )
