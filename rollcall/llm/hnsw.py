"""Approximate nearest neighbours: a navigable small-world graph per shard, results merged.

Distinct vectors are dealt to shards of bounded size. A shard's graph grows by insertion, a block of
vectors at a time: a beam search in the graph so far, and a product of the block with itself, give
the candidates of each new vector. It is linked to near ones in different directions (a candidate is
passed over if a chosen neighbour is nearer to it than the vector itself) and back; a list that is
full is thinned by the same rule. Every vector is in layer 0, each higher layer keeps a random
sixteenth of the one below. Links are flat arrays, and a vector that thinning has cut off is tied to
one of its neighbours again.

A search goes down the layers with a whole block of queries at once: in every step each query
opens the best few vectors of its beam that are not yet open. Graph and search rank in double
precision, so that near copies, whose cosines differ by less than single precision holds, are told
apart. Where more vectors than the beam has room for lie within rounding of the nearest, the search
goes on along the links until it has met all of them. A task holds one shard and one block of
queries; a block is as large as a shard, so the index adds to the traffic about what the queries do.
All that a shard's search finds is scored again on the original vectors, and the nearest are merged.

Every row is a candidate, also where ids repeat. Equal vectors are one entry that keeps its smallest
ids, repeats included, since no answer can hold more of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import table, written
from rollcall.llm.registry import query

#: Vector components in a shard and in a block of queries, on average (131,072 vectors of 64).
SHARD_COMPONENTS = 1 << 23
#: Links per vector in layer 0 and above after thinning, places for more before the next thinning.
LINKS, UPPER_LINKS, SLACK = 32, 16, 16
#: Beam of an insertion, of a search and of the way down, vectors opened in a step, vectors inserted at once.
CANDIDATES, BEAM, DOWN, OPENED, INSERTED = 64, 128, 8, 4, 256
KEEP = 1 / 16
NEAREST, QUERY_STEP = 5, 50

INDEX = "dim int, shard bigint, vectors binary, ids binary, layers array<binary>, links array<binary>"
FOUND = "query_id bigint, query_hash bigint, query_check bigint, repeats bigint, vec_id bigint, score double"


# -- graph -------------------------------------------------------------------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _best(unit: np.ndarray, own: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` places of each row that are nearest to its vector, best first, -1 at the end."""
    scores = np.where(places < 0, -np.inf, np.einsum("bkd,bd->bk", unit[places], own))
    return np.take_along_axis(places, np.argsort(-scores, 1, kind="stable")[:, :most], 1)


def _chosen(unit: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """What each vector of ``own`` links to, of its candidates (places, best first, -1 at the end)."""
    here, rows = near >= 0, unit[near]
    to_self = np.einsum("bkd,bd->bk", rows, own)
    among = rows @ rows.transpose(0, 2, 1)
    taken = np.zeros(near.shape, bool)
    closest = np.full(near.shape, -2.0)
    room = np.full(len(near), most)
    for c in range(near.shape[1]):
        # Nearer to the vector than to any neighbour that is chosen already.
        new = here[:, c] & (to_self[:, c] >= closest[:, c]) & (room > 0)
        taken[:, c] = new
        room -= new
        closest = np.where(new[:, None], np.maximum(closest, among[:, c]), closest)
    rest = here & ~taken
    taken |= rest & (np.cumsum(rest, 1) <= room[:, None])
    order = np.argsort(~taken, 1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(taken, order, 1), np.take_along_axis(near, order, 1), -1)


class Graph:
    """Layers of one shard: the places of their vectors in order, and for each the places it links to.

    The last layer holds the entry alone. ``scored`` counts the products taken by searches, those of insertions included.
    """

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], links: list[np.ndarray]):
        self.unit, self.layers, self.links = unit, layers, links
        self.entry, self.scored = int(layers[-1][0]), 0

    @classmethod
    def build(cls, unit: np.ndarray, seed: int) -> Graph:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(unit))
        height = rng.geometric(1 - KEEP, len(unit)) - 1
        height[order[0]] = height.max() + 1
        layers = [np.flatnonzero(height >= x).astype(np.int32) for x in range(int(height.max()) + 1)]
        widths = [(UPPER_LINKS if x else LINKS) + SLACK for x in range(len(layers))]
        graph = cls(unit, layers, [np.full((len(a), w), -1, np.int32) for a, w in zip(layers, widths, strict=True)])
        at = 1
        while at < len(unit):
            some = order[at : at + min(at, INSERTED, graph._rows(LINKS + SLACK))]
            graph._insert(some, height[some])
            at += len(some)
        graph._tie()
        return graph

    def _rows(self, width: int) -> int:
        """Rows of ``width`` vectors that are handled at once: 32 MB, one row at least."""
        return max(1, (1 << 22) // (width * self.unit.shape[1]))

    def _row(self, level: int, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.layers[level], places) if level else places

    def _insert(self, some: np.ndarray, height: np.ndarray) -> None:
        entry = np.full((len(some), 1), self.entry)
        for level in range(len(self.layers) - 2, -1, -1):
            own = height >= level
            if own.any():
                self._link(level, some[own], self._layer(self.unit[some[own]], entry[own], level, CANDIDATES))
            if level:
                entry = self._layer(self.unit[some], entry, level, DOWN)

    def _link(self, level: int, some: np.ndarray, found: np.ndarray) -> None:
        """Link new vectors to those found and to each other, and back."""
        unit, most = self.unit, UPPER_LINKS if level else LINKS
        mates = unit[some] @ unit[some].T
        np.fill_diagonal(mates, -2)
        mates = some[np.argsort(-mates, 1, kind="stable")[:, : min(most, len(some) - 1)]]
        near = np.concatenate([found, mates], 1)
        step = self._rows(near.shape[1])
        parts = []
        for at in range(0, len(some), step):
            own = unit[some[at : at + step]]
            parts.append(_chosen(unit, own, _best(unit, own, near[at : at + step], CANDIDATES), most // 2))
        chosen = np.concatenate(parts)
        self.links[level][self._row(level, some), : chosen.shape[1]] = chosen
        start, end = np.repeat(some, chosen.shape[1]), chosen.ravel()
        start, end = start[end >= 0], end[end >= 0]
        once = ~(self.links[level][self._row(level, end)] == start[:, None]).any(1)
        self._back(level, end[once], start[once], most)

    def _back(self, level: int, start: np.ndarray, end: np.ndarray, most: int) -> None:
        """Add links; lists without room are thinned, together with what is new."""
        unit, links = self.unit, self.links[level]
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        nodes, first, group, counts = np.unique(start, return_index=True, return_inverse=True, return_counts=True)
        row = self._row(level, nodes)
        held = (links[row] >= 0).sum(1)
        place = np.arange(len(start)) - first[group]
        full = held + counts > links.shape[1]
        fits = ~full[group]
        links[row[group[fits]], held[group[fits]] + place[fits]] = end[fits]
        full = np.flatnonzero(full)
        step = self._rows(links.shape[1] + int(counts.max(initial=0)))
        for at in range(0, len(full), step):
            some = full[at : at + step]
            where = np.full(len(nodes), -1)
            where[some] = np.arange(len(some))
            own = where[group] >= 0
            wide = np.full((len(some), links.shape[1] + int(counts[some].max())), -1)
            wide[:, : links.shape[1]] = links[row[some]]
            wide[where[group[own]], links.shape[1] + place[own]] = end[own]
            vectors = unit[nodes[some]]
            kept = _chosen(unit, vectors, _best(unit, vectors, wide, CANDIDATES), most)
            links[row[some]] = -1
            links[row[some], : kept.shape[1]] = kept

    def _tie(self) -> None:
        """Extra columns of layer 0 that make every vector reachable from the entry."""
        while True:
            links, seen = self.links[0], np.zeros(len(self.unit) + 1, bool)
            seen[[self.entry, -1]] = True
            edge = np.array([self.entry])
            while len(edge):
                edge = np.unique(links[edge])
                edge = edge[~seen[edge]]
                seen[edge] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            # -1 is no link; the place of it in ``seen`` is no lead.
            leads = seen[links[lost]] & (links[lost] >= 0)
            lead = np.where(leads.any(1), links[lost, leads.argmax(1)], -1)
            if (lead < 0).all():
                lost, lead = lost[:1], np.array([np.where(seen[:-1], self.unit @ self.unit[lost[0]], -2).argmax()])
            lost, lead = lost[lead >= 0], lead[lead >= 0]
            order = np.argsort(lead, kind="stable")
            lost, lead = lost[order], lead[order]
            _, first, group, counts = np.unique(lead, return_index=True, return_inverse=True, return_counts=True)
            extra = np.full((len(links), int(counts.max())), -1, np.int32)
            extra[lead, np.arange(len(lead)) - first[group]] = lost
            self.links[0] = np.concatenate([links, extra], 1)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Places of the vectors found for each query (unit length), best first, -1 at the end."""
        step = min(INSERTED, self._rows(OPENED * self.links[0].shape[1]))
        parts = [np.zeros((0, beam), np.int64)]
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            found = np.full((len(some), 1), self.entry)
            for level in range(len(self.layers) - 2, 0, -1):
                found = self._layer(some, found, level, DOWN)
            first = np.full((len(some), 1), self.entry)
            parts.append(self._layer(some, np.concatenate([first, found], 1), 0, max(beam, DOWN + 1))[:, :beam])
        return np.concatenate(parts)

    def within_rounding(self, query: np.ndarray, found: np.ndarray, nearest: int) -> np.ndarray:
        """``found`` and, if its last lies within rounding of the ``nearest``-th, all linked ones that do."""
        found = found[found >= 0]
        scores = self.unit[found] @ query
        if len(found) <= nearest:
            return found
        # A product of unit vectors is off by less than this; both of those compared are.
        least = -np.partition(-scores, nearest - 1)[nearest - 1] - 4 * (len(query) + 4) * np.finfo(float).eps
        if scores.min() < least:
            return found
        seen = np.zeros(len(self.unit) + 1, bool)
        seen[found] = seen[-1] = True
        parts = [found]
        while len(parts[-1]):
            # -1 is no link and the last place of ``seen``.
            new = np.unique(self.links[0][parts[-1]])
            new = new[~seen[new]]
            seen[new] = True
            parts.append(new[self.unit[new] @ query >= least])
        return np.concatenate(parts)

    def _layer(self, queries, entry, level, beam) -> np.ndarray:
        unit, links = self.unit, self.links[level]
        n, m = len(unit), len(queries)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        entry = np.sort(entry, 1)
        entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
        place = np.full((m, beam), -1, np.int64)
        score = np.full((m, beam), -np.inf)
        place[:, : entry.shape[1]] = _best(unit, queries, entry, beam)
        here = place >= 0
        who, which = np.nonzero(here)
        score[here] = np.einsum("ij,ij->i", unit[place[here]], queries[who])
        self.scored += len(who)
        seen[who, place[here]] = True
        closed = ~here
        active = np.arange(m)
        while True:
            active = active[~closed[active].all(1)]
            if not len(active):
                return np.where(score > -np.inf, place, -1)
            # A beam is in order, so its first vectors that are not open are the best of them.
            best = np.argsort(closed[active], 1, kind="stable")[:, :OPENED]
            shut = np.take_along_axis(closed[active], best, 1)
            closed[active[:, None], best] = True
            opened = np.where(shut, self.entry, place[active[:, None], best])
            near = np.where(shut[:, :, None], -1, links[self._row(level, opened)]).reshape(len(active), -1)
            near = np.sort(np.where(near < 0, n, near), 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            new = ~seen[active[:, None], near]
            who, which = np.nonzero(new)
            near = near[who, which]
            seen[active[who], near] = True
            self.scored += len(who)
            # Links of all opened vectors at once, but only those that are new.
            width = int(new.sum(1).max())
            column = (np.cumsum(new, 1) - 1)[who, which]
            places = np.full((len(active), width), -1, np.int64)
            scores = np.full((len(active), width), -np.inf)
            places[who, column] = near
            scores[who, column] = np.einsum("ij,ij->i", unit[near], queries[active[who]])
            scores = np.concatenate([score[active], scores], 1)
            places = np.concatenate([place[active], places], 1)
            shut = np.concatenate([closed[active], np.zeros((len(active), width), bool)], 1) | (places < 0)
            order = np.argsort(-scores, 1, kind="stable")[:, :beam]
            score[active] = np.take_along_axis(scores, order, 1)
            place[active] = np.take_along_axis(places, order, 1)
            closed[active] = np.take_along_axis(shut, order, 1)


# -- shards ------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, with finite components only, not all of them zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part, written once.

    Every row with an id and a usable vector takes part, also rows that repeat an id or a vector.
    """
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Zero has two signs; one of them, so that equal vectors are equal in every bit.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return written(rows.withColumn("dim", F.size("vector")), "vectors")


def _parts(rows: DataFrame, part_rows: int | None) -> int:
    """How many shards or blocks: of ``part_rows`` rows on average, or of a bounded number of components."""
    count, size = rows.agg(F.count("*"), F.sum("dim")).first()
    return max(1, -(-count // part_rows) if part_rows else -(-(size or 0) // SHARD_COMPONENTS))


def index(rows: DataFrame, nearest: int = NEAREST, shard_rows: int | None = None) -> DataFrame:
    """One row per shard: its distinct vectors, their smallest ids, and the graph; written."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= nearest + 1)
    entries = few.groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim")
    )
    entries = written(entries, "entries")
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(_parts(entries, shard_rows))))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        whole = group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        some = group["ids"].combine_chunks()
        valid = some.value_lengths().to_numpy().astype(np.int64)
        ids = np.full((len(whole), nearest + 1), -1, np.int64)
        ids[np.arange(nearest + 1) < valid[:, None]] = some.flatten().to_numpy()
        # In the order of ids and vectors, so that a rerun builds the same graph.
        order = np.lexsort((*whole.T[::-1], ids[:, 0]))
        whole, ids, valid = whole[order], ids[order], valid[order]
        graph = Graph.build(_unit(whole), shard)
        return pa.table({
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([shard], pa.int64()),
            "vectors": [whole.tobytes()],
            "ids": [np.column_stack([valid, ids]).tobytes()],
            "layers": [[x.tobytes() for x in graph.layers]],
            "links": [[x.tobytes() for x in graph.links]],
        })

    return written(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX), "hnsw")


def _found(row: dict, query_ids: np.ndarray, queries: np.ndarray, nearest: int) -> list[tuple]:
    """(number of the query, vec_id, score) of the nearest in one shard, scored in double precision."""
    dim = row["dim"]
    whole = np.frombuffer(row["vectors"]).reshape(-1, dim)
    numbers = np.frombuffer(row["ids"], np.int64).reshape(len(whole), -1)
    layers = [np.frombuffer(x, np.int32) for x in row["layers"]]
    links = [np.frombuffer(x, np.int32).reshape(len(a), -1) for x, a in zip(row["links"], layers, strict=True)]
    graph, units = Graph(_unit(whole), layers, links), _unit(queries)
    out = []
    for n, (query_id, q, unit, some) in enumerate(
        zip(query_ids.tolist(), queries, units, graph.search(units), strict=True)
    ):
        # One more than asked for, since the query itself may be among them.
        some = graph.within_rounding(unit, some, nearest + 1)
        scores = cosines(q, whole[some])
        if len(some) > nearest + 1:
            keep = scores >= np.partition(scores, -nearest - 1)[-nearest - 1]
            some, scores = some[keep], scores[keep]
        pairs = []
        for s, p in zip(scores.tolist(), some.tolist(), strict=True):
            ids = numbers[p, 1 : 1 + numbers[p, 0]].tolist()
            if query_id in ids and (whole[p] == q).all():
                # The query's own row; others of its id are candidates.
                ids.remove(query_id)
            pairs += [(-s, i) for i in ids]
        out += [(n, i, -s) for s, i in sorted(pairs)[:nearest]]
    return out


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; scaling first keeps squares in range."""
    q = q / np.abs(q).max()
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return (rows @ q) / (np.linalg.norm(rows, axis=1) * np.linalg.norm(q))


def search(built: DataFrame, queries: DataFrame, nearest: int = NEAREST, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows but the query's own, ties by vec_id.

    ``queries`` has vec_id, vector and dim. Vectors of another length than the query's are no
    candidates. Rows that repeat an id are queries of their own, each with its own ranks, and
    candidates of each other; rows that repeat id and vector have equal answers, one for each.
    """
    # Two hashes stand for the vector of a query.
    mark = [F.xxhash64("vector").alias("query_hash"), F.xxhash64("vector", F.lit(1)).alias("query_check")]
    blocks = _parts(queries, block_rows)
    asked = queries.groupBy("dim", F.col("vec_id").alias("query_id"), "vector").agg(F.count("*").alias("repeats"))
    asked = asked.select("*", *mark).withColumn("block", F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    pairs = asked.join(built.select("dim", "shard", every.alias("block")), ["dim", "block"])
    # toDF gives the columns new identities; both sides of the cogroup come from the same table.
    held = built.toDF(*built.columns).withColumn("block", every)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(key: tuple, shard: pa.Table, some: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and some.num_rows:
            whole = some["vector"].combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)
            out = _found(shard.to_pylist()[0], some["query_id"].to_numpy(), whole, nearest)
        number, ids, scores = list(zip(*out, strict=True)) or [[], [], []]
        rows = some.select(names[:4]).take(pa.array(number, pa.int64()))
        found = [pa.array(ids, pa.int64()), pa.array(scores, pa.float64())]
        return pa.table([*rows.columns, *found], names)

    keys = ["dim", "shard", "block"]
    found = held.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(run, FOUND)
    order = Window.partitionBy("query_id", "query_hash", "query_check").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    each = ranked.withColumn("_each", F.explode(F.sequence(F.lit(1), "repeats")))
    return each.select("query_id", "rank", "vec_id", "score")


@query("op9_hnsw")
def op9_hnsw(spark, sf_dir):
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return search(index(rows), rows.filter(F.col("vec_id") % QUERY_STEP == 0))
