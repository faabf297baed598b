"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt evenly over shards of a bounded number of rows. In a shard equal vectors are one node, and a node
keeps the ids of all its rows. Nodes are numbered by falling level, so layer l is the nodes 0 to n_l and its links one
flat array with a row per node. A layer is built by insertion: blocks of nodes look for their neighbours in the graph
of the nodes before them, choose links to different sides, and are linked back. A search descends layer by layer
and keeps a beam of the nearest nodes in the lowest. Many searches move side by side, as numpy arrays.

Every query is searched in every shard; the nearest rows of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import reliable

#: Rows of a shard. More make fewer, larger graphs: less work for each query, more memory (some 500 bytes a row) for a task.
SHARD_ROWS = 8192
#: Links of a node in the upper layers (twice as many in the lowest), and the beams while building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 24, 64, 128
#: The beam in the upper layers; all it holds are entries of the layer below, so that clusters far apart are not missed.
DESCENT_BEAM = 16
_BLOCK = 256
_NONE = -1


def _squares(vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to queries, pair by pair."""
    gap = vectors[rows] - queries
    return np.einsum("nd,nd->n", gap, gap)


def _choose(vectors: np.ndarray, own: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates at most ``most`` links: the nearest, but none nearer to a chosen one than to the node itself.

    Free places then go to the nearest of the others. ``near`` is padded with -1 at infinite distance.
    """
    order = np.argsort(distance, axis=1, kind="stable")[:, : max(3 * most, 48)]
    near, distance = np.take_along_axis(near, order, 1), np.take_along_axis(distance, order, 1)
    b, c = near.shape
    points = vectors[near] - vectors[own][:, None, :]
    norm = np.einsum("bcd,bcd->bc", points, points)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
    hidden, count = ~np.isfinite(distance), np.zeros(b, np.int64)
    chosen = np.zeros((b, c), bool)
    for j in range(c):
        take = ~hidden[:, j] & (count < most)
        chosen[:, j] = take
        count += take
        hidden[take] |= between[take, j] < distance[take]
    rank = np.where(chosen, np.arange(c), np.where(np.isfinite(distance), c + np.arange(c), 2 * c))
    pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
    links = np.take_along_axis(near, pick, 1)
    links[np.take_along_axis(rank, pick, 1) == 2 * c] = _NONE
    if links.shape[1] < most:
        links = np.pad(links, ((0, 0), (0, most - links.shape[1])), constant_values=_NONE)
    return links


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query up to ``width`` nodes near it, unordered, and their squared distances; padded with -1 at infinity.

    ``entry`` has a row of nodes to begin with for each query, padded likewise.
    """
    b = len(queries)
    ids = np.full((b, width), _NONE)
    distance = np.full((b, width), np.inf)
    seen = np.zeros((b, len(links)), bool)
    entry = entry[:, :width]
    row, place = np.nonzero(entry >= 0)
    ids[:, : entry.shape[1]] = entry
    distance[row, place] = _squares(vectors, entry[row, place], queries[row])
    seen[row, entry[row, place]] = True
    open_ = distance.copy()  # of the nodes whose links were not followed yet
    going = np.arange(b)
    while True:
        best = np.argmin(open_[going], axis=1)
        more = np.isfinite(open_[going, best])
        going, best = going[more], best[more]
        if not len(going):
            return ids, distance
        at = ids[going, best]
        open_[going, best] = np.inf
        following = links[at]
        new = (following >= 0) & ~seen[going[:, None], following]
        row, place = np.nonzero(new)
        node = following[row, place]
        seen[going[row], node] = True
        found = np.full(following.shape, np.inf)
        found[row, place] = _squares(vectors, node, queries[going[row]])
        found[found >= distance[going].max(axis=1)[:, None]] = np.inf
        useful = np.isfinite(found).any(axis=1)
        rows, found, following = going[useful], found[useful], following[useful]
        if len(rows):
            all_distance = np.concatenate([distance[rows], found], axis=1)
            keep = np.argpartition(all_distance, width - 1, axis=1)[:, :width]
            distance[rows] = np.take_along_axis(all_distance, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], following], axis=1), keep, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], found], axis=1), keep, 1)


@dataclass
class Graph:
    """Vectors of the nodes and, layer by layer from the lowest, the links of the nodes 0 to n_l."""

    vectors: np.ndarray
    layers: list[np.ndarray]

    def entries(self, queries: np.ndarray, above: int) -> np.ndarray:
        """The nodes nearest to each query that a descent from the top to layer ``above`` meets."""
        entry = np.zeros((len(queries), 1), np.int64)
        for links in self.layers[: above - 1 : -1]:
            entry, _ = _beam(self.vectors, links, queries, entry, DESCENT_BEAM)
        return entry

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``width`` nodes near each query and their squared distances, nearest first."""
        found, scores = [], []
        for i in range(0, len(queries), _BLOCK):
            block = queries[i : i + _BLOCK]
            ids, distance = _beam(self.vectors, self.layers[0], block, self.entries(block, 1), width)
            order = np.argsort(distance, axis=1, kind="stable")
            found.append(np.take_along_axis(ids, order, 1)), scores.append(np.take_along_axis(distance, order, 1))
        return np.concatenate(found), np.concatenate(scores)


def build_graph(vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[Graph, np.ndarray]:
    """The graph of distinct vectors, and the order in which its nodes hold them."""
    n = len(vectors)
    draw = np.random.default_rng(seed).random(n)
    levels = np.floor(-np.log1p(-draw) / np.log(links)).astype(np.int64)
    order = np.argsort(-levels, kind="stable")
    vectors, levels = np.ascontiguousarray(vectors[order]), levels[order]
    sizes = [int((levels >= level).sum()) for level in range(levels[0] + 1)]
    graph = Graph(vectors, [np.empty((0, links), np.int64)] * len(sizes))
    for level in range(len(sizes) - 1, -1, -1):
        most = links if level else 2 * links
        graph.layers[level] = layer = np.full((sizes[level], most), _NONE, np.int64)
        done = 1
        known = sizes[level + 1] if level + 1 < len(sizes) else 1  # nodes of the layer above: found by descent, so they come first
        while done < sizes[level]:
            stop = min(sizes[level], done + min(_BLOCK, max(16, done // 2)))
            if done < known:
                stop = min(stop, known)
            new = np.arange(done, stop)
            entry = graph.entries(vectors[new], level + 1) if done >= known else np.zeros((len(new), 1), np.int64)
            near, distance = _beam(vectors, layer, vectors[new], entry, beam)
            # nodes of the same block do not meet in the graph: the nearest of them are candidates too
            block = vectors[new] - vectors[new].mean(axis=0)
            norm = np.einsum("bd,bd->b", block, block)
            inside = np.maximum(norm[:, None] + norm[None, :] - 2 * block @ block.T, 0)
            np.fill_diagonal(inside, np.inf)
            mates = np.argsort(inside, axis=1)[:, : min(len(new), most)]
            near = np.concatenate([near, new[mates]], axis=1)
            distance = np.concatenate([distance, np.take_along_axis(inside, mates, 1)], axis=1)
            chosen = _choose(vectors, new, near, distance, links)
            layer[new, :links] = chosen
            _link_back(vectors, layer, new, chosen)
            done = stop
    return graph, order


def _link_back(vectors: np.ndarray, layer: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen nodes to the new ones; a node with too many links chooses among them."""
    row, place = np.nonzero(chosen >= 0)
    target, source = chosen[row, place], new[row]
    fresh = ~(layer[target] == source[:, None]).any(axis=1)
    target, source = target[fresh], source[fresh]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    most, taken = layer.shape[1], (layer[nodes] >= 0).sum(axis=1)
    nth = np.arange(len(target)) - np.repeat(first, count)
    fits = np.repeat(taken + count <= most, count)
    layer[target[fits], (np.repeat(taken, count) + nth)[fits]] = source[fits]
    over = np.flatnonzero(taken + count > most)
    for part in np.array_split(over, -(-len(over) // _BLOCK)) if len(over) else []:
        wide = np.full((len(part), most + int(count[part].max())), _NONE)
        wide[:, :most] = layer[nodes[part]]
        for i, k in enumerate(part.tolist()):
            wide[i, most : most + count[k]] = source[first[k] : first[k] + count[k]]
        distance = np.full(wide.shape, np.inf)
        r, p = np.nonzero(wide >= 0)
        distance[r, p] = _squares(vectors, wide[r, p], vectors[nodes[part]][r])
        layer[nodes[part]] = _choose(vectors, nodes[part], wide, distance, most)


# --- shards as rows


_SHARD = "shard long, dim long, element string, vectors binary, ids array<long>, first binary, layer_sizes array<long>, layers array<binary>"


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not all zero, and without null or non-finite components."""
    v = F.col(f"`{vector}`")
    limit = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False)))


def _kind(df: DataFrame, vector: str) -> tuple[str, str]:
    """The numpy and the Spark type that hold the components as they are."""
    return ("f4", "array<float>") if df.schema[vector].dataType.elementType == T.FloatType() else ("f8", "array<double>")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def _lengths(vectors: pa.Array) -> np.ndarray:
    return vectors.value_lengths().to_numpy(zero_copy_only=False)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS,
                links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """A row per shard (and vector length in it): its graph as flat arrays, written to the checkpoint folder.

    Rows are dealt round robin, so a vector or id that many rows share weighs no more than others; in a shard
    equal vectors are one node with all their ids. Every row whose vector is usable is indexed: one that is null,
    empty, zero or holds a null or non-finite component is not. A null id stays a null id. No usable row: no shard.
    """
    usable = _usable(vectors, vector)
    element, wide = _kind(usable, vector)
    usable = usable.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(wide).alias("vector"))
    shards = max(1, -(-usable.count() // shard_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, rows = table["id"].combine_chunks(), table["vector"].combine_chunks()
        lengths = _lengths(rows)
        for dim in np.unique(lengths).tolist():
            place = np.flatnonzero(lengths == dim)
            matrix = _matrix(rows.take(pa.array(place)))
            matrix = matrix + np.zeros(1, matrix.dtype)  # -0.0 is 0.0
            distinct, node = np.unique(matrix.view(np.dtype((np.void, matrix.dtype.itemsize * dim))).ravel(), return_inverse=True)
            graph, order = build_graph(distinct.view(matrix.dtype).reshape(-1, dim), links, beam)
            where = np.empty(len(order), np.int64)
            where[order] = np.arange(len(order))
            node = where[node]
            own = ids.take(pa.array(place))
            number, missing = own.fill_null(0).to_numpy(), np.asarray(own.is_null())
            by_node = np.lexsort((number, missing, node))
            first = np.searchsorted(node[by_node], np.arange(len(order) + 1))
            yield pa.RecordBatch.from_pylist([{
                "shard": TaskContext.get().partitionId(), "dim": dim, "element": element, "vectors": graph.vectors.tobytes(),
                "ids": own.take(pa.array(by_node)).to_pylist(), "first": first.astype("i8").tobytes(),
                "layer_sizes": [len(x) for x in graph.layers], "layers": [x.astype("i4").tobytes() for x in graph.layers],
            }], schema)

    schema = _arrow_schema()
    return reliable(usable.repartition(shards).mapInArrow(build, _SHARD))


def _arrow_schema() -> pa.Schema:
    long, blob = pa.int64(), pa.binary()
    return pa.schema([("shard", long), ("dim", long), ("element", pa.string()), ("vectors", blob), ("ids", pa.list_(long)),
                      ("first", blob), ("layer_sizes", pa.list_(long)), ("layers", pa.list_(blob))])


class _Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict):
        vectors = np.frombuffer(row["vectors"], row["element"]).reshape(-1, row["dim"])
        layers = [np.frombuffer(x, "i4").reshape(n, -1).astype(np.int64) for n, x in zip(row["layer_sizes"], row["layers"])]
        self.graph, self.first = Graph(vectors, layers), np.frombuffer(row["first"], "i8")
        ids = pa.array(row["ids"], pa.int64())
        self.ids, self.missing = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())

    def nearest(self, queries: np.ndarray, k: int, width: int) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
        """(query, ids, missing ids, distances) of the k rows nearest to each query, distances in double precision."""
        nodes, _ = self.graph.search(queries.astype(self.graph.vectors.dtype), max(width, k))
        for q, found in enumerate(nodes):
            found = found[found >= 0]
            gap = self.graph.vectors[found].astype(np.float64) - queries[q].astype(np.float64)
            distance = np.sqrt(np.einsum("nd,nd->n", gap, gap))
            # the first k ids of a node are enough: they are its smallest
            count = np.minimum(self.first[found + 1] - self.first[found], k)
            rows = np.repeat(self.first[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            distance = np.repeat(distance, count)
            best = np.lexsort((self.ids[rows], self.missing[rows], distance))[:k]
            yield q, self.ids[rows[best]], self.missing[rows[best]], distance[best]


def search_index(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding",
                 beam: int = SEARCH_BEAM, exclude_own: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the index found nearest to each query, nearest first, ties to smaller ids.

    The score is the Euclidean distance of the vectors as they are, in double precision. With ``exclude_own`` a query
    is a row of the index, and one row with its id and its very vector is left out of its result. Repeated queries have results
    of their own; a null id comes after all others. A query whose vector is not usable gives no row, as does one of
    a length that no vector of the index has; with fewer than k rows in the index the result is shorter.

    Queries are sent to every shard, sorted behind its graph, and read as a stream: a task holds one graph and a
    block of queries. Of the rows found in the shards the first k of each query are kept before and after the last shuffle.
    """
    usable = _usable(queries, vector)
    usable = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("query_id"),
        F.col(f"`{vector}`").cast(_kind(usable, vector)[1]).alias("query"),
    )
    usable = reliable(usable)  # the number of a query stays what it is
    shards = F.broadcast(index.select("shard", "dim").distinct())  # 16 bytes a shard
    sent = usable.withColumn("dim", F.size("query").cast("long")).join(shards, "dim").withColumn("kind", F.lit(1))
    graphs = index.withColumn("kind", F.lit(0))
    wanted = k + 1 if exclude_own else k
    columns = ["shard", "dim", "kind", "row", "query_id", "query"]
    stream = graphs.unionByName(sent, allowMissingColumns=True).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind")
    rest = [c for c in graphs.columns if c not in columns]
    long, real = pa.int64(), pa.float64()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            kinds = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (kinds[1:] == 0)) + 1).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                if kinds[a] == 0:
                    graph = _Shard(part.select(["dim", *rest]).to_pylist()[0])
                    continue
                for c in range(0, len(part), _BLOCK):
                    block = part.slice(c, _BLOCK)
                    found = list(graph.nearest(_matrix(block.column(5)), wanted, beam))
                    which = np.repeat([q for q, *_ in found], [len(x[1]) for x in found])
                    ids, missing, score = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
                    yield pa.RecordBatch.from_arrays([
                        block.column(3).take(pa.array(which)), block.column(4).take(pa.array(which)),
                        pa.array(ids, long, mask=missing), pa.array(score, real),
                    ], names=["row", "query_id", "vec_id", "score"])

    found = stream.select(*columns, *rest).mapInArrow(step, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy("score", F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)
    if exclude_own:
        itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
        place = F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("row"))
        ranked = ranked.withColumn("own", place).filter(~F.col("rank").eqNullSafe(F.col("own")))
        ranked = ranked.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own"), 1).otherwise(0)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
