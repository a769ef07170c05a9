"""Centroid clustering by ball-tree filtering.

Vectors become integers, and each partition builds metric trees of up to TREE_ROWS of its rows. A node stores its
radius, its count and its integer sum. The trees are written to the shared folder once. In each round the trees are
walked with the centroids: a node hands on those centroids that the triangle inequality leaves possible for any of its
points; where one is left, the whole ball is added to it by its sum and count; leaves compare exactly, in integers, the
smaller number first. Tasks add up what they assign, so that a round shuffles one row a centroid and task. The driver
holds the centroids (at most MAX_CENTROIDS) and their sums, no vectors.

Distances to ball centres are floating-point, so a centroid is let go only if it is farther by more than a margin well
above their error; ties and near ties always reach the leaves.

Edge cases: vectors that are null, of another length or with a null or non-finite component are left out; with fewer
vectors than centroids each of them starts one; equal vectors make one leaf of radius 0; rows repeated with their id
are vectors of their own, and count in the start as often (hash ties go by components); a null id is hashed as empty
text; an empty table gives an empty one; only the id and vector columns are read, so extra columns may have any name.
A component beyond LARGEST in size after scaling raises an error that names it, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, map_arrow
from rowloom.session import cut_lineage, discard

#: Rows in one tree, and in a leaf, at most.
TREE_ROWS, LEAF_ROWS = 4096, 32
#: Centroids at most: they and their sums are what every task and the driver hold.
MAX_CENTROIDS = 4096
#: Largest component in size, so that 64 squared differences add up within a long; up to EXACT, floating-point products are exact.
LARGEST, EXACT = 1 << 27, 1 << 20

_NODE = np.dtype([("start", "<i4"), ("stop", "<i4"), ("after", "<i4"), ("radius", "<f8")])


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points (rows) to integer centroids (columns)."""
    if max(abs(points).max(initial=0), abs(centroids).max(initial=0)) <= EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


class BallTree:
    """Points in tree order; nodes in preorder, each with the number of the node after its subtree; a sum a node."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.nodes, self.sums = points, order, nodes, sums

    @classmethod
    def build(cls, points: np.ndarray) -> BallTree:
        order, nodes, sums = np.arange(len(points)), [], []
        stack = [(0, len(points), -1)]
        while stack:
            start, stop, upper = stack.pop()
            if start == stop:
                nodes[upper][2] = len(nodes)  # the subtree of `upper` ends here
                continue
            own = points[order[start:stop]]
            total = own.sum(0)
            away = own - total / len(own)
            reach = (away * away).sum(1)
            radius = float(np.sqrt(reach.max()))
            here = len(nodes)
            nodes.append([start, stop, 0, radius])
            sums.append(total)
            stack.append((0, 0, here))
            if len(own) > LEAF_ROWS and (own != own[0]).any():
                far = own[reach.argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = own @ (other - far)
                by = np.argsort(along, kind="stable")
                order[start:stop] = order[start:stop][by]
                half = start + len(own) // 2
                stack += [(half, stop, here), (start, half, here)]
        return cls(points[order], order, np.array([tuple(n) for n in nodes], _NODE), np.array(sums, np.int64))

    def assign(self, centroids: np.ndarray, margin: float) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
        """(node, start, stop, centroid) for whole balls and (-1, start, stop, centroid of each point) for leaves."""
        floats = centroids.astype(np.float64)
        possible = {-1: np.arange(len(centroids))}
        open_until: list[tuple[int, int]] = []
        i = 0
        while i < len(self.nodes):
            start, stop, after, radius = self.nodes[i].tolist()
            while open_until and open_until[-1][1] <= i:
                possible.pop(open_until.pop()[0])
            left = possible[open_until[-1][0] if open_until else -1]
            if len(left) > 1:
                away = np.sqrt(((floats[left] - self.sums[i] / (stop - start)) ** 2).sum(1))
                left = left[away <= away.min() + 2 * radius + margin]
            if len(left) == 1:
                yield i, start, stop, int(left[0])
                i = after
            elif after == i + 1:
                yield -1, start, stop, left[squared(self.points[start:stop], centroids[left]).argmin(1)]
                i = after
            else:
                possible[i] = left
                open_until.append((i, after))
                i += 1


def _margin(points: np.ndarray, centroids: np.ndarray) -> float:
    """Far above the error of distances among numbers of this size."""
    size = max(abs(points).max(initial=0), abs(centroids).max(initial=0)) + 1
    return 1e-9 * float(size) * points.shape[1]


def _kept(vector: Column, dims: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite)


def _integers(vectors: pa.Array, dims: int, scale: float) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if abs(whole).max(initial=0) > LARGEST:
        raise ValueError(f"a component of {flat[abs(whole).argmax()]} is too large: scaled by {scale} it must be at most {LARGEST} in size")
    return whole.astype(np.int64).reshape(-1, dims)


def ball_trees(df: DataFrame, dims: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Trees over the kept vectors of each partition: ids in tree order, points, nodes and sums."""
    id_type = df.schema[id_col].dataType.simpleString()

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        tree = BallTree.build(_integers(table["vector"].combine_chunks(), dims, scale))
        small = tree.points.astype(np.min_scalar_type(-1 - int(abs(tree.points).max())))
        ids = table["id"].combine_chunks().take(pa.array(tree.order))
        columns = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *(pa.array([x], pa.binary()) for x in (small.tobytes(), tree.nodes.tobytes(), tree.sums.astype("<i8").tobytes())),
            pa.array([small.dtype.itemsize], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "points", "nodes", "sums", "width"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                if rows + part.num_rows > TREE_ROWS:
                    yield one(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield one(held)

    kept = df.where(_kept(col(vector_col), dims)).select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("vector"))
    return map_arrow(kept, build, f"ids array<{id_type}>, points binary, nodes binary, sums binary, width int")


def _trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for i in range(batch.num_rows):
        points, nodes, sums, width = (batch.column(c)[i].as_py() for c in ("points", "nodes", "sums", "width"))
        tree = BallTree(
            np.frombuffer(points, f"<i{width}").astype(np.int64).reshape(-1, dims), np.empty(0), np.frombuffer(nodes, _NODE), np.frombuffer(sums, "<i8").reshape(-1, dims),
        )
        yield batch.column("ids")[i].values, tree


def _round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor of the mean of what each is assigned; those without any stay."""
    k, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, tree in _trees(batch, dims):
                for node, start, stop, to in tree.assign(centroids, _margin(tree.points, centroids)):
                    if node >= 0:
                        count[to] += stop - start
                        total[to] += tree.sums[node]
                    else:
                        count += np.bincount(to, minlength=k)
                        np.add.at(total, to, tree.points[start:stop])
        used = np.flatnonzero(count)
        names = ["cluster", "n", "total"]
        columns = [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = map_arrow(trees, add_up, "cluster int, n bigint, total array<bigint>")
    sums = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # at most k * dims rows
        out[r.cluster, r.pos] = r.total // r.n
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """id, cluster and exact squared distance of every vector."""
    dims = centroids.shape[1]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, dims):
                cluster = np.empty(len(tree.points), np.int32)
                for _, start, stop, to in tree.assign(centroids, _margin(tree.points, centroids)):
                    cluster[start:stop] = to
                distance = ((tree.points - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return map_arrow(trees, tell, f"id {id_type}, cluster int, distance bigint")


def first_by_hash(df: DataFrame, dims: int, k: int, seed: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The integer vectors of the k smallest SHA-256 values of "seed:id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.where(_kept(col(vector_col), dims)).select(digest.alias("h"), col(vector_col).cast("array<double>").alias("v"))
    least = rows.orderBy("h", "v").limit(k).collect()  # k rows, bounded by MAX_CENTROIDS
    return _integers(pa.array([r.v for r in least], pa.list_(pa.float64())), dims, scale) if least else np.zeros((0, dims), np.int64)


def cluster(
    df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    start: Callable[..., np.ndarray] = first_by_hash,
) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance (squared) of every kept vector after the given rounds, as a written table; and the centroids."""
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"between 1 and {MAX_CENTROIDS} centroids can be had, not {k}")
    id_type = df.schema[id_col].dataType.simpleString()
    trees = cut_lineage(ball_trees(df, dims, scale, id_col, vector_col), "ball-trees")
    centroids = start(df, dims, k, seed, scale, id_col, vector_col)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(trees, centroids)
    assigned = cut_lineage(_assigned(trees, centroids, id_type), "ball-assigned")
    discard(trees)
    return assigned, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned, with the inertia of its cluster and of all, and the hash of its centroid's components."""
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    names = assigned.sparkSession.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = sums.join(F.broadcast(names), "cluster")
    whole = told.agg(F.sum("cluster_inertia").alias("inertia"), F.collect_list(F.struct("cluster", "cluster_inertia", "centroid_sha256")).alias("told"))
    told = whole.select("inertia", F.explode("told").alias("told")).select("told.*", "inertia")  # one row a centroid
    return assigned.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """The same in SQL, every vector against every centroid."""
    near = """
  n{r} AS (
    SELECT rn, min((dist, c)) AS best FROM (
      SELECT v.rn, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS dist FROM v JOIN c{r} c ON v.i = c.i GROUP BY ALL) GROUP BY rn)"""
    move = """
  m{r} AS (SELECT n.best[2] AS c, v.i, floor_div(sum(v.x)::BIGINT, count(*)) AS x FROM v JOIN n{p} n USING (rn) GROUP BY ALL),
  c{r} AS (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{p} o LEFT JOIN m{r} m USING (c, i))"""
    steps = ",".join(near.format(r=r) + ("," + move.format(r=r + 1, p=r) if r < rounds else "") for r in range(rounds + 1))
    # Floors of quotients, also of negative sums.
    steps = steps.replace("floor_div(sum(v.x)::BIGINT, count(*))", "((sum(v.x)::BIGINT - ((sum(v.x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")
    return f"""
WITH e AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
      sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
  v AS MATERIALIZED (SELECT rn, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM e),
  f AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, rn FROM e QUALIFY c < {k}),
  c0 AS (SELECT c, i, x FROM f JOIN v USING (rn)),{steps},
  s AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia,
  sum(best[1]) OVER ()::BIGINT AS inertia, sha AS centroid_sha256
FROM n{rounds} JOIN e USING (rn) JOIN s ON s.c = best[2]
"""
