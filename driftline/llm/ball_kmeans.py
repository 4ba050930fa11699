"""Centroid clustering with balls: k-means whose rounds compare a vector only with the centroids that can be nearer than its own.

A cluster is a ball around its centroid. Its radius is bounded without another pass: the largest distance to the old centroid,
plus the way the centroid has moved. Centroids farther away than twice that radius are no neighbours of the ball. Within it,
members nearer to their centroid than half the way to the nearest neighbour form the stable core, which keeps its cluster
unseen; the others lie in annuli, and a member of one is compared exactly with the neighbours within twice its distance only.

Everything is whole numbers, so that bounds, ties and results are exact. A round is one pass of Spark over the vectors, written
to the shared folder, and one aggregation with map-side combine; the driver holds the k centroids and k rows of sums.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; an empty
table gives an empty result; fewer kept vectors than k give as many clusters. A null id counts as empty text where the first
centroids are drawn, and rows with the same id are ordered by their components there; repeated rows are vectors of their own.
Ties go to the centroid with the smaller number. Only the id and vector columns are read. A component beyond LARGEST is
refused by an error, since squared distances would no longer fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, workdir, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest size of a component: 64 squared differences of twice as much stay below 2**63.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, whole numbers floor(scale * component), of the vectors that are kept."""

    def bad(v: Column) -> Column:
        d = v.cast("double")
        return v.isNull() | F.isnan(d) | (F.abs(d) == F.lit(math.inf))

    def whole(v: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * v.cast("double"))
        return F.when(F.abs(v.cast("double")) * scale > LARGEST, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(y).cast("bigint")

    kept = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dimensions) & ~F.exists("v", bad))
    return kept.select("vec_id", F.transform("v", whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least hash of seed and id, in that order: a top-k, k rows at the driver."""
    name = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    least = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in least], dtype=np.int64)


class Balls:
    """The centroids of one round, and of each ball a bound of its radius (none in the first round)."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray | None):
        self.centroids, self.radius = centroids, radius
        apart = centroids[:, None, :] - centroids[None, :, :]
        self.apart = (apart * apart).sum(axis=2)  # squared distances between centroids

    def neighbours(self, c: int) -> np.ndarray:
        """Centroids that may be as near as c to a member of its ball, in order of their distance from c."""
        near = np.sqrt(self.apart[c].astype(np.float64)) <= 2 * self.radius[c] + 1.0  # the bound is rounded up
        near[c] = False
        found = np.nonzero(near)[0]
        return found[np.argsort(self.apart[c][found], kind="stable")]

    def all_compared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector, from comparing it with every centroid."""
        best, cluster = _squared(x, self.centroids[0]), np.zeros(len(x), dtype=np.int32)
        for c in range(1, len(self.centroids)):
            d = _squared(x, self.centroids[c])
            nearer = d < best
            best[nearer], cluster[nearer] = d[nearer], c
        return cluster, best

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector, given its cluster of the round before."""
        cluster, best = before.copy(), np.zeros(len(x), dtype=np.int64)
        for c in np.unique(before):
            members = np.nonzero(before == c)[0]
            own = _squared(x[members], self.centroids[c])
            best[members] = own
            for j in self.neighbours(c):
                # Nearer than half the way to j: j and all that follow it cannot be as near. What stays here is in an outer annulus.
                outer = np.nonzero(self.apart[c, j] <= 4 * own)[0]
                if not len(outer):
                    break
                who = members[outer]
                d = _squared(x[who], self.centroids[j])
                nearer = (d < best[who]) | (d == best[who]) & (j < cluster[who])
                best[who[nearer]], cluster[who[nearer]] = d[nearer], j
        return cluster, best


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _round(balls: Balls, dimensions: int, first: bool):
    names = ["vec_id", "x", "cluster", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            cluster, best = balls.all_compared(x) if first else balls.assign(x, batch.column("cluster").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())], names=names)

    return run


def next_balls(assigned: DataFrame, balls: Balls) -> Balls:
    """Centroids floor(sum / count) of the clusters, exactly; an empty cluster keeps its own. One row of sums for each cluster."""
    width = balls.centroids.shape[1]
    sums = [F.sum(F.element_at("x", i + 1)).alias(f"s{i}") for i in range(width)]
    centroids, radius = balls.centroids.copy(), np.zeros(len(balls.centroids))
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect():
        c = r["cluster"]
        centroids[c] = [r[f"s{i}"] // r["n"] for i in range(width)]
        moved = centroids[c] - balls.centroids[c]
        radius[c] = math.sqrt(r["far"]) + math.sqrt(int((moved * moved).sum()))
    return Balls(centroids, radius)


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster and squared distance of each of vectors (vec_id, x: whole numbers, all of one length), and the centroids.

    Each round assigns all vectors and moves the centroids; after the last they are assigned once more.
    """
    spark = vectors.sparkSession
    folder = workdir(spark, "balls")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, x array<bigint>, cluster int, distance bigint"
    now = written(vectors, f"{folder}/vectors")
    centroids = first_centroids(now, k, seed)
    if not len(centroids):
        return now.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    balls = Balls(centroids, None)
    for step in range(rounds + 1):
        now = written(now.mapInArrow(_round(balls, centroids.shape[1], step == 0), schema), f"{folder}/round{step}")
        if step < rounds:
            balls = next_balls(now, balls)
    return now, balls.centroids


def clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    found, centroids = ball_kmeans(whole_vectors(rows, key, vector), k, rounds, seed)
    spark = rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    more = spark.createDataFrame([(c, s, total, sha[c]) for c, s in sums.items() if c < len(sha)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(more), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of the rule: every vector against every centroid, in each round."""
    floor_div = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v) ORDER BY h, x LIMIT {k}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min_by(c, {{'d': d, 'c': c}}) AS c, min(d) AS d
  FROM (SELECT v.rid, c{r}.c, CAST(list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r})
  GROUP BY rid
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (
    SELECT c, list({floor_div} ORDER BY i) AS x FROM (
      SELECT a{r}.c, i, sum(v.x[i]) AS s, count(*) AS n FROM v JOIN a{r} USING (rid), range(1, {dimensions + 1}) AS g(i) GROUP BY a{r}.c, i
    ) GROUP BY c
  ) AS m ON m.c = c{r}.c
)""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, CAST({last}.c AS INTEGER) AS cluster, {last}.d AS distance, CAST(sum({last}.d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum({last}.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM v JOIN {last} USING (rid) JOIN c{rounds} AS f ON f.c = {last}.c"""


ORACLE_SQL = oracle()
