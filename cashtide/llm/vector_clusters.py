"""Centroid clustering over a vector-approximation file.

Vectors of whole numbers are stored twice: whole, sorted and bucketed by a row number, and as an
approximation of ``BITS`` bits a dimension, the number of the cell that holds the component. Cell
edges are quantiles of about ``SAMPLED`` vectors, whose outer cells reach to the least and largest
component of all; they decide how much is skipped and never a result.

Each round reads the approximations alone. Lookup tables give the middle and half-width of each
cell, and with them the interval of the distance to each centroid, and of the difference to that of
the centroid nearest to the middle (both distances share the cell, so this interval is far
narrower). A centroid whose interval lies clear of the nearest one's is out. Where only one is left
and the vector was in its cluster before, nothing more is read. Whole vectors are fetched, by a join
on their buckets that moves only what is asked for, where intervals overlap or the cluster changed:
the exact distances to the centroids that are left decide, and the vector's components move from the
sums of its old cluster to those of its new one. Sums are added up in each task, and only sums and
centroids reach the driver.

A vector counts when it has exactly ``WIDTH`` components, none null, not a number or infinite; one
with a component above 2**21 in size, whose distances do not fit a long, is left out likewise. A
vector without vec_id is clustered but no seed. Of seeds with equal hashes the lesser components go
first. Repeated rows count as often as they come. With fewer vectors than centroids there are fewer
centroids; an empty table gives an empty result; further columns are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import in_arrow, small_batches
from cashtide.llm.line_runs import settings
from cashtide.sources.tables import table

# Components, their factor, centroids, rounds, and what is hashed before a vec_id.
WIDTH = 64
FACTOR = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1:"
#: Components beyond this size have distances that do not fit a long.
LARGEST = 2.0**21
#: Bits of a cell's number, and about how many vectors its edges are taken from.
BITS = 6
SAMPLED = 4096
#: Vectors in one bucket.
BUCKET_ROWS = 250_000

STATE = "r bigint, codes binary, cluster int"
JUDGED = "r bigint, codes binary, old int, cluster int, left bigint"
MOVED = "r bigint, codes binary, cluster int, n bigint, sums array<bigint>"
NEAREST = "vec_id bigint, cluster int, distance bigint"
NOWHERE = -1


def whole_vectors(embeddings, width=WIDTH, factor=FACTOR):
    """Rows (r, vec_id, v): the vectors that count, in whole numbers."""

    def fits(x):
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)

    found = embeddings.filter((F.size("embedding") == width) & F.forall("embedding", fits))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("int"))
    return found.select(
        F.monotonically_increasing_id().alias("r"), F.col("vec_id").cast("bigint"), v.alias("v")
    )


def matrix(column, width):
    """An Arrow column of equally long lists as rows of numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), width)


class Grid:
    """The cells of every dimension."""

    def __init__(self, sample, low, high, bits=BITS):
        cells = 1 << bits
        self.edges, middles, halves = [], [], []
        for d in range(len(low)):
            values = np.sort(sample[:, d]) if len(sample) else np.array([low[d]])
            at = (np.arange(1, cells) * len(values)) // cells
            edges = np.unique(np.clip(values[at], low[d], high[d]))
            starts, ends = np.append(low[d], edges + 1), np.append(edges, high[d])
            ends = np.maximum(starts, ends)  # an empty last cell
            lacking = cells - len(starts)
            middles.append(np.pad((starts + ends) / 2, (0, lacking)))
            halves.append(np.pad((ends - starts) / 2, (0, lacking)))
            self.edges.append(edges)
        self.middles, self.halves = np.array(middles), np.array(halves)
        self.reach = float(max(np.abs(low).max(), np.abs(high).max()))

    def codes(self, v):
        """The cell of each component: its number of edges below."""
        held = np.empty(v.shape, np.uint8)
        for d, edges in enumerate(self.edges):
            held[:, d] = np.searchsorted(edges, v[:, d], "left")
        return held

    def lookup(self, codes):
        dims = np.arange(codes.shape[1])
        return self.middles[dims, codes], self.halves[dims, codes]


def left_over(codes, grid, centroids):
    """Bits of the centroids that may be nearest to a vector anywhere in its cells."""
    centres = centroids.astype(float)
    middle, half = grid.lookup(codes)
    near = (centres**2).sum(1) - 2 * middle @ centres.T
    first = near.argmin(1)
    # What rounding can hide where components are very large.
    reach = grid.reach + np.abs(centres).max()
    hidden = 4 * codes.shape[1] * reach * reach * 2.0**-40
    bits = np.zeros(len(codes), np.int64)
    for c in np.unique(first):
        rows = first == c
        slack = half[rows] @ (2 * np.abs(centres - centres[c])).T
        overlaps = near[rows] - near[rows][:, [c]] <= slack + hidden
        bits[rows] = overlaps @ (np.int64(1) << np.arange(len(centres)))
    return bits


def exact(v, bits, centroids):
    """The nearest of the centroids left, the smaller number of equals, and its distance."""
    distance = np.full((len(v), len(centroids)), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        rows = (bits >> c & 1).astype(bool)
        distance[rows, c] = ((v[rows] - centre) ** 2).sum(1)
    nearest = distance.argmin(1)
    return nearest, distance[np.arange(len(v)), nearest]


def _approximating(grid, width):
    def task(batches):
        for batch in batches:
            codes = grid.value.codes(matrix(batch.column(1), width))
            yield {
                "r": batch.column(0),
                "codes": [row.tobytes() for row in codes],
                "cluster": [NOWHERE] * len(codes),
            }

    return task


def _reach(width):
    def task(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), width)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield {"low": [low.tolist()], "high": [high.tolist()]}

    return task


def _judging(grid, centroids, width):
    def task(batches):
        for batch in batches:
            codes = b"".join(batch.column(1).to_pylist())
            codes = np.frombuffer(codes, np.uint8).reshape(-1, width)
            bits = left_over(codes, grid.value, centroids) if len(codes) else np.zeros(0, np.int64)
            alone = bits & (bits - 1) == 0
            only = np.where(alone, np.log2(np.maximum(bits, 1)).astype(int), NOWHERE)
            yield {
                "r": batch.column(0), "codes": batch.column(1), "old": batch.column(2),
                "cluster": only.tolist(), "left": bits.tolist(),
            }

    return task


def _moving(centroids, width):
    """Clusters of the vectors fetched, and what the sums of the clusters gain and lose."""

    def task(batches):
        sums = np.zeros((len(centroids), width), np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = matrix(batch.column(4), width)
            new, _ = exact(v, np.array(batch.column(3).to_pylist(), np.int64), centroids)
            old = np.array(batch.column(2).to_pylist(), np.int64)
            moved = new != old
            was = moved & (old != NOWHERE)
            np.add.at(sums, new[moved], v[moved])
            np.subtract.at(sums, old[was], v[was])
            np.add.at(counts, new[moved], 1)
            np.subtract.at(counts, old[was], 1)
            nothing = [None] * len(v)
            yield {
                "r": batch.column(0), "codes": batch.column(1), "cluster": new.tolist(),
                "n": nothing, "sums": nothing,
            }
        used = np.flatnonzero(counts | sums.any(1))
        nothing = [None] * len(used)
        yield {
            "r": nothing, "codes": nothing, "cluster": used.tolist(),
            "n": counts[used].tolist(), "sums": sums[used].tolist(),
        }

    return task


def _measuring(centroids, width):
    def task(batches):
        for batch in batches:
            bits = np.array(batch.column(1).to_pylist(), np.int64)
            nearest, distance = exact(matrix(batch.column(2), width), bits, centroids)
            yield {
                "vec_id": batch.column(0), "cluster": nearest.tolist(), "distance": distance.tolist(),
            }

    return task


class VectorFile:
    """Whole vectors in buckets, and their approximations."""

    def __init__(self, embeddings, width=WIDTH, factor=FACTOR, bits=BITS):
        self.spark, self.width = embeddings.sparkSession, width
        small_batches(self.spark)
        vectors = session.cut(whole_vectors(embeddings, width, factor), "whole-vectors")
        self.rows = vectors.count()
        self.buckets = max(4, -(-self.rows // BUCKET_ROWS))
        self.name = session.fresh_dir(self.spark, "vectors").rsplit("/", 1)[1].replace("-", "_")
        path = session.fresh_dir(self.spark, "vector-buckets")
        with self.aligned():
            dealt = vectors.repartition(self.buckets, "r")
            writer = dealt.write.bucketBy(self.buckets, "r").sortBy("r").format("parquet")
            writer.option("path", path).saveAsTable(self.name)
        self.path, self.whole = path, self.spark.table(self.name)
        if self.rows:
            share = SAMPLED / self.rows
            spread = F.xxhash64("r") / 2.0**64 + 0.5
            sample = vectors.filter(spread < share).select("v").collect()  # about SAMPLED rows
            sample = np.array([row["v"] for row in sample], np.int64).reshape(-1, width)
            grid = Grid(sample, *self._reach(vectors), bits)
            self.grid = self.spark.sparkContext.broadcast(grid)  # width x cells numbers
            codes = in_arrow(vectors.select("r", "v"), _approximating(self.grid, width), STATE)
            self.state = session.cut(codes, "approximations")

    def aligned(self):
        return settings(
            self.spark,
            spark__sql__shuffle__partitions=str(self.buckets),
            spark__sql__sources__bucketing__autoBucketedScan__enabled="false",
        )

    def _reach(self, vectors):
        partial = in_arrow(vectors.select("v"), _reach(self.width), "low array<int>, high array<int>")
        each = partial.select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
        rows = each.groupBy("d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        found = sorted(map(tuple, rows.collect()))
        return np.array([f[1] for f in found]), np.array([f[2] for f in found])

    def seeds(self, k=CENTROIDS):
        """The ``k`` vectors whose ids have the smallest hashes."""
        hashed = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
        first = self.whole.select(hashed.alias("hash"), "v").filter("hash IS NOT NULL")
        rows = first.orderBy("hash", "v").limit(k).collect()
        return np.array([row["v"] for row in rows], np.int64).reshape(-1, self.width)

    def judge(self, centroids):
        task = _judging(self.grid, centroids, self.width)
        return session.cut(in_arrow(self.state, task, JUDGED), "judged-vectors")

    def move(self, centroids, counts, sums):
        """One round: every vector to its nearest centroid; ``counts`` and ``sums`` follow."""
        judged = self.judge(centroids)
        stays = (F.col("cluster") == F.col("old")) & (F.col("cluster") != NOWHERE)
        asked = judged.filter(~stays).select("r", "codes", "old", "left")
        with self.aligned():
            fetched = asked.join(self.whole.select("r", "v").hint("merge"), "r")
            moved = session.cut(in_arrow(fetched, _moving(centroids, self.width), MOVED), "moves")
        kept = judged.filter(stays).select("r", "codes", "cluster")
        self.state = kept.unionByName(moved.filter("r IS NOT NULL").select("r", "codes", "cluster"))
        gains = moved.filter("r IS NULL")
        for row in gains.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
            counts[row["cluster"]] += row["n"]
        each = gains.select("cluster", F.posexplode("sums").alias("d", "x"))
        for row in each.groupBy("cluster", "d").agg(F.sum("x").alias("x")).collect():
            sums[row["cluster"], row["d"]] += row["x"]

    def nearest(self, centroids):
        """Per vector its cluster and exact distance."""
        judged = self.judge(centroids).select("r", "left")
        with self.aligned():
            fetched = judged.join(self.whole.hint("merge"), "r").select("vec_id", "left", "v")
            return session.cut(in_arrow(fetched, _measuring(centroids, self.width), NEAREST), "nearest")

    def close(self):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def cluster(embeddings, k=CENTROIDS, rounds=ROUNDS, width=WIDTH, factor=FACTOR, bits=BITS):
    """Rows (vec_id, cluster, distance) and the final centroids."""
    held = VectorFile(embeddings, width, factor, bits)
    try:
        centroids = held.seeds(k) if held.rows else np.empty((0, width), np.int64)
        if not len(centroids):
            return embeddings.sparkSession.createDataFrame([], NEAREST), centroids
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for _ in range(rounds):
            held.move(centroids, counts, sums)
            full = counts > 0
            centroids = centroids.copy()
            centroids[full] = sums[full] // counts[full][:, None]
        return held.nearest(centroids), centroids
    finally:
        held.close()


def with_inertia(nearest, centroids):
    """Adds the sums of distances, per cluster and of all, and the digest of the centroid."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {
        row["cluster"]: row["total"]
        for row in nearest.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    }  # a row a centroid
    each = F.array(*[F.lit(sums.get(c, 0)).cast("bigint") for c in range(len(digests))])
    names = F.array(*[F.lit(d) for d in digests]).cast("array<string>")
    return nearest.select(
        "*",
        F.get(each, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )


def op13_vector_clusters(spark, sf_dir):
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _rounds_sql(rounds):
    """Assignment and update of each round, one after the other."""
    parts = []
    for i in range(rounds + 1):
        parts.append(
            f"p{i} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS dist "
            f"FROM v JOIN c{i} c ON c.d = v.d GROUP BY v.r, c.c),\n"
            f"a{i} AS (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM p{i} GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"c{i + 1} AS (SELECT o.c, o.d, coalesce(n.x, o.x) AS x FROM c{i} o LEFT JOIN "
                f"(SELECT a.c, v.d, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x "
                f"FROM a{i} a JOIN v ON v.r = a.r GROUP BY a.c, v.d) n ON n.c = o.c AND n.d = o.d)"
            )
    return ",\n".join(parts)


OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {WIDTH}
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
v AS (SELECT r, vec_id, unnest(range({WIDTH})) AS d,
    unnest(list_transform(e, lambda x: floor(x * {FACTOR})::BIGINT)) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS c FROM e
  WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),
c0 AS (SELECT s.c, v.d, v.x FROM s JOIN v ON v.r = s.r),
{_rounds_sql(ROUNDS)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT e.vec_id, a.c::INT AS cluster, a.dist::BIGINT AS distance,
  sum(a.dist) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.dist) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN e ON e.r = a.r JOIN h ON h.c = a.c
"""
