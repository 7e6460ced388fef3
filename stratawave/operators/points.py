"""Point clouds as rows (keys, pid, x, y, z): sampling, searches, clusters, shape."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.functions import vectors as v
from stratawave.operators import kernels
from stratawave.operators.order import positions, same
from stratawave.session import cut

XYZ = ("x", "y", "z")


def spot(alias: str = "") -> list[Column]:
    return [F.col(f"{alias}.{c}" if alias else c) for c in XYZ]


def squared(a: str, b: str) -> Column:
    return v.dot(v.subtract(spot(a), spot(b)), v.subtract(spot(a), spot(b)))


def explode_points(messages: DataFrame, width: int | None = None) -> DataFrame:
    """Points of cloud messages (topic, seq, ts, data of rows by shape): pid, x, y, z, attrs (further columns)."""
    from stratawave.operators.image import split_rows

    w = F.lit(width) if width else F.coalesce(F.get("shape", F.size("shape") - 1), F.lit(0))
    n = F.when(w >= 3, (F.size("data") / w).cast("int")).otherwise(0)
    each = messages.select("topic", "seq", "ts", F.posexplode(split_rows(F.col("data"), w, n)).alias("pid", "point"))
    return each.select("topic", "seq", "ts", "pid", *(F.get("point", F.lit(i)).alias(c) for i, c in enumerate(XYZ)), F.slice("point", 4, F.size("point")).alias("attrs"))


def voxel_downsample(points: DataFrame, voxel_size: float, by: Sequence[str] = (), columns: Sequence[str] = XYZ) -> DataFrame:
    """Mean of every column over each voxel; combines before the shuffle. Voxels are named by vx, vy, vz, whose order is the order of the result's rows when sorted."""
    if voxel_size <= 0:
        raise ValueError("a voxel size is above 0")
    cells = [F.floor(F.col(c) / voxel_size).alias(f"v{c}") for c in XYZ]
    return points.groupBy(*by, *cells).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("count"))


def uniform_downsample(points: DataFrame, every_k: int, start_index: int = 0) -> DataFrame:
    if every_k < 1 or start_index < 0:
        raise ValueError("every_k is at least 1 and start_index not negative")
    return points.filter((F.col("pid") >= start_index) & ((F.col("pid") - start_index) % every_k == 0))


def per_cloud(points: DataFrame, by: Sequence[str], run) -> DataFrame:
    """A kernel over whole clouds (each a sensor message): run(frame) picks or adds rows of one cloud, given in the order of pid."""
    by = list(by)

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame.sort_values("pid").reset_index(drop=True))

    grouped = points.groupBy(*by)
    return grouped.applyInPandas(each, points.schema)


def random_downsample(points: DataFrame, count: int | None = None, ratio: float | None = None, seed: int | None = None, replace: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """A count-exact random choice from each cloud, by NumPy's generator; in order unless with replacement."""
    if (count is None) == (ratio is None):
        raise ValueError("give either count or ratio")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        k = int(np.ceil(n * ratio)) if count is None else count
        chosen = np.random.default_rng(seed).choice(n, size=k if replace else min(k, n), replace=replace)
        return frame.iloc[chosen if replace else np.sort(chosen)]

    return per_cloud(points, by, run)


def farthest_point_downsample(points: DataFrame, count: int, start_index: int = 0, seed: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Greedy farthest points of each cloud, in the order chosen (column rank)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        start = start_index if seed is None else int(np.random.default_rng(seed).integers(len(frame)))
        chosen = kernels.farthest_points(frame[list(XYZ)].to_numpy(float), count, start)
        return frame.iloc[chosen].assign(rank=np.arange(len(chosen)))

    return per_cloud(points.withColumn("rank", F.lit(0).cast("long")), by, run)


def cells_around(size: Column | float) -> list[Column]:
    """Exploded names of the 27 cells around a point."""
    s = F.lit(float(size)) if not isinstance(size, Column) else size
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for d, c in zip(o, XYZ))) for o in np.ndindex(3, 3, 3)))
    return F.transform(steps, lambda o: F.struct(*((F.floor(F.col(c) / s) + o[f"d{c}"] - 1).alias(f"c{c}") for c in XYZ)))


def radius_pairs(points: DataFrame, queries: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """(keys, qid, pid, distance) of points at most ``radius`` from a query (pid renamed qid).

    Queries go to the 27 cells of a grid as wide as the radius, points to their own, so
    every pair meets once in an equi-join. A radius of 0 joins equal coordinates.
    """
    if radius < 0:
        raise ValueError("a radius is not negative")
    by = list(by)
    q = queries.filter(v.is_finite(*XYZ)).select(*by, F.col("pid").alias("qid"), *XYZ)
    p = points.filter(v.is_finite(*XYZ)).select(*by, "pid", *XYZ)
    if radius == 0:
        a, b = q.alias("a"), p.alias("b")
        on = same("a", "b", by) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.z") == F.col("b.z"))
        return a.join(b, on).select(*(F.col(f"a.`{k}`") for k in by), "a.qid", "b.pid", F.lit(0.0).alias("distance"))
    a = q.withColumn("cell", F.explode(cells_around(radius))).alias("a")
    b = p.withColumn("cell", F.struct(*(F.floor(F.col(c) / F.lit(float(radius))).alias(f"c{c}") for c in XYZ))).alias("b")
    on = same("a", "b", by) & (F.col("a.cell") == F.col("b.cell")) & (squared("a", "b") <= radius * radius)
    return a.join(b, on).select(*(F.col(f"a.`{k}`") for k in by), "a.qid", "b.pid", F.sqrt(squared("a", "b")).alias("distance"))


def radius_search(points: DataFrame, queries: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """(keys, qid, neighbors: ascending pids); a query without neighbours has an empty list."""
    by = list(by)
    found = radius_pairs(points, queries, radius, by).groupBy(*by, "qid").agg(F.array_sort(F.collect_list("pid")).alias("neighbors"))
    a, b = queries.select(*by, F.col("pid").alias("qid")).alias("a"), found.alias("b")
    return a.join(b, same("a", "b", [*by, "qid"]), "left").select(*(F.col(f"a.`{k}`") for k in by), "a.qid", F.coalesce("b.neighbors", F.array().cast(found.schema["neighbors"].dataType)).alias("neighbors"))


def nearest_first(pairs: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by, "qid").orderBy("distance", "pid")
    return pairs.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def hybrid_search(points: DataFrame, queries: DataFrame, radius: float, max_neighbors: int, by: Sequence[str] = ()) -> DataFrame:
    """(keys, qid, pid, distance, rank) of at most ``max_neighbors`` nearest points within the radius."""
    if max_neighbors < 1:
        raise ValueError("max_neighbors is at least 1")
    return nearest_first(radius_pairs(points, queries, radius, by), by, max_neighbors)


#: Levels of cells below a cloud's box, each half as wide as the one above; points of a cell, as a multiple of k, beyond which it is divided further.
LEVELS, CROWD = 32, 4


def knn_search(points: DataFrame, queries: DataFrame, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(keys, qid, pid, distance, rank) of the k nearest points of each query, fewer where a cloud has fewer; ties to the smaller pid.

    Exact in two steps whose cells follow the local density. Every cloud's box is halved
    LEVELS times; of the cells around a query, the smallest with more than CROWD · k points
    gives a bound of its k-th distance. The cells of the level that is just as wide as this
    bound then hold all its neighbours, in 27 cells. So a query meets a multiple of k
    points where the density changes smoothly, in a dense cloud as in a wide one. Of points
    at one place the k with the smallest pid count. A query far outside a cloud meets all
    of it.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    by, cell = list(by), ["cx", "cy", "cz"]
    p = points.filter(v.is_finite(*XYZ)).select(*by, "pid", *XYZ)
    q = queries.filter(v.is_finite(*XYZ)).select(*by, F.col("pid").alias("qid"), *XYZ)
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy(*by, *XYZ).orderBy("pid"))).filter(F.col("rank") <= k).drop("rank")
    wide = F.greatest(*(F.max(c) - F.min(c) for c in XYZ))
    boxes = cut(p.groupBy(*by).agg(F.when(wide > 0, wide).otherwise(1.0).alias("extent"), *(F.min(c).alias(f"low_{c}") for c in XYZ)))
    finest = lambda c: F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), (F.col(c) - F.col(f"low_{c}")) / F.col("extent") * F.lit(float(1 << LEVELS))))).cast("long")
    inside = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << LEVELS) - 1).cast("long"), x))

    def placed(df: DataFrame) -> DataFrame:
        a, b = df.alias("a"), boxes.alias("b")
        return a.join(b, same("a", "b", by)).select("a.*", "b.extent", *(f"b.low_{c}" for c in XYZ)).withColumns({f"c{c}": finest(c) for c in XYZ})

    def shifted(c: str, level: Column) -> Column:
        # a shift by the level's number, which is negative above the box
        return F.floor(F.col(c) / F.pow(F.lit(2.0), LEVELS - level)).cast("long")

    located = placed(p).withColumns({c: inside(F.col(c)) for c in cell})
    asked = placed(q)
    crowded = located.groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("n"))
    halves = lambda df: df.withColumn("level", F.explode(F.array(*map(F.lit, range(LEVELS + 1))))).withColumns({c: shifted(c, F.col("level")) for c in cell})
    crowded = halves(crowded).groupBy(*by, "level", *cell).agg(F.sum("n").alias("n")).filter(F.col("n") > CROWD * k)
    homes = asked.select(*by, *(inside(F.col(c)).alias(c) for c in cell)).distinct().select("*", F.struct(*cell).alias("home"))
    h, c = halves(homes).alias("h"), crowded.alias("c")
    levels = h.join(c, same("h", "c", [*by, "level", *cell])).groupBy(*(F.col(f"h.`{x}`") for x in by), "h.home").agg(F.max("h.level").alias("level"))
    a, l = asked.withColumn("home", F.struct(*(inside(F.col(x)).alias(x) for x in cell))).alias("a"), levels.alias("l")
    first = cut(a.join(l, same("a", "l", [*by, "home"]), "left").select("a.*", F.coalesce("l.level", F.lit(0)).alias("level")))

    def met(rows: DataFrame, at: DataFrame) -> DataFrame:
        """Pairs of queries with the points in the cells they name."""
        used = [r.level for r in at.select("level").distinct().collect()]  # at most one for each level
        b = located.withColumn("level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumns({c: shifted(c, F.col("level")) for c in cell}).alias("b")
        a = rows.alias("a")
        return a.join(b, same("a", "b", [*by, "level"]) & (F.col("a.ax") == F.col("b.cx")) & (F.col("a.ay") == F.col("b.cy")) & (F.col("a.az") == F.col("b.cz")))

    own = first.withColumns({f"a{x}": shifted(f"home.c{x}", F.col("level")) for x in XYZ})
    distance = F.sqrt(squared("a", "b"))
    bound = nearest_first(met(own, first).select(*(F.col(f"a.`{x}`") for x in by), "a.qid", "b.pid", distance.alias("distance")), by, k)
    bound = bound.groupBy(*by, "qid").agg(F.max("distance").alias("within"), F.count(F.lit(1)).alias("found"))
    a, d = first.alias("a"), bound.alias("d")
    reach = F.floor(F.log2(F.col("a.extent") / (F.col("d.within") * (1 + 1e-9)))).cast("int")
    second = a.join(d, same("a", "d", [*by, "qid"])).select(
        *(F.col(f"a.`{x}`") for x in (*by, "qid", *XYZ, *cell)), "d.within", F.when(F.col("d.within") == 0, LEVELS).otherwise(F.greatest(F.lit(-1000), F.least(F.lit(LEVELS), F.coalesce(reach, F.lit(-1000))))).alias("level")
    )
    second = cut(second)
    step = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    around = second
    for x in XYZ:
        around = around.withColumn(f"s{x}", F.explode(step)).withColumn(f"a{x}", shifted(f"c{x}", F.col("level")) + F.col(f"s{x}"))
    pairs = met(around, second).select(*(F.col(f"a.`{x}`") for x in by), "a.qid", "b.pid", distance.alias("distance"), "a.within").filter(F.col("distance") <= F.col("within") * (1 + 1e-9))
    return nearest_first(pairs.drop("within"), by, k)


def neighbours(points: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """Self search joined with the coordinates of the neighbours: (keys, qid, pid, rank, distance, x, y, z)."""
    by = list(by)
    a, b = knn_search(points, points, k, by).alias("a"), points.alias("b")
    return a.join(b, same("a", "b", by) & (F.col("a.pid") == F.col("b.pid"))).select(*(F.col(f"a.`{c}`") for c in by), "a.qid", "a.pid", "a.rank", "a.distance", *(F.col(f"b.{c}") for c in XYZ))


def local_covariances(points: DataFrame, k: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, covariance: 9 elements) of the k nearest points, the point itself among them, divided by k - 1."""
    pairs = [(a, b) for a in XYZ for b in XYZ]
    found = neighbours(points, k, by).groupBy(*by, "qid").agg(F.array(*(F.coalesce(F.covar_samp(a, b), F.lit(0.0)) for a, b in pairs)).alias("covariance"))
    return found.withColumnRenamed("qid", "pid")


def principal(covariance: Column | str) -> Column:
    """Struct (eigenvalues in descending order, normal) of flat 3x3 covariances, over Arrow batches."""

    @F.pandas_udf("struct<eigenvalues: array<double>, normal: array<double>>")
    def run(covariances: pd.Series) -> pd.DataFrame:
        stacked = np.stack([np.asarray(c, float).reshape(3, 3) for c in covariances]) if len(covariances) else np.zeros((0, 3, 3))
        values, vectors = np.linalg.eigh(stacked)
        return pd.DataFrame({"eigenvalues": list(np.clip(values[:, ::-1], 0, None)), "normal": list(kernels.signed(vectors[:, :, 0])) if len(stacked) else []})

    return run(covariance)


def curvature_descriptors(points: DataFrame, k: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Shape of each point's neighbourhood from the eigenvalues of its covariance, in descending order."""
    e = local_covariances(points, k, by).select(*by, "pid", principal("covariance")["eigenvalues"].alias("eigenvalues"))
    a, b, c = (F.get("eigenvalues", F.lit(i)) for i in range(3))
    eps = float(np.finfo(float).eps)
    largest, total = F.greatest(a, F.lit(eps)), F.greatest(a + b + c, F.lit(eps))
    entropy = sum((F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0) for x in (a, b, c)), F.lit(0.0))
    return e.select(
        *by, "pid", "eigenvalues", ((a - b) / largest).alias("linearity"), ((b - c) / largest).alias("planarity"), (c / largest).alias("scattering"), ((a - c) / largest).alias("anisotropy"),
        F.cbrt(a * b * c).alias("omnivariance"), (-entropy).alias("eigenentropy"), (c / total).alias("curvature"), (c / total).alias("surface_variation"),
    )


def estimate_normals(points: DataFrame, k: int = 8, orient_toward: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, normal): the direction of least spread, its largest component positive, or turned toward a point."""
    by = list(by)
    n = local_covariances(points, max(k, 3), by).select(*by, "pid", principal("covariance")["normal"].alias("normal"))
    if orient_toward is None:
        return n
    a, b = n.alias("a"), points.alias("b")
    toward = v.dot(v.unpack("a.normal", 3), [F.lit(float(o)) - F.col(f"b.{c}") for o, c in zip(orient_toward, XYZ)])
    joined = a.join(b, same("a", "b", by) & (F.col("a.pid") == F.col("b.pid")))
    return joined.select(*(F.col(f"a.`{c}`") for c in by), "a.pid", F.when(toward < 0, F.transform("a.normal", lambda x: -x)).otherwise(F.col("a.normal")).alias("normal"))


def nearest_neighbor_distances(points: DataFrame, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, distances): to the k nearest other points, ascending."""
    found = knn_search(points, points, k + 1, by).filter("rank > 0")
    return found.groupBy(*by, "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "distance"))), lambda s: s["distance"]).alias("distances")).withColumnRenamed("qid", "pid")


def nearest_neighbor_distance_stats(points: DataFrame, k: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Per cloud: mean, std (by n), min and max of all distances to the k nearest others."""
    each = nearest_neighbor_distances(points, k, by).select(*by, F.explode("distances").alias("d"))
    return each.groupBy(*by).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"))


def keep(points: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.alias("p").join(chosen.alias("c"), same("p", "c", [*by, "pid"]), "left_semi")


def statistical_outlier_filter(points: DataFrame, k: int = 8, std_ratio: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """Points whose mean distance to the k nearest others is at most the cloud's mean plus ``std_ratio`` deviations; a single point stays."""
    by = list(by)
    means = cut(nearest_neighbor_distances(points, k, by).select(*by, "pid", (F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / F.size("distances")).alias("d")))
    limits = means.groupBy(*by).agg((F.avg("d") + std_ratio * F.stddev_pop("d")).alias("most"))
    a, b = means.alias("a"), limits.alias("b")
    good = a.join(b, same("a", "b", by)).filter(F.col("a.d") <= F.col("b.most")).select(*(F.col(f"a.`{c}`") for c in by), "a.pid")
    single = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("pid")).filter("n = 1").select(*by, "pid")
    return keep(points, good.unionByName(single), by)


def radius_outlier_filter(points: DataFrame, radius: float, min_neighbors: int, by: Sequence[str] = ()) -> DataFrame:
    """Points with at least ``min_neighbors`` others within the radius."""
    counts = radius_pairs(points, points, radius, by).groupBy(*by, F.col("qid").alias("pid")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return keep(points, counts.filter(F.col("n") >= min_neighbors), by)


def components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, root): the least pid of each node's component of the graph of (keys, a, b).

    Each round lets every node with a smaller neighbour hang on its smallest one, shortens
    the trees so made to their roots by doubling, and contracts the edges to the roots. The
    graph shrinks with each round and ends without edges. Rounds are cut in the shared
    folder.
    """
    by = list(by)
    left = cut(edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    roots = nodes.select(*by, "pid", F.col("pid").alias("root"))

    def follow(df: DataFrame, column: str, up: DataFrame) -> DataFrame:
        """``column`` replaced by what it hangs on, if anything; moved tells where it did."""
        d, u = df.alias("d"), up.alias("u")
        joined = d.join(u, same("d", "u", by) & (F.col(f"d.{column}") == F.col("u.node")), "left")
        kept = [F.coalesce("u.up", f"d.{column}").alias(column) if c == column else F.col(f"d.`{c}`") for c in df.columns if c != "moved"]
        return joined.select(*kept, F.col("u.up").isNotNull().alias("moved"))

    while True:
        up = cut(left.groupBy(*by, F.col("a").alias("node")).agg(F.min("b").alias("up")).filter("up < node"))
        if not up.take(1):
            return cut(roots)
        while True:
            up = cut(follow(follow(up, "up", up), "up", up))
            if not up.filter("moved").take(1):
                break
        up = up.drop("moved")
        roots = cut(follow(roots, "root", up).drop("moved"))
        left = cut(follow(follow(left, "a", up), "b", up).drop("moved").filter("a <> b").distinct())


def ranked(roots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Numbers 0, 1, ... for the roots of each cloud in their order."""
    return positions(roots.select(*by, "root").distinct(), by, ["root"], "label")


def connected_components(points: DataFrame, radius: float, min_component_size: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, label, size): components of the graph of points within ``radius``, numbered by their first pid; small ones are -1."""
    by = list(by)
    edges = radius_pairs(points, points, radius, by).filter("qid < pid").select(*by, F.col("qid").alias("a"), F.col("pid").alias("b"))
    state = components(points, edges, by)
    sizes = state.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("size"))
    big = ranked(sizes.filter(F.col("size") >= min_component_size), by)
    a, b, c = state.alias("a"), sizes.alias("b"), big.alias("c")
    joined = a.join(b, same("a", "b", [*by, "root"])).join(c, same("a", "c", [*by, "root"]), "left")
    return joined.select(*(F.col(f"a.`{k}`") for k in by), "a.pid", F.coalesce("c.label", F.lit(-1).cast("long")).alias("label"), "b.size")


def cluster_dbscan(points: DataFrame, eps: float, min_points: int, by: Sequence[str] = ()) -> DataFrame:
    """(keys, pid, label): DBSCAN; noise is -1.

    Core points have ``min_points`` within ``eps``, themselves included; clusters are the
    components of core points and are numbered by their least core pid, which is the
    order in which a scan would open them. A border point belongs to the first of the
    clusters that reach it.
    """
    if eps <= 0 or min_points < 1:
        raise ValueError("eps is above 0 and min_points at least 1")
    by = list(by)
    pairs = cut(radius_pairs(points, points, eps, by).select(*by, "qid", "pid"))
    core = cut(pairs.groupBy(*by, F.col("qid").alias("pid")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select(*by, "pid"))
    a, c = pairs.alias("a"), core.alias("c")
    from_core = a.join(c, same("a", "c", by) & (F.col("a.qid") == F.col("c.pid")), "left_semi")
    edges = from_core.join(c, same("a", "c", by) & (F.col("a.pid") == F.col("c.pid")), "left_semi").filter("qid < pid").select(*by, F.col("qid").alias("a"), F.col("pid").alias("b"))
    state = components(core, edges, by)
    labels = ranked(state, by)
    s, l = state.alias("s"), labels.alias("l")
    named = cut(s.join(l, same("s", "l", [*by, "root"])).select(*(F.col(f"s.`{k}`") for k in by), "s.pid", "l.label"))
    n = named.alias("n")
    reached = a.join(n, same("a", "n", by) & (F.col("a.qid") == F.col("n.pid"))).groupBy(*(F.col(f"a.`{k}`").alias(k) for k in by), F.col("a.pid").alias("pid")).agg(F.min("n.label").alias("label"))
    p, r = points.alias("p"), reached.alias("r")
    joined = p.join(n, same("p", "n", [*by, "pid"]), "left").join(r, same("p", "r", [*by, "pid"]), "left")
    return joined.select(*(F.col(f"p.`{k}`") for k in by), "p.pid", F.coalesce("n.label", "r.label", F.lit(-1).cast("long")).alias("label"))


def iter_loop_closure_candidates(poses: DataFrame, radius: float, min_separation: int = 30, max_candidates_per_pose: int = 1, by: Sequence[str] = ("topic",)) -> DataFrame:
    """(keys, source_index, target_index, pose_distance): earlier poses within the radius and at least ``min_separation`` rows before, the nearest first.

    ``poses`` has seq (the index) and position. A radius of 0 takes the earliest pose at
    the same place.
    """
    if radius < 0 or min_separation < 1 or max_candidates_per_pose < 1:
        raise ValueError("radius is not negative; separation and candidates are at least 1")
    spots = poses.select(*by, F.col("seq").alias("pid"), *(x.alias(c) for x, c in zip(v.unpack("position", 3), XYZ)))
    pairs = radius_pairs(spots, spots, radius, by).filter(F.col("pid") <= F.col("qid") - min_separation)
    best = nearest_first(pairs, by, max_candidates_per_pose)
    return best.select(*by, F.col("qid").alias("source_index"), F.col("pid").alias("target_index"), F.col("distance").alias("pose_distance"))


find_loop_closure_candidates = iter_loop_closure_candidates


def segment_plane(points: DataFrame, distance_threshold: float, iterations: int = 100, seed: int = 0) -> dict:
    """Best plane of a cloud by random triples: {plane: (a, b, c, d) of unit normal, inliers: count, points: count}.

    The triples come from NumPy's generator on the driver (at most 3 · ``iterations``
    points are fetched); one pass over the points counts the inliers of all planes in
    Arrow batches and sums the counts. The first of equally good planes is kept,
    degenerate triples are skipped. None for fewer than three points.
    """
    if distance_threshold < 0 or iterations < 1:
        raise ValueError("a threshold is not negative and there is at least one iteration")
    placed = cut(positions(points.filter(v.is_finite(*XYZ)).select("pid", *XYZ), [], ["pid"], "place"))
    n = placed.count()
    if n < 3:
        return {"plane": None, "inliers": 0, "points": n}
    rng = np.random.default_rng(seed)
    triples = np.array([rng.choice(n, 3, replace=False) for _ in range(iterations)])
    wanted = placed.sparkSession.createDataFrame([(int(i),) for i in np.unique(triples)], "place long")
    rows = {r.place: (r.x, r.y, r.z) for r in placed.join(F.broadcast(wanted), "place").collect()}
    planes = []
    for t in triples:
        a, b, c = (np.array(rows[int(i)]) for i in t)
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        planes.append(np.append(normal / size, -(normal / size) @ a) if size > 1e-12 else np.full(4, np.nan))
    stacked = np.array(planes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = np.abs(batch[list(XYZ)].to_numpy(float) @ stacked[:, :3].T + stacked[:, 3])
            yield pd.DataFrame({"plane": np.arange(len(stacked)), "n": (d <= distance_threshold).sum(axis=0)})

    best = placed.mapInPandas(count, "plane int, n long").groupBy("plane").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "plane").first()
    if not best.n:
        return {"plane": None, "inliers": 0, "points": n}
    return {"plane": tuple(map(float, stacked[best.plane])), "inliers": best.n, "points": n}


def plane_distance(plane: Sequence[float]) -> Column:
    return F.abs(v.dot(list(plane[:3]), spot()) + float(plane[3]))


def segment_ground(points: DataFrame, distance_threshold: float, up_axis=(0.0, 0.0, 1.0), max_slope_degrees: float = 20.0, iterations: int = 100, seed: int = 0) -> tuple[DataFrame, dict]:
    """Points with is_ground, and the plane, turned to point up.

    A plane steeper than the bound is no ground: then no point is.
    """
    found = segment_plane(points, distance_threshold, iterations, seed)
    plane = found["plane"]
    if plane is not None:
        up = np.asarray(up_axis, float) / np.linalg.norm(up_axis)
        cosine = float(np.dot(plane[:3], up))
        plane = tuple(-x for x in plane) if cosine < 0 else plane
        if abs(cosine) < np.cos(np.radians(max_slope_degrees)):
            plane = None
    mask = F.coalesce(plane_distance(plane) <= distance_threshold, F.lit(False)) if plane is not None else F.lit(False)
    return points.withColumn("is_ground", mask), found | {"plane": plane}


def valid_point_cloud_points(points: DataFrame, finite: bool = True, drop_zero_xyz: bool = True) -> DataFrame:
    out = points
    if finite:
        out = out.filter(v.is_finite(*XYZ))
    if drop_zero_xyz:
        out = out.filter(~F.coalesce((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0), F.lit(False)))
    return out


def calibrate_point_cloud_metric_scale(relative: DataFrame, accurate: DataFrame, correspondence: str = "index", fit_offset: bool = True, max_correspondence_distance: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(keys, scale, offset, correspondence_count, rmse) of accurate = scale · relative + offset by least squares, from moments in one aggregate.

    Points correspond by pid, or each relative point to the nearest accurate one.
    """
    by = list(by)
    r, a = relative.alias("r"), accurate.alias("a")
    if correspondence == "index":
        pairs = r.join(a, same("r", "a", [*by, "pid"]))
    elif correspondence == "nearest":
        near = knn_search(accurate, relative, 1, by)
        if max_correspondence_distance is not None:
            near = near.filter(F.col("distance") <= max_correspondence_distance)
        n = near.alias("n")
        pairs = r.join(n, same("r", "n", by) & (F.col("r.pid") == F.col("n.qid"))).join(a, same("n", "a", [*by, "pid"]))
    else:
        raise ValueError("points correspond by index or nearest")
    good = pairs.filter(v.is_finite(*spot("r"), *spot("a")))
    s, t = spot("r"), spot("a")
    sums = good.groupBy(*(F.col(f"r.`{k}`").alias(k) for k in by)).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"s{c}") for x, c in zip(s, XYZ)), *(F.avg(x).alias(f"t{c}") for x, c in zip(t, XYZ)),
        F.avg(v.dot(s, s)).alias("ss"), F.avg(v.dot(s, t)).alias("st"), F.avg(v.dot(t, t)).alias("tt"),
    )
    ms, mt = [F.col(f"s{c}") for c in XYZ], [F.col(f"t{c}") for c in XYZ]
    if fit_offset:
        scale = (F.col("st") - v.dot(ms, mt)) / F.nullif(F.col("ss") - v.dot(ms, ms), F.lit(0.0))
        offset = v.subtract(mt, v.scale(ms, scale))
    else:
        scale, offset = F.col("st") / F.nullif(F.col("ss"), F.lit(0.0)), [F.lit(0.0)] * 3
    # the mean squared residual, multiplied out
    o = offset
    square = F.col("tt") + scale * scale * F.col("ss") + v.dot(o, o) - 2 * scale * F.col("st") - 2 * v.dot(o, mt) + 2 * scale * v.dot(o, ms)
    return sums.select(*by, scale.alias("scale"), F.array(*offset).alias("offset"), F.col("n").alias("correspondence_count"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("rmse"))


def apply_point_cloud_metric_scale(points: DataFrame, scale: float, offset: Sequence[float] | float = 0.0) -> DataFrame:
    o = [float(offset)] * 3 if isinstance(offset, (int, float)) else [float(x) for x in offset]
    return points.withColumns({c: F.col(c) * float(scale) + d for c, d in zip(XYZ, o)})


def calibrate_depth_anything_point_cloud(points: DataFrame, scale: float, offset: float, min_depth: float | None = 0.1, max_depth: float | None = 8.0) -> DataFrame:
    """Relative cloud (camera looks along -z) to metric: depth d = -z becomes scale · d + offset, x and y grow along; depths out of range are left out."""
    d = -F.col("z")
    m = d * float(scale) + float(offset)
    ratio = m / F.nullif(d, F.lit(0.0))
    good = v.is_finite(ratio, m) & (d > 0)
    if min_depth is not None:
        good = good & (m >= float(min_depth))
    if max_depth is not None:
        good = good & (m <= float(max_depth))
    return points.filter(good).withColumns({"x": F.col("x") * ratio, "y": F.col("y") * ratio, "z": -m})


def apply_depth_metric_scale(depth: Column, scale: float, offset: float = 0.0, min_depth: float = 0.0, preserve_invalid: bool = True) -> Column:
    adjusted = depth * float(scale) + float(offset)
    return F.when(v.is_finite(depth) & (depth > min_depth), adjusted).otherwise(depth) if preserve_invalid else adjusted


def calibrate_depth_metric_scale(relative: DataFrame, accurate: DataFrame, fit_offset: bool = True, min_depth: float = 0.0) -> DataFrame:
    """(scale, offset, correspondence_count, rmse) between two depth images of rows (row, col, z) over pixels valid in both.

    Points of an accurate cloud become a depth image by points_to_depth_image.
    """
    a, b = relative.alias("a"), accurate.alias("b")
    pairs = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.col") == F.col("b.col"))).select(F.col("a.z").alias("x"), F.col("b.z").alias("y"))
    pairs = pairs.filter(v.is_finite("x", "y") & (F.col("x") > min_depth) & (F.col("y") > 0))
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg(F.col("y") * F.col("y")).alias("yy"))
    mx, my, xx, xy, yy = (F.col(c) for c in ("mx", "my", "xx", "xy", "yy"))
    scale = (xy - mx * my) / F.nullif(xx - mx * mx, F.lit(0.0)) if fit_offset else xy / F.nullif(xx, F.lit(0.0))
    offset = my - scale * mx if fit_offset else F.lit(0.0)
    square = yy + scale * scale * xx + offset * offset - 2 * scale * xy - 2 * offset * my + 2 * scale * offset * mx
    return sums.select(scale.alias("scale"), offset.alias("offset"), F.col("n").alias("correspondence_count"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("rmse"))
