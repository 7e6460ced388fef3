"""Elevation rasters as cells (raster, row, col, z); row grows with y unless said otherwise.

Neighbourhoods are made by sending each cell to the cells it serves, or by lag and lead
along rows and columns, so rasters of any size spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawave.functions import geodesy
from stratawave.functions import vectors as v
from stratawave.functions.transforms import dem_grid_to_points
from stratawave.operators.order import same
from stratawave.session import cut

KEY = ("raster",)
CELL = ("raster", "row", "col")
NAN = float("nan")


def sizes(cells: DataFrame) -> DataFrame:
    """(raster, rows, cols); a small table."""
    return cells.groupBy(*KEY).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def with_sizes(cells: DataFrame) -> DataFrame:
    a, b = cells.alias("a"), sizes(cells).alias("b")
    return a.join(b, same("a", "b", KEY)).select("a.*", "b.rows", "b.cols")


def explode_raster(messages: DataFrame, name: str = "name") -> DataFrame:
    """Cells of raster messages with shape (rows, cols)."""
    cols = F.get("shape", F.lit(1))
    return messages.select(F.col(name).alias("raster"), cols.alias("cols"), F.posexplode("data").alias("i", "z")).select("raster", F.floor(F.col("i") / F.col("cols")).cast("int").alias("row"), (F.col("i") % F.col("cols")).cast("int").alias("col"), "z")


def crop_raster(cells: DataFrame, row_start: int, row_stop: int, col_start: int, col_stop: int) -> DataFrame:
    """Rows and columns in half-open ranges, numbered from 0 again."""
    kept = cells.filter((F.col("row") >= row_start) & (F.col("row") < row_stop) & (F.col("col") >= col_start) & (F.col("col") < col_stop))
    return kept.withColumns({"row": F.col("row") - max(row_start, 0), "col": F.col("col") - max(col_start, 0)})


def mosaic_tiles(cells: DataFrame, tile_row: Column, tile_col: Column, name: str = "mosaic") -> DataFrame:
    """Tiles of equal shape, placed by the rank of their row and column key."""
    named = cells.withColumns({"tile_row": tile_row, "tile_col": tile_col})
    tiles = named.groupBy("raster", "tile_row", "tile_col").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    shape = tiles.agg(F.max("rows").alias("h"), F.max("cols").alias("w"))
    ranked = lambda c: tiles.select(c).distinct().select(c, (F.dense_rank().over(Window.orderBy(c)) - 1).alias(f"{c}_at"))  # noqa: E731  # one row for each row or column of tiles
    placed = named.join(ranked("tile_row"), "tile_row").join(ranked("tile_col"), "tile_col").crossJoin(F.broadcast(shape))
    return placed.select(F.lit(name).alias("raster"), (F.col("tile_row_at") * F.col("h") + F.col("row")).cast("int").alias("row"), (F.col("tile_col_at") * F.col("w") + F.col("col")).cast("int").alias("col"), "z")


def tile_corner(name: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a tile's south-west corner from a name such as N37W122."""
    part = lambda i: F.regexp_extract(F.upper(name), r"([NS])(\d{1,2})([EW])(\d{1,3})", i)
    wrong = F.raise_error(F.concat(F.lit("not the name of a tile: "), name)).cast("int")
    lat = F.when(part(2) == "", wrong).otherwise(part(2).cast("int") * F.when(part(1) == "S", -1).otherwise(1))
    lon = F.when(part(4) == "", wrong).otherwise(part(4).cast("int") * F.when(part(3) == "W", -1).otherwise(1))
    return lat, lon


def mosaic_dem_tiles(cells: DataFrame, fill_value: float = NAN, name: str = "mosaic") -> DataFrame:
    """One raster, its row 0 in the north, from tiles named by their corner; absent tiles are filled.

    Tiles must have one shape and different corners, and must not be too sparse for their
    span (more than max(64, 8 · tiles) places): each is an error.
    """
    lat, lon = tile_corner(F.col("raster"))
    named = cells.withColumns({"lat": lat, "lon": lon})
    tiles = named.groupBy("raster", "lat", "lon").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    t = tiles.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lat", "lon").alias("corners"), F.countDistinct("h", "w").alias("shapes"), F.max("h").alias("h"), F.max("w").alias("w"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")).first()
    if not t.n:
        raise ValueError("there is no tile")
    if t.shapes != 1:
        raise ValueError("tiles differ in shape")
    if t.corners != t.n:
        raise ValueError("two tiles have the same corner")
    rows, columns = t.north - t.south + 1, t.east - t.west + 1
    if rows * columns > max(64, 8 * t.n):
        raise ValueError(f"{t.n} tiles are too few for {rows} x {columns} places")
    placed = named.select(((F.lit(t.north) - F.col("lat")) * t.h + F.col("row")).alias("row"), ((F.col("lon") - t.west) * t.w + F.col("col")).alias("col"), "z")
    grid = dense_grid(cells.sparkSession, rows * t.h, columns * t.w)
    return grid.join(placed, ["row", "col"], "left").select(F.lit(name).alias("raster"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.coalesce("z", F.lit(float(fill_value))).alias("z"))


def dense_grid(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def sample_grid(cells: DataFrame, queries: DataFrame, rows: Column | str = "at_row", cols: Column | str = "at_col", bilinear: bool = True) -> DataFrame:
    """Adds sample: the raster's value at fractional rows and columns, clamped to its edges; raster names both sides.

    Bilinear values need their four corners, which come by one equi-join; nearest values
    round halves to even. A NaN corner with weight makes the value NaN; a query that is
    null or NaN, or of an unknown raster, gives NaN.
    """
    identity = "query_identity"
    asked = cut(queries.withColumns({"at_r": v.col(rows), "at_c": v.col(cols), identity: F.monotonically_increasing_id()}))
    a, b = asked.filter(v.is_finite("at_r", "at_c")).alias("a"), sizes(cells).alias("b")
    clamp = lambda x, most: F.greatest(F.lit(0.0), F.least(x, (most - 1).cast("double")))
    near = a.join(b, same("a", "b", KEY)).select("a.raster", f"a.{identity}", clamp(F.col("a.at_r"), F.col("b.rows")).alias("r"), clamp(F.col("a.at_c"), F.col("b.cols")).alias("c"), "b.rows", "b.cols")
    if bilinear:
        r0, c0 = F.floor("r").cast("int"), F.floor("c").cast("int")
        fr, fc = F.col("r") - r0, F.col("c") - c0
        r1, c1 = F.least(r0 + 1, F.col("rows") - 1), F.least(c0 + 1, F.col("cols") - 1)
        corner = lambda rr, cc, w: F.struct(rr.cast("int").alias("row"), cc.cast("int").alias("col"), w.alias("weight"))
        corners = F.array(corner(r0, c0, (1 - fr) * (1 - fc)), corner(r0, c1, (1 - fr) * fc), corner(r1, c0, fr * (1 - fc)), corner(r1, c1, fr * fc))
    else:
        corners = F.array(F.struct(F.rint("r").cast("int").alias("row"), F.rint("c").cast("int").alias("col"), F.lit(1.0).alias("weight")))
    wanted = near.select("raster", identity, F.explode(corners).alias("k")).select("raster", identity, "k.row", "k.col", "k.weight").alias("w")
    values = wanted.join(cells.alias("z"), same("w", "z", CELL), "left")
    # a corner without weight does not spoil the value
    term = F.when(F.col("w.weight") > 0, F.coalesce("z.z", F.lit(NAN)) * F.col("w.weight")).otherwise(0.0)
    sampled = values.groupBy(f"w.{identity}").agg(F.sum(term).alias("sample"))
    x, y = asked.alias("x"), sampled.alias("y")
    return x.join(y, F.col(f"x.{identity}") == F.col(f"y.{identity}"), "left").select(*(F.col(f"x.`{c}`") for c in queries.columns), F.coalesce("y.sample", F.lit(NAN)).alias("sample"))


def linspace(index: Column, n: int, low: Column, high: Column) -> Column:
    return low + index * (high - low) / (n - 1) if n > 1 else low


def target_cells(cells: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Every cell of a raster of the new shape, with the old size: raster, row, col, rows, cols."""
    h, w = (int(x) for x in shape)
    if h < 1 or w < 1:
        raise ValueError("a shape is at least 1 x 1")
    return sizes(cells).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))


def is_bilinear(method: str) -> bool:
    if method not in ("bilinear", "nearest"):
        raise ValueError("the method is bilinear or nearest")
    return method == "bilinear"


def resample_raster(cells: DataFrame, shape: Sequence[int], method: str = "bilinear") -> DataFrame:
    """The raster on another number of rows and columns, edges on edges."""
    at = target_cells(cells, shape).select(*CELL, linspace(F.col("row"), shape[0], F.lit(0.0), (F.col("rows") - 1).cast("double")).alias("at_row"), linspace(F.col("col"), shape[1], F.lit(0.0), (F.col("cols") - 1).cast("double")).alias("at_col"))
    return sample_grid(cells, at, bilinear=is_bilinear(method)).select(*CELL, F.col("sample").alias("z"))


def reproject_raster(cells: DataFrame, src_bounds: Sequence[float], shape: Sequence[int], dst_bounds: Sequence[float] | None = None, transform=None, method: str = "bilinear", fill_value: float = NAN) -> DataFrame:
    """The raster on a new grid. Bounds are (min_x, min_y, max_x, max_y), row 0 lying at min_y.

    ``transform`` maps new coordinates to old ones: a 3x3 homography, or a function of two
    columns. Places outside the source are filled.
    """
    s, d = list(map(float, src_bounds)), list(map(float, dst_bounds or src_bounds))
    if s[0] >= s[2] or s[1] >= s[3] or d[0] >= d[2] or d[1] >= d[3]:
        raise ValueError("bounds end before they start")
    x, y = linspace(F.col("col"), shape[1], F.lit(d[0]), F.lit(d[2])), linspace(F.col("row"), shape[0], F.lit(d[1]), F.lit(d[3]))
    if callable(transform):
        x, y = transform(x, y)
    elif transform is not None:
        m = [[float(k) for k in row] for row in np.asarray(transform, float).reshape(3, 3)]
        w = m[2][0] * x + m[2][1] * y + m[2][2]
        x, y = (F.try_divide(m[i][0] * x + m[i][1] * y + m[i][2], w) for i in (0, 1))
    at = target_cells(cells, shape).select(*CELL, ((y - s[1]) / (s[3] - s[1]) * (F.col("rows") - 1)).alias("at_row"), ((x - s[0]) / (s[2] - s[0]) * (F.col("cols") - 1)).alias("at_col"), "rows", "cols")
    inside = v.between("at_row", 0.0, None) & (F.col("at_row") <= F.col("rows") - 1) & v.between("at_col", 0.0, None) & (F.col("at_col") <= F.col("cols") - 1)
    return sample_grid(cells, at, bilinear=is_bilinear(method)).select(*CELL, F.when(inside, F.col("sample")).otherwise(F.lit(float(fill_value))).alias("z"))


def terrain_gradients(cells: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Adds dz_dy and dz_dx: central differences inside, one-sided at the edges, null where a raster has one row or column.

    Windows run along single rows and single columns.
    """
    if resolution <= 0:
        raise ValueError("a resolution is above 0")

    def slope(line: str, along: str) -> Column:
        w = Window.partitionBy("raster", line).orderBy(along)
        back, ahead = F.lag("z").over(w), F.lead("z").over(w)
        first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
        return F.when(first, ahead - F.col("z")).when(last, F.col("z") - back).otherwise((ahead - back) / 2) / float(resolution)

    return cells.withColumn("dz_dx", slope("row", "col")).withColumn("dz_dy", slope("col", "row"))


def terrain_normals(cells: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Adds normal: the unit vector across (1, 0, dz_dx) and (0, 1, dz_dy)."""
    n = [-F.col("dz_dx"), -F.col("dz_dy"), F.lit(1.0)]
    size = v.norm(n)
    return terrain_gradients(cells, resolution).withColumn("normal", F.array(*(x / size for x in n)))


def slope_aspect(cells: DataFrame, resolution: float = 1.0, north_up: bool = False) -> DataFrame:
    """Adds slope (radians) and aspect (direction of descent, clockwise from north); with ``north_up`` rows grow to the south."""
    g = terrain_gradients(cells, resolution)
    dx, dy = F.col("dz_dx"), F.col("dz_dy") * (-1.0 if north_up else 1.0)
    return g.withColumns({"slope": F.atan(F.hypot(dx, dy)), "aspect": F.atan2(-dx, -dy)})


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, resolution: float = 1.0, north_up: bool = False) -> DataFrame:
    """Adds shade in 0 to 1: the cosine between the surface and the light, not below 0."""
    a, h = float(np.radians(azimuth)), float(np.radians(altitude))
    s = slope_aspect(cells, resolution, north_up)
    light = F.lit(np.sin(h)) * F.cos("slope") + F.lit(np.cos(h)) * F.sin("slope") * F.cos(F.lit(a) - F.col("aspect"))
    shade = F.when(F.isnan(light), light).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), light)))
    return s.withColumn("shade", shade)


def serve(cells: DataFrame, window: int, center: bool = False) -> DataFrame:
    """Each cell sent to the cells whose edge-padded window holds it: (raster, row, col, z, times, dr, dc).

    ``times`` is how often padding repeats it there. A window has window // 2 cells before
    its middle and the rest behind.
    """
    if window < 1:
        raise ValueError("a window has at least one cell")
    before = window // 2
    after = window - 1 - before
    sized = with_sizes(cells)

    def reached(at: Column, n: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), at - after), F.least(n - 1, at + before))

    def repeats(at: Column, middle: Column, n: Column) -> Column:
        # offsets o in [-before, after] with clamp(middle + o) = at
        low = F.when(at == 0, F.lit(-before)).otherwise(at - middle)
        high = F.when(at == n - 1, F.lit(after)).otherwise(at - middle)
        return F.greatest(F.lit(0), F.least(high, F.lit(after)) - F.greatest(low, F.lit(-before)) + 1)

    r, c = F.col("row"), F.col("col")
    spread = sized.withColumn("to_row", F.explode(reached(r, F.col("rows")))).withColumn("to_col", F.explode(reached(c, F.col("cols"))))
    del center
    return spread.select("raster", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "z", (repeats(r, F.col("to_row"), F.col("rows")) * repeats(c, F.col("to_col"), F.col("cols"))).alias("times"))


def local_moments(cells: DataFrame, window: int) -> DataFrame:
    """(raster, row, col, mean, std, min, max) over finite values of edge-padded windows; std by the number of values.

    Values are taken relative to the cell in the middle before they are squared, so large
    elevations do not cancel.
    """
    a, b = serve(cells, window).alias("a"), cells.alias("b")
    pairs = a.join(b, same("a", "b", CELL)).select(*(F.col(f"a.{c}") for c in CELL), F.col("a.z").alias("z"), F.when(v.is_finite("b.z"), F.col("b.z")).otherwise(0.0).alias("base"), F.col("a.times").alias("times"))
    good = v.is_finite("z")
    d, t = F.when(good, F.col("z") - F.col("base")), F.when(good, F.col("times"))
    g = pairs.groupBy(*CELL).agg(F.sum(t).alias("n"), F.sum(d * t).alias("s"), F.sum(d * d * t).alias("q"), F.min(F.when(good, F.col("z"))).alias("min"), F.max(F.when(good, F.col("z"))).alias("max"), F.first("base").alias("base"))
    mean = F.col("s") / F.col("n")
    nan = F.lit(NAN)
    some = F.col("n") > 0
    return g.select(*CELL, F.when(some, F.col("base") + mean).otherwise(nan).alias("mean"), F.when(some, F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))).otherwise(nan).alias("std"), F.coalesce("min", nan).alias("min"), F.coalesce("max", nan).alias("max"))


def roughness_map(cells: DataFrame, window_size: int = 3) -> DataFrame:
    """(raster, row, col, roughness): the standard deviation of elevation in a window."""
    return local_moments(cells, window_size).select(*CELL, F.col("std").alias("roughness"))


def traversability_map(cells: DataFrame, resolution: float = 1.0, max_slope_degrees: float = 30.0, max_roughness: float | None = None, roughness_window: int = 3) -> DataFrame:
    """(raster, row, col, score, passable): 1 on flat ground, 0 at the greatest slope or roughness and where z is not finite."""
    if max_slope_degrees <= 0 or (max_roughness is not None and max_roughness <= 0):
        raise ValueError("the greatest slope and roughness are above 0")
    unit = lambda x: 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = unit(F.col("slope") / float(np.radians(max_slope_degrees)))
    s = slope_aspect(cells, resolution)
    if max_roughness is not None:
        a, b = s.alias("a"), roughness_map(cells, roughness_window).alias("b")
        s = a.join(b, same("a", "b", CELL)).select("a.*", "b.roughness")
        score = F.least(score, unit(F.col("roughness") / float(max_roughness)))
    score = F.when(v.is_finite("z"), score).otherwise(0.0)
    return s.select(*CELL, score.alias("score"), (score > 0).alias("passable"))


def sample_elevation(cells: DataFrame, queries: DataFrame, x: Column | str = "x", y: Column | str = "y", resolution: float = 1.0, origin=(0.0, 0.0), bilinear: bool = True) -> DataFrame:
    """Adds sample at local coordinates."""
    if resolution <= 0:
        raise ValueError("a resolution is above 0")
    return sample_grid(cells, queries, (v.col(y) - float(origin[1])) / float(resolution), (v.col(x) - float(origin[0])) / float(resolution), bilinear)


def sample_elevation_at_navsat(cells: DataFrame, queries: DataFrame, navsat: str, ref_lat: float, ref_lon: float, ref_alt: float = 0.0, resolution: float = 1.0, origin=(0.0, 0.0), bilinear: bool = True) -> DataFrame:
    e, n, _ = geodesy.navsat_to_enu(*v.unpack(navsat, 3), ref_lat, ref_lon, ref_alt)
    return sample_elevation(cells, queries, e, n, resolution, origin, bilinear)


def terrain_patch(cells: DataFrame, center: Sequence[float], size: int | Sequence[int], resolution: float = 1.0, origin=(0.0, 0.0), fill_value: float = NAN) -> DataFrame:
    """(raster, row, col, z, x0, y0) of a patch of fixed size about a place in every raster, filled outside; x0 and y0 locate its first cell."""
    if resolution <= 0:
        raise ValueError("a resolution is above 0")
    rows, cols = (size, size) if isinstance(size, int) else size
    if rows < 1 or cols < 1:
        raise ValueError("a patch is at least 1 x 1")
    first_row = int(np.rint((center[1] - origin[1]) / resolution)) - rows // 2
    first_col = int(np.rint((center[0] - origin[0]) / resolution)) - cols // 2
    inside = cells.filter((F.col("row") >= first_row) & (F.col("row") < first_row + rows) & (F.col("col") >= first_col) & (F.col("col") < first_col + cols))
    inside = inside.withColumns({"row": F.col("row") - first_row, "col": F.col("col") - first_col})
    grid = target_cells(cells, (rows, cols)).select(*CELL)
    a, b = grid.alias("a"), inside.alias("b")
    return a.join(b, same("a", "b", CELL), "left").select(*(F.col(f"a.{c}") for c in CELL), F.coalesce("b.z", F.lit(float(fill_value))).alias("z"), F.lit(origin[0] + first_col * resolution).alias("x0"), F.lit(origin[1] + first_row * resolution).alias("y0"))


def terrain_patch_at_navsat(cells: DataFrame, navsat: Sequence[float], ref_lat: float, ref_lon: float, ref_alt: float = 0.0, size=3, resolution: float = 1.0, origin=(0.0, 0.0), fill_value: float = NAN) -> DataFrame:
    del ref_alt
    e = np.radians(navsat[1] - ref_lon) * geodesy.EARTH_RADIUS * np.cos(np.radians(ref_lat))
    n = np.radians(navsat[0] - ref_lat) * geodesy.EARTH_RADIUS
    return terrain_patch(cells, (float(e), float(n)), size, resolution, origin, fill_value)


def dem_to_point_cloud(cells: DataFrame, x=None, y=None, resolution: float = 1.0, origin=(0.0, 0.0), include_nan: bool = False) -> DataFrame:
    points = dem_grid_to_points(cells, x, y, resolution, origin)
    return (points if include_nan else points.filter(v.is_finite("x", "y", "z"))).select(*CELL, "x", "y", "z")


def dem_to_mesh(cells: DataFrame, x=None, y=None, resolution: float = 1.0, origin=(0.0, 0.0), include_nan: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (raster, vertex, x, y, z) of the cells in use, and faces (raster, a, b, c): two triangles for each quad of finite corners.

    A quad finds its corners by lead along rows and columns; vertices are numbered in the
    order of rows and columns.
    """
    from stratawave.operators.order import positions

    points = dem_grid_to_points(cells, x, y, resolution, origin)
    good = F.lit(True) if include_nan else v.is_finite("x", "y", "z")
    along = Window.partitionBy("raster", "row").orderBy("col")
    down = Window.partitionBy("raster", "col").orderBy("row")
    marked = points.withColumn("good", good).withColumn("east", F.lead("good").over(along) & (F.lead("col").over(along) == F.col("col") + 1))
    pair = F.col("good") & F.coalesce("east", F.lit(False))
    quads = marked.withColumn("pair", pair).withColumn("below", F.lead("pair").over(down) & (F.lead("row").over(down) == F.col("row") + 1)).filter(F.col("pair") & F.col("below"))
    corner = lambda dr, dc: F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"))
    used = quads.select("raster", F.explode(F.array(*(corner(*d) for d in ((0, 0), (0, 1), (1, 0), (1, 1))))).alias("k")).select("raster", "k.row", "k.col").distinct()
    numbered = cut(positions(used, ["raster"], ["row", "col"], "vertex"))
    n, p = numbered.alias("n"), points.alias("p")
    vertices = n.join(p, same("n", "p", CELL)).select("n.raster", "n.vertex", "p.x", "p.y", "p.z")
    faces = quads.select("raster", F.posexplode(F.array(F.array(corner(0, 0), corner(0, 1), corner(1, 0)), F.array(corner(0, 1), corner(1, 1), corner(1, 0)))).alias("half", "face"), "row", "col")
    for i, c in enumerate("abc"):
        f = faces.withColumn("k", F.get("face", F.lit(i))).alias("f")
        faces = f.join(n, same("f", "n", KEY) & (F.col("f.k.row") == F.col("n.row")) & (F.col("f.k.col") == F.col("n.col"))).select("f.*", F.col("n.vertex").alias(c)).drop("k")
    return vertices, faces.select("raster", "row", "col", "half", "a", "b", "c")


def write_dem_cache(cells: DataFrame, path: str) -> None:
    """Rasters as Parquet, one folder for each, sorted by row and column."""
    cells.repartition("raster").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("raster").parquet(path)


def read_dem_cache(spark, path: str, name: str | None = None) -> DataFrame:
    cells = spark.read.parquet(path)
    return cells if name is None else cells.filter(F.col("raster") == name)
