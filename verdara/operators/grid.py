"""The analytical grid of an area of interest: one lattice for all observations of an analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.functions import projection
from verdara.functions.geo import let, utm_epsg
from verdara.operators import spatial
from verdara.session import spread

SCHEMA_VERSION = "1.0.0"


def six_digits(x: Column) -> Column:
    """A number's text with six significant digits, without trailing zeros, as C's %g writes it.

    Whole numbers of six digits and zeros, as a lattice's edges mostly are, are cut from their digits; any other is formatted.
    """
    x = x.cast("double")
    size = F.abs(x)
    digits, sign = F.floor(size).cast("string"), F.when(x < 0, "-").otherwise("")
    more = F.length(digits) - 6
    exact = (x == F.floor(x)) & (size < 1e15) & ((more <= 0) | (size % F.pow(F.lit(10.0), more) == 0))
    mantissa = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5)), r"\.?0*$", "")
    power = F.lpad((more + 5).cast("string"), 2, "0")
    other = let(F.struct(x.alias("x"), F.format_string("%.5e", x).alias("short")), lambda s: _six_digits(s["x"], s["short"]))
    return F.when(exact & (more <= 0), F.concat(sign, digits)).when(exact, F.concat(sign, mantissa, F.lit("e+"), power)).otherwise(other)


def _six_digits(x: Column, short: Column) -> Column:
    power = F.regexp_extract(short, r"e([+-]\d+)$", 1).cast("int")
    plain = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa, exponent = plain(F.regexp_extract(short, r"^(.*)e", 1)), F.regexp_extract(short, r"(e[+-]\d+)$", 1)
    fixed = plain(F.format_string("%.10f", F.round(x, 10)))
    return F.when(x == 0, "0").when((power < -4) | (power >= 6), F.concat(mantissa, exponent)).otherwise(fixed)


def signature(epsg: Column, width: Column, height: Column, transform: Sequence[Column]) -> Column:
    """Two grids are one if their signatures are."""
    numbers = F.array_join(F.array(*map(six_digits, transform)), ",")
    return F.concat(F.lit("EPSG:"), epsg.cast("string"), F.lit(":"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":"), numbers)


def canonical_grids(areas: DataFrame, ring: str = "ring", resolution: float = 10.0) -> DataFrame:
    """Adds epsg, resolution, left, bottom, right, top, width, height, transform, bounds_geographic, signature and
    problem to areas with a ring in degrees.

    The ring is projected to its centre's UTM zone and its bounds are moved outward to the lattice through the
    zone's origin, so that areas of one zone share their cells. All of it is arithmetic within a row, much of it, so
    the areas are spread over the tasks first. What isn't done for each corner of the ring stays out of lambdas, as Spark
    compiles columns and walks through lambdas node by node.
    """
    centre = let(projection.ring_middle(F.col(ring)), lambda c: utm_epsg(c["x"], c["y"]))
    snapped = lambda v, snap: (snap(v / resolution) * resolution).cast("double")

    def bounds(flat: Column) -> Column:
        at = lambda k, pick: pick(F.transform(flat, lambda p: p[k]))
        edges = {"left": snapped(at("x", F.array_min), F.floor), "bottom": snapped(at("y", F.array_min), F.floor), "right": snapped(at("x", F.array_max), F.ceil), "top": snapped(at("y", F.array_max), F.ceil)}
        return F.struct(*[v.alias(k) for k, v in edges.items()])

    out = spread(areas).withColumn("epsg", centre).withColumn("_box", let(projection.ring_utm(F.col(ring), F.col("epsg")), bounds))
    cells = lambda a, b: F.round((F.col(b) - F.col(a)) / resolution).cast("int")
    step = F.lit(float(resolution))
    out = out.withColumns({k: F.col("_box")[k] for k in ("left", "bottom", "right", "top")})
    affine = [step, F.lit(0.0), F.col("left"), F.lit(0.0), -step, F.col("top")]
    out = out.withColumns({"resolution": step, "width": cells("left", "right"), "height": cells("bottom", "top"), "transform": F.array(*affine)})
    out = projection.with_lonlat(out, ("left", "right"), ("bottom", "top"), F.col("epsg"))
    corners = [f"_{x}_{y}" for x in ("left", "right") for y in ("bottom", "top")]
    span = [pick(*[F.col(f"{c}_{k}") for c in corners]) for pick in (F.least, F.greatest) for k in ("lon", "lat")]
    made = {"bounds_geographic": F.array(*span), "signature": signature(F.col("epsg"), F.col("width"), F.col("height"), affine)}
    made["problem"] = F.coalesce(projection.ring_problem(F.col(ring)), F.when((F.col("width") < 1) | (F.col("height") < 1), "below_one_cell"))
    return out.withColumns(made).drop("_box", *[f"{c}_{k}" for c in corners for k in ("lon", "lat")])


def grid_document(ring: Column) -> Column:
    """The grid's record as it is stored, from the columns of `canonical_grids`."""
    c = F.col
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.concat(F.lit("EPSG:"), c("epsg").cast("string")).alias("crs"), c("epsg").alias("epsg"), F.array("resolution", "resolution").alias("resolution"),
        c("transform").alias("transform"), c("width").alias("width"), c("height").alias("height"), F.array("left", "bottom", "right", "top").alias("bounds_projected"), c("bounds_geographic").alias("bounds_geographic"),
        ring.alias("aoi_geometry_4326"), c("signature").alias("signature"),
    )


def cells(grids: DataFrame, ring: str = "ring") -> DataFrame:
    """row, col, x, y and in_aoi for each cell of each grid; a cell is in when its centre is.

    A row of cells is cut where the ring's sides cross it, once for the whole row, so a cell looks at the few
    crossings of its row instead of all sides.
    """
    flat = grids.withColumn("_flat", projection.ring_utm(F.col(ring), F.col("epsg")))
    rows = flat.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    rows = rows.withColumn("y", F.col("top") - (F.col("row") + 0.5) * F.col("resolution"))
    rows = rows.withColumn("_cuts", projection.crossings(F.col("_flat"), F.col("y"))).drop("_flat")
    out = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    out = out.withColumn("x", F.col("left") + (F.col("col") + 0.5) * F.col("resolution"))
    return out.withColumn("in_aoi", F.size(F.filter("_cuts", lambda v: v > F.col("x"))) % 2 == 1).drop("_cuts")


def granules_on_grid(granules: DataFrame, grids: DataFrame, pad: int = 4) -> DataFrame:
    """Granules (bbox in degrees) beside each grid whose bounds, padded by some cells, they meet."""
    edge, more = F.col("bounds_geographic"), pad * F.col("resolution") / 111_320.0
    box = dict(zip(spatial.BOX, (F.get("bbox", F.lit(k)) for k in range(4)), strict=True))
    padded = dict(zip(spatial.BOX, (edge[0] - more, edge[1] - more, edge[2] + more, edge[3] + more), strict=True))
    return spatial.meeting(granules, grids, box, padded).select("l.*", "r.*")
