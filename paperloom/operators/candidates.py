"""Candidates for a page's number: boxes, position bands, label anchors, crops.

Candidate rows have page columns, an order (item_no or several columns), x0, y0,
x1, y1, digits, and the page's w and h. Bands compare the corner before it is
cut to whole pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import params
from paperloom.functions.text import digits_of
from paperloom.functions.params import Anchor, Band


def bounds(box: Column) -> Column:
    """Struct x0, y0, x1, y1 of an array of points."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bands_table(cands: DataFrame, bands: Sequence[Band]) -> DataFrame:
    rows = [(b.type, b.y_lo, b.y_hi, b.x_min, b.x_max, b.digits_lo, b.digits_hi, i) for i, b in enumerate(bands)]
    return cands.sparkSession.createDataFrame(rows, "b_type string, y_lo double, y_hi double, x_min double, x_max double, digits_lo int, digits_hi int, region int")


def in_bands(cands: DataFrame, bands: Sequence[Band] = params.BANDS) -> DataFrame:
    """Candidates of a column type within a band of that type, with the band's region; the table of bands is a few rows and is broadcast."""
    b = F.broadcast(bands_table(cands, bands))
    height = F.col("y1") - F.col("y0")
    inside = (
        F.col("x0").between(F.col("x_min") * F.col("w"), F.col("x_max") * F.col("w"))
        & F.col("y0").between(F.col("y_lo") * F.col("h"), F.col("y_hi") * F.col("h"))
        & height.between(F.lit(params.MIN_HEIGHT) * F.col("h"), F.lit(params.MAX_HEIGHT) * F.col("h"))
        & F.length("digits").between(F.col("digits_lo"), F.col("digits_hi"))
    )
    return cands.join(b, (F.col("type") == F.col("b_type")) & inside).select(*cands.columns, "region")


def pixel_height() -> Column:
    return F.col("y1").cast("int") - F.col("y0").cast("int")


def ranked(cands: DataFrame, page: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Candidates with their place on the page: tallest first, equals in item order."""
    w = Window.partitionBy(*page).orderBy(pixel_height().desc(), *order)
    return cands.withColumn("place", F.row_number().over(w).cast("long"))


def anchored(cands: DataFrame, labels: DataFrame, page: Sequence[str], anchor: Anchor) -> DataFrame:
    """Candidates on the row of a label (page, ly, lx1) of their page, within the anchor's columns.

    An equi-join on the page with the row as a residual; where the number must stand right of the label, the nearest right edge counts.
    """
    cy = (F.col("y0") + F.col("y1")) / 2
    across = F.col("x0").between(F.lit(anchor.x_min) * F.col("w"), F.lit(anchor.x_max) * F.col("w"))
    l = labels.select(*(F.col(c).alias(f"__{c}") for c in page), "ly", "lx1")
    same = F.lit(True)
    for c in page:
        same = same & (F.col(c) == F.col(f"__{c}"))
    on_row = same & (F.abs(cy - F.col("ly")) <= F.lit(anchor.tolerance) * F.col("h"))
    if anchor.right_of_label:
        on_row = on_row & (F.col("x0") >= F.col("lx1"))
    return cands.where(across).join(l, on_row, "left_semi")


def first_that_finds(first: DataFrame, second: DataFrame, page: Sequence[str]) -> DataFrame:
    """The first's candidates, and the second's for pages where the first has none."""
    return first.unionByName(second.join(first.select(*page).distinct(), list(page), "left_anti"))


def distinct_boxes(cands: DataFrame, page: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One candidate for each box of a page: the first in order."""
    w = Window.partitionBy(*page, "x0", "y0", "x1", "y1").orderBy(*order)
    return cands.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def crop(raster_w: Column, raster_h: Column, w: Column, h: Column) -> Column:
    """Struct cx0, cy0, cx1, cy1 to cut from the large raster: the box with margins, clipped; null if too small."""
    pad_x, pad_y = (F.col("x1") - F.col("x0")) * F.lit(params.PAD), (F.col("y1") - F.col("y0")) * F.lit(params.PAD)
    scaled = lambda v, most: F.least(most, (v * F.lit(params.CROP_SCALE)).cast("int"))
    x0 = scaled(F.greatest(F.lit(0.0), F.col("x0") - pad_x), raster_w)
    y0 = scaled(F.greatest(F.lit(0.0), F.col("y0") - pad_y), raster_h)
    x1 = scaled(F.least(w.cast("double"), F.col("x1") + pad_x), raster_w)
    y1 = scaled(F.least(h.cast("double"), F.col("y1") + pad_y), raster_h)
    big = (x1 - x0 >= params.MIN_CROP[0]) & (y1 - y0 >= params.MIN_CROP[1])
    return F.when(big, F.struct(x0.alias("cx0"), y0.alias("cy0"), x1.alias("cx1"), y1.alias("cy1")))


def tight_crop() -> Column:
    """Struct cx0, cy0, cx1, cy1 of the bare box in the large raster, neither padded nor clipped; null if it is empty."""
    scaled = {c: (F.col(c).cast("int") * F.lit(params.CROP_SCALE)).cast("int") for c in ("x0", "y0", "x1", "y1")}
    return F.when((scaled["x1"] > scaled["x0"]) & (scaled["y1"] > scaled["y0"]), F.struct(*(v.alias(f"c{k}") for k, v in scaled.items())))


def anchored_crop(x: Column, y: Column, width: Column, height: Column, shares: Sequence[Column], raster_w: Column, raster_h: Column) -> Column:
    """Struct cx0, cy0, cx1, cy1 of a field that stands at shares (from x, to x, from y, to y) of an anchor's box, clipped to the raster; null if too small."""
    at = lambda a, b, share: ((a + b * share) * F.lit(params.CROP_SCALE)).cast("int")
    x0, x1 = F.greatest(F.lit(0), at(x, width, shares[0])), F.least(raster_w, at(x, width, shares[1]))
    y0, y1 = F.greatest(F.lit(0), at(y, height, shares[2])), F.least(raster_h, at(y, height, shares[3]))
    big = (x1 - x0 >= params.MIN_CROP[0]) & (y1 - y0 >= params.MIN_CROP[1])
    return F.when(big, F.struct(x0.alias("cx0"), y0.alias("cy0"), x1.alias("cx1"), y1.alias("cy1")))


def zoomed(width: Column, height: Column, zooms: Sequence[float] = params.ZOOMS) -> Column:
    """Array of zoom, zw, zh, smooth: the size of each variant that is read of a crop, with its quiet margin, and whether it is enlarged smoothly or averaged down."""
    size = lambda v, z: (F.rint(v * F.lit(z)) + 2 * params.MARGIN).cast("int")
    return F.array(*(F.struct(F.lit(z).alias("zoom"), size(width, z).alias("zw"), size(height, z).alias("zh"), F.lit(z >= 1).alias("smooth")) for z in zooms))


def column_has_digits(items: DataFrame, page: Sequence[str], column: tuple[float, float, float] = params.FIELD_COLUMN) -> DataFrame:
    """Columns page, written: whether any item (text, x0, y0, w, h) in a field column holds a digit."""
    y_lo, y_hi, x_max = column
    inside = (F.col("x0") <= F.lit(x_max) * F.col("w")) & F.col("y0").between(F.lit(y_lo) * F.col("h"), F.lit(y_hi) * F.col("h"))
    return items.groupBy(*page).agg(F.coalesce(F.bool_or(inside & (digits_of(F.col("text")) != "")), F.lit(False)).alias("written"))


def for_type(cands: DataFrame, labels: DataFrame, page: Sequence[str], order: Sequence[str], bands: Sequence[Band] = params.BANDS, anchors: Sequence[tuple[str, Anchor]] = params.ANCHORS) -> DataFrame:
    """The candidates of pages whose type is known, with region and place: each type by its own rule, all pages at once.

    cands has a column type; types with bands keep what lies in them, a box of two regions once. Types with anchors take the first anchor that finds
    something on the page; labels has (page, marker, ly, lx1). Other types have none.
    """
    found = distinct_boxes(in_bands(cands, bands), page, ["region", *order])
    for kind in dict.fromkeys(k for k, _ in anchors):
        mine = cands.where(F.col("type") == kind)
        chosen = None
        for _, anchor in (a for a in anchors if a[0] == kind):
            some = anchored(mine, labels.where(F.col("marker") == anchor.marker), page, anchor)
            chosen = some if chosen is None else first_that_finds(chosen, some, page)
        found = found.unionByName(chosen.withColumn("region", F.lit(0)))
    return ranked(found, page, ["region", *order])


def readable_shape(width: Column, height: Column) -> Column:
    """Whether the second reader takes a crop: not empty, and not too wide."""
    return (width > 0) & (height > 0) & (width / height <= F.lit(params.MAX_ASPECT))
