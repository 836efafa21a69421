"""Boxes on pages: grids, labels, crops, and grouping by nearness."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of page furniture.
CHROME = ("nav_item", "header", "footer", "sidebar", "advertisement", "breadcrumb", "pagination")


def grid_boxes(pages: DataFrame, key: str, width: str, height: str, columns: int = 3, margin: int = 20, top: int = 80, ratio: float = 0.8, most: int = 50) -> DataFrame:
    """A grid of cells in place of segmentation: key, x, y, width, height, confidence 0.5.

    Rows are laid while they end above the lower margin and fewer than `most` boxes lie in those before.
    """
    cell_w = F.floor((F.col(width) - 2 * margin) / columns).cast("int")
    rows = pages.select(key, F.col(height).alias("page_height"), cell_w.alias("cw")).withColumn("ch", F.floor(F.col("cw") * ratio).cast("int"))
    fitting = F.floor((F.col("page_height") - margin - (margin + top) - 1) / F.nullif(F.col("ch"), F.lit(0))).cast("int")
    n = F.least(F.greatest(F.coalesce(fitting, F.lit(0)), F.lit(0)), F.lit(-(-most // columns)))
    cells = rows.where((n > 0) & (F.col("cw") > 0)).select(key, "cw", "ch", F.explode(F.sequence(F.lit(0), n - 1)).alias("row"))
    cells = cells.select("*", F.explode(F.array(*[F.lit(c) for c in range(columns)])).alias("column"))
    return cells.select(
        key, (margin + F.col("column") * F.col("cw")).alias("x"), (margin + top + F.col("row") * F.col("ch")).alias("y"),
        (F.col("cw") - margin).alias("width"), (F.col("ch") - margin).alias("height"), F.lit(0.5).alias("confidence"),
    )


def largest(boxes: DataFrame, key: str, order: list, most: int = 50) -> DataFrame:
    w = Window.partitionBy(key).orderBy((F.col("width") * F.col("height")).desc(), *order)
    return boxes.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= most).drop("__place")


def box_label(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """What a region is by its place and shape; the first rule that holds. Labels and bounds, in order."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    ry, rx, rw, rh = share(y, page_h), share(x, page_w), share(w, page_w), share(h, page_h)
    aspect = F.coalesce(F.try_divide(w.cast("double"), h.cast("double")), F.lit(1.0))
    inside = lambda v, lo, hi: (v > lo) & (v < hi)
    return (
        F.when((ry < 0.10) & (rw > 0.5), "header")
        .when((ry > 0.85) & (rw > 0.5), "footer")
        .when((rw < 0.25) & (rh > 0.3) & ((rx < 0.15) | (rx > 0.75)), "sidebar")
        .when((ry < 0.15) & (rh < 0.05), "nav_item")
        .when(inside(rw, 0.15, 0.5) & inside(rh, 0.1, 0.5) & inside(aspect, 0.5, 2.0), "product_card")
        .when((rw < 0.2) & (rh < 0.05) & (aspect > 2), "price_tag")
        .when(inside(rw, 0.1, 0.4) & inside(aspect, 0.8, 1.2), "product_image")
        .when((rw > 0.6) & (rh < 0.05), "table_row")
        .when((rw > 0.4) & inside(rh, 0.05, 0.2), "description_text")
        .when(inside(rw, 0.2, 0.8) & (rh < 0.06), "list_item")
        .otherwise("unknown")
    )


def content_only(boxes: DataFrame, label: str = "label", confidence: str = "confidence", least: float = 0.3) -> DataFrame:
    return boxes.where((F.col(confidence) >= least) & ~F.col(label).isin(*CHROME))


def crops(boxes: DataFrame, page_w: str, page_h: str, padding: int = 10, smallest: int = 10) -> DataFrame:
    """Padded corners x1, y1, x2, y2 within the page; crops under 10 pixels either way go."""
    out = boxes.withColumns({
        "x1": F.greatest(F.lit(0), F.col("x") - padding), "y1": F.greatest(F.lit(0), F.col("y") - padding),
        "x2": F.least(F.col(page_w), F.col("x") + F.col("width") + padding), "y2": F.least(F.col(page_h), F.col("y") + F.col("height") + padding),
    })
    return out.where((F.col("x2") - F.col("x1") >= smallest) & (F.col("y2") - F.col("y1") >= smallest))


def box_distance(a: str, b: str) -> Column:
    """Least distance of two boxes whose columns have prefixes a and b."""
    gap = lambda lo, size: F.greatest(F.lit(0), F.col(b + lo) - F.col(a + lo) - F.col(a + size), F.col(a + lo) - F.col(b + lo) - F.col(b + size))
    return F.sqrt((F.pow(gap("x", "width"), F.lit(2)) + F.pow(gap("y", "height"), F.lit(2))).cast("double"))


def near_pairs(boxes: DataFrame, key: str, order: str, threshold: float = 50.0) -> DataFrame:
    """key, i, j: the boxes of a page within `threshold` of each other, i before j in order.

    Boxes lie on a grid of cells of the threshold's width, or of the page's mean box size if that is more; two boxes are
    compared where one, widened by the threshold, shares a cell with the other, and only in the first such cell.
    """
    size = boxes.groupBy(key).agg(F.greatest(F.lit(float(threshold)), F.lit(1.0), F.avg(F.greatest("width", "height").cast("double"))).alias("cell")).withColumnRenamed(key, "__page")
    rows = boxes.join(size, F.col(key).eqNullSafe(F.col("__page"))).select(key, F.col(order).alias("o"), "x", "y", "width", "height", "cell")
    at = lambda v: F.floor(v / F.col("cell")).cast("int")

    def on_grid(side: str, wide: float) -> DataFrame:
        span = lambda p, n: (at(F.col(p) - wide), at(F.col(p) + F.col(n) + wide))
        (x0, x1), (y0, y1) = span("x", "width"), span("y", "height")
        cells = rows.withColumn("cx", F.explode(F.sequence(x0, x1))).withColumn("cy", F.explode(F.sequence(y0, y1)))
        return cells.select(*[F.col(c).alias(f"{side}_{c}") for c in ("o", "x", "y", "width", "height", "cx", "cy", "cell")], F.col(key).alias(f"{side}_key"), x0.alias(f"{side}_x0"), y0.alias(f"{side}_y0"))

    a, b = on_grid("a", float(threshold)), on_grid("b", 0.0)
    met = a.join(b, F.col("a_key").eqNullSafe(F.col("b_key")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & (F.col("a_o") < F.col("b_o")))
    first = (F.col("a_cx") == F.greatest("a_x0", "b_x0")) & (F.col("a_cy") == F.greatest("a_y0", "b_y0"))
    near = met.where(first & (box_distance("a_", "b_") <= threshold))
    return near.select(F.col("a_key").alias(key), F.col("a_o").alias("i"), F.col("b_o").alias("j"))


def group_by_nearness(boxes: DataFrame, key: str, order: str, threshold: float = 50.0) -> DataFrame:
    """Greedy groups of a page's boxes: each box not yet taken opens a group and takes all later ones near it. key, order, grp.

    Pairs come from near_pairs(); the fold in order sees a page's boxes and its near pairs, not all pairs.
    """
    pairs = near_pairs(boxes, key, order, threshold).groupBy(key, "j").agg(F.array_sort(F.collect_list("i")).alias("before"))
    pairs = pairs.select(F.col(key).alias("__page"), "j", "before")
    rows = boxes.select(key, order).join(pairs, F.col(key).eqNullSafe(F.col("__page")) & (F.col(order) == F.col("j")), "left").select(key, order, "before")

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(order, ignore_index=True)
        opened: dict = {}  # the group that a box has opened
        group = []
        for box, before in zip(page[order], page["before"], strict=True):
            own = next((opened[i] for i in (before if before is not None else ()) if i in opened), None)
            if own is None:
                own = opened[box] = len(opened)
            group.append(own)
        return page[[key, order]].assign(grp=group)

    schema = f"{key} {boxes.schema[key].dataType.simpleString()}, {order} {boxes.schema[order].dataType.simpleString()}, grp int"
    return rows.groupBy(key).applyInPandas(fold, schema)


def assemble(grouped: DataFrame, key: str, label: str, value: str, order: str) -> DataFrame:
    """One entity a group: map of label to value, the last of a label in order."""
    last = grouped.groupBy(key, "grp", label).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(key, "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "v")))).alias("entity"))
