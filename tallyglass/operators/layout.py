"""Boxes and text blocks of images. Every join is first an equi-join on the image."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.exprs import half_up

#: Region of a box as shares of it: x from, x to, y from, y to.
REGIONS = {"name": (0.05, 0.95, 0.0, 0.18), "whole": (0.0, 1.0, 0.0, 1.0), "left": (0.0, 0.35, 0.92, 1.0), "right": (0.65, 1.0, 0.92, 1.0)}


def blocks_in_regions(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """``image_id, box_id, name_text, whole_text, number_text, blocks``: texts of blocks whose centre lies in a region of a box, from top to bottom.

    The number comes from the left or the right lower corner: the one with n/m first, else the left, else the right.
    """
    j = boxes.join(blocks, "image_id")
    cx, cy = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    inside = {}
    for name, (x0, x1, y0, y1) in REGIONS.items():
        inside[name] = cx.between(F.col("box_left") + F.col("box_width") * x0, F.col("box_left") + F.col("box_width") * x1) & cy.between(F.col("box_top") + F.col("box_height") * y0, F.col("box_top") + F.col("box_height") * y1)
    item = F.struct("top", "block_id", "text")
    texts = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside[c], item))), lambda x: x["text"]), sep)
    g = j.filter(inside["whole"]).groupBy("image_id", "box_id").agg(texts("name", "\n").alias("name_text"), texts("whole", "\n").alias("whole_text"), texts("left", " ").alias("l"), texts("right", " ").alias("r"), F.count("*").alias("blocks"))
    number = F.when(F.col("l").rlike(r"\d+/\d+"), F.col("l")).when(F.col("r").rlike(r"\d+/\d+"), F.col("r")).when(F.col("l") != "", F.col("l")).otherwise(F.col("r"))
    g = g.select("image_id", "box_id", "name_text", "whole_text", number.alias("number_text"), "blocks")
    keys = boxes.select("image_id", "box_id")
    return keys.join(g, ["image_id", "box_id"], "left").na.fill("", ["name_text", "whole_text", "number_text"]).na.fill(0, ["blocks"])


def merge_region_text(df: DataFrame) -> DataFrame:
    """``raw_text`` of ``name_text, number_text, whole_text, accepted, detected, late_number``: name and number if it has a digit; without a detector only accepted crops, the whole text where the name is empty; a late number only if none is there."""
    digit = F.col("number_text").rlike(r"\d")
    own = F.when(digit, F.concat_ws("\n", "name_text", "number_text")).when(F.col("name_text") != "", F.col("name_text"))
    text = F.when(F.col("detected"), own).when(F.col("accepted"), F.coalesce(own, F.col("whole_text")))
    merged = F.when(F.col("late_number").isNull(), text).when(text.isNull(), F.col("late_number")).when(~text.rlike(r"\d+/\d+"), F.concat_ws("\n", text, "late_number")).otherwise(text)
    return df.withColumn("raw_text", merged)


def pad_and_clamp(boxes: DataFrame, image_width: int, image_height: int, share: float = 0.10) -> DataFrame:
    """Boxes with a margin of a share of the short side, cut to the image; empty ones drop out."""
    m = half_up(F.least("box_width", "box_height") * share).cast("int")
    x, y = F.greatest(F.col("box_left") - m, F.lit(0)), F.greatest(F.col("box_top") - m, F.lit(0))
    b = boxes.withColumns({"x": x, "y": y, "w": F.least(F.lit(image_width) - x, F.col("box_width") + 2 * m), "h": F.least(F.lit(image_height) - y, F.col("box_height") + 2 * m)})
    return b.filter("w > 0 AND h > 0")


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    inter = w * h
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / (area(a) + area(b) - inter))


def nms(boxes: DataFrame, tie: list[str], confidence: float = 0.25, overlap: float = 0.45) -> DataFrame:
    """Greedy suppression per image, surest first: a box stays if it overlaps no kept one by more than ``overlap``. ``boxes(image_id, x1, y1, x2, y2, confidence, ..tie)``."""
    item = F.struct((-F.col("confidence")).alias("c"), *tie, "x1", "y1", "x2", "y2")
    g = boxes.filter(F.col("confidence") >= confidence).groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("b"))
    kept = F.aggregate("b", F.slice("b", 1, 0), lambda k, x: F.when(F.forall(k, lambda y: iou(x, y) <= overlap), F.concat(k, F.array(x))).otherwise(k))
    return g.select("image_id", F.explode(kept).alias("x")).select("image_id", *[F.col(f"x.{t}") for t in tie], (-F.col("x.c")).alias("confidence"), "x.x1", "x.y1", "x.x2", "x.y2")


def filter_and_order(boxes: DataFrame, image_width: int, image_height: int, tie: list[str], least: float = 0.01, most: int = 20) -> DataFrame:
    """Boxes of at least a share of the image by row band (a quarter of the height), then from the left; the first ``most`` with their place."""
    band = F.floor(F.col("box_top") / max(1, int(image_height * 0.25)))
    b = boxes.filter(F.col("box_width") * F.col("box_height") >= least * image_width * image_height).withColumn("band", band)
    return b.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("band", "box_left", *tie))).filter(F.col("place") <= most)


def best_box(boxes: DataFrame, tie: list[str]) -> DataFrame:
    """One box per image: the largest product of area and confidence; the smallest tie key at equality."""
    score = F.col("box_width") * F.col("box_height") * F.col("confidence")
    fields = [c for c in boxes.columns if c != "image_id"]
    return boxes.groupBy("image_id").agg(F.min_by(F.struct(*fields), F.struct((-F.round(score, 6)).alias("s"), *tie)).alias("b")).select("image_id", "b.*")


#: Most columns and rows of an image's grid.
GRID = 64


def overlapping(boxes: DataFrame) -> DataFrame:
    """``image_id, z, o_z, area``: the pairs of boxes of an image, later ones second, that share an area, each once.

    An image is cut into a grid whose cells are about as large as its boxes. A box is put into each cell that it touches, and boxes meet in a cell; the
    pair is kept only in the cell of the left upper corner of what they share. So a crowded image's boxes meet their neighbours only, in as many tasks as it has cells.
    """
    size = lambda lo, hi: F.greatest(F.avg(F.col(hi) - F.col(lo)), (F.max(hi) - F.min(lo)) / GRID, F.lit(1e-6))
    grid = boxes.groupBy("image_id").agg(size("x1", "x2").alias("gw"), size("y1", "y2").alias("gh"), F.min("x1").alias("gx"), F.min("y1").alias("gy"))
    real = boxes.filter("x2 > x1 AND y2 > y1").join(grid, "image_id")
    at = lambda v, lo, step: F.floor((v - F.col(lo)) / F.col(step))
    cells = lambda lo, hi, g, step: F.explode(F.sequence(at(F.col(lo), g, step), at(F.col(hi), g, step)))
    put = real.withColumn("cx", cells("x1", "x2", "gx", "gw")).withColumn("cy", cells("y1", "y2", "gy", "gh"))
    later = put.select("image_id", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("z", "x1", "y1", "x2", "y2")])
    left, upper = F.greatest("x1", "o_x1"), F.greatest("y1", "o_y1")
    w, h = F.least("x2", "o_x2") - left, F.least("y2", "o_y2") - upper
    j = put.join(later, ["image_id", "cx", "cy"]).filter((F.col("o_z") > F.col("z")) & (w > 0) & (h > 0))
    return j.filter((at(left, "gx", "gw") == F.col("cx")) & (at(upper, "gy", "gh") == F.col("cy"))).select("image_id", "z", "o_z", (w * h).alias("area"))


#: Boxes up to which an image is one task's; those of fuller images meet in the cells of a grid.
CROWDED = 4096


def _covered_areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by image and z: the rows with ``covered``, the areas that later boxes of the image share with those of a row's z, added up.

    Whole images are worked on, many at a time; an image that a batch cuts goes on with the next one.
    """

    def differs(t: pa.Table, column: str) -> np.ndarray:
        """Whether a row's value is another than that of the row before it."""
        c = t.column(column)
        return np.append(True, pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy())

    def covered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        first = differs(t, "image_id")
        starts, ties = np.flatnonzero(first), np.flatnonzero(first | differs(t, "z"))
        sizes = np.diff(np.append(ties, len(t)))
        end, later = np.append(starts[1:], len(t))[np.cumsum(first) - 1], np.repeat(ties + sizes, sizes)
        x1, y1, x2, y2 = (t.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("x1", "y1", "x2", "y2"))
        real = (x2 > x1) & (y2 > y1)
        sums, own = np.zeros(len(t)), np.flatnonzero(real & (later < end))
        at = later[own]
        while len(own):  # each row meets the next of its image's later ones
            w, h = np.minimum(x2[own], x2[at]) - np.maximum(x1[own], x1[at]), np.minimum(y2[own], y2[at]) - np.maximum(y1[own], y1[at])
            shared = real[at] & (w > 0) & (h > 0)
            sums[own[shared]] += w[shared] * h[shared]
            at = at + 1
            going = at < end[own]
            own, at = own[going], at[going]
        found = np.repeat(np.add.reduceat(sums, ties), sizes)
        yield from t.append_column("covered", pa.array(found)).to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("image_id")
        last = int(pc.index(ids, ids[-1]).as_py())
        if last == 0 and (not held or held[0].column("image_id")[0] == ids[0]):
            held.append(b)
            continue
        yield from covered([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield from covered(held)


def visible_boxes(boxes: DataFrame, most: float = 0.55) -> DataFrame:
    """Boxes of which later ones (greater z) of the image cover at most a share, overlaps added up. ``boxes(image_id, z, x1, y1, x2, y2)``.

    Boxes are dealt by image once, and those of an image meet where they are; only the boxes of crowded images, whose ids are broadcast, go through the
    grid of :func:`overlapping`.
    """
    placed = boxes.filter("image_id IS NOT NULL AND z IS NOT NULL")
    crowded = F.broadcast(placed.groupBy("image_id").count().filter(F.col("count") > CROWDED).select("image_id"))
    few, many = placed.join(crowded, "image_id", "left_anti").select(boxes.columns), placed.join(crowded, "image_id", "left_semi").select(boxes.columns)
    schema = StructType([*few.schema.fields, StructField("covered", DoubleType())])
    met = few.repartition("image_id").sortWithinPartitions("image_id", "z").mapInArrow(_covered_areas, schema)
    by_grid = overlapping(many).groupBy("image_id", "z").agg(F.sum("area").cast("double").alias("covered"))
    alone = boxes.filter("image_id IS NULL OR z IS NULL").withColumn("covered", F.lit(0.0))
    area = F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1))
    every = met.unionByName(many.join(by_grid, ["image_id", "z"], "left")).unionByName(alone)
    return every.withColumn("covered_share", F.round(F.coalesce("covered", F.lit(0.0)) / area, 6)).filter(F.col("covered_share") <= most).drop("covered")


#: Distances of the passes as shares of the image's short side; bounds of a card's width over height; depth of splits; least share of
#: area; least blocks of a region; regions after which no further pass is made.
PASSES, ASPECT, DEPTH, LEAST, FEWEST, PLENTY = (0.08, 0.15, 0.25, 0.40, 0.60), (0.40, 1.10), 4, 0.008, 2, 3
REGION = "image_id long, place long, left double, top double, width double, height double, text string"


class _Image:
    """The blocks of one image, sorted by (top, left, text): left, top, right, bottom and centres as arrays."""

    def __init__(self, width: float, height: float, frames: np.ndarray, texts: list[str]):
        self.width, self.height, self.texts = width, height, texts
        self.x1, self.y1, self.x2, self.y2 = frames[:, 0], frames[:, 1], frames[:, 0] + frames[:, 2], frames[:, 1] + frames[:, 3]
        self.cx, self.cy = frames[:, 0] + frames[:, 2] / 2, frames[:, 1] + frames[:, 3] / 2

    def distances(self, k: int) -> np.ndarray:
        return np.sqrt((self.cx - self.cx[k]) ** 2 + (self.cy - self.cy[k]) ** 2)

    def bounds(self, own: np.ndarray) -> tuple[float, float, float, float]:
        return float(self.x1[own].min()), float(self.y1[own].min()), float(self.x2[own].max()), float(self.y2[own].max())

    def area(self, own: np.ndarray) -> float:
        x1, y1, x2, y2 = self.bounds(own)
        return (x2 - x1) * (y2 - y1)

    def clusters(self, distance: float) -> list[np.ndarray]:
        """Blocks connected by steps between centres of at most ``distance``, in the order of their first block."""
        name, n = np.full(len(self.cx), -1), 0
        for i in range(len(name)):
            if name[i] >= 0:
                continue
            name[i], todo = n, [i]
            while todo:
                k = todo.pop()
                near = np.flatnonzero((name < 0) & (self.distances(k) <= distance))
                name[near] = n
                todo += near.tolist()
            n += 1
        return [np.flatnonzero(name == k) for k in range(n)]

    def halves(self, own: np.ndarray, across: bool, middle: float) -> tuple[np.ndarray, np.ndarray]:
        low = (self.cx if across else self.cy)[own] <= middle
        return own[low], own[~low]

    def regions(self, own: np.ndarray, depth: int = 0) -> list[np.ndarray]:
        """The cluster if it is shaped like a card, else what its halves give; nothing if it is too small or cannot be halved."""
        if len(own) < FEWEST:
            return []
        x1, y1, x2, y2 = self.bounds(own)
        if (x2 - x1) * (y2 - y1) < LEAST * self.width * self.height:
            return []
        shape = (x2 - x1) / (y2 - y1) if y2 > y1 else np.inf
        if ASPECT[0] <= shape <= ASPECT[1]:
            return [own]
        if depth >= DEPTH or len(own) < 2 * FEWEST:
            return []
        across = shape > ASPECT[1]
        halves = self.halves(own, across, x1 + (x2 - x1) / 2 if across else y1 + (y2 - y1) / 2)
        return [r for h in halves for r in self.regions(h, depth + 1)] if min(map(len, halves)) >= FEWEST else []

    def detect(self) -> list[np.ndarray]:
        best: list[np.ndarray] = []
        short, clusters, before = min(self.width, self.height), [], 0
        for share in PASSES:
            # wider steps only join clusters: as many as before are the same ones, and a single one stays
            if before != 1:
                clusters = self.clusters(share * short)
            if len(clusters) == before:
                continue
            before = len(clusters)
            found = [r for c in clusters for r in self.regions(c)]
            best = found if len(found) > len(best) else best
            if len(best) >= PLENTY:
                break
        if not best:
            whole = [c for c in clusters if len(c) >= FEWEST]
            return [max(whole, key=self.area)] if whole else []
        middle = lambda b: ((b[0] + b[2]) / 2 - self.width / 2) ** 2 + ((b[1] + b[3]) / 2 - self.height / 2) ** 2
        return sorted(best, key=lambda own: middle(self.bounds(own)))


#: Blocks up to which an image is worked on in plain lists.
FEW = 24


class _Few(_Image):
    """An image of few blocks, in plain lists, as array operations would cost far more than the work itself. ``frames`` are (left, top, width, height)."""

    def __init__(self, width: float, height: float, frames: list[list[float]], texts: list[str]):
        self.width, self.height, self.texts = width, height, texts
        self.x1, self.y1 = [f[0] for f in frames], [f[1] for f in frames]
        self.x2, self.y2 = [f[0] + f[2] for f in frames], [f[1] + f[3] for f in frames]
        self.cx, self.cy = [f[0] + f[2] / 2 for f in frames], [f[1] + f[3] / 2 for f in frames]
        at = list(zip(self.cx, self.cy, strict=True))
        self.far = [[math.sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) for x, y in at] for x0, y0 in at]

    def bounds(self, own: list[int]) -> tuple[float, float, float, float]:
        return min([self.x1[k] for k in own]), min([self.y1[k] for k in own]), max([self.x2[k] for k in own]), max([self.y2[k] for k in own])

    def clusters(self, distance: float) -> list[list[int]]:
        left, out = list(range(len(self.cx))), []
        while left:
            own, left = [left[0]], left[1:]
            for k in own:  # grows while it is read
                if not left:
                    break
                far = self.far[k]
                own += [i for i in left if far[i] <= distance]
                left = [i for i in left if not far[i] <= distance]
            out.append(sorted(own))
        return out

    def halves(self, own: list[int], across: bool, middle: float) -> tuple[list[int], list[int]]:
        c = self.cx if across else self.cy
        return [k for k in own if c[k] <= middle], [k for k in own if not c[k] <= middle]


def _cluster_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by image: many images a batch; an image that a batch cuts goes on with the next one."""

    def regions(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sizes = t.column("image_id").to_numpy(), np.stack([t.column(c).to_numpy() for c in ("image_width", "image_height")], axis=1)
        frames, texts = np.stack([t.column(c).to_numpy() for c in ("left", "top", "width", "height")], axis=1), t.column("text").to_pylist()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ends = np.append(starts[1:], len(ids))
        enough = ends - starts >= FEWEST  # the others have no region
        rows, plain = [], frames.tolist()
        for s, e, name, size in zip(starts[enough].tolist(), ends[enough].tolist(), ids[starts[enough]].tolist(), sizes[starts[enough]].tolist(), strict=True):
            image = _Few(*size, plain[s:e], texts[s:e]) if e - s <= FEW else _Image(*size, frames[s:e], texts[s:e])
            for place, own in enumerate(image.detect()):
                x1, y1, x2, y2 = image.bounds(own)
                rows.append((name, place, x1, y1, x2 - x1, y2 - y1, "\n".join([image.texts[k] for k in own])))
        if rows:
            types = [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in REGION.split(", ")])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("image_id").to_numpy()
        last = int(np.searchsorted(ids, ids[-1]))
        if last == 0 and (not held or held[0].column("image_id")[0].as_py() == ids[0]):
            held.append(b)
            continue
        yield from regions(pa.Table.from_batches([*held, b.slice(0, last)]))
        held = [b.slice(last)]
    if held:
        yield from regions(pa.Table.from_batches(held))


def cluster_blocks(blocks: DataFrame) -> DataFrame:
    """Regions of text blocks per image, nearest to the centre first: connected blocks at rising distances, halved where the shape is no card's; the pass with most regions wins.

    Where no pass finds a card's shape, the largest cluster of the widest distance is the region. An image's few blocks are worked on
    together, in the order of (top, left, text); images run in parallel, many to a batch. Blocks without an image or a frame are left out.
    ``blocks(image_id, image_width, image_height, left, top, width, height, text)``.
    """
    numbers = ["image_width", "image_height", "left", "top", "width", "height"]
    b = blocks.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("double").alias(c) for c in numbers], F.coalesce("text", F.lit("")).alias("text")).dropna()
    by_image = b.repartition("image_id").sortWithinPartitions("image_id", "top", "left", "text", "width", "height")
    return by_image.mapInArrow(_cluster_images, REGION)
