"""Pixel statistics of decoded images, one narrow row per image.

Images are independent rows. Python sees Arrow batches of bounded size (see
``batches.small_batches``) and reads the pixels where they lie, one image at a
time; all scoring on top of the returned numbers is column expressions.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.operators.batches import small_batches

# Inclusive (H, S, V) bounds of the colour masks, H in 0..180.
MASKS = {
    "smoke": ((0, 0, 150), (180, 50, 255)),
    "brown": ((10, 50, 50), (20, 255, 200)),
    "dark": ((0, 0, 0), (180, 255, 80)),
    "green": ((35, 40, 40), (85, 255, 255)),
    "bare": ((5, 30, 80), (30, 200, 220)),
}
EDGE_LOW, EDGE_HIGH = 50, 150
ENTROPY_TINY = 1e-9
DIAGONAL = np.tan(np.pi / 8)   # slope below which a gradient counts as straight

FEATURE_SCHEMA = ("image_id string, height int, width int, smoke_ratio double, brown_ratio double, "
                  "dark_ratio double, waste_ratio double, green_ratio double, bare_ratio double, "
                  "laplacian_var double, gray_std double, edge_density double, entropy double")
REGION_SCHEMA = "image_id string, issue string, x int, y int, w int, h int, area int"

# Mask and smallest reported region of each issue.
REGION_RULES = {
    "Smoke / Air Pollution": ("smoke", 500),
    "Garbage / Illegal Dumping": ("waste", 300),
    "Deforestation / Vegetation Loss": ("bare", 500),
}


def to_hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit hue (halved to 0..180), saturation and value planes."""
    b, g, r = np.moveaxis(bgr, 2, 0).astype("float64", order="C")
    value = np.maximum(np.maximum(b, g), r)
    delta = value - np.minimum(np.minimum(b, g), r)
    safe = np.where(delta > 0, delta, 1.0)
    hue = np.where(value == r, (g - b) / safe, np.where(value == g, 2.0 + (b - r) / safe, 4.0 + (r - g) / safe)) * 30.0
    hue = np.where(delta > 0, np.where(hue < 0, hue + 180.0, hue), 0.0)
    saturation = 255.0 * delta / np.maximum(value, 1.0)
    return np.floor(hue + 0.5), np.floor(saturation + 0.5), value


def to_gray(bgr: np.ndarray) -> np.ndarray:
    weights = np.array([0.114, 0.587, 0.299])
    return np.floor(bgr.astype("float64") @ weights + 0.5)


def colour_masks(bgr: np.ndarray) -> dict[str, np.ndarray]:
    planes = to_hsv(bgr)
    def inside(low, high):
        out = np.ones(bgr.shape[:2], dtype=bool)
        for plane, lo, hi, top in zip(planes, low, high, (180, 255, 255)):
            if lo > 0:
                out &= plane >= lo
            if hi < top:
                out &= plane <= hi
        return out
    out = {name: inside(*bounds) for name, bounds in MASKS.items()}
    out["waste"] = out["brown"] | out["dark"]
    return out


def _border(gray: np.ndarray, mode: str) -> np.ndarray:
    """One pixel of padding; a side of length one cannot be reflected."""
    pad = [(1, 1), (1, 1)]
    return np.pad(gray, pad, mode=mode if min(gray.shape) > 1 else "edge")


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = _border(gray, "reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4.0 * gray


def edges(gray: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Edge mask: 3×3 gradient, thinning along its direction, two thresholds."""
    p = _border(gray, "edge")
    across = lambda q: q[:-2] + 2 * q[1:-1] + q[2:]
    dx = across(p)[:, 2:] - across(p)[:, :-2]
    dy = across(p.T).T[2:, :] - across(p.T).T[:-2, :]
    size = np.abs(dx) + np.abs(dy)
    framed = np.pad(size, 1)
    # Only pixels above the low threshold are compared with their two neighbours.
    y, x = np.nonzero(size > low)
    ax, ay = np.abs(dx[y, x]), np.abs(dy[y, x])
    flat, steep = ay < ax * DIAGONAL, ax < ay * DIAGONAL
    step_y = np.where(flat, 0, 1)
    step_x = np.where(flat, 1, np.where(steep, 0, np.where(dx[y, x] * dy[y, x] > 0, 1, -1)))
    here = size[y, x]
    peak = (here > framed[y + 1 - step_y, x + 1 - step_x]) & (here >= framed[y + 1 + step_y, x + 1 + step_x])
    thin = np.zeros(size.shape, dtype=bool)
    thin[y[peak], x[peak]] = True
    weak, strong = thin, thin & (size > high)
    if not strong.any():
        return strong
    labels, count = label_regions(weak)
    kept = np.zeros(count + 1, dtype=bool)
    kept[labels[strong]] = True
    kept[0] = False
    return kept[labels]


def entropy(gray: np.ndarray) -> float:
    share = np.bincount(gray.astype("int64").ravel(), minlength=256) / gray.size
    return float(-(share * np.log2(share + ENTROPY_TINY)).sum())


def label_regions(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected labels 1..n: runs per row, linked to the touching runs above."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    stop = np.nonzero(change == -1)[1]
    # Runs of the row above that touch a run form one index range of the sorted runs.
    stride = width + 2
    above = (row - 1) * stride
    first = np.searchsorted(row * stride + stop, above + start, side="left")
    beyond = np.searchsorted(row * stride + start, above + stop, side="right")
    links = np.maximum(beyond - first, 0)
    lower = np.repeat(np.arange(len(row)), links)
    upper = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
    # Hook the larger label under the smaller one and shorten the chains until all links agree.
    parent = np.arange(len(row))
    while (parent[lower] != parent[upper]).any():
        one, two = parent[lower], parent[upper]
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    names, number = np.unique(parent, return_inverse=True)
    labels = np.zeros((height, width + 1), dtype=np.int64)
    np.add.at(labels, (row, start), number + 1)
    np.add.at(labels, (row, stop), -(number + 1))
    return np.cumsum(labels, axis=1)[:, :width], len(names)


def regions(mask: np.ndarray, larger_than: int) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of each region above the size."""
    labels, count = label_regions(mask)
    ys, xs = np.nonzero(labels)
    which = labels[ys, xs]
    area = np.bincount(which, minlength=count + 1)
    low_x = np.full(count + 1, mask.shape[1]); high_x = np.full(count + 1, -1)
    low_y = np.full(count + 1, mask.shape[0]); high_y = np.full(count + 1, -1)
    np.minimum.at(low_x, which, xs); np.maximum.at(high_x, which, xs)
    np.minimum.at(low_y, which, ys); np.maximum.at(high_y, which, ys)
    return [(int(low_x[k]), int(low_y[k]), int(high_x[k] - low_x[k] + 1), int(high_y[k] - low_y[k] + 1), int(area[k]))
            for k in range(1, count + 1) if area[k] > larger_than]


def decode(height: int, width: int, channels: int, data) -> np.ndarray:
    """BGR pixels of an image row: grey is repeated, an alpha channel dropped."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., :3]


def _statistics(image_id: str, bgr: np.ndarray) -> tuple:
    masks = colour_masks(bgr)
    gray = to_gray(bgr)
    share = {name: float(m.mean()) for name, m in masks.items()}
    return (image_id, bgr.shape[0], bgr.shape[1], share["smoke"], share["brown"], share["dark"],
            share["waste"], share["green"], share["bare"], float(laplacian(gray).var()),
            float(gray.std()), float(edges(gray).mean()), entropy(gray))


def readable() -> Column:
    return F.coalesce(F.col("image.height") > 0, F.lit(False))


def _image_columns(images: DataFrame) -> DataFrame:
    """Images as flat columns."""
    return small_batches(images).select(
        F.col("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")


def _per_image(images: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows of each image; ``rows_of`` gets no pixels for an image that can't be read."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data = batch.column(4)
            for at, (image_id, height, *shape) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:4]])):
                bgr = decode(height, *shape, data[at].as_buffer()) if height is not None and height > 0 else None
                out.extend(rows_of(image_id, bgr))
            if out:
                columns = [pa.array(values, type=f.type) for values, f in zip(zip(*out), fields)]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return _image_columns(images).mapInArrow(run, schema)


def image_features(images: DataFrame, unreadable: bool = False) -> DataFrame:
    """All colour, sharpness, edge and texture statistics in one pass.

    With ``unreadable``, an image that can't be read is a row whose statistics are null.
    """
    nothing = (None,) * FEATURE_SCHEMA.count(",")
    return _per_image(images if unreadable else images.where(readable()), FEATURE_SCHEMA,
                      lambda i, bgr: [(i, *nothing) if bgr is None else _statistics(i, bgr)])


def image_regions(images: DataFrame, rules: dict = REGION_RULES) -> DataFrame:
    """One row per reported region of each image and issue."""
    def rows_of(image_id, bgr):
        masks = colour_masks(bgr)
        return [(image_id, issue, *box) for issue, (mask, least) in rules.items()
                for box in regions(masks[mask], least)]
    return _per_image(images.where(readable()), REGION_SCHEMA, rows_of)
