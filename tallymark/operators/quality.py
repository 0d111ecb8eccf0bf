"""Scan quality: metrics of pixel arrays, flags from metrics, and the image steps that need no library."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def flags(df: DataFrame, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """``is_blurry, is_skewed, is_low_dpi, warnings`` from ``blur, skew, dpi``."""
    blurry, skewed, low = F.col("blur") < cfg.min_blur, F.abs("skew") > cfg.max_skew, F.col("dpi") < cfg.min_dpi
    note = lambda cond, text: F.when(cond, F.lit(text))
    return df.withColumn("is_blurry", blurry).withColumn("is_skewed", skewed).withColumn("is_low_dpi", low).withColumn("warnings", F.array_compact(F.array(note(blurry, "blurry"), note(skewed, "skewed"), note(low, "low resolution"))))


def decode(content: bytes) -> np.ndarray:
    """Grey levels of a PNG (8-bit grey, RGB or RGBA, not interlaced) or binary PGM; empty for anything else."""
    try:
        if content[:2] == b"P5":
            head = content.split(maxsplit=4)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(content[len(content) - w * h :], np.uint8).reshape(h, w).astype(float)
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            at, data, size = 8, [], None
            while at < len(content):
                n, kind = struct.unpack(">I4s", content[at : at + 8])
                body = content[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
                    size = {0: 1, 2: 3, 6: 4}[colour] if depth == 8 and not lace else None
                elif kind == b"IDAT":
                    data.append(body)
                at += 12 + n
            raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * size)
            out = np.zeros((h, w * size), np.int64)
            for y in range(h):
                kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
                up = out[y - 1] if y else np.zeros(w * size, np.int64)
                if kind == 0:
                    out[y] = line
                elif kind == 2:
                    out[y] = (line + up) & 255
                else:
                    for x in range(w * size):
                        a, b, c = (out[y, x - size] if x >= size else 0), up[x], (up[x - size] if x >= size else 0)
                        if kind == 4:
                            p = a + b - c
                            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                        out[y, x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else best)) & 255
            px = out.reshape(h, w, size).astype(float)
            return px[:, :, 0] if size == 1 else px[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    except Exception:  # an unreadable image has no pixels
        pass
    return np.zeros((0, 0))


def blur(px: np.ndarray) -> float:
    """Variance of the Laplacian, mirrored at the edges; 0 for an empty image."""
    if px.size == 0:
        return 0.0
    p = np.pad(px, 1, mode="reflect" if min(px.shape) > 1 else "edge")
    return round(float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var()), 2)


def otsu(px: np.ndarray) -> int:
    """The grey level that best parts dark from light."""
    n = np.bincount(px.astype(np.uint8).ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(px: np.ndarray) -> float:
    """Degrees in (-45, 45] of the smallest rectangle round the dark pixels; 0 for fewer than 100."""
    if px.size == 0:
        return 0.0
    ys, xs = np.nonzero(px <= otsu(px))
    if len(xs) < 100:
        return 0.0
    pts = np.unique(np.stack((xs, ys), 1), axis=0)

    def half(p):
        out = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(half(pts) + half(pts[::-1]), float)
    if len(hull) < 3:
        return 0.0
    angles = np.unique(np.mod(np.arctan2(*(np.roll(hull, -1, 0) - hull).T[::-1]), np.pi / 2))
    area = lambda a: np.ptp(hull @ (np.cos(a), np.sin(a))) * np.ptp(hull @ (-np.sin(a), np.cos(a)))
    best = np.degrees(min(angles, key=area))
    return round(float(best - 90 if best > 45 else best), 2)


def measure(images: DataFrame, dpi: int = 200) -> DataFrame:
    """``case_id, doc_id, blur, skew, dpi, width, height`` of image bytes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for case, doc, content in zip(pdf.case_id, pdf.doc_id, pdf.content):
                px = decode(content)
                rows.append((case, doc, blur(px), skew(px), dpi, px.shape[1], px.shape[0]))
            yield pd.DataFrame(rows, columns=["case_id", "doc_id", "blur", "skew", "dpi", "width", "height"])

    return images.select("case_id", "doc_id", "content").mapInPandas(run, "case_id string, doc_id string, blur double, skew double, dpi int, width int, height int")


# --- steps on pixel arrays --------------------------------------------------------------------------------------------


def rotate(px: np.ndarray, angle: float) -> np.ndarray:
    """Turned by ``angle`` degrees about its centre, nearest neighbour; under half a degree unchanged."""
    if abs(angle) < 0.5 or px.size == 0:
        return px
    h, w = px.shape
    a = np.radians(angle)
    y, x = np.mgrid[:h, :w]
    dx, dy = x - w / 2, y - h / 2
    sx, sy = np.rint(np.cos(a) * dx - np.sin(a) * dy + w / 2).astype(int), np.rint(np.sin(a) * dx + np.cos(a) * dy + h / 2).astype(int)
    return px[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)]


def threshold(px: np.ndarray) -> np.ndarray:
    return np.where(px <= otsu(px), 0.0, 255.0) if px.size else px


def equalise(px: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation by tiles."""
    out = px.copy()
    for rows in np.array_split(np.arange(px.shape[0]), grid):
        for cols in np.array_split(np.arange(px.shape[1]), grid):
            if not len(rows) or not len(cols):
                continue
            tile = px[np.ix_(rows, cols)].astype(np.uint8)
            n = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, clip * tile.size / 256)
            n = np.minimum(n, most) + np.maximum(n - most, 0).sum() / 256
            out[np.ix_(rows, cols)] = (np.cumsum(n) * 255 / n.sum())[tile]
    return out


def upscale(px: np.ndarray, scale: int = 2) -> np.ndarray:
    """Enlarged, then sharpened against its own blur."""
    big = np.kron(px, np.ones((scale, scale)))
    p = np.pad(big, 1, mode="edge")
    soft = sum(p[a : a + big.shape[0], b : b + big.shape[1]] for a in range(3) for b in range(3)) / 9
    return np.clip(1.5 * big - 0.5 * soft, 0, 255)


def crop(px: np.ndarray, x: int, y: int, w: int, h: int, padding: int = 15) -> np.ndarray:
    return px[max(0, y - padding) : y + h + padding, max(0, x - padding) : x + w + padding]


def as_pgm(px: np.ndarray) -> bytes:
    out = io.BytesIO()
    out.write(f"P5 {px.shape[1]} {px.shape[0]} 255\n".encode())
    out.write(np.clip(px, 0, 255).astype(np.uint8).tobytes())
    return out.getvalue()


def pill(conf: Column) -> Column:
    """Confidence band for display."""
    return F.when(conf * 100 >= 80, "high").when(conf * 100 >= 60, "medium").otherwise("low")
