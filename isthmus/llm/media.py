"""Media columns: texts stored as progressive JPEG files, and files read back as full-resolution RGB tensors.

`store_media` makes the files, `rgb_tensors` decodes them into tensor columns with features of these bytes, and
`media_features` gives the features alone.

Defined results: a null text is empty; the payload is the UTF-8 text filled with zero bytes to a positive multiple of 64,
so an empty text has one block; equal texts give equal files, payloads, tensors and features; very long texts make one
large picture each; rows are treated one by one, so repeated rows give repeated results; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .jpeg import Image, encode
from .text import per_batch


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text) and media, a JPEG file."""

    def store(ids: list, texts: list) -> dict:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return {"doc_id": ids, "n_bytes": [len(r) for r in raw], "media": [encode(r + bytes(-len(r) % 64 if r else 64)) for r in raw]}

    return per_batch(docs, [doc_id, text], store, "doc_id long, n_bytes long, media binary")


def rgb_tensors(media: DataFrame) -> DataFrame:
    """What each file holds: payload sizes and hashes, its tensor (height, width and pixels, row-major RGB bytes), and a feature of the tensor as stored."""

    def tensors(ids: list, sizes: list, files: list) -> dict:
        out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "height", "width", "pixels", "feature")}
        for f in files:
            image = Image(f)
            payload = image.payload()
            h, w, pixels = image.height, image.width, b"".join(x.tobytes() for x in image.strips())
            stored = np.frombuffer(pixels, np.uint8).reshape(h, w, 3)
            made = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), h, w, pixels, feature(stored))
            for column, x in zip(out.values(), made, strict=True):
                column.append(x)
        return {"doc_id": ids, "n_bytes": sizes} | out

    return per_batch(media, ["doc_id", "n_bytes", "media"], tensors, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, pixels binary, feature string")


def media_features(media: DataFrame) -> DataFrame:
    """Sizes and hashes of the stored files, and the features of their tensors, without the tensors."""
    return rgb_tensors(media).drop("height", "width", "pixels")


def feature(rgb: np.ndarray) -> str:
    """Size, and mean and standard deviation of each colour; from whole-number sums, so exactly repeatable."""
    n = rgb.shape[0] * rgb.shape[1]
    counts = [np.bincount(rgb[:, :, k].ravel(), minlength=256) for k in range(3)]
    level = np.arange(256)
    sums = [(int(c @ level), int(c @ (level * level))) for c in counts]
    mean = [f"{t / n:.4f}" for t, _ in sums]
    spread = [f"{(max(0, s * n - t * t) ** 0.5) / n:.4f}" for t, s in sums]
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean {' '.join(mean)} std {' '.join(spread)}"
