"""Encoders: a protocol, and a deterministic provider that needs neither weights nor a network.

The provider hashes words (or bytes of an image) into a histogram and normalises it. It stands in for a model, so its
relevance says nothing about one.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64


class Encoder(Protocol):
    name: str
    dimension: int

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...

    def encode_images(self, images: list[bytes]) -> np.ndarray: ...


class HistogramEncoder:
    name = "histogram"

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def _fold(self, items: Iterable[list[bytes]], n: int) -> np.ndarray:
        out = np.zeros((n, self.dimension), np.float32)
        for row, words in enumerate(items):
            h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            signs = np.where(h >> np.uint64(63), 1.0, -1.0)
            out[row] = np.bincount((h % np.uint64(self.dimension)).astype(np.int64), signs, self.dimension)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        """All words of a text count, however long it is; the stand-in has no model's limit."""
        return self._fold(([w.encode() for w in re.split(r"[^\w]+", t.lower()) if w] for t in texts), len(texts))

    def encode_images(self, images: list[bytes]) -> np.ndarray:
        return self._fold(([bytes([b]) for b in x] for x in images), len(images))


class ByteGramEncoder(HistogramEncoder):
    """A second stand-in, with vectors of its own: runs of three characters in place of words."""

    name = "bytegrams"

    def encode_texts(self, texts: list[str]) -> np.ndarray:
        padded = (f"  {t.lower()} ".encode() if t.strip() else b"" for t in texts)
        return self._fold(([t[i : i + 3] for i in range(len(t) - 2)] for t in padded), len(texts))


#: Encoders by name; `load` fails for other names.
ENCODERS = {c.name: c for c in (HistogramEncoder, ByteGramEncoder)}


def load(name: str, dimension: int = DIMENSION) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder: {name}")
    return ENCODERS[name](dimension)


def encode_column(encoder: Encoder, text: Column) -> Column:
    """Vectors of a text column, batch by batch; the encoder is built once for each worker's iterator."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoder.encode_texts(texts.fillna("").tolist())))

    return run(text)


#: The fields of a cue that may hold an image, and how image files begin.
CUE_FIELDS = ("dataUrl", "data_url", "base64", "content")
IMAGE_STARTS = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"BM", b"II*\x00", b"MM\x00*")


def is_image(data: bytes) -> bool:
    """Whether bytes begin as an image file does; pixels are an encoder's business."""
    return data.startswith(IMAGE_STARTS) or (data[:4] == b"RIFF" and data[8:12] == b"WEBP")


def image_bytes(cue: dict) -> bytes:
    """The image of a request: base64, bare or as a data address."""
    given = next((cue[k] for k in CUE_FIELDS if cue.get(k)), None)
    if not given:
        raise ValueError("visual_query requires imageCue.dataUrl/base64 or imageEmbedding")
    text = given if isinstance(given, (str, bytes)) else None
    if isinstance(text, str) and text[:5].lower() == "data:":
        text = text.partition(",")[2] or text
    try:
        data = base64.b64decode(text, validate=True)
    except (binascii.Error, TypeError, ValueError) as error:
        raise ValueError("imageCue contains invalid base64 image data") from error
    if not is_image(data):
        raise ValueError("imageCue image data could not be decoded")
    return data


def decoded(text: Column) -> Column:
    """The bytes of a base64 column, bare or as a data address; null where it is no strict base64."""
    bare = F.regexp_replace(text, "(?i)^data:[^,]*,", "")
    strict = bare.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(strict, F.unbase64(bare))


def visual_vector(encoder: Encoder | None, embedding: list[float] | None, cue: dict | None) -> list[float]:
    """The given vector, else one in the cue, else the encoded image."""
    cue = cue or {}
    for given in (embedding, cue.get("embedding"), cue.get("vector")):
        if given:
            if isinstance(given, (str, bytes)):
                raise ValueError("embedding must be a numeric sequence")
            return [float(x) for x in given]
    if encoder is None:
        raise RuntimeError("embedding encoder is not loaded")
    return encoder.encode_images([image_bytes(cue)])[0].tolist()
