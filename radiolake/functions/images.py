"""Image bytes and pixels. Pixels are an array of grey values with a width; the work on
them is vectorised over Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

# Fixed values: (level, width) of the display windows.
WINDOWS = {"bone": (128.0, 100.0), "enamel": (200.0, 100.0), "soft_tissue": (80.0, 150.0), "metal_reduction": (100.0, 200.0)}


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of some bytes; at counts from 1."""
    text = F.hex(F.substring(content, at, size))
    if little:
        text = F.concat(*[F.substring(text, 2 * size - 2 * i - 1, 2) for i in range(size)])
    return F.conv(text, 16, 10).cast("int")


@F.pandas_udf(StructType([StructField(n, IntegerType()) for n in ("width", "height", "parts")]))
def _jpeg(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Size and number of colour parts of JPEG bytes: its segments are walked to the frame's head."""

    def read(d: bytes | None) -> tuple:
        at = 2
        while d is not None and at + 9 < len(d) and d[at] == 0xFF:
            if 0xC0 <= d[at + 1] <= 0xCF and d[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(d[at + 7 : at + 9], "big"), int.from_bytes(d[at + 5 : at + 7], "big"), d[at + 9]
            at += 2 + int.from_bytes(d[at + 2 : at + 4], "big")
        return None, None, None

    for batch in contents:
        yield pd.DataFrame([read(d) for d in batch], columns=["width", "height", "parts"]).astype("Int32")


def header(content: Column) -> Column:
    """struct(kind, width, height, mode) from the bytes of PNG, GIF, BMP and JPEG files. Only
    JPEG, whose head lies behind segments of any length, goes to Python. Other bytes,
    and files torn within their head, give nulls."""
    magic = F.hex(F.substring(content, 1, 8))
    kind = F.when(magic == "89504E470D0A1A0A", "png").when(magic.startswith("FFD8FF"), "jpeg").when(magic.startswith("424D"), "bmp").when(magic.startswith("47494638"), "gif")
    jpeg = _jpeg(F.when(kind == "jpeg", content))
    width = F.when(kind == "png", _number(content, 17, 4)).when(kind == "gif", _number(content, 7, 2, True)).when(kind == "bmp", _number(content, 19, 4, True)).when(kind == "jpeg", jpeg["width"])
    height = F.when(kind == "png", _number(content, 21, 4)).when(kind == "gif", _number(content, 9, 2, True)).when(kind == "bmp", _number(content, 23, 4, True)).when(kind == "jpeg", jpeg["height"])
    of = lambda key, names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]
    # Colour modes by the formats' own codes.
    png = of(_number(content, 26, 1), {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"})
    bmp = of(_number(content, 29, 2, True), {1: "1", 8: "P", 24: "RGB", 32: "RGBA"})
    mode = F.when(kind == "png", png).when(kind == "gif", "P").when(kind == "bmp", bmp).when(kind == "jpeg", of(jpeg["parts"], {1: "L", 3: "RGB", 4: "CMYK"}))
    whole = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return F.struct(F.when(whole, kind).alias("kind"), F.when(whole, width).alias("width"), F.when(whole, height).alias("height"), F.when(whole, mode).alias("mode"))


def window_level(pixels: np.ndarray, preset: str = "bone", level: float | None = None, width: float | None = None) -> np.ndarray:
    """Grey values stretched so that the window fills 0 to 255, cut off to whole numbers."""
    base = WINDOWS.get(preset, WINDOWS["bone"])
    level, width = base[0] if level is None else level, max(1.0, base[1] if width is None else width)
    low = level - width / 2
    return ((np.clip(pixels.astype(np.float32), low, low + width) - low) / width * 255.0).astype(np.uint8)


def more_contrast(pixels: np.ndarray, amount: float) -> np.ndarray:
    """Blended away from the mean grey by an amount; 1 changes nothing."""
    mean = float(int(pixels.mean() + 0.5))
    return np.clip(mean + amount * (pixels.astype(np.float32) - mean), 0, 255).astype(np.uint8)


def cropped(pixels: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x1, y1, x2, y2 = box
    return pixels[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


def side_by_side(left: np.ndarray, right: np.ndarray, gap: int = 10) -> np.ndarray:
    """Two crops in one image with a black strip between."""
    out = np.zeros((max(left.shape[0], right.shape[0]), left.shape[1] + gap + right.shape[1]), np.uint8)
    out[: left.shape[0], : left.shape[1]] = left
    out[: right.shape[0], left.shape[1] + gap :] = right
    return out


# Least side, greatest jump between rows, least deviation of a usable image.
LEAST_SIDE, MOST_JUMP, LEAST_SPREAD = 100, 75, 5


def quality(pixels: np.ndarray) -> tuple[bool, str]:
    """(usable, why not): too small, a jump of brightness between rows, or hardly any contrast."""
    if min(pixels.shape[:2], default=0) < LEAST_SIDE:
        return False, "too small"
    rows = pixels.reshape(pixels.shape[0], -1).mean(1)
    if np.abs(np.diff(rows)).max() > MOST_JUMP:
        return False, "brightness jumps between rows"
    if pixels.std() < LEAST_SPREAD:
        return False, "no contrast"
    return True, "ok"


def denoise_parameters(strength: Column) -> tuple[Column, Column, Column]:
    """(diameter, sigma, odd median size) of a strength between 0 and 1."""
    k = F.round(3 + strength * 10).cast("int")
    return F.round(5 + strength * 20).cast("int"), F.round(20 + strength * 180).cast("int"), F.when(k % 2 == 0, k + 1).otherwise(k)


@F.pandas_udf(StructType([StructField("ok", BooleanType()), StructField("reason", StringType())]))
def quality_gate(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Quality of images given as grey values (binary) and width; null or torn ones fail."""
    rows = []
    for data, w in zip(pixels, width):
        whole = data is not None and w == w and w and len(data) % int(w) == 0
        rows.append(quality(np.frombuffer(data, np.uint8).reshape(-1, int(w))) if whole else (False, "no image"))
    return pd.DataFrame(rows, columns=["ok", "reason"])


def _each(work):
    """A UDF (pixels binary, width int, *numbers) -> binary over rows' images. Null pixels,
    and pixels that don't fill whole rows, give null."""

    @F.pandas_udf(BinaryType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for pixels, width, *rest in batches:
            out = []
            for d, w, *args in zip(pixels, width, *rest):
                whole = d is not None and w == w and w and len(d) % int(w) == 0
                out.append(work(np.frombuffer(d, np.uint8).reshape(-1, int(w)), *args).tobytes() if whole else None)
            yield pd.Series(out, dtype=object)

    return run


def windowed(preset: str, level: float | None = None, width: float | None = None):
    """A UDF (binary -> binary) that applies a display window; the level and the width given
    take the place of the preset's."""

    @F.pandas_udf(BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda d: None if d is None else window_level(np.frombuffer(d, np.uint8), preset, level, width).tobytes())

    return run


def contrasted(amount: float):
    """A UDF (pixels, width) for the contrast."""
    return _each(lambda p: more_contrast(p, amount))


def crops():
    """A UDF (pixels, width, x1, y1, x2, y2) for the pixels of a window."""
    return _each(lambda p, *box: cropped(p, tuple(map(int, box))))


def comparisons(gap: int = 10):
    """A UDF (pixels, width, window's four corners, the other window's four) for both side by side."""
    return _each(lambda p, *b: side_by_side(cropped(p, tuple(map(int, b[:4]))), cropped(p, tuple(map(int, b[4:]))), gap))


def synthetic(width: int = 1024, height: int = 512, seed: int = 0, findings: list[tuple[int, int]] | None = None) -> np.ndarray:
    """A made-up panoramic film: two bright jaws with a row of teeth each, noise, and a dark
    spot at each finding (quadrant, position). For tests; the same seed gives the same film."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width] / np.array([height, width]).reshape(2, 1, 1)
    film = 60 * np.exp(-(((y - 0.65) / 0.25) ** 2) / 2) + 50 * np.exp(-(((y - 0.35) / 0.2) ** 2) / 2) + rng.normal(0, 10, (height, width))
    for jaw, bend in ((0.36, 0.06), (0.64, -0.06)):
        along = (x - 0.5) / 0.42
        inside = (np.abs(along) < 1) & (np.abs(y - jaw - bend * along**2) < 0.06) & ((along * 8) % 1 > 0.15)
        film = np.where(inside, 215.0, film)
    for quadrant, position in findings or []:
        at = 0.5 + (position - 0.5) / 8 * 0.42 * (-1 if quadrant in (1, 4) else 1)
        film = np.where(((x - at) * width) ** 2 + ((y - (0.36 if quadrant in (1, 2) else 0.64)) * height) ** 2 < 64, 60.0, film)
    kernel = np.exp(-(np.arange(-4, 5) ** 2) / 4.5)
    for axis in (0, 1):
        film = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 4, "edge"), kernel / kernel.sum(), "valid"), axis, film)
    return np.clip(film, 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """Grey pixels as a PNG file."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    head = pixels.shape[1].to_bytes(4, "big") + pixels.shape[0].to_bytes(4, "big") + b"\x08\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
