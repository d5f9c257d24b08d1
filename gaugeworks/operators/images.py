"""Images as they are sent: decoding, resizing, corruption and JPEG, by the driver JVM's codecs, as calls are made from the driver too."""

from __future__ import annotations

import base64
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import corrupt


def to_bmp(image: np.ndarray) -> bytes:
    """A 24-bit bitmap of an image of height by width by RGB: a format that any codec reads without loss."""
    h, w = image.shape[:2]
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def from_bmp(data: bytes) -> np.ndarray:
    at, (w, h), bits = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
    if bits != 24:
        raise ValueError(f"a bitmap of {bits} bits")
    rows = np.frombuffer(data, np.uint8, abs(h) * (-(-3 * w // 4) * 4), at).reshape(abs(h), -1)[:, : 3 * w]
    return (rows[::-1] if h > 0 else rows).reshape(abs(h), w, 3)[:, :, ::-1].copy()


def decode(spark: SparkSession, data: bytes, max_edge: int = 0) -> np.ndarray:
    """RGB of an image file; scaled down to ``max_edge`` where its longer edge is over that. 0 keeps its size, so that coordinates in a stem stay true."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if image is None:
        raise ValueError("no image that the JVM can read")
    w, h = image.getWidth(), image.getHeight()
    scale = min(1.0, max_edge / max(w, h)) if max_edge else 1.0
    w, h = max(1, int(w * scale)), max(1, int(h * scale))
    plain = jvm.java.awt.image.BufferedImage(w, h, 1)
    pen = plain.createGraphics()
    pen.setRenderingHint(jvm.java.awt.RenderingHints.KEY_INTERPOLATION, jvm.java.awt.RenderingHints.VALUE_INTERPOLATION_BILINEAR)
    pen.drawImage(image, 0, 0, w, h, None)
    pen.dispose()
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(plain, "bmp", out)
    return from_bmp(bytes(out.toByteArray()))


def jpeg(spark: SparkSession, image: np.ndarray, quality: int = 90) -> bytes:
    """``image`` as JPEG; its bytes are those of the JVM's encoder, not of any other."""
    jvm = spark._jvm
    pixels = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(to_bmp(image)))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(float(quality) / 100)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(pixels, None, None), settings)
    stream.flush()
    writer.dispose()
    return bytes(out.toByteArray())


def data_url(spark: SparkSession, data: bytes, corruption: str = "", severity: int = 0, seed: int = 0, max_edge: int = 0, quality: int = 90) -> str:
    """An image file as it is sent: decoded, resized and corrupted where wanted, as JPEG in base64."""
    image = decode(spark, data, max_edge)
    if corruption:
        image = corrupt.corrupted(image, corruption, severity, seed)
    return "data:image/jpeg;base64," + base64.b64encode(jpeg(spark, image, quality)).decode("ascii")


def manifests(refs: DataFrame) -> DataFrame:
    """(question_id, images) of refs(question_id, camera, path, source_sha256): the refs of a question in the order of ``pos`` where there is one, else of their cameras."""
    first = [F.col("pos")] if "pos" in refs.columns else []
    entry = F.struct(*first, F.col("camera").alias("camera"), F.col("path").alias("path"), F.col("source_sha256").alias("source_sha256"))
    listed = refs.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("images"))
    return listed.select("question_id", F.transform("images", lambda x: F.struct(*[x[n].alias(n) for n in ("camera", "path", "source_sha256")])).alias("images"))


def missing(refs: DataFrame) -> DataFrame:
    """(question_id) whose images aren't all there: what a run checks before its first call."""
    return refs.where("source_sha256 is null").select("question_id").distinct()
