"""Vectors as arrays: norms, products, hashed embeddings, 8-bit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    size = F.greatest(norm(vector), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / size)


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """Digest bytes less 128 at unit length: an encoder without a model."""
    digest = F.sha2(text.cast("binary"), 256)
    return normalise(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") - 128).cast("double")))


def int8(vector: Column) -> Column:
    """Struct of 8-bit codes and the scale that turns them back."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, F.lit(1.0)).otherwise(top)
    return F.struct(F.transform(vector, lambda x: F.rint(x.cast("double") / scale * 127).cast("tinyint")).alias("codes"), (scale / 127).alias("scale"))


def packed_codes(codes: Column) -> Column:
    """8-bit codes as base64 of their bytes, in one line."""
    digits = F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("int").bitwiseAND(F.lit(255))), 2, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), "[\\r\\n]", "")


def unpacked_codes(text: Column) -> Column:
    """The 8-bit codes that ``packed_codes`` made base64 of."""
    digits = F.hex(F.unbase64(text))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i)).cast("tinyint"))
    return F.when(F.length(digits) > 0, codes).otherwise(F.array().cast("array<tinyint>"))
