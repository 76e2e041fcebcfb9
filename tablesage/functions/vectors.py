"""Dense vectors as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesage.functions.binding import let

# Fixed values of the stand-in embedding.
HASH_DIMENSIONS = 1536
HASH_BYTES = 32


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def hash_levels(text: Column) -> Column:
    """The unscaled entries of the stand-in embedding, as integers 0 to 99."""
    def octets(digest: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(HASH_BYTES - 1))
        return F.transform(places, lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))

    # Entry i is (byte[i mod 32] * (i + 1)) mod 100, so the byte array is read cyclically.
    cyclic = F.flatten(F.array_repeat(let(F.sha2(F.coalesce(text, F.lit("")), 256), octets), HASH_DIMENSIONS // HASH_BYTES))
    return F.transform(cyclic, lambda octet, i: F.pmod(octet * (i + 1), F.lit(100)))


def hash_embedding(text: Column) -> Column:
    """Deterministic unit vector of a text, for use where no embedding model is at hand."""
    return scaled_to_unit(F.transform(hash_levels(text), lambda level: level / F.lit(100.0)))


def scaled_to_unit(vector: Column) -> Column:
    def divided(v: Column) -> Column:
        return let(norm(v), lambda length: F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length)))

    return let(vector, divided)
