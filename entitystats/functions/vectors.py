"""Vector arithmetic and reproducible text vectors."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unlike lengths or a zero norm."""
    size = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(F.lit(0.0))


def text_vector(text: Column, dim: int = 384) -> Column:
    """Vector in [-1, 1]^dim drawn from a generator seeded by the text's SHA-256.

    Needs Python's generator to give the same numbers, so it runs in Arrow
    batches rather than as an expression.
    """

    @F.pandas_udf("array<double>")
    def draw(texts: pd.Series) -> pd.Series:
        def one(value: str) -> list[float]:
            rnd = random.Random(int(hashlib.sha256(value.encode("utf-8")).hexdigest()[:16], 16))
            return [rnd.uniform(-1.0, 1.0) for _ in range(dim)]

        return texts.map(one, na_action="ignore")

    return draw(text)


def names_checksum(names: Column) -> Column:
    """SHA-256 of the compact JSON list, characters beyond ASCII written as ``\\uXXXX``."""
    text = F.to_json(names)
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("[0-9a-f]{4}"), F.lit(0))
    plain = F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), u)))
    return F.sha2(F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(plain, "")).otherwise(text), 256)
