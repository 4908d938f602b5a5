"""Identity, hash splits, shards and check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(*parts: Column) -> Column:
    """qid|arm|navigator|answerer."""
    return F.concat_ws("|", *parts)


def head64(text: Column) -> Column:
    """The first 8 bytes of SHA-256 as a decimal(20,0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def split_fraction(seed: int, key: Column) -> Column:
    return head64(F.concat(F.lit(f"{seed}:"), key)).cast("double") / F.lit(float(1 << 64))


def assign_split(seed: int, key: Column, dev: float = 0.2) -> Column:
    """dev for a fixed share of keys, else test."""
    return F.when(split_fraction(seed, key) < dev, F.lit("dev")).otherwise(F.lit("test"))


def shard_of(key: Column, n: int) -> Column:
    """All 256 bits of SHA-256 modulo n."""
    digits = F.split(F.sha2(key, 256), "")
    return F.aggregate(digits, F.lit(0), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("int")) % n)


def file_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def chunk_key(sha256: Column, model: str, most: int, overlap: int) -> Column:
    """Names a document's chunks under a model and window."""
    return F.left(F.sha2(F.concat_ws("|", sha256, F.lit(model), F.lit(str(most)), F.lit(str(overlap))), 256), F.lit(24))


def isin_from_valor(valor: Column) -> Column:
    """CH, the number in nine digits, and the check digit over letters as two digits each."""
    body = F.concat(F.lit("CH"), F.lpad(valor.cast("string"), 9, "0"))
    digits = F.split(F.array_join(F.transform(F.split(body, ""), lambda c: F.conv(c, 36, 10)), ""), "")
    # from the right, every other digit beginning with the last is doubled, as the check digit follows it
    turned = F.transform(F.reverse(digits), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(turned, F.lit(0), lambda a, d: a + F.floor(d / 10).cast("int") + d % 10)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def uniform(seed: int, *key: Column) -> Column:
    """A double in [0, 1) that depends on key alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / F.lit(float(1 << 53))
