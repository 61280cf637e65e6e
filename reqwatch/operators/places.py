"""Places of addresses: the longest block that holds an address, and a store of answers that grow old."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits_of(text: str | None) -> str | None:
    """4 or 6 and an address's bits, or those of a block's prefix; null for what is neither.  Mapped addresses are of version 4."""
    try:
        net = ipaddress.ip_network((text or "").strip(), strict=False)
    except ValueError:
        return None
    address, size = net.network_address, net.prefixlen
    if net.version == 6 and size >= 96 and (mapped := address.ipv4_mapped) is not None:
        address, size = mapped, size - 96
    return f"{address.version}{int(address):0{address.max_prefixlen}b}"[: 1 + size]


def address_bits(column: Column) -> Column:
    """bits_of a column.  Called not deterministic, so that no filter on it sinks beneath a distinct and runs it for each row."""

    @F.pandas_udf("string")
    def bits(texts: pd.Series) -> pd.Series:
        return texts.map(bits_of)

    return bits.asNondeterministic()(column)


def placed(addresses: DataFrame, blocks: DataFrame, key: str = "ip_address", block: str = "block", address: str | None = None) -> DataFrame:
    """(key, and blocks' other columns): for each different address the columns of the longest block that holds it.

    address: the column of the key's one address, where the key is not the address itself.

    An address's prefixes of each length that a block has (129 + 33 at most) meet the blocks by equality, so no range is
    scanned and no address meets a block that does not hold it.  Addresses that no block holds, and texts that are no
    address, are not in the result.  Of equal blocks one stands, the least by its columns.
    """
    names = [c for c in blocks.columns if c != block]
    own = blocks.withColumn("_bits", address_bits(F.col(block))).where("_bits is not null").groupBy("_bits").agg(F.min(F.struct(*names)).alias("_place"))
    sizes = sorted(r.n for r in own.select(F.length("_bits").alias("n")).distinct().collect())  # at most 162
    each = addresses.select(*dict.fromkeys([key, address or key])).distinct().withColumn("_all", address_bits(F.col(address or key)))
    each = each.select(key, F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("_all"))).alias("_size"), "_all")
    each = each.select(key, "_size", F.substring("_all", F.lit(1), F.col("_size")).alias("_bits"))
    best = each.join(own, "_bits").groupBy(key).agg(F.max_by("_place", "_size").alias("_place"))
    return best.select(key, "_place.*")


def fresh(store: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Answers of the store (.., looked_up_at) that are not older than so many days."""
    return store.where(F.unix_timestamp("looked_up_at") > F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - days * 86400)


def renewed(addresses: DataFrame, blocks: DataFrame, store: DataFrame, as_of: str, days: int = 7, key: str = "ip_address") -> DataFrame:
    """The store for these addresses: fresh answers as they are, all others asked anew at as_of."""
    held = fresh(store, as_of, days)
    asked = addresses.select(key).distinct().join(held.select(key), key, "left_anti")
    return held.unionByName(placed(asked, blocks, key).withColumn("looked_up_at", F.to_timestamp(F.lit(as_of)).cast(store.schema["looked_up_at"].dataType)).select(store.columns))
