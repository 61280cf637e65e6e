"""Address lists and address kinds."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_networks(entries) -> list:
    """Addresses and CIDR blocks; anything else is dropped."""
    out = []
    for e in entries:
        if isinstance(e, str) and e.strip():
            try:
                out.append(ipaddress.ip_network(e.strip(), strict=False))
            except ValueError:
                continue
    return out


def in_networks(ip: Column, entries) -> Column:
    """Whether ip is in any entry; an empty or odd address is in none."""
    nets = parse_networks(entries)
    if not nets:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def hit(values: pd.Series) -> pd.Series:
        known: dict = {}

        def one(v):
            if v not in known:
                try:
                    a = ipaddress.ip_address(v)
                    known[v] = any(a.version == n.version and a in n for n in nets)
                except ValueError:
                    known[v] = False
            return known[v]

        return values.fillna("").map(one)

    return hit(ip)


def blocked(ip: Column, blocklist, whitelist) -> Column:
    """On the blocklist and not on the whitelist."""
    return ~in_networks(ip, whitelist) & in_networks(ip, blocklist)


def v4_number(ip: Column) -> Column:
    """The 32-bit number of a dotted address, null if it is none."""
    parts = F.split(ip, r"\.")
    n = F.lit(0).cast("long")
    for k in range(4):
        n = n * 256 + F.get(parts, F.lit(k)).try_cast("long")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z")
    return F.when(ok, n)


def in_v4(ip: Column, entries) -> Column:
    """in_networks for version 4 blocks alone, without Python."""
    n, hit = v4_number(ip), F.lit(False)
    for net in parse_networks(entries):
        if net.version == 4:
            hit = hit | n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(hit, F.lit(False))


#: Fixed values.  Private and reserved blocks, of which no geo lookup can know a place.
UNPLACED = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "0.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "240.0.0.0/4", "::/128", "::1/128", "fe80::/10", "2001:db8::/32", "5f00::/8", "3ff3::/16", "2001:10::/28",
]


def looked_up(ip: Column) -> Column:
    """Whether a geo lookup makes sense: a valid address, neither private nor reserved."""
    return F.when(v4_number(ip).isNotNull(), ~in_v4(ip, UNPLACED)).otherwise(in_networks(ip, ["::/0"]) & ~in_networks(ip, UNPLACED))
