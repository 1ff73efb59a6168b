"""As-of joins and interval lookups without theta joins.

Both sides are unioned, sorted within each key, and the payload of the nearest
right row is carried along: one shuffle, one sort, spill-safe, never quadratic.
Very large keys are carried along over several ranges (``ordered.last_before``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.ordered import last_before
from peerlens.runtime import durable


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, payload: list[str], direction: str = "backward", strict: bool = False, hot_rows: int = 1_000_000) -> DataFrame:
    """``left`` with the payload of the nearest right row of the same keys.

    backward: latest right row at or before (``strict``: before) the left time;
    forward: earliest at or after (after). Several right rows at one time count
    as the one with the largest payload struct backward, the smallest forward.
    Left rows with null keys or times, and left rows without a match, keep null
    payloads. Payload names must not occur in ``left``.
    """
    cols = left.columns
    one = F.struct(F.col(right_on).alias("_at"), *[F.col(p) for p in payload])
    pick = F.max if direction == "backward" else F.min
    # one right row per key and time bounds what the window carries
    r = right.where(F.col(right_on).isNotNull()).groupBy(*keys, right_on).agg(pick(one).alias("_p"))
    backward = direction == "backward"
    # at equal times the side that must be seen first sorts first
    right_side = (1 if strict else 0) if backward else (0 if strict else 1)
    tagged = left.select(*[F.col(c) for c in cols], F.col(on).alias("_t"), F.lit(1 - right_side).alias("_side"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_left"))
    other = r.select(*[F.col(k) for k in keys], F.col(right_on).alias("_t"), F.lit(right_side).alias("_side"), "_p", F.lit(False).alias("_left"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    order = [F.col("_t").asc_nulls_first(), F.col("_side").asc()] if backward else [F.col("_t").desc_nulls_first(), F.col("_side").desc()]
    both = last_before(both, keys, order, "_p", "_c", hot_rows=hot_rows)
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = both.withColumn("_m", F.when(known, F.col("_c"))).where(F.col("_left"))
    return out.select(*[F.col(c) for c in cols], F.col("_m._at").alias(right_on if right_on not in cols else f"{right_on}_match"), *[F.col(f"_m.{p}").alias(p) for p in payload])


def ip_key(ip):
    """32 hex digits of an address whose text order is its numeric order; null if malformed.

    IPv4 keys start with 4 and IPv6 keys with 6, so the families never mix.
    """
    octet = lambda i: F.split(ip, r"\.")[i].try_cast("int")
    four = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    v4 = F.when(four & (F.greatest(*[octet(i) for i in range(4)]) <= 255), F.concat(F.lit("4"), F.lpad(F.hex((octet(0).cast("long") * 16777216) + octet(1) * 65536 + octet(2) * 256 + octet(3)), 32, "0")))
    # IPv6: expand the one double colon, then pad every group
    halves = F.split(F.lower(ip), "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    head, tail = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail)
    full = F.when(F.size(halves) == 1, head).when((F.size(halves) == 2) & (missing >= 1), F.concat(head, F.array_repeat(F.lit("0"), missing), tail))
    six = ip.contains(":") & ip.rlike("^[0-9a-fA-F:]+$") & (F.size(full) == 8) & F.forall(full, lambda g: F.length(g) <= 4)
    v6 = F.when(six, F.concat(F.lit("6"), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")))
    return F.lower(F.coalesce(v4, v6))


def cidr_bounds(network, base=None):
    """Struct(low, high) of a CIDR block as :func:`ip_key` values; null if malformed.

    ``base`` is the key of the block's address, if a column already has it.
    """
    base = ip_key(F.substring_index(network, "/", 1)) if base is None else base
    bits = F.substring_index(network, "/", -1).try_cast("int")
    size = F.when(base.startswith("4"), 32).otherwise(128)
    ok = network.contains("/") & base.isNotNull() & bits.between(0, size)
    free = size - bits
    # the block is aligned: cut to whole hex digits and set the partial digit
    keep = F.floor((F.lit(132) - free) / 4).cast("int")
    part = (free % 4).cast("int")
    digit = F.conv(F.substring(base, keep + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), part).cast("int")
    low_digit = (F.floor(digit / step) * step).cast("int")
    fill = F.lit(33) - keep
    low = F.when(part == 0, F.rpad(F.substring(base, F.lit(1), keep), 33, "0")).otherwise(F.rpad(F.concat(F.substring(base, F.lit(1), keep), F.lower(F.hex(low_digit))), 33, "0"))
    high = F.when(part == 0, F.rpad(F.substring(base, F.lit(1), keep), 33, "f")).otherwise(F.rpad(F.concat(F.substring(base, F.lit(1), keep), F.lower(F.hex(low_digit + step - 1))), 33, "f"))
    return F.when(ok & (fill >= 0), F.struct(low.alias("low"), high.alias("high")))


def cidr_lookup(ips: DataFrame, blocks: DataFrame, ip: str, network: str, payload: list[str]) -> DataFrame:
    """Each address with the payload of the block that holds it, else null.

    Blocks are taken not to overlap; of blocks that begin at one address any may
    count. Malformed blocks and addresses match nothing. Each address meets the
    last block that begins at or before it, family by family; the as-of join
    splits a family of very many rows into ranges, so a block is never listed twice.
    """
    # keys are long expressions: each is made in a projection of its own and written once
    left = durable(ips.withColumn("_k", ip_key(F.col(ip))), "keys").withColumn("_family", F.substring("_k", 1, 1))
    based = durable(blocks.withColumn("_base", ip_key(F.substring_index(network, "/", 1))), "blocks")
    b = based.select(cidr_bounds(F.col(network), F.col("_base")).alias("_b"), *payload).where(F.col("_b").isNotNull()).select(F.substring("_b.low", 1, 1).alias("_family"), F.col("_b.low").alias("_low"), F.col("_b.high").alias("_high"), *payload)
    joined = asof_join(left, b, ["_family"], "_k", "_low", ["_high", *payload])
    inside = F.col("_k") <= F.col("_high")
    return joined.select(*[F.col(c) for c in ips.columns], *[F.when(inside, F.col(p)).alias(p) for p in payload])
