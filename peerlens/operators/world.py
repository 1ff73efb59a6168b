"""A generated world: entities, a ledger of unspent outputs, blocks, campaigns, and the truth behind them.

The ledger is sequential by nature, so a world is built on the driver and is as
small as its configuration says; what grows with it (the flooding of announcements)
runs in parallel, see ``generate``. Everything is a function of the configuration.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from peerlens.operators.generate import seed_of

# Parameters of a world; regimes and overrides change single values.
DEFAULTS: dict = {
    "seed": 7,
    "world": {"entities": 80, "illicit_share": 0.15, "cgnat_share": 0.2, "ipv6_share": 0.2, "blocks": 60, "payments_per_block": 6.0, "tor_share": 0.05, "vpn_share": 0.05},
    "types": {"individual": 0.62, "merchant": 0.14, "exchange": 0.08, "service": 0.06, "mining_pool": 0.04, "mixer": 0.06},
    "regions": {"DE": [64501, "Nordlicht Netz", 0.4], "BR": [64502, "Rio Cabo", 0.3], "IN": [64503, "Deccan Fibre", 0.3]},
    "money": {"opening_mu": 17.5, "value_mu": 14.0, "sigma": 1.2, "fee_mu": 2.0, "fee_sigma": 0.6, "subsidy": 312_500_000, "payout_every": 6},
    "campaigns": {"count": 4, "moves": 10},
    "clock": {"start_us": 1_740_000_000_000_000, "block_us": 600_000_000},
}
REGIMES: dict[str, dict] = {"quiet": {"campaigns.count": 0}, "busy": {"world.payments_per_block": 20.0}, "hidden": {"world.tor_share": 0.3, "world.vpn_share": 0.3}}
# Types that run their traffic from data centres.
HOSTED = ("exchange", "service", "mining_pool", "mixer")
# Moves that name a pattern, in the order in which ties are broken.
PATTERNS = ("peel_chain", "fan_out", "structuring", "coinjoin_like", "pass_through", "rapid_hop")
MOVES = (*PATTERNS, "consolidate", "wait")
# Virtual bytes of a transaction, an input and an output.
VBYTES = (11, 68, 31)


def configure(changes: dict | None = None, overrides: tuple[str, ...] = (), regime: str | None = None) -> dict:
    """The defaults with a nested dict, a regime and dotted ``a.b=value`` overrides laid over them, in this order.

    An unknown name, and a value of another kind than the default, is an error.
    """
    def copy(x):
        return {k: copy(v) for k, v in x.items()} if isinstance(x, dict) else x

    def put(at: dict, path: list[str], value: object, whole: str) -> None:
        name = path[0]
        if name not in at and at is not out["types"] and at is not out["regions"]:
            raise KeyError(f"unknown setting {whole}")
        if len(path) > 1:
            return put(at[name], path[1:], value, whole)
        known = at.get(name, value)
        if isinstance(known, (int, float)) and not isinstance(value, (int, float)):
            raise TypeError(f"{whole} must be a number")
        at[name] = type(known)(value) if isinstance(known, (int, float)) else value

    def lay(tree: dict, prefix: list[str]) -> None:
        for k, v in tree.items():
            path = [*prefix, *k.split(".")]
            lay(v, path) if isinstance(v, dict) else put(out, path, v, ".".join(path))

    out = copy(DEFAULTS)
    lay(changes or {}, [])
    if regime:
        lay(REGIMES[regime], [])
    for text in overrides:
        name, _, value = text.partition("=")
        put(out, name.split("."), float(value) if "." in value or "e" in value else int(value), name)
    return out


@dataclass
class Entity:
    entity_id: str
    entity_type: str
    region: str
    ips: list[str]
    behind_cgnat: bool
    is_illicit: bool = False
    addresses: list[str] = field(default_factory=list)


@dataclass
class Campaign:
    campaign_id: str
    holder: int
    start_block: int
    left: int
    ran: dict[str, int] = field(default_factory=dict)
    entities: set[int] = field(default_factory=set)
    txids: list[str] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    total: int = 0

    def typology(self) -> str:
        """The pattern that it ran most often; ties by the order of the patterns."""
        seen = [p for p in PATTERNS if self.ran.get(p)]
        return max(seen, key=lambda p: (self.ran[p], -PATTERNS.index(p))) if seen else "none"


def shares(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole numbers that add up to ``total``; rounding goes to the largest share, then by name."""
    counts = {k: round(w * total) for k, w in weights.items()}
    counts[min(weights, key=lambda k: (-weights[k], k))] += total - sum(counts.values())
    return counts


def population(cfg: dict) -> list[Entity]:
    """Entities by type share, each in a region, with addresses of its region's slice or a shared one."""
    rng = np.random.default_rng(seed_of(cfg["seed"], "population"))
    w, regions = cfg["world"], cfg["regions"]
    names, weights = list(regions), np.array([r[2] for r in regions.values()], float)
    out: list[Entity] = []
    for kind, n in shares(cfg["types"], w["entities"]).items():
        for _ in range(n):
            r = int(rng.choice(len(names), p=weights / weights.sum()))
            shared = bool(rng.random() < w["cgnat_share"]) and kind not in HOSTED
            if shared:
                ip = f"100.{64 + r}.0.{int(rng.integers(1, 5))}"
            elif rng.random() < w["ipv6_share"]:
                ip = f"2001:db8:{r:x}::{int(rng.integers(1, 65_536)):x}"
            else:
                ip = f"198.18.{r}.{int(rng.integers(1, 255))}"
            out.append(Entity(f"ent-{len(out):06d}", kind, names[r], [ip], shared))
    for i in rng.permutation(len(out))[: round(w["illicit_share"] * len(out))]:
        out[int(i)].is_illicit = True
    return out


class Ledger:
    """Unspent outputs by owner; every transaction spends what exists and conserves value."""

    def __init__(self, people: list[Entity], cfg: dict):
        self.people, self.cfg = people, cfg
        self.rng = np.random.default_rng(seed_of(cfg["seed"], "ledger"))
        self.unspent: list[dict[tuple[str, int], tuple[str, int, int]]] = [{} for _ in people]
        self.rows: list[dict] = []
        self.born: dict[str, int] = {}

    def address(self, owner: int) -> str:
        """A new address of the owner, or for hosted types sometimes an old one."""
        e = self.people[owner]
        if e.addresses and e.entity_type in HOSTED and self.rng.random() < 0.6:
            return e.addresses[int(self.rng.integers(len(e.addresses)))]
        e.addresses.append("bc1q" + hashlib.sha256(f"{owner}:{len(e.addresses)}:{self.cfg['seed']}".encode()).hexdigest()[:38])
        return e.addresses[-1]

    def add(self, height: int, block_us: int, payer: int | None, inputs: list, outs: list[tuple[int, int]], fee: int, coinbase: bool = False) -> str:
        """Record a transaction; ``outs`` are (owner, sats)."""
        made = [(self.address(o), sats, o) for o, sats in outs]
        txid = hashlib.sha256(repr(([k for k, _ in inputs], [(a, s) for a, s, _ in made], height if coinbase else 0)).encode()).hexdigest()
        # a child is broadcast after its parents
        earliest = max([self.born[k[0]] for k, _ in inputs if k[0] in self.born], default=block_us - self.cfg["clock"]["block_us"])
        at = int(max(earliest + 1_000, block_us - self.rng.integers(1, self.cfg["clock"]["block_us"])))
        self.born[txid] = at
        for vout, (a, sats, o) in enumerate(made):
            self.unspent[o][(txid, vout)] = (a, sats, height)
        self.rows.append({
            "txid": txid, "block_height": height, "block_time_us": block_us, "broadcast_us": at, "is_coinbase": coinbase, "payer": payer,
            "input_txids": [k[0] for k, _ in inputs], "input_vouts": [k[1] for k, _ in inputs], "input_addresses": [v[0] for _, v in inputs], "input_amounts": [v[1] for _, v in inputs],
            "output_addresses": [a for a, _, _ in made], "output_amounts": [s for _, s, _ in made], "fee_sats": fee, "vsize": VBYTES[0] + VBYTES[1] * len(inputs) + VBYTES[2] * len(made),
        })
        return txid

    def balance(self, owner: int) -> int:
        return sum(v[1] for v in self.unspent[owner].values())

    def pay(self, height: int, block_us: int, owner: int, outs: list[tuple[int, int]], everything: bool = False, with_: int | None = None) -> str | None:
        """Spend the owner's coins, largest first, until outputs and fee are covered; change returns to the owner.

        ``with_`` is a cosigner whose largest coin joins in and returns to it. None if the coins do not suffice.
        """
        rate = int(np.clip(self.rng.lognormal(self.cfg["money"]["fee_mu"], self.cfg["money"]["fee_sigma"]), 1, 500))
        coins = sorted(self.unspent[owner].items(), key=lambda kv: (-kv[1][1], kv[0]))
        joined = sorted(self.unspent[with_].items(), key=lambda kv: (-kv[1][1], kv[0]))[:1] if with_ is not None else []
        chosen, have, need = list(joined), 0, sum(s for _, s in outs)
        back = [(with_, v[1]) for _, v in joined]
        fee = rate * (VBYTES[0] + VBYTES[1] * len(chosen) + VBYTES[2] * (len(outs) + len(back) + 1))
        for coin in coins:
            if have >= need + fee and not everything:
                break
            chosen.append(coin)
            have += coin[1][1]
            fee += rate * VBYTES[1]
        if have < need + fee or len(chosen) == len(joined):
            return None
        change = have - need - fee
        keep = [(owner, change)] if change > 546 else []
        for k, _ in chosen:
            self.unspent[owner].pop(k, None)
            if with_ is not None:
                self.unspent[with_].pop(k, None)
        return self.add(height, block_us, owner, chosen, [*outs, *back, *keep], fee if keep else fee + change)


def _move(book: Ledger, c: Campaign, move: str, height: int, block_us: int, rng: np.random.Generator) -> list[str | None]:
    """One move of a campaign; the transactions it made."""
    crew = [i for i, e in enumerate(book.people) if e.is_illicit]
    other = lambda: int(crew[int(rng.integers(len(crew)))])
    have, pay = book.balance(c.holder), lambda outs, **k: book.pay(height, block_us, c.holder, outs, **k)
    if move == "peel_chain":
        return [pay([(other(), max(1_000, have // 20))])]
    if move == "fan_out":
        return [pay([(other(), max(1_000, have // 40)) for _ in range(8)])]
    if move == "structuring":
        return [pay([(other(), int(rng.integers(900_000, 1_000_000)))]) for _ in range(3)]
    if move == "coinjoin_like":
        part = max(1_000, have // 10)
        return [pay([(other(), part) for _ in range(4)], with_=other() if len(crew) > 1 else None)]
    if move in ("pass_through", "rapid_hop"):
        made = []
        for _ in range(1 if move == "pass_through" else 3):
            target = other()
            made.append(book.pay(height, block_us, c.holder, [(target, max(1_000, int(book.balance(c.holder) * 0.9)))]))
            if made[-1]:
                c.holder = target
                c.entities.add(target)
        return made
    return [pay([], everything=True)] if move == "consolidate" else []


def build(cfg: dict) -> dict[str, pd.DataFrame]:
    """Chain and truth of a world: transactions, entities, campaigns, origins."""
    people = population(cfg)
    book, rng = Ledger(people, cfg), np.random.default_rng(seed_of(cfg["seed"], "events"))
    money, w, clock = cfg["money"], cfg["world"], cfg["clock"]
    draw = lambda mu: int(max(1_000, rng.lognormal(mu, money["sigma"])))
    now, height = clock["start_us"], 880_000
    for i in range(len(people)):  # opening balances, made before the first block
        book.add(height - 1, now, None, [], [(i, draw(money["opening_mu"])) for _ in range(2)], 0, True)
    opening = len(book.rows)
    pools = [i for i, e in enumerate(people) if e.entity_type == "mining_pool"] or [0]
    crew = [i for i, e in enumerate(people) if e.is_illicit]
    live = [Campaign(f"cmp-{k:04d}", crew[k % len(crew)], int(rng.integers(w["blocks"] // 2 + 1)), cfg["campaigns"]["moves"]) for k in range(cfg["campaigns"]["count"] if crew else 0)]
    for block in range(w["blocks"]):
        now += int(max(1, rng.exponential(clock["block_us"])))
        pool = pools[block % len(pools)]
        book.add(height + block, now, pool, [], [(pool, money["subsidy"])], 0, True)
        if block % money["payout_every"] == money["payout_every"] - 1:
            book.pay(height + block, now, pool, [(int(i), draw(money["value_mu"])) for i in rng.choice(len(people), 5)])
        for _ in range(int(rng.poisson(w["payments_per_block"]))):
            payer, payee = (int(x) for x in rng.integers(len(people), size=2))
            if payer != payee:
                book.pay(height + block, now, payer, [(payee, draw(money["value_mu"]))])
        for c in live:
            if block >= c.start_block and c.left > 0:
                move = MOVES[int(rng.integers(len(MOVES)))]
                c.left -= 1
                c.entities.add(c.holder)
                made = [t for t in _move(book, c, move, height + block, now, rng) if t]
                if made:
                    c.ran[move] = c.ran.get(move, 0) + 1
                    c.txids += made
                    c.times.append(now)
    rows = pd.DataFrame(book.rows[opening:])
    sums = dict(zip(rows["txid"], rows["output_amounts"].map(sum), strict=True))
    origins = []
    for r in rows.itertuples():
        e, u = people[int(r.payer)], rng.random()
        region = cfg["regions"][e.region]
        kind = "tor" if u < w["tor_share"] else "vpn_suspect" if u < w["tor_share"] + w["vpn_share"] else "mobile" if e.behind_cgnat else "hosting" if e.entity_type in HOSTED else "residential"
        relay = kind in ("tor", "vpn_suspect")
        origins.append((r.txid, f"192.0.2.{int(rng.integers(1, 255))}" if relay else e.ips[0], None if relay else region[0], None if relay else region[1], kind, None if relay else e.region, e.entity_id, r.broadcast_us))
    return {
        "transactions": rows.drop(columns=["payer", "broadcast_us"]),
        "entities": pd.DataFrame([(e.entity_id, e.entity_type, e.is_illicit, e.region, e.addresses, e.ips, e.behind_cgnat) for e in people], columns=ENTITY),
        "campaigns": pd.DataFrame([(c.campaign_id, c.typology(), sorted(people[i].entity_id for i in c.entities), c.txids, min(c.times), max(c.times), sum(sums.get(t, 0) for t in c.txids)) for c in live if c.txids], columns=CAMPAIGN),
        "origins": pd.DataFrame(origins, columns=ORIGIN),
    }


ENTITY = ["entity_id", "entity_type", "is_illicit", "region", "addresses", "ips", "behind_cgnat"]
CAMPAIGN = ["campaign_id", "typology", "entity_ids", "txids", "start_us", "end_us", "total_sats"]
ORIGIN = ["txid", "true_ip", "true_asn", "true_as_org", "true_net_class", "true_country", "entity_id", "broadcast_us"]
# Fixed schemas of the tables of a world.
SCHEMAS = {
    "transactions": "txid string, block_height long, block_time_us long, is_coinbase boolean, input_txids array<string>, input_vouts array<int>, input_addresses array<string>, input_amounts array<long>, "
    "output_addresses array<string>, output_amounts array<long>, fee_sats long, vsize long",
    "entities": "entity_id string, entity_type string, is_illicit boolean, region string, addresses array<string>, ips array<string>, behind_cgnat boolean",
    "campaigns": "campaign_id string, typology string, entity_ids array<string>, txids array<string>, start_us long, end_us long, total_sats long",
    "origins": "txid string, true_ip string, true_asn long, true_as_org string, true_net_class string, true_country string, entity_id string, broadcast_us long",
}


def frames(spark: SparkSession, cfg: dict) -> dict[str, DataFrame]:
    """The tables of a world in their fixed schemas."""
    def plain(v, whole: bool):
        v = v.item() if isinstance(v, np.generic) else v
        return None if isinstance(v, float) and v != v else int(v) if whole and v is not None else v

    out = {}
    for name, df in build(cfg).items():
        whole = [part.endswith(" long") for part in SCHEMAS[name].split(", ")]
        out[name] = spark.createDataFrame([[plain(v, w) for v, w in zip(row, whole, strict=True)] for row in df.itertuples(index=False)], SCHEMAS[name])
    return out


def write_world(spark: SparkSession, cfg: dict, folder: str) -> dict[str, DataFrame]:
    """The tables written as parquet, chain and truth apart; a folder that exists is an error."""
    made = frames(spark, cfg)
    for name, df in made.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{'chain' if name == 'transactions' else 'truth'}/{name}")
    return made


def vendor_lists(spark: SparkSession, cfg: dict) -> DataFrame:
    """(network, asn, as_org, country): the address blocks of each region, as a vendor would list them."""
    rows = []
    for i, (country, (asn, org, _)) in enumerate(cfg["regions"].items()):
        rows += [(f"198.18.{i}.0/24", asn, org, country), (f"100.{64 + i}.0.0/16", asn, org, country), (f"2001:db8:{i:x}::/48", asn, org, country)]
    return spark.createDataFrame(rows, "network string, asn int, as_org string, country string")
