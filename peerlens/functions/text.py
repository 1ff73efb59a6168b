"""String and hash expressions: address kinds, labels, redaction, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def script_type(address: Column) -> Column:
    """Output type that an address's own spelling tells, else null."""
    n = F.char_length(address)
    return (
        F.when(address.startswith("bc1p"), "p2tr")
        .when(address.startswith("bc1q") & (n == 42), "p2wpkh")
        .when(address.startswith("bc1q") & (n == 62), "p2wsh")
        .when(address.startswith("3"), "p2sh")
        .when(address.startswith("1"), "p2pkh")
    )


def node_id(kind: str, key: Column) -> Column:
    """Prefixed graph node id; null for a null key."""
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def bare_id(node: Column) -> Column:
    """Node id without its prefix."""
    return F.regexp_replace(node, "^(addr|tx|peer|cluster|asn):", "")


def short(text: Column, head: int, tail: int, least: int) -> Column:
    """First and last characters around an ellipsis, if the text is long enough."""
    return F.when(F.char_length(text) >= least, F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail)))).otherwise(text)


def ip_label(ip: Column) -> Column:
    """Address with its host part hidden: two octets of IPv4, two groups of IPv6; other texts stay."""
    # fixed values: what stands for the hidden part
    four = F.regexp_replace(ip, r"^(\d+\.\d+)\.\d+\.\d+$", "$1.x.x")
    return F.when(F.length(F.regexp_replace(ip, "[^.]", "")) == 3, four).otherwise(F.regexp_replace(ip, "^([0-9a-fA-F]+:[0-9a-fA-F]*):.*$", "$1:x:x"))


def tx_label(txid: Column) -> Column:
    return short(txid, 8, 4, 13)


def address_label(address: Column) -> Column:
    return short(address, 6, 4, 11)


def hash_id(text: Column, n: int = 16, prefix: str = "") -> Column:
    """Leading hex digits of the SHA-256 of a text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, n))


# Words in an operator's name that tell its network class; VPN is asked before mobile and hosting.
VPN_WORDS = ("vpn", "proxy", "privacy", "anonym", "tunnel", "mullvad", "private internet")
MOBILE_WORDS = ("mobile", "cellular", "wireless", "gsm", "lte")
HOSTING_WORDS = (
    "hosting", "cloud", "data center", "datacenter", "data centre", "server", "vps", "dedicated", "colocation", "amazon",
    "google", "microsoft", "digitalocean", "ovh", "hetzner", "linode", "vultr", "alibaba", "oracle",
)


def net_class(org: Column, is_tor: Column, is_proxy: Column, asn_known: Column, other_known: Column) -> Column:
    """Network class of a peer.

    Tor list first; without an operator database unknown if another list was
    there, else null; then the proxy flag, a null operator, and the words of its
    name; what is left is residential.
    """
    name = F.lower(org)
    out = (
        F.when(F.coalesce(is_tor, F.lit(False)), "tor_exit")
        .when(~asn_known, F.when(other_known, "unknown"))
        .when(F.coalesce(is_proxy, F.lit(False)), "vpn_suspect")
        .when(org.isNull(), "unknown")
    )
    for label, words in (("vpn_suspect", VPN_WORDS), ("mobile", MOBILE_WORDS), ("hosting", HOSTING_WORDS)):
        out = out.when(name.rlike("|".join(words)), label)
    return out.otherwise("residential")
