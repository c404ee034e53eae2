"""Addresses, ports and protocols."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
IPV4_TEXT = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# fixed values: private IPv4 networks (loopback, link-local, documentation, benchmark and reserved
# networks count as private, two anycast addresses do not), then the multicast networks
PRIVATE_TEXT = (
    r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.0\.0\.(?!(9|10)$)|^192\.0\.2\.|^192\.168\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(24[0-9]|25[0-5])\."
)
MULTICAST_TEXT = r"^(22[4-9]|23[0-9])\."


def ipv4_number(address: Column) -> Column:
    """Address as a number, NULL unless it is plain dotted-quad text."""
    octet = [F.split_part(address, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(address.rlike(IPV4_TEXT), number)


def ipv4_class(address: Column) -> Column:
    """internal, special, external or invalid; anything but IPv4 text is invalid."""
    return (
        F.when(~F.coalesce(address.rlike(IPV4_TEXT), F.lit(False)), "invalid")
        .when(address.rlike(PRIVATE_TEXT), "internal").when(address.rlike(MULTICAST_TEXT), "special").otherwise("external")
    )


# fixed values: IPv6 networks with a class of their own, the first that fits counts; all others are external
V6_NETWORKS = (
    ("2001:1::1/128", "external"), ("2001:1::2/128", "external"), ("2001:3::/32", "external"), ("2001:4:112::/48", "external"),
    ("2001:20::/28", "external"), ("2001:30::/28", "external"),
    ("::/128", "internal"), ("::1/128", "internal"), ("64:ff9b:1::/48", "internal"), ("100::/64", "internal"), ("2001::/23", "internal"),
    ("2001:db8::/32", "internal"), ("2002::/16", "internal"), ("fc00::/7", "internal"), ("fe80::/10", "internal"),
    ("::/8", "special"), ("100::/8", "special"), ("200::/7", "special"), ("400::/6", "special"), ("800::/5", "special"), ("1000::/4", "special"),
    ("4000::/3", "special"), ("6000::/3", "special"), ("8000::/3", "special"), ("a000::/3", "special"), ("c000::/3", "special"),
    ("e000::/4", "special"), ("f000::/5", "special"), ("f800::/6", "special"), ("fe00::/9", "special"), ("ff00::/8", "special"),
)
_GROUPS = "^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times; the value is worked out once a row and stands once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _four_digits(groups: Column) -> Column:
    """Groups of one to four digits, joined by colons, as four digits each."""
    return F.regexp_replace(F.regexp_replace(groups, "([0-9a-f]+)", "000$1"), "[0-9a-f]*([0-9a-f]{4})(:|$)", "$1")


def ipv6_digits(address: Column) -> Column:
    """IPv6 text as 32 lower-case hexadecimal digits, which sort like the addresses; NULL for anything else.

    A zone after ``%`` is left out; the last two groups may be dotted quads. A double colon stands for one or more groups of zeros.
    """
    def quad_as_groups(text):
        quad = F.regexp_extract(text, r"[^:]*$", 0)
        both = lambda tail: F.concat(F.regexp_extract(text, r"^.*:", 0), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
        return F.when(F.contains(quad, F.lit(".")), _let(F.lpad(F.lower(F.hex(ipv4_number(quad))), 8, "0"), both)).otherwise(text)

    def halves(text):
        gap = F.lit("::")
        parts = [F.split_part(text, gap, F.lit(i)) for i in (1, 2)]
        gaps = F.length(text) - F.length(F.replace(text, gap, F.lit("")))
        return F.when(parts[0].rlike(_GROUPS) & parts[1].rlike(_GROUPS) & gaps.isin(0, 2), F.struct(
            _four_digits(parts[0]).alias("first"), _four_digits(parts[1]).alias("last"), (gaps == 2).alias("gap")))

    def joined(h):
        known = F.length(h["first"]) + F.length(h["last"])
        fits = (h["gap"] & (known <= 28)) | (~h["gap"] & (known == 32))
        return F.when(fits, F.concat(h["first"], F.repeat(F.lit("0"), 32 - known), h["last"]))

    text = F.lower(F.regexp_replace(address, "%[^%]+$", ""))
    return F.when(F.contains(address, F.lit(":")), _let(_let(_let(text, quad_as_groups), halves), joined))


def _bounds(network: str) -> tuple[str, str]:
    net = ipaddress.IPv6Network(network)
    return f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"


def ipv6_class(address: Column) -> Column:
    """internal, special, external or invalid; an address that maps an IPv4 address has that one's class."""
    def named(digits):
        mapped = F.concat_ws(".", *[F.conv(F.substring(digits, i, 2), 16, 10) for i in range(25, 33, 2)])
        out = F.when(digits.isNull(), "invalid").when(digits.startswith("0" * 20 + "ffff"), ipv4_class(mapped))
        for network, kind in V6_NETWORKS:
            out = out.when(digits.between(*_bounds(network)), kind)
        return out.otherwise("external")

    return _let(ipv6_digits(address), named)


def address_class(address: Column) -> Column:
    """Class of an address of either family."""
    return F.when(F.coalesce(F.contains(address, F.lit(":")), F.lit(False)), ipv6_class(address)).otherwise(ipv4_class(address))


def with_address_class(df: DataFrame, address: str, out: str) -> DataFrame:
    return df.withColumn(out, address_class(F.col(address)))


def port_number(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number.between(0, 65535), number.try_cast("int"))


def protocol_number(text: Column) -> Column:
    return text.try_cast("smallint")
