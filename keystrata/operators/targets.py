"""Remotes and addresses that a scan is pointed at, and the numbers of its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.functions.arrays import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _host_fits(host: Column) -> Column:
    return (F.length(host) <= 253) & F.forall(F.split(host, r"\.", -1), lambda label: F.rlike(label, F.lit("^[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?$")))


def _path_fits(path: Column) -> Column:
    return F.rlike(path, F.lit("^[A-Za-z0-9._~/-]+$")) & ~F.substring(path, 1, 1).isin("/", "-") & ~F.array_contains(F.split(path, "/"), "..")


def remotes(targets: DataFrame) -> DataFrame:
    """transport, host and port (of https only) of each git remote in its https, ssh or user@host:path form; other text gives no row."""
    raw = F.col("raw")
    https, ssh = F.startswith(raw, F.lit("https://")), F.startswith(F.lower(raw), F.lit("ssh://"))
    rest = F.when(https, F.substring(raw, 9, 1 << 30)).when(ssh, F.substring(raw, 7, 1 << 30)).otherwise(F.regexp_replace(raw, "^([^:]*):", "$1/"))
    authority = F.substring_index(rest, "/", 1)
    user = F.when(F.contains(authority, F.lit("@")), F.substring_index(authority, "@", 1))
    place = F.when(user.isNull(), authority).otherwise(F.substring(authority, F.length(user) + 2, 1 << 30))
    port = F.regexp_extract(place, r":([0-9]{1,5})$", 1)
    host = F.when(port == "", place).otherwise(F.substring(place, F.lit(1), F.length(place) - F.length(port) - 1))
    number = F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.when(https, 443).otherwise(22))
    path = F.substring(rest, F.length(authority) + 2, 1 << 30)
    users = F.when(https, user.isNull()).when(ssh, user.isNull() | F.rlike(user, F.lit("^[A-Za-z0-9._-]+$"))).otherwise(F.contains(raw, F.lit(":")) & F.rlike(user, F.lit("^[A-Za-z0-9._-]+$")))
    hosts = _host_fits(host) | https & F.rlike(host, F.lit(r"^\[[0-9A-Fa-f:.]+\]$"))
    rows = targets.where(F.contains(rest, F.lit("/")) & users & hosts & _path_fits(path) & number.between(1, 65535))
    return rows.withColumns({"transport": F.when(https, "https").otherwise("ssh"), "host": F.lower(host), "port": F.when(https, number)})


def blocked_ipv4(value: Column) -> Column:
    """Whether an IPv4 address, as a number, must not be reached."""
    out = F.lit(False)
    for low, high in map(dims.cidr_bounds, dims.BLOCKED_IPV4):
        out = out | value.between(low, high)
    return out


def ipv6_hex(text: Column) -> Column:
    """The 16 bytes of an IPv6 text as 32 hexadecimal digits, a zone left out; null if it is none."""
    plain = F.trim(F.lower(F.substring_index(text, "%", 1)))
    tail = F.substring_index(plain, ":", -1)
    octets = F.transform(F.split(tail, r"\."), lambda o: F.lpad(F.hex(o.try_cast("long")), 2, "0"))
    dotted = F.rlike(tail, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    quad = F.concat(F.array_join(F.slice(octets, 1, 2), ""), F.lit(":"), F.array_join(F.slice(octets, 3, 2), ""))
    whole = F.when(dotted, F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(tail)), F.lower(quad))).otherwise(plain)

    def read(halves):
        own = lambda k: F.when(F.coalesce(F.get(halves, F.lit(k)), F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.get(halves, F.lit(k)), ":", -1))
        given = F.size(own(0)) + F.size(own(1))
        fits = F.forall(F.concat(own(0), own(1)), lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$"))) & F.when(F.size(halves) == 1, given == 8).otherwise((F.size(halves) == 2) & (given <= 7))
        wide = lambda k: F.array_join(F.transform(own(k), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(fits, F.concat(wide(0), F.repeat(F.lit("0000"), F.greatest(8 - given, F.lit(0))), wide(1)))

    return F.when(F.contains(plain, F.lit(":")), let(F.split(whole, "::", -1), read))


def address_policy_v6(addresses: DataFrame) -> DataFrame:
    """Whether each IPv6 text may be reached: global unicast outside its reserved blocks, or an embedded IPv4 address that may be; what is no address may not."""
    own = ipv6_hex(F.col("ip"))

    def allowed(hexed):
        number = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")
        begins = lambda *ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.startswith(hexed, p))
        last = begins("0" * 20 + "ffff", "0" * 16 + "ffff0000", "0064ff9b" + "0" * 16)
        public = begins("2", "3") & ~begins("200100", "200101", "20010db8", "3fff0")
        return F.when(last, ~blocked_ipv4(number(25))).when(begins("2002"), ~blocked_ipv4(number(5))).otherwise(public)

    return addresses.withColumn("allowed", F.coalesce(let(own, allowed), F.lit(False)))


def profile_faults(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``fault``: the first number that the arithmetic of risk can't use, or null."""
    number = lambda c: F.coalesce(~F.isnan(F.col(c).cast("double")), F.lit(False))
    bad = lambda c, fits: ~(number(c) & F.coalesce(fits, F.lit(False)))
    fault = F.when(F.col("today").try_cast("date").isNull(), "today").when(bad("crqc_year", F.col("crqc_year").between(1990, 2200)), "crqc_year")
    fault = fault.when(bad("migration_years", (F.col("migration_years") > 0) & (F.col("migration_years") <= 100)), "migration_years").when(bad("horizon_years", F.col("horizon_years") >= 0), "horizon_years")
    return profiles.withColumn("fault", fault.when(bad("sensitivity", F.col("sensitivity").between(0, 1)), "sensitivity"))
