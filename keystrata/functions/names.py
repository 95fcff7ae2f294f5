"""What a text may show, and what a name tells: escaped control characters, slugs, and the role of a weak digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.arrays import let

_UNSAFE = r"[\x00-\x08\x0A-\x1F\x7F-\x9F\u2028-\u202E\u2066-\u2069]"

# Parts of names, and whole words, that tell of a digest made for security, and of one that is not.
SECURITY_PARTS = "password passwd passphrase secret signature credential hmac integrity".split()
SECURITY_WORDS = "pwd token sign signed signer signing verify verifier auth authenticate authentication cert certificate salt nonce otp session apikey privatekey jwt csrf login".split()
OTHER_PARTS = "entitytag cachekey cachebust checksum dedup contenthash filehash assethash chunkhash objectid gitoid websocket 258eafa5e91447da".split()
OTHER_WORDS = "etag cache cached caching oid uuid shard bucket partition git wsaccept".split()


def sanitized(text: Column) -> Column:
    """The text with control characters (but tabs), line separators and direction marks as ``\\xHH`` or ``\\uHHHH``."""
    pieces = F.split(text, f"(?<={_UNSAFE})|(?={_UNSAFE})", -1)
    code = lambda c: F.lower(F.hex(F.ascii(c)))
    shown = lambda c: F.when(F.ascii(c) < 256, F.concat(F.lit("\\x"), F.lpad(code(c), 2, "0"))).otherwise(F.concat(F.lit("\\u"), F.lpad(code(c), 4, "0")))
    return F.when(~F.rlike(text, F.lit(_UNSAFE)), text).otherwise(F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"^{_UNSAFE}$")), shown(p)).otherwise(p)), ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def digest(text: Column) -> Column:
    """A short name that stays the same: the first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def endpoint(host: Column, port: Column) -> Column:
    """A TLS endpoint as ``tls://host:port``, IPv6 hosts in brackets; no or zero ports are left out."""
    own = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(F.lit("tls://"), own, F.when(port != 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(""))


def rule_named(category: Column, label: Column) -> Column:
    """A rule's name from what a finding is about, without saying its category twice."""
    about = slug(label)
    prefix = F.concat(category, F.lit("-"))
    rest = F.when(F.startswith(about, prefix), F.substring(about, F.length(prefix) + 1, F.length(about))).otherwise(about)
    return F.concat(category, F.lit("/"), F.when(rest == "", "finding").otherwise(rest))


def _words(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])(?=[A-Z])", "$1 "), "([A-Z])(?=[A-Z][a-z])", "$1 ")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def _role(name: Column) -> Column:
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    holds = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(flat, p))

    def told(words):
        pairs = F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, b)), lambda p: p.isNotNull())
        has = lambda known: F.arrays_overlap(F.concat(words, pairs), F.array(*map(F.lit, known)))
        return F.when(holds(SECURITY_PARTS) | has(SECURITY_WORDS), "security").when(holds(OTHER_PARTS) | has(OTHER_WORDS), "non-security")

    return let(_words(name), told)


def digest_role(line: Column, read: int = 32, digits: bool = False) -> Column:
    """Struct of role and signal: what the first names of a line tell of the digest made there; a security word wins. Null if none tells. With ``digits`` names may begin with one."""
    names = F.slice(F.regexp_extract_all(line, F.lit(rf"[A-Za-z_{'0-9' * digits}][A-Za-z0-9_-]{{0,63}}"), F.lit(0)), 1, read)
    roles = F.transform(names, lambda n: F.struct(_role(n).alias("role"), n.alias("signal")))
    first = lambda own, role: F.get(F.filter(own, lambda r: r["role"] == role), F.lit(0))
    return let(roles, lambda own: F.coalesce(first(own, "security"), first(own, "non-security")))
