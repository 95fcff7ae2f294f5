"""Names of the object identifiers that signatures of certificates go by."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arcs, and the names by the numbers below them.
RSA, ECDSA, NIST, XMSS = "1.2.840.113549.1.1", "1.2.840.10045.4", "2.16.840.1.101.3.4.3", "1.3.6.1.5.5.7.6"
RSA_DIGESTS = {2: "md2", 3: "md4", 4: "md5", 5: "sha1", 11: "sha256", 12: "sha384", 13: "sha512", 14: "sha224"}
SINGLE = {
    f"{RSA}.10": "rsassaPss",
    "1.2.840.10040.4.3": "dsaWithSHA1",
    f"{NIST}.1": "dsaWithSHA224",
    f"{NIST}.2": "dsaWithSHA256",
    f"{ECDSA}.1": "ecdsaWithSHA1",
    "1.3.101.112": "Ed25519",
    "1.3.101.113": "Ed448",
    "1.2.840.113549.1.9.16.3.17": "HSS-LMS",
    f"{XMSS}.34": "XMSS",
    f"{XMSS}.35": "XMSSMT",
}


def _table() -> dict[str, str]:
    """Single names, then the runs of numbers: ECDSA by digest, ML-DSA and SLH-DSA by parameters, and both with a digest before them."""
    out = SINGLE | {f"{RSA}.{n}": f"{digest}WithRSAEncryption" for n, digest in RSA_DIGESTS.items()}
    out |= {f"{ECDSA}.3.{k}": f"ecdsaWithSHA{bits}" for k, bits in enumerate((224, 256, 384, 512), 1)}
    lattice = [f"ML-DSA-{size}" for size in (44, 65, 87)]
    sets = list(product(("SHA2", "SHAKE"), (128, 192, 256), "sf"))
    hashed = [f"Hash{name}-with-SHA512" for name in lattice]
    for family, size, speed in sets:
        digest = {"SHA2": "SHA256" if size == 128 else "SHA512", "SHAKE": "SHAKE128" if size == 128 else "SHAKE256"}[family]
        hashed.append(f"HashSLH-DSA-{family}-{size}{speed}-with-{digest}")
    pure = lattice + [f"SLH-DSA-{family}-{size}{speed}" for family, size, speed in sets]
    return out | {f"{NIST}.{n}": name for n, name in enumerate(pure + hashed, 17)}


NAMES = _table()


def signature_name(oid: Column) -> Column:
    """The name of a signature's identifier; null for one that is unknown or null."""
    return F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))[oid]
