"""Dimensions: fixed values that rules refer to. Each table is small and may be broadcast."""

from __future__ import annotations

# Ranks, best or worst first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
PQ_STATUSES = ("vulnerable", "transitional", "unknown", "safe")

# Data classes as (id, horizon in years, sensitivity, obligations).
DATA_CLASSES = (
    ("legal-privileged", 30, 1.0, ("aba-1.6c", "hndl")),
    ("medical-phi", 25, 0.95, ("hipaa", "hndl")),
    ("government-cui", 25, 1.0, ("cnsa-2.0", "hndl")),
    ("financial-pii", 10, 0.8, ("hndl",)),
    ("secrets", 5, 0.9, ("hndl",)),
    ("general", 7, 0.5, ("hndl",)),
    ("public", 0, 0.0, ()),
)
# Which failures breach an obligation.
OBLIGATIONS = (
    ("hndl", ("confidentiality",)),
    ("cnsa-2.0", ("confidentiality", "identity", "cnsa2-algorithms")),
    ("aba-1.6c", ("confidentiality", "classical-strength")),
    ("hipaa", ("confidentiality", "classical-strength")),
)
CRQC_YEARS = (2026, 2028, 2030, 2033, 2035, 2040, 2050)

# Usage of a finding by its rule.
USAGE_BY_RULE = {
    "tls/hybrid-kex": ("key-establishment",),
    "tls/leaf-public-key": ("authentication",),
    "tls/leaf-signature": ("signature",),
    "tls/chain-classical": ("signature",),
    "tls/intermediate-signature": ("signature",),
    "tls/negotiated-protocol": ("protocol",),
}
HARVEST = ("key-establishment", "encryption", "protocol")
FORGE = ("signature", "authentication")

# Post-quantum TLS groups as (name, mechanism, hybrid).
PQ_GROUPS = (
    ("X25519MLKEM768", "ML-KEM-768", True),
    ("SecP256r1MLKEM768", "ML-KEM-768", True),
    ("MLKEM768", "ML-KEM-768", False),
    ("SecP384r1MLKEM1024", "ML-KEM-1024", True),
    ("MLKEM1024", "ML-KEM-1024", False),
)
# How ciphers of a session without an ephemeral key exchange begin.
STATIC_RSA_CIPHERS = ("AES", "ARIA", "CAMELLIA", "DES", "IDEA", "NULL", "RC2", "RC4", "SEED")
CLASSICAL_KEYS = ("rsa", "rsa-pss", "dsa", "ec", "ed25519", "ed448", "x25519", "x448", "dh")

# IPv4 blocks that a scan must not reach.
BLOCKED_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()

# Directories that are never scanned, anywhere below the root.
SKIPPED_DIRS = (
    "node_modules .git dist build coverage .next out vendor .turbo target .venv venv .tox .nox __pycache__ .mypy_cache .pytest_cache .ruff_cache"
).split()
MANIFEST_FILES = (
    "package.json package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lock Cargo.lock poetry.lock uv.lock Pipfile.lock composer.lock Gemfile.lock"
).split()

# Registry of libraries: (ecosystem, name, severity, pq status, fixed in). Users extend it as a table.
# A severity that the reference's tree does not tell is null.
REGISTRY = (
    ("npm", "jsonwebtoken", "high", "vulnerable", None),
    ("npm", "node-forge", "medium", "vulnerable", None),
    ("npm", "crypto-js", "medium", "unknown", None),
    ("npm", "elliptic", "high", "vulnerable", None),
    ("pypi", "rsa", "high", "vulnerable", None),
    ("pypi", "pyjwt", "medium", "vulnerable", None),
    ("pypi", "cryptography", "medium", "vulnerable", "48.0.0"),
    ("crates", "ring", "medium", "vulnerable", None),
    ("crates", "rustls", "medium", "vulnerable", "0.23.22"),
    ("crates", "ed25519-dalek", "medium", "vulnerable", None),
    ("npm", "tweetnacl", None, "vulnerable", None),
    ("npm", "openpgp", None, "vulnerable", None),
    ("npm", "node-rsa", None, "vulnerable", None),
    ("npm", "jsrsasign", None, "vulnerable", None),
    ("pypi", "python-jose", None, "vulnerable", None),
    ("pypi", "ecdsa", None, "vulnerable", None),
    ("pypi", "pycryptodome", None, "unknown", None),
    ("pypi", "pynacl", None, "vulnerable", None),
    ("pypi", "paramiko", None, "vulnerable", None),
    ("pypi", "pyopenssl", None, "unknown", None),
    ("pypi", "liboqs-python", None, "transitional", None),
    ("crates", "rsa", None, "vulnerable", None),
    ("crates", "x25519-dalek", None, "vulnerable", None),
    ("crates", "p256", None, "vulnerable", None),
    ("crates", "openssl", None, "unknown", None),
    ("crates", "oqs", None, "unknown", None),
    ("crates", "pqcrypto", None, "unknown", None),
)

# What libraries provide, as (ecosystem, name, algorithms), by their public documentation. Users extend it as a table.
PROVIDED = (
    ("npm", "jsonwebtoken", "JWT-RS256 JWT-ES256 JWT-PS256 JWT-HS256"),
    ("npm", "node-forge", "RSA Ed25519"),
    ("npm", "crypto-js", "AES 3DES RC4 MD5 SHA-1 SHA-256"),
    ("npm", "elliptic", "ECDSA ECDH Ed25519"),
    ("npm", "tweetnacl", "X25519 Ed25519"),
    ("npm", "openpgp", "RSA ECDSA ECDH Ed25519 X25519"),
    ("npm", "node-rsa", "RSA"),
    ("npm", "jsrsasign", "RSA DSA ECDSA"),
    ("pypi", "rsa", "RSA"),
    ("pypi", "pyjwt", "JWT-RS256 JWT-ES256 JWT-HS256"),
    ("pypi", "cryptography", "RSA ECDSA ECDH X25519 Ed25519"),
    ("pypi", "python-jose", "JWT-RS256 JWT-ES256 JWT-HS256"),
    ("pypi", "ecdsa", "ECDSA ECDH Ed25519"),
    ("pypi", "pycryptodome", "RSA DSA ECDSA ElGamal AES 3DES"),
    ("pypi", "pynacl", "X25519 Ed25519 XSalsa20-Poly1305"),
    ("pypi", "paramiko", "RSA ECDSA Ed25519 DH"),
    ("pypi", "pyopenssl", "RSA DSA EC"),
    ("pypi", "liboqs-python", "ML-KEM ML-DSA SLH-DSA"),
    ("crates", "ring", "RSA ECDSA Ed25519 X25519"),
    ("crates", "rustls", "ECDHE X25519 RSA ECDSA"),
    ("crates", "ed25519-dalek", "Ed25519"),
    ("crates", "x25519-dalek", "X25519"),
    ("crates", "rsa", "RSA"),
    ("crates", "p256", "ECDSA-P-256 ECDH-P-256"),
    ("crates", "openssl", "RSA DSA ECDSA ECDH DH"),
    ("crates", "oqs", "ML-KEM ML-DSA SLH-DSA"),
    ("crates", "pqcrypto", "ML-KEM ML-DSA SLH-DSA"),
)


def cidr_bounds(block: str) -> tuple[int, int]:
    base, bits = block.split("/")
    n = sum(int(o) << s for o, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
    return n, n + (1 << (32 - int(bits))) - 1
