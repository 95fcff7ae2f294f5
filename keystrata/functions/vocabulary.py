"""What an algorithm label says: primitive, NIST quantum security level, and whether its use is broken or weak today.

A label is lower-cased and its runs of other characters than letters and digits become single
dashes. It is looked up whole in a table of names, then by its first part in a table of
families, whose level may hang on the first size in the label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions import oids

_SIZES = {"128": 1, "192": 3, "256": 5}
_KEM = {"512": 1, "768": 3, "1024": 5}
_DSA = {"44": 2, "65": 3, "87": 5}


def _names() -> dict[str, tuple[str, int | None]]:
    """Whole labels with their primitive and level."""
    out: dict[str, tuple[str, int | None]] = {}

    def add(primitive: str, level: int | None, names: str) -> None:
        out.update(dict.fromkeys(names.split(), (primitive, level)))

    # Labels of one spelling.
    add("other", 0, "jwt-none")
    add("mac", None, "jwt-hs256 jwt-hs384 jwt-hs512")
    add("signature", 0, "jwt-rs256 jwt-rs384 jwt-rs512 jwt-ps256 jwt-ps384 jwt-ps512 jwt-es256 jwt-es256k jwt-es384 jwt-es512 jwt-eddsa jwt-ed25519 jwt-ed448")
    add("pke", 0, "jwt-rsa1-5 jwt-rsa-oaep jwt-rsa-oaep-256 jwt-rsa-oaep-384 jwt-rsa-oaep-512 static-rsa-key-exchange")
    add("key-agree", 0, "jwt-ecdh-es jwt-ecdh-es-a128kw jwt-ecdh-es-a192kw jwt-ecdh-es-a256kw")
    add("kem", None, "ml-kem mlkem")
    add("signature", None, "ml-dsa slh-dsa hashml-dsa hashslh-dsa hss-lms lms xmss xmssmt")
    add("signature", 0, "ec rsa-pss rsassa-pss rsassapss rsa dsa eddsa ed25519 ed448")
    add("key-agree", 0, "x25519 x448")
    add("pke", 0, "ecies elgamal")
    add("hash", 0, "md2 md4 md5 sha1 sha-1")
    add("hash", 2, "sha256 sha-256 sha3-256")
    add("hash", 4, "sha384 sha-384 sha3-384")
    add("hash", None, "sha224 sha-224 sha512 sha-512 sha3-224 sha3-512 ripemd160 ripemd-160 blake2 blake2b blake2s blake3")
    add("xof", None, "shake128 shake256")
    add("ae", None, "chacha20-poly1305 xsalsa20-poly1305")
    add("stream-cipher", None, "salsa20 xsalsa20 chacha20")
    # The families whose names come from their parameters.
    for size, level in _KEM.items():
        add("kem", level, " ".join([f"ml-kem-{size}", f"mlkem-{size}", f"mlkem{size}", f"ml-kem{size}", *(f"{c}mlkem{size}" for c in ("x25519", "secp256r1", "secp384r1"))]))
    for size, level in _DSA.items():
        add("signature", level, " ".join(f"{h}ml-dsa-{size}{end}" for h in ("", "hash") for end in ("", "-with-sha512")))
    for size, level in _SIZES.items():
        kinds = [f"slh-dsa-{f}-{size}{v}" for f in ("sha2", "shake") for v in "sf"]
        add("signature", level, " ".join(f"{h}{k}{end}" for h in ("", "hash") for k in kinds for end in ("", "-with-sha256", "-with-sha512", "-with-shake128", "-with-shake256")))
    for digest in ("md2", "md4", "md5", "sha", "sha1", "sha224", "sha256", "sha384", "sha512"):
        add("signature", 0, f"{digest}withrsaencryption dsawith{digest} ecdsawith{digest}")
    return out


NAMES = _names()

# Fixed values: (first parts, what may follow, primitive, level). What follows is nothing but a number, or anything.
FAMILIES = (
    ("rsa rsapss dsa", "number", "signature", 0),
    ("ecdsa rsassa", "any", "signature", 0),
    ("ecdh ecdhe", "any", "key-agree", 0),
    ("dh dhe ffdhe", "number", "key-agree", 0),
    ("rsaoaep rsaes", "any", "pke", 0),
    ("hmac", "any", "mac", None),
    ("pbkdf2 hkdf", "any", "kdf", None),
    ("blake2 blake2b blake2s", "number", "hash", None),
    ("des desx desede tripledes 3des des3 rc2 arc2", "any", "block-cipher", 0),
    ("rc4 arc4 arcfour", "any", "stream-cipher", 0),
    ("camellia bf blowfish", "any", "block-cipher", None),
)

# Parts of a label that tell a use that is broken without a quantum computer.
BROKEN = (
    ("collision-broken digest", "md2 md4 md5"),
    ("sha-1", "sha1"),
    ("broken cipher", "des desx desede tripledes rc2 rc4 arc4 arcfour"),
)
# Labels that CNSA 2.0 names, and first parts of labels of public-key algorithms.
CNSA2 = tuple("ml-kem-1024 ml-kem1024 mlkem-1024 mlkem1024 secp384r1mlkem1024 ml-dsa-87 ml-dsa-87-with-sha512 hashml-dsa-87 hashml-dsa-87-with-sha512 hss-lms lms xmss xmssmt".split())
PUBLIC_KEY = tuple("rsa rsassa dsa ec ecdsa ecdh ecdhe dh dhe ffdhe x25519 x448 ed25519 ed448 eddsa ml mlkem slh hashml hashslh static".split())


# Curves by the names that labels give them, with their own name and strength; strengths of moduli; strengths of DES by what follows.
CURVES = {
    ("p-192", "prime192v1", "secp192r1"): ("secp192r1", 80),
    ("secp192k1",): ("secp192k1", 80),
    ("p-224", "secp224r1"): ("secp224r1", 112),
    ("p-256", "prime256v1", "secp256r1"): ("secp256r1", 128),
    ("p-384", "secp384r1"): ("secp384r1", 192),
    ("p-521", "secp521r1"): ("secp521r1", 256),
    ("secp256k1",): ("secp256k1", 128),
    ("brainpoolp256r1",): ("brainpoolP256r1", 128),
    ("brainpoolp384r1",): ("brainpoolP384r1", 192),
    ("brainpoolp512r1",): ("brainpoolP512r1", 256),
    ("x25519",): ("Curve25519", 128),
    ("x448",): ("Curve448", 224),
}
MODULI = {"1024": 80, "2048": 112, "3072": 128, "7680": 192, "15360": 256}
# Curve and strength of the signatures that JOSE names.
JOSE_CURVES = {"jwt-es256": ("secp256r1", 128), "jwt-es256k": ("secp256k1", 128), "jwt-es384": ("secp384r1", 192), "jwt-es512": ("secp521r1", 256), "jwt-ed25519": ("Ed25519", 128), "jwt-ed448": ("Ed448", 224)}
MODES = "cbc ecb ccm gcm cfb ofb ctr"
FRIENDLY = {"prime256v1": "P-256", "secp256r1": "P-256", "secp384r1": "P-384", "secp521r1": "P-521"}


def normal(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-|-$", "")


def _head(label: Column) -> Column:
    """First part of a normal label, without a size at its end if the rest is a family's name."""
    first = F.element_at(F.split(label, "-"), 1)
    short = F.regexp_replace(first, "[0-9]+$", "")
    sized = [h for heads, follows, *_ in FAMILIES if follows == "number" for h in heads.split()] + ["aes", "camellia"]
    return F.when(short.isin(*sized), short).otherwise(first)


def described(label: Column) -> Column:
    """Struct of primitive and level; both null for a null label, ``unknown`` for one that no row fits."""
    own = normal(label)
    head, size = _head(own), F.regexp_extract(own, "(128|192|256)", 1)
    rest = F.regexp_replace(own, "^[a-z]+", "")
    number = F.rlike(rest, F.lit("^-?[0-9]*$"))
    pair = lambda primitive, level: F.struct(F.lit(primitive).alias("primitive"), (level if isinstance(level, Column) else F.lit(level)).cast("int").alias("level"))
    aes = F.when(size == "128", 1).when(size == "192", 3).when(size == "256", 5)
    out = F.struct(F.when(label.isNotNull(), "unknown").alias("primitive"), F.lit(None).cast("int").alias("level"))
    out = F.when(F.startswith(own, F.lit("jwt-")), out).otherwise(
        F.when(head == "aes", F.when(F.rlike(own, F.lit("gcm|ccm")), pair("ae", aes)).otherwise(pair("block-cipher", aes))).otherwise(out)
    )
    for heads, follows, primitive, level in reversed(FAMILIES):
        fits = head.isin(*heads.split()) & (number if follows == "number" else F.lit(True))
        out = F.when(fits, pair(primitive, level)).otherwise(out)
    alike = F.rlike(label, F.lit("/")) & F.forall(F.split(F.lower(label), "/"), lambda p: p.isin("rsa", "dsa", "ecdsa"))
    out = F.when(F.contains(own, F.lit("kyber")), pair("kem", None)).when(alike, pair("signature", 0)).when(F.startswith(own, F.lit("rsa-oaep")), pair("pke", 0)).otherwise(out)
    for kind in sorted(set(NAMES.values()), key=repr):
        out = F.when(own.isin(*(n for n, k in NAMES.items() if k == kind)), pair(*kind)).otherwise(out)
    return out


def cnsa2_standing(label: Column) -> Column:
    """True for what CNSA 2.0 names, false for other public-key algorithms, else null."""
    own = normal(label)
    public = _head(own).isin(*PUBLIC_KEY) | described(label)["primitive"].isin("kem", "key-agree", "pke", "signature")
    return F.when(own.isin(*CNSA2), True).when(public, False)


def broken(label: Column) -> Column:
    """Why a label's use is broken today, or null."""
    parts = F.regexp_extract_all(F.replace(F.lower(label), F.lit("sha-"), F.lit("sha")), F.lit("[a-z]+[0-9]*"), F.lit(0))
    out = F.when(normal(label) == "jwt-none", "alg none")
    for reason, names in reversed(BROKEN):
        out = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, names.split()))), reason).otherwise(out)
    return out


def below_strength(label: Column) -> Column:
    """Whether the label names a key below 2,048 bits, or a curve below 224."""
    own = normal(label)
    head, size = _head(own), F.regexp_extract(own, "([0-9]{3,5})$", 1).try_cast("int")
    curve = F.regexp_extract(F.regexp_replace(own, "^[a-z]+", ""), "([0-9]{3})", 1).try_cast("int")
    return F.coalesce(F.when(head.isin("rsa", "dsa", "dh", "dhe", "ffdhe"), size < 2048).when(head.isin("ecdsa", "ecdh", "ecdhe"), curve < 224), F.lit(False))


def _found(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def details(label: Column) -> Column:
    """Struct of parameter_set, curve, bits (classical strength) and mode of a label; each is null where the label does not tell it."""
    own = normal(label)
    head = _head(own)
    after = F.when(head.isin("ecdsa", "ecdh", "ecdhe"), F.nullif(F.regexp_extract(own, "^[a-z]+-(.+)$", 1), F.lit("")))
    plain = F.when(own.isin("x25519", "x448"), own)
    by_name = {name: kind for names, kind in CURVES.items() for name in names}
    place = F.coalesce(after, plain)
    written = F.nullif(F.regexp_extract(label, "^[A-Za-z]+-(.+)$", 1), F.lit("unknown-curve"))
    edwards = F.when(own == "ed25519", "Ed25519").when(own == "ed448", "Ed448")
    hybrid = F.when(F.rlike(own, F.lit("^(?:x25519|secp256r1|secp384r1)mlkem[0-9]+$")), F.regexp_replace(F.regexp_extract(own, "^(.*)mlkem", 1), "^x25519$", "Curve25519"))
    curve = F.coalesce(_found({n: c for n, (c, _) in by_name.items()}, place), F.when(after.isNotNull(), written), edwards, _found({n: c for n, (c, _) in JOSE_CURVES.items()}, own), hybrid)

    digits = F.nullif(F.regexp_extract(own, "([0-9]+)$", 1), F.lit(""))
    modulus = F.when(F.rlike(own, F.lit("^(?:(?:rsa|rsa-pss|dsa)-[0-9]+|(?:ffdhe|dhe?)-?[0-9]{3,5})$")), digits)
    cipher = F.when(head.isin("aes", "camellia"), F.nullif(F.regexp_extract(own, "^(?:aes|camellia)-?(128|192|256)", 1), F.lit("")))
    digest = F.when(F.rlike(own, F.lit("^(?:sha-?|sha3-)(?:224|256|384|512)$")), digits)
    keyed = F.nullif(F.regexp_extract(own, "^(?:jwt-hs|hmac-sha-?)(224|256|384|512)$", 1), F.lit(""))
    lattice = F.when(F.rlike(own, F.lit("^(?:ml-?kem|(?:hash)?ml-dsa)-?[0-9]+(?:-with-sha512)?$")), F.regexp_extract(own, "^[a-z-]+([0-9]+)", 1)).when(hybrid.isNotNull(), digits)
    tree = F.when(F.rlike(own, F.lit("^(?:hash)?slh-dsa-(?:sha2|shake)-(?:128|192|256)[sf]")), F.concat(F.upper(F.regexp_extract(own, "slh-dsa-(sha2|shake)-", 1)), F.lit("-"), F.regexp_extract(own, "-((?:128|192|256)[sf])", 1)))
    des = F.when(F.rlike(own, F.lit("^(?:des-ede3|3des|tripledes|desede|des3)(?:-|$)")), 112).when(F.rlike(own, F.lit("^des-ede(?:-|$)")), 80).when(F.rlike(own, F.lit("^des(?:-|$)")), 56)
    ciphers = des.isNotNull() | head.isin("aes", "camellia", "desx", "rc2", "arc2")
    mode = F.when(ciphers, F.nullif(F.regexp_extract(own, f"-({MODES.replace(' ', '|')})[0-9]*$", 1), F.lit("")))
    bits = F.coalesce(
        _found({n: b for n, (_, b) in by_name.items()}, place), F.when(edwards == "Ed25519", 128).when(edwards == "Ed448", 224), _found(MODULI, modulus),
        cipher.cast("int"), (digest.cast("int") / 2).cast("int"), des, _found({n: b for n, (_, b) in JOSE_CURVES.items()}, own), F.when(F.rlike(own, F.lit("^ripemd-?160$")), 80),
    )
    return F.struct(F.coalesce(modulus, cipher, digest, lattice, tree, keyed).alias("parameter_set"), curve.alias("curve"), bits.alias("bits"), mode.alias("mode"))


def key_label(kind: Column, bits: Column, curve: Column) -> Column:
    """The label of a public key: its type with size, curve or parameters; ``unknown-key`` for types without a label, null included."""
    tree = F.concat(F.upper(F.regexp_extract(kind, "^(.*)[sf]$", 1)), F.regexp_extract(kind, "([sf])$", 1))
    named = F.coalesce(_found(FRIENDLY, curve), curve, F.lit("unknown-curve"))
    out = F.when(F.rlike(kind, F.lit("^slh-dsa-(?:sha2|shake)-[0-9]+[sf]$")), tree).when(F.rlike(kind, F.lit("^(?:ml-kem|ml-dsa|slh-dsa|hss-lms|xmss)")), F.upper(kind))
    out = out.when(kind.isin("rsa", "rsa-pss", "dsa"), F.concat(F.upper(kind), F.lit("-"), F.coalesce(bits.cast("string"), F.lit("?"))))
    return out.when(kind == "ec", F.concat(F.lit("ECDSA-"), named)).when(kind == "ed25519", "Ed25519").when(kind == "ed448", "Ed448").otherwise("unknown-key")


# Identifiers of whole labels, and of labels that begin with a name.
LABEL_OIDS = {
    "static-rsa-key-exchange": "1.2.840.113549.1.1.1", "jwt-rsa1-5": "1.2.840.113549.1.1.1", "jwt-ps256": "1.2.840.113549.1.1.10", "jwt-ps384": "1.2.840.113549.1.1.10", "jwt-ps512": "1.2.840.113549.1.1.10",
    "jwt-rs256": "1.2.840.113549.1.1.11", "jwt-rs384": "1.2.840.113549.1.1.12", "jwt-rs512": "1.2.840.113549.1.1.13",
    "jwt-es256": "1.2.840.10045.4.3.2", "jwt-es256k": "1.2.840.10045.4.3.2", "jwt-es384": "1.2.840.10045.4.3.3", "jwt-es512": "1.2.840.10045.4.3.4",
    "jwt-rsa-oaep": "1.2.840.113549.1.1.7", "jwt-rsa-oaep-256": "1.2.840.113549.1.1.7", "jwt-rsa-oaep-384": "1.2.840.113549.1.1.7", "jwt-rsa-oaep-512": "1.2.840.113549.1.1.7",
    "jwt-hs256": "1.2.840.113549.2.9", "jwt-hs384": "1.2.840.113549.2.10", "jwt-hs512": "1.2.840.113549.2.11", "jwt-ed25519": "1.3.101.112", "jwt-ed448": "1.3.101.113",
    "ec": "1.2.840.10045.2.1", "x25519": "1.3.101.110", "x448": "1.3.101.111", "ed25519": "1.3.101.112", "ed448": "1.3.101.113",
    "hss-lms": "1.2.840.113549.1.9.16.3.17", "lms": "1.2.840.113549.1.9.16.3.17", "xmss": "1.3.6.1.5.5.7.6.34", "xmssmt": "1.3.6.1.5.5.7.6.35",
    "md2": "1.2.840.113549.2.2", "md4": "1.2.840.113549.2.4", "md5": "1.2.840.113549.2.5", "sha1": "1.3.14.3.2.26", "ripemd160": "1.3.36.3.2.1",
    "sha256": "2.16.840.1.101.3.4.2.1", "sha384": "2.16.840.1.101.3.4.2.2", "sha512": "2.16.840.1.101.3.4.2.3", "sha224": "2.16.840.1.101.3.4.2.4",
    "sha3-224": "2.16.840.1.101.3.4.2.7", "sha3-256": "2.16.840.1.101.3.4.2.8", "sha3-384": "2.16.840.1.101.3.4.2.9", "sha3-512": "2.16.840.1.101.3.4.2.10",
    "hmac-md5": "1.3.6.1.5.5.8.1.1", "hmac-sha1": "1.2.840.113549.2.7", "hmac-sha224": "1.2.840.113549.2.8", "hmac-sha256": "1.2.840.113549.2.9", "hmac-sha384": "1.2.840.113549.2.10", "hmac-sha512": "1.2.840.113549.2.11",
    "des-cbc": "1.3.14.3.2.7", "des-ede3-cbc": "1.2.840.113549.3.7", "rc2-cbc": "1.2.840.113549.3.2", "rc4": "1.2.840.113549.3.4",
    "ml-kem-512": "2.16.840.1.101.3.4.4.1", "ml-kem-768": "2.16.840.1.101.3.4.4.2", "ml-kem-1024": "2.16.840.1.101.3.4.4.3",
}
BEGUN_OIDS = (
    ("^rsa-?oaep|^rsaes-oaep", "1.2.840.113549.1.1.7"),
    ("^rsassa-?pss(?:-|$)|^rsa-pss(?:-[0-9]+)?$", "1.2.840.113549.1.1.10"),
    ("^rsa(?:-[0-9]+)?$", "1.2.840.113549.1.1.1"),
    ("^dsa(?:-[0-9]+)?$", "1.2.840.10040.4.1"),
    ("^ecdsa(?:-.+)?$", "1.2.840.10045.2.1"),
    ("^pbkdf2(?:-(?:md5|sha-?[0-9]+))?$", "1.2.840.113549.1.5.12"),
)


def identifier(label: Column) -> Column:
    """The object identifier that a label stands for, or null: signatures by name, the others by whole label, then by how they begin."""
    own = normal(label)
    plain = F.regexp_replace(F.regexp_replace(own, "^((?:hmac-)?sha|ripemd)-([0-9])", "$1$2"), "^ml-?kem-?([0-9])", "ml-kem-$1")
    signed = {name.lower(): oid for oid, name in oids.NAMES.items()}
    signed |= {name.split("-with-")[0]: oid for name, oid in signed.items() if name.startswith("hash")}
    begun = F.lit(None).cast("string")
    for pattern, oid in reversed(BEGUN_OIDS):
        begun = F.when(F.rlike(own, F.lit(pattern)), oid).otherwise(begun)
    return F.when(~F.contains(label, F.lit("/")), F.coalesce(_found(LABEL_OIDS, plain), _found(signed, own), begun))


def refined(label: Column, uses: Column) -> Column:
    """Struct of primitive, level and oid of a label in the light of its uses (array): a plain RSA key that encrypts and does not sign is for encryption, an EC key that only agrees on keys is for agreement."""
    own, told = normal(label), described(label)
    signs = F.array_contains(uses, "signature")
    encrypts = F.rlike(own, F.lit("^rsa(?:-[0-9]+)?$")) & F.array_contains(uses, "encryption")
    agrees = (own == "ec") & F.array_contains(uses, "key-establishment") & ~F.array_contains(uses, "authentication")
    open_use = ~F.coalesce(signs, F.lit(False))
    return F.struct(
        F.when(open_use & encrypts, "pke").when(open_use & agrees, "key-agree").otherwise(told["primitive"]).alias("primitive"),
        told["level"].alias("level"),
        F.when(~(open_use & F.coalesce(agrees, F.lit(False))), identifier(label)).alias("oid"),
    )
