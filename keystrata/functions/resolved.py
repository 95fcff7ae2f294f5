"""The calls of the four JavaScript APIs as a table: where each carries its algorithm and what the algorithm makes of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import FRIENDLY

# Modules by the name they are imported under, helpers that hand a module through, objects that hold ``crypto``.
MODULES = {"crypto": "node:crypto", "node:crypto": "node:crypto", "jsonwebtoken": "jsonwebtoken", "jose": "jose"}
HELPERS = ("_interopRequireDefault", "_interopRequireWildcard", "__importDefault", "__importStar")
GLOBALS = ("window", "globalThis", "self", "global")
BUILDERS = ("SignJWT", "CompactSign", "FlattenedSign", "GeneralSign", "EncryptJWT", "CompactEncrypt", "FlattenedEncrypt", "GeneralEncrypt")

# Fixed values: (api, methods, distinctive: the name alone tells the API, where: kind and place of the argument, key of the options, family).
CALLS = (
    ("node:crypto", "createHash", True, "value", 0, "", "hash"),
    ("node:crypto", "hash", False, "value", 0, "", "hash"),
    ("node:crypto", "createCipheriv createDecipheriv createCipher createDecipher", True, "value", 0, "", "cipher"),
    ("node:crypto", "createHmac hkdf hkdfSync", False, "value", 0, "", "mac"),
    ("node:crypto", "pbkdf2 pbkdf2Sync", False, "value", 4, "", "mac"),
    ("node:crypto", "generateKeyPair generateKeyPairSync", True, "value", 0, "", "keypair"),
    ("node:crypto", "createSign createVerify", True, "value", 0, "", "signature"),
    ("node:crypto", "sign verify", False, "value", 0, "", "one-shot"),
    ("node:crypto", "createECDH", True, "value", 0, "", "ecdh"),
    ("node:crypto", "createDiffieHellman", True, "value", 0, "", "dh"),
    ("node:crypto", "createDiffieHellmanGroup getDiffieHellman", True, "value", 0, "", "dh-group"),
    ("node:crypto", "diffieHellman", True, "call", 0, "", "agreement"),
    ("node:crypto", "publicEncrypt privateDecrypt", True, "call", 0, "", "rsa"),
    ("node:crypto", "privateEncrypt publicDecrypt", True, "call", 0, "", "rsa-private"),
    ("webcrypto", "generateKey", False, "algorithm", 0, "", "web-key"),
    ("webcrypto", "importKey", False, "algorithm", 2, "", "web-key"),
    ("webcrypto", "unwrapKey", False, "algorithm", 4, "", "web-key"),
    ("webcrypto", "sign verify", False, "algorithm", 0, "", "web-sign"),
    ("webcrypto", "deriveKey deriveBits", False, "algorithm", 0, "", "web-derive"),
    ("webcrypto", "encrypt decrypt", False, "algorithm", 0, "", "web-encrypt"),
    ("webcrypto", "wrapKey unwrapKey", False, "algorithm", 3, "", "web-encrypt"),
    ("jsonwebtoken", "sign", False, "options", 2, "algorithm", "jwt-default"),
    ("jsonwebtoken", "verify", False, "options", 2, "algorithms", "jwt-required"),
    ("jose", "jwtVerify compactVerify flattenedVerify generalVerify", False, "options", 2, "algorithms", "jwt"),
    ("jose", "jwtDecrypt compactDecrypt flattenedDecrypt generalDecrypt", False, "options", 2, "keyManagementAlgorithms", "jwt"),
    ("jose", "importPKCS8 importSPKI importX509 importJWK", False, "value", 1, "", "jwt"),
    ("jose", "generateKeyPair generateSecret", False, "value", 0, "", "jwt"),
    ("jose", "setProtectedHeader", False, "options", 0, "alg", "jwt"),
    ("jose", "UnsecuredJWT", False, "call", 0, "", "unsecured"),
)
# Bits of the Diffie-Hellman groups with names.
GROUP_BITS = {"modp1": 768, "modp2": 1024, "modp5": 1536, "modp14": 2048, "modp15": 3072, "modp16": 4096, "modp17": 6144, "modp18": 8192}
# Classes of JWT algorithms, in the order they are tried.
JWT = (
    ("alg-none", "none"),
    ("hmac", "HS(?:256|384|512)"),
    ("rsa", "(?:RS|PS)(?:256|384|512)"),
    ("ecdsa", "ES(?:256K?|384|512)"),
    ("eddsa", "EdDSA|Ed25519|Ed448"),
    ("rsa-key-transport", "RSA1_5|RSA-OAEP(?:-(?:256|384|512))?"),
    ("ecdh-key-agreement", r"ECDH-ES(?:\+A(?:128|192|256)KW)?"),
)
#: A text with none of these holds no such call.
NAMES = ("create", "generate", "pbkdf2", "hkdf", "iffieHellman", "Encrypt", "Decrypt", "encrypt", "decrypt", "sign", "erify", "subtle", "import", "UnsecuredJWT", "hash", "setProtectedHeader")


def table() -> list[tuple]:
    """(api, method, distinctive, kind, place, key, family): a row for each call."""
    return [(api, m, *rest) for api, methods, *rest in CALLS for m in methods.split()]


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def jwt_class(alg: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(JWT):
        out = F.when(F.rlike(alg, F.lit(f"^(?:{pattern})$")), name).otherwise(out)
    return out


def _sized(family: Column, bits: Column) -> Column:
    return F.concat(family, F.coalesce(F.concat(F.lit("-"), bits.cast("string")), F.lit("")))


def group_bits(group: Column) -> Column:
    return F.coalesce(_map(GROUP_BITS, F.lower(group)), F.regexp_extract(group, r"(?i)^ffdhe(\d{4})$", 1).try_cast("int"))


def classified() -> dict[str, Column]:
    """Rule, algorithm, bits, curve and digest of a call, from the columns api, method, family, token, size, dynamic, absent and params."""
    family, token, method, api = F.col("family"), F.col("token"), F.col("method"), F.col("api")
    low, param = F.lower(token), lambda k: F.col("params")[k]
    number = lambda k: param(k).try_cast("int")
    node = lambda name: F.lit(f"source/node-crypto/{name}")
    web = lambda name: F.lit(f"source/webcrypto/{name}")
    weak = F.rlike(low, F.lit("^(?:md5|sha-?1)$"))
    digest_label = F.when(F.contains(low, F.lit("md5")), "MD5").otherwise("SHA-1")
    curve_of = lambda name: F.coalesce(_map(FRIENDLY, name), name)
    signer = F.when(F.contains(low, F.lit("ecdsa")), "ECDSA").when(F.contains(low, F.lit("dsa")), "DSA").when(F.contains(low, F.lit("rsa")), "RSA").otherwise("RSA/DSA/ECDSA")
    kinds = {"rsa": "rsa", "rsa-pss": "rsa", "dsa": "dsa", "ec": "ec", "ed25519": "eddsa", "ed448": "eddsa", "x25519": "xdh", "x448": "xdh", "dh": "dh"}
    names = {"ed25519": "Ed25519", "ed448": "Ed448", "x25519": "X25519", "x448": "X448"}
    webs = {"rsassa-pkcs1-v1_5": "rsa-sig", "rsa-pss": "rsa-sig", "rsa-oaep": "rsa-oaep", "ecdsa": "ecdsa", "ecdh": "ecdh", "ed25519": "eddsa", "ed448": "eddsa", "x25519": "xdh", "x448": "xdh"}
    kind, own = _map(kinds, low), _map(webs, low)
    web_curve = F.when(own.isin("ecdsa", "ecdh"), curve_of(param("namedCurve")))
    jwt = jwt_class(token)
    # the library knows key transport and agreement only in jose
    jwt_rule = F.when(jwt.isNotNull() & ((api == "jose") | ~jwt.isin("rsa-key-transport", "ecdh-key-agreement")), F.concat(F.lit("jwt/"), api, F.lit("/"), jwt))
    unresolved = F.concat(F.lit("jwt/"), api, F.lit("/algorithm-unresolved"))
    absent = F.col("absent")
    jwts = F.when(token.isNotNull(), jwt_rule).when(F.col("dynamic"), unresolved).when(absent & (family == "jwt-default"), F.lit("jwt/jsonwebtoken/hmac")).when(absent & (family == "jwt-required"), unresolved)
    bits = F.when((family == "keypair") & kind.isin("rsa", "dsa"), number("modulusLength")).when((family == "keypair") & (kind == "dh"), F.coalesce(number("primeLength"), group_bits(param("group"))))
    bits = bits.when(family == "dh", F.col("size")).when(family == "dh-group", group_bits(token)).when((family == "web-key") & own.isin("rsa-sig", "rsa-oaep"), number("modulusLength"))
    curve = F.when((family == "keypair") & (kind == "ec"), curve_of(param("namedCurve"))).when(family == "ecdh", curve_of(token)).when(family == "web-key", web_curve)
    digest = F.when(family.isin("signature", "one-shot"), token).when((family == "keypair") & (kind == "rsa"), F.coalesce(param("hashAlgorithm"), param("hash"))).when((family.isin("web-key", "web-sign")) & own.isin("rsa-sig", "rsa-oaep", "ecdsa"), param("hash"))
    rule = (
        F.when((family == "hash") & weak, node("weak-hash")).when((family == "mac") & weak, node("legacy-digest")).when((family == "cipher") & F.rlike(low, F.lit("des|rc4|rc2")), node("weak-cipher"))
        .when((family == "keypair") & kind.isNotNull(), F.concat(node("keygen-"), kind)).when(family == "signature", node("signature")).when((family == "one-shot") & token.isNotNull(), node("signature"))
        .when(family == "ecdh", node("ecdh")).when(family.isin("dh", "dh-group"), node("dh")).when(family == "agreement", node("key-agreement")).when(family == "rsa", node("rsa-encryption")).when(family == "rsa-private", node("rsa-private-encrypt"))
        .when(F.startswith(family, F.lit("web-")) & F.col("dynamic"), web("algorithm-unresolved"))
        .when(family == "web-key", F.when(own.isin("rsa-sig", "rsa-oaep"), web("keygen-rsa")).when(own.isin("ecdsa", "ecdh"), web("keygen-ec")).when(own.isNotNull(), F.concat(web("keygen-"), own)))
        .when(family == "web-sign", F.when(own == "rsa-sig", web("rsa-signature")).when(own.isin("ecdsa", "eddsa"), F.concat(web(""), own))).when((family == "web-derive") & own.isin("ecdh", "xdh"), web("key-agreement"))
        .when((family == "web-encrypt") & (own == "rsa-oaep"), web("rsa-oaep")).when(family == "unsecured", F.lit("jwt/jose/alg-none")).when(F.startswith(family, F.lit("jwt")), jwts)
    )
    curved = lambda head, c: F.coalesce(F.concat(head, F.lit("-"), c), head)
    mac = F.when(method == "createHmac", "HMAC").when(F.startswith(method, F.lit("hkdf")), "HKDF").otherwise("PBKDF2")
    algorithm = (
        F.when(family == "hash", digest_label).when(family == "mac", F.concat(mac, F.lit("-"), digest_label)).when(family == "cipher", F.upper(token))
        .when((family == "keypair") & kind.isin("rsa", "dsa", "dh"), _sized(F.upper(low), bits)).when((family == "keypair") & (kind == "ec"), F.coalesce(F.concat(F.lit("ECDSA-"), curve), F.lit("EC"))).when(family == "keypair", _map(names, low))
        .when(family.isin("signature", "one-shot"), F.coalesce(signer, F.lit("RSA/DSA/ECDSA"))).when(family == "ecdh", curved(F.lit("ECDH"), curve)).when(family.isin("dh", "dh-group"), _sized(F.lit("DH"), bits)).when(family.isin("rsa", "rsa-private"), "RSA")
        .when(F.startswith(family, F.lit("web-")) & F.col("dynamic"), F.lit(None)).when((family == "web-key") & own.isin("rsa-sig", "rsa-oaep"), _sized(F.lit("RSA"), bits)).when((family == "web-key") & own.isin("ecdsa", "ecdh"), curved(F.upper(low), curve))
        .when((family == "web-sign") & (own == "rsa-sig"), "RSA").when(family == "web-encrypt", "RSA-OAEP").when(F.startswith(family, F.lit("web-")), F.coalesce(_map(names, low), F.upper(low)))
        .when(family == "unsecured", "JWT-none").when(F.startswith(family, F.lit("jwt")), F.when(token.isNotNull(), F.concat(F.lit("JWT-"), token)).when(absent & (family == "jwt-default"), "JWT-HS256"))
    )
    return {"rule": rule, "algorithm": algorithm, "bits": bits, "curve": curve, "digest": digest}
