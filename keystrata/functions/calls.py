"""Calls that use cryptography, as tables: which calls there are, what their literal argument names, and the rules.

``match`` in ``keystrata.operators.source`` finds call sites by the names alone and joins
them to these tables, so an API is added as a row.
"""

from __future__ import annotations

# Fixed values: (language, text that the file must hold, receiver, methods, rule, algorithm). An algorithm that
# starts with "@" is the name of a table in LITERALS, which the first argument, a literal, is looked up in.
_CRYPTO, _PYCA, _DOME = "", "cryptography", "Crypto"
CALLS = (
    ("javascript", _CRYPTO, "", "createHash", "", "@digest"),
    ("javascript", _CRYPTO, "crypto", "hash", "", "@digest"),
    ("javascript", _CRYPTO, "", "createCipher createDecipher createCipheriv createDecipheriv", "", "@cipher"),
    ("javascript", _CRYPTO, "", "generateKeyPair generateKeyPairSync", "", "@keypair"),
    ("javascript", _CRYPTO, "", "createSign createVerify", "source/node-crypto/signature", "RSA/DSA/ECDSA"),
    ("javascript", _CRYPTO, "", "createECDH", "source/node-crypto/ecdh", "ECDH"),
    ("javascript", _CRYPTO, "", "createDiffieHellman createDiffieHellmanGroup getDiffieHellman", "source/node-crypto/dh", "DH"),
    ("javascript", _CRYPTO, "", "diffieHellman", "source/node-crypto/key-agreement", "DH"),
    ("javascript", _CRYPTO, "", "publicEncrypt privateDecrypt", "source/node-crypto/rsa-encryption", "RSA"),
    ("javascript", _CRYPTO, "", "privateEncrypt publicDecrypt", "source/node-crypto/rsa-private-encrypt", "RSA"),
    ("javascript", _CRYPTO, "subtle", "generateKey importKey unwrapKey", "", "@subtle-key"),
    ("javascript", _CRYPTO, "subtle", "sign verify", "", "@subtle-sign"),
    ("javascript", _CRYPTO, "subtle", "deriveKey deriveBits", "", "@subtle-derive"),
    ("javascript", _CRYPTO, "subtle", "encrypt decrypt wrapKey", "", "@subtle-encrypt"),
    ("python", _PYCA, "rsa", "generate_private_key", "source/python-cryptography/keygen-rsa", "RSA"),
    ("python", _PYCA, "ec", "generate_private_key", "source/python-cryptography/keygen-ec", "EC"),
    ("python", _PYCA, "dsa", "generate_private_key generate_parameters", "source/python-cryptography/keygen-dsa", "DSA"),
    ("python", _PYCA, "dh", "generate_parameters", "source/python-cryptography/dh", "DH"),
    ("python", _PYCA, "X25519PrivateKey", "generate from_private_bytes", "source/python-cryptography/xdh", "X25519"),
    ("python", _PYCA, "X448PrivateKey", "generate from_private_bytes", "source/python-cryptography/xdh", "X448"),
    ("python", _PYCA, "Ed25519PrivateKey", "generate from_private_bytes", "source/python-cryptography/keygen-eddsa", "Ed25519"),
    ("python", _PYCA, "Ed448PrivateKey", "generate from_private_bytes", "source/python-cryptography/keygen-eddsa", "Ed448"),
    ("python", _PYCA, "ec", "ECDH", "source/python-cryptography/ecdh", "ECDH"),
    ("python", _PYCA, "ec", "ECDSA", "source/python-cryptography/ecdsa", "ECDSA"),
    ("python", _PYCA, "padding", "PSS PKCS1v15", "source/python-cryptography/rsa-signature", "RSA"),
    ("python", _PYCA, "padding", "OAEP", "source/python-cryptography/rsa-oaep", "RSA-OAEP"),
    ("python", "", "hashlib", "md5", "source/python-hashlib/weak-hash", "MD5"),
    ("python", "", "hashlib", "sha1", "source/python-hashlib/weak-hash", "SHA-1"),
    ("python", "", "hashlib", "new", "", "@hashlib"),
    ("python", _DOME, "RSA", "generate", "source/pycryptodome/keygen-rsa", "RSA"),
    ("python", _DOME, "ECC", "generate", "source/pycryptodome/keygen-ec", "EC"),
    ("python", _DOME, "DSA", "generate", "source/pycryptodome/keygen-dsa", "DSA"),
    ("python", _DOME, "PKCS1_OAEP", "new", "source/pycryptodome/rsa-oaep", "RSA-OAEP"),
    ("python", _DOME, "pkcs1_15", "new", "source/pycryptodome/rsa-signature", "RSA"),
    ("python", _DOME, "pss", "new", "source/pycryptodome/rsa-signature", "RSA"),
    ("python", _DOME, "PKCS1_PSS", "new", "source/pycryptodome/rsa-signature", "RSA"),
    ("python", _DOME, "PKCS1_v1_5", "new", "source/pycryptodome/rsa-signature", "RSA"),
    ("python", _DOME, "DSS", "new", "source/pycryptodome/dss", "ECDSA/DSA"),
    ("python", _DOME, "MD5", "new", "source/pycryptodome/weak-hash", "MD5"),
    ("python", _DOME, "SHA1", "new", "source/pycryptodome/weak-hash", "SHA-1"),
    ("python", _DOME, "SHA", "new", "source/pycryptodome/weak-hash", "SHA-1"),
    ("python", _DOME, "DES", "new", "source/pycryptodome/weak-cipher", "DES"),
    ("python", _DOME, "DES3", "new", "source/pycryptodome/weak-cipher", "3DES"),
    ("python", _DOME, "ARC4", "new", "source/pycryptodome/weak-cipher", "RC4"),
    ("python", _DOME, "ARC2", "new", "source/pycryptodome/weak-cipher", "RC2"),
    ("go", '"crypto/rsa"', "rsa", "GenerateKey GenerateMultiPrimeKey", "source/go/keygen-rsa", "RSA"),
    ("go", '"crypto/rsa"', "rsa", "SignPKCS1v15 SignPSS VerifyPKCS1v15 VerifyPSS", "source/go/rsa-signature", "RSA"),
    ("go", '"crypto/rsa"', "rsa", "EncryptOAEP DecryptOAEP EncryptPKCS1v15 DecryptPKCS1v15 DecryptPKCS1v15SessionKey", "source/go/rsa-encryption", "RSA"),
    ("go", '"crypto/ecdsa"', "ecdsa", "GenerateKey", "source/go/keygen-ec", "EC"),
    ("go", '"crypto/ecdsa"', "ecdsa", "Sign SignASN1 Verify VerifyASN1", "source/go/ecdsa", "ECDSA"),
    ("go", '"crypto/ecdh"', "ecdh", "P256 P384 P521", "source/go/ecdh", "ECDH"),
    ("go", '"crypto/ecdh"', "ecdh", "X25519", "source/go/ecdh", "X25519"),
    ("go", '"crypto/elliptic"', "elliptic", "GenerateKey Marshal MarshalCompressed Unmarshal UnmarshalCompressed", "source/go/elliptic", "EC"),
    ("go", '"crypto/dsa"', "dsa", "GenerateKey GenerateParameters Sign Verify", "source/go/dsa", "DSA"),
    ("go", '"crypto/ed25519"', "ed25519", "GenerateKey NewKeyFromSeed Sign Verify VerifyWithOptions", "source/go/ed25519", "Ed25519"),
    ("go", 'curve25519"', "curve25519", "X25519 ScalarMult ScalarBaseMult", "source/go/curve25519", "X25519"),
    ("go", '"crypto/md5"', "md5", "New Sum", "source/go/weak-hash", "MD5"),
    ("go", '"crypto/sha1"', "sha1", "New Sum", "source/go/weak-hash", "SHA-1"),
    ("go", '"crypto/des"', "des", "NewCipher", "source/go/weak-cipher", "DES"),
    ("go", '"crypto/des"', "des", "NewTripleDESCipher", "source/go/weak-cipher", "3DES"),
    ("go", '"crypto/rc4"', "rc4", "NewCipher", "source/go/weak-cipher", "RC4"),
    ("java", "", "KeyPairGenerator", "getInstance", "", "@jvm-keypair"),
    ("java", "", "Signature", "getInstance", "", "@jvm-signature"),
    ("java", "", "KeyAgreement", "getInstance", "", "@jvm-agreement"),
    ("java", "", "Cipher", "getInstance", "", "@jvm-cipher"),
    ("java", "", "MessageDigest", "getInstance", "", "@jvm-digest"),
)

# Fixed values: (table, pattern of the whole literal in small letters, rule, algorithm; "=" is the literal in capitals).
# Of a literal with "/" the first part counts. At most one pattern of a table fits.
_NO_EDWARDS = "(?!.*(?:ecdsa|ed25519|ed448|eddsa))"
LITERALS = (
    ("digest", "md5", "source/node-crypto/weak-hash", "MD5"),
    ("digest", "sha-?1", "source/node-crypto/weak-hash", "SHA-1"),
    ("cipher", ".*(?:des|rc4|rc2).*", "source/node-crypto/weak-cipher", "="),
    ("keypair", "rsa|rsa-pss", "source/node-crypto/keygen-rsa", "RSA"),
    ("keypair", "dsa", "source/node-crypto/keygen-dsa", "DSA"),
    ("keypair", "ec", "source/node-crypto/keygen-ec", "EC"),
    ("keypair", "ed25519", "source/node-crypto/keygen-eddsa", "Ed25519"),
    ("keypair", "ed448", "source/node-crypto/keygen-eddsa", "Ed448"),
    ("keypair", "x25519", "source/node-crypto/keygen-xdh", "X25519"),
    ("keypair", "x448", "source/node-crypto/keygen-xdh", "X448"),
    ("keypair", "dh", "source/node-crypto/keygen-dh", "DH"),
    ("subtle-key", "rsassa-pkcs1-v1_5|rsa-pss|rsa-oaep", "source/webcrypto/keygen-rsa", "RSA"),
    ("subtle-key", "ecdsa|ecdh", "source/webcrypto/keygen-ec", "="),
    ("subtle-key", "ed25519", "source/webcrypto/keygen-eddsa", "Ed25519"),
    ("subtle-key", "ed448", "source/webcrypto/keygen-eddsa", "Ed448"),
    ("subtle-key", "x25519|x448", "source/webcrypto/keygen-xdh", "="),
    ("subtle-sign", "rsassa-pkcs1-v1_5|rsa-pss", "source/webcrypto/rsa-signature", "RSA"),
    ("subtle-sign", "ecdsa", "source/webcrypto/ecdsa", "ECDSA"),
    ("subtle-sign", "ed25519", "source/webcrypto/eddsa", "Ed25519"),
    ("subtle-sign", "ed448", "source/webcrypto/eddsa", "Ed448"),
    ("subtle-derive", "ecdh|x25519|x448", "source/webcrypto/key-agreement", "="),
    ("subtle-encrypt", "rsa-oaep", "source/webcrypto/rsa-oaep", "RSA-OAEP"),
    ("hashlib", "md5", "source/python-hashlib/weak-hash", "MD5"),
    ("hashlib", "sha-?1", "source/python-hashlib/weak-hash", "SHA-1"),
    ("jvm-keypair", "rsa|rsassa-pss", "source/java/keygen-rsa", "RSA"),
    ("jvm-keypair", "ec|ecdsa", "source/java/keygen-ec", "EC"),
    ("jvm-keypair", "dsa", "source/java/keygen-dsa", "DSA"),
    ("jvm-keypair", "dh|diffiehellman", "source/java/keygen-dh", "DH"),
    ("jvm-keypair", "ed25519|eddsa", "source/java/keygen-eddsa", "Ed25519"),
    ("jvm-keypair", "ed448", "source/java/keygen-eddsa", "Ed448"),
    ("jvm-keypair", "x25519|xdh", "source/java/keygen-xdh", "X25519"),
    ("jvm-keypair", "x448", "source/java/keygen-xdh", "X448"),
    ("jvm-signature", ".*ecdsa.*", "source/java/ecdsa", "ECDSA"),
    ("jvm-signature", "(?!.*(?:ecdsa|448)).*(?:ed25519|eddsa).*", "source/java/eddsa", "Ed25519"),
    ("jvm-signature", "(?!.*ecdsa).*ed448.*", "source/java/eddsa", "Ed448"),
    ("jvm-signature", f"{_NO_EDWARDS}.*(?:rsa|pss).*", "source/java/rsa-signature", "RSA"),
    ("jvm-signature", f"{_NO_EDWARDS}(?!.*(?:rsa|pss)).*dsa.*", "source/java/dsa-signature", "DSA"),
    ("jvm-agreement", "ecdh|ecmqv", "source/java/key-agreement", "ECDH"),
    ("jvm-agreement", "dh|diffiehellman", "source/java/key-agreement", "DH"),
    ("jvm-agreement", "x25519|xdh", "source/java/key-agreement", "X25519"),
    ("jvm-agreement", "x448", "source/java/key-agreement", "X448"),
    ("jvm-cipher", "rsa", "source/java/rsa-encryption", "RSA"),
    ("jvm-cipher", "desede|tripledes|des|rc2|rc4|arcfour", "source/java/weak-cipher", "="),
    ("jvm-digest", "md[25]", "source/java/weak-hash", "="),
    ("jvm-digest", "sha(?:-?1)?", "source/java/weak-hash", "SHA-1"),
)

# Rules of public-key use by API; all are medium and vulnerable.
_PUBLIC_KEY = {
    "source/node-crypto": "keygen-rsa keygen-dsa keygen-ec keygen-eddsa keygen-xdh keygen-dh signature ecdh dh key-agreement rsa-encryption rsa-private-encrypt",
    "source/webcrypto": "keygen-rsa keygen-ec keygen-eddsa keygen-xdh rsa-signature ecdsa eddsa key-agreement rsa-oaep",
    "source/python-cryptography": "keygen-rsa keygen-ec keygen-dsa keygen-eddsa dh xdh ecdh ecdsa rsa-signature rsa-oaep",
    "source/pycryptodome": "keygen-rsa keygen-ec keygen-dsa rsa-oaep rsa-signature dss",
    "source/go": "keygen-rsa rsa-signature rsa-encryption keygen-ec ecdsa ecdh elliptic dsa ed25519 curve25519",
    "source/java": "keygen-rsa keygen-ec keygen-dsa keygen-dh keygen-eddsa keygen-xdh rsa-signature ecdsa dsa-signature eddsa key-agreement rsa-encryption",
}
# What such a rule's use is; the others (a key pair of either use) have none.
_USES = {
    "key-establishment": "keygen-xdh keygen-dh ecdh dh xdh key-agreement elliptic curve25519",
    "encryption": "rsa-encryption rsa-oaep",
    "signature": "keygen-dsa keygen-eddsa signature rsa-private-encrypt rsa-signature ecdsa eddsa dss dsa ed25519 dsa-signature",
}
# The other rules as (names, severity, pq status, usage).
_OTHERS = (
    ("source/node-crypto source/pycryptodome source/python-hashlib source/go source/java", "weak-hash", "medium", "vulnerable", "hashing"),
    ("source/node-crypto source/pycryptodome source/python-hashlib source/go source/java", "weak-hash-non-security", "low", "unknown", "hashing"),
    ("source/node-crypto source/pycryptodome source/go source/java", "weak-cipher", "high", "vulnerable", "encryption"),
    ("source/node-crypto", "legacy-digest", "low", "unknown", "mac"),
    ("source/webcrypto", "algorithm-unresolved", "info", "unknown", ""),
    ("jwt/jsonwebtoken jwt/jose jwt/pyjwt", "alg-none", "critical", "vulnerable", "authentication"),
    ("jwt/jsonwebtoken jwt/jose jwt/pyjwt", "hmac", "low", "safe", "authentication"),
    ("jwt/jsonwebtoken jwt/jose jwt/pyjwt", "rsa ecdsa eddsa", "high", "vulnerable", "authentication"),
    ("jwt/jose", "rsa-key-transport ecdh-key-agreement", "high", "vulnerable", "key-establishment"),
    ("jwt/jsonwebtoken jwt/jose", "algorithm-unresolved", "info", "unknown", "authentication"),
    ("keys", "private-key-block", "critical", "vulnerable", "secret-material"),
    ("keys", "public-key-block", "medium", "vulnerable", ""),
    ("source", "unreadable-path scan-truncated file-too-large binary-skipped directories-skipped non-code-skipped findings-capped ast-fallback", "info", "unknown", ""),
)


def rules() -> list[tuple[str, str, str, str]]:
    """The rule catalogue: (rule, severity, pq status, usage)."""
    use = {name: u for u, names in _USES.items() for name in names.split()}
    out = [(f"{api}/{name}", "medium", "vulnerable", "signature" if (api, name) == ("source/go", "keygen-ec") else use.get(name, "")) for api, names in _PUBLIC_KEY.items() for name in names.split()]
    return out + [(f"{api}/{name}", severity, pq, usage) for apis, names, severity, pq, usage in _OTHERS for api in apis.split() for name in names.split()]


def calls() -> list[tuple[str, str, str, str, str, str]]:
    """(language, callee, gate, rule, algorithm, table): a row for each call."""
    return [(language, f"{receiver}.{m}" if receiver else m, gate, rule, "" if a.startswith("@") else a, a[1:] if a.startswith("@") else "") for language, gate, receiver, methods, rule, a in CALLS for m in methods.split()]


def literals() -> list[tuple[str, str, str, str]]:
    return [(table, f"^(?:{pattern})$", rule, algorithm) for table, pattern, rule, algorithm in LITERALS]


def needed_names(language: str) -> list[str]:
    """Names of which a text with any call of the language holds one; those that hold another are left out."""
    names = {callee.rsplit(".", 1)[-1] for own, callee, *_ in calls() if own == language}
    return sorted(n for n in names if not any(other != n and other in n for other in names))


def call_pattern(language: str) -> str:
    """A pattern of any call of the language: group 1 is the callee, group 2 the literal in its first argument (or in that object's ``name``)."""
    names = sorted({callee for own, callee, *_ in calls() if own == language}, key=lambda n: (-len(n), n))
    callee = "|".join(n.replace(".", r"\s*+\.\s*+") for n in names)
    return rf"""(?<![\w$])({callee})\s*+\(\s*+(?:(?:\{{\s*+name\s*+:\s*+)?["'`]([^"'`\\\r\n]{{1,64}})["'`])?"""
