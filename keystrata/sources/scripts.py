"""JavaScript files whose calls are resolved, and by hand what they hold."""

# (file ending, code): imports, aliases, destructuring, shadowed names, options by name, builders.
SCRIPTS = (
    (".ts", 'import { createCipheriv as enc } from "node:crypto";\nenc("des-ede3-cbc", k, iv);'),
    (".js", 'const c = require("crypto");\nconst { createCipheriv: mk } = c;\nmk("rc4", k, null);'),
    (".js", 'const c = require("crypto");\nconst gen = c.generateKeyPairSync;\nconst again = gen;\nagain("rsa", { modulusLength: 1024 });'),
    (".js", 'require("crypto").createHash("md5").update(x);'),
    (".ts", 'import * as crypto from "crypto";\ncrypto?.createECDH?.("prime256v1");'),
    (".js", 'globalThis.crypto.subtle.generateKey({ name: "ECDSA", namedCurve: "P-384" }, true, ["sign"]);'),
    (".ts", 'import crypto from "crypto";\n(crypto as any).createCipheriv("des", k, iv);\ncrypto!.createSign("RSA-SHA1");\n(0, crypto.publicEncrypt)(pub, buf);'),
    (".js", 'var _crypto = _interopRequireDefault(require("crypto"));\n(0, _crypto.default.createCipheriv)("des-ede3-cbc", k, iv);'),
    (".mjs", 'const { webcrypto } = await import("node:crypto");\nawait webcrypto.subtle.sign({ name: "RSA-PSS", saltLength: 32 }, key, data);'),
    (".ts", 'import { createCipheriv } from "crypto";\nconst ALG = "rc2-40-cbc";\ncreateCipheriv(ALG, k, iv);'),
    (".ts", 'import jwt from "jsonwebtoken";\nconst opts = { algorithm: "RS256" };\njwt.sign(p, k, opts);'),
    (".ts", 'import crypto from "node:crypto";\nexport function f(crypto) { return crypto.createCipheriv("des", k, iv); }'),
    (".ts", 'import { createCipheriv } from "crypto";\nfunction g() { const createCipheriv = (a) => a; return createCipheriv("des"); }\ncreateCipheriv("rc4", k, null);'),
    (".ts", 'import jwt from "jsonwebtoken";\n{ const jwt = makeFake(); jwt.sign(p, k, { algorithm: "RS256" }); }\ntry { run(); } catch (jwt) { jwt.sign(p, k, { algorithm: "ES256" }); }\njwt.sign(p, k, { algorithm: "HS256" });'),
    (".js", 'let c = require("crypto");\nc.generateKeyPairSync("ec", { namedCurve: "secp192r1" });\nc.getDiffieHellman("modp2");'),
    (".js", 'import jwt from "jsonwebtoken";\njwt.sign(p, k);\njwt.verify(t, k);\njwt.verify(t, k, { algorithms: ["none", pick()] });'),
    (".js", 'import { SignJWT, UnsecuredJWT } from "jose";\nawait new SignJWT(p).setProtectedHeader({ alg: "ES256" }).sign(k);\nconst b = new SignJWT(p);\nb.setProtectedHeader({ alg: "EdDSA" });\nnew UnsecuredJWT(p).encode();\nother.setProtectedHeader({ alg: "HS256" });'),
    (".js", 'import { subtle } from "x";\nsubtle.encrypt({ name: alg }, k, d);\ncrypto.subtle.importKey("raw", d, { name: "RSA-OAEP", hash: { name: "SHA-1" } }, true, u);'),
    (".js", '// require("crypto").createHash("md5")\nconst s = "createHash(";\nthis.crypto.createHash("sha1");\nmy.pbkdf2(a, b, c, d, "sha1");\ncrypto.pbkdf2(a, f(b, [1, 2]), "x,y", d, "sha1");\ncreateHash("md5");'),
    (".py", 'createHash("md5")'),
)
_NODE, _WEB = "source/node-crypto", "source/webcrypto"
# (script, rule, algorithm, bits, text at the place, confidence, severity).
RESOLVED = (
    (0, f"{_NODE}/weak-cipher", "DES-EDE3-CBC", "", "enc(", "confirmed", "high"),
    (1, f"{_NODE}/weak-cipher", "RC4", "", "mk(", "confirmed", "high"),
    (2, f"{_NODE}/keygen-rsa", "RSA-1024", "1024", "again(", "confirmed", "high"),
    (3, f"{_NODE}/weak-hash", "MD5", "", "require(", "confirmed", "medium"),
    (4, f"{_NODE}/ecdh", "ECDH-P-256", "", "crypto?", "confirmed", "medium"),
    (5, f"{_WEB}/keygen-ec", "ECDSA-P-384", "", "globalThis", "confirmed", "medium"),
    (6, f"{_NODE}/weak-cipher", "DES", "", "(crypto as", "confirmed", "high"),
    (6, f"{_NODE}/signature", "RSA", "", "crypto!", "confirmed", "high"),
    (6, f"{_NODE}/rsa-encryption", "RSA", "", "(0,", "confirmed", "medium"),
    (7, f"{_NODE}/weak-cipher", "DES-EDE3-CBC", "", "(0,", "high", "high"),
    (8, f"{_WEB}/rsa-signature", "RSA", "", "webcrypto.subtle", "confirmed", "medium"),
    (9, f"{_NODE}/weak-cipher", "RC2-40-CBC", "", "createCipheriv(", "confirmed", "high"),
    (10, "jwt/jsonwebtoken/rsa", "JWT-RS256", "", "jwt.sign", "confirmed", "high"),
    (11, f"{_NODE}/weak-cipher", "DES", "", "crypto.createC", "high", "high"),
    (12, f"{_NODE}/weak-cipher", "RC4", "", 'createCipheriv("rc4', "confirmed", "high"),
    (13, "jwt/jsonwebtoken/rsa", "JWT-RS256", "", 'jwt.sign(p, k, { algorithm: "RS', "high", "high"),
    (13, "jwt/jsonwebtoken/ecdsa", "JWT-ES256", "", 'jwt.sign(p, k, { algorithm: "ES', "high", "high"),
    (13, "jwt/jsonwebtoken/hmac", "JWT-HS256", "", 'jwt.sign(p, k, { algorithm: "HS', "confirmed", "low"),
    (14, f"{_NODE}/keygen-ec", "ECDSA-secp192r1", "", "c.gen", "high", "high"),
    (14, f"{_NODE}/dh", "DH-1024", "1024", "c.get", "high", "high"),
    (15, "jwt/jsonwebtoken/hmac", "JWT-HS256", "", "jwt.sign", "high", "low"),
    (15, "jwt/jsonwebtoken/algorithm-unresolved", "", "", "jwt.verify(t, k)", "confirmed", "info"),
    (15, "jwt/jsonwebtoken/alg-none", "JWT-none", "", "jwt.verify(t, k, ", "confirmed", "critical"),
    (15, "jwt/jsonwebtoken/algorithm-unresolved", "", "", "jwt.verify(t, k, ", "confirmed", "info"),
    (16, "jwt/jose/ecdsa", "JWT-ES256", "", ").setP", "confirmed", "high"),
    (16, "jwt/jose/eddsa", "JWT-EdDSA", "", "b.set", "confirmed", "high"),
    (16, "jwt/jose/alg-none", "JWT-none", "", "new Uns", "confirmed", "critical"),
    (17, f"{_WEB}/algorithm-unresolved", "", "", "subtle.enc", "high", "info"),
    (17, f"{_WEB}/keygen-rsa", "RSA", "", "crypto.subtle", "confirmed", "high"),
    (18, f"{_NODE}/weak-hash", "SHA-1", "", "this.crypto", "high", "medium"),
    (18, f"{_NODE}/legacy-digest", "PBKDF2-SHA-1", "", "crypto.pb", "high", "low"),
)

# Weak digests by what the code around them says: (path ending, code, rule, severity, signal).
DIGESTS = (
    ("a.js", "const crypto = require('node:crypto')\nfunction onResponse (response, keyValue) {\n  const digest = crypto.createHash('sha1').update(keyValue + uid).digest('base64')\n  if (secWSAccept !== digest) {\n  }\n}", f"{_NODE}/weak-hash-non-security", "low", "secWSAccept"),
    ("b.js", 'const accept = crypto.createHash("sha1").update(key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest("base64");', f"{_NODE}/weak-hash-non-security", "low", "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"),
    ("c.ts", 'const digest = createHash("md5").update(body).digest("hex");\nres.setHeader("ETag", digest);', f"{_NODE}/weak-hash-non-security", "low", "ETag"),
    ("d.ts", 'const digest = createHash("md5").update(pw).digest("hex");\nres.setHeader("ETag", digest);\nif (digest !== storedPassword) throw new Error("no");', f"{_NODE}/weak-hash", "high", "storedPassword"),
    ("e.py", "import hashlib\netag = hashlib.md5(body).hexdigest()", "source/python-hashlib/weak-hash-non-security", "low", "etag"),
    ("f.py", 'git_oid = hashlib.new("sha1", blob).hexdigest()', "source/python-hashlib/weak-hash-non-security", "low", "git_oid"),
    ("g.py", "password_hash = hashlib.md5(pw).hexdigest()", "source/python-hashlib/weak-hash", "high", "password_hash"),
    ("h.py", "etag = compute()\nh = hashlib.sha1(data)\nsend(etag, h)", "source/python-hashlib/weak-hash", "medium", ""),
    ("i.py", "h = hashlib.md5(password, usedforsecurity=False)", "source/python-hashlib/weak-hash-non-security", "low", "usedforsecurity=False"),
    ("j.py", "from Crypto.Hash import SHA\ncache_key = SHA.new(data).hexdigest()", "source/pycryptodome/weak-hash-non-security", "low", "cache_key"),
    ("k.go", 'import "crypto/md5"\netag := fmt.Sprintf("%x", md5.Sum(body))', "source/go/weak-hash-non-security", "low", "etag"),
    ("l.java", 'String etag = toHex(MessageDigest.getInstance("MD5").digest(body));', "source/java/weak-hash-non-security", "low", "etag"),
    ("m.js", 'const c = createHash("md5").update(x);\nconst etag = y;', f"{_NODE}/weak-hash", "medium", ""),
)


def written(code: str) -> str:
    """The code as the derived tables hold it: @n, @o and @c for a new line and braces, which SQL and its templates read otherwise."""
    return code.replace("\n", "@n").replace("{", "@o").replace("}", "@c")
