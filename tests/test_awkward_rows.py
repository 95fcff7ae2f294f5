"""Rows that stopped a job or lost a hit before: labels without sizes, odd curves, long strings, gates."""

from pyspark.sql import functions as F

from keystrata.operators import estate, once, risk, source

FINDING = "target string, ord int, rule_id string, category string, severity string, pq_status string, algorithm string, usage string, classical_break string, context string, host string, port int"
FILES = "target string, path string, content string, size_bytes long"


def findings(spark, labels):
    return spark.createDataFrame([("t", i, "source/x", "source", "medium", "vulnerable", a, "", None, None, None, None) for i, a in enumerate(labels)], FINDING)


def test_labels_without_a_size_are_not_weak(spark):
    bare = ["RSA", "RSA-?", "DSA", "DH", "DHE", "ECDH", "RSA-OAEP", "ECDSA-unknown-curve", "EC", "", None]
    weak = ["RSA-1024", "ECDSA-P-192", "DH-768"]
    got = {r["algorithm"]: r["reason"] for r in risk.with_threats(findings(spark, bare + weak)).collect()}
    assert {a: r for a, r in got.items() if r} == dict.fromkeys(weak, "below minimum strength") and len(got) == 14


def test_many_labels_are_judged_alike(spark, monkeypatch):
    rows = findings(spark, ["RSA", "RSA-1024", "MD5", "JWT-none", None])
    want = sorted(map(tuple, risk.with_threats(rows).select("ord", "reason", "standing").collect()))
    monkeypatch.setattr(once, "MOST_VALUES", 1)
    assert sorted(map(tuple, risk.with_threats(rows).select("ord", "reason", "standing").collect())) == want


def test_matched_hits_go_through_the_risk_model(spark):
    code = 'generateKeyPairSync("rsa", {})\ngetDiffieHellman("modp14")\ncreateECDH(c)\ncreateSign("RSA-SHA256")\npublicEncrypt(k, b)\nsubtle.sign({ name: "ECDSA" }, k)\n'
    hits = source.assessed(source.match(spark.createDataFrame([("t", "src/a.js", code, 1)], FILES), ("javascript",)))
    rows = hits.select("target", F.col("at").cast("int").alias("ord"), F.col("rule").alias("rule_id"), F.lit("source").alias("category"), "severity", "pq_status", "algorithm", "usage", F.lit(None).cast("string").alias("classical_break"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("int").alias("port"))
    out = risk.assets(rows, risk.profiles(spark).where("data_class = 'general'"))
    assert {r["asset"] for r in out.select("asset").distinct().collect()} >= {"source/node-crypto/dh:DH", "source/node-crypto/ecdh:ECDH", "source/node-crypto/keygen-rsa:RSA"}


def test_curves_and_versions_without_small_numbers(spark):
    curves = spark.createDataFrame([("ec", None, c) for c in ("wap", "brainpoolP1", "unknown", "secp192r1", "P-256", None)], "key_type string, key_bits int, curve string")
    assert [r["curve"] for r in estate.key_posture(curves).collect() if r["weak"]] == ["secp192r1"]
    parts = spark.createDataFrame([("20240131123045.1",), ("1.2",), ("x",)], "v string").select(estate.version_parts(F.col("v")).alias("p")).collect()
    assert [r["p"] for r in parts] == [[2_000_000_000, 1, 0, 0], [1, 2, 0, 0], None]


def test_strings_of_many_escapes_keep_their_end(spark):
    code = 's = "' + "\\n" * 100_000 + '" # hashlib.md5(a)\nhashlib.sha1(b)\n'
    hits = source.match(spark.createDataFrame([("t", "src/a.py", code, 1)], FILES), ("python",)).collect()
    assert [(h["algorithm"], h["line"]) for h in hits] == [("SHA-1", 2)]


def test_gates_hold_in_code_only(spark):
    rows = [("t", "src/a.go", '// "crypto/rsa"\nrsa.GenerateKey(r, 2048)', 1), ("t", "src/b.go", 'import "crypto/rsa"\nrsa.GenerateKey(r, 2048)', 1)]
    assert [h["path"] for h in source.match(spark.createDataFrame(rows, FILES), ("go",)).collect()] == ["src/b.go"]


def test_what_follows_a_call_goes_past_the_next_one(spark):
    code = 'generateKeyPairSync("rsa", { x: createHash("md5"), modulusLength: 1024 })'
    hits = {h["rule"]: h["after"] for h in source.match(spark.createDataFrame([("t", "src/a.js", code, 1)], FILES), ("javascript",)).collect()}
    assert "modulusLength: 1024" in hits["source/node-crypto/keygen-rsa"]


def test_literals_by_pattern_and_method(spark):
    js = ["des-cfb", "des3", "des-ede-cbc", "rc2-40-cbc", "rc4-40", "aes-256-cbc"]
    jvm = {"SHA224withRSA": "RSA", "SHA256withRSAandMGF1": "RSA", "NONEwithECDSA": "ECDSA", "SHA1withDSA": "DSA", "EdDSA": "Ed25519", "Ed448": "Ed448"}
    code = {
        "src/a.js": "\n".join(f'createCipheriv("{c}", k)' for c in js) + '\ncreateHash("md4")\n' + 'subtle.generateKey({ name: "ECDSA" })\nsubtle.generateKey({ name: "RSA-PSS", modulusLength: 1024 })\nsubtle.sign({ name: "RSA-PSS" })\n'
        + 'generateKeyPairSync("ec", { namedCurve: "secp192r1" })\ncreateSign("RSA-SHA1")\ncreateSign("RSA-SHA256")',
        "src/b.java": "\n".join(f'Signature.getInstance("{s}")' for s in jvm) + '\nKeyAgreement.getInstance("ECMQV"); KeyAgreement.getInstance("X448"); Cipher.getInstance("TripleDES/CBC"); KeyPairGenerator.getInstance("ECDSA"); MessageDigest.getInstance("MD4"); MessageDigest.getInstance("MD2")',
    }
    rows = source.assessed(source.match(spark.createDataFrame([("t", p, c, 1) for p, c in code.items()], FILES), ("javascript", "java"))).orderBy("path", "at").collect()
    got = [(r["rule"].split("/", 1)[1], r["algorithm"], r["severity"]) for r in rows]
    assert got[:5] == [("node-crypto/weak-cipher", c.upper(), "high") for c in js[:5]]
    assert got[5:11] == [("webcrypto/keygen-ec", "ECDSA", "medium"), ("webcrypto/keygen-rsa", "RSA", "high"), ("webcrypto/rsa-signature", "RSA", "medium"), ("node-crypto/keygen-ec", "EC", "high"), ("node-crypto/signature", "RSA/DSA/ECDSA", "high"), ("node-crypto/signature", "RSA/DSA/ECDSA", "medium")]
    assert [a for _, a, _ in got[11:17]] == list(jvm.values()) and got[14][2] == "high"
    assert [a for _, a, _ in got[17:]] == ["ECDH", "X448", "TRIPLEDES", "EC", "MD2"]
