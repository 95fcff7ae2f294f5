"""Bills of materials against a plain builder, on the fixture and on awkward rows."""

import hashlib
import json
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keystrata.functions import dims, vocabulary
from keystrata.operators import cbom
from keystrata.plans import cbom as plans

SF = "/root/testdata/sf0.001"
AT = "2026-01-01T00:00:00Z"


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def slug(text):
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", text.lower())) or "asset"


def place_of(row):
    if row["path"]:
        return (row["path"], row["line"] or None)
    if row["host"]:
        host = f"[{row['host']}]" if ":" in row["host"] else row["host"]
        return (f"tls://{host}:{row['port']}" if row["port"] else f"tls://{host}", None)
    return None


def told_by(row, labels):
    """The assets that a row of the fixture tells of, in order: (ref, name, labels it refers to)."""
    where = place_of(row)
    alg = lambda label: (f"crypto/algorithm/{slug(label)}", label)
    if row["certificates"]:
        for c in row["certificates"]:
            own = short("|".join([c["subject"] or "", c["issuer"] or "", c["not_after"] or "", c["public_key"] or ""]))
            yield from (alg(c["signature_algorithm"]), alg(c["public_key"]), (f"crypto/key/public/{own}", f"{c['subject']} public key"), (f"crypto/certificate/{own}", c["subject"]))
        return
    if row["category"] == "keys":
        side = "private" if "private" in row["rule_id"] else "public"
        text = where[0] + (f":{where[1]}" if where[1] else "")
        if row["algorithm"]:
            yield alg(row["algorithm"])
        yield f"crypto/key/{side}/{short(row['rule_id'] + '|' + text)}", f"{side.capitalize()} key material ({text})"
        return
    if row["rule_id"] == "tls/negotiated-protocol":
        kind = "tls" if row["protocol"].lower() == "tls" else "other"
        if row["grp"]:
            yield alg(row["grp"])
        version = row["protocol_version"]
        yield f"crypto/protocol/{slug(kind + '-' + (version or 'unknown'))}-{short(where[0])}", " ".join([kind.upper(), *([version] if version else [])]) + f" ({where[0]})"
    if row["algorithm"]:
        yield alg(row["algorithm"])


PURLS = {"1.0.3": "pkg:npm/tweetnacl@1.0.3", None: "pkg:npm/tweetnacl", "^9.0.2": "pkg:npm/jsonwebtoken", "==2.0.0-rc.1": "pkg:npm/%40scope/pkg@2.0.0-rc.1", ">=1.5": "pkg:pypi/py-nacl"}


def plain_document(rows):
    """{ref: (name, findings, places, confidences, worst status, worst severity)} of one target's rows, in the order that a document lists them."""
    libraries, assets, given = {}, {}, defaultdict(list)
    provided = {f"deps/{e}-{n}": labels.split() for e, n, labels in dims.PROVIDED}

    def add(table, ref, name, row=None):
        table.setdefault(ref, (name, []))
        if row is not None:
            table[ref][1].append(row)

    ends = {}
    for row in rows:
        if row["category"] == "deps":
            if row["rule_id"] != "deps/none":
                url = PURLS[row["version"]]
                for label in provided.get(row["rule_id"], ()):
                    add(assets, f"crypto/algorithm/{slug(label)}", label)
                    given[url] += [f"crypto/algorithm/{slug(label)}"] * (f"crypto/algorithm/{slug(label)}" not in given[url])
                add(libraries, url, url, row)
            continue
        for ref, name in told_by(row, None):
            add(assets, ref, name, row)
        if row["rule_id"] in ("tls/leaf-signature", "tls/leaf-public-key"):
            ends.setdefault(place_of(row)[0], {})[row["rule_id"]] = row
    parsed = {place_of(r)[0] for r in rows if r["certificates"]}
    for end, leaf in ends.items():
        if end not in parsed:
            own = short(f"leaf|{end}")
            if "tls/leaf-public-key" in leaf:
                add(assets, f"crypto/key/public/{own}", f"Leaf public key ({end})", leaf["tls/leaf-public-key"])
            add(assets, f"crypto/certificate/{own}", f"Leaf certificate ({end})", leaf.get("tls/leaf-signature", leaf.get("tls/leaf-public-key")))
    return libraries, assets, given


def documents(lines):
    text = defaultdict(list)
    for r in lines.orderBy("target", "place").collect():
        text[r["target"]].append(r["line"])
    return {t: json.loads("".join(parts)) for t, parts in text.items()}


def test_documents_equal_a_plain_builder(spark):
    findings = plans.findings(spark, SF).persist()
    docs = documents(cbom.document_lines(findings, AT))
    by_target = defaultdict(list)
    for row in findings.orderBy("ord").collect():
        by_target[row["target"]].append(row.asDict(recursive=True))
    assert set(docs) == set(by_target)
    for target, doc in docs.items():
        libraries, assets, given = plain_document(by_target[target])
        assert [c["bom-ref"] for c in doc["components"] if c["type"] == "library"] == list(libraries)
        assert [c["bom-ref"] for c in doc["components"] if c["type"] != "library"] == list(assets)
        for c in doc["components"]:
            name, rows = (libraries | assets)[c["bom-ref"]]
            props = defaultdict(list)
            for p in c["properties"]:
                props[p["name"].removeprefix("keystrata:")].append(p["value"])
            assert c["type"] == "library" or c["name"] == name
            assert props["finding"] == list(dict.fromkeys(r["id"] for r in rows))
            assert props["confidence"] == list(dict.fromkeys(r["confidence"] or "medium" for r in rows))
            assert props["pq_status"] == ([min((r["pq_status"] for r in rows), key=dims.PQ_STATUSES.index)] if rows else [])
            assert props["severity"] == ([min((r["severity"] for r in rows), key=dims.SEVERITIES.index)] if rows else [])
            places = list(dict.fromkeys(p for r in rows if (p := place_of(r))))
            assert [(o["location"], o.get("line")) for o in c.get("evidence", {}).get("occurrences", [])] == places
            for value in (v for part in c.get("cryptoProperties", {}).values() if isinstance(part, dict) for k, v in part.items() if k.endswith("Ref")):
                assert value in assets, "a reference without an asset"
        depends = {d["ref"]: d for d in doc.get("dependencies", [])}
        assert depends.get("target", {}).get("dependsOn", []) == list(libraries)
        assert {r: d["provides"] for r, d in depends.items() if r != "target"} == dict(given)
        assert re.fullmatch("urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}", doc["serialNumber"])
        assert doc["metadata"]["component"]["name"] == target
    findings.unpersist()


CERT = dict(subject="CN=a", issuer="CN=b", not_before="2026-01-01T00:00:00.000Z", not_after="2026-02-30T00:00:00Z", signature_algorithm="sha256WithRSAEncryption", signature_oid="1.2.3.4", public_key="RSA-2048", public_key_bits=2048)


def rows_of(spark, *rows):
    schema = ", ".join(f"{c} {t}" for c, t in cbom.FINDING.items())
    return spark.createDataFrame([tuple({"target": "t", "ord": k, "id": f"F{k}", **r}.get(c) for c in cbom.FINDING) for k, r in enumerate(rows)], schema)


def only(docs):
    return {c["bom-ref"]: c for c in docs["t"]["components"]}


def test_certificates_with_parts_missing_and_their_times(spark):
    empty = dict.fromkeys(CERT)
    found = only(documents(cbom.document_lines(rows_of(spark, {"category": "tls", "host": "2001:db8::1", "port": 443, "severity": "high", "pq_status": "vulnerable", "certificates": [CERT, empty]}), AT)))
    whole = next(c for c in found.values() if c["name"] == "CN=a")
    assert whole["cryptoProperties"]["certificateProperties"] | {"subjectPublicKeyRef": 0} == {
        "subjectName": "CN=a", "issuerName": "CN=b", "notValidBefore": CERT["not_before"], "signatureAlgorithmRef": "crypto/algorithm/sha256withrsaencryption", "subjectPublicKeyRef": 0, "certificateFormat": "X.509",
    }
    assert whole["evidence"]["occurrences"] == [{"location": "tls://[2001:db8::1]:443"}]
    assert found["crypto/algorithm/sha256withrsaencryption"]["cryptoProperties"]["oid"] == "1.2.3.4"
    assert found[whole["cryptoProperties"]["certificateProperties"]["subjectPublicKeyRef"]]["cryptoProperties"]["relatedCryptoMaterialProperties"]["size"] == 2048
    assert "crypto/algorithm/asset" in found


@pytest.mark.parametrize("turned", [False, True])
def test_an_identifier_that_was_read_wins_whichever_comes_first(spark, turned):
    rows = [{"category": "source", "algorithm": "RSA-2048", "oid": "1.2.3"}, {"category": "source", "algorithm": "rsa 2048"}]
    found = only(documents(cbom.document_lines(rows_of(spark, *(rows[::-1] if turned else rows)), AT)))
    assert found["crypto/algorithm/rsa-2048"]["cryptoProperties"]["oid"] == "1.2.3"
    assert found["crypto/algorithm/rsa-2048"]["name"] == ("rsa 2048" if turned else "RSA-2048")


def test_names_are_made_safe_and_odd_rows_survive(spark):
    key = {"category": "keys", "rule_id": "keys/private-key-block", "path": 'src/e"\x1b]0;x\x07.key', "line": 1, "severity": "critical", "pq_status": "vulnerable"}
    rows = rows_of(spark, key, key, {"category": None}, {"category": "keys", "rule_id": None}, {"category": "tls", "protocol": "IKE"}, {"category": "deps"}, {"id": None, "algorithm": "MD5"}, {"target": None, "algorithm": "MD5"}, {"algorithm": ""}, {"algorithm": "x" * 100_000})
    rows = rows.unionByName(rows).withColumn("kind", F.lit("clash")).withColumn("library", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("ref", F.lit("clash"))
    found = only(documents(cbom.document_lines(rows, AT)))
    names = [c["name"] for c in found.values()]
    assert 'Private key material (src/e"\\x1b]0;x\\x07.key:1)' in names and "Public key material (F3)" in names and "IKE ()" in names
    private = next(c for c in found.values() if c["name"].startswith("Private"))
    assert [p["value"] for p in private["properties"]] == ["vulnerable", "critical", "medium", "F0", "F1"]
    assert len(private["evidence"]["occurrences"]) == 1 and private["cryptoProperties"]["relatedCryptoMaterialProperties"] == {"type": "private-key", "state": "compromised"}
    assert len(found) == 4


def test_an_empty_table_gives_no_lines_and_a_target_without_assets_an_empty_document(spark):
    assert cbom.document_lines(rows_of(spark).limit(0), AT).count() == 0
    doc = documents(cbom.document_lines(rows_of(spark, {"category": "tls", "rule_id": "tls/hybrid-kex"}), AT))["t"]
    assert doc["components"] == [] and "dependencies" not in doc


def test_files_of_a_target_are_its_document_in_order(spark, tmp_path):
    findings = plans.findings(spark, SF).withColumn("target", F.when(F.col("target") > "t2", "big").otherwise(F.col("target")))
    lines = cbom.document_lines(findings, AT)
    cbom.write_documents(lines, str(tmp_path / "out"))
    want = documents(lines)
    for folder in (tmp_path / "out").glob("target=*"):
        text = "".join(Path(f).read_text() for f in sorted(folder.glob("part-*")))
        assert json.loads(text) == want[folder.name.removeprefix("target=")]


def test_identifiers_uses_and_versions(spark):
    want = {
        "RSA-?": "1.2.840.113549.1.1.1", "rsassaPss-sha256": "1.2.840.113549.1.1.10", "RSA-OAEP": "1.2.840.113549.1.1.7", "DSA-1024": "1.2.840.10040.4.1", "ECDSA-P-256": "1.2.840.10045.2.1", "ECDH-P-256": None, "ML-KEM-768": "2.16.840.1.101.3.4.4.2",
        "mlkem1024": "2.16.840.1.101.3.4.4.3", "HashML-DSA-65": "2.16.840.1.101.3.4.3.33", "SLH-DSA-SHAKE-256f": "2.16.840.1.101.3.4.3.31", "ecdsaWithSHA384": "1.2.840.10045.4.3.3", "SHA-256": "2.16.840.1.101.3.4.2.1", "HMAC-SHA-1": "1.2.840.113549.2.7",
        "RSA/DSA/ECDSA": None, "DES-CBC": "1.3.14.3.2.7", "JWT-ES256K": "1.2.840.10045.4.3.2", "nothing": None, None: None,
    }
    got = spark.createDataFrame([(k,) for k in want], "label string").select("label", vocabulary.identifier(F.col("label")).alias("oid")).collect()
    assert {r["label"]: r["oid"] for r in got} == want
    cases = [("RSA-2048", ["encryption"], "pke"), ("RSA-2048", ["encryption", "signature"], "signature"), ("EC", ["key-establishment"], "key-agree"), ("EC", ["key-establishment", "authentication"], "signature"), ("EC", [], "signature")]
    rows = spark.createDataFrame(cases, "label string, uses array<string>, want string").withColumn("got", vocabulary.refined(F.col("label"), F.col("uses"))["primitive"])
    assert rows.where("got <> want or got is null").count() == 0
    versions = {"==1.2": "1.2", "1.0.0-rc.1": "1.0.0-rc.1", "^1": None, "1.2 || 2": None, "latest": None, "": None}
    got = spark.createDataFrame([(v,) for v in versions], "v string").select("v", cbom.pinned_version(F.col("v")).alias("p")).collect()
    assert {r["v"]: r["p"] for r in got} == versions
