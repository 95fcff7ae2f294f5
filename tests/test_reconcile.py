"""Dependency findings eased, or left, by what their library's call sites prove."""

import pytest

from keystrata.operators import reconcile

KINDS = "target string, ord int, rule_id string, category string, severity string, pq_status string, confidence string, algorithm string, path string, evidence string, recommendation string, note string"


def site(path, line, kind, alg, confidence="confirmed"):
    return (f"jwt/jsonwebtoken/{kind}", "jwt", "low", "safe", confidence, f"JWT-{alg}", path, f"{path}:{line}", "Rotate.", "n")


def dep(path, name="npm-jsonwebtoken"):
    return (f"deps/{name}", "deps", "high", "vulnerable", "medium", None, path, f"{path}:x@9", "Migrate.", "n")


def gap(rule):
    return (rule, "source", "info", "unknown", "high", None, None, "1 file", None, "n")


HMAC = site("auth.js", 2, "hmac", "HS256")
CASES = {
    "all sites are symmetric": ([HMAC, dep("package.json")], ["low"]),
    "another site is not": ([HMAC, site("sign.js", 4, "rsa", "RS256"), dep("package.json")], ["high"]),
    "no site is resolved": ([site("auth.js", 2, "hmac", "HS256", "medium"), dep("package.json")], ["high"]),
    "another site of less confidence is not": ([HMAC, site("legacy.js", 9, "rsa", "RS256", "medium"), dep("package.json")], ["high"]),
    "a site decides at run time": ([HMAC, site("sign.js", 3, "algorithm-unresolved", "unknown"), dep("package.json")], ["high"]),
    "only the package with sites": ([site("packages/a/auth.js", 2, "hmac", "HS256"), dep("packages/a/package.json"), dep("packages/b/package.json")], ["low", "high"]),
    "a nested package keeps its sites": ([site("apps/web/auth.js", 2, "hmac", "HS256"), dep("package.json"), dep("apps/web/package.json")], ["high", "low"]),
    "a name is no directory": ([site("apps/webby/auth.js", 2, "hmac", "HS256"), dep("apps/web/package.json")], ["high"]),
    "no lock files, other libraries or languages": ([HMAC, dep("pnpm-lock.yaml"), dep("package.json", "npm-jsrsasign"), dep("requirements.txt", "pypi-pyjwt"), dep("Cargo.toml", "crates-rustls")], ["high"] * 4),
    "the scan left files out": ([HMAC, gap("source/ast-fallback"), dep("package.json")], ["high"]),
    "another gap": ([HMAC, gap("source/directories-skipped"), dep("package.json")], ["low"]),
    "no sites": ([dep("package.json")], ["high"]),
}


@pytest.fixture(scope="module")
def out(spark):
    rows = [(name, i, *f) for name, (findings, _) in CASES.items() for i, f in enumerate(findings)]
    rows += [(None, 1, *HMAC), (None, 2, *dep("package.json")), ("many", 0, *dep("package.json"))] + [("many", i, *site(f"f{i}.js", i, "hmac", "HS256")) for i in range(1, 300)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    found = reconcile.updated(df)
    assert found.columns == df.columns and found.count() == df.count()
    return found.orderBy("target", "ord").collect()


@pytest.mark.parametrize("name", CASES)
def test_case(out, name):
    own = [r for r in out if r["target"] == name]
    assert [r["severity"] for r in own if r["category"] == "deps"] == CASES[name][1]
    for r in own:
        eased = r["category"] == "deps" and r["severity"] == "low"
        assert (r["pq_status"] == "transitional") == eased and (not eased or (r["confidence"] == "high" and "HMAC (symmetric)" in r["recommendation"] and "HS256 at " in r["recommendation"] and r["recommendation"].endswith("Migrate.")))


def test_many_sites_are_cited_in_order(out):
    text = next(r["recommendation"] for r in out if r["target"] == "many" and r["category"] == "deps")
    assert "All 299 call sites" in text and "HS256 at f1.js:1, HS256 at f2.js:2, HS256 at f3.js:3, HS256 at f4.js:4, HS256 at f5.js:5, and 294 more" in text


def test_no_findings(spark):
    assert reconcile.updated(spark.createDataFrame([], KINDS)).collect() == []
