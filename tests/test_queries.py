"""Every estate query against DuckDB on the smallest tables, and rule tables against plain values."""

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from keystrata.operators import estate, risk, source
from keystrata.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLE_SQL[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("spec", "fixed", "verdict"),
    [("^0.23", "0.23.22", "either"), ("0.23.4", "0.23.22", "below"), ("0.23.22", "0.23.22", "at-or-above"), (">=48", "48.0.0", "at-or-above"), ("~1.2", "2.0.0", "below"), ("<2.0.0", "2.0.0", "below"), ("latest", "1.0.0", None)],
)
def test_judged_range(spark, spec, fixed, verdict):
    from pyspark.sql import functions as F

    row = spark.range(1).select(estate.judged_range(F.lit(spec), estate.version_parts(F.lit(fixed))).alias("v")).first()
    assert row["v"] == verdict


RANGES = [
    ("0.23.22", "below", "0.21.0; =0.23.5; ^0.21; >=0.21, <0.23.22; 0.20 - 0.22; 0.23.0-rc.1; 0.20.1 || ^0.22"),
    ("0.23.22", "either", "^0.23.5; ~0.23.1; 0.23; 0.23.x; >=0.21, <=0.23.22; >=0.21; *; 0.21.0 || 0.23.30"),
    ("0.23.22", "at-or-above", "0.23.27; ^0.23.22; >= 0.24; 0.23.22 || 0.24.x"),
    ("48.0.0", "either", ">=41; !=47.0.1,>=46; 99999999999999999999 || 1.0.0"),
    ("48.0.0", "below", "~=41.0; ==41.*; ==47.0.0; >=1,<2; ==41.0.0"),
    ("48.0.0", "at-or-above", ">=48,<50; 99999999999999999999"),
    ("0.23.22", None, "latest; git+https://example.com/x.git; workspace:^; file:../x"),
]


def test_judged_range_on_the_reference_table(spark):
    rows = [(s, f, v) for f, v, specs in RANGES for s in specs.split("; ")] + [("", "1.0.0", None), (None, "1.0.0", None), ("1.0.0", None, None)]
    df = spark.createDataFrame(rows, "spec string, fixed string, want string").withColumn("got", estate.judged_range(F.col("spec"), estate.version_parts(F.col("fixed"))))
    assert [tuple(r) for r in df.where("not got <=> want").collect()] == []


def test_registry_knows_the_recoverable_libraries(spark):
    rows = [("pypi", "Python_Jose"), ("pypi", "ecdsa"), ("pypi", "PyNaCl"), ("pypi", "pyOpenSSL"), ("npm", "tweetnacl"), ("crates", "p256"), ("crates", "x25519_dalek"), ("npm", "left-pad")]
    df = spark.createDataFrame([("t", "m", e, n, "1.0.0") for e, n in rows], "target string, manifest string, ecosystem string, name string, version string")
    want = ["deps/crates-p256", "deps/crates-x25519-dalek", "deps/npm-tweetnacl", "deps/pypi-ecdsa", "deps/pypi-pynacl", "deps/pypi-pyopenssl", "deps/pypi-python-jose"]
    assert sorted(r["rule_id"] for r in estate.match_deps(df).collect()) == want


def test_sarif_lines_are_one_log_for_each_target(spark):
    import json

    from keystrata.operators import reports

    rows = [("t", 1, "b/y", "high", "vulnerable", 'a"b', None, None), ("t", 1, "b/y", "high", "vulnerable", 'a"b', None, None), ("t", 2, "a/x-z", "info", "safe", None, "::1", None), ("u", 5, "c", "low", "safe", "\n", "h", 443), (None, 1, "c", "low", "safe", None, None, None), ("w", 1, None, "low", "safe", None, None, None)]
    schema = "target string, ord long, rule_id string, severity string, pq_status string, algorithm string, host string, port int"
    lines = reports.sarif_lines(spark.createDataFrame(rows, schema)).orderBy("target", "part", "ord", F.desc("line")).collect()
    logs = {t: json.loads("".join(r["line"] for r in lines if r["target"] == t))["runs"][0] for t in {r["target"] for r in lines}}
    assert {t: [(r["ruleId"], r["level"], r["rank"]) for r in log["results"]] for t, log in logs.items()} == {"t": [("b/y", "error", 80), ("b/y", "error", 80), ("a/x-z", "none", 0)], "u": [("c", "note", 30)]}
    assert all(log["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for log in logs.values() for r in log["results"])
    assert [r["name"] for r in logs["t"]["tool"]["driver"]["rules"]] == ["AXZ", "BY"]
    assert reports.sarif_lines(spark.createDataFrame([], schema)).count() == 0


def test_key_labels(spark):
    from keystrata.functions.vocabulary import details, key_label

    rows = [("rsa", 2048, None, "RSA-2048"), ("rsa-pss", None, None, "RSA-PSS-?"), ("ec", None, "prime256v1", "ECDSA-P-256"), ("ec", None, "secp192r1", "ECDSA-secp192r1"), ("ec", None, None, "ECDSA-unknown-curve")]
    rows += [("ed25519", None, None, "Ed25519"), ("slh-dsa-sha2-128s", None, None, "SLH-DSA-SHA2-128s"), ("ml-dsa-87", None, None, "ML-DSA-87"), ("x", 1, "y", "unknown-key"), (None, None, None, "unknown-key")]
    df = spark.createDataFrame(rows, "kind string, bits int, curve string, want string")
    assert df.where(key_label(F.col("kind"), F.col("bits"), F.col("curve")) != F.col("want")).count() == 0
    empty = spark.createDataFrame([(None,), ("",), ("-",), ("RSA-99999999999999999999",)], "label string").select(details(F.col("label")).alias("d"))
    assert {tuple(r["d"]) for r in empty.collect()} == {(None,) * 4, ("99999999999999999999", None, None, None)}


def test_lock_readers_pass_over_other_texts(spark):
    from keystrata.operators import manifests

    texts = [None, "", "[]", "packages:", "packages: {}\n", '{"dependencies": null}', '{"default": {"x": "1"}}', "x: y\n" * 100_000]
    rows = [("t", f"d/{name}", text) for name in ("package-lock.json", "pnpm-lock.yaml", "Pipfile.lock") for text in texts]
    files = spark.createDataFrame(rows, "target string, path string, content string")
    assert [read(files).count() for read in (manifests.npm_lock_v1, manifests.pnpm_lock, manifests.pipfile_lock)] == [0, 0, 0]


def test_mosca_inequality_over_the_grid(spark):
    from pyspark.sql import functions as F

    rows = risk.with_verdict(risk.profiles(spark).withColumn("threat", F.lit("harvest-now"))).collect()
    assert len(rows) == 49
    for r in rows:
        left = r["crqc"] - 2026 - r["horizon"]
        expected = "not-applicable" if r["horizon"] <= 0 else "exposed" if left < 0 else "overdue" if left < 3 else "on-track"
        assert r["status"] == expected


@pytest.mark.parametrize(("ip", "allowed"), [("8.8.8.8", True), ("10.1.2.3", False), ("169.254.169.254", False), ("192.88.99.1", False), ("256.1.1.1", None), ("01.2.3.4", None)])
def test_address_policy(spark, ip, allowed):
    assert estate.address_policy(spark.createDataFrame([(ip,)], "ip string")).first()["allowed"] == allowed


def test_matches_have_offsets_and_lines(spark):
    text = "import hashlib\n\nx = hashlib.md5(a)\ny = hashlib.sha1(b)"
    files = spark.createDataFrame([("t", "src/a.py", text), ("t", "vendor/b.py", text), ("t", "src/c.py", "")], "target string, path string, content string")
    rows = source.match(files, ("python",)).orderBy("at").collect()
    assert [(r["path"], r["algorithm"], r["at"], r["line"]) for r in rows] == [("src/a.py", "MD5", text.index("hashlib.md5"), 3), ("src/a.py", "SHA-1", text.index("hashlib.sha1"), 4)]


def test_other_text_files_get_the_javascript_matchers(spark):
    text = "see createCipheriv('rc4', k)"
    files = spark.createDataFrame([("t", "README.md", text), ("t", "a.js", text), ("t", "a.py", text), ("t", "vendor/b.md", text)], "target string, path string, content string")
    assert sorted((r["path"], r["algorithm"], r["at"]) for r in source.match(files, ("javascript", "other")).collect()) == [("README.md", "RC4", 4), ("a.js", "RC4", 4)]
    assert [r[1] for r in source.match(files, ("other",)).collect()] == ["README.md"]
    assert [r[1] for r in source.match(files, ("javascript", "python")).collect()] == ["a.js"]


def test_requirements_join_lines_and_drop_options(spark):
    from keystrata.operators import manifests

    text = "a[x] == 1.0 \\\n  --hash=sha256:00\n# b==2\n-r c.txt\nd ; python_version > '3'\n\ne>=1,<2 # why"
    files = spark.createDataFrame([("t", "p/requirements.txt", text), ("t", "requirements.txt", None), ("t", "p/other.txt", text)], "target string, path string, content string")
    assert sorted((r["name"], r["version"]) for r in manifests.requirements(files).collect()) == [("a", "== 1.0"), ("d", ""), ("e", ">=1,<2")]


def test_manifests_of_no_use_give_no_rows(spark):
    from keystrata.operators import manifests

    files = spark.createDataFrame([("t", f"p/{n}", c) for n in ("package.json", "Cargo.lock", "Cargo.toml", "requirements.txt", "package-lock.json", "yarn.lock", "pyproject.toml") for c in (None, "", "{broken")], "target string, path string, content string")
    assert all(read(files).isEmpty() for read in (manifests.npm, manifests.stanza_locks, manifests.toml_entries, manifests.requirements, manifests.npm_lock, manifests.yarn_lock, manifests.pyproject))


def test_deepest_directory_owns_a_site(spark):
    from keystrata.operators import manifests

    sites = spark.createDataFrame([("t", "a/b/x.js", 1), ("t", "ab/x.js", 2), ("u", "x.js", 3)], "target string, path string, ord long")
    dirs = spark.createDataFrame([("t", ""), ("t", "a"), ("t", "a/b")], "target string, dir string")
    assert sorted((r["ord"], r["dir"]) for r in manifests.owning_dirs(sites, dirs).collect()) == [(1, "a/b"), (2, "")]


@pytest.mark.parametrize(
    ("label", "primitive", "level"),
    [("X25519MLKEM768", "kem", 3), ("ml-dsa-65", "signature", 3), ("SLH-DSA-SHA2-256s", "signature", 5), ("AES-256-GCM", "ae", 5), ("aes128-cbc", "block-cipher", 1), ("RSA-?", "signature", 0), ("dsa", "signature", 0), ("sa", "unknown", None), ("JWT-ES256K", "signature", 0), ("JWT-zz", "unknown", None), (None, None, None)],
)
def test_described_labels(spark, label, primitive, level):
    from keystrata.functions.vocabulary import described

    row = spark.createDataFrame([(label,)], "label string").select(described(F.col("label")).alias("d")).first()["d"]
    assert (row["primitive"], row["level"]) == (primitive, level)


def test_markdown_rows_escape(spark):
    from keystrata.operators import reports

    rows = spark.createDataFrame([("t", 1, "low", "a_b|c", None)], "target string, ord long, severity string, rule_id string, algorithm string")
    assert reports.markdown_rows(rows).first()["line"] == "| LOW | a\\_b\\|c |  |"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.py", "x = 'a # b' # c\ny = 1", "x = 'a # b'    \ny = 1"),
        ("a.js", "a /* b\n c */ d // e\n'//f'", "a     \n      d     \n'//f'"),
        ("a.go", "s := `// x`; \"//\" // y", "s := `// x`; \"//\"     "),
        ("a.py", '"""# x\n# y""" # z', '"""# x\n# y"""    '),
        ("a.md", "// text", "// text"),
    ],
)
def test_comments_are_blanked(spark, path, text, want):
    files = spark.createDataFrame([("t", path, text)], "target string, path string, content string")
    assert source.strip_comments(files).first()["content"] == want


def test_hostile_files_take_little_time(spark):
    import time

    texts = [("a.js", "createHash(" * 100_000), ("b.js", "/*" * 300_000), ("c.py", "'" * 400_001), ("d.py", "rsa" + " " * 500_000), ("e.go", '"\\' * 200_000), ("f.js", "createHash('md5')\n" * 50_000), ("g.js", '"' + "\\a" * 300_000)]
    files = spark.createDataFrame([("t", p, t) for p, t in texts], "target string, path string, content string").repartition(4)
    began = time.time()
    assert source.match(files, ("javascript", "python", "go")).count() == 50_000
    assert time.time() - began < 120


def test_every_call_and_rule_is_known():
    from keystrata.functions import calls

    rules = [r[0] for r in calls.rules()]
    tables = {r[0] for r in calls.literals()}
    assert len(rules) == len(set(rules)) == 104
    assert {r for *_, r, _, t in calls.calls() if not t} | {r for _, _, r, _ in calls.literals()} <= set(rules)
    assert {t for *_, t in calls.calls() if t} == tables
