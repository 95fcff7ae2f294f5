"""Calls resolved through long chains, hidden names, awkward arguments and texts."""

import time

from pyspark.sql import functions as F

from keystrata.operators import resolved

FILES = "target string, path string, content string, name string"


def hits(spark, *codes):
    rows = spark.createDataFrame([("t", f"src/{i}.ts", code, "x") for i, code in enumerate(codes)], FILES)
    return sorted((r["path"][4:-3], r["at"], r["rule"].split("/", 1)[1], r["algorithm"], r["confidence"]) for r in resolved.resolved_calls(rows).collect())


def test_chains_and_hidden_names(spark):
    chain = 'const a0 = require("node:crypto");\n' + "".join(f"const a{i + 1} = a{i};\n" for i in range(40)) + 'a40.createCipheriv("des", k, v);'
    loop = 'const a = b; const b = a;\na.createHash("md5");'
    arrow = 'import c, { createHash } from "crypto";\nconst f = (createHash) => createHash("md5");\nconst g = c => c.createHash("sha1");\nclass A { m(createHash) { return createHash("md5"); } }\ncreateHash("md5");'
    got = hits(spark, chain, loop, arrow, None, "", "}}}{{{ sign(", 'createHash("md5"')
    assert [x for x in got if x[0] == "0"] == [("0", chain.index("a40.createC"), "node-crypto/weak-cipher", "DES", "confirmed")]
    assert [x[2:] for x in got if x[0] == "1"] == [("node-crypto/weak-hash", "MD5", "high")]  # a ring of names is nobody's
    assert [x[1:] for x in got if x[0] == "2"] == [(arrow.index("c.createHash"), "node-crypto/weak-hash", "SHA-1", "high"), (arrow.rindex("createHash"), "node-crypto/weak-hash", "MD5", "confirmed")]
    assert not [x for x in got if x[0] in "3456"]


def test_arguments_are_cut_at_their_own_depth(spark):
    text = ["a, f(b, [c, d]), { e: 1, g }, 'x,y' ), z", "", "x as any, y!", "(a => { return b, c; }), ...rest"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").select("i", resolved.parts(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in rows] == [["a", "f(b, [c, d])", "{ e: 1, g }", "'x,y'"], [""], ["x", "y"], ["(a => { return b, c; })", "...rest"]]


def test_hostile_files_end(spark):
    codes = ["{" * 20_000, "f(" * 20_000, '"' * 20_001, "const x = " * 5_000, "crypto." * 20_000, "(a) => " * 8_000]
    began = time.time()
    hits(spark, *['import c from "crypto";\n' + code + '\nc.createHash("md5");' for code in codes])
    assert time.time() - began < 90


def test_no_files(spark):
    assert resolved.resolved_calls(spark.createDataFrame([], FILES)).collect() == []
