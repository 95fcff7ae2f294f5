"""Key blocks in text files, read by splitting a text at its dashes: linear, whatever the text holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.functions.arrays import let, running_totals

# Labels of key blocks.
PRIVATE_LABELS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
PUBLIC_LABELS = ("PUBLIC KEY", "RSA PUBLIC KEY")
MOST_BODY, MOST_HEADERS, MOST_HEADER, LEAST_BODY = 65_536, 16, 1_024, 40
_BREAK = r"\r\n|\n|\r|\\r\\n|\\n|\\r"


def _is_body(body):
    """Whether a text is a key's: up to 16 header lines, then base64 of 40 characters or more, line breaks real or escaped."""

    def fits(lines):
        header = lambda x: F.rlike(x, F.lit("^[A-Za-z][A-Za-z0-9_-]*+:")) & (F.length(x) <= MOST_HEADER)
        headers = F.coalesce(F.array_min(F.transform(lines, lambda x, i: F.when(~header(x), i))), F.size(lines))
        rest = F.slice(lines, headers + 1, F.greatest(F.size(lines), F.lit(1)))
        size = F.aggregate(rest, F.lit(0), lambda a, x: a + F.length(x))
        return (headers <= MOST_HEADERS) & (size >= LEAST_BODY) & F.forall(rest, lambda x: F.rlike(x, F.lit("^[A-Za-z0-9+/=]++$")))

    lines = F.filter(F.transform(F.split(body, _BREAK), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")
    return (F.length(body) < MOST_BODY) & let(lines, fits)


def key_blocks(files: DataFrame) -> DataFrame:
    """(target, path, line, label, rule_id, algorithm, severity, pq_status) of each key block.

    A private key is critical whatever it is; a public one is judged by its label alone, as the key's bytes are not decoded."""

    def blocks(parts):
        breaks = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
        label = lambda p: F.regexp_extract(p, "^-{0,4}BEGIN ([A-Z ]{1,32})$", 1)
        rows = F.zip_with(F.transform(parts, lambda p, i: F.struct(label(p).alias("label"), F.get(parts, i + 1).alias("body"), F.get(parts, i + 2).alias("end"))), running_totals(breaks), lambda r, n: F.struct(r["label"].alias("label"), r["body"].alias("body"), r["end"].alias("end"), (n + 1).alias("line")))
        return F.filter(rows, lambda r: r["label"].isin(*PRIVATE_LABELS, *PUBLIC_LABELS) & F.startswith(r["end"], F.lit("END")) & _is_body(r["body"]))

    found = files.where(F.contains("content", F.lit("-----BEGIN "))).select("target", "path", F.inline(let(F.split("content", "-----", -1), blocks)))
    private, rsa = F.col("label").isin(*PRIVATE_LABELS), F.col("label") == "RSA PUBLIC KEY"
    return found.select(
        "target", "path", F.col("line").cast("int").alias("line"), "label", F.when(private, "keys/private-key-block").otherwise("keys/public-key-block").alias("rule_id"), F.when(rsa, "RSA").alias("algorithm"),
        F.when(private, "critical").when(rsa, "medium").otherwise("low").alias("severity"), F.when(private | rsa, "vulnerable").otherwise("unknown").alias("pq_status"),
    )
