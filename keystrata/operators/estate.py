"""Dependencies, TLS posture and scan targets as joins and column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.functions.vocabulary import key_label
from keystrata.operators.once import judged_once
from keystrata.operators.targets import blocked_ipv4


_TOP = 2_000_000_000


def version_parts(text: Column) -> Column:
    """First dotted number of a text as four whole numbers; null if there is none."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(found, r"\."), lambda p: F.least(F.coalesce(p.try_cast("int"), F.lit(_TOP)), F.lit(_TOP)))  # a part beyond that, a date say, counts as that
    return F.when(found != "", F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4))


def canonical_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "pypi", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).when(ecosystem == "crates", F.lower(F.translate(name, "_", "-"))).otherwise(name)


# One comparison of a range: operator, number, wildcards, and a suffix (of a pre-release or build) that is passed over.
_TERM = r"(?:(===|~=|==|!=|>=|<=|\^|~|=|>|<)\s{0,8})?[vV]?(?:([0-9]+(?:\.[0-9]+)*)((?:\.[xX*])+)?(?:(?:[-+]|\.?(?=[A-Za-z]))[0-9A-Za-z.+-]*)?|[xX*])"
_BRANCH = rf"^\s*{_TERM}(?:(?:[\s,]+|(?=[<>=!~^])){_TERM})*\s*$"
_HYPHEN = r"^\s*[vV]?([0-9]\S*)\s+-\s+[vV]?([0-9]\S*)\s*$"


def _interval(term: Column) -> Column:
    """[lo, hi) of one comparison, as arrays of four whole numbers."""
    op, number, wild = (F.regexp_extract(term, _TERM, i) for i in (1, 2, 3))
    parts = F.transform(F.split(number, r"\."), lambda p: F.least(F.coalesce(p.try_cast("int"), F.lit(_TOP)), F.lit(_TOP)))
    n = F.least(F.size(parts), F.lit(4))
    v = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
    full = (n >= 3) & (wild == "")
    least, most = (F.array(*[F.lit(x)] * 4) for x in (0, _TOP + 1))

    def bumped(k):
        return F.transform(v, lambda x, i: F.when(i < k, x).when(i == k, x + 1).otherwise(F.lit(0)))

    after = F.when(full, bumped(F.lit(3))).otherwise(bumped(n - 1))
    caret = F.when((F.get(v, F.lit(0)) > 0) | (n == 1), bumped(F.lit(0))).when((F.get(v, F.lit(1)) > 0) | (n == 2), bumped(F.lit(1))).otherwise(bumped(F.lit(2)))
    lo = F.when((number == "") | op.isin("<", "<=", "!="), least).when(op == ">", bumped(F.lit(3))).otherwise(v)
    hi = F.when((number == "") | op.isin(">", ">=", "!="), most).when(op == "<", v).when(op == "^", caret)
    hi = hi.when(op == "~", F.when(n == 1, bumped(F.lit(0))).otherwise(bumped(F.lit(1)))).when(op == "~=", bumped(F.greatest(n - 2, F.lit(0))))
    return F.struct(lo.alias("lo"), hi.otherwise(after).alias("hi"))


def range_ends(spec: Column) -> Column:
    """[lo, hi) of each branch of a version range; null for what is no range."""
    branches = F.transform(F.split(spec, r"\|\|"), lambda b: F.regexp_replace(b, _HYPHEN, ">=$1 <=$2"))
    terms = F.transform(branches, lambda b: F.transform(F.regexp_extract_all(b, F.lit(_TERM), F.lit(0)), _interval))
    ends = F.transform(terms, lambda own: F.struct(F.array_max(F.transform(own, lambda t: t["lo"])).alias("lo"), F.array_min(F.transform(own, lambda t: t["hi"])).alias("hi")))
    return F.when(F.forall(branches, lambda b: F.rlike(b, F.lit(_BRANCH))), ends)


def range_verdict(ends: Column, fixed: Column) -> Column:
    """Where a range stands against the fixed version; null for what is no range."""
    verdict = F.when(F.forall(ends, lambda e: e["hi"] <= fixed), "below").when(F.forall(ends, lambda e: e["lo"] >= fixed), "at-or-above").otherwise("either")
    return F.when(ends.isNotNull() & fixed.isNotNull(), verdict)


def judged_range(spec: Column, fixed: Column) -> Column:
    """Where a version range stands against the fixed version; null for what is no range."""
    return range_verdict(range_ends(spec), fixed)


def pinned(ecosystem: Column, version: Column) -> Column:
    """The one version that a declaration names, or null; a bare version of a crate stands for a range."""
    exact = F.regexp_extract(version, r"^\s*(={0,3})\s*[vV]?(\d+(?:\.\d+)*(?:[-+][0-9A-Za-z.+-]+)?)\s*$", 2)
    return F.when((exact != "") & ((ecosystem != "crates") | F.startswith(F.trim(version), F.lit("="))), exact)


def constraint(ecosystem: Column, version: Column) -> Column:
    """The range that a declaration means: a bare version of a crate is a caret range."""
    return F.when((ecosystem == "crates") & version.rlike(r"^\s*\d"), F.concat(F.lit("^"), F.trim(version))).otherwise(version)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(e, n, s, p, f) for e, n, s, p, f in dims.REGISTRY]
    return spark.createDataFrame(rows, "ecosystem string, canon string, severity string, pq_status string, fixed_in string")


def match_deps(declared: DataFrame) -> DataFrame:
    """Declared packages that the registry knows, once for each manifest, name and version, assessed against the fixed version."""
    known = F.broadcast(registry(declared.sparkSession))
    rows = declared.withColumn("canon", canonical_name(F.col("ecosystem"), F.col("name"))).join(known, ["ecosystem", "canon"])
    rows = rows.withColumn("spec", F.when(F.col("fixed_in").isNotNull(), constraint(F.col("ecosystem"), F.col("version"))))
    rows = judged_once(rows, "spec", {"ends": range_ends(F.col("spec"))})  # ranges are read once each, many manifests name the same
    verdict = range_verdict(F.col("ends"), version_parts(F.col("fixed_in")))
    done = verdict == "at-or-above"
    return rows.select(
        "target", F.concat(F.lit("deps/"), "ecosystem", F.lit("-"), "canon").alias("rule_id"), F.format_string("%s:%s@%s", "manifest", "name", "version").alias("evidence"),
        F.coalesce(verdict, F.lit("none")).alias("verdict"), F.when(done, "info").otherwise(F.col("severity")).alias("severity"), F.when(done, "transitional").otherwise(F.col("pq_status")).alias("pq_status"),
        F.when(F.col("fixed_in").isNull(), "medium").when(verdict.isin("at-or-above", "below"), "high").otherwise("low").alias("confidence"),
    ).distinct()


def advisories(declared: DataFrame, known: DataFrame, shown: int = 5) -> DataFrame:
    """Exact pins with the first advisory ids of their version."""
    pins = declared.where(pinned(F.col("ecosystem"), F.col("version")).isNotNull()).select("target", "ecosystem", "name", "version").distinct()
    ids = known.groupBy("ecosystem", "name", "version").agg(F.array_join(F.slice(F.array_sort(F.collect_set("id")), 1, shown), ",").alias("ids"))
    return pins.join(ids, ["ecosystem", "name", "version"])


def tls_protocol(shakes: DataFrame) -> DataFrame:
    major, minor = (F.regexp_extract("protocol", r"^TLSv(\d)(?:\.(\d))?$", i) for i in (1, 2))
    version = F.when(major != "", F.concat(major, F.lit("."), F.when(minor == "", "0").otherwise(minor)))
    severity = F.when(version == "1.3", "info").when(version == "1.2", "medium").otherwise("high")
    return shakes.select("host", version.alias("version"), severity.alias("severity"), F.when(version == "1.3", "unknown").otherwise("vulnerable").alias("pq_status"))


def tls_kex(shakes: DataFrame) -> DataFrame:
    """The classical key exchange that a session used, or null."""
    modern = (F.col("protocol") == "TLSv1.3") | F.startswith("cipher", F.lit("TLS_"))
    pq = F.lower("grp").isin(*(g.lower() for g, _, _ in dims.PQ_GROUPS))
    curve = F.when(F.col("grp").isin("prime256v1", "secp256r1"), "P-256").when(F.col("grp") == "secp384r1", "P-384").when(F.col("grp") == "secp521r1", "P-521").otherwise(F.col("grp"))
    field = lambda name: F.concat_ws("-", F.lit(name), F.col("bits").cast("string"))
    label = (
        F.when(~modern & F.exists(F.array(*map(F.lit, dims.STATIC_RSA_CIPHERS)), lambda p: F.startswith(F.upper("cipher"), p)), "static-RSA-key-exchange")
        .when(~modern & F.col("cipher").rlike("^(?:DHE|EDH)-"), field("DHE"))
        .when(F.col("grp").isNotNull() & ~pq, F.concat(F.lit("ECDHE-"), curve))
        .when(~modern & F.col("cipher").rlike("^(?:ECDHE|EECDH)-"), "ECDHE")
        .when(modern & F.col("bits").isNotNull(), field("FFDHE"))
    )
    weak = F.coalesce(label.rlike("^(?:FF)?DHE") & (F.col("bits") < 2048), F.lit(False))
    return shakes.select("host", label.alias("kex"), weak.alias("weak"))


def tls_probe_summary(probes: DataFrame) -> DataFrame:
    accepted, open_ = F.bool_or(F.col("outcome") == "accepted"), F.bool_or(F.col("outcome").isin("inconclusive", "untestable"))
    names = F.array_sort(F.collect_list(F.when(F.col("outcome") == "accepted", F.struct("idx", "grp"))))
    return probes.groupBy("host", "port").agg(F.when(accepted, "supported").when(open_, "unknown").otherwise("unsupported").alias("verdict"), F.array_join(F.transform(names, lambda n: n["grp"]), ",").alias("accepted"))


def tls_untried_groups(shakes: DataFrame, probes: DataFrame) -> DataFrame:
    """Post-quantum groups that an endpoint has not refused."""
    groups = shakes.sparkSession.createDataFrame([(g,) for g, _, _ in dims.PQ_GROUPS], "grp string")
    refused = probes.where("outcome = 'rejected'").select("host", "port", "grp")
    return shakes.select("host", "port").join(F.broadcast(groups)).join(refused, ["host", "port", "grp"], "left_anti")


def key_posture(certs: DataFrame) -> DataFrame:
    curve = F.regexp_extract("curve", r"(\d{3})", 1).try_cast("int")
    classical, pq = F.col("key_type").isin(*dims.CLASSICAL_KEYS), F.rlike("key_type", F.lit("^(?:ml-kem|ml-dsa|slh-dsa|hss-lms|xmss)"))
    weak = F.coalesce(F.when(F.col("key_type").isin("rsa", "rsa-pss", "dsa"), F.col("key_bits") < 2048).when(F.col("key_type") == "ec", F.when(F.col("curve").isNotNull(), curve < 224)), F.lit(False))
    status = F.when(pq, "safe").when(classical, "vulnerable").otherwise("unknown")
    severity = F.when(~classical, "info").when(weak, F.when(F.col("key_bits") < 1024, "critical").otherwise("high")).otherwise("medium")
    return certs.withColumns({"pq_status": status, "severity": severity, "weak": weak})


def tls_chain(certs: DataFrame) -> DataFrame:
    """How many intermediates of each endpoint are classical, post-quantum or unknown by the weaker of key and signature, and what that makes of the chain.

    cnsa2 is false if a known key or signature is outside CNSA 2.0, true if all are inside, else null."""
    rows = key_posture(certs.where("chain_pos > 1 and not self_signed")).withColumn("signature", signature_posture(F.col("signature_algorithm"))["pq_status"])
    kind = F.when((F.col("pq_status") == "vulnerable") | (F.col("signature") == "vulnerable"), "classical").when((F.col("pq_status") == "safe") & (F.col("signature") == "safe"), "post_quantum").otherwise("unknown")
    key = F.when(F.col("key_type") != "unknown", F.col("key_type").isin("ml-kem-1024", "ml-dsa-87"))
    signed = F.when(F.col("signature") != "unknown", F.rlike(F.lower("signature_algorithm"), F.lit("^(?:hash)?ml-dsa-87(?:-with-sha512)?$")))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    sums = rows.withColumns({"kind": kind, "meets": key & signed}).groupBy("host", "port").agg(*map(count, ("classical", "post_quantum", "unknown")), F.count_if(F.col("meets") == F.lit(False)).alias("outside"), F.count_if("meets").alias("inside"))
    total = F.col("classical") + F.col("post_quantum") + F.col("unknown")
    return sums.select(
        "host", "port", "classical", "post_quantum", "unknown", F.when(F.col("post_quantum") == total, "info").otherwise("medium").alias("severity"),
        F.when(F.col("classical") > 0, "vulnerable").when(F.col("unknown") > 0, "unknown").otherwise("safe").alias("pq_status"), F.when(F.col("unknown") == 0, "confirmed").otherwise("high").alias("confidence"),
        F.when(F.col("outside") > 0, F.lit(False)).when(F.col("inside") == total, F.lit(True)).alias("cnsa2"),
    )


def tls_validity(certs: DataFrame, today: str) -> DataFrame:
    left = F.date_diff("valid_to", F.lit(today).cast("date"))
    rows = certs.where("chain_pos = 1").select("host", "valid_to", left.alias("days_left"))
    return rows.where("days_left < 30").withColumn("severity", F.when(F.col("days_left") < 0, "high").otherwise("low"))


def address_policy(addresses: DataFrame) -> DataFrame:
    """Whether each IPv4 text may be reached; null if it is not an address."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.transform(F.split("ip", r"\."), lambda p: p.cast("long"))
    value = F.when(F.col("ip").rlike(rf"^{octet}(?:\.{octet}){{3}}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))
    return addresses.withColumn("value", value).withColumn("allowed", ~blocked_ipv4(F.col("value")))


def signature_posture(label: Column) -> Column:
    """Struct of severity and pq_status of a certificate's signature algorithm."""
    low = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    pair = lambda severity, pq: F.struct(F.lit(severity).alias("severity"), F.lit(pq).alias("pq_status"))
    pq = F.exists(F.array(*map(F.lit, ("mldsa", "slhdsa", "hsslms", "xmss"))), lambda p: F.contains(low, p))
    known = F.exists(F.array(*map(F.lit, ("rsa", "dsa", "ecdsa", "ed25519", "ed448"))), lambda p: F.contains(low, p))
    return F.when(pq, pair("info", "safe")).when(~F.coalesce(known, F.lit(False)), pair("medium", "unknown")).when(F.rlike(low, F.lit("md[245]")), pair("critical", "vulnerable")).when(F.rlike(low, F.lit("sha1(?![0-9])")), pair("high", "vulnerable")).otherwise(pair("medium", "vulnerable"))


def tls_leaf_keys(certs: DataFrame) -> DataFrame:
    """The leaf's key of each endpoint: label, severity, pq_status and the years after which it is deprecated and disallowed."""
    rows = key_posture(certs.where("chain_pos = 1"))
    classical = F.col("pq_status") == "vulnerable"
    strength = F.coalesce(F.regexp_extract("curve", r"(\d{3})", 1).try_cast("int"), F.lit(256))
    short = F.when(F.col("key_type").isin("rsa", "rsa-pss", "dsa"), F.col("key_bits") < 3072).otherwise((F.col("key_type") == "ec") & (strength < 256))
    covered = classical & ~F.col("weak")
    return rows.select("host", "port", key_label(F.col("key_type"), F.col("key_bits"), F.col("curve")).alias("label"), "severity", "pq_status", F.when(covered & F.coalesce(short, F.lit(False)), 2030).alias("deprecated"), F.when(covered, 2035).alias("disallowed"))


def tls_signatures(certs: DataFrame) -> DataFrame:
    """Signatures below the root: all of leaves, and of intermediates those that are unknown, weak or broken."""
    rows = certs.where("chain_pos = 1 or not self_signed").withColumn("posture", signature_posture(F.col("signature_algorithm")))
    told = (F.col("chain_pos") == 1) | (F.col("posture.pq_status") == "unknown") | F.col("posture.severity").isin("critical", "high")
    return rows.where(told).select("host", "port", "chain_pos", "signature_algorithm", "posture.severity", "posture.pq_status")


def tls_without_leaf(shakes: DataFrame, certs: DataFrame) -> DataFrame:
    """Endpoints that shook hands and showed no leaf certificate."""
    return shakes.select("host", "port", "protocol").join(certs.where("chain_pos = 1").select("host", "port"), ["host", "port"], "left_anti")


def repositories(targets: DataFrame) -> DataFrame:
    """owner and repo of each target that names a repository as owner/repo, with the site's name before it or as its https url; with its canonical url."""
    t = F.trim("raw")
    short = F.regexp_replace(t, r"^(?i:(?:https://)?(?:www\.)?github\.com/)", "")
    url = F.startswith(F.lower(t), F.lit("https://"))
    short = F.regexp_replace(F.when(url, F.regexp_replace(short, "/$", "")).otherwise(short), r"\.git$", "")
    parts = F.split(short, "/", -1)
    owner, repo = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    fits = (F.size(parts) == 2) & F.rlike(owner, F.lit("^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$")) & F.rlike(repo, F.lit("^[A-Za-z0-9._-]{1,100}$")) & ~F.lower(repo).isin(".", "..", ".git")
    return targets.where(fits).select("raw", owner.alias("owner"), repo.alias("repo")).withColumn("url", F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit(".git")))


def numeric_hosts(hosts: DataFrame) -> DataFrame:
    """Whether a host's last label is a decimal or hexadecimal number, as in an address written unusually; such hosts are refused."""
    last = F.element_at(F.split(F.regexp_replace("host", r"\.$", ""), r"\."), -1)
    return hosts.withColumn("refused", F.rlike(F.lower(last), F.lit("^(?:[0-9]+|0x[0-9a-f]*)$")))


def classify_targets(targets: DataFrame) -> DataFrame:
    """Kind of each scan target, the first that fits: path, github, remote, host; else invalid."""
    t = F.trim("raw")
    fits = lambda p: F.rlike(t, F.lit(p))
    host = r"^[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::(\d{1,5}))?$"
    kind = (
        F.when(fits(r"^(?:\.{1,2}(?:/|$)|/|~)"), "path")
        .when(fits(r"^https?://(?:www\.)?github\.com/[^/]+/[^/]+/?$"), "github")
        .when(fits(r"^(?:ssh|git|git\+ssh)://|^https?://[^?#]*\.git$|^[\w.-]+@[\w.-]+:"), "remote")
        .when(fits(r"^https?://|^\[[0-9A-Fa-f:]+\](?::\d+)?$"), "host")
        .when(fits(r"^[A-Za-z0-9-]+/[A-Za-z0-9._-]+$"), "github")
        .when(fits(host), "host")
        .otherwise("invalid")
    )
    port = F.regexp_extract(t, r"(?:^\[[^\]]*\]|^[^/:@]+|^https?://[^/:?#]+):(\d{1,5})(?:[/?#]|$)", 1)
    return targets.select("raw", kind.alias("kind"), F.when(kind == "host", F.when(port == "", 443).otherwise(port.cast("int"))).alias("port"))


def top_findings(findings: DataFrame, shown: int, rank: Column) -> DataFrame:
    """The most severe findings of each target, in report order."""
    rows = findings.withColumn("sev", rank)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("sev", "ord"))).where(F.col("place") <= shown)
