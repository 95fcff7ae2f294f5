"""Findings as a bill of cryptographic materials (CycloneDX 1.6): assets, libraries, and the document in lines.

Every finding claims assets, in a fixed order; claims are made row by row. Claims of one asset (target and
``ref``) are reduced with partial aggregates: the first claim names and describes it, the worst status and
severity win, an identifier that a scanner read wins over the catalogue's. What an asset lists (confidences,
findings, places) is made distinct as rows of its own, so neither an asset nor a target has to fit in a task.

Findings need the columns of ``FINDING``; those that a caller lacks are taken as null, others are passed
over. Rows without target, ord or id are left out, as a document cannot hold them; equal rows are one. A null
confidence is medium, a null severity or status the mildest. Certificates with null texts count them as empty.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions import dims
from keystrata.functions.names import digest, endpoint, sanitized, slug
from keystrata.functions.vocabulary import details, refined
from keystrata.operators import risk
from keystrata.sources.shared import saved

CERTIFICATE = "struct<subject: string, issuer: string, not_before: string, not_after: string, signature_algorithm: string, signature_oid: string, public_key: string, public_key_bits: int>"
FINDING = {
    "target": "string", "ord": "bigint", "id": "string", "category": "string", "rule_id": "string", "severity": "string", "pq_status": "string", "confidence": "string", "algorithm": "string",
    "oid": "string", "usage": "string", "path": "string", "line": "int", "host": "string", "port": "int", "evidence": "string", "protocol": "string", "protocol_version": "string", "cipher": "string",
    "grp": "string", "ecosystem": "string", "name": "string", "version": "string", "certificates": f"array<{CERTIFICATE}>",
}
_CLAIM = "struct<ref: string, kind: string, name: string, label: string, uses: array<string>, oid: string, body: string, version: string, declared: string, seen: boolean>"

# Protocols that a document knows, kinds of packages by ecosystem, rules of a leaf certificate, schema and form of versions and times.
PROTOCOLS = ("tls", "ssh", "ipsec", "ike", "sstp", "wpa")
PACKAGES = {"python": "pypi", "pypi": "pypi", "crates": "cargo", "cargo": "cargo"}
LEAF_SIGNATURE, LEAF_KEY = "tls/leaf-signature", "tls/leaf-public-key"
SCHEMA = "http://cyclonedx.org/schema/bom-1.6.schema.json"
PINNED = r"^\d+(?:\.\d+)*(?:[-+.][0-9A-Za-z.-]+)?$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def typed(findings: DataFrame) -> DataFrame:
    """The columns of ``FINDING`` alone, in its types, of the rows that a document can hold."""
    have = set(findings.columns)
    rows = findings.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FINDING.items()])
    return rows.dropna(subset=["target", "ord", "id"]).withColumn("uses", risk.uses_told()).withColumns(_placed())


def algorithm_ref(label: Column) -> Column:
    own = slug(label)
    return F.concat(F.lit("crypto/algorithm/"), F.when(own == "", "asset").otherwise(own))


def is_date_time(text: Column) -> Column:
    """Whether a text is a date and time of RFC 3339 that exists; false for null."""
    return F.coalesce(F.rlike(text, F.lit(DATE_TIME)) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def encoded(text: Column) -> Column:
    """A text as a part of a URI."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def pinned_version(version: Column) -> Column:
    """The version if it is one, not a range; else null."""
    own = F.regexp_replace(F.trim(version), "^==?", "")
    return F.when(F.rlike(own, F.lit(PINNED)), own)


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL: Python names in lower case with single dashes, every part of a name encoded."""
    kind = ecosystem
    for own, written in PACKAGES.items():
        kind = F.when(ecosystem == own, written).otherwise(kind)
    plain = F.when(kind == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.array_join(F.transform(F.split(plain, "/"), encoded), "/"), F.coalesce(F.concat(F.lit("@"), encoded(version)), F.lit("")))


def _claim(ref: Column, kind: str, name: Column, seen: bool = True, **more: Column) -> Column:
    own = {"label": F.lit(None), "uses": F.lit(None), "oid": F.lit(None), "body": F.lit(None), "version": F.lit(None), "declared": F.lit(None)} | more
    return F.struct(ref.alias("ref"), F.lit(kind).alias("kind"), name.alias("name"), *[c.alias(n) for n, c in own.items()], F.lit(seen).alias("seen")).cast(_CLAIM)


def _algorithm(label: Column, uses: Column, oid: Column | None = None, seen: bool = True) -> Column:
    return _claim(F.lit(None), "algorithm", label, seen, label=label, uses=uses, oid=F.lit(None) if oid is None else oid)


def _key(private: Column, algorithm: Column, size: Column | None = None) -> Column:
    parts = [F.when(private, "private-key").otherwise("public-key").alias("type"), F.when(private, "compromised").alias("state"), algorithm.alias("algorithmRef")]
    parts += [] if size is None else [F.when(size != 0, size).alias("size")]
    return F.to_json(F.struct(F.lit("related-crypto-material").alias("assetType"), F.struct(*parts).alias("relatedCryptoMaterialProperties")))


def _certificate(**parts: Column) -> Column:
    inner = F.struct(*[c.alias(n) for n, c in parts.items()], F.lit("X.509").alias("certificateFormat"))
    return F.to_json(F.struct(F.lit("certificate").alias("assetType"), inner.alias("certificateProperties")))


def _of_certificate(cert: Column) -> Column:
    """Claims of a parsed certificate: both algorithms, its key, itself."""
    text = lambda c: F.coalesce(cert[c], F.lit(""))
    identity = digest(F.concat_ws("|", text("subject"), text("issuer"), text("not_after"), text("public_key")))
    signature, algorithm = algorithm_ref(text("signature_algorithm")), algorithm_ref(text("public_key"))
    key = F.concat(F.lit("crypto/key/public/"), identity)
    signs = F.array(F.lit("signature"))
    body = _certificate(
        subjectName=text("subject"), issuerName=text("issuer"), notValidBefore=F.when(is_date_time(cert["not_before"]), cert["not_before"]),
        notValidAfter=F.when(is_date_time(cert["not_after"]), cert["not_after"]), signatureAlgorithmRef=signature, subjectPublicKeyRef=key,
    )
    return F.array(
        _algorithm(text("signature_algorithm"), signs, cert["signature_oid"]),
        _algorithm(text("public_key"), signs),
        _claim(key, "key", F.concat(text("subject"), F.lit(" public key")), body=_key(F.lit(False), algorithm, cert["public_key_bits"])),
        _claim(F.concat(F.lit("crypto/certificate/"), identity), "certificate", text("subject"), body=body),
    )


def _placed() -> dict[str, Column]:
    """Where a finding was seen: location, line (at_line), and both as JSON (place); null if nowhere."""
    path = F.nullif("path", F.lit(""))
    location = F.coalesce(path, endpoint(F.nullif("host", F.lit("")), F.col("port")))
    at = F.when(path.isNotNull() & (F.col("line") != 0), F.col("line"))
    escaped = F.regexp_replace(F.to_json(F.array(location)), r"^\[|\]$", "")
    place = F.concat(F.lit('{"location":'), escaped, F.coalesce(F.concat(F.lit(',"line":'), at.cast("string")), F.lit("")), F.lit("}"))
    return {"location": location, "at_line": at, "place": place}


def _of_key() -> Column:
    private = F.array_contains("uses", "secret-material")
    place = F.coalesce(F.concat("location", F.coalesce(F.concat(F.lit(":"), F.col("at_line").cast("string")), F.lit(""))), F.col("id"))
    side = F.when(private, "private").otherwise("public")
    ref = F.concat(F.lit("crypto/key/"), side, F.lit("/"), digest(F.concat(F.coalesce("rule_id", F.lit("")), F.lit("|"), place)))
    own = _claim(ref, "key", F.concat(F.initcap(side), F.lit(" key material ("), place, F.lit(")")), body=_key(private, algorithm_ref(F.col("algorithm"))))
    return F.concat(_own_algorithm(), F.array(own))


def _own_algorithm() -> Column:
    return F.when(F.nullif("algorithm", F.lit("")).isNotNull(), F.array(_algorithm(F.col("algorithm"), F.col("uses"), F.col("oid")))).otherwise(F.array().cast(f"array<{_CLAIM}>"))


def _of_protocol() -> Column:
    said = F.lower(F.coalesce("protocol", F.lit("tls")))
    kind = F.when(said.isin(*PROTOCOLS), said).otherwise("other")
    version, group = F.nullif("protocol_version", F.lit("")), F.nullif("grp", F.lit(""))
    place = F.coalesce(endpoint(F.nullif("host", F.lit("")), F.col("port")), F.col("evidence"), F.lit(""))
    ref = F.concat(F.lit("crypto/protocol/"), slug(F.concat(kind, F.lit("-"), F.coalesce(version, F.lit("unknown")))), F.lit("-"), digest(place))
    inner = F.struct(
        kind.alias("type"), version.alias("version"), F.when(F.nullif("cipher", F.lit("")).isNotNull(), F.array(F.struct(F.col("cipher").alias("name")))).alias("cipherSuites"),
        F.when(group.isNotNull(), F.array(algorithm_ref(group))).alias("cryptoRefArray"),
    )
    body = F.to_json(F.struct(F.lit("protocol").alias("assetType"), inner.alias("protocolProperties")))
    own = _claim(ref, "protocol", F.concat(F.concat_ws(" ", F.upper(kind), version), F.lit(" ("), place, F.lit(")")), body=body)
    first = F.when(group.isNotNull(), F.array(_algorithm(group, F.array(F.lit("key-establishment"))))).otherwise(F.array().cast(f"array<{_CLAIM}>"))
    return F.concat(first, F.array(own), _own_algorithm())


def _of_library() -> Column:
    version = pinned_version(F.col("version"))
    url = purl(F.col("ecosystem"), F.col("name"), version)
    own = _claim(url, "library", F.col("name"), version=version, declared=F.when(version.isNull(), F.nullif("version", F.lit(""))))
    given = F.transform("provided", lambda label: _algorithm(label, F.array().cast("array<string>"), seen=False))
    return F.when(url.isNotNull(), F.concat(F.coalesce(given, F.array().cast(f"array<{_CLAIM}>")), F.array(own)))


def provided_table(spark) -> DataFrame:
    """(rule_id, kind, library, provided): the registry's libraries by the rule of their findings, with the algorithms that they provide."""
    rows = [(f"deps/{e}-{n}", e, n, labels.split()) for e, n, labels in dims.PROVIDED]
    return spark.createDataFrame(rows, "rule_id string, kind string, library string, provided array<string>")


def _with_registry(findings: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Dependency findings with ecosystem and name, the registry's where they have none, and what they provide. The registry of ``dims`` is small and fixed, so it is broadcast; a caller's own is joined as Spark sees fit by its size."""
    known = F.broadcast(provided_table(findings.sparkSession)) if registry is None else registry
    rows = findings.join(known.withColumnRenamed("rule_id", "_rule").where("_rule is not null"), F.col("rule_id") == F.col("_rule"), "left")
    return rows.withColumns({"ecosystem": F.coalesce("ecosystem", "kind"), "name": F.coalesce("name", "library")})


def leaves(findings: DataFrame) -> DataFrame:
    """Leaf certificates that are known by findings alone: (target, endpoint, ord, signature, key), the last finding of either kind as a struct. Endpoints with a parsed certificate are left out."""
    at = endpoint(F.nullif("host", F.lit("")), F.col("port"))
    parsed, named = F.coalesce(F.size("certificates") > 0, F.lit(False)), F.nullif("algorithm", F.lit("")).isNotNull()
    told = named & F.col("rule_id").isin(LEAF_SIGNATURE, LEAF_KEY)
    rows = findings.where(parsed | told).withColumns({"endpoint": at, "_parsed": parsed, "_told": F.coalesce(told, F.lit(False))}).where("endpoint is not null")
    own = F.struct("ord", "id", "algorithm", "oid", "severity", "pq_status", "confidence", "place")
    last = lambda rule: F.max_by(F.when(F.col("rule_id") == rule, own), F.when(F.col("_told") & (F.col("rule_id") == rule), F.struct("ord", "id")))
    found = rows.groupBy("target", "endpoint").agg(F.bool_or("_parsed").alias("_parsed"), F.min(F.when(F.col("_told"), F.col("ord"))).alias("ord"), last(LEAF_SIGNATURE).alias("signature"), last(LEAF_KEY).alias("key"))
    return found.where("not _parsed and ord is not null").drop("_parsed")


def _leaf_claims(findings: DataFrame) -> DataFrame:
    rows = leaves(findings).withColumn("anchor", F.coalesce("signature", "key"))
    own = digest(F.concat(F.lit("leaf|"), F.col("endpoint")))
    signs = F.array(F.lit("signature"))
    has_key, key_ref = F.col("key").isNotNull(), F.concat(F.lit("crypto/key/public/"), own)
    body = _certificate(signatureAlgorithmRef=algorithm_ref(F.col("signature.algorithm")), subjectPublicKeyRef=F.when(has_key, key_ref))
    none = F.lit(None).cast(_CLAIM)
    of = lambda finding, claim, there: F.struct(finding.alias("finding"), F.when(there, claim).otherwise(none).alias("claim"))
    named = lambda what: F.concat(F.lit(what), F.lit(" ("), F.col("endpoint"), F.lit(")"))
    each = F.array(
        of(F.col("anchor"), _algorithm(F.col("signature.algorithm"), signs, F.col("signature.oid"), False), F.col("signature").isNotNull()),
        of(F.col("anchor"), _algorithm(F.col("key.algorithm"), signs, F.col("key.oid"), False), has_key),
        of(F.col("key"), _claim(key_ref, "key", named("Leaf public key"), body=_key(F.lit(False), algorithm_ref(F.col("key.algorithm")))), has_key),
        of(F.col("anchor"), _claim(F.concat(F.lit("crypto/certificate/"), own), "certificate", named("Leaf certificate"), body=body), F.lit(True)),
    )
    out = rows.select("target", "ord", F.posexplode_outer(each).alias("pos", "c")).where("c.claim is not null")
    return out.select("target", F.struct(F.lit(1).alias("phase"), "ord", "pos", "c.finding.id").alias("at"), "c.claim.*", *[F.col(f"c.finding.{c}") for c in ("id", "severity", "pq_status", "confidence", "place")])


def claims(findings: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """A row for each asset that a finding tells of: (target, at, what is claimed, what the finding says of itself). ``at`` orders the claims of a target."""
    rows = _with_registry(typed(findings), registry)
    parsed = F.coalesce(F.size("certificates") > 0, F.lit(False))
    protocol = F.col("protocol").isNotNull() | F.coalesce(F.col("rule_id") == "tls/negotiated-protocol", F.lit(False))
    each = F.when(F.col("category") == "deps", _of_library()).when(parsed, F.flatten(F.transform("certificates", _of_certificate))).when(F.col("category") == "keys", _of_key()).when(protocol, _of_protocol()).otherwise(_own_algorithm())
    main = rows.withColumn("_each", each).select("target", "ord", "id", "severity", "pq_status", "confidence", "place", F.posexplode_outer("_each").alias("pos", "c")).where("c is not null")  # an inner explode would judge every claim twice, for a filter before it
    own = main.select("target", F.struct(F.lit(0).alias("phase"), "ord", "pos", "id").alias("at"), "c.*", "id", "severity", "pq_status", "confidence", "place")
    out = own.unionByName(_leaf_claims(typed(findings)))
    return out.withColumn("ref", F.coalesce("ref", algorithm_ref(F.col("label"))))


def _algorithm_body() -> Column:
    parts = F.struct(
        F.col("_told.primitive").alias("primitive"), F.col("_told.level").alias("nistQuantumSecurityLevel"), F.col("_of.bits").alias("classicalSecurityLevel"), F.col("_of.parameter_set").alias("parameterSetIdentifier"),
        F.col("_of.curve").alias("curve"), F.col("_of.mode").alias("mode"),
    )
    return F.to_json(F.struct(F.lit("algorithm").alias("assetType"), parts.alias("algorithmProperties"), F.coalesce("read_oid", "_told.oid").alias("oid")))


def components(claimed: DataFrame) -> DataFrame:
    """A row for each asset and library of a target: (target, ref, kind, name, version, body, pq_status, severity, first, place). ``place`` is its first place, null without one; status and severity are null where no finding is about it."""
    seen = F.col("seen")
    ranked = claimed.withColumns({"_pq": F.when(seen, risk.rank_of(dims.PQ_STATUSES, "pq_status")), "_sev": F.when(seen, risk.rank_of(dims.SEVERITIES, "severity"))})
    text = F.when(seen, F.col("place"))
    out = ranked.groupBy("target", "ref").agg(
        F.min_by(F.struct("kind", "name", "version", "label", "uses", "body"), F.struct("at", "name")).alias("own"), F.min("at").alias("first"),
        F.min_by("oid", F.when(F.col("oid").isNotNull() & (F.col("kind") == "algorithm"), F.struct("at", "oid"))).alias("read_oid"),
        F.min("_pq").alias("_pq"), F.min("_sev").alias("_sev"), F.min(F.when(text.isNotNull(), F.struct("at", text.alias("text")))).alias("place"),
    )
    named = lambda values, c: F.when(F.col(c).isNotNull(), F.get(F.array(*map(F.lit, values)), F.least(F.col(c), F.lit(len(values) - 1))))
    rows = out.select("target", "ref", "own.*", "read_oid", "first", "place", named(dims.PQ_STATUSES, "_pq").alias("pq_status"), named(dims.SEVERITIES, "_sev").alias("severity"))
    told = rows.withColumns({"_of": details(F.col("label")), "_told": refined(F.col("label"), F.coalesce("uses", F.array().cast("array<string>")))})
    body = F.when(F.col("kind") == "algorithm", _algorithm_body()).otherwise(F.col("body"))
    shown = F.when(F.col("kind") == "library", F.col("name")).otherwise(sanitized(F.col("name")))
    return told.select("target", "ref", "kind", shown.alias("name"), "version", body.alias("body"), "pq_status", "severity", "first", "place")


def items(claimed: DataFrame) -> DataFrame:
    """What assets list, each once: (target, ref, list, text, first). Lists are declared (versions), confidence, finding and place; ``text`` of a place is its JSON."""
    seen = F.col("seen")
    pair = lambda kind, text: F.struct(F.lit(kind).alias("list"), text.alias("text"))
    each = F.array(
        pair("declared", F.when(seen, F.col("declared"))), pair("confidence", F.when(seen, F.coalesce("confidence", F.lit("medium")))), pair("finding", F.when(seen, F.col("id"))), pair("place", F.when(seen, F.col("place"))),
    )
    rows = claimed.select("target", "ref", "at", F.explode_outer(each).alias("e")).where("e.text is not null")
    return rows.groupBy("target", "ref", F.col("e.list").alias("list"), F.col("e.text").alias("text")).agg(F.min("at").alias("first"))


def provides(findings: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(target, library, ref): the algorithm assets that each library provides, each once."""
    rows = _with_registry(typed(findings).where("category = 'deps'"), registry)
    url = purl(F.col("ecosystem"), F.col("name"), pinned_version(F.col("version")))
    each = rows.select("target", url.alias("library"), F.posexplode("provided").alias("pos", "label")).where("library is not null")
    return each.groupBy("target", "library", algorithm_ref(F.col("label")).alias("ref")).agg(F.min("pos").alias("pos"))


def serial(target: Column, scanned_at: Column) -> Column:
    """A document's serial number, which hangs on the target and the time of the scan alone."""
    h = F.sha2(F.concat(target, F.lit("|"), scanned_at), 256)
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12))


def document_lines(findings: DataFrame, scanned_at: str, tool: str = "keystrata", tool_version: str = "1", registry: DataFrame | None = None) -> DataFrame:
    """(target, place, line): a document for every target with findings, in lines that make one when put together by ``place``.

    Assets come after libraries, both by their first finding. Assets are written once to the shared folder, as most kinds of lines are made from them; an asset
    that a third of all rows are about meets its lists in a join, which Spark splits where it is skewed.
    """
    claimed = claims(findings, registry)
    parts, lists = saved(components(claimed), "cbom"), items(claimed)
    library = F.col("kind") == "library"
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    prop = lambda name, value: F.concat(F.lit(f'{{"name":"{tool}:{name}","value":'), quoted(value), F.lit("}"))
    none = F.lit(None)
    zero = F.struct(none.cast("int").alias("phase"), none.cast("bigint").alias("ord"), none.cast("int").alias("pos"), none.cast("string").alias("id"))

    def line(part: int | Column, text: Column, head: Column = zero, ref: Column = F.lit(""), sub: int | Column = 0, at: Column = zero, tie: Column = F.lit("")) -> list[Column]:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        place = F.struct(as_col(part).alias("part"), head.alias("head"), ref.alias("ref"), as_col(sub).alias("sub"), at.alias("at"), tie.alias("tie"))
        return [F.col("target"), place.alias("place"), text.alias("line")]

    order = F.struct(F.when(library, 0).otherwise(1).alias("side"), F.col("first"), F.col("ref"))
    targets = typed(findings).select("target").distinct().join(parts.groupBy("target").agg(F.min(order).alias("least"), F.bool_or(library).alias("depends"), F.min(F.when(library, F.struct("first", "ref"))).alias("least_library")), "target", "left")
    marked = parts.join(targets, "target")
    comma = lambda first: F.when(first, "").otherwise(",")
    side = F.when(library, 1).otherwise(2)
    head = F.struct(
        F.lit(SCHEMA).alias("$schema"), F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), serial(F.col("target"), F.lit(scanned_at)).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(
            F.lit(scanned_at).alias("timestamp"),
            F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(tool).alias("name"), F.lit(tool_version).alias("version"), F.lit(f"tool/{tool}").alias("bom-ref"))).alias("components")).alias("tools"),
            F.struct(F.lit("application").alias("type"), F.lit("target").alias("bom-ref"), F.col("target").alias("name")).alias("component"),
        ).alias("metadata"),
    )
    opened = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"components":['))
    bare = F.when(library, F.to_json(F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), F.col("name"), F.col("version"), F.col("ref").alias("purl")))).otherwise(
        F.to_json(F.struct(F.lit("cryptographic-asset").alias("type"), F.col("ref").alias("bom-ref"), F.col("name")))
    )
    begun = F.concat(comma(order == F.col("least")), F.regexp_replace(bare, r"\}$", ""), F.when(library, "").otherwise(F.concat(F.lit(',"cryptoProperties":'), F.col("body"))), F.lit(',"properties":['))
    verdict = F.when(F.col("pq_status").isNull(), "").otherwise(F.concat(prop("pq_status", F.col("pq_status")), F.lit(","), prop("severity", F.col("severity"))))
    placed = F.col("place").isNotNull()
    owners = parts.select("target", "ref", F.col("first").alias("_first"), "kind", F.col("place").alias("_place"))
    listed = lists.join(owners, ["target", "ref"])
    is_place, is_declared = F.col("list") == "place", F.col("list") == "declared"
    shown = F.when(is_place, F.concat(comma((F.col("first") == F.col("_place.at")) & (F.col("text") == F.col("_place.text"))), F.col("text"))).when(is_declared, F.concat(prop("declared-version", F.col("text")), F.lit(",")))
    shown = shown.when(F.col("list") == "confidence", F.concat(F.lit(","), prop("confidence", F.col("text")))).otherwise(F.concat(F.lit(","), prop("finding", F.col("text"))))
    sub = F.when(is_declared, 1).when(F.col("list") == "confidence", 3).when(is_place, 6).otherwise(4)
    needs = marked.where("depends")
    provided = provides(findings, registry).groupBy("target", "library").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda r: r["ref"]).alias("refs"))
    given = provided.join(owners.where(library).select("target", F.col("ref").alias("library"), "_first"), ["target", "library"])
    lines = (
        targets.select(line(0, opened)),
        marked.select(line(side, begun, F.col("first"), F.col("ref"), 0)),
        listed.select(line(side, shown, F.col("_first"), F.col("ref"), sub, F.col("first"), F.col("text"))),
        marked.select(line(side, verdict, F.col("first"), F.col("ref"), 2)),
        marked.select(line(side, F.when(placed, '],"evidence":{"occurrences":[').otherwise("]"), F.col("first"), F.col("ref"), 5)),
        marked.select(line(side, F.when(placed, "]}}").otherwise("}"), F.col("first"), F.col("ref"), 7)),
        targets.select(line(3, F.when(F.col("depends"), '],"dependencies":[{"ref":"target","dependsOn":[').otherwise("]"))),
        needs.where(library).select(line(4, F.concat(comma(F.struct("first", "ref") == F.col("least_library")), quoted(F.col("ref"))), F.col("first"), F.col("ref"))),
        targets.where("depends").select(line(5, F.lit("]}"))),
        given.select(line(6, F.concat(F.lit(","), F.to_json(F.struct(F.col("library").alias("ref"), F.col("refs").alias("provides")))), F.col("_first"), F.col("library"))),
        targets.select(line(7, F.when(F.col("depends"), "]}").otherwise("}"))),
    )
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more)
    return out.where("line <> ''")


def write_documents(lines: DataFrame, path: str) -> None:
    """A folder of text files for each target, whose contents one after the other, by file name, are its document. A large target is written by many tasks."""
    dealt = lines.repartitionByRange("target", "place").sortWithinPartitions("target", "place")
    dealt.select("target", F.col("line").alias("value")).write.partitionBy("target").text(path)
