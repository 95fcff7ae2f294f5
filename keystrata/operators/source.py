"""Call sites in files: offsets and line numbers from built-in regex functions, then joins to tables.

A file's text, its comments blanked, is scanned once by the pattern of its language; the
matches and the parts between them give offsets and lines as running sums. Sites are joined
to the tables of calls, literals and rules, which are small and fixed. All of it is narrow.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import calls, dims, names
from keystrata.functions.arrays import chunks, cut, let, running_totals
from keystrata.operators.ranks import ranked


def language(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(F.element_at(F.split(path, "/"), -1).isin(*dims.MANIFEST_FILES), "manifest")
        .when(F.rlike(low, F.lit(r"\.[cm]?[jt]sx?$")), "javascript")
        .when(F.rlike(low, F.lit(r"\.(?:py|pyw|pyi)$")), "python")
        .when(F.endswith(low, F.lit(".go")), "go")
        .when(F.rlike(low, F.lit(r"\.(?:java|kt|kts|scala|groovy)$")), "java")
        .otherwise("other")
    )


def path_context(path: Column) -> Column:
    low = F.lower(path)
    docs = F.rlike(low, F.lit(r"\.(md|mdx|markdown|rst|txt|adoc)$")) | F.rlike(low, F.lit(r"(^|/)docs?/"))
    tests = F.rlike(low, F.lit(r"\.(test|spec|stories)\.[a-z0-9]+$")) | F.rlike(low, F.lit(r"(^|/)(tests?|__tests__|__mocks__|__fixtures__|fixtures?|examples?|e2e|mocks?)/"))
    return F.when(docs, "docs").when(tests, "test").otherwise("source")


def kept(files: DataFrame) -> DataFrame:
    """Files below no skipped directory."""
    dirs = F.split("path", "/")
    return files.where(~F.arrays_overlap(F.slice(dirs, F.lit(1), F.size(dirs) - 1), F.array(*map(F.lit, dims.SKIPPED_DIRS))))


def file_classes(files: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    binary = F.locate("\u0000", F.substring("content", 1, 8192)) > 0
    return files.select("target", "path", language(F.col("path")).alias("language"), path_context(F.col("path")).alias("context"), (F.octet_length("content") > most_bytes).alias("too_large"), binary.alias("is_binary"))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


# Strings (kept) or comments (blanked) of a language. What is not closed ends with its line, or with the text, so a
# token takes all that was read for it and no text is read twice.
_TEXTS = "|".join(rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}?+" for q in "\"'")
_C_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_TOKENS = {
    "python": "|".join(rf"{q}(?s:.*?)(?:{q}|\z)" for q in ('"' * 3, "'" * 3)) + rf"|{_TEXTS}|#[^\n]*+",
    "go": rf"`[^`]*+`?+|{_TEXTS}|{_C_COMMENT}",
    "other": rf"{_TEXTS}|{_C_COMMENT}",
}


def without_comments(text: Column, kind: str) -> Column:
    """The text with every character of a comment but its line breaks a space; strings stay, and so do offsets."""
    pattern = _TOKENS[kind]

    def glued(tokens):
        blank = lambda t: F.when(F.substring(t, 1, 2).isin("//", "/*") | F.startswith(t, F.lit("#")), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
        return F.array_join(F.zip_with(F.split(text, pattern, -1), tokens, lambda p, t: F.concat(p, F.coalesce(blank(t), F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), glued)


def strip_comments(files: DataFrame) -> DataFrame:
    """``files`` with the comments of Python, Go, JVM and JavaScript files blanked; other text stays."""
    kind, own = language(F.col("path")), F.col("content")
    text = F.when(kind == "python", without_comments(own, "python")).when(kind == "go", without_comments(own, "go"))
    return files.withColumn("content", text.when(kind.isin("java", "javascript"), without_comments(own, "other")).otherwise(own))


def call_sites(files: DataFrame, kind: str) -> DataFrame:
    """``files`` by call site: callee, literal (or ""), after (up to 256 characters behind it), before and ahead (of its place), at and line, with the gates the file holds."""
    pattern, text = calls.call_pattern(kind), F.col("content")
    reach = 2048 if kind == "javascript" else 512  # where a digest goes next is read in JavaScript only

    def placed(found):
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = lambda own: F.zip_with(between, found, lambda b, m: own(b) + own(m))
        rows = F.arrays_zip(
            between.alias("b"), F.transform(found, F.length).alias("size"), running_totals(sizes(F.length)).alias("at"), running_totals(sizes(_breaks)).alias("line"),
            F.transform(found, lambda m: F.regexp_extract(m, pattern, 1)).alias("callee"), F.transform(found, lambda m: F.regexp_extract(m, pattern, 2)).alias("literal"),
        )
        def sites(pieces):
            def site(x):
                at = x["at"] + F.length(x["b"])
                after = cut(pieces, at + x["size"], at + x["size"] + 256)
                return F.struct(F.regexp_replace(x["callee"], r"\s", "").alias("callee"), x["literal"].alias("literal"), after.alias("after"), cut(pieces, F.greatest(at - 256, F.lit(0)), at).alias("before"), cut(pieces, at, at + reach).alias("ahead"), at.alias("at"), (x["line"] + _breaks(x["b"]) + 1).alias("line"))

            return F.transform(rows, site)

        return let(chunks(text), sites)

    return files.select("target", "path", "gates", F.inline(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)))


def digest_context(before: Column, ahead: Column, follow: Column) -> Column:
    """The line of a call and, where ``follow``, those of the next 16 lines that name the variable it is assigned to."""
    start = F.regexp_extract(before, r"[^\n]*\z", 0)
    variable = F.regexp_extract(start, r"([A-Za-z_$][\w$]*)\s*(?::[^=:]*)?:?=\s*(?:(?:await|new)\s+)*[\w$.]*\z", 1)

    def told(lines):
        uses = F.filter(F.slice(lines, 2, 16), lambda own: follow & (variable != "") & F.array_contains(F.split(own, r"[^\w$]+"), variable))
        return F.concat_ws(" ", start, F.get(lines, F.lit(0)), F.array_join(uses, " "))

    return let(F.split(ahead, "\n"), told)


def _dimension(df: DataFrame, rows, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def match(files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(target, path, rule, algorithm, literal, after, context, at, line): every use, of a weak digest with the code that tells its role; "other" text files, if asked for, are read as JavaScript, their text as it is."""
    # texts without any name of a call are left before their comments are blanked; what gates the others' code holds is seen once
    some = kept(files).withColumn("language", language(F.col("path"))).where(F.col("language").isin(*languages))
    named = lambda kind: reduce(or_, (F.contains("content", F.lit(n)) for n in calls.needed_names(kind)))
    some = some.where(F.when(F.col("language").isin("python", "go", "java"), reduce(lambda held, k: F.when(F.col("language") == k, named(k)).otherwise(held), ("python", "go", "java"), F.lit(False))).otherwise(named("javascript")))
    gates = sorted({gate for _, _, gate, *_ in calls.calls() if gate})
    rows = strip_comments(some).withColumn("gates", F.filter(F.array(*map(F.lit, gates)), lambda g: F.contains(F.col("content"), g)))
    found = None
    for kind in ("javascript", "python", "go", "java"):
        read = [n for n in languages if n == kind or n == "other" and kind == "javascript"]
        if read:
            sites = call_sites(rows.where(F.col("language").isin(*read)), kind).withColumn("language", F.lit(kind))
            found = sites if found is None else found.unionByName(sites)
    known = _dimension(files, calls.calls(), "language string, callee string, gate string, rule string, algorithm string, table string")
    named = _dimension(files, calls.literals(), "table string, pattern string, named_rule string, named_algorithm string").withColumnRenamed("table", "of")
    own = found.join(known, ["language", "callee"]).where((F.col("gate") == "") | F.array_contains("gates", F.col("gate"))).withColumn("name", F.lower(F.split("literal", "/")[0]))
    told = own.join(named, (F.col("table") == F.col("of")) & F.rlike("name", F.col("pattern")), "left").where((F.col("table") == "") | F.col("named_rule").isNotNull())
    rule = F.coalesce("named_rule", "rule")
    context = F.when(rule.endswith("/weak-hash"), digest_context(F.col("before"), F.col("ahead"), F.col("language") == "javascript"))
    return told.select("target", "path", rule.alias("rule"), F.coalesce(F.when(F.col("named_algorithm") == "=", F.upper("name")).otherwise(F.col("named_algorithm")), "algorithm").alias("algorithm"), "literal", "after", context.alias("context"), "at", "line")


def assessed(hits: DataFrame) -> DataFrame:
    """Hits once each, with what their rule says and what the key's size, its curve, the signed digest or a digest's role changes: bits, role, severity, pq_status, usage and reason.

    A weak digest that the names around it, or Python's ``usedforsecurity=False``, show to be no security control goes to its rule's
    ``-non-security`` variant; one made for security is high.
    """
    rules = _dimension(hits, calls.rules(), "rule string, severity string, pq_status string, usage string")
    inside = F.regexp_extract("after", r"^[^;)]*+", 0)
    said = F.regexp_extract(inside, r"(?i)(?:key_?size|modulusLength|bits)\W{1,4}(\d{3,5})\b", 1)
    plain = F.get(F.filter(F.reverse(F.regexp_extract_all(inside, F.lit(r"\b(\d{3,5})\b"), F.lit(1))), lambda n: n != "65537"), F.lit(0))
    bits = F.when(F.col("rule").rlike("/(?:keygen-(?:rsa|dsa)|dh|dsa)$"), F.coalesce(F.nullif(said, F.lit("")), plain).cast("int"))
    waived = F.col("rule").startswith("source/python-hashlib/") & F.rlike("after", F.lit(r"^[^\r\n]{0,240}?\busedforsecurity\s{0,4}=\s{0,4}False\b"))
    role = F.when(F.col("context").isNotNull(), F.when(waived, F.struct(F.lit("non-security").alias("role"), F.lit("usedforsecurity=False").alias("signal"))).when(F.col("rule").startswith("source/node-crypto/"), names.digest_role(F.col("context"), 64, digits=True)).otherwise(names.digest_role(F.col("context"))))
    once = hits.dropDuplicates(["target", "path", "at", "rule", "algorithm"]).withColumn("_role", role)
    rule = F.when(F.col("_role.role") == "non-security", F.concat("rule", F.lit("-non-security"))).otherwise(F.col("rule"))
    rows = once.withColumns({"rule": rule, "role": F.col("_role.role"), "signal": F.col("_role.signal")}).drop("_role").join(rules, "rule").withColumn("bits", bits)
    curve = F.when(F.col("rule").endswith("/keygen-ec"), F.nullif(F.regexp_extract(inside, r"(?i)curve\W{1,4}[\"'`]([\w-]{1,64})[\"'`]", 1), F.lit("")))
    curve = F.when(F.regexp_extract(curve, r"(\d{3})", 1).try_cast("int") < 224, curve)
    signed = F.when(F.col("rule").rlike("/(?:signature|rsa-signature|dsa-signature|ecdsa)$") & F.rlike("literal", F.lit(r"(?i)md[245]|sha-?1(?!\d)")), F.col("literal"))
    worse = F.when(F.col("bits") < 1024, "critical").when((F.col("bits") < 2048) | (F.col("role") == "security") | curve.isNotNull() | signed.isNotNull(), "high")
    reason = F.when(F.col("bits") < 2048, F.format_string("a key of %d bits is below 2048", "bits")).when(curve.isNotNull(), F.concat(F.lit("the curve "), curve, F.lit(" is below 224 bits"))).when(signed.isNotNull(), F.concat(F.lit("a signature over "), signed)).when(F.col("role").isNotNull(), F.concat("role", F.lit(": "), "signal"))
    return rows.withColumns({"severity": F.coalesce(worse, "severity"), "reason": reason})


def walk_order(files: DataFrame) -> DataFrame:
    """Place of each file in a depth-first walk by name, within its target."""
    return ranked(files.select("target", "path"), ["target"], [F.split("path", "/")])


def budget_prefix(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Files of each target before the first, in walk order, that breaks a limit."""
    rows = ranked(files.select("target", "path", F.octet_length("content").alias("size")), ["target"], [F.split("path", "/")], {"total": "size"})
    return rows.where((F.col("place") <= most_files) & (F.col("total") <= most_bytes))


def coverage_samples(files: DataFrame, shown: int = 10) -> DataFrame:
    """For each target and language the number of files and the first names."""
    rows = files.select("target", language(F.col("path")).alias("language"), "path")
    # of each of 64 parts of a target's files the first, then of those: no target meets in one task
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64)))
    few = salted.withColumn("k", F.row_number().over(Window.partitionBy("target", "language", "salt").orderBy("path"))).where(F.col("k") <= shown)
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("target", "language").orderBy("path"))).where(F.col("k") <= shown)
    names = first.groupBy("target", "language").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("sample"))
    counts = rows.groupBy("target", "language").agg(F.count("*").alias("files"))
    more = F.when(F.col("files") > shown, F.format_string("%s and %d more", "sample", F.col("files") - shown)).otherwise(F.col("sample"))
    return counts.join(names, ["target", "language"]).select("target", "language", "files", more.alias("sample"))
