"""Secret scans by a trigram index: Boolean trigram queries select texts, regexes verify them.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold:
runs of fixed characters give trigrams that cover them and are all needed, alternatives give an "or",
optional and repeated parts give nothing. The inverted index is a table of postings
(trigram, text), written to the shared folder; texts go by a hash, so a text with many copies
is one entry. Intersecting the postings text by text answers the queries, and texts that
satisfy a query are verified with the regex; a rule without needed trigrams scans all texts.
Two texts with one hash share their postings, which costs a verification and loses nothing.

DataFrame functions only. What is shuffled are postings (a few for each text) and the
selected texts' hashes; these go to all tasks while they are few (``rows.BROADCAST_KEYS``) and
are joined beyond that. Every pattern is linear in the text: none can start again inside
what it has read in vain. Spans are code points, end exclusive. A null or empty text has no
spans. Equal rows each give their row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.arrays import chunks, cut, let, running, running_totals

from .rows import bounded, free_name
from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values of the contract. A run of fewer than the least characters never matches the last two, which drops the same matches.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def trigram_query(pattern: str):
    """Needed trigrams of a regex, lower-cased: ("and"|"or", parts), a trigram, or None if none is needed."""
    from re import _parser

    def joined(kind, parts):
        parts = list(dict.fromkeys(parts))
        return parts[0] if len(parts) == 1 else (kind, tuple(parts)) if parts else None

    def walk(items):
        parts, run = [], ""

        def flush():
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(0, len(run) - 2, 3))
            parts.extend([run[-3:]] * (len(run) > 3))
            run = ""

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg).lower()
                continue
            if name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in arg[3]):
                run += "".join(chr(a).lower() for _, a in arg[3])
                continue
            if name == "MAX_REPEAT" and arg[0] == arg[1] and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                run += chr(arg[2][0][1]).lower() * arg[0]
                continue
            flush()
            if name == "SUBPATTERN":
                parts.append(walk(arg[3]))
            elif name == "BRANCH":
                ways = [walk(way) for way in arg[1]]
                parts.append(None if None in ways else joined("or", ways))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                parts.append(walk(arg[2]))
        flush()
        return joined("and", [p for p in parts if p is not None])

    return walk(_parser.parse(pattern))


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query, held: Column) -> Column:
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, query)
    out = None
    for part in query[1]:
        c = _holds(part, held)
        out = c if out is None else out & c if query[0] == "and" else out | c
    return out


def _name(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (trigram, name) for the trigrams that the rules need; name is the text's hash."""
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    grams = sorted(set().union(*(_trigrams(trigram_query(r.pattern)) for r in rules)))
    if not grams:
        return docs.select(F.lit("").alias("trigram"), F.lit(0).cast("long").alias("name")).limit(0)
    held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams)))
    return docs.select(F.explode(held).alias("trigram"), _name(F.col("text")).alias("name"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(name, wanted): texts whose postings, intersected, satisfy a rule's query; bit k of wanted stands for the k-th rule."""
    wanted = F.lit(0).cast("long")
    for rank, rule in enumerate(rules):
        if (query := trigram_query(rule.pattern)) is not None:
            wanted = wanted.bitwiseOR(F.when(_holds(query, F.col("held")), F.lit(1 << rank)).otherwise(F.lit(0)))
    return index.groupBy("name").agg(F.collect_set("trigram").alias("held")).select("name", wanted.alias("wanted")).where("wanted <> 0")


NO_SPANS = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) of a rule's matches that are long enough."""

    def placed(matches):
        between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
        checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
        at = running_totals(F.zip_with(between, matches, lambda b, m: F.length(b) + F.length(m)))

        def span(x):
            start = x["at"] + F.length(x["b"])
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"))

        found = F.arrays_zip(at.alias("at"), between.alias("b"), matches.alias("m"), checked.alias("g"))
        return F.when(F.size(matches) > 0, F.transform(F.filter(found, lambda x: F.length(x["g"]) >= rule.least) if rule.least else found, span)).otherwise(F.expr(NO_SPANS))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)


def scan(docs: DataFrame, rules=RULES, into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: array of (start, rank, end), rank being the rule's place in ``rules``, in order; no other column may be called that."""
    if len(rules) > 63 or into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"at most 63 rules, and a column other than {docs.columns}")
    scratch = Scratch(docs.sparkSession, "secret-scan")
    index = scratch.save(postings(docs, rules), "postings")
    found = scratch.save(candidates(index, rules), "candidates")
    scratch.drop("postings")
    own, name, wanted = (free_name(docs, c) for c in ("_own", "_name", "_wanted"))
    rows = docs.withColumn(own, _name(F.col("text"))).join(bounded(found.select(F.col("name").alias(name), F.col("wanted").alias(wanted))), F.col(own) == F.col(name), "left")
    text, spans = F.coalesce(F.col("text").cast("string"), F.lit("")), []
    for rank, rule in enumerate(rules):
        one = _spans(text, rule, rank)
        if trigram_query(rule.pattern) is not None:
            one = F.when(F.coalesce(F.col(wanted), F.lit(0)).bitwiseAND(F.lit(1 << rank)) != 0, one).otherwise(F.expr(NO_SPANS))
        spans.append(one)
    return rows.select(*docs.columns, F.array_sort(F.concat(*spans)).alias(into))


def _joined(spans: Column, rules) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rules=RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are replaced as one."""
    spans = free_name(docs, "_spans")
    found = scan(docs, rules, spans)

    def parts(own, pieces):
        reach = running(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # of overlapping spans the first begins the gap
        fresh = F.filter(F.arrays_zip(own.alias("s"), reach.alias("reach")), lambda x: x["s"]["start"] >= x["reach"])
        kept = F.transform(fresh, lambda x: F.concat(cut(pieces, x["reach"], x["s"]["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), cut(pieces, F.array_max(F.transform(own, lambda s: s["end"])), F.length("text")))

    done = F.when(F.size(spans) > 0, let(chunks(F.col("text")), lambda pieces: parts(F.col(spans), pieces))).otherwise(F.col("text"))
    return found.withColumn("text", done).select(*docs.columns)


#: Kinds as the SQL writes them: RE2 has no look-behind, so group 2 is what counts as the match there.
_SQL_KINDS = tuple((r.kind, r.pattern.replace("(?<![A-Za-z0-9_-])", "(^|[^A-Za-z0-9_-])(").replace("}+", "}") + ")" if "(?<!" in r.pattern else r.pattern, r.group, r.least) for r in RULES)


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    own = 2 if pattern.startswith("(^|") else 0
    return (
        f"SELECT rid, {rank} AS rank, '{kind}' AS kind, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) + length(ms[k]) - length(own[k]) AS BIGINT) AS s, length(own[k]) AS n "
        f"FROM (SELECT rid, regexp_split_to_array(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {own}) AS own, regexp_extract_all(text, '{p}', {group}) AS g, "
        f"unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) AS k FROM d) WHERE length(g[k]) >= {least}"
    )


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(k, *row) for k, row in enumerate(_SQL_KINDS))}),
told AS (SELECT rid, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
  string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)
"""


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract's base by plain regexes, for tests: doc_id, the three counts, digest."""
    import re
    from hashlib import sha256

    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    out = []
    for doc_id, text in docs:
        spans = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= n]
        spans.sort()
        out.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()))
    return out
