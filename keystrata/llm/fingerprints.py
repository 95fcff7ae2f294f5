"""Document fingerprints by SpotSigs.

Texts are lower-cased and read as words. Common words of the corpus's languages are
anchors; a signature is the chain of the next two content words after an anchor, other
anchors between them passed over. The start of the text counts as an anchor. The set of a
text's signatures, hashed and sorted, is its fingerprint. A text too short for a chain has
its words as its only signature; empty and null texts have the empty signature.

Likeness is the Jaccard similarity of two sets. ``near_pairs`` finds all classes of equal
fingerprints that reach a threshold: sets are partitioned by length into bands, a set meets
only bands whose lengths can reach the threshold, and only through its rarest signatures
(pruned Jaccard); pairs are between class representatives, with membership beside.

DataFrame functions only, each in time linear in the text. Next to a document stands the one
of the next smaller doc_id (nulls last, equal ones by the text's hash, then by text). Rows are
put in order in buckets cut at quantiles of a bounded sample of (doc_id, hash), so that no
bucket has a fixed share of the table and rows of one doc_id, or none, are divided too; the
sample sets the cuts only. A bucket sees the first row of the one below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.arrays import let

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it not of on or that the their this to was were which with you "
    "als am auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nicht sich sie sind und von war wie zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il je la le les ne nous ont par pas pour que qui sa se son sur un une vous "
    "al como con del el ella ellos era los las lo más me mi no o para pero por su sus una uno y ya"
).split()

_WORD = r"[^\p{L}\p{N}]+"
#: Buckets at most, rows of the sample for each, and buckets of a coarse step.
MOST_BUCKETS, SAMPLED, _COARSE = 1 << 16, 8, 256


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's signatures."""

    def of(words):
        content = F.array_join(F.transform(F.split(words, " "), lambda w: F.when(w.isin(*ANCHORS), "").otherwise(w)), " ")
        # An anchor leaves two spaces behind: the content word after it, like the first of all, gets a mark.
        marked = F.concat(F.lit("\u0001"), F.regexp_replace(F.trim(content), " {2,}", " \u0001"))
        chains = F.regexp_extract_all(marked, F.lit("\u0001(?=([^ ]+ [^ ]+))"), F.lit(1))
        short = lambda c: F.substring(F.md5(F.replace(c, F.lit("\u0001"), F.lit(""))), 1, 8)
        return let(F.transform(chains, short), lambda c: F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c))).otherwise(F.array(short(words))))

    return let(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _WORD, " ")), of)


def packed(signs: Column) -> Column:
    """A set of signatures as bytes, four each, for a shuffle."""
    return F.unhex(F.array_join(signs, ""))


def unpacked(own: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(own)), F.lit(".{8}"), F.lit(0))


def fingerprint(signs: Column) -> Column:
    """A set of signatures as one string."""
    return F.array_join(signs, ".")


def likeness(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))


def _place(at: Column, tie: Column) -> Column:
    return F.struct(at.alias("at"), tie.alias("tie"))


def _bucketed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` (with place) and their bucket, by order of place; at most MOST_BUCKETS, each with about as many rows."""
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // bucket_rows))
    share = F.pmod(F.xxhash64("place"), F.lit(1 << 40)) / float(1 << 40)
    sampled = rows.select("place").where(share * n <= SAMPLED * buckets)
    cuts = sampled.agg(F.filter(F.array_sort(F.collect_set("place")), lambda p, i: i % SAMPLED == SAMPLED - 1).alias("cuts")).first()["cuts"]
    as_array = lambda own: F.array(*(_place(F.lit(c["at"]), F.lit(c["tie"])) for c in own)) if own else F.array().cast("array<struct<at:bigint,tie:bigint>>")
    below = lambda own: F.size(F.filter(own, lambda c: c <= F.col("place")))
    if len(cuts) < _COARSE:
        return rows.withColumn("bucket", below(as_array(cuts)))
    groups = [cuts[k : k + _COARSE] for k in range(0, len(cuts), _COARSE)]
    fine = rows.sparkSession.createDataFrame([(k, [tuple(c) for c in own]) for k, own in enumerate(groups)], "step int, fine array<struct<at:bigint,tie:bigint>>")
    step = F.greatest(below(as_array([own[0] for own in groups])) - 1, F.lit(0))
    return rows.withColumn("step", step).join(F.broadcast(fine), "step").withColumn("bucket", F.col("step") * (_COARSE + 1) + below(F.col("fine"))).drop("step", "fine")


def with_next(docs: DataFrame, bucket_rows: int = 2000) -> DataFrame:
    """(doc_id, text, signs, next, next_signs): every row with what the row after it in falling order of doc_id has, round to the first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = _place(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"))
    rows = _bucketed(rows.withColumn("place", place), bucket_rows)
    heads = rows.groupBy("bucket").agg(F.max("place").alias("place"))  # a row for each bucket
    order, whole = Window.orderBy(F.desc("bucket")), Window.partitionBy()
    above = F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(whole))  # the last sees the first of all
    heads = heads.select("place", above.alias("above"))
    to = F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("bucket"), F.lit(1).alias("guest")))))
    signed = rows.withColumn("signs", packed(signatures(F.col("text"))))
    dealt = signed.join(F.broadcast(heads), "place", "left").withColumn("to", F.explode(to))
    by = Window.partitionBy("to.bucket").orderBy("to.guest", F.desc("place"), F.desc("text"))
    after = F.lead(F.struct("text", "signs")).over(by)
    return dealt.select("doc_id", "text", "signs", "to.guest", after.alias("after")).where("guest = 0").select("doc_id", "text", unpacked(F.col("signs")).alias("signs"), F.col("after.text").alias("next"), unpacked(F.col("after.signs")).alias("next_signs"))


def edited(text: Column, after: Column) -> Column:
    """The last third of the code points replaced by as many of the next text's first."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(after, F.lit(1), k))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array(F.struct(F.col("signs").alias("own"), signatures(F.col("edited")).alias("edited"), F.col("next_signs").alias("next"))).alias("signs"))
    get = lambda s: F.struct(fingerprint(s["own"]).alias("fingerprint"), fingerprint(s["edited"]).alias("edited_fingerprint"), likeness(s["own"], s["edited"]).alias("near_edited"), likeness(s["own"], s["next"]).alias("near_next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.inline(F.transform("signs", get)))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(a, b, likeness) between classes of equal fingerprints, and membership (doc_id, class)."""
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.col("text")).alias("signs"))
    classes = signed.groupBy("signs").agg(F.min("doc_id").alias("class")).withColumn("n", F.size("signs"))
    members = signed.join(classes, "signs").select("doc_id", "class")
    rare = classes.select("class", "n", F.explode("signs").alias("sign"))
    known = rare.groupBy("sign").agg(F.count("*").alias("df")).where("df > 1")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "sign"))
    # Signatures met once cannot be shared; they fill the first places of a set's order.
    shared = rare.join(known, "sign").withColumn("rank", rank)
    held = F.max("rank").over(Window.partitionBy("class"))
    prefix = shared.withColumn("rank", F.col("rank") + F.col("n") - held).where(F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    band = lambda c: F.floor(F.log(c) / -F.log(F.lit(threshold)))
    a = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "sign", F.col("rank").alias("ra"), F.explode(F.array(band(F.col("n")), band(F.col("n")) + 1)).alias("band"))
    b = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sign", F.col("rank").alias("rb"), band(F.col("n")).alias("band"))
    reach = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1 >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    met = a.join(b, ["sign", "band"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & reach).select("a", "b").distinct()
    sets = lambda c: classes.select(F.col("class").alias(c), F.col("signs").alias(f"s{c}"))
    pairs = met.join(sets("a"), "a").join(sets("b"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb")))
    return pairs.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), members


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract by plain loops, for tests; rows of one doc_id have to differ in nothing."""
    import re
    from hashlib import md5, sha256

    short = lambda x: md5(x.encode()).hexdigest()[:8]

    def signs(text):
        words, out, spot, held = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" "), set(), True, []
        for w in words:
            if w in ANCHORS:
                spot = True
                continue
            out |= {short(f"{p} {w}") for p in held}
            held, spot = [w] if spot else [], False
        return sorted(out) or [short(" ".join(words))]

    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = (set(signs(x)) for x in (t, e, after))
        out.append((d, len(t), sha256(e.encode()).hexdigest(), ".".join(sorted(a)), ".".join(sorted(b)), len(a & b) / len(a | b), len(a & c) / len(a | c)))
    return out


_SIGNS_SQL = """
  SELECT doc_id, CASE WHEN len(s) > 0 THEN list_sort(list_distinct(s)) ELSE [substr(md5(array_to_string(w, ' ')), 1, 8)] END AS {0}
  FROM (SELECT doc_id, w, list_transform(list_filter(range(1, len(c)), lambda k: k = 1 OR c[k] - c[k - 1] > 1), lambda k: substr(md5(concat(w[c[k]], ' ', w[c[k + 1]])), 1, 8)) AS s
    FROM (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({1}, w[i])) AS c
      FROM (SELECT doc_id, string_split(trim(regexp_replace(lower({2}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM e)))"""
_LIKE_SQL = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"

#: For tables whose doc_ids differ.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, concat(substr(text, 1, n - n // 3), substr(next, 1, n // 3)) AS edited FROM n),
a AS ({_SIGNS_SQL.format("own", list(ANCHORS), "text")}), b AS ({_SIGNS_SQL.format("other", list(ANCHORS), "edited")}), c AS ({_SIGNS_SQL.format("after", list(ANCHORS), "next")})
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '.') AS fingerprint, array_to_string(other, '.') AS edited_fingerprint,
  {_LIKE_SQL.format("own", "other")} AS near_edited, {_LIKE_SQL.format("own", "after")} AS near_next FROM e JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN c USING (doc_id)
"""
