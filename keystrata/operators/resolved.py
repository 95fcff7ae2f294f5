"""JavaScript calls resolved to the module they come from, and what their arguments say.

One pass over a file's text gives its events: imports, declarations, heads of functions, calls
and braces. Braces are matched by depth: within a file and depth, the enclosing brace of an
event is the last one opened before it and the next one closed after it, two windows over
sorted rows. So a declaration holds in a range of offsets, and a name means its innermost
declaration around it, a join on (file, name). Declarations that name others are followed by
pointer jumping: a round doubles what is followed, six rounds at most, so chains of 64 names. Calls that reach one of the four
APIs keep a slice of the text behind them, which is cut at the commas of its own depth.

What is not read: values that go through calls, reassignment, patterns in patterns, object
literals inside others as options, a second declarator after a comma, ``eval``; ``var`` holds in
the whole file. A name that nothing declares is a global, one from another module a local. Parameters and other declarations without a known value hide
what is outside. Files without a name of the APIs are left before any of this.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions import calls
from keystrata.functions import resolved as facts
from keystrata.functions.arrays import chunks, cut, let, running_totals
from keystrata.sources.shared import saved

from .source import kept, language, strip_comments

FILE = ["target", "path"]
#: Characters behind a call that its arguments are read from; rounds that follow chains of names.
REACH, JUMPS = 2048, 6
_ID = r"[A-Za-z_$][\w$]*+"
_CHAIN = rf"{_ID}(?:\s*+!?\s*+\??\.\s*+{_ID})*+"
_Q = r"""(?:"[^"\\\n]*+"|'[^'\\\n]*+'|`[^`\\$]*+`)"""
_STRING = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?+|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?+|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?+"""
_IMPORT = rf"\bimport\s+(?:{_ID}\s*=\s*require\(\s*{_Q}\s*\)|(?!type\b)[\w$*{{}}\s,]+?\s*from\s*{_Q})"
_PARAMS, _TYPE = r"\([^()]*+\)", r"(?:\s*+:[^{};=()]*+)?"
_INIT = (
    rf"(?:(?:(?:await\s+)?(?:import|(?:{_ID}\(\s*)?require)\(\s*{_Q}\s*\)(?:\s*\))?(?:\s*\.\s*{_ID})*+|{_CHAIN}|{_Q}|\{{[^{{}}]*+\}}|\[[^\[\]]*+\])(?=\s*(?:as\s+const\s*)?(?:[;,\n)}}]|\z))"
    rf"|(?:await\s+)?new\s+{_CHAIN}(?=\s*\())"
)
_DECL = rf"\b(?:const|let|var)\s+(?:{_ID}|\{{[^{{}}]*+\}}|\[[^\[\]]*+\])(?:\s*:\s*[\w$.<>\[\]| ]+?)?\s*(?:=(?![=>])\s*(?:{_INIT})?|\b(?:of|in)\b|(?=[;\n,)]))"
_KEYWORDS = "if|for|while|switch|catch|with|function|return|typeof|await|import|super"
_HEAD = rf"\b(?:async\s+)?function\s*\*?\s*(?:{_ID})?\s*{_PARAMS}{_TYPE}\s*\{{|\bcatch\s*{_PARAMS}\s*\{{|(?:{_PARAMS}{_TYPE}|(?<![\w$.]){_ID})\s*=>\s*\{{?|(?<![\w$.])(?!(?:{_KEYWORDS})\b){_ID}\s*{_PARAMS}{_TYPE}\s*\{{"
_CALL = rf"(?<![\w$.])(?:new\s+)?(?:require\(\s*{_Q}\s*\)|\(\s*(?:0\s*,\s*)?{_CHAIN}(?:\s+as\s+[\w.]+)?\s*\)|{_ID})(?:\s*+!?\s*+\??\.\s*+{_ID})*+\s*!?\s*(?:\?\.\s*)?\("
_CLASS = rf"\bclass\s+{_ID}"
_EVENTS = "|".join((_STRING, _IMPORT, _DECL, _HEAD, _CLASS, r"\)\s*\.\s*setProtectedHeader\s*\(", _CALL, r"[{}]"))
#: An event begins with a quote, a bracket or a name; a name that no event can follow is passed in one look.
_EVENT = rf"(?=[\"'`{{}}()]|(?<![\w$.])(?:(?:{_ID}(?:\s*+!?\s*+\??\.\s*+{_ID})*+\s*+[!?.=(]|(?:import|const|let|var|async|function|class|new|await|catch)\b)))(?:{_EVENTS})"
_PIECE = rf"""{_STRING}|[()\[\]{{}},]|[^"'`()\[\]{{}},]++"""


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _plain(text: Column) -> Column:
    """A chain of names without blanks, ``?`` and ``!``."""
    return F.regexp_replace(text, r"[\s?!]", "")


def parts(text: Column) -> Column:
    """The parts of a text between its commas, up to the bracket that closes what is around it; brackets and strings stay whole."""

    def split(found):
        step = lambda t: F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        depth = lambda deep: F.arrays_zip(found.alias("t"), deep.alias("d"))

        def joined(pieces):
            end = F.coalesce(F.get(F.filter(F.transform(pieces, lambda p, i: F.when(p["t"].isin(")", "]", "}") & (p["d"] <= 0), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(pieces))
            own = F.transform(F.slice(pieces, F.lit(1), end), lambda p: F.when((p["t"] == ",") & (p["d"] == 0), F.lit("\u0001")).otherwise(p["t"]))
            return F.transform(F.split(F.array_join(own, ""), "\u0001"), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"( as [\w. ]+|!)$", ""))

        return let(depth(running_totals(F.transform(found, step))), joined)

    return let(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), split)


def events(files: DataFrame) -> DataFrame:
    """Target, path, token, at, line, depth (of open braces before it) and behind (the text after it) of every event."""
    named = reduce(or_, (F.contains("content", F.lit(n)) for n in facts.NAMES))
    rows = strip_comments(kept(files).where((language(F.col("path")) == "javascript") & named))
    text = F.col("content")
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))

    def placed(found):
        between = F.slice(F.split(text, _EVENT, -1), F.lit(1), F.size(found))
        both = lambda own: F.zip_with(between, found, lambda b, m: own(b) + own(m))
        deep = F.transform(found, lambda m: F.when(F.endswith(m, F.lit("{")) & ~F.rlike(m, F.lit("^[\"'`]")), 1).when(m == "}", -1).otherwise(0))
        rows = F.arrays_zip(found.alias("token"), between.alias("b"), running_totals(both(F.length)).alias("at"), running_totals(both(breaks)).alias("line"), running_totals(deep).alias("depth"))

        def cutting(pieces):
            def event(x):
                at = x["at"] + F.length(x["b"])
                end = at + F.length(x["token"])
                behind = F.when(F.endswith(x["token"], F.lit("(")) | F.rlike(x["token"], F.lit(r"=>\s*$")), cut(pieces, end, end + REACH))
                return F.struct(x["token"].alias("token"), at.cast("long").alias("at"), (x["line"] + breaks(x["b"]) + 1).alias("line"), x["depth"].alias("depth"), behind.alias("behind"))

            return F.filter(F.transform(rows, event), lambda e: ~F.rlike(e["token"], F.lit("^[\"'`]")))

        return let(chunks(text), cutting)

    return rows.select(*FILE, F.inline(let(F.regexp_extract_all(text, F.lit(_EVENT), F.lit(0)), placed)))


def scoped(found: DataFrame) -> DataFrame:
    """Events with the range of offsets (lo, hi) between the braces around them; a head's range is that of its body."""
    token = F.col("token")
    opens, closes = F.endswith(token, F.lit("{")), token == "}"
    # the name of a function holds around its body, so it is an event of its own; a brace and what it closes count to the depth inside it
    named = rf"^(?:async\s+)?function\s*\*?\s*{_ID}"
    names = found.where(F.rlike(token, F.lit(named))).withColumn("token", F.regexp_extract("token", named, 0))
    rows = found.unionByName(names).withColumn("level", F.when(opens, F.col("depth") + 1).otherwise(F.col("depth")))
    by = Window.partitionBy(*FILE, "level").orderBy("at")
    lo = F.max(F.when(opens, F.col("at"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.min(F.when(closes, F.col("at"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    outer = F.when(F.col("level") > 0, lo), F.when(F.col("level") > 0, hi)
    line = F.col("at") + F.length(token) + F.length(F.regexp_extract("behind", r"^[^;\n]*+", 0))  # an arrow without braces
    short = F.rlike(token, F.lit(r"=>\s*$"))
    return rows.withColumns({"lo": F.when(short, F.col("at")).otherwise(F.coalesce(outer[0], F.lit(-1))).cast("long"), "hi": F.when(short, line).otherwise(F.coalesce(outer[1], F.lit(1 << 62))).cast("long")})


def _value(init: Column) -> dict[str, Column]:
    """What a declaration's right side is: kind, module, root (a name), steps (names after it) and text."""
    bare = _plain(init)
    module = _first(init, rf"(?:import|require)\(\s*[\"'`]([^\"'`]*)")
    after = F.filter(F.split(_first(init, rf"\)\s*((?:\.\s*{_ID}\s*)++)$"), r"\s*\.\s*"), lambda s: s != "")
    built = _first(init, rf"^(?:await\s+)?new\s+({_CHAIN})")
    wrapped = _first(init, rf"^({_ID})\(\s*require")
    chain = F.rlike(bare, F.lit(rf"^{_ID}(?:\.{_ID})*+$"))
    kind = F.when(module.isNotNull(), F.when(wrapped.isNull() | wrapped.isin(*facts.HELPERS), "module").otherwise("unknown")).when(built.isNotNull(), "builder").when(chain, "name")
    names = F.split(F.coalesce(F.when(built.isNotNull(), _plain(built)), bare), r"\.")
    told = module.isNull() & (built.isNotNull() | chain)
    return {
        "kind": kind.when(F.rlike(init, F.lit("^[\"'`{\\[]")), "text").otherwise("unknown"),
        "module": module,
        "root": F.when(told, F.get(names, F.lit(0))),
        "steps": F.coalesce(F.when(told, F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0)))), F.when(module.isNotNull(), after), F.array().cast("array<string>")),
        "text": init,
    }


def declarations(rows: DataFrame) -> DataFrame:
    """id, name, lo, hi, at, stable, kind, module, root, steps and text of every name declared."""
    token, none = F.col("token"), lambda: F.array().cast("array<string>")
    pair = lambda n, s: F.struct(n.alias("name"), s.alias("own"))
    body = lambda t: F.split(F.regexp_extract(t, r"\{([^{}]*)\}", 1), ",")
    listed = lambda t, sep: F.filter(F.transform(body(t), lambda p: pair(F.coalesce(_first(p, rf"^\s*{_ID}{sep}({_ID})"), _first(p, rf"^\s*(?:\.\.\.)?({_ID})")), F.when(F.startswith(F.trim(p), F.lit("...")), F.array(F.lit("?"))).otherwise(F.array(F.regexp_extract(p, rf"({_ID})", 1))))), lambda x: x["name"].isNotNull())
    # imports: a default name or * is the module, unless jose, whose default is a member
    imported = F.filter(F.concat(F.array(pair(_first(token, rf"^import\s+({_ID})\s*[,=f]"), none()), pair(_first(token, rf"\*\s*as\s+({_ID})"), none())), F.when(F.contains(token, F.lit("{")), listed(token, r"\s+as\s+")).otherwise(F.array().cast("array<struct<name:string,own:array<string>>>"))), lambda x: x["name"].isNotNull())
    module = F.coalesce(_first(token, r"from\s*[\"'`]([^\"'`]*)"), _first(token, r"require\(\s*[\"'`]([^\"'`]*)"))
    imports = rows.where(F.startswith(token, F.lit("import"))).select(*FILE, "at", F.lit(-1).cast("long").alias("lo"), F.lit(1 << 62).cast("long").alias("hi"), F.inline(imported), F.lit(True).alias("stable"), F.lit("module").alias("kind"), module.alias("module"), F.lit(None).cast("string").alias("root"), none().alias("steps"), F.lit(None).cast("string").alias("text"))
    # const, let, var
    said = rows.where(F.rlike(token, F.lit(r"^(?:const|let|var)\s")))
    left, init = F.regexp_extract(token, rf"^\w+\s+({_ID}|\{{[^{{}}]*\}}|\[[^\[\]]*\])", 1), F.regexp_replace(F.regexp_extract(token, r"(?s)^\w+\s+(?:[A-Za-z_$][\w$]*|\{[^{}]*\}|\[[^\[\]]*\])(?:\s*:[^=]*)?\s*=\s*(.*)$", 1), r"\s+$", "")
    lefts = F.when(F.startswith(left, F.lit("{")), listed(left, r"\s*:\s*")).when(F.startswith(left, F.lit("[")), F.transform(F.regexp_extract_all(left, F.lit(_ID), F.lit(0)), lambda n: pair(n, F.array(F.lit("?"))))).otherwise(F.array(pair(left, none())))
    value = said.withColumns({"init": init, "names": lefts}).withColumns({f"v_{k}": v for k, v in _value(F.col("init")).items()})
    var = F.startswith(token, F.lit("var"))
    spoken = value.select(*FILE, "at", F.when(var, F.lit(-1)).otherwise(F.col("lo")).cast("long").alias("lo"), F.when(var, F.lit(1 << 62)).otherwise(F.col("hi")).cast("long").alias("hi"), F.inline("names"), F.startswith(token, F.lit("const")).alias("stable"), *[F.col(f"v_{k}").alias(k) for k in ("kind", "module", "root", "steps", "text")])
    # names without a known value: functions, classes, parameters (in their body)
    blank = [F.lit(False).alias("stable"), F.lit("unknown").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("module", "root")], none().alias("steps"), F.lit(None).cast("string").alias("text")]
    heads = rows.where(F.rlike(token, F.lit(r"=>\s*\{?$|\)[^()]*\{$")))
    params = F.coalesce(_first(token, r"\(([^()]*)\)[^()]*$"), _first(token, rf"^({_ID})\s*=>"))
    inner = heads.select(*FILE, "at", "lo", "hi", F.explode(F.regexp_extract_all(F.regexp_replace(params, rf":\s*[\w$.<>\[\]| ]+|=[^,]*|{_ID}\s*:(?=\s*{_ID}\s*[,}}])", " "), F.lit(_ID), F.lit(0))).alias("name"), none().alias("own"), *blank)
    functions = rows.where(F.rlike(token, F.lit(rf"^(?:(?:async\s+)?function\s*\*?|class)\s*{_ID}$"))).select(*FILE, "at", "lo", "hi", _first(token, rf"({_ID})$").alias("name"), none().alias("own"), *blank)
    return imports.unionByName(spoken).unionByName(inner).unionByName(functions).withColumns({"id": F.concat_ws(" ", F.col("at").cast("string"), "name"), "steps": F.concat("steps", "own")}).drop("own")


_INSIDE = lambda name: (F.col(f"{name}.lo") <= F.col("own.at")) & (F.col("own.at") < F.col(f"{name}.hi"))


def meant(rows: DataFrame, known: DataFrame, root: str, keep: list[str]) -> DataFrame:
    """``rows`` with the columns ``keep`` of the innermost declaration of the name in ``root`` around each; they need a key column ``key`` and ``at``."""
    held = rows.alias("own").join(known.alias("d"), [F.col(f"own.{c}") == F.col(f"d.{c}") for c in FILE] + [F.col(f"own.{root}") == F.col("d.name"), _INSIDE("d")])
    best = held.groupBy(*[F.col(f"own.{c}").alias(c) for c in FILE], F.col("own.key").alias("key")).agg(F.max_by(F.struct(*[F.col(f"d.{c}").alias(c) for c in keep]), F.struct("d.lo", "d.at")).alias("m"))
    return rows.join(best, [*FILE, "key"], "left")


def bindings(known: DataFrame) -> DataFrame:
    """The declarations, those that name others replaced by what they lead to: kind, module, root, steps, stable, text; a builder keeps that it is one."""
    named = known.where(F.col("kind").isin("name", "builder"))
    plain = known.where(~F.col("kind").isin("name", "builder"))
    others = known.select(*FILE, "name", "lo", "hi", "at", "id")
    start = meant(named.withColumn("key", F.col("id")), others, "root", ["id"])
    pointer = start.select(*FILE, "id", F.when(F.col("m.id") != F.col("id"), F.col("m.id")).alias("next"), "root", "steps", "stable", (F.col("kind") == "builder").alias("built"))
    pointer = saved(pointer, "names")
    for _ in range(JUMPS):
        if not pointer.join(pointer.select(*FILE, F.col("id").alias("next")), [*FILE, "next"], "left_semi").limit(1).count():
            break
        far = pointer.select(*FILE, F.col("id").alias("next"), F.col("next").alias("f_next"), F.col("root").alias("f_root"), F.col("steps").alias("f_steps"), F.col("stable").alias("f_stable"), F.col("built").alias("f_built"), F.lit(True).alias("f"))
        own = lambda c: F.when(F.col("f"), F.col(f"f_{c}")).otherwise(F.col(c))
        pointer = pointer.join(far, [*FILE, "next"], "left").select(
            *FILE, "id", own("next").alias("next"), own("root").alias("root"), F.concat(F.coalesce("f_steps", F.array().cast("array<string>")), "steps").alias("steps"), (F.col("stable") & F.coalesce("f_stable", F.lit(True))).alias("stable"), (F.col("built") | F.coalesce("f_built", F.lit(False))).alias("built")
        )
        pointer = saved(pointer, "names")
    end = plain.select(*FILE, F.col("id").alias("next"), F.col("kind").alias("e_kind"), F.col("module").alias("e_module"), F.col("steps").alias("e_steps"), F.col("stable").alias("e_stable"), F.col("text").alias("e_text"), F.col("name").alias("e_name"))
    led = pointer.join(end, [*FILE, "next"], "left").select(
        *FILE, "id", F.coalesce("e_kind", F.lit("global")).alias("kind"), F.col("e_module").alias("module"), F.coalesce("e_name", "root").alias("root"), F.concat(F.coalesce("e_steps", F.array().cast("array<string>")), "steps").alias("steps"),
        (F.col("stable") & F.coalesce("e_stable", F.lit(True))).alias("stable"), F.col("e_text").alias("text"), "built",
    )
    place = known.select(*FILE, "id", "name", "lo", "hi", "at")
    rest = plain.select(*FILE, "id", "kind", "module", F.col("name").alias("root"), "steps", "stable", "text", F.lit(False).alias("built"))
    return rest.unionByName(led).join(place, [*FILE, "id"])


def _calls(rows: DataFrame) -> DataFrame:
    """Every call and construction: root (a name) or module, steps (the names after it), built (with ``new``) and behind."""
    token = F.col("token")
    # of a declaration that constructs something, the construction is a call too
    made = F.regexp_extract(token, rf"^(?:const|let|var)\s[^=]*=\s*(?:await\s+)?(new\s+{_CHAIN})$", 1)
    declared = rows.where(made != "").withColumns({"at": (F.col("at") + F.length(token) - F.length(made)).cast("long"), "token": F.concat(made, F.lit("("))})
    called = rows.where(F.endswith(token, F.lit("(")) & ~F.rlike(token, F.lit(rf"^(?:{_KEYWORDS})\s*\($"))).unionByName(declared)
    new = F.rlike(token, F.lit(r"^new\s"))
    head = F.regexp_replace(F.regexp_replace(token, r"^new\s+", ""), r"\s*(?:\?\.)?\s*\($", "")
    module = _first(head, r"^require\(\s*[\"'`]([^\"'`]*)")
    opened = F.regexp_replace(F.regexp_replace(head, r"^\(\s*(?:0\s*,\s*)?", ""), r"(?:\s+as\s+[\w.]+)?\s*\)", "")
    chain = F.filter(F.split(_plain(F.when(module.isNotNull(), F.regexp_replace(head, r"^require\([^)]*\)", "")).otherwise(opened)), r"\."), lambda s: s != "")
    linked = F.startswith(token, F.lit(")"))
    steps = F.when(module.isNotNull(), chain).when(linked, F.array(F.lit("setProtectedHeader"))).otherwise(F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))))
    before = Window.partitionBy(*FILE).orderBy("at")
    out = called.select(*FILE, "at", "line", "behind", module.alias("own_module"), F.when(module.isNull() & ~linked, F.get(chain, F.lit(0))).alias("root"), steps.alias("own_steps"), new.alias("new"), linked.alias("linked"))
    # a method behind a bracket belongs to what was constructed last
    class_ = F.last(F.when(F.col("new"), F.col("root")), ignorenulls=True).over(before)
    out = out.withColumn("root", F.when(F.col("linked"), class_).otherwise(F.col("root")))
    return out.withColumn("key", F.concat_ws(" ", F.col("at").cast("string"), "linked"))


def _api(rows: DataFrame) -> DataFrame:
    """Calls with api, method, tier and whether they are found by name only (heuristic, by_receiver)."""
    module = F.coalesce("own_module", F.when(F.col("m.kind") == "module", F.col("m.module")))
    path = F.concat(F.coalesce(F.when(F.col("m.kind") == "module", F.col("m.steps")), F.array().cast("array<string>")), "own_steps")
    known = F.create_map(*(F.lit(x) for p in facts.MODULES.items() for x in p))[module]
    path = F.when((F.get(path, F.lit(0)) == "default") & (known != "jose"), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)
    globe = F.col("m").isNull() | (F.col("m.kind") == "global")
    chain = F.concat(F.array(F.coalesce("m.root", "root")), F.coalesce(F.when(F.col("m.kind") == "global", F.col("m.steps")), F.array().cast("array<string>")), "own_steps")
    chain = F.when(globe & F.get(chain, F.lit(0)).isin(*facts.GLOBALS), F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0)))).otherwise(chain)
    rows = rows.withColumns({"known": known, "reach": F.when(known.isNotNull(), path).otherwise(chain), "far": known.isNotNull(), "globe": globe, "stable": F.coalesce("m.stable", F.lit(True))})
    n, last = F.size("reach"), F.element_at("reach", -1)
    receiver = F.array_join(F.slice("reach", F.lit(1), F.greatest(n - 1, F.lit(0))), ".")
    named = F.when(n > 1, F.get("reach", n - 2))
    built = F.col("m.built") & (F.col("known") == "jose") & F.get("m.steps", F.lit(0)).isin(*facts.BUILDERS)
    by_class = F.col("linked") & (F.col("known") == "jose") & F.get("reach", F.lit(0)).isin(*facts.BUILDERS)
    api = (
        F.when(built | by_class, F.when(last == "setProtectedHeader", "jose")).when(F.col("m.built"), F.lit(None)).when(last == "setProtectedHeader", F.lit(None))
        .when(F.col("far") & (receiver == ""), F.col("known"))
        .when(F.col("far"), F.when((F.col("known") == "node:crypto") & receiver.isin("subtle", "webcrypto.subtle"), "webcrypto"))
        .when(n < 2, F.lit(None)).when(named == "subtle", "webcrypto").when(named == "jwt", "jsonwebtoken").otherwise("node:crypto")
    )
    sure = F.when(F.col("far"), F.col("stable")).otherwise((named == "subtle") & F.col("globe") & (receiver == "crypto.subtle"))
    rows = rows.withColumns({"api": api, "method": last, "tier": F.when(sure, "confirmed").otherwise("high"), "heuristic": ~F.col("far") & (named != "subtle"), "by_receiver": named.isin("jwt", "crypto")})
    return rows.where(F.col("api").isNotNull() & ~F.exists("reach", lambda s: s == "?") & (~F.col("new") | (F.col("method") == "UnsecuredJWT")) & (F.col("new") | (F.col("method") != "UnsecuredJWT")))


def _string(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit("${")), F.regexp_extract(F.when(F.rlike(text, F.lit("^(?:\"[^\"]*\"|'[^']*'|`[^`]*`)$")), text), "(?s)^.(.*).$", 1))


def _fields(text: Column) -> Column:
    """Key and value of each part of an object literal; the key of a spread or computed part is ``?``."""
    inner = parts(F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))
    return F.transform(inner, lambda p: F.struct(F.coalesce(_first(p, rf"^[\"']?({_ID})[\"']?\s*:"), _first(p, rf"^({_ID})$"), F.when(F.trim(p) != "", F.lit("?"))).alias("k"), F.trim(F.regexp_replace(p, rf"^[\"']?{_ID}[\"']?\s*:", "")).alias("v")))


def _field(fields: Column, key: Column | str) -> Column:
    return F.get(F.filter(fields, lambda f: f["k"] == (F.lit(key) if isinstance(key, str) else key)), F.lit(0))["v"]


def resolved_calls(files: DataFrame) -> DataFrame:
    """Target, path, at, line, api, method, rule, algorithm, bits, confidence and severity of every call of the four APIs that says something."""
    rows = saved(scoped(events(files)), "events")
    known = saved(bindings(saved(declarations(rows), "declarations")), "bindings")
    found = _api(meant(_calls(rows), known, "root", ["kind", "module", "root", "steps", "stable", "text", "built"]))
    dimension = F.broadcast(files.sparkSession.createDataFrame(facts.table(), "api string, method string, distinctive boolean, from string, place int, option string, family string"))
    own = found.join(dimension, ["api", "method"]).where(~F.col("heuristic") | F.col("distinctive") | F.col("by_receiver"))
    own = own.select(*FILE, "at", "line", "api", "method", "tier", "from", "place", "option", "family", parts(F.col("behind")).alias("args")).withColumn("key", F.concat_ws(" ", F.col("at").cast("string"), "family"))
    text = F.get("args", F.col("place"))
    own = own.withColumns({"arg": F.when(F.col("from") != "call", F.nullif(F.trim(text), F.lit(""))), "more": F.when(F.col("family") == "keypair", F.get("args", F.lit(1)))})
    for c in ("arg", "more"):  # a name that stands for a text, an object or a list
        named = own.withColumn("name_", _first(F.col(c), rf"^({_ID})$"))
        own = meant(named, known.where("kind = 'text'").unionByName(known.where("kind <> 'text'").withColumn("text", F.lit(None).cast("string"))), "name_", ["text"]).withColumn(c, F.coalesce("m.text", F.col(c))).drop("m", "name_")
    arg, empty = F.col("arg"), F.array().cast("array<struct<k:string,v:string>>")
    opened = F.startswith(arg, F.lit("{"))
    own = own.withColumns({"fields": F.when(opened, _fields(arg)).otherwise(empty), "more_fields": F.when(F.startswith(F.col("more"), F.lit("{")), _fields(F.col("more"))).otherwise(empty)})
    both = F.concat(F.when(F.col("from") == "algorithm", F.col("fields")).otherwise(empty), "more_fields")
    scalar = lambda v: F.coalesce(_string(v), _first(v, r"^(\d[\d_]*)$"), _string(_field(_fields(v), "name")))
    own = own.withColumn("params", F.map_from_entries(F.transform(F.array(*[F.lit(k) for k in ("modulusLength", "primeLength", "group", "namedCurve", "hash", "hashAlgorithm", "name")]), lambda k: F.struct(k, scalar(_field(both, k))))))
    told = lambda token, size, dynamic, absent: F.struct(token.alias("token"), size.alias("size"), dynamic.alias("dynamic"), absent.alias("absent"))
    no, yes, null = F.lit(False), F.lit(True), F.lit(None).cast("string")
    none, runtime, missing = F.lit(None).cast("int"), F.array(told(null, F.lit(None).cast("int"), yes, no)), F.array(told(null, F.lit(None).cast("int"), no, yes))
    one = lambda token: F.array(told(token, none, no, no))
    value = _field(F.col("fields"), F.col("option"))
    items = F.transform(F.filter(parts(F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1)), lambda p: F.trim(p) != ""), lambda p: _string(F.trim(p)))
    listed = F.concat(F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: told(i, none, no, no)), F.when(F.exists(items, lambda i: i.isNull()), runtime).otherwise(F.slice(runtime, 1, 0)))
    spread = F.exists("fields", lambda f: f["k"] == "?")
    options = F.when(F.rlike(arg, F.lit(r"^(?:async\s+)?function\b|=>")) & ~opened, missing).when(~opened, runtime).when(value.isNull(), F.when(spread, runtime).otherwise(missing)).when(_string(value).isNotNull(), one(_string(value)))
    options = options.when(F.startswith(value, F.lit("[")), F.when(F.size(listed) > 0, listed).otherwise(missing)).otherwise(runtime)
    name = F.coalesce(_string(arg), F.when(opened, _string(_field(F.col("fields"), "name"))))
    algorithm = F.when(name.isNotNull(), one(name)).otherwise(runtime)
    number = F.regexp_extract(arg, r"^(\d+)$", 1).try_cast("int")
    plain = F.when(_string(arg).isNotNull(), one(_string(arg))).when(number.isNotNull(), F.array(told(null, number, no, no))).otherwise(runtime)
    said = F.when((F.col("from") == "call") | arg.isNull(), missing).when(F.col("from") == "value", plain).when(F.col("from") == "algorithm", algorithm).otherwise(options)
    out = own.select(*FILE, "at", "line", "api", "method", "tier", "family", "params", F.inline(said)).withColumns(facts.classified()).where(F.col("rule").isNotNull())
    rules = F.broadcast(files.sparkSession.createDataFrame(calls.rules(), "rule string, base string, pq_status string, usage string"))
    size = F.regexp_extract("curve", r"(\d{3})", 1).try_cast("int")
    worse = F.when(F.col("bits") < 1024, "critical").when((F.col("bits") < 2048) | (size < 224) | F.rlike("digest", F.lit(r"(?i)md[245]|sha-?1(?!\d)")), F.when(F.col("base") == "critical", "critical").otherwise("high"))
    return out.join(rules, "rule").select(*FILE, "at", "line", "api", "method", "rule", "algorithm", "bits", F.when((F.col("family") == "jwt-default") & F.col("absent"), "high").otherwise(F.col("tier")).alias("confidence"), F.coalesce(worse, "base").alias("severity"))
