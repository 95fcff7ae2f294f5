"""Declared packages read from manifests and lock files, and the manifest that owns a call site.

Each reader is narrow: one pass over the file's text with built-in functions. Only the
forward fill of sections sorts, within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (file name, kind, ecosystem).
KINDS = (
    ("package.json", "npm-manifest", "npm"),
    ("package-lock.json", "npm-lock", "npm"),
    ("requirements.txt", "requirements", "pypi"),
    ("pyproject.toml", "pyproject", "pypi"),
    ("Cargo.toml", "cargo-manifest", "crates"),
    ("Cargo.lock", "cargo-lock", "crates"),
    ("yarn.lock", "yarn-lock", "npm"),
    ("poetry.lock", "poetry-lock", "pypi"),
    ("uv.lock", "uv-lock", "pypi"),
    ("pnpm-lock.yaml", "pnpm-lock", "npm"),
    ("Pipfile.lock", "pipfile-lock", "pypi"),
)
STANZA_LOCKS = ("Cargo.lock", "poetry.lock", "uv.lock")
_NPM_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kinds(files: DataFrame) -> DataFrame:
    """(target, path, kind, ecosystem); both null for a file that is read by none."""
    kind = ecosystem = F.lit(None).cast("string")
    for name, k, e in KINDS:
        kind = F.when(file_name(F.col("path")) == name, k).otherwise(kind)
        ecosystem = F.when(file_name(F.col("path")) == name, e).otherwise(ecosystem)
    return files.select("target", "path", kind.alias("kind"), ecosystem.alias("ecosystem"))


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(file_name(F.col("path")).isin(*names))


def npm(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of every section of package.json; text that is no JSON gives no row."""
    parsed = F.from_json("content", ", ".join(f"{s} map<string,string>" for s in _NPM_SECTIONS))
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    rows = _named(files, "package.json").withColumn("parsed", parsed)
    entries = F.concat(*(F.coalesce(F.map_entries(F.col("parsed")[s]), none) for s in _NPM_SECTIONS))
    return rows.select("target", "path", F.inline(entries).alias("name", "version"))


def requirements(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of requirement lines; continuations joined, comments, options, extras and markers left out."""
    joined = F.regexp_replace("content", r"\\\r?\n", " ")
    lines = _named(files, "requirements.txt").select("target", "path", F.explode(F.split(joined, r"\r?\n")).alias("line"))
    rows = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(?:^|\s)#.*$", ""))).where(F.col("line").rlike("^[A-Za-z0-9]"))
    spec = F.regexp_extract("line", r"^[A-Za-z0-9._-]+\s*(?:\[[^\]]*\])?\s*([^;]*?)\s*(?:;|\s--|$)", 1)
    return rows.select("target", "path", F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1).alias("name"), spec.alias("version"))


def stanza_locks(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of the package stanzas of Cargo.lock, poetry.lock and uv.lock."""
    parts = F.split("content", r"(?m)^\[\[package\]\]")
    rows = _named(files, *STANZA_LOCKS).select("target", "path", F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("part"))
    field = lambda k: F.regexp_extract("part", rf'(?m)^{k} = "([^"]+)"', 1).alias(k)
    return rows.select("target", "path", field("name"), field("version")).where("name <> ''")


def npm_lock(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of the ``packages`` of package-lock.json; the root, links and workspace paths give no row."""
    parsed = F.from_json("content", "packages map<string,struct<name:string,version:string,link:boolean>>")["packages"]
    rows = _named(files, "package-lock.json").select("target", "path", F.explode(parsed).alias("key", "own"))
    place = F.regexp_extract("key", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    rows = rows.where((place != "") & ~F.coalesce("own.link", F.lit(False)) & F.col("own.version").isNotNull())
    return rows.select("target", "path", F.coalesce("own.name", place).alias("name"), "own.version")


#: Levels of nested ``dependencies`` that a version 1 lock is read to.
LOCK_LEVELS = 6


def npm_lock_v1(files: DataFrame) -> DataFrame:
    """(target, path, name, version, whole) of the nested ``dependencies`` of a package-lock.json without ``packages``.

    ``whole`` is false for a package whose own dependencies lie below LOCK_LEVELS and are not
    read. Packages without a version and text that is no JSON give no row.
    """
    level = "string"
    for _ in range(LOCK_LEVELS):
        level = f"map<string,struct<version:string,dependencies:{level}>>"

    def packages(own: Column, levels: int) -> Column:
        entries = F.map_entries(own)
        whole = lambda e: e["value"]["dependencies"].isNull() if levels == 1 else F.lit(True)
        found = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"]["version"].alias("version"), whole(e).alias("whole")))
        if levels > 1:
            below = F.filter(entries, lambda e: e["value"]["dependencies"].isNotNull())
            found = F.concat(found, F.flatten(F.transform(below, lambda e: packages(e["value"]["dependencies"], levels - 1))))
        return found

    parsed = F.from_json("content", f"packages string, dependencies {level}")
    rows = _named(files, "package-lock.json").select("target", "path", parsed.alias("lock")).where("lock.packages is null")
    return rows.select("target", "path", F.inline(packages(F.col("lock.dependencies"), LOCK_LEVELS)).alias("name", "version", "whole")).where("version is not null")


def pnpm_lock(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of the keys below ``packages:`` of pnpm-lock.yaml, of all its formats; peers in brackets or after ``_`` are left off."""
    section = F.filter(F.split("content", r"\r?\n(?=[^\s#])"), lambda part: F.startswith(part, F.lit("packages:")))
    line = F.explode(F.flatten(F.transform(section, lambda part: F.split(part, r"\r?\n")))).alias("line")
    key = r"^  ['\"]?/?((?:@[^/@\s]+/)?[^/@\s:'\"]+)[@/]([0-9][^\s:'\"()_/]*)[^:]*:\s*$"
    rows = _named(files, "pnpm-lock.yaml").select("target", "path", line)
    rows = rows.select("target", "path", F.regexp_extract("line", key, 1).alias("name"), F.regexp_extract("line", key, 2).alias("version"))
    return rows.where("name <> ''")


def pipfile_lock(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of both sections of Pipfile.lock, without ``==``; packages without a version give no row."""
    parsed = F.from_json("content", ", ".join(f"{s} map<string,struct<version:string>>" for s in ("default", "develop")))
    none = F.expr("cast(array() as array<struct<key:string,value:struct<version:string>>>)")
    rows = _named(files, "Pipfile.lock").withColumn("parsed", parsed)
    entries = F.concat(*(F.coalesce(F.map_entries(F.col("parsed")[s]), none) for s in ("default", "develop")))
    rows = rows.select("target", "path", F.inline(entries).alias("name", "own"))
    return rows.select("target", "path", "name", F.regexp_replace("own.version", "^==", "").alias("version")).where("version is not null")


def yarn_lock(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of the stanzas of yarn.lock, of either format."""
    rows = _named(files, "yarn.lock").select("target", "path", F.explode(F.split("content", r"\n(?=\S)")).alias("part"))
    name = F.regexp_extract("part", r'^"?((?:@[^/@"\s]+/)?[^@"\s#]+)@', 1)
    version = F.regexp_extract("part", r'\n\s+version:? "?([^"\s]+)', 1)
    return rows.select("target", "path", name.alias("name"), version.alias("version")).where("name <> '' and version <> ''")


def pyproject(files: DataFrame) -> DataFrame:
    """(target, path, name, version) of the project's dependency list and of Poetry's table, without python itself."""
    array = F.regexp_extract("content", r'(?m)^dependencies\s*=\s*\[\s*((?:"[^"]*"\s*,?\s*)*)\]', 1)
    listed = _named(files, "pyproject.toml").select("target", "path", F.explode(F.regexp_extract_all(array, F.lit('"([^"]*)"'), F.lit(1))).alias("item"))
    spec = r"^\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*?)\s*(?:;|$)"
    listed = listed.select("target", "path", F.regexp_extract("item", spec, 1).alias("name"), F.regexp_extract("item", spec, 2).alias("version"))
    table = toml_entries(files, "pyproject.toml").where("section = 'tool.poetry.dependencies' and name <> 'python'")
    return listed.unionByName(table.drop("section"))


def toml_entries(files: DataFrame, name: str = "Cargo.toml") -> DataFrame:
    """(target, path, section, name, version): quoted entries of a TOML file below their table's header."""
    lines = _named(files, name).select("target", "path", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    header = F.regexp_extract("line", r"^\[([^\[\]]+)\]\s*$", 1)
    above = Window.partitionBy("target", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(above))
    entry = r'^([A-Za-z0-9_-]+)\s*=\s*"([^"]*)"'
    return rows.where(F.col("line").rlike(entry)).select("target", "path", "section", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("version"))


def owning_dirs(sites: DataFrame, dirs: DataFrame) -> DataFrame:
    """``sites`` with dir: the deepest manifest directory of the target that holds the site; sites of none are left out, equal rows are one site."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = sites.withColumn("dir", F.explode(above)).join(dirs.select("target", "dir").distinct(), ["target", "dir"])
    return met.groupBy(*sites.columns).agg(F.max_by("dir", F.length("dir")).alias("dir"))


def reconciled(sites: DataFrame, dirs: DataFrame, shown: int = 5) -> DataFrame:
    """For each manifest directory: whether its sites prove that only HMAC is used, and the first sites."""
    owned = owning_dirs(sites, dirs)
    judged = owned.groupBy("target", "dir").agg(
        (F.bool_or(F.col("confidence") == "confirmed") & F.bool_and(F.col("rule_id").endswith("/hmac"))).alias("decisive"), F.count("*").alias("sites")
    )
    place = F.row_number().over(Window.partitionBy("target", "dir").orderBy("ord", "path"))
    first = owned.withColumn("k", place).where(F.col("k") <= shown).groupBy("target", "dir")
    cited = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]), ", ").alias("cited"))
    more = F.when(F.col("sites") > shown, F.format_string("%s and %d more", "cited", F.col("sites") - shown)).otherwise(F.col("cited"))
    return judged.join(cited, ["target", "dir"]).select("target", "dir", "decisive", "sites", more.alias("cited"))
