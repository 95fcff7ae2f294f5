"""What a walk leaves out and what it could not read: marked directories, files of no use, the coverage of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.manifests import file_name

# Marks of directories that hold no code of the project, and dependency files that no reader takes.
MARKERS = ("pyvenv.cfg", "CACHEDIR.TAG")
UNREAD_MANIFESTS = (
    "go.mod go.sum pom.xml build.gradle build.gradle.kts gradle.lockfile build.sbt Gemfile Gemfile.lock composer.json composer.lock packages.config packages.lock.json Directory.Packages.props setup.py setup.cfg "
    "environment.yml conda-lock.yml bun.lock bun.lockb deno.json deno.lock Package.swift Package.resolved Podfile.lock pubspec.yaml pubspec.lock mix.exs mix.lock vcpkg.json conanfile.txt conanfile.py"
).split()
UNREAD_ENDINGS = "csproj fsproj vbproj cabal gemspec nuspec".split()
NON_CODE_ENDINGS = "png jpg jpeg gif webp avif ico icns bmp tif tiff psd woff woff2 ttf otf eot mp3 mp4 m4a wav ogg oga flac webm mov avi pdf wasm pyc pyo".split()
MAPPED_ENDINGS = "js jsx cjs cjsx mjs mjsx ts tsx cts ctsx mts mtsx css".split()
# Rules that tell of a gap, and rules that tell of what is left out by design.
GAP_RULES = {
    "source": "unreadable-path scan-truncated file-too-large binary-skipped findings-capped ast-fallback".split(),
    "deps": "unsupported-manifest manifest-too-large scan-truncated".split(),
}
DESIGN_RULES = {"source": "directories-skipped non-code-skipped".split()}


def below_no_marker(files: DataFrame) -> DataFrame:
    """Files below no directory (but the root) that holds a marker. Directories, not files, meet the markers."""
    rows = files.withColumn("_parts", F.split("path", "/")).withColumn("_dir", F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - 1), "/")).drop("_parts")
    dirs = rows.select("target", "_dir").where(F.col("_dir") != "").distinct()
    marked = rows.where(file_name(F.col("path")).isin(*MARKERS)).where(F.col("_dir") != "").select("target", F.col("_dir").alias("up")).distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("target", "_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    left_out = above.join(marked, ["target", "up"], "left_semi").select("target", "_dir").distinct()
    return rows.join(left_out, ["target", "_dir"], "left_anti").drop("_dir")


def walk_class(path: Column) -> Column:
    """unread-manifest, source-map or non-code for a file that no scanner reads; else null."""
    name, ending = file_name(path), F.substring_index(path, ".", -1)
    mapped = F.substring_index(F.regexp_replace(F.lower(path), r"\.map$", ""), ".", -1)
    dotted = F.contains(name, F.lit("."))
    return (
        F.when(name.isin(*UNREAD_MANIFESTS) | dotted & ending.isin(*UNREAD_ENDINGS), "unread-manifest")
        .when((F.lower(ending) == "map") & (F.size(F.split(name, r"\.")) > 2) & mapped.isin(*MAPPED_ENDINGS), "source-map")
        .when(dotted & F.lower(ending).isin(*NON_CODE_ENDINGS), "non-code")
    )


def coverage(findings: DataFrame) -> DataFrame:
    """For each target of ``findings`` and each check: whether it saw all, the gaps, what it leaves out by design, and a line of text.

    A scan tells a gap once for each rule, so a target has few titles however many files it has."""
    sets = [(check, kind, f"{check}/{r}") for kind, rules in (("gap", GAP_RULES), ("design", DESIGN_RULES)) for check, names in rules.items() for r in names]
    known = F.broadcast(findings.sparkSession.createDataFrame(sets, "check string, kind string, rule_id string"))
    told = findings.join(known, "rule_id").select("target", "check", "kind", "title").distinct()
    titles = lambda kind: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("title")))), "; "), F.lit(""))
    notes = told.groupBy("target", "check").agg(titles("gap").alias("note"), titles("design").alias("skipped"))
    checks = findings.select("target").distinct().select("target", F.explode(F.array(*map(F.lit, GAP_RULES))).alias("check"))
    rows = checks.join(notes, ["target", "check"], "left").withColumn("complete", F.col("note").isNull())
    status = F.when(F.col("complete"), "complete").otherwise(F.concat(F.lit("partial: "), "note"))
    return rows.withColumn("line", F.concat("check", F.lit(" ("), status, F.lit(")")))
