"""Evidence from files: (revision, path, content, language) rows to typed findings, many files in one job.

Parsers that Spark lacks (TOML, Python's grammar, tar) run in mapInPandas as small helpers; all else stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import dependency_name, dependency_rest, language, redacted

#: SPDX id, phrase and confidence, in the order in which they are tried.
LICENSE_PHRASES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "high"),
    ("Apache-2.0", "www.apache.org/licenses/LICENSE-2.0", "high"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "high"),
    ("BSD-3-Clause", "Neither the name of", "high"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms", "low"),
    ("ISC", "Permission to use, copy, modify, and/or distribute", "high"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n                       Version 3", "high"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "low"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n                       Version 2", "high"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "low"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "high"),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "high"),
)
#: Further phrases of this library's own, for callers who ask for them.
MORE_LICENSES = (
    ("MIT", "Released under the MIT License", "high"),
    ("GPL-3.0", "GNU General Public License, version 3", "high"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "high"),
)
#: Ecosystem, indicator and path pattern of test files, first match.
TEST_PATTERNS = (
    ("python", "pytest_conftest", r"(^|/)conftest\.py$"),
    ("python", "pytest_test_file", r"(^|/)test_[^/]+\.py$"),
    ("python", "pytest_file_test", r"(^|/)[^/]+_test\.py$"),
    ("python", "tests_dir_file", r"(^|/)tests?/[^/]+\.py$"),
    ("js", "jest_test_file", r"\.(test|spec)\.(t|j)sx?$"),
    ("js", "tests_dir_file", r"(^|/)__tests__/"),
    ("go", "go_test_file", r"_test\.go$"),
    ("rust", "rust_test_module", r"(^|/)tests/[^/]+\.rs$"),
)
#: Pattern name and pattern of a secret.
SECRET_PATTERNS = (
    ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    ("github_pat", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("private_key", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"),
    ("assigned_token", r"(?i)\b(?:token|secret|password|api_key)\s*[=:]\s*\"([^\"\s]{12,})\""),
    ("slack_token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})\b"),
)
#: Names of licence and requirements files.
LICENSE_FILE = r"(?i)^([^/]+/)?(LICEN[SC]E|COPYING|COPYRIGHT)([._-][^/]*)?$"
REQUIREMENTS_FILE = r"(?i)(^|/)requirements([-_].+)?\.txt$"


def index_files(files: DataFrame) -> DataFrame:
    """revision, path, size_bytes, language and content_hash of each file."""
    return files.select("revision", "path", F.octet_length("content").cast("long").alias("size_bytes"), language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"))


def first_license(content: Column, phrases=LICENSE_PHRASES) -> Column:
    out = F.struct(F.lit("unknown").alias("spdx_id"), F.lit("unknown").alias("confidence"))
    for spdx, phrase, confidence in reversed(phrases):
        out = F.when(F.contains(content, F.lit(phrase)), F.struct(F.lit(spdx).alias("spdx_id"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def licenses(files: DataFrame, phrases=LICENSE_PHRASES) -> DataFrame:
    """Licence of each licence file at the root or one folder down, by the first phrase found; unknown where there is none."""
    rows = files.where(F.col("path").rlike(LICENSE_FILE)).withColumn("_l", first_license(F.col("content"), phrases))
    return rows.select("revision", "path", "_l.spdx_id", "_l.confidence", F.octet_length("content").cast("long").alias("size_bytes"))


def tests(files: DataFrame) -> DataFrame:
    """The first test pattern that each path meets."""
    out = F.lit(None).cast("struct<ecosystem:string,indicator:string>")
    for eco, name, pattern in reversed(TEST_PATTERNS):
        out = F.when(F.col("path").rlike(pattern), F.struct(F.lit(eco).alias("ecosystem"), F.lit(name).alias("indicator"))).otherwise(out)
    return files.select("revision", "path", out.alias("_t")).where("_t is not null").select("revision", "path", "_t.*")


def secrets(files: DataFrame) -> DataFrame:
    """Named patterns with a redacted preview; files with a NUL among their first 1024 characters are binary."""
    text = files.where(F.instr(F.left("content", F.lit(1024)), "\0") == 0)

    def of(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), 1), lambda x: F.struct(F.lit(name).alias("pattern_name"), redacted(x).alias("preview")))

    found = F.concat(*(of(*p) for p in SECRET_PATTERNS))
    return text.select("revision", "path", F.explode(found).alias("s")).select("revision", "path", "s.*")


def setup_py(files: DataFrame) -> DataFrame:
    """setup.py files with their number of lines; they are never run."""
    return files.where(F.col("path").rlike(r"(^|/)setup\.py$")).select("revision", "path", F.size(F.split("content", "\n")).alias("end_line"))


def requirements(files: DataFrame, pattern: str = REQUIREMENTS_FILE) -> DataFrame:
    """Dependencies of requirements files, with their line; blank lines, comments and options are left out."""
    lines = files.where(F.col("path").rlike(pattern)).select("revision", "path", F.posexplode(F.split("content", r"\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\s+#.*$", "")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[#-]"))
    return lines.select("revision", "path", (F.col("pos") + 1).alias("line_number"), dependency_name(F.col("line")).alias("name"), dependency_rest(F.col("line")).alias("version_spec"))


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies of package.json files by kind; files that are no JSON objects give none."""
    kind = "map<string,string>"
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("_j", F.from_json("content", f"dependencies {kind}, devDependencies {kind}, peerDependencies {kind}"))
    parts = [rows.select("revision", "path", F.lit(k).alias("kind"), F.explode(F.col(f"_j.{c}")).alias("name", "version_spec")) for k, c in (("runtime", "dependencies"), ("dev", "devDependencies"), ("peer", "peerDependencies"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pyproject(files: DataFrame) -> DataFrame:
    """Runtime and optional dependencies of pyproject.toml files; malformed files give none."""

    def parsed(batches):
        import tomllib

        import pandas as pd

        for pdf in batches:
            out = []
            for rev, path, content in zip(pdf["revision"], pdf["path"], pdf["content"]):
                try:
                    project = tomllib.loads(content or "").get("project", {})
                except tomllib.TOMLDecodeError:
                    continue
                if not isinstance(project, dict):
                    continue
                groups = {"runtime": project.get("dependencies")} | {f"optional:{g}": v for g, v in (project.get("optional-dependencies") or {}).items()}
                out += [(rev, path, kind, spec) for kind, specs in groups.items() if isinstance(specs, list) for spec in specs if isinstance(spec, str)]
            yield pd.DataFrame(out, columns=["revision", "path", "kind", "spec"])

    rows = files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")).select("revision", "path", "content").mapInPandas(parsed, "revision string, path string, kind string, spec string")
    return rows.select("revision", "path", "kind", dependency_name(F.col("spec")).alias("name"), dependency_rest(F.col("spec")).alias("version_spec"))


def interfaces(files: DataFrame) -> DataFrame:
    """Public top-level functions and classes of Python files; files that don't parse give none."""

    def parsed(batches):
        import ast

        import pandas as pd

        for pdf in batches:
            out = []
            for rev, path, content in zip(pdf["revision"], pdf["path"], pdf["content"]):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                for node in tree.body:
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not node.name.startswith("_"):
                        of_class = isinstance(node, ast.ClassDef)
                        shown = ", ".join(map(ast.unparse, node.bases)) if of_class else ast.unparse(node.args)
                        methods = [m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and not m.name.startswith("_")] if of_class else []
                        out.append((rev, path, "class" if of_class else "function", node.name, f"{node.name}({shown})", ",".join(methods), node.lineno, node.end_lineno))
            yield pd.DataFrame(out, columns=["revision", "path", "kind", "name", "signature", "methods", "start_line", "end_line"])

    schema = "revision string, path string, kind string, name string, signature string, methods string, start_line int, end_line int"
    return files.where(F.col("path").rlike(r"\.py$")).select("revision", "path", "content").mapInPandas(parsed, schema)


#: Kinds of locators, and the languages whose lines are counted.
LOCATOR_KINDS = ("file_range", "manifest_key", "whole_file")
COUNTED_LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "ruby", "java", "shell", "markdown", "yaml", "toml", "json", "sql", "html", "css")


def bad_locators(found: DataFrame, index: DataFrame) -> DataFrame:
    """found (run, extractor, revision, path, locator_kind, start_line, end_line, key_path) rows whose locator has a wrong kind
    or shape, or doesn't hold in index (revision, path, language, n_lines): the path must be there, and a line range must end
    within the file where the lines of its language are counted."""
    rows = found.join(index.select("revision", "path", F.lit(True).alias("_there"), F.when(F.col("language").isin(*COUNTED_LANGUAGES), F.col("n_lines")).alias("_lines")), ["revision", "path"], "left")
    lines = F.col("locator_kind") == "file_range"
    reason = (
        F.when(~F.coalesce(F.col("locator_kind").isin(*LOCATOR_KINDS), F.lit(False)), "invalid locator kind")
        .when(F.col("path").isNull(), "locator without a path")
        .when(lines & (F.col("start_line").isNull() | F.col("end_line").isNull()), "line range without its ends")
        .when(lines & ((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))), "bad line range")
        .when((F.col("locator_kind") == "manifest_key") & F.col("key_path").isNull(), "manifest key without its path")
        .when(F.col("_there").isNull(), "path not in snapshot")
        .when(lines & (F.col("end_line") > F.col("_lines")), "line past end of file")
    )
    return rows.withColumn("violation", reason).where("violation is not null").drop("_there", "_lines")


def stage_outcomes(found: DataFrame, bad: DataFrame) -> DataFrame:
    """run, extractor, status and n_items: one bad item fails its whole stage, other stages stand."""
    failed = bad.select("run", "extractor").distinct().withColumn("failed", F.lit(True))
    rows = found.groupBy("run", "extractor").agg(F.count("*").alias("n")).join(failed, ["run", "extractor"], "left")
    return rows.select("run", "extractor", F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"), F.when(F.col("failed"), 0).otherwise(F.col("n")).cast("long").alias("n_items"))


def to_analyse(revisions: DataFrame, completed: DataFrame, config: str) -> DataFrame:
    """Snapshotted revisions without a completed run under the configuration: the skip comes before any extraction."""
    return revisions.where("snapshot_status = 'snapshotted'").join(completed.where((F.col("config") == config) & (F.col("status") == "succeeded")).select("revision_id").distinct(), "revision_id", "left_anti")
