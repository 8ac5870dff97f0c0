"""Column functions for names, keys and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Patterns of an ecosystem key (ecosystem, provider, rest), of a repository's URL, of an owner/name path, of a
#: bare package name, and of the name at the start of a dependency spec.
KEY = r"^([a-z]+):(?:([^:]+):)?(.+)$"
REPOSITORY_URL = r"(?i)github\.com/([A-Za-z0-9][A-Za-z0-9-]*)/([A-Za-z0-9._-]+)"
OWNER_AND_NAME = r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$"
BARE_NAME = r"^[a-z0-9][a-z0-9._-]*$"
DEPENDENCY_NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"


def pep503(name: Column) -> Column:
    """Lower case, runs of -, _ and . as one dash."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-_.]+", "-")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "stage").otherwise(s)


def tail_name(key: Column) -> Column:
    """Last segment of an ecosystem key; null where the key has no ecosystem or no tail."""
    tail = F.trim(F.lower(F.element_at(F.split(F.regexp_extract(key, KEY, 3), "/"), -1)))
    return F.when(key.rlike(KEY) & (tail != ""), tail)


def successor_keys(name: Column) -> Column:
    """Keys that a free-form successor may have, in the order in which they are tried."""
    name = F.trim(name)
    url = REPOSITORY_URL
    repo = F.regexp_replace(F.lower(F.regexp_extract(name, url, 2)), r"\.(git|md)$", "")
    from_url = F.when(name.rlike(url), F.concat(F.lit("source:github:"), F.lower(F.regexp_extract(name, url, 1)), F.lit("/"), repo))
    from_path = F.when(name.rlike(OWNER_AND_NAME), F.concat(F.lit("source:github:"), F.lower(name)))
    bare = F.lower(name).rlike(BARE_NAME)
    return F.array_distinct(F.array_compact(F.array(from_url, from_path, F.when(bare, F.concat(F.lit("pypi:"), F.lower(name))), F.when(bare, F.concat(F.lit("npm:"), F.lower(name))))))


def dependency_name(spec: Column) -> Column:
    """Name part of a dependency spec, or all of it where it doesn't start like a name."""
    name = F.regexp_extract(F.trim(spec), DEPENDENCY_NAME, 1)
    return F.when(name == "", F.trim(spec)).otherwise(name)


def dependency_rest(spec: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(spec), DEPENDENCY_NAME, ""))


def redacted(secret: Column) -> Column:
    """The first four characters, a star for each other."""
    return F.concat(F.left(secret, F.lit(4)), F.repeat(F.lit("*"), F.greatest(F.length(secret) - 4, F.lit(0))))


def without_fence(text: Column) -> Column:
    """Model output without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


#: Language by file extension, first match.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".rb": "ruby", ".sh": "shell", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".sql": "sql", ".html": "html", ".css": "css",
}


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, lang in reversed(LANGUAGES.items()):
        out = F.when(F.endswith(F.lower(path), F.lit(ext)), lang).otherwise(out)
    return out


def days_between(then: Column, now: Column) -> Column:
    """Days, with fractions, between two timestamps; null where then is."""
    return (F.unix_micros(now) - F.unix_micros(then)) / 86400e6
