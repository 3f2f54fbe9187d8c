"""Technology markers and manifests of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import first_of

# Root files that mark a technology, manifest defaults, list lengths.
MARKERS = {
    "package.json": "Node.js",
    "requirements.txt": "Python",
    "pyproject.toml": "Python",
    "go.mod": "Go",
    "Cargo.toml": "Rust",
    "pom.xml": "Java/Kotlin",
    "build.gradle": "Java/Kotlin",
    "build.gradle.kts": "Java/Kotlin",
    "composer.json": "PHP",
    "Gemfile": "Ruby",
    "Dockerfile": "Docker",
    "docker-compose.yml": "Docker",
    "docker-compose.yaml": "Docker",
}
DEFAULT_NAME = "unnamed"
DEFAULT_VERSION = "0.0.0"
LISTED = 10
README_LINES = 5


def tech_stack(files: DataFrame) -> DataFrame:
    """Distinct ``repo, technology``; reads paths only, filtered at the scan."""
    marker = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    roots = files.select("repo", "path").filter(F.col("path").isin(list(MARKERS)))
    return roots.select("repo", F.element_at(marker, F.col("path")).alias("technology")).distinct()


def _keys(text: Column, member: str) -> Column:
    keys = F.json_object_keys(F.get_json_object(text, f"$.{member}"))
    return F.coalesce(keys, F.array().cast("array<string>"))


def manifests(files: DataFrame, shown: int | None = LISTED) -> DataFrame:
    """One row per root ``package.json``, with ``shown`` names of each list (``None``: all)."""
    text = F.col("text")
    raw = files.filter(F.col("path") == "package.json").select("repo", "text")
    parsed = raw.withColumn("_ok", F.coalesce(
        F.try_parse_json(text).isNotNull() & (F.trim(text) != "null"), F.lit(False)))

    def value(member: str) -> Column:
        return F.nullif(F.get_json_object(text, f"$.{member}"), F.lit(""))

    read = parsed.select(
        "repo", F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("corrupt")).alias("status"),
        F.when(F.col("_ok"), F.coalesce(value("name"), F.lit(DEFAULT_NAME))).alias("name"),
        F.when(F.col("_ok"), F.coalesce(value("version"), F.lit(DEFAULT_VERSION))).alias("version"),
        F.when(F.col("_ok"), value("description")).alias("description"),
        *[F.when(F.col("_ok"), _keys(text, m)).alias(m) for m in ("dependencies", "devDependencies", "scripts")],
    )

    def listed(member: str, name: str) -> list[Column]:
        more = F.lit(False) if shown is None else F.size(member) > shown
        return [first_of(F.col(member), shown).alias(name), F.size(member).alias(f"n_{name}"), more.alias(f"more_{name}")]

    return read.select("repo", "status", "name", "version", "description",
                       *listed("dependencies", "dependencies"), *listed("devDependencies", "dev_dependencies"),
                       "scripts")


def readme_preview(files: DataFrame, lines: int | None = README_LINES) -> DataFrame:
    """The first ``lines`` lines of each root README (``None``: all)."""
    head = F.array_join(first_of(F.split("text", "\n", -1), lines), "\n")
    return files.filter(F.col("path") == "README.md").select("repo", head.alias("preview"))
