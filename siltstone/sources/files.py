"""Readers of source trees, commit logs, JSON documents, append-only logs and rating sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import artifact_id

# Fixed values.
EXCLUDED_FOLDERS = (
    ".git", "node_modules", ".venv", "venv", "env", ".env", "build", "dist", "target", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode", "vendor", "egg-info", ".eggs",
)
EXCLUDED_EXTENSIONS = (
    "pyc", "pyo", "pyd", "class", "o", "obj", "so", "dll", "dylib", "exe", "bin", "png", "jpg", "jpeg", "gif", "ico", "svg", "pdf", "zip", "tar", "gz", "7z", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "wav",
)
LANGUAGES = {
    "py": ("python", "source_code"), "js": ("javascript", "source_code"), "ts": ("typescript", "source_code"), "jsx": ("javascript", "source_code"), "tsx": ("typescript", "source_code"),
    "java": ("java", "source_code"), "go": ("go", "source_code"), "rs": ("rust", "source_code"), "cpp": ("cpp", "source_code"), "cc": ("cpp", "source_code"), "cxx": ("cpp", "source_code"),
    "c": ("c", "source_code"), "h": ("c", "source_code"), "hpp": ("cpp", "source_code"), "cs": ("csharp", "source_code"), "rb": ("ruby", "source_code"), "kt": ("kotlin", "source_code"),
    "scala": ("scala", "source_code"), "sh": ("shell", "source_code"), "bash": ("shell", "source_code"), "sql": ("sql", "source_code"),
    "md": ("other", "markdown"), "markdown": ("other", "markdown"), "txt": ("other", "plain_text"), "rst": ("other", "markdown"),
    "yaml": ("yaml", "configuration"), "yml": ("yaml", "configuration"), "json": ("json", "configuration"), "toml": ("toml", "configuration"),
}
MOST_BYTES = 1 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def classified(paths: DataFrame) -> DataFrame:
    """With language and artifact_type by extension; unknown otherwise."""
    names = {k: F.create_map(*(F.lit(x) for e, v in LANGUAGES.items() for x in (e, v[n]))) for n, k in enumerate(("language", "artifact_type"))}
    return paths.withColumns({k: F.coalesce(m[extension(F.col("path"))], F.lit("unknown")) for k, m in names.items()})


def source_tree(spark: SparkSession, root: str, repository: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Text files under ``root``: artifact_id, repository, path, language, artifact_type, text.

    Hidden and excluded folders, excluded extensions, empty files and those
    over a mebibyte are left out; bytes that are no UTF-8 are replaced.
    """
    found = _inside(spark, root, extensions).where(F.col("length").between(1, MOST_BYTES))
    out = classified(found.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))))
    return out.select(artifact_id(F.lit(repository), F.col("path"), F.col("text")).alias("artifact_id"), F.lit(repository).alias("repository"), "path", "language", "artifact_type", "text")


def count_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> int:
    """How many files a scan would look at, however large; no content is read. The reader itself passes over empty files."""
    return _inside(spark, root, extensions).select("path").count()


def _inside(spark: SparkSession, root: str, extensions: tuple[str, ...] | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    files = files.withColumn("path", F.replace(inside, F.lit(base), F.lit("")))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    files = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_FOLDERS))) & ~F.exists(folders, lambda d: d.startswith(".")))
    files = files.where(~extension(F.col("path")).isin(*EXCLUDED_EXTENSIONS))
    return files.where(extension(F.col("path")).isin(*extensions)) if extensions else files


def commit_log(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Commits of a log with records ended by 0x1e and fields by 0x1f: sha, author, time, subject, files. Records with fewer fields are dropped."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) != ''")
    parts = F.split("value", "\x1f")
    log = raw.where(F.size(parts) >= 5).select(*(F.trim(F.get(parts, F.lit(k)), F.lit(" \n\r\t")).alias(n) for k, n in enumerate(("sha", "author", "time", "subject", "names"))))
    log = log.withColumn("files", F.filter(F.split("names", "\n"), lambda f: F.trim(f) != "")).drop("names")
    return log.orderBy(F.desc("time"), "sha").limit(most) if most else log


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; a torn line is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_items(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The items of documents of the form {field: [...]}."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", "true").json(path).select(F.inline(field))


def rating_sheets(spark: SparkSession, path: str, key: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Rows of blind CSV sheets with every dimension filled in, joined to what the blind ids stand for."""
    schema = "blind_id string, " + ", ".join(f"{d} int" for d in dimensions)
    return spark.read.schema(schema).option("header", "true").csv(path).na.drop(subset=list(dimensions)).join(key, "blind_id")


class Registry:
    """Named sources; an unknown name raises."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, maker: Callable[..., DataFrame]) -> None:
        self.makers[name] = maker

    def load(self, name: str, *args, **settings) -> DataFrame:
        if name not in self.makers:
            raise KeyError(f"no source named {name}; there are {', '.join(sorted(self.makers))}")
        return self.makers[name](*args, **settings)


SOURCES = Registry()
SOURCES.register("tree", source_tree)
SOURCES.register("commits", commit_log)
SOURCES.register("json_log", json_log)
