
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders never entered, and the limits of a repository.
IGNORED_FOLDERS = [".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".gradle", ".idea", ".vscode"]
MOST_FILES, MOST_BYTES = 25_000, 512 * 2**20
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "cargo.lock"]


@dataclass(frozen=True)
class Rule:
    """A pattern's segments, a `**` being one of them; anywhere: it may start below any folder."""

    segments: tuple[str, ...]
    anywhere: bool
    negated: bool
    folders_only: bool

    def prefix(self) -> str:
        """A regular expression for the paths that start with what the pattern names."""
        parts = []
        for k, s in enumerate(self.segments):
            last = k == len(self.segments) - 1
            if s == "**":
                parts.append("[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*")
            else:
                parts.append("".join(_GLOB.get(c) or re.escape(c) for c in s) + ("" if last else "/"))
        return ("(?:[^/]+/)*" if self.anywhere else "") + "".join(parts)


_GLOB = {"*": "[^/]*", "?": "[^/]"}


def ignore_rules(text: str | None) -> list[Rule]:
    """5: the patterns of an ignore file, as Git's documentation has them: blank lines and comments are none, `!` negates,
    a slash at the end asks for a folder, and one before that ties the pattern to the root."""
    out = []
    for line in map(str.strip, (text or "").splitlines()):
        bare = line.removeprefix("!").removesuffix("/")
        segments = tuple(s for s in bare.split("/") if s)
        if segments and line[0] != "#":
            out.append(Rule(segments, "/" not in bare, line[0] == "!", line[-1] == "/"))
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """5: the last rule that matches the path or a folder on its way decides."""
    out = F.lit(False)
    for r in rules:
        out = F.when(path.rlike(f"^{r.prefix()}{'/' if r.folders_only else '(?:/|$)'}"), not r.negated).otherwise(out)
    return out


def hard_ignored(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.isin(IGNORED_FOLDERS))


def read_files(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> DataFrame:
    """4, 7: files below root with path, size and content; nothing is listed on the driver but by Spark's reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    rows = raw.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^.*?{base}/", "").alias("path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))
    return rows.filter(~hard_ignored(F.col("path")) & ~ignored(F.col("path"), rules or []))


def describe(files: DataFrame, *keep: str) -> DataFrame:
    """21-24, 26: extension, role, language and lines of code of each file, with the columns to keep. A file is a row: paths may stand in many repositories."""
    p = F.col("path")
    return files.select(*keep, "path", T.extension(p).alias("ext"), T.role(p).alias("role"), T.language(p).alias("language"), "size_bytes", T.loc(F.col("content")).alias("loc"))


def measure(files: DataFrame, by: str | None = None, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """2, 3: files and bytes, of all or of each repository, and whether that is within the limits."""
    n = files.groupBy(*([by] if by else [])).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0).cast("long")).alias("bytes"))
    return n.withColumn("accepted", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes))


def parseable(files: DataFrame, most_bytes: int = 512 * 1024, most_files: int = 5000, by: str | None = None) -> DataFrame:
    """6: what parsers look at: no lock files, nothing binary, nothing large, nothing in folders left out, and of that the
    first files of a repository by path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    own = files.filter((F.col("size_bytes") <= most_bytes) & ~name.isin(LOCKFILES) & ~F.coalesce(F.col("content").contains("\x00"), F.lit(False)) & ~hard_ignored(F.col("path")))
    if by is None:
        return own.orderBy("path").limit(most_files)
    return own.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("path"))).filter(F.col("__k") <= most_files).drop("__k")


def layout(files: DataFrame, by: str | None = None) -> DataFrame:
    """25: monorepo, src-rooted, app-rooted or flat, of all files or of each repository."""
    starts = lambda *p: F.bool_or(F.element_at(F.split("path", "/"), 1).isin(*p) & F.col("path").contains("/"))
    return files.groupBy(*([by] if by else [])).agg(F.when(starts("packages", "apps"), "monorepo").when(starts("src"), "src-rooted").when(starts("app"), "app-rooted").otherwise("flat").alias("layout"))
