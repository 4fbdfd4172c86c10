"""Finding paths, and what they say about a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs

# Languages by file name and by extension.
FILENAMES = {"dockerfile": "dockerfile", "makefile": "shell", "gemfile": "ruby", "rakefile": "ruby", "jenkinsfile": "shell", "vagrantfile": "ruby"}
EXTENSIONS = {
    "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "python": "py pyw pyi", "java": "java", "go": "go", "rust": "rs",
    "csharp": "cs", "c": "c h", "cpp": "cpp hpp cc cxx hh hxx", "kotlin": "kt kts", "swift": "swift", "ruby": "rb rake gemspec", "php": "php phtml",
    "scala": "scala sc", "shell": "sh bash zsh fish", "css": "css", "scss": "scss sass", "less": "less", "html": "html htm", "vue": "vue",
    "svelte": "svelte", "sql": "sql", "yaml": "yaml yml", "json": "json jsonc", "xml": "xml xsl xslt", "graphql": "graphql gql",
    "terraform": "tf tfvars", "hcl": "hcl", "dockerfile": "dockerfile",
}
LANGUAGE = {e: language for language, es in EXTENSIONS.items() for e in es.split()}


def language_of(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    return FILENAMES.get(name) or LANGUAGE.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "unknown")


def language(path: Column | str) -> Column:
    """As ``language_of``, as an expression: the file's name first, then its extension."""
    p = F.col(path) if isinstance(path, str) else path
    maps = [F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (FILENAMES, LANGUAGE)]
    name = F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1))
    return F.coalesce(maps[0][name], maps[1][F.lower(F.regexp_extract(p, r"\.([^.]*)$", 1))], F.lit("unknown"))


def by_glob(files: DataFrame, pattern: str, limit: int = 20, path: str = "path") -> DataFrame:
    """(path, total_matches): the distinct paths that match, in binary order, ``limit``
    at most. A literal beginning of the glob is pushed down to the scan."""
    if wrong := globs.problem(pattern):
        raise ValueError(wrong)
    found = files.select(F.col(path).alias("path"))
    if prefix := globs.literal_prefix(pattern):
        found = found.where(F.col("path").startswith(prefix))
    found = found.where(F.col("path").rlike(globs.any_regex([pattern]))).distinct()
    total = found.agg(F.count("*").alias("total_matches"))
    return found.orderBy("path").limit(limit).join(F.broadcast(total)).orderBy("path")


def by_like(files: DataFrame, pattern: str, limit: int = 20, path: str = "path") -> DataFrame:
    """Distinct paths by the store's looser glob, where ``*`` crosses segments."""
    like = F.col(path).like(globs.to_like(pattern))
    return files.where(like).select(F.col(path).alias("path")).distinct().orderBy("path").limit(limit)


def safe(path: Column | str) -> Column:
    """Relative, and without a step up."""
    p = F.col(path) if isinstance(path, str) else path
    return ~p.rlike(r"^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)|\x00")
