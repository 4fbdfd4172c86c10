"""Which files are indexed: an ordered predicate whose first hit is the reason."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import any_regex, gitignore_rules

# Paths never indexed.
DENY = {
    "dependencies": "node_modules/** jspm_packages/** bower_components/** vendor/** .venv/** venv/** .yarn/** .pnpm-store/** Pods/** .bundle/** deps/**",
    "version control": ".git/** .hg/** .svn/**",
    "build artifacts": "dist/** build/** out/** target/** bin/** obj/** __pycache__/** _build/** .build/** .output/** .next/** .nuxt/** .angular/** .svelte-kit/** .astro/** .turbo/** .parcel-cache/** .cache/** .gradle/** .mvn/** .expo/** .docusaurus/** .storybook-static/**",
    "secrets": ".env .env.* *.pem *.key *.p12 *.pfx",
    "logs and locks": "*.log *.lock package-lock.json yarn.lock pnpm-lock.yaml Gemfile.lock poetry.lock",
    "ide": ".idea/** .vscode/** .fleet/** .DS_Store *.swp *.swo *.sublime-workspace",
    "testing": "coverage/** .nyc_output/** .pytest_cache/** .hypothesis/** .tox/** htmlcov/**",
    "linter caches": ".mypy_cache/** .ruff_cache/** .eslintcache .stylelintcache",
    "cloud": ".terraform/** .serverless/** .vercel/** .netlify/**",
}
# Extensions (and dotfile names) that are text without looking.
TEXT = "ts tsx js jsx mjs cjs json yaml yml toml xml html htm css scss sass less md markdown txt rst adoc py rb go rs java kt scala c cpp h hpp cs fs sh bash zsh fish ps1 bat cmd sql graphql prisma vue svelte astro env gitignore dockerignore editorconfig eslintrc prettierrc babelrc lock log".split()
#: Common binary extensions.
BINARY = "png jpg jpeg gif bmp ico tif tiff webp avif heic psd mp3 wav flac ogg m4a aac mp4 m4v avi mov mkv webm wmv pdf doc docx xls xlsx ppt pptx odt ods zip gz bz2 xz 7z rar tar tgz jar war class o a so dylib dll exe bin dat db sqlite sqlite3 ttf otf woff woff2 eot pyc pyo wasm iso dmg deb rpm node parquet".split()
HEAD = 8192


@dataclass(frozen=True)
class Policy:
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    gitignore: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())  #: (directory, rules) in the order found
    max_size: int = 1 << 20
    respect_gitignore: bool = True


def parse_size(size: str) -> int:
    m = re.fullmatch(r"(\d+)(KB|MB)", size, re.IGNORECASE)
    if not m:
        raise ValueError(f"{size!r} is no size such as 1MB or 500KB")
    return int(m[1]) * (1 << 20 if m[2].upper() == "MB" else 1 << 10)


def deny_patterns() -> list[str]:
    return [p for group in DENY.values() for p in group.split()]


def hard_denied(path: Column) -> Column:
    return path.rlike(any_regex(deny_patterns()))


def known_text(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    dot = F.regexp_extract(name, r"^\.([^.]+)$", 1)
    return ext.isin(TEXT) | dot.isin(TEXT)


def binary_extension(path: Column) -> Column:
    return ~known_text(path) & F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(BINARY)


def binary_content(content: Column) -> Column:
    """A zero byte among the first 8,192."""
    return F.coalesce(F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, HEAD)), "(..)", "$1 ")) > 0, F.lit(False))


def ignored(path: Column, policy: Policy) -> Column:
    """The last rule that matches decides; a rule with ! takes a path back in. A run of
    rules with one verdict is one pattern, so the plan grows with changes of verdict alone."""
    rules = [r for base, lines in policy.gitignore for r in gitignore_rules(list(lines), base)]
    out = F.lit(False)
    for ignores, run in itertools.groupby(rules, key=lambda r: r[0]):
        out = F.when(path.rlike("|".join(f"(?:{regex})" for _, regex in run)), F.lit(ignores)).otherwise(out)
    return out


def category(policy: Policy = Policy(), path: str = "path", size: str | None = "length", content: str | None = None) -> Column:
    """Why a file is not indexed: hardcoded, user-exclude, gitignore, binary, size,
    binary (content) or include-mismatch; null if it is. An unknown size is no reason."""
    p = F.regexp_replace(F.col(path), r"^\./", "")
    out = F.when(hard_denied(p), "hardcoded")
    if policy.exclude:
        out = out.when(p.rlike(any_regex(list(policy.exclude))), "user-exclude")
    if policy.respect_gitignore and policy.gitignore:
        out = out.when(ignored(p, policy), "gitignore")
    out = out.when(binary_extension(p), "binary")
    if size:
        out = out.when(F.col(size) > policy.max_size, "size")
    if content:
        out = out.when(~known_text(p) & binary_content(F.col(content)), "binary")
    if policy.include and policy.include != ("**/*",):
        out = out.when(~p.rlike(any_regex(list(policy.include))), "include-mismatch")
    return out


def classify(files: DataFrame, policy: Policy = Policy(), **columns) -> DataFrame:
    why = category(policy, **columns)
    return files.withColumn("category", why).withColumn("should_index", F.col("category").isNull())
