"""Path predicates and projections, Column -> Column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language.
EXTENSIONS = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".py": "python",
    ".rs": "rust",
    ".java": "java",
}
UNKNOWN = "unknown"

# Directory names never scanned.
PRUNED_DIRS = (
    "node_modules", ".next", ".nuxt", ".vuepress", ".svelte-kit", ".turbo", ".yarn", ".pnpm-store",
    ".parcel-cache", ".rollup-cache", ".eslintcache", ".stylelintcache", ".tsbuildinfo", ".swc",
    "vendor",
    "__pycache__", ".venv", "venv", ".pytest_cache", ".tox", ".mypy_cache", ".ruff_cache",
    "target",
    ".gradle", ".mvn",
    "build", "dist", "bin", "out",
    ".git", ".svn", ".hg",
    ".idea", ".vscode", ".vs",
    ".terraform", ".serverless",
    ".cache", "coverage",
    ".DS_Store", "Thumbs.db",
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    """Names of the directories above a file, outermost first."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def ancestors(path: Column) -> Column:
    """Every leading path of a file, itself included: a, a/b, a/b/c.js."""
    depth = F.size(F.split(path, "/"))
    return F.transform(F.sequence(F.lit(1), depth), lambda n: F.call_function("substring_index", path, F.lit("/"), n))


def detect_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F
    for language in dict.fromkeys(EXTENSIONS.values()):
        out = out.when(ext.isin(*[e for e, lang in EXTENSIONS.items() if lang == language]), F.lit(language))
    return out.otherwise(F.lit(UNKNOWN))


def in_pruned_dir(path: Column, names: Sequence[str] = PRUNED_DIRS) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + ")/")


def detect_file_type(path: Column) -> Column:
    """Config format from the file name; the first rule that holds decides."""
    name = base_name(path)
    yaml = name.endswith(".yaml") | name.endswith(".yml")
    return (
        F.when(name == ".envrc", F.lit("envrc"))
        .when(name.startswith(".env"), F.lit("env"))
        .when(name.startswith("docker-compose."), F.lit("docker-compose"))
        .when(yaml & (name.contains("configmap") | name.contains("secret")), F.lit("k8s"))
        .when(name.endswith(".service"), F.lit("systemd"))
        .when(name.endswith(".sh") | name.endswith(".bash"), F.lit("shell"))
        .otherwise(F.lit("env"))
    )


def relativize(path: Column, root: Column) -> Column:
    """Path below ``root``; the base name when it lies elsewhere."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.substring(path, F.length(prefix) + 1, F.length(path))
    return F.when(path.startswith(prefix), below).otherwise(base_name(path))


_GLOB_CHAR = r"(?:\\.|[^\\\]-])"
_GLOB_CLASS = re.compile(rf"\[(\^?)((?:{_GLOB_CHAR}(?:-{_GLOB_CHAR})?)+)\]")


def glob_regex(glob: str) -> str | None:
    """Java regex of a shell glob; ``*`` and ``?`` stop at '/'. None when malformed."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            m = _GLOB_CLASS.match(glob, i)
            if not m:
                return None
            chars = re.sub(r"\\(.)|([\[&^])", lambda e: re.escape(e.group(1) or e.group(2)), m.group(2))
            out.append(f"[{m.group(1)}{chars}]")
            i = m.end()
            continue
        if c == "\\":
            i += 1
            if i == len(glob):
                return None
            c = re.escape(glob[i])
        else:
            c = {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        out.append(c)
        i += 1
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, globs: Sequence[str], root: str) -> Column:
    """Any glob matches the base name, or the whole path below the scan root."""
    patterns = [r for r in map(glob_regex, globs) if r is not None]
    if not patterns:
        return F.lit(False)
    either = "(?s)" + "|".join(f"(?:{p})" for p in patterns)
    full = F.concat(F.lit(root.rstrip("/") + "/"), path)
    return base_name(path).rlike(either) | full.rlike(either)
