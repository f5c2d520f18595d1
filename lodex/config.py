"""Settings and fixed values."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

# Names that a scan leaves out, file name endings that it takes, languages by ending, and limits.
EXCLUDED = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "bower_components", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", "htmlcov", ".tox", ".nox", ".eggs", "egg-info", ".coverage", "migrations",
    "dist", "build", ".next", ".nuxt", ".svelte-kit", ".parcel-cache", ".turbo", ".cache", "out", "coverage", "target", "bin", "obj", ".idea", ".vscode", ".DS_Store", "models", "checkpoints", "huggingface", ".huggingface", "hf-cache", "backups", "backup", ".backups", ".abstract-index.json",
)
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "swift": "swift",
    "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "c-family", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "lua": "lua", "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "mdx": "markdown", "rst": "restructuredtext", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "ini": "ini", "cfg": "config", "conf": "config", "env": "config", "xml": "xml", "html": "html", "css": "css", "sql": "sql", "graphql": "graphql", "proto": "protobuf",
}
EXTENSIONS = tuple(f".{x}" for x in LANGUAGES)
TEXT_LANGUAGES = ("markdown", "restructuredtext", "text", "json", "yaml", "toml", "ini", "config", "xml", "html", "css")
LARGE_LINES, LARGE_BYTES, MOST_BYTES = 3000, 512 * 1024, 2 * 1024 * 1024
REGION_LINES, REGION_CHARS, REGIONS = 40, 1800, 200
RRF_K, VECTOR_TIMES, TEXT_TIMES, MERGED, RERANK_MORE = 60, 4, 2, 30, 5
KEYWORD_CAP, DIMENSIONS, CLIP = 50, 1024, 4000
BM25_K1, BM25_B = 1.2, 0.75
DEBOUNCE_MS, FLUSH_PATHS, TICK_MS = 400, 64, 100
OVERVIEW_FILES = 80
SHOWN_ATTRIBUTES, SHOWN_CONSTANTS, SHOWN_VALUE, SHOWN_READS, SHOWN_TYPE_LINES = 8, 8, 80, 3, 5
SHOWN_ENTRIES, SHOWN_LINES = 40, 80
SCHEMA_VERSION = 4
# What marks a project's root, folders of a home that are no project, and variables that name one.
ROOT_MARKERS = (".git", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "composer.json", "Gemfile", "build.gradle", "build.gradle.kts", "pom.xml", "Makefile")
NO_PROJECTS = (".claude", ".codex", ".gemini", ".cache", ".config", ".local")
ROOT_VARIABLES = ("REPO_ROOT", "WORKSPACE_ROOT", "WORKSPACE", "PROJECT_ROOT", "PWD", "INIT_CWD")


@dataclass(frozen=True)
class EngineConfig:
    """Settings of one repository's index."""

    root: str
    languages: tuple[str, ...] = ()
    extra_extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_private: bool = False
    compat_substring: bool = False
    ignore_lines: tuple[str, ...] = field(default=())
    ignore_files: tuple[str, ...] = (".gitignore",)
    watch_files: bool = True
    embedding_model: str = ""
    dimensions: int = DIMENSIONS
    #: A model's function from a text to a vector, and from hits (id, score, vec_rank, fts_rank) to hits in a better order.
    encode: Callable | None = None
    rerank: Callable | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> EngineConfig:
        """Settings by environment variables; lists are comma-separated, and what isn't set keeps its default."""
        listed = lambda name: tuple(x.strip() for x in env.get(name, "").split(",") if x.strip())
        return cls(
            root=resolve_root(env),
            languages=listed("LANGUAGES"),
            extra_extensions=tuple(x.lower() for x in listed("GENERIC_CODE_EXTENSIONS")),
            exclude=listed("EXCLUDE_PATTERNS"),
            include_private=env.get("INCLUDE_PRIVATE_FUNCTIONS", "false").lower() == "true",
            watch_files=env.get("WATCH_FILES", "true").lower() == "true",
            embedding_model=env.get("EMBEDDING_MODEL", ""),
        )


def resolve_root(env: Mapping[str, str], start: str | None = None, home: str | None = None) -> str:
    """The project's folder: REPO_ROOT if set; else the nearest marked folder that holds one of the places probed.

    Probed are the start, then the places that the variables name, in order. A home itself is never taken for marked. Without a
    marked folder the first place counts that isn't a home or one of its folders of settings, else the first.
    """
    if env.get("REPO_ROOT"):
        return str(Path(env["REPO_ROOT"]).expanduser().resolve())
    at_home = Path(home or Path.home()).expanduser().resolve()
    named = [start, *(env.get(v) for v in ROOT_VARIABLES)]
    places = [Path(p).expanduser().resolve() for p in named if p] or [Path.cwd()]
    for place in places:
        for folder in (place, *place.parents):
            if folder != at_home and any((folder / m).exists() for m in ROOT_MARKERS):
                return str(folder)
    poor = {at_home, *(at_home / n for n in NO_PROJECTS)}
    return str(next((p for p in places if p not in poor), places[0]))
