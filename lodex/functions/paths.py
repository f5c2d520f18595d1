"""Globs, ignore rules and the path filter, which batch and stream share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodex.config import EXCLUDED, EXTENSIONS, LANGUAGES


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: * and ? stay within a segment, ** spans any number of segments."""
    parts = pattern.strip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        if part == "**":
            out += "(?:[^/]+/)*" if k < len(parts) - 1 else ".*"
            continue
        out += _segment(part) + ("/" if k < len(parts) - 1 else "")
    return f"^{out}$"


def _segment(part: str) -> str:
    out, k = "", 0
    while k < len(part):
        c = part[k]
        close = part.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            inside = part[k + 1 : close]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return out


def ignore_rules(lines: Iterable[str]) -> list[tuple[str, bool]]:
    """(regular expression over the path, whether it ignores) in order; of those that match a path the last decides.

    A leading or inner / ties a pattern to the root, a trailing / to folders, ! takes a path back.
    """
    rules = []
    for line in lines:
        text = line.rstrip("\n").rstrip()
        if not text or text.startswith("#"):
            continue
        keep, text = text.startswith("!"), text.removeprefix("!")
        folder, tied = text.endswith("/"), "/" in text.rstrip("/")
        body = glob_regex(text)[1:-1]
        rules.append((("^" if tied else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), not keep))
    return rules


def ignored(path: Column, lines: Iterable[str]) -> Column:
    """Whether the last matching rule ignores the path."""
    out = F.lit(False)
    for pattern, verdict in ignore_rules(lines):
        out = F.when(path.rlike(pattern), F.lit(verdict)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """The ending of the file name in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """By ending; an unknown ending is its own language, none is unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    ext = F.substring(extension(path), 2, 64)
    return F.coalesce(known[ext], F.when(ext != "", ext), F.lit("unknown"))


def excluded(path: Column, names: Iterable[str] = EXCLUDED, substring: bool = False) -> Column:
    """Whether a segment of the path is an excluded name, or holds one with substring."""
    names = [F.lit(n) for n in dict.fromkeys(names)]
    parts = F.split(path, "/")
    if substring:
        return F.exists(parts, lambda p: F.exists(F.array(*names), lambda n: F.contains(p, n)))
    return F.exists(parts, lambda p: p.isin(*names))


def wanted(path: Column, *, extensions: Iterable[str] = EXTENSIONS, exclude: Iterable[str] = (), ignore_lines: Iterable[str] = (), substring: bool = False) -> Column:
    """The filter of files: ending first, then excluded names, then ignore rules."""
    return extension(path).isin(*extensions) & ~excluded(path, (*EXCLUDED, *exclude), substring) & ~ignored(path, ignore_lines)


def path_test(*, extensions: Iterable[str] = EXTENSIONS, exclude: Iterable[str] = (), ignore_lines: Iterable[str] = (), substring: bool = False) -> Callable[[str, bool], bool]:
    """The same filter for one path at a time, and for folders: whether to enter one. A folder with files to take back is entered."""
    names, endings = (*EXCLUDED, *exclude), frozenset(extensions)
    rules = [(re.compile(pattern), verdict) for pattern, verdict in ignore_rules(ignore_lines)]
    back = not all(verdict for _, verdict in rules)

    def keeps(path: str, folder: bool) -> bool:
        last = path.rpartition("/")[2]
        if last in names or substring and any(n in last for n in names):
            return False
        if folder:
            return back or not any(pattern.match(f"{path}/x") for pattern, _ in rules)
        dot = last.rfind(".")
        verdicts = [verdict for pattern, verdict in rules if pattern.match(path)]
        return (last[dot:].lower() if dot >= 0 else "") in endings and not (verdicts and verdicts[-1])

    return keeps


def under(path: Column, prefix: str | None = None, without: str | None = None) -> Column:
    """Paths that begin with a prefix and with none of the comma-separated ones left out."""
    out = path.startswith(prefix) if prefix else F.lit(True)
    for bad in filter(None, (x.strip() for x in (without or "").split(","))):
        out &= ~path.startswith(bad)
    return out


def named_within(path: Column, names: Iterable[str], depth: int, keep: Iterable[str] = ()) -> Column:
    """Paths of at most so many parts whose last is one of the names, but for those at or below a path to keep."""
    parts = F.split(path, "/")
    out = (F.size(parts) <= depth) & F.element_at(parts, -1).isin(*names)
    for kept in keep:
        out &= (path != kept) & ~path.startswith(f"{kept.rstrip('/')}/")
    return out


def cache_key(path: Column) -> Column:
    """Last name of the path, and the first 16 digits of its hash."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16))
