"""Parsing Python texts with errors: what stands between the broken statements is kept.

A text that the parser refuses is taken apart where a statement begins without indentation; each part is parsed alone. In a
class or function whose body is broken the same is done one level down. A definition whose head is broken stays by its name.
"""

from __future__ import annotations

import ast
import re

#: Errors that are told, parts that a bracket or a string left open may run over, and lines that the head of a definition may have.
TOLD, RUN, HEAD = 5, 50, 30
_DEFINES = re.compile(r"(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")
_GOES_ON = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}#]|$")


def recovered(text: str) -> tuple[ast.Module, list[str]]:
    """The sound statements of a text, at their lines, and its errors in order."""
    errors: list[tuple[int, str]] = []
    body = _statements(re.split(r"\r\n|\r|\n", text), 0, errors)
    return ast.Module(body, []), [e for _, e in sorted(errors)]


def told(errors: list[str]) -> str:
    """The first errors in a line, and how many more there are."""
    more = f" (+{len(errors) - TOLD} more)" if len(errors) > TOLD else ""
    return "; ".join(errors[:TOLD]) + more


def _parse(lines: list[str]) -> tuple[list[ast.stmt] | None, SyntaxError | ValueError | None]:
    try:
        return ast.parse("\n".join(lines) + "\n").body, None
    except (SyntaxError, ValueError) as e:
        return None, e


def _at(nodes: list[ast.stmt], offset: int) -> list[ast.stmt]:
    open_ = list(nodes) if offset else []
    for x in open_:
        held = x.__dict__
        if "lineno" in held:
            held["lineno"] += offset
            if held.get("end_lineno") is not None:
                held["end_lineno"] += offset
        for v in held.values():
            if type(v) is list:
                open_ += [y for y in v if isinstance(y, ast.AST)]
            elif isinstance(v, ast.AST) and not isinstance(v, ast.expr_context):
                open_.append(v)
    return nodes


def _parts(lines: list[str]) -> list[int]:
    """Where statements begin; decorators belong to what they stand before."""
    starts = [k for k, x in enumerate(lines) if x[:1] not in ("", " ", "\t", "\f") and not _GOES_ON.match(x)]
    return [k for n, k in enumerate(starts) if not n or not lines[starts[n - 1]].startswith("@")]


def _statements(lines: list[str], offset: int, errors: list[tuple[int, str]]) -> list[ast.stmt]:
    """Statements of lines of which the first is that after `offset` in the text."""
    whole, error = _parse(lines)
    if whole is not None:
        return _at(whole, offset)
    starts = _parts(lines)
    if not starts or starts[0]:
        starts = [0, *starts]
    if len(starts) == 1:
        return _salvaged(lines, offset, error, errors)
    ends, out, k = [*starts[1:], len(lines)], [], 0
    while k < len(starts):
        begin, used = starts[k], k
        found, error = _parse(lines[begin : ends[k]])
        if found is None and re.search("never closed|unterminated triple", str(error)):
            for j in range(k + 1, min(k + RUN, len(starts))):
                found, _ = _parse(lines[begin : ends[j]])
                if found is not None:
                    used = j
                    break
        out += _salvaged(lines[begin : ends[k]], offset + begin, error, errors) if found is None else _at(found, offset + begin)
        k = used + 1
    return out


def _salvaged(lines: list[str], offset: int, error: SyntaxError | ValueError, errors: list[tuple[int, str]]) -> list[ast.stmt]:
    """What is sound in a statement that the parser refuses."""
    head = next((k for k, x in enumerate(lines) if x.strip() and not x.lstrip().startswith(("@", "#"))), 0)
    defines = _DEFINES.match(lines[head])
    last = max((k for k, x in enumerate(lines) if x.strip()), default=0)
    for end in range(head, min(head + HEAD, len(lines))) if defines else ():
        if not lines[end].rstrip().endswith(":"):
            continue
        made, _ = _parse([*lines[: end + 1], "    pass"])
        if made is None or end >= last:
            continue
        inner = lines[end + 1 : last + 1]
        first = next((x for x in inner if x.strip()), "")
        indent = first[: len(first) - len(first.lstrip())]
        if not indent:
            break
        node = _at(made, offset)[0]
        node.body = _statements([x.removeprefix(indent) if x.startswith(indent) else x.lstrip() if not x.strip() else x for x in inner], offset + end + 1, errors) or node.body
        node.end_lineno = offset + last + 1
        return [node]
    line = offset + (getattr(error, "lineno", None) or 1)
    said = (getattr(error, "text", None) or lines[head]).strip()[:40]
    errors.append((line, f"syntax error at L{line}:{getattr(error, 'offset', None) or 0}: '{said}'"))
    if not defines:
        return []
    node = ast.parse(f"def {defines[2]}(): pass" if defines[1] == "def" else f"class {defines[2]}: pass").body[0]
    node.lineno, node.end_lineno, node.by_name = offset + head + 1, offset + last + 1, True
    return [node]


def sound(tree: ast.Module) -> bool:
    """Whether there is more than definitions that stay by their names alone."""
    return not all(getattr(node, "by_name", False) for node in tree.body)
