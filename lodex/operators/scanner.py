"""Definitions, parameters and calls of one file in languages other than Python, by tokens and the brackets or blocks that hold them.

Strings and comments are single tokens or none, so what stands in them opens nothing; a definition ends where its bracket or
block closes, however the text is indented.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_STRING = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_WORD = r"[^\W\d][\w$]*|\$\w+"
_REST = r"=>|->|::|\.\.\.|\?\.|[=!<>]=|\d[\w.]*|\S"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)|'


def _lexer(comment: str, string: str = _STRING, word: str = _WORD) -> re.Pattern:
    return re.compile(f"(?P<comment>{comment})|(?P<string>{string})|(?P<word>{word})|(?P<rest>{_REST})", re.DOTALL)


@dataclass(frozen=True)
class Rules:
    """How a language is read. classes, functions: words that begin a definition. shaped: where a name with parameters before a body is one without such a word."""

    lexer: re.Pattern
    classes: str = "class"
    functions: str = ""
    #: all: at the top and in classes; class: in classes only; none.
    shaped: str = "none"
    #: Where a parameter's type stands: before its name, or after it.
    type_first: bool = False
    #: Whether blocks end with the word end.
    worded: bool = False
    #: Whether a method without a body, in a class, is defined.
    bodiless: bool = False


_TICKS = r"`(?:\\.|[^`\\])*`?|"
_JS = Rules(_lexer(_C_COMMENT, _TICKS + _STRING, r"[^\W\d][\w$]*|\$[\w$]*|#\w+"), "class interface enum", "function", "class")
_C = Rules(_lexer(_C_COMMENT + r"|(?:(?<=\n)|(?<![\s\S]))[ \t]*\#(?:\\\n|[^\n])*", r'R"(\w*)\(.*?\)(?:\w*)"|' + _STRING), "struct enum union class", "", "all", True)
RULES = {
    "javascript": _JS,
    "typescript": _JS,
    "java": Rules(_lexer(_C_COMMENT, _TRIPLE + _STRING), "class interface enum record", "", "class", True, bodiless=True),
    "csharp": Rules(_lexer(_C_COMMENT + r"|\#[^\n]*", r'\$?@\$?"(?:""|[^"])*"|' + _TRIPLE + _STRING), "class interface enum record struct", "", "class", True, bodiless=True),
    "go": Rules(_lexer(_C_COMMENT, r"`[^`]*`?|" + _STRING), "type", "func"),
    "rust": Rules(_lexer(_C_COMMENT, r"""b?r\#\#".*?"\#\#|b?r\#".*?"\#|b?r"[^"]*"|b?"(?:\\.|[^"\\])*"?|b?'(?:\\[^\n]+?|[^'\\\n])'|'\w+"""), "struct enum trait union impl", "fn", bodiless=True),
    "kotlin": Rules(_lexer(_C_COMMENT, _TRIPLE + _STRING), "class interface object", "fun", bodiless=True),
    "scala": Rules(_lexer(_C_COMMENT, _TRIPLE + _STRING), "class trait object", "def", bodiless=True),
    "swift": Rules(_lexer(_C_COMMENT, _TRIPLE + r'"(?:\\.|[^"\\\n])*"?'), "class struct enum protocol extension actor", "func", bodiless=True),
    "c": _C,
    "c-family": _C,
    "cpp": _C,
    "php": Rules(_lexer(_C_COMMENT + r"|\#(?!\[)[^\n]*", r'"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\])*'?"), "class interface trait enum", "function", type_first=True, bodiless=True),
    "ruby": Rules(_lexer(r"\#[^\n]*|(?<=\n)=begin.*?(?:\n=end|\Z)", r'"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\])*'?|:[^\W\d]\w*[?!]?", r"[^\W\d]\w*[?!]?(?!=>)|[@$]+\w+"), "class module", "def", worded=True),
    "lua": Rules(_lexer(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", r"\[\[.*?(?:\]\]|\Z)|" + _STRING), "", "function", worded=True),
    "shell": Rules(_lexer(r"(?:(?<=\s)|(?<![\s\S]))\#[^\n]*", r'"(?:\\.|[^"\\])*"?|' + r"'[^']*'?|\\.", r"[^\W\d][\w-]*|\$\w+"), "", "function", "all"),
}
#: Words that are followed by brackets without being names, and words before a name that isn't defined there.
STATEMENTS = frozenset("if for while switch catch return sizeof typeof new else throw do case delete await yield using goto try finally elif until unless when match function func fn fun def in of not and or elseif foreach synchronized lock fixed guard where echo print isset unset assert super this".split())
BEFORE_USES = frozenset("return new else throw case await yield goto in of do and or not".split()) | {".", "->", "?.", "=", "(", ",", "!", "+", "-", "/", "%", "?", "|", "==", "=>"}
MODIFIERS = frozenset("public private protected internal static final abstract sealed partial override virtual async default open data export pub unsafe const inline suspend implicit fileprivate mutating extern native synchronized strictfp transient volatile readonly new explicit friend constexpr typedef".split())
PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")
#: Columns of lists, which are empty rather than null.
LISTS = ("params", "decorators", "raises", "bases", "class_attrs", "instance_attrs", "calls")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class Tokens:
    """A text's tokens without comments, the line of each, the bracket or block that each lies in, and where brackets and blocks close."""

    def __init__(self, rules: Rules, text: str):
        self.kind, self.text, self.at, self.source, self.words = [], [], [], text, rules.functions
        begin: int | None = 0
        while begin is not None:
            begin = self._read(rules, text, begin)
        breaks = [m.end() for m in re.finditer("\n", text)]
        self.line = [bisect_right(breaks, a) for a in self.at]
        self.close, self.inside = {}, []
        self._blocks() if rules.worded else self._brackets()
        self.closers = set(self.close.values())

    def _read(self, rules: Rules, text: str, begin: int) -> int | None:
        """Tokens from begin on; where to go on behind a pattern between slashes, None at the end."""
        slashes, kinds, texts, at = rules is _JS, self.kind, self.text, self.at
        for found in rules.lexer.finditer(text, begin):
            kind = found.lastgroup
            if kind == "comment":
                continue
            token = found[0]
            if slashes and token == "/" and (not texts or texts[-1] in "(,=:[!&|?{};+-*<>" or texts[-1] in ("=>", "return", "==")) and (whole := _REGEX.match(text, found.start())):
                kind, token = "string", whole[0]
            kinds.append(kind)
            texts.append(token)
            at.append(found.start())
            if kind == "string" and token[0] == "/":
                return whole.end()
        return None

    def __len__(self) -> int:
        return len(self.text)

    def _brackets(self) -> None:
        open_: list[int] = []
        for k, t in enumerate(self.text):
            rest = t in _BRACKETS and self.kind[k] == "rest"
            if rest and open_ and t not in PAIRS and (PAIRS[self.text[open_[-1]]] == t or any(PAIRS[self.text[o]] == t for o in open_)):
                while PAIRS[self.text[open_[-1]]] != t:  # left open by a mistake, or closed by a sign of another meaning
                    self.close[open_.pop()] = k
                self.close[open_.pop()] = k
            self.inside.append(open_[-1] if open_ else -1)
            if rest and t in PAIRS:
                open_.append(k)
        self.close |= dict.fromkeys(open_, len(self) - 1)

    def _blocks(self) -> None:
        """Brackets, and words up to their end."""
        lua = self.words == "function"
        always = {"function", "repeat"} if lua else {"def", "class", "module", "begin", "case"}
        leading = {"if", "while", "for"} if lua else {"if", "unless", "while", "until", "for"}
        open_: list[int] = []
        loop = -1  # the line of a loop, whose do opens nothing of its own
        for k, t in enumerate(self.text):
            plain = self.kind[k] == "word" and (k == 0 or self.text[k - 1] not in (".", ":", "&."))
            top = self.text[open_[-1]] if open_ else ""
            shuts = PAIRS.get(top) == t if self.kind[k] == "rest" else plain and (t == "end" and top not in PAIRS or lua and t == "until" and top == "repeat")
            if shuts and open_:
                self.close[open_.pop()] = k
            self.inside.append(open_[-1] if open_ else -1)
            first = k == 0 or self.line[k] != self.line[k - 1] or self.text[k - 1] in (";", "=", "then", "else", "do", "(")
            if self.kind[k] == "rest" and t in PAIRS or plain and (t in always and not (t == "def" and self._endless(k)) or t in leading and first or t == "do" and loop != self.line[k]):
                open_.append(k)
            if plain and t in ("while", "until", "for"):
                loop = self.line[k]
        self.close |= dict.fromkeys(open_, len(self) - 1)

    def _endless(self, k: int) -> bool:
        """Whether what def at k defines is what stands behind a sign of equality."""
        j, depth = k + 1, 0
        while j < len(self) and self.line[j] == self.line[k] and (depth or self.kind[j] == "word" or self.text[j] in (".", "(")):
            depth += (self.text[j] == "(") - (self.text[j] == ")")
            j += 1
        return j < len(self) and self.line[j] == self.line[k] and self.text[j] == "=" and self.at[j] > self.at[j - 1] + len(self.text[j - 1])

    def past(self, k: int) -> int:
        """Behind the bracket that opens at k."""
        return self.close[k] + 1

    def slice(self, a: int, b: int) -> str:
        """The source from token a up to token b."""
        return self.source[self.at[a] : self.at[b - 1] + len(self.text[b - 1])].strip() if a < b else ""


@dataclass
class Found:
    """A definition: its name, its first and last token, the bracket or block that holds its body (-1: none), and its parameters' bracket."""

    kind: str
    name: str
    first: int
    last: int
    body: int
    params: int = -1
    of_type: str | None = None


def _angles(t: Tokens, k: int) -> int:
    """Behind the <...> at k, or behind k if it stays open."""
    depth, j = 0, k
    while j < len(t) and t.text[j] not in ("{", ";", "("):
        depth += (t.text[j] == "<") - (t.text[j] == ">")
        j += 1
        if depth == 0:
            return j
    return k + 1


def _line_end(t: Tokens, k: int) -> int:
    """The last token of what begins at k and goes on while brackets are open."""
    j = k
    while j + 1 < len(t) and t.line[j + 1] == t.line[j] and t.text[j + 1] not in ("}", ")", ";"):
        j += 1
        j = t.close.get(j, j)
    return j


def _body(t: Tokens, k: int, rules: Rules) -> tuple[int, int] | None:
    """(body, last token) of a definition whose head goes on at k; None if it is none."""
    j, within, line = k, t.inside[k] if k < len(t) else -1, t.line[k - 1]
    lead = False  # behind a colon of initial values
    while j < len(t) and t.inside[j] == within and t.text[j] not in (")", "]", "}"):
        word = t.text[j]
        if word == "{" and not (lead and t.kind[j - 1] == "word"):
            return j, t.close[j]
        if word == ";":
            return (-1, j) if rules.bodiless else None
        if word in ("=>", "="):
            return (-1, _line_end(t, j)) if rules.bodiless and not rules.type_first or word == "=>" else None
        if rules.bodiless and not rules.type_first and t.line[j] != line and word not in (":", "->", "where", "throws", "with", "extends"):
            return -1, j - 1
        if rules.type_first and t.kind[j] == "rest" and word not in (":", "->", "::", ",", "<", ">", "*", "&", ".", "[", "(", "{", "?"):
            return None
        lead |= word == ":" and not rules.bodiless
        line = t.line[j]
        j = t.past(j) if j in t.close else j + 1
    return (-1, j - 1) if rules.bodiless and not rules.type_first else None


def _class_at(t: Tokens, k: int, rules: Rules) -> Found | None:
    word, j = t.text[k], k + 1
    if word == "class" and j < len(t) and t.text[j] in ("class", "struct") or word == "enum" and j < len(t) and t.text[j] in ("class", "struct"):
        j += 1
    if word == "impl":
        j = _angles(t, j) if j < len(t) and t.text[j] == "<" else j
        names = []
        while j < len(t) and t.text[j] not in ("{", ";", "where"):
            if t.text[j] == "for":
                names = []
            elif t.kind[j] == "word" and not (names and t.text[j - 1] != "::"):
                names = [t.text[j]]
            j = _angles(t, j) if t.text[j] == "<" else j + 1
        name = names[0] if names else None
    else:
        name = t.text[j] if j < len(t) and t.kind[j] == "word" else None
        j += 1
        while name and rules.worded and j + 1 < len(t) and t.text[j] == "::":
            name, j = f"{name}::{t.text[j + 1]}", j + 2
    if not name or name in STATEMENTS or name in ("extends", "implements"):
        return None
    if rules.worded:
        return Found("class", name, k, t.close[k], k)
    if word == "type" and not (j < len(t) and t.text[j] in ("struct", "interface", "[")):
        return None
    line = t.line[j - 1]
    while j < len(t) and t.text[j] not in ("{", ";", "}", ")", "="):
        if rules.bodiless and not rules.type_first and t.line[j] != line and t.text[j] not in (":", "extends", "with", "where", "(", ","):
            break
        if rules.shaped == "all" and t.text[j] in ("(", "*", "&"):
            return None  # a type that is used
        line = t.line[j]
        j = t.past(j) if j in t.close else j + 1
    if j < len(t) and t.text[j] == "{":
        return Found("class", name, k, t.close[j], j)
    return Found("class", name, k, min(j, len(t) - 1) if j < len(t) and t.text[j] == ";" else j - 1, -1) if rules.bodiless else None


def _keyword_function(t: Tokens, k: int, rules: Rules) -> Found | None:
    j = k + 1
    if t.text[k] == "func" and j < len(t) and t.text[j] == "(":
        j = t.past(j)  # the receiver
    name = None
    while j < len(t) and (t.kind[j] == "word" or t.text[j] in ("*", "&", ".", ":", "<", "[", "::")) and t.line[j] == t.line[k]:
        if t.text[j] in ("<", "["):
            j = _angles(t, j) if t.text[j] == "<" else t.past(j)
            continue
        if t.text[j] == ":" and not rules.worded:
            break
        if t.kind[j] == "word":
            if name and t.text[j - 1] not in (".", ":", "::", ">"):
                break
            name = t.text[j]
        j += 1
    if not name:
        return None
    params = j if j < len(t) and t.text[j] == "(" else -1
    after = t.past(params) if params >= 0 else j
    if rules.worded:
        if t.text[k] == "def" and after < len(t) and t.text[after] == "=" and t.line[after] == t.line[k]:
            return Found("function", name, k, _line_end(t, after), -1, params)
        return Found("function", name, k, t.close.get(k, len(t) - 1), k, params)
    if params < 0 and rules.shaped == "none" and "def" not in rules.functions:
        return None
    while after < len(t) and t.text[after] == "(" and "def" in rules.functions:
        after = t.past(after)
    got = _body(t, after, rules) if after < len(t) else (-1, after - 1) if rules.bodiless else None
    return got and Found("function", name, k, got[1], got[0], params)


def _shaped_function(t: Tokens, k: int, rules: Rules, owner: str | None) -> Found | None:
    """A name, its parameters and a body."""
    j = k + 1
    j = _angles(t, j) if rules.shaped == "class" and j < len(t) and t.text[j] == "<" else j
    if t.text[k] in STATEMENTS or j >= len(t) or t.text[j] != "(" or k and t.text[k - 1] in BEFORE_USES:
        return None
    typed = k and (t.kind[k - 1] == "word" or t.text[k - 1] in (">", "]", "*", "&", "~", "::", "?")) and t.text[k - 1] not in STATEMENTS
    if rules.type_first and not typed and t.text[k] != owner:
        return None
    after = t.past(j)
    if after >= len(t) or rules is _JS and t.text[after] not in ("{", ":"):
        return None
    got = _body(t, after, rules)
    if not got or got[0] < 0 and t.text[got[1]] != ";" and "=>" not in t.text[after : after + 1]:
        return None
    first = k
    while rules.type_first and first and t.inside[first - 1] == t.inside[k] and t.text[first - 1] not in (";", "{", "}", ":"):
        first -= 1
    while first < k and t.text[first] in (")", "]"):  # the last of what stood within brackets before
        first += 1
    return Found("function", t.text[k], first, got[1], got[0], j)


def _assigned_function(t: Tokens, k: int) -> Found | None:
    """name = function, or name = (parameters) =>."""
    j = k + 1
    if j < len(t) and t.text[j] == ":":
        while j < len(t) and t.text[j] not in ("=", ";", "{", "}", ")"):
            j = t.past(j) if j in t.close else j + 1
    if j + 1 >= len(t) or t.text[j] != "=" or k and t.text[k - 1] in (".", ",", "("):
        return None
    j += 1
    j += t.text[j] == "async"
    if j < len(t) and t.text[j] == "function":
        j += 1
        j += j < len(t) and t.text[j] == "*"
        j += j < len(t) and t.kind[j] == "word"
        if j < len(t) and t.text[j] == "(" and t.past(j) < len(t) and t.text[t.past(j)] == "{":
            return Found("function", t.text[k], k, t.close[t.past(j)], t.past(j), j)
        return None
    params, after = (j, t.past(j)) if j < len(t) and t.text[j] == "(" else (-1, j + 1)
    if after < len(t) and t.text[after] == ":" and params >= 0:
        while after < len(t) and t.text[after] not in ("=>", ";", "{", "}"):
            after = t.past(after) if after in t.close else after + 1
    if after + 1 < len(t) and t.text[after] == "=>" and (params >= 0 or t.kind[j] == "word"):
        body = after + 1 if t.text[after + 1] == "{" else -1
        return Found("function", t.text[k], k, t.close[body] if body >= 0 else _line_end(t, after), body, params)
    return None


def _params(t: Tokens, found: Found, rules: Rules) -> list[dict]:
    if found.params < 0:
        return []
    parts, begin, angle = [], found.params + 1, 0
    for k in range(found.params + 1, t.close[found.params] + 1):
        angle += (t.text[k] == "<") - (t.text[k] == ">")
        if t.text[k] == "," and t.inside[k] == found.params and angle <= 0 or k == t.close[found.params]:
            parts.append((begin, k))
            begin = k + 1
    out = []
    for a, b in parts:
        eq = next((k for k in range(a, b) if t.text[k] == "=" and t.inside[k] == found.params), b)
        colon = next((k for k in range(a, eq) if t.text[k] == ":" and t.inside[k] == found.params), eq)
        words = [k for k in range(a, colon) if t.kind[k] == "word" and t.inside[k] == found.params]
        if not words:
            if t.text[a : a + 1] and t.text[a] in ("{", "["):  # a pattern in place of a name
                words = [a]
            else:
                continue
        go = rules.functions == "func" and rules.classes == "type"
        at = words[0] if go else words[-1]
        name = t.slice(at, t.past(at)) if at in t.close else t.text[at]
        kind = t.slice(at + 1, eq) if go else t.slice(a, at) if rules.type_first else t.slice(colon + 1, eq)
        if rules.type_first and not kind and name[:1] != "$":
            name, kind = ("", name) if name == "void" else (name, kind)
        if name:
            value, kind = t.slice(eq + 1, b), "" if kind == "&" else kind
            out.append({"name": name.lstrip("&"), "annotation": kind.removeprefix("mut ").removesuffix("...").strip() or None, "has_default": eq < b, "default_value": value or None, "variadic": "..." in t.text[a:b] or t.text[a : a + 1] == ["*"] and rules.worded, "kw_variadic": False})
    if rules.functions == "func" and rules.classes == "type":  # names that share the type behind them
        for p, q in reversed(list(zip(out, out[1:], strict=False))):
            p["annotation"] = p["annotation"] or q["annotation"]
    return out


def _result(t: Tokens, found: Found, rules: Rules) -> str | None:
    if rules.type_first and not rules.functions:
        name = max((k for k in range(found.first, found.params) if t.text[k] == found.name), default=found.first)
        a = found.first
        while a < name:
            if t.text[a] == "@" or t.text[a] == "template":
                a += 2 if t.text[a] == "@" else 1
                a = t.past(a) if t.text[a] == "(" else a
            elif t.text[a] == "<":
                a = max(_angles(t, a), a + 1)
            elif t.text[a] == "[":
                a = t.past(a)
            elif t.text[a] in MODIFIERS:
                a += 1
            else:
                break
        while name - 2 > a and t.text[name - 1] == "::":  # of the class that it is defined for
            name -= 2
        return t.slice(a, name) or None
    if found.params < 0 or rules.worded:
        return None
    a = t.past(found.params)
    b = found.body if found.body >= 0 else found.last + 1
    b = next((k for k in range(a, b) if t.text[k] in ("=>", "=", ";", "where", "throws")), b)
    if a < b and t.text[a] in (":", "->"):
        a += 1
    elif rules.functions != "func":
        return None
    return t.slice(a, b) or None


def _calls(t: Tokens, found: Found, names: set[int]) -> list[dict]:
    """Names with brackets behind them in the body, with what they are taken from, in the order in which they are first seen."""
    counts: dict[str, int] = {}
    for k in range(max(found.body, found.params, found.first) + 1, found.last):
        if t.kind[k] == "word" and t.text[k + 1] == "(" and (t.text[k] not in STATEMENTS or t.text[k - 1] in (".", "::", "->")) and k not in names:
            first = k
            while first > 1 and t.text[first - 1] in (".", "::", "->", "?.") and t.kind[first - 2] == "word":
                first -= 2
            callee = "".join(t.text[first : k + 1])
            counts[callee] = counts.get(callee, 0) + 1
    return [{"callee": c, "ord": k, "n": n} for k, (c, n) in enumerate(counts.items())]


def definitions(language: str, text: str) -> tuple[Tokens, list[tuple[Found, int, int]]]:
    """The tokens, and each definition with its name's token and the number of the one that holds it (-1: none), in order."""
    rules = RULES[language]
    t, found, open_ = Tokens(rules, text), [], []
    classes, functions = frozenset(rules.classes.split()), frozenset(rules.functions.split())
    for k, sort in enumerate(t.kind):
        if sort != "word":
            continue
        while open_ and found[open_[-1]][0].last < k:
            open_.pop()
        if k and t.text[k - 1] in (".", "->", "?.") or k and t.text[k - 1] == "::" and not rules.type_first:
            continue
        holder = found[open_[-1]][0] if open_ else None
        direct = holder is not None and holder.kind == "class" and t.inside[k] == holder.body
        if found and found[-1][1] < k and found[-1][0].first <= k <= max(found[-1][0].params, found[-1][0].first):
            continue  # within the head of the last
        got = None
        if t.text[k] in classes and not (k and t.text[k - 1] == "@" and rules.bodiless and not rules.type_first):
            got = _class_at(t, k, rules)
        elif t.text[k] in functions:
            got = _keyword_function(t, k, rules)
        elif rules.shaped == "class" and direct or rules.shaped == "all" and (holder is None or direct):
            got = _shaped_function(t, k, rules, holder.name if holder else None)
        if not got and rules is _JS:
            got = _assigned_function(t, k)
        if got:
            at = next((j for j in range(k, min(k + 30, len(t))) if t.text[j] == got.name), k)
            if not (found and found[-1][1] == at):
                found.append((got, at, open_[-1] if open_ else -1))
                open_.append(len(found) - 1)
    return t, found


def scan_source(language: str, path: str, text: str) -> list[dict]:
    """Rows of functions, classes and methods with their lines, parameters, results and calls.

    What a class holds is its method. What is defined within a function is an inner_function or inner_class, with the number of
    definitions around it as its depth and the name of the one that holds it. Of a name defined twice at one place the first counts.
    """
    rules = RULES[language]
    t, found = definitions(language, text)
    rows, seen, full, depth, inner = [], set(), {}, {}, {}
    heads = {at for _, at, _ in found}
    for k, (f, _, above) in enumerate(found):
        holder = found[above][0] if above >= 0 else None
        owner = full[above] if holder and holder.kind == "class" else None
        inner[k] = above >= 0 and (inner[above] or holder.kind == "function")
        depth[k] = depth[above] + 1 if above >= 0 else 0
        full[k] = f"{full[above]}.{f.name}" if f.kind == "function" and owner or inner[k] else f.name
        kind = ("method" if owner else "function") if f.kind == "function" else "class"
        kind = f"inner_{kind}" if inner[k] else kind
        if (kind, full[k]) in seen:
            continue
        seen.add((kind, full[k]))
        function = f.kind == "function"
        rows.append({c: [] for c in LISTS} | {
            "path": path, "kind": kind, "class_name": owner if function else None, "name": f.name, "qualified_name": full[k], "ord": len(rows), "start_line": t.line[f.first] + 1, "end_line": t.line[f.last] + 1, "visibility": "public",
            "params": _params(t, f, rules) if function else [], "return_type": _result(t, f, rules) if function else None, "calls": _calls(t, f, heads) if function else [], "depth": depth[k], "parent": full[above] if above >= 0 else None,
        })
    return rows
