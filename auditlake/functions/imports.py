"""Static imports of JavaScript and TypeScript files, from their tokens.

Only string literals are import targets; calls with anything else count as dynamic. What a file's extension rules out (types in a
JavaScript file, JSX where there is none) and what isn't closed leaves the whole file unparsed, with a limitation.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd

from auditlake.functions.javascript import TYPED, Unparsed, extension, tokens, unquoted
from auditlake.functions.lazy import lazy_udf

#: What a declaration can follow: the end of a statement, or (without a semicolon) of a value.
_ENDS = frozenset("; } ) ] { string template part name number regex element".split())
_TYPE_BEFORE = frozenset("typeof as extends keyof satisfies is".split())
_LINE_END = re.compile(r"\r\n|[\n\r\u2028\u2029]")


def only_types(names: list[str]) -> bool:
    """Whether every name in braces is imported as a type, and there is one."""
    groups = [g for g in _groups(names) if g]
    return bool(groups) and all(map(_is_type, groups))


def _groups(names: list[str]):
    group = []
    for t in [*names, ","]:
        if t == ",":
            yield group
            group = []
        else:
            group.append(t)


def _is_type(group: list[str]) -> bool:
    """`type T`, `type T as U`, `type as as U`; but `type`, `type as T` name a value."""
    return group[0] == "type" and (len(group) > 1 and group[1] != "as" or len(group) > 3 or group == ["type", "as"])


class _Reader:
    def __init__(self, source: str, path: str):
        self.toks, self.typed, self.found, self.dynamic = tokens(source, path), extension(path) in TYPED, [], 0
        self.source, self.shut = source, {}
        stack = []
        for i, t in enumerate(self.toks):
            if t.kind == "(":
                stack.append(i)
            elif t.kind == ")":
                self.shut[stack.pop()] = i

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def member(self, i: int) -> bool:
        return self.kind(i - 1) in (".", "?.")

    def call(self, i: int) -> bool:
        """Whether the word at i is called: no member, no declared function or method, no type."""
        if self.kind(i + 1) != "(" or self.member(i) or self.text(i - 1) in ("function", "new") or self.kind(i - 1) == "*":
            return False
        after = self.shut[i + 1] + 1
        if self.kind(after) == "{" and not _LINE_END.search(self.source, self.toks[after - 1].at, self.toks[after].at):
            return False
        if self.text(i) == "import" and self.typed:
            return self.text(i - 1) not in _TYPE_BEFORE and self.kind(i - 1) not in ("<", "|", "&")
        return True

    def add(self, kind: str, i: int, at: int) -> None:
        self.found.append((kind, unquoted(self.text(i)), at))

    def declaration(self, i: int) -> int:
        """An import or export at i; the last token that belongs to it for sure."""
        word, at, j = self.text(i), self.toks[i].at, i + 1
        if word == "import" and self.kind(j) == "string":
            self.add("static", j, at)
            return j
        # `import type from` imports a value, `import type from from` a type of that name.
        keyword = self.text(j) == "type" and self.kind(j + 1) in ("name", "{", "*") and (self.text(j + 1) != "from" or self.text(j + 2) == "from")
        j += keyword
        names, depth, outside = [], 0, False
        while self.kind(j) in ("name", ",", "*", "{", "}") or depth and self.kind(j) == "string":
            if self.text(j) == "from" and self.kind(j + 1) == "string" and not depth:
                break
            if depth and self.kind(j) != "}":
                names.append(self.text(j))
            elif self.kind(j) in ("name", "*"):
                outside = True
            depth += (self.kind(j) == "{") - (self.kind(j) == "}")
            j += 1
        if self.text(j) != "from" or self.kind(j) != "name" or self.kind(j + 1) != "string":
            return i
        if not self.typed and (keyword or any(map(_is_type, filter(None, _groups(names))))):
            raise Unparsed("types")
        types = keyword or (not outside and only_types(names))
        self.add("type-only" if types else "static" if word == "import" else "re-export", j + 1, at)
        return j + 1

    def run(self) -> None:
        i = 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "name" and t.text in ("import", "require"):
                if t.text == "require" and self.text(i - 1) == "=" and self.text(i - 3) == "import" and not self.member(i - 3):
                    # import x = require(): TypeScript's own form is no reference of a module graph.
                    if not self.typed:
                        raise Unparsed("types")
                elif self.call(i):
                    if self.kind(i + 2) == "string" and self.kind(i + 3) in (")", ","):
                        self.add("dynamic-literal" if t.text == "import" else "require", i + 2, t.at)
                    else:
                        self.dynamic += 1
            if t.kind == "name" and t.text in ("import", "export") and not self.member(i) and self.kind(i + 1) not in (".", ":", "(") and (i == 0 or self.kind(i - 1) in _ENDS):
                i = self.declaration(i)
            i += 1


def imports(source: str, path: str = "a.ts") -> tuple[list[tuple[str, str, int]], int]:
    """([(kind, specifier, offset)], number of dynamic references), in source order."""
    reader = _Reader(source, path)
    reader.run()
    return sorted(reader.found, key=lambda f: (f[2], f[0])), reader.dynamic


@lazy_udf("parsed boolean, dynamic int, imports array<struct<kind:string,specifier:string,line:int,col:int,ordinal:int>>")
def source_imports(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Lines end as JavaScript's do; columns count UTF-16 units from 1. A null content has no imports."""
    rows = []
    for name, text in zip(path, content):
        text = text or ""
        try:
            found, dynamic = imports(text, name or "")
        except Unparsed:
            rows.append((False, 0, []))
            continue
        starts = [0, *(m.end() for m in _LINE_END.finditer(text))] if found else []
        places = []
        for i, (kind, specifier, at) in enumerate(found):
            line = bisect_right(starts, at)
            col = len(text[starts[line - 1] : at].encode("utf-16-le", "surrogatepass")) // 2 + 1
            places.append({"kind": kind, "specifier": specifier, "line": line, "col": col, "ordinal": i})
        rows.append((True, dynamic, places))
    return pd.DataFrame(rows, columns=["parsed", "dynamic", "imports"])


_JSON_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)


def plain_json(text: str) -> str:
    """JSON without comments and trailing commas."""
    bare = _JSON_TOKEN.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare, flags=re.S)


@lazy_udf("string")
def jsonc_to_json(content: pd.Series) -> pd.Series:
    return content.map(lambda t: None if t is None else plain_json(t))
