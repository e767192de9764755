"""Tokens of JavaScript and TypeScript files, JSX included, with a stack of what is open.

A file's extension chooses the language, as a compiler does: JSX in .jsx and .tsx, types in .ts, .tsx, .mts and .cts. Whether `/`
begins a regular expression and `<` an element follows from what stands before: an operator, a keyword, the bracket of a condition
or the end of a block ask for a value; a name, a literal or the end of an object is one. In .tsx `<T>(` may also list the type parameters of a
function type: it is read as an element, and again as types where the file can't be read so.

Elements, fragments, attributes, spreads and expression containers are frames of the stack; text between them is skipped, whatever
quotes are in it. What isn't closed, or not by its own kind, is an error (Unparsed), as is JSX in a file whose extension rules it out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Extensions by language, words before a value, words whose bracket holds a condition.
TYPED, ELEMENTS = (".ts", ".tsx", ".mts", ".cts"), (".jsx", ".tsx")
BEFORE_VALUE = frozenset("return typeof case in of delete void instanceof new do else yield await throw import export default extends".split())
CONDITIONS = frozenset("if while for with".split())
CLOSERS = {")": "(", "]": "[", "}": "{"}

_SPACE = re.compile(r"(?:\s|\ufeff|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_STRING = re.compile(r"'(?:\\(?:\r\n|.)|[^'\\\n\r])*'|\"(?:\\(?:\r\n|.)|[^\"\\\n\r])*\"", re.S)
_NAME = re.compile(r"[#@]?[A-Za-z_$\\\u0080-\U0010ffff][\w$\\\u0080-\U0010ffff]*|@")
_NUMBER = re.compile(r"(?:\d|\.\d)(?:[eE][+-]?\d|[\w.])*")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_SIGN = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\+\+|--|[^\s]")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_TAG = re.compile(r"(?:[A-Za-z_$\u0080-\U0010ffff][\w$\-\u0080-\U0010ffff]*)(?:\s*[.:]\s*[A-Za-z_$\u0080-\U0010ffff][\w$\-\u0080-\U0010ffff]*)*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\-\u0080-\U0010ffff]*(?:\s*:\s*[A-Za-z_$][\w$\-]*)?")
_TEXT = re.compile(r"[^{}<>]*")
_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=(?!>)|extends\s+[^\s=>/])")
_FUNCTION_TYPE = re.compile(r"<\s*[A-Za-z_$][\w$]*\s*>\s*\(")
_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "v": "\v", "f": "\f", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}


class Unparsed(ValueError):
    pass


class Token(NamedTuple):
    """kind: name, string, template, part (of a template), number, regex, element, or the sign itself."""

    kind: str
    text: str
    at: int


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def unquoted(text: str) -> str:
    """The value of a string literal."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if not code:
            return _PLAIN.get(m[4], m[4])
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else m[0]

    return _ESCAPE.sub(one, text[1:-1])


def tokens(source: str, path: str = "") -> list[Token]:
    """All tokens outside of comments, JSX text and attribute strings."""
    jsx, typed, types_at = extension(path) in ELEMENTS, extension(path) in TYPED, set()
    while True:
        lexer = _Lexer(source, jsx, typed, types_at)
        try:
            return lexer.run()
        except Unparsed:
            # Each round reads one more place as types, the first that may be.
            if lexer.doubt is None:
                raise
            types_at.add(lexer.doubt)


class _Lexer:
    def __init__(self, source: str, jsx: bool, typed: bool, types_at: set[int]):
        self.source, self.jsx, self.typed, self.types_at = source, jsx, typed, types_at
        self.at, self.out, self.doubt = 0, [], None
        #: Open frames: [kind, detail]. Kinds: ( [ { (detail: what its end is), ` (in a template), container, tag, children.
        self.open: list[list] = []
        #: Whether a value is expected, and the last word.
        self.value, self.word = True, ""

    def run(self) -> list[Token]:
        if self.source.startswith("#!"):
            self.at = (re.compile(r"[\n\r]").search(self.source) or re.compile(r"\Z").search(self.source)).start()
        while self.at < len(self.source):
            kind = self.open[-1][0] if self.open else ""
            (self.tag if kind == "tag" else self.children if kind == "children" else self.code)()
        if self.open:
            raise Unparsed(self.open[-1][0])
        return self.out

    def put(self, kind: str, text: str, value: bool) -> None:
        self.out.append(Token(kind, text, self.at))
        self.at += len(text)
        self.value, self.word = value, text if kind == "name" else ""

    def skip(self) -> None:
        if m := _SPACE.match(self.source, self.at):
            self.at = m.end()

    def code(self) -> None:
        self.skip()
        source, at = self.source, self.at
        if at >= len(source):
            return
        c = source[at]
        member = bool(self.out) and self.out[-1].kind in (".", "?.")
        if source.startswith("/*", at):
            raise Unparsed("comment")
        if c in "'\"":
            if not (m := _STRING.match(source, at)):
                raise Unparsed("string")
            self.put("string", m[0], False)
        elif c == "`" or c == "}" and self.open and self.open[-1][0] == "`":
            self.template(c)
        elif m := _NAME.match(source, at):
            self.put("name", m[0], m[0] in BEFORE_VALUE and not member)
        elif m := _NUMBER.match(source, at):
            self.put("number", m[0], False)
        elif c == "/" and self.value:
            if not (m := _REGEX.match(source, at)):
                raise Unparsed("regex")
            self.put("regex", m[0], False)
        elif c == "<" and self.value and at not in self.types_at and self.element(at):
            pass
        elif c in "([{":
            self.bracket(c, member)
        elif c in ")]}":
            self.close(c)
        else:
            sign = _SIGN.match(source, at)[0]
            # After a value ++, -- and (in TypeScript) ! belong to it.
            after = not self.value and (sign in ("++", "--") or sign == "!" and self.typed and not source.startswith("=", at + 1))
            self.put(sign, sign, not after)

    def template(self, c: str) -> None:
        if c == "}":
            self.open.pop()
        end = _TEMPLATE.match(self.source, self.at + 1).end()
        if end >= len(self.source):
            raise Unparsed("template")
        if self.source[end] == "`":
            self.put("template" if c == "`" else "part", self.source[self.at : end + 1], False)
        else:
            self.put("part", self.source[self.at : end + 2], True)
            self.open.append(["`", None])

    def bracket(self, c: str, member: bool) -> None:
        before = self.out[-1] if self.out else Token("", "", 0)
        if c == "(":
            condition = before.kind == "name" and before.text in CONDITIONS and not (len(self.out) > 1 and self.out[-2].kind in (".", "?."))
            ends = condition
        elif c == "{":
            # A block's end asks for a value, an object is one.
            ends = not self.value or before.kind in ("", "=>", ";", "{", "}", ")") or before.text in ("do", "else")
        else:
            ends = False
        self.open.append([c, ends])
        self.put(c, c, True)

    def close(self, c: str) -> None:
        if not self.open or self.open[-1][0] not in (CLOSERS[c], "container" if c == "}" else ""):
            raise Unparsed(c)
        _, ends = self.open.pop()
        self.put(c, c, bool(ends))

    def element(self, at: int) -> bool:
        """Opens an element or a fragment at a `<` before which a value is expected; False where it lists types."""
        if not self.jsx:
            if self.typed:
                return False
            raise Unparsed("element")
        if self.typed and _PARAMETERS.match(self.source, at):
            return False
        if self.typed and self.doubt is None and _FUNCTION_TYPE.match(self.source, at):
            self.doubt = at
        self.open_tag()
        return True

    def open_tag(self) -> None:
        start = self.at
        self.at += 1
        self.skip()
        if self.source.startswith(">", self.at):
            self.at += 1
            self.open.append(["children", "", start])
            return
        if not (m := _TAG.match(self.source, self.at)):
            raise Unparsed("tag")
        self.at = m.end()
        if self.typed and self.source.startswith("<", self.at):
            self.type_arguments()
        self.open.append(["tag", re.sub(r"\s", "", m[0]), start])

    def type_arguments(self) -> None:
        depth = 0
        while self.at < len(self.source):
            c = self.source[self.at]
            if m := _STRING.match(self.source, self.at):
                self.at = m.end()
                continue
            depth += (c == "<") - (c == ">" and self.source[self.at - 1] != "=")
            self.at += 1
            if not depth:
                return
        raise Unparsed("type arguments")

    def done(self, start: int) -> None:
        """An element is closed: a value, unless it stands in another."""
        if not self.open or self.open[-1][0] not in ("tag", "children"):
            self.out.append(Token("element", "", start))
            self.value, self.word = False, ""

    def container(self) -> None:
        self.open.append(["container", False])
        self.put("{", "{", True)

    def tag(self) -> None:
        self.skip()
        source, at = self.source, self.at
        c = source[at : at + 1]
        if c == "/":
            self.at += 1
            self.skip()
            if not source.startswith(">", self.at):
                raise Unparsed("tag")
            self.at += 1
            self.done(self.open.pop()[2])
        elif c == ">":
            self.at += 1
            self.open[-1][0] = "children"
        elif c == "{":
            self.container()
        elif m := _ATTRIBUTE.match(source, at):
            self.at = m.end()
            self.skip()
            if source.startswith("=", self.at):
                self.at += 1
                self.attribute()
        elif c:
            raise Unparsed("attribute")

    def attribute(self) -> None:
        self.skip()
        c = self.source[self.at : self.at + 1]
        if c and c in "'\"":
            end = self.source.find(c, self.at + 1)
            if end < 0:
                raise Unparsed("string")
            self.at = end + 1
        elif c == "{":
            self.container()
        elif c == "<":
            self.open_tag()
        else:
            raise Unparsed("attribute")

    def children(self) -> None:
        self.at = _TEXT.match(self.source, self.at).end()
        c = self.source[self.at : self.at + 1]
        if c == "{":
            self.container()
        elif c == "<":
            close = re.compile(r"<(?:\s|//[^\n]*|/\*.*?\*/)*/(?![/*])", re.S).match(self.source, self.at)
            if not close:
                self.open_tag()
                return
            self.at = close.end()
            self.skip()
            name = _TAG.match(self.source, self.at)
            self.at = name.end() if name else self.at
            self.skip()
            _, opened, start = self.open[-1]
            if not self.source.startswith(">", self.at) or opened != (re.sub(r"\s", "", name[0]) if name else ""):
                raise Unparsed("closing tag")
            self.at += 1
            self.open.pop()
            self.done(start)
        elif c:
            raise Unparsed("text")
