"""Named symbols of TypeScript and TSX sources, from their tokens.

A row's source is cut in tokens (nested templates, regular expressions and JSX
texts included), brackets are matched, and declarations are read where they can
stand: functions, classes, interfaces, methods of classes and object literals,
and arrow functions bound to a name. Types are stepped over, so an object type is
never taken for a body. Ranges are those of the declaration: an ``export`` and
decorators of a class belong to it, modifiers belong to a method, the binding
does not belong to an arrow function. Overloads, abstract classes, generators
and function or class expressions are no symbols, but what stands within is.
"""

from __future__ import annotations

import re

Symbol = tuple[str, str | None, int, int]
Token = tuple[str, str, int, int]  # kind (w word, n number, s text, r regular expression, p other), text, start, end

_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_PART = re.compile(
    r"(?P<w>[#@]?[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*)|(?P<n>\.?\d[\w.]*)|(?P<s>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<p>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|===?|!==?|\+\+|--|\*\*|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")
_TAG = re.compile(r"<\s*(?:>|[A-Za-z_$][\w$.:-]*)")
_LEAD_WORDS = frozenset("return typeof case do else in of instanceof new void delete throw await yield extends default".split())
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}$"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_MODIFIERS = frozenset("public private protected static abstract override readonly declare async get set accessor *".split())
_NO_NAMES = frozenset("if for while switch catch with function return do else try new typeof await".split())


class _Lexer:
    """Tokens of a source; ``${`` and ``}$`` stand around code within templates and JSX."""

    def __init__(self, source: str, jsx: bool) -> None:
        self.source, self.jsx, self.tokens = source, jsx, []
        self.parens: list[bool] = []  # whether an operand may follow the closing one
        self.operand = False  # whether the last token ends an operand

    def put(self, kind: str, start: int, end: int, text: str | None = None) -> int:
        text = self.source[start:end] if text is None else text
        if text == "(":
            last = self.tokens[-1][1] if self.tokens else ""
            self.parens.append(last in ("if", "while", "for", "with"))
        self.operand = kind in "nsr" or (kind == "w" and text not in _LEAD_WORDS) or text in ("]", "++", "--")
        if text == ")":
            self.operand = not (self.parens.pop() if self.parens else False)
        self.tokens.append((kind, text, start, end))
        return end

    def code(self, at: int, closing: bool = False) -> int:
        """Tokens up to the end, or past the brace that closes code within a template."""
        source, depth = self.source, 0
        while True:
            skipped = _SKIP.match(source, at)
            at = skipped.end() if skipped else at
            if at >= len(source):
                return at
            c = source[at]
            if c == "`":
                at = self.template(at)
            elif c == "/" and not self.operand and (m := _REGEX.match(source, at)):
                at = self.put("r", at, m.end())
            elif c == "<" and self.jsx and not self.operand and _TAG.match(source, at) and not _GENERIC.match(source, at):
                at = self.element(at)
            elif closing and c == "}" and not depth:
                self.put("p", at, at + 1, "}$")
                return at + 1
            else:
                m = _PART.match(source, at)
                depth += (c == "{") - (c == "}")
                at = self.put(m.lastgroup, at, m.end())

    def within(self, at: int) -> int:
        """Code between braces of a template or of JSX."""
        self.put("p", at, at, "${")
        return self.code(at, True)

    def template(self, at: int) -> int:
        start = at
        at += 1
        while at < len(self.source) and self.source[at] != "`":
            if self.source.startswith("${", at):
                at = self.within(at + 2)
            else:
                at += 2 if self.source[at] == "\\" else 1
        return self.put("s", start, min(at + 1, len(self.source)), "``")

    def element(self, at: int) -> int:
        """A JSX element with its children."""
        source, start = self.source, at
        at = _TAG.match(source, at).end()
        if source[at - 1] != ">":
            while at < len(source) and not source.startswith((">", "/>"), at):
                if source[at] == "{":
                    at = self.within(at + 1)
                elif source[at] in "\"'":
                    at = source.find(source[at], at + 1) + 1 or len(source)
                elif source[at] == "<":
                    at = self.element(at) if _TAG.match(source, at) and source[at - 1] == "=" else source.find(">", at) + 1 or len(source)
                else:
                    at += 1
            if source.startswith("/>", at):
                return self.put("s", start, at + 2, "<>")
            at += 1
        while at < len(source) and not source.startswith("</", at):
            if source[at] == "{":
                at = self.within(at + 1)
            elif source[at] == "<" and _TAG.match(source, at):
                at = self.element(at)
            else:
                at += 1
        return self.put("s", start, source.find(">", at) + 1 or len(source), "<>")


class _Reader:
    """Declarations of a row of tokens."""

    def __init__(self, source: str, tokens: list[Token]) -> None:
        self.source, self.tokens, self.size = source, tokens, len(tokens)
        self.text = [t[1] for t in tokens] + [""] * 4
        self.kind = [t[0] for t in tokens] + [""] * 4
        # Whether a token begins a line; what ends a template or an element began before the tokens within.
        self.fresh = [b[2] > a[3] and source.find("\n", a[3], b[2]) >= 0 for a, b in zip([("", "", 0, 0), *tokens], tokens)] + [True] * 4
        self.match, held = list(range(self.size + 4)), []
        for i, (kind, text, _, _) in enumerate(tokens):
            if kind == "p" and text in _OPEN:
                held.append(i)
            elif kind == "p" and text in _CLOSE and any(self.text[k] == _CLOSE[text] for k in held[-3:]):
                while self.text[held[-1]] != _CLOSE[text]:
                    self.match[held.pop()] = i - 1
                self.match[held.pop()] = i
        for i in held:
            self.match[i] = self.size - 1
        self.found: list[tuple[str, bool, int, int]] = []  # name, whether it is a class, first and last token

    def past(self, i: int) -> int:
        """Past the brackets that open at ``i``."""
        return self.match[i] + 1

    def angles(self, i: int) -> int:
        """Past type parameters or arguments at ``i``, if there are any."""
        if self.text[i] != "<":
            return i
        depth = 0
        while i < self.size:
            t = self.text[i]
            depth += (t == "<") - (t == ">")
            i = self.past(i) if t in _OPEN and self.kind[i] == "p" else i + 1
            if not depth:
                break
        return i

    def type(self, i: int) -> int:
        """Past a type."""
        while True:
            while self.text[i] in ("|", "&", "keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new", "-", "..."):
                if self.text[i + 1] in (")", ",", "=>", "{", ";", "=") and self.kind[i] == "w":
                    break
                i += 1
            if self.text[i] == "<":
                i = self.angles(i)
            if self.text[i] in ("{", "[", "(") and self.kind[i] == "p":
                called = self.text[i] == "("
                i = self.past(i)
                if called and self.text[i] == "=>":
                    i += 1
                    continue
            else:
                i += 1
                while self.text[i] in (".", "?.") and self.kind[i + 1] == "w":
                    i += 2
                i = self.angles(i)
            while self.text[i] == "[" and not self.fresh[i]:
                i = self.past(i)
            if self.text[i] in ("|", "&", "is", "extends") or (self.text[i] in ("?", ":") and self._conditional):
                self._conditional = self._conditional or self.text[i] == "extends"
                i += 1
                continue
            return i

    _conditional = False

    def annotation(self, i: int) -> int:
        """Past a type annotation, if there is one."""
        if self.text[i] != ":":
            return i
        self._conditional = False
        return self.type(i + 1)

    def expression(self, i: int) -> int:
        """Past an expression: up to a comma, a closing bracket, or a line that does not go on with it."""
        asked = 0
        start = i
        while i < self.size:
            t, mark = self.text[i], self.kind[i] == "p"
            if mark and (t in (",", ";") or t in _CLOSE or (t == ":" and not asked)):
                return i
            if i > start and self.fresh[i] and self._ends(i - 1) and not self._goes_on(i):
                return i
            asked += mark and t == "?"
            asked -= mark and t == ":"
            i = self.past(i) if mark and t in _OPEN else i + 1
        return i

    def _ends(self, i: int) -> bool:
        return self.kind[i] in "nsr" or (self.kind[i] == "w" and self.text[i] not in _LEAD_WORDS) or self.text[i] in (")", "]", "}", "++", "--")

    def _goes_on(self, i: int) -> bool:
        return self.text[i] in ("instanceof", "in", "as", "satisfies") if self.kind[i] == "w" else self.kind[i] == "p" and self.text[i] not in ("{", "!", "~", "++", "--", "@", "}")

    def arrow(self, i: int) -> int | None:
        """The last token of an arrow function that begins at ``i``."""
        k = i + 1 if self.text[i] == "async" and self.text[i + 1] != "=>" and not self.fresh[i + 1] else i
        k = self.angles(k)
        if self.text[k] == "(" and self.kind[k] == "p":
            k = self.annotation(self.past(k))
        elif self.kind[k] == "w":
            k += 1
        if self.text[k] != "=>" or k == i:
            return None
        return self.match[k + 1] if self.text[k + 1] == "{" else self.expression(k + 1) - 1

    def leads(self, i: int) -> bool:
        """Whether a statement can begin at ``i``."""
        if i == 0:
            return True
        last, kind = self.text[i - 1], self.kind[i - 1]
        if kind == "w":
            return last in ("export", "default", "else", "do", "declare", "abstract") or (last not in _LEAD_WORDS and self.fresh[i])
        return last in (";", "{", "}", ")") if kind == "p" else self.fresh[i]

    def exported(self, i: int) -> int:
        """The first token of the export statement that wraps a declaration at ``i``."""
        k = i - 1 if i and self.text[i - 1] == "default" else i
        return k - 1 if k and self.text[k - 1] == "export" and self.kind[k - 1] == "w" else i

    def decorated(self, i: int) -> int:
        """Past decorators at ``i``."""
        while self.kind[i] == "w" and self.text[i][0] == "@":
            i += 1
            while self.text[i] == ".":
                i += 2
            i = self.past(i) if self.text[i] == "(" else i
        return i

    def method(self, i: int) -> tuple[str, int, int, int] | None:
        """(name, first, last, body) of a method with a body whose member begins at ``i``."""
        k = self.decorated(i)
        first = k
        while self.text[k] in _MODIFIERS and (self.kind[k] == "w" or self.text[k] == "*") and self.text[k + 1] not in ("(", "<", "=", ";", ":", "?", "!", ",", "}"):
            k += 1
        if self.text[k] == "[" and self.kind[k] == "p":
            end = self.past(k)
        elif self.kind[k] in "wns" and self.kind[k] and self.text[k] != "``" and (self.text[k] not in _NO_NAMES or self.text[k + 1] == "("):
            end = k + 1
        else:
            return None
        name = self.source[self.tokens[k][2] : self.tokens[end - 1][3]]
        end = self.angles(end + 1 if self.text[end] == "?" else end)
        if self.text[end] != "(" or self.kind[end] != "p":
            return None
        body = self.annotation(self.past(end))
        return (name, first, self.match[body], body) if self.text[body] == "{" and self.kind[body] == "p" else None

    def read(self) -> list[Symbol]:
        braces: list[tuple[int, str, int]] = []  # last token and kind of what is open, and what was declared outside
        kinds: dict[int, str] = {}
        declared = -1  # depth at which names are being declared
        starts: dict[int, int] = {}  # of classes with decorators
        i = 0
        while i < self.size:
            while braces and i > braces[-1][0]:
                declared = braces.pop()[2]
            kind, text = self.kind[i], self.text[i]
            inside = braces[-1][1] if braces else "block"
            last = self.text[i - 1] if i else ""
            new_line = i > 0 and self.fresh[i]
            member = (inside == "class" and (last in ("{", ";", "}") or new_line)) or (inside == "object" and last in ("{", ","))
            if member and (m := self.method(i)):
                name, first, end, body = m
                self.found.append((name, False, first, end))
                kinds[body] = "block"
                i = max(i, first) if first > i else i
                kind, text = self.kind[i], self.text[i]
            elif kind == "w" and text[0] == "@" and self.leads(i):
                k = self.decorated(i)
                while self.text[k] in ("export", "default", "abstract"):
                    k += 1
                starts.setdefault(k, i)
            if kind == "p" and text in _OPEN:
                at = kinds.get(i) or ("object" if text == "{" and (last in ("=", "(", ",", "[", "?", "||", "&&", "??", "...", "return", ":", "=>", "default") and not (last == "=>" or (last == ":" and inside == "block" and declared < 0 and self._labelled(i)))) else "block" if text in ("{", "${") else "list")
                braces.append((self.match[i], at, declared))
                declared = -1
            elif kind == "p" and text == ";":
                declared = -1
            elif kind == "p" and text == "," and declared == len(braces):
                self.declarator(i + 1)
            elif kind == "w" and text in ("const", "let", "var") and self.text[i + 1] != "enum" and last != ".":
                declared = len(braces)
                self.declarator(i + 1)
            elif kind == "w" and text == "function" and self.kind[i + 1] == "w":
                first = i - 1 if last == "async" else i
                body = self.annotation(self.past(self.angles(i + 2)))
                if self.leads(first) and self.text[body] == "{":
                    self.found.append((self.text[i + 1], False, self.exported(first), self.match[body]))
                    kinds[body] = "block"
            elif kind == "w" and text == "class" and last != "." and (self.kind[i + 1] == "w" or self.text[i + 1] == "{") and self.text[i + 1] != ":":
                body = i + 1
                while body < self.size and not (self.text[body] == "{" and self.kind[body] == "p"):
                    body = self.angles(body) if self.text[body] == "<" else self.past(body) if self.text[body] in ("(", "[") else body + 1
                kinds[body] = "class"
                named = self.kind[i + 1] == "w" and self.text[i + 1] not in ("extends", "implements")
                if named and self.leads(i) and last != "abstract":
                    self.found.append((self.text[i + 1], True, starts.get(i, self.exported(i)), self.match[min(body, self.size - 1)]))
            elif kind == "w" and text == "interface" and self.kind[i + 1] == "w" and self.leads(i):
                body = i + 1
                while body < self.size and self.text[body] != "{":
                    body = self.angles(body) if self.text[body] == "<" else body + 1
                if body < self.size:
                    self.found.append((self.text[i + 1], False, self.exported(i), self.match[body]))
                    i = self.match[body]
            i += 1
        return self.ordered()

    def _labelled(self, i: int) -> bool:
        """Whether the brace at ``i`` follows a label of a switch."""
        return self.text[i - 2] == "default" or any(self.text[k] == "case" for k in range(max(0, i - 6), i))

    def declarator(self, i: int) -> None:
        """The arrow function that a name at ``i`` is bound to, if it is."""
        k = self.past(i) if self.text[i] in ("{", "[") else i + 1
        name = self.source[self.tokens[i][2] : self.tokens[k - 1][3]] if i < self.size else ""
        k = self.annotation(k + 1 if self.text[k] == "!" else k)
        if self.text[k] == "=" and (end := self.arrow(k + 1)) is not None:
            self.found.append((name, False, k + 1, end))

    def ordered(self) -> list[Symbol]:
        """Symbols by place, each with the nearest class around it."""
        spans = sorted(((self.tokens[a][2], -self.tokens[min(b, self.size - 1)][3], name, is_class) for name, is_class, a, b in self.found))
        out, around = [], []
        for start, end, name, is_class in spans:
            while around and around[-1][1] <= start:
                around.pop()
            out.append((name, around[-1][0] if around else None, start, -end))
            if is_class:
                around.append((name, -end))
        return out


def symbols(source: str, jsx: bool = False) -> list[Symbol]:
    """(name, enclosing class, start, end) of every symbol, in order of their places."""
    lexer = _Lexer(source, jsx)
    lexer.code(0)
    return _Reader(source, lexer.tokens).read()
