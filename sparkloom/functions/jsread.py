"""32, 35: facts of one JavaScript or TypeScript file: tokens with their state, then declarations by descent into classes."""

from __future__ import annotations

import re

NAME = r"[A-Za-z_$][\w$]*"
TOKEN = re.compile(rf"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<name>\#?{NAME}(?:\s*\??\.\s*\#?{NAME})*)|(?P<number>\.?\d[\w.]*)|(?P<mark>=>|\.\.\.|.)""", re.S)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a value begins, so that a slash opens a regular expression and `<` an element.
BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "async", "super", "import", "require", "constructor", "with", "of", "in", "case", "throw", "else"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "async", "declare", "get", "set", "accessor"}
VERBS = {"get", "post", "put", "patch", "delete"}


def scan(content: str, elements: bool) -> list[tuple[str, str, int]]:
    """Tokens (kind, text, line) without comments. Code inside templates and elements is scanned as code, their texts aren't.

    What is open is a stack: code (with its depth of braces and where its tokens begin), a template, an element's tag, an element's
    children. A template and an element are a token `text` where they begin."""
    out, open_, i, n, line = [], [["code", 0, 0]], 0, len(content), 1

    def value() -> bool:
        """Whether what stands before is a value, after which `/` divides and `<` compares."""
        if len(out) == open_[-1][2]:
            return False
        kind, text, _ = out[-1]
        return kind in ("text", "number", "regex") or (text in ")]}" if kind == "mark" else kind == "name" and text not in BEFORE_VALUE)

    while i < n:
        mode, begin = open_[-1], i
        if mode[0] == "template":
            i = next((m.end() for m in [re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S).match(content, i)] if m), i)
            if content.startswith("${", i):
                open_.append(["code", 0, len(out)])
                i += 2
            else:
                open_.pop()
                i += 1
        elif mode[0] == "tag":
            m = re.compile(r"""(?:"[^"]*"|'[^']*'|=>|[^>{/"']|/(?!>))*""", re.S).match(content, i)
            i = m.end()
            if content.startswith("/>", i):
                open_.pop()
                i += 2
            elif content.startswith("{", i):
                open_.append(["code", 0, len(out)])
                i += 1
            else:
                mode[0] = "children"
                i += 1
        elif mode[0] == "children":
            i = next((k for k in range(i, n) if content[k] in "<{"), n)
            if content.startswith("</", i):
                i = content.find(">", i) + 1 or n
                open_.pop()
            elif i < n:
                open_.append(["code", 0, len(out)] if content[i] == "{" else ["tag"])
                i += 1
        else:
            c = content[i]
            if c == "`":
                out.append(("text", "`", line))
                open_.append(["template"])
                i += 1
            elif c == "/" and not value() and (m := REGEX.match(content, i)):
                out.append(("regex", m[0], line))
                i = m.end()
            elif c == "<" and elements and not value() and re.compile(r"<(?:[A-Za-z]|>)").match(content, i):
                out.append(("text", "<", line))
                open_.append(["tag"])
                i += 1
            elif c == "}" and not mode[1] and len(open_) > 1:
                open_.pop()
                i += 1
            else:
                m = TOKEN.match(content, i)
                i = m.end()
                if m.lastgroup != "skip":
                    mode[1] += (c == "{") - (c == "}")
                    out.append((m.lastgroup, re.sub(r"\s|\?(?=\.)", "", m[0]) if m.lastgroup == "name" else m[0], line))
        line += content.count("\n", begin, i)
    return out


class Reader:
    """Facts (line, kind, name, form, end, exported, scope, specifiers) of one file's tokens."""

    def __init__(self, tokens: list[tuple[str, str, int]]):
        self.t, self.out, self.close = tokens, [], {}
        held: list[int] = []
        for k, (kind, text, _) in enumerate(tokens):
            if kind == "mark" and text in "([{":
                held.append(k)
            elif kind == "mark" and text in ")]}" and held:
                self.close[held.pop()] = k

    def text(self, k: int) -> str:
        return self.t[k][1] if 0 <= k < len(self.t) else ""

    def kind(self, k: int) -> str:
        return self.t[k][0] if 0 <= k < len(self.t) else ""

    def line(self, k: int) -> int:
        return self.t[min(max(k, 0), len(self.t) - 1)][2]

    def after(self, k: int) -> int:
        """The place after the bracket that closes the one at k."""
        return self.close.get(k, len(self.t) - 1) + 1

    def add(self, k: int, kind: str, name: str, form: str | None = None, end: int | None = None, exported: bool = False, scope: str = "", names: list[str] | None = None) -> None:
        self.out.append((self.line(k), kind, name, form, self.line(k if end is None else end), exported, scope, names or []))

    def find(self, k: int, *marks: str) -> int:
        """The first of the marks from k on, brackets being passed over; the end of the tokens where there is none."""
        while k < len(self.t):
            if self.kind(k) == "mark" and self.text(k) in marks:
                return k
            k = self.after(k) if self.kind(k) == "mark" and self.text(k) in "([{" else k + 1
        return k

    def ending(self, k: int) -> int:
        """The last token of the statement that k is in: before a semicolon, or where a line ends and the next begins anew."""
        while k + 1 < len(self.t) and self.text(k) != ";":
            if self.kind(k) == "mark" and self.text(k) in "([{":
                k = self.after(k) - 1
            here, ahead = self.text(k), self.text(k + 1)
            new = self.line(k + 1) > self.line(k) and not (self.kind(k) == "mark" and here not in ")]}") and not (self.kind(k + 1) == "mark" and ahead not in "{[@#(") and here not in ("extends", "=")
            if new or ahead in ("}", ")"):
                return k
            k += 1
        return min(k, len(self.t) - 1)

    def program(self) -> list[tuple]:
        k = 0
        while k < len(self.t):
            k = self.statement(k, False)
        return self.out

    def statement(self, k: int, exported: bool) -> int:
        word = self.text(k) if self.kind(k) == "name" else ""
        begin = k
        if word == "import" and self.text(k + 1) not in ("(", "."):
            return self.import_(k)
        if word == "export":
            return self.export(k)
        while word in ("async", "abstract", "declare", "default") and self.kind(k + 1) == "name" and self.text(k + 1) in ("function", "class", "async", "abstract", "const", "let", "var", "enum", "interface", "type"):
            k += 1
            word = self.text(k)
        if word == "const" and self.text(k + 1) == "enum":
            k, word = k + 1, "enum"
        if word == "function" and (name := self.text(k + 1 + (self.text(k + 1) == "*"))) and re.fullmatch(NAME, name):
            return self.function(begin, k + 1 + (self.text(k + 1) == "*"), exported)
        if word == "class" and re.fullmatch(NAME, self.text(k + 1)) and self.text(k + 1) not in ("extends", "implements"):
            return self.class_(begin, k + 1, exported)
        if word in ("interface", "type", "enum") and re.fullmatch(NAME, self.text(k + 1)) and self.text(k + 2) in ("{", "=", "<", "extends"):
            end = self.after(self.find(k + 2, "{")) - 1 if word != "type" else self.ending(k + 2)
            self.add(begin, word, self.text(k + 1), end=end, exported=exported)
            return end + 1
        if word in ("const", "let", "var"):
            return self.variables(begin, k, exported)
        end = self.after(k) - 1 if self.text(k) == "{" else self.ending(k)
        self.uses(k, end + 1, "")
        return end + 1

    def import_(self, k: int) -> int:
        if self.kind(k + 1) == "name" and self.text(k + 2) == "=" and self.text(k + 3) == "require" and self.kind(k + 5) == "text":
            self.add(k, "import", self.text(k + 5)[1:-1], "commonjs", k + 6, names=[self.text(k + 1)])
            return k + 7
        end = next((j for j in range(k + 1, len(self.t)) if self.kind(j) == "text" or self.text(j) == ";"), None)
        if end is None or self.kind(end) != "text":
            return k + 1
        self.add(k, "import", self.text(end)[1:-1], "static", end, names=self.names(k + 1 + (self.text(k + 1) == "type" and self.text(k + 2) not in ("from", ",")), end))
        return end + 1

    def names(self, lo: int, hi: int) -> list[str]:
        """The names that a clause binds: of each part between commas and braces the last, `type` and `from` aside."""
        out, part = [], []
        for k in range(lo, hi + 1):
            word = self.text(k)
            if k == hi or self.kind(k) == "mark" and word in ",{}":
                own = [w for i, w in enumerate(part) if not (w == "type" and i == 0 and len(part) > 1) and w not in ("as", "from", "*")]
                out += own[-1:]
                part = []
            else:
                part.append(word)
        return out

    def export(self, k: int) -> int:
        first = k + 1 + (self.text(k + 1) == "type" and self.text(k + 2) in ("{", "*"))
        if self.text(first) in ("{", "*"):
            shut = self.close.get(first, first)
            for name in self.names(first + 1, shut) if self.text(first) == "{" else []:
                self.add(k, "export", name, "unknown")
            end = first + 1 if self.text(first) == "*" else shut + 1
            while self.kind(end) == "name" and self.text(end) != "from":
                end += 1
            if self.text(end) == "from" and self.kind(end + 1) == "text":
                self.add(k, "reexport", self.text(end + 1)[1:-1])
                return end + 2
            return end
        seen = len(self.out)
        default = self.text(k + 1) == "default"
        end = self.statement(k + 1 + default, True)
        for line, kind, name, form, _, exported, scope, _names in self.out[seen:]:
            if exported and not scope:
                told = {"interface": kind, "type": kind, "class": kind, "enum": "unknown"}.get(kind, "variable" if form == "variable" else "function")
                self.out.append((line, "export", name, told, line, False, "", []))
        return end

    def named(self, name: str) -> str:
        return "hook" if re.match("use[A-Z]", name) else "component" if name[:1].isupper() else "function"

    def function(self, begin: int, k: int, exported: bool) -> int:
        name = self.text(k)
        shut = self.after(self.find(k + 1, "("))
        body = self.find(shut, "{", ";")
        end = self.after(body) - 1 if self.text(body) == "{" else min(body, len(self.t) - 1)
        self.add(begin, self.named(name), name, end=end, exported=exported)
        self.uses(k + 1, end + 1, name)
        return end + 1

    def variables(self, begin: int, k: int, exported: bool) -> int:
        end = self.ending(k + 1)
        at = k + 1
        while at <= end:
            stop = min(self.find(at, ",", ";"), end + 1)
            name = self.text(at)
            if self.kind(at) == "name" and re.fullmatch(NAME, name):
                eq = self.find(at + 1, "=", ",", ";")
                function = self.text(eq) == "=" and self.arrow(eq + 1)
                called = self.text(eq + 1) == "require" and self.kind(eq + 3) == "text"
                if not called or exported:
                    self.add(begin if at == k + 1 else at, self.named(name) if function else "variable", name, None if function else "variable", min(stop, end), exported)
                self.uses(at + 1, stop, name if function else "", name if called else None)
            else:
                self.uses(at, stop, "")
            at = stop + 1
        return end + 1

    def arrow(self, k: int) -> bool:
        k += self.text(k) == "async"
        if self.text(k) == "function":
            return True
        if self.text(k) == "<":
            k = self.find(k, ">") + 1
        if self.text(k) == "(":
            k = self.after(k)
            if self.text(k) == ":":
                k = min(self.find(k, "=>", ";", "{"), len(self.t))
            return self.text(k) == "=>"
        return self.kind(k) == "name" and self.text(k + 1) == "=>"

    def class_(self, begin: int, k: int, exported: bool) -> int:
        name, body = self.text(k), self.find(k + 1, "{")
        end = self.after(body) - 1
        self.add(begin, "class", name, end=end, exported=exported)
        for j in range(k + 1, min(body, len(self.t))):
            if self.text(j) in ("extends", "implements") and self.kind(j + 1) == "name":
                self.add(j, "inheritance", self.text(j + 1), scope=name)
        j = body + 1
        while j < end:
            at = j
            while self.kind(j) == "name" and self.text(j) in MODIFIERS and self.kind(j + 1) == "name" or self.text(j) == "*":
                j += 1
            if self.text(j) == "@":
                j += 2 if self.text(j + 2) != "(" else self.after(j + 2) - j
                continue
            generic = j + 1
            if self.text(generic) == "<":
                generic = self.find(generic, ">") + 1
            if self.kind(j) == "name" and self.text(generic) == "(":
                shut = self.after(generic)
                block = self.find(shut, "{", ";", "}")
                last = self.after(block) - 1 if self.text(block) == "{" else min(block, end - 1)
                self.add(at, "method", self.text(j), end=last, scope=name)
                self.uses(generic, last + 1, f"{name}.{self.text(j)}")
                j = last + 1
            else:
                last = min(max(self.ending(j), j), end - 1)
                self.uses(j, last + 1, name)
                j = last + 1
        return end + 1

    def uses(self, lo: int, hi: int, scope: str, bound: str | None = None) -> None:
        """Calls, imports by expression and routes from lo on, below hi."""
        for k in range(lo, min(hi, len(self.t))):
            if self.kind(k) != "name" or self.text(k + 1) != "(":
                continue
            name, first = self.text(k), self.text(k + 2)
            literal = self.kind(k + 2) == "text" and len(first) > 1
            if name in ("require", "import") and literal:
                self.add(k, "import", first[1:-1], "commonjs" if name == "require" else "dynamic", scope=scope, names=[bound] if bound and name == "require" else [])
            elif name.split(".")[0] not in NOT_CALLS and self.text(k - 1) != "function" and self.text(self.after(k + 1)) != "{":
                self.add(k, "call", name, scope=scope)
                if literal and first[1:2] == "/" and name.split(".")[-1] in VERBS and "." in name:
                    self.add(k, "route", f"{name.split('.')[-1].upper()} {first[1:-1]}", scope=scope)


def facts(path: str, content: str) -> list[tuple]:
    """(path, line, kind, name, signature, form, end, exported, scope, specifiers)."""
    lines = content.split("\n")
    elements = not re.search(r"\.[cm]?ts$", path)
    found = Reader(scan(content, elements)).program()
    return [(path, r[0], r[1], r[2], lines[r[0] - 1].strip(), *r[3:]) for r in found]
