"""The surface language's text: tokens, grammar and syntax trees.

Infix operators have one precedence and group to the left; prefix operators bind tighter. Operators
are the longest run of symbol characters, so ``x=-1`` has the operator ``=-`` and is an error. Trees
are tuples whose first item says what they are.
"""

from __future__ import annotations

import re
from typing import Any

SYMBOLS = r"#;:_'.|!$%&/^=*\-+<>?@~\\"
SPACE = re.compile(r"(?:\s+|//[^\n]*)*")
NUMBER = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"')
NAME = re.compile(r"\$[a-z][a-z0-9_]*|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?")
OPERATOR = re.compile(rf"(?!//)(?:[{SYMBOLS}]+|[A-Z][A-Z0-9]*[{SYMBOLS}][A-Z0-9{SYMBOLS}]*)")
WORDS = frozenset("let in for filter fold do save print import true false".split())
Tree = tuple[Any, ...]


class LanguageError(Exception):
    """An error of a program, with a code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Parser:
    """Reads a text from left to right; what may come next decides which tokens are looked for."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.skip()

    def skip(self) -> None:
        self.at = SPACE.match(self.text, self.at).end()  # type: ignore[union-attr]

    def fail(self, wanted: str) -> LanguageError:
        line = self.text.count("\n", 0, self.at) + 1
        start = self.text.rfind("\n", 0, self.at) + 1
        end = self.text.find("\n", start)
        shown = self.text[start : end if end >= 0 else len(self.text)]
        return LanguageError("E_PARSE", f"line {line}, column {self.at - start + 1}: expected {wanted}\n{shown}\n{' ' * (self.at - start)}^")

    def take(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        self.skip()
        return m[0]

    def mark(self, text: str) -> bool:
        """Take a bracket or comma."""
        if self.text.startswith(text, self.at):
            self.at += len(text)
            self.skip()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.mark(text):
            raise self.fail(repr(text))

    def look(self, pattern: re.Pattern) -> str:
        m = pattern.match(self.text, self.at)
        return m[0] if m else ""

    def word(self, text: str) -> bool:
        if self.look(NAME) == text:
            self.take(NAME)
            return True
        return False

    def operator(self, text: str) -> None:
        if self.look(OPERATOR) != text:
            raise self.fail(repr(text))
        self.take(OPERATOR)

    def name(self) -> str:
        found = self.look(NAME)
        if not found or found in WORDS:
            raise self.fail("a name")
        self.take(NAME)
        return found

    def string(self) -> str:
        found = self.take(STRING)
        if found is None:
            raise self.fail("a string")
        return found[1:-1]

    def starts_operator(self) -> str:
        """The operator here, if it isn't a name: upper-case letters need a symbol after them, and a program variable begins with a dollar."""
        return "" if self.look(NAME).startswith("$") else self.look(OPERATOR)

    def program(self) -> list[Tree]:
        out = []
        while self.at < len(self.text):
            out.append(self.command())
        return out

    def command(self) -> Tree:
        if self.word("import"):
            return ("import", self.string())
        if self.word("print"):
            return ("print", self.string(), self.expression())
        if self.word("save"):
            return ("save", self.string(), self.expression())
        self.word("let")
        symbol = self.starts_operator()
        name = self.take(OPERATOR) if symbol else self.name()
        formal = None
        if self.mark("("):
            formal = [self.name()]
            while self.mark(","):
                formal.append(self.name())
            self.need(")")
        self.operator("=")
        return ("let", name, formal, self.expression())

    def expression(self) -> Tree:
        if self.word("let"):
            name = self.name()
            self.operator("=")
            value = self.expression()
            if not self.word("in"):
                raise self.fail("'in'")
            return ("in", name, value, self.expression())
        for kind in ("for", "filter"):
            if self.word(kind):
                name = self.name()
                if not self.word("in"):
                    raise self.fail("'in'")
                over = self.expression()
                if not self.word("do"):
                    raise self.fail("'do'")
                return (kind, name, over, self.expression())
        if self.word("fold"):
            op = self.take(OPERATOR) or self.name()
            first = self.expression()
            second = self.expression() if self.begins() else None
            return ("fold", op, None if second is None else first, first if second is None else second)
        left = self.prefixed()
        while (op := self.starts_operator()) not in ("", ":"):  # a colon alone belongs to a slice
            self.take(OPERATOR)
            left = ("call", op, [left, self.prefixed()])
        return left

    def begins(self) -> bool:
        """Whether an expression goes on here, rather than a command or a closing mark."""
        if self.look(STRING) or self.look(NUMBER) or self.text[self.at : self.at + 1] in ("[", "("):
            return True
        name = self.look(NAME)
        if not name:
            return False
        if name in WORDS:
            return name in ("true", "false", "let", "for", "filter", "fold") and not (name == "let" and self.defines(self.at + 3))
        return not self.defines(self.at)

    def defines(self, at: int) -> bool:
        """Whether a definition stands at a place: a name, perhaps arguments, and ``=``."""
        at = SPACE.match(self.text, at).end()  # type: ignore[union-attr]
        m = re.compile(r"[^\s()=\[\],]+\s*(?:\([^()]*\))?\s*=").match(self.text, at)
        return bool(m) and OPERATOR.match(self.text, m.end() - 1)[0] == "="  # type: ignore[index]

    def prefixed(self) -> Tree:
        if self.look(NUMBER):
            return self.postfixed()
        op = self.starts_operator()
        if op:
            self.take(OPERATOR)
            if self.text.startswith("(", self.at):
                args = self.arguments()
                return self.accessed(("call", op, args))
            return ("call", op, [self.prefixed()])
        return self.postfixed()

    def arguments(self) -> list[Tree]:
        self.need("(")
        out = [self.expression()]
        while self.mark(","):
            out.append(self.expression())
        self.need(")")
        return out

    def postfixed(self) -> Tree:
        if self.text.startswith('"', self.at):
            return self.accessed(("constant", self.string()))
        if self.look(NUMBER):
            return self.accessed(("constant", float(self.take(NUMBER) or 0)))
        if self.mark("("):
            inner = self.expression()
            self.need(")")
            return self.accessed(inner)
        if self.mark("["):
            items = []
            if not self.mark("]"):
                items.append(self.expression())
                while self.mark(","):
                    items.append(self.expression())
                self.need("]")
            return self.accessed(("array", items))
        if self.word("true"):
            return self.accessed(("constant", True))
        if self.word("false"):
            return self.accessed(("constant", False))
        if self.look(NAME) in ("let", "for", "filter", "fold"):
            return self.expression()
        name = self.name()
        return self.accessed(("call", name, self.arguments() if self.text.startswith("(", self.at) else []))

    def accessed(self, tree: Tree) -> Tree:
        while self.mark("["):
            low = None if self.look(OPERATOR).startswith(":") else self.expression()
            if low is not None and self.mark("]"):
                tree = ("call", "index", [tree, low])
                continue
            if not self.mark(":"):
                raise self.fail("':' or ']'")
            high = None if self.mark("]") else self.expression()
            if high is not None:
                self.need("]")
            tree = ("slice", tree, low, high)
        return tree


def shown(tree: Tree) -> str:
    """The text of a tree, which reads as the same tree."""
    kind = tree[0]
    if kind == "constant":
        v = tree[1]
        return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)
    if kind == "call":
        return f"{tree[1]}({', '.join(map(shown, tree[2]))})" if tree[2] else tree[1]
    if kind == "array":
        return f"[{', '.join(map(shown, tree[1]))}]"
    if kind == "slice":
        return f"{shown(tree[1])}[{shown(tree[2]) if tree[2] else ''} : {shown(tree[3]) if tree[3] else ''}]"
    if kind in ("for", "filter"):
        return f"({kind} {tree[1]} in {shown(tree[2])} do {shown(tree[3])})"
    if kind == "fold":
        return f"(fold {tree[1]} {shown(tree[2]) + ' ' if tree[2] else ''}{shown(tree[3])})"
    if kind == "in":
        return f"(let {tree[1]} = {shown(tree[2])} in {shown(tree[3])})"
    if kind in ("print", "save"):
        return f'{kind} "{tree[1]}" {shown(tree[2])}'
    if kind == "import":
        return f'import "{tree[1]}"'
    return f"let {tree[1]}{'(' + ', '.join(tree[2]) + ')' if tree[2] else ''} = {shown(tree[3])}"


def parse_program(text: str) -> list[Tree]:
    """The commands of a program."""
    return Parser(text).program()


def parse_expression(text: str) -> Tree:
    """One expression."""
    p = Parser(text)
    tree = p.expression()
    if p.at < len(text):
        raise p.fail("the end")
    return tree
