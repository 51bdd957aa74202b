"""The rule packs' pattern dialect: a grammar, its translation to Java's, and the literals a match can't do without.

The dialect is that of linear-time engines: no look-around, no back-references; classes with nested sets and set operations,
scoped flags, Unicode by default. Flags are resolved while parsing, so that each node means one thing; the
translation writes out what Java would read otherwise. Limits on the size of a compiled automaton aren't modelled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

# What the names of ASCII classes stand for.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t\\x20", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "\\x21-\\x7E", "lower": "a-z", "print": "\\x20-\\x7E",
    "punct": "\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E", "space": "\\t\\n\\x0B\\f\\r\\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
# Long names of general categories.
CATEGORIES = {
    "casedletter": "LC", "closepunctuation": "Pe", "connectorpunctuation": "Pc", "control": "Cc", "currencysymbol": "Sc", "dashpunctuation": "Pd", "decimalnumber": "Nd", "enclosingmark": "Me", "finalpunctuation": "Pf",
    "format": "Cf", "initialpunctuation": "Pi", "letter": "L", "letternumber": "Nl", "lineseparator": "Zl", "lowercaseletter": "Ll", "mark": "M", "mathsymbol": "Sm", "modifierletter": "Lm", "modifiersymbol": "Sk",
    "nonspacingmark": "Mn", "number": "N", "openpunctuation": "Ps", "other": "C", "otherletter": "Lo", "othernumber": "No", "otherpunctuation": "Po", "othersymbol": "So", "paragraphseparator": "Zp", "privateuse": "Co",
    "punctuation": "P", "separator": "Z", "spaceseparator": "Zs", "spacingmark": "Mc", "surrogate": "Cs", "symbol": "S", "titlecaseletter": "Lt", "unassigned": "Cn", "uppercaseletter": "Lu",
}
# Properties that are true or false, as Java names them.
BINARY = {"alphabetic": "IsAlphabetic", "ideographic": "IsIdeographic", "lowercase": "IsLowercase", "uppercase": "IsUppercase", "whitespace": "IsWhite_Space", "noncharactercodepoint": "IsNoncharacter_Code_Point", "hexdigit": "IsHex_Digit", "joincontrol": "IsJoin_Control"}
_SHORT = {v.lower(): v for v in CATEGORIES.values()}
_ASCII = {"d": "0-9", "w": "0-9A-Za-z_", "s": "\\t\\n\\x0B\\f\\r\\x20"}
_ESCAPES = {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}
_CASED = {"Lu": r"[\p{Lu}\p{Ll}\p{Lt}]", "Ll": r"[\p{Lu}\p{Ll}\p{Lt}]", "Lt": r"[\p{Lu}\p{Ll}\p{Lt}]", "IsLowercase": r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]", "IsUppercase": r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"}
MOST_DEPTH, MOST_LITERALS = 250, 64


class PatternError(ValueError):
    """A pattern isn't of the dialect."""


@dataclass(frozen=True)
class Flags:
    i: bool = True  # rules match any case
    m: bool = False
    s: bool = False
    R: bool = False
    U: bool = False
    u: bool = True
    x: bool = False


@dataclass(frozen=True)
class Node:
    """kind: lit (one character), java (a class or an assertion as Java reads it), cat, alt, rep."""

    kind: str
    text: str = ""
    parts: tuple[Node, ...] = ()
    low: int = 0
    high: int | None = None
    greedy: bool = True
    any_case: bool = True
    wide: bool = False  # java: it takes a character


def _code(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"


def _script(name: str) -> bool:
    """Whether there is such a script, as far as can be told here."""
    try:
        import regex
    except ImportError:
        return True
    try:
        regex.compile(rf"\p{{Script={name}}}")
    except regex.error:
        return False
    return True


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.at, self.depth, self.names = pattern, 0, 0, set()

    # what stands next
    def fail(self, what: str):
        raise PatternError(f"{what} at {self.at}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self) -> str:
        c = self.peek()
        if not c:
            self.fail("the pattern ends too early")
        self.at += 1
        return c

    def skip(self, f: Flags) -> None:
        """With flag x, white space and comments mean nothing."""
        while f.x and self.peek():
            if self.peek().isspace():
                self.at += 1
            elif self.peek() == "#":
                end = self.p.find("\n", self.at)
                self.at = len(self.p) if end < 0 else end + 1
            else:
                return

    # groups and branches
    def pattern(self) -> Node:
        node, _ = self.branches(Flags())
        if self.peek():
            self.fail("a group is closed that isn't open")
        return node

    def branches(self, f: Flags) -> tuple[Node, Flags]:
        """Up to the group's end. A flag set on its own holds to there, over branches."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            self.fail("groups are nested too deep")
        done, now = [], []
        while True:
            self.skip(f)
            c = self.peek()
            if c in ("", ")"):
                break
            if c == "|":
                self.at += 1
                done.append(Node("cat", parts=tuple(now)))
                now = []
            elif c in "*+?{":
                if not now or now[-1] is None:
                    self.fail("nothing to repeat")
                now[-1] = self.repeated(now[-1], f)
            elif c == "(":
                got = self.group(f)
                if isinstance(got, Flags):
                    f = got
                    now.append(None)  # flags can't be repeated
                else:
                    now.append(got)
            else:
                now.append(self.single(f))
            if now and now[-1] is None and self.peek() not in tuple("*+?{"):
                now.pop()
        self.depth -= 1
        done.append(Node("cat", parts=tuple(n for n in now if n)))
        return (done[0] if len(done) == 1 else Node("alt", parts=tuple(done))), f

    def group(self, f: Flags) -> Node | Flags:
        self.at += 1
        inner = f
        if self.peek() == "?":
            self.at += 1
            if self.peek() in tuple("=!") or self.peek(2) in ("<=", "<!"):
                self.fail("look-around isn't supported")
            if self.peek() == "<" or self.peek(2) == "P<":
                self.at += 1 if self.peek() == "<" else 2
                end = self.p.find(">", self.at)
                name = self.p[self.at : max(end, self.at)]
                if end < 0 or not name or not (name[0] == "_" or name[0].isalpha()) or not all(c in "_.[]" or c.isalnum() for c in name) or name in self.names:
                    self.fail(f"not a group's name: {name}")
                self.names.add(name)
                self.at = end + 1
            else:
                inner = self.flags(f)
                if self.take() == ")":
                    if inner == f and self.p[self.at - 2] == "?":
                        self.fail("no flags are set")
                    return inner
        node, _ = self.branches(inner)
        if self.peek() != ")":
            self.fail("a group isn't closed")
        self.at += 1
        return Node("cat", parts=(node,))

    def flags(self, f: Flags) -> Flags:
        seen, on = set(), True
        while self.peek() not in (":", ")"):
            c = self.take()
            if c == "-":
                if not on:
                    self.fail("flags are turned off twice")
                on = False
                if self.peek() in (":", ")"):
                    self.fail("no flag to turn off")
                continue
            if c not in "imsRUux":
                self.fail(f"no such flag: {c}")
            if c in seen:
                self.fail(f"flag {c} twice")
            seen.add(c)
            f = replace(f, **{c: on})
        return f

    def repeated(self, node: Node, f: Flags) -> Node:
        c = self.take()
        low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(c, (0, 0))
        if c == "{":
            end = self.p.find("}", self.at)
            counts = [x.strip() for x in self.p[self.at : max(end, self.at)].split(",")]
            if end < 0 or len(counts) > 2 or not (counts[0].isascii() and counts[0].isdigit()) or not all(x == "" or (x.isascii() and x.isdigit()) for x in counts[1:]):
                self.fail("not a count of repetitions")
            low = int(counts[0])
            high = low if len(counts) == 1 else int(counts[1]) if counts[1] else None
            if high is not None and high < low or max(low, high or 0) >= 1 << 32:
                self.fail("not a range of repetitions")
            self.at = end + 1
        self.skip(f)
        lazy = self.peek() == "?"
        if lazy:
            self.at += 1
        return Node("rep", parts=(node,), low=low, high=high, greedy=lazy == f.U)

    # one character, class or place
    def single(self, f: Flags) -> Node:
        c = self.take()
        if c == ".":
            if not f.u:
                self.fail("a dot without Unicode could cut a character")
            return Node("java", "[\\x{0}-\\x{10FFFF}]" if f.s else "[^\\r\\n]" if f.R else "[^\\n]", wide=True)
        if c == "^":
            return Node("java", "\\A" if not f.m else r"(?:\A|(?<=\n)|(?<=\r)(?!\n))" if f.R else r"(?:\A|(?<=\n))")
        if c == "$":
            return Node("java", "\\z" if not f.m else r"(?:\z|(?=\r)|(?<!\r)(?=\n))" if f.R else r"(?:\z|(?=\n))")
        if c == "[":
            return Node("java", self.set(f), any_case=f.i, wide=True)
        if c == "\\":
            return self.escape(f)
        return Node("lit", c, any_case=f.i)

    def escape(self, f: Flags) -> Node:
        c = self.peek()
        word = "\\w" if f.u else "[0-9A-Za-z_]"
        places = {"A": "\\A", "z": "\\z", "<": f"(?<!{word})(?={word})", ">": f"(?<={word})(?!{word})"}
        if c and c in places:
            self.at += 1
            return Node("java", places[c])
        if c and c in "bB":
            self.at += 1
            if c == "B":
                if not f.u:
                    self.fail("\\B without Unicode could stand inside a character")
                return Node("java", "\\B")
            halves = {"{start}": places["<"], "{end}": places[">"], "{start-half}": f"(?<!{word})", "{end-half}": f"(?!{word})"}
            for name, java in halves.items():
                if self.peek(len(name)) == name:
                    self.at += len(name)
                    return Node("java", java)
            return Node("java", "\\b" if f.u else f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")
        kind, text = self.escaped(f)
        return Node("lit", text, any_case=f.i) if kind == "char" else Node("java", text, any_case=f.i, wide=True)

    def escaped(self, f: Flags) -> tuple[str, str]:
        """After a backslash, in a class or out of it: (char, itself) or (class, Java's)."""
        c = self.take()
        if c.lower() in "dws":
            if f.u:
                return "class", "\\" + c
            if c.isupper():
                self.fail(f"\\{c} without Unicode could cut a character")
            return "class", f"[{_ASCII[c]}]"
        if c in "pP":
            return "class", self.property(c == "P", f)
        if c in "xuU":
            return "char", self.number({"x": 2, "u": 4, "U": 8}[c])
        if c in _ESCAPES:
            return "char", _ESCAPES[c]
        if c.isdigit():
            self.fail("back-references aren't supported")
        if not c.isascii() or c.isalnum() or c in "<>":
            self.fail(f"no such escape: \\{c}")
        return "char", c

    def number(self, digits: int) -> str:
        if self.peek() == "{":
            end = self.p.find("}", self.at)
            text = self.p[self.at + 1 : max(end, self.at + 1)]
            self.at = end + 1 if end >= 0 else len(self.p)
        else:
            text = self.peek(digits)
            self.at += digits
            if len(text) < digits:
                text = ""
        value = int(text, 16) if text and all(x in "0123456789abcdefABCDEF" for x in text) else 1 << 32
        if value > 0x10FFFF or 0xD800 <= value < 0xE000:
            self.fail("not a character's number")
        return chr(value)

    def property(self, negated: bool, f: Flags) -> str:
        if not f.u:
            self.fail("properties need Unicode")
        if self.peek() == "{":
            end = self.p.find("}", self.at)
            name = self.p[self.at + 1 : max(end, self.at + 1)]
            self.at = end + 1
            if end < 0 or not name:
                self.fail("not a property")
        else:
            name = self.take()
        if name[0] == "^":
            negated, name = not negated, name[1:]
        key = ""
        for sign in ("!=", "=", ":"):
            if sign in name:
                key, name = name.split(sign, 1)
                negated ^= sign == "!="
                break
        plain = lambda x: x.lower().replace("_", "").replace("-", "").replace(" ", "")
        key, short = plain(key), plain(name)
        short = short.removeprefix("is") if short not in ("is",) and short.startswith("is") else short
        if key in ("", "gc", "generalcategory") and (short in CATEGORIES or short in _SHORT):
            java = CATEGORIES.get(short) or _SHORT[short]
        elif not key and short in BINARY:
            java = BINARY[short]
        elif not key and short in ("any", "ascii", "assigned"):
            return {("any", False): "[\\x{0}-\\x{10FFFF}]", ("any", True): "[^\\x{0}-\\x{10FFFF}]", ("ascii", False): "[\\x00-\\x7F]", ("ascii", True): "[^\\x00-\\x7F]", ("assigned", False): "\\P{Cn}", ("assigned", True): "\\p{Cn}"}[short, negated]
        elif key in ("", "sc", "script") and short.isalpha() and _script(name):
            java = f"Is{name.replace(' ', '_')}"
        else:
            self.fail(f"no such property: {name}")
        if f.i and java in _CASED:
            return f"[^{_CASED[java]}]" if negated else _CASED[java]
        return f"\\{'P' if negated else 'p'}{{{java}}}"

    # classes
    def set(self, f: Flags) -> str:
        """A bracketed class after its bracket, as Java's with its brackets."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            self.fail("classes are nested too deep")
        negated = self.peek() == "^"
        if negated:
            self.at += 1
            if not f.u:
                self.fail("a negated class without Unicode could cut a character")
        self.skip(f)
        items: list[str] = []
        while self.peek() == "-":
            self.at += 1
            items.append("\\x{2D}")
            self.skip(f)
        if not items and self.peek() == "]":
            self.at += 1
            items.append("\\x{5D}")
        left: Callable[[str], str] | None = None
        while True:
            self.skip(f)
            two = self.peek(2)
            if not two:
                self.fail("a class isn't closed")
            if two[0] == "]":
                self.at += 1
                break
            if two in ("&&", "--", "~~"):
                self.at += 2
                done = self.joined(left, items)
                left = {"&&": lambda b, a=done: f"[{a}&&{b}]", "--": lambda b, a=done: f"[{a}&&[^{b}]]", "~~": lambda b, a=done: f"[[{a}&&[^{b}]][{b}&&[^{a}]]]"}[two]
                items = []
            elif two[0] == "[":
                items.append(self.nested(f))
            else:
                items.append(self.range(f))
        self.depth -= 1
        whole = self.joined(left, items)
        return f"[^{whole}]" if negated else whole

    @staticmethod
    def joined(left: Callable[[str], str] | None, items: list[str]) -> str:
        own = f"[{''.join(items)}]" if items else "[^\\x{0}-\\x{10FFFF}]"
        return left(own) if left else own

    def nested(self, f: Flags) -> str:
        if self.peek(2) == "[:":
            end = self.p.find(":]", self.at)
            name = self.p[self.at + 2 : max(end, self.at + 2)]
            if end >= 0 and name.removeprefix("^") in POSIX:
                self.at = end + 2
                return f"[^{POSIX[name[1:]]}]" if name[0] == "^" else f"[{POSIX[name]}]"
        self.at += 1
        return self.set(f)

    def member(self, f: Flags) -> tuple[str, str]:
        c = self.take()
        if c != "\\":
            return "char", c
        return self.escaped(f)

    def range(self, f: Flags) -> str:
        kind, low = self.member(f)
        self.skip(f)
        if self.peek() != "-" or self.peek(2) in ("-]", "--") or kind == "class" and self.peek(2) == "-]":
            return _code(low) if kind == "char" else low
        self.at += 1
        self.skip(f)
        if self.peek() == "]":  # a dash at the end, after spaces
            return (_code(low) if kind == "char" else low) + "\\x{2D}"
        other, high = self.member(f)
        if kind == "class" or other == "class":
            self.fail("a range needs characters at both ends")
        if ord(high) < ord(low):
            self.fail("a range goes backwards")
        return f"{_code(low)}-{_code(high)}"


def parse(pattern: str) -> Node:
    """The pattern's tree; a PatternError says where it leaves the dialect."""
    return _Parser(pattern).pattern()


def to_java(node: Node) -> str:
    """The tree for Java's engine with the flags iuU. Groups capture nothing, as only whole matches are used."""
    if node.kind in ("lit", "java"):
        text = _code(node.text) if node.kind == "lit" else node.text
        return text if node.any_case or not (node.kind == "lit" or node.wide) else f"(?-iu:{text})"
    if node.kind == "cat":
        return "".join(f"(?:{to_java(p)})" if p.kind == "alt" else to_java(p) for p in node.parts)
    if node.kind == "alt":
        return "|".join(map(to_java, node.parts))
    inner = node.parts[0]
    text = to_java(inner)
    if inner.kind not in ("lit", "java") or not (inner.any_case and (inner.kind == "lit" or inner.wide)):
        text = f"(?:{text})"
    signs = {(0, None): "*", (1, None): "+", (0, 1): "?"}
    sign = signs.get((node.low, node.high)) or f"{{{node.low}{'' if node.high == node.low else ',' + ('' if node.high is None else str(node.high))}}}"
    return text + sign + ("" if node.greedy else "?")


def literals(node: Node) -> frozenset[str] | None:
    """Texts in lower case of which every match has one at least (looking only at ASCII); None if nothing is sure.

    Of several such sets that of the longest shortest text is taken: it picks the fewest texts.
    """
    worth = lambda s: (min(map(len, s)), -len(s))
    if node.kind == "lit":
        return frozenset([node.text.lower()]) if node.text.isascii() else None
    if node.kind == "java":
        return None
    if node.kind == "rep":
        return literals(node.parts[0]) if node.low else None
    if node.kind == "alt":
        found = [literals(p) for p in node.parts]
        if None in found or sum(map(len, found)) > MOST_LITERALS:
            return None
        return frozenset().union(*found)
    best: list[frozenset[str]] = []
    run = ""
    for p in _flat(node):
        own = literals(p)
        if p.kind == "lit" and own:
            run += next(iter(own))
            continue
        best += [frozenset([run])] if run else []
        run = ""
        best += [own] if own else []
    best += [frozenset([run])] if run else []
    return max(best, key=worth) if best else None


def _flat(node: Node):
    for p in node.parts:
        if p.kind == "cat":
            yield from _flat(p)
        elif p.kind == "java" and not p.wide:
            continue  # a place takes no character
        else:
            yield p
