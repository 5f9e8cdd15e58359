r"""Rule patterns, which follow a syntax without look-around and back references, as Java has to be told them.

Both syntaxes share most signs and give some of them other meanings: [[:digit:]], a--b
inside brackets, a++ or \h. So a pattern is read sign by sign and written anew. Only whether
a pattern occurs matters here, so groups capture nothing and laziness is left out.
"""

from __future__ import annotations

import re
import string

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

# ASCII classes by name, and general categories by their long names.
ASCII = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "punct": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "cntrl": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
CLASSES = {"d": r"[\p{Nd}]", "s": r"[\p{IsWhite_Space}]", "w": r"[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}]"}
BYTES = {"d": "[0-9]", "s": r"[\t\n\x0B\f\r ]", "w": "[0-9A-Za-z_]"}
CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
ANY = r"[\x{0}-\x{10FFFF}]"
#: Repetitions of one sign or group at most, in all: what repeats more often takes more room than a pattern may.
MOST = 1000


class Invalid(ValueError):
    """No pattern."""


def _sign(c: int) -> str:
    return f"\\x{{{c:X}}}"


def _none(x: str) -> str:
    """One character that is not in a class."""
    return f"(?:(?!{x}){ANY})"


class _Reader:
    def __init__(self, spark: SparkSession, pattern: str):
        self.spark, self.text, self.at = spark, pattern, 0
        self.flags, self.names = frozenset("u"), set()

    # signs
    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise Invalid("ends early")
        self.at += 1
        return self.text[self.at - 1]

    def skip(self, sign: str) -> bool:
        if self.text.startswith(sign, self.at):
            self.at += len(sign)
            return True
        return False

    def upto(self, sign: str) -> str:
        end = self.text.find(sign, self.at)
        if end < 0:
            raise Invalid(f"no {sign}")
        out, self.at = self.text[self.at : end], end + len(sign)
        return out

    def blanks(self) -> None:
        """With the flag x, white space and comments are nothing."""
        while "x" in self.flags and self.peek() and (self.peek().isspace() or self.peek() == "#"):
            if self.take() == "#":
                while self.peek() and self.take() != "\n":
                    pass

    # expressions
    def whole(self) -> str:
        out = self.branches()
        if self.at < len(self.text):
            raise Invalid("a ) too many")
        return out

    def branches(self) -> str:
        flags, out = self.flags, [self.sequence()]
        while self.skip("|"):
            out.append(self.sequence())
        self.flags = flags  # flags set in a group hold up to its end
        return "|".join(out)

    def sequence(self) -> str:
        out: list[str] = []
        while True:
            self.blanks()
            c = self.peek()
            if c in ("", "|", ")"):
                return "".join(out)
            if c in "*+?{":
                if not out or out[-1] == "":  # nothing, or flags, can't be repeated
                    raise Invalid("nothing to repeat")
                out[-1] = f"(?:{out[-1]}){self.times()}"
            else:
                out.append(self.atom())

    def times(self) -> str:
        c = self.take()
        if c == "{":
            found = re.fullmatch(r"\s*([0-9]+)\s*(,\s*([0-9]*)\s*)?", self.upto("}"), re.ASCII)
            if not found or found[3] and int(found[3]) < int(found[1]) or int(found[3] or found[1]) > MOST:
                raise Invalid("no count")
            c = f"{{{found[1]}{',' if found[2] else ''}{found[3] or ''}}}"
        self.blanks()
        self.skip("?")
        return c

    def atom(self) -> str:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.folded(self.brackets())
        if c == ".":
            return ANY if "s" in self.flags else r"[^\r\n]" if "R" in self.flags else r"[^\n]"
        if c == "^":
            return r"\A" if "m" not in self.flags else r"(?:\A|(?<=\n)|(?<=\r)(?!\n))" if "R" in self.flags else r"(?<![^\n])"
        if c == "$":
            return r"\z" if "m" not in self.flags else r"(?:\z|(?=\r)|(?<!\r)(?=\n))" if "R" in self.flags else r"(?![^\n])"
        if c != "\\":
            return self.folded(_sign(ord(c)))
        return self.bound() or self.folded(self.escape())

    def folded(self, x: str) -> str:
        return x if "i" not in self.flags else f"(?iu:{x})" if "u" in self.flags else f"(?i:{x})"

    def group(self) -> str:
        if not self.skip("?"):
            inner = self.branches()
        elif self.peek(2) in ("P<", "<=", "<!") or self.peek() == "<":
            self.skip("P")
            self.skip("<")
            name = self.upto(">")
            if not re.fullmatch(r"[^\W\d][\w.\[\]]*", name) or name in self.names:
                raise Invalid("no name")
            self.names.add(name)
            inner = self.branches()
        else:
            flags, on, seen = set(self.flags), True, ""
            while (c := self.take()) not in ":)":
                if c == "-" and on:
                    on = False
                elif c in "imsUuxR" and c not in seen:
                    seen += c
                    (flags.add if on else flags.discard)(c)
                else:
                    raise Invalid("no flag")
            if not on and self.text[self.at - 2] == "-" or (c == ")" and not seen):
                raise Invalid("no flag")
            if c == ")":
                self.flags = frozenset(flags)
                return ""
            before, self.flags = self.flags, frozenset(flags)
            inner = self.branches()
            self.flags = before
        if not self.skip(")"):
            raise Invalid("no )")
        return f"(?:{inner})"

    def bound(self) -> str | None:
        """An escape that stands between characters."""
        w = (CLASSES if "u" in self.flags else BYTES)["w"]
        starts, ends = f"(?<!{w})(?={w})", f"(?<={w})(?!{w})"
        for sign, x in ((r"b{start}", starts), (r"b{end}", ends), (r"b{start-half}", f"(?<!{w})"), (r"b{end-half}", f"(?!{w})"), ("b", f"(?:{starts}|{ends})"), ("B", f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"), ("<", starts), (">", ends), ("A", r"\A"), ("z", r"\z")):
            if self.skip(sign):
                if sign == "b" and self.peek() == "{":
                    raise Invalid("no word boundary")
                return f"(?:{x})"
        return None

    def escape(self) -> str:
        """An escape that stands for one character, or one of a class."""
        c = self.take()
        if c in "dswDSW":
            x = (CLASSES if "u" in self.flags else BYTES)[c.lower()]
            return x if c.islower() else _none(x)
        if c in "pP":
            return self.property(c == "P")
        return _sign(self.code(c))

    def code(self, c: str) -> int:
        """The character that an escape stands for."""
        if c in CONTROLS:
            return CONTROLS[c]
        if c in "xuU":
            digits = self.upto("}") if self.skip("{") else "".join(self.take() for _ in range({"x": 2, "u": 4, "U": 8}[c]))
            if not re.fullmatch("[0-9A-Fa-f]+", digits) or (n := int(digits, 16)) > 0x10FFFF or 0xD800 <= n < 0xE000:
                raise Invalid("no character")
            return n
        if not c.isascii() or c.isalnum() or c in "<>":
            raise Invalid(f"no escape \\{c}")
        return ord(c)

    def property(self, negated: bool) -> str:
        name = self.upto("}") if self.skip("{") else self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        kind, sign, value = name.partition("!=") if "!=" in name else name.partition("=") if "=" in name else name.partition(":")
        negated ^= sign == "!="
        bare = re.sub(r"[\s_-]", "", value or kind).lower().removeprefix("is" if not value else "")
        kind = re.sub(r"[\s_-]", "", kind).lower() if value else ""
        some = {"any": ANY, "ascii": r"[\x00-\x7F]", "assigned": r"\P{Cn}"}
        tries = [some[bare]] if bare in some and not kind else []
        short = {x.lower(): x for x in CATEGORIES.values()} | {"lc": "LC"}
        category = CATEGORIES.get(bare) or short.get(bare)
        if category and kind in ("", "gc", "generalcategory"):
            tries.append(r"[\p{Lu}\p{Ll}\p{Lt}]" if category == "LC" else f"\\p{{{category}}}")
        spelt = re.sub(r"[\s-]", "_", (value or name).strip())
        if kind in ("", "sc", "script", "scx", "scriptextensions") and re.fullmatch("[A-Za-z_]+", spelt):
            tries += [f"\\p{{IsScript={spelt}}}".replace("IsScript=", "script="), *([f"\\p{{Is{spelt}}}"] if not kind else [])]
        for x in tries:
            if compiles(self.spark, x):
                return _none(x) if negated else x
        raise Invalid(f"no property {name}")

    # what stands in brackets
    def brackets(self) -> str:
        negated, items, out, operator = self.skip("^"), [], "", ""
        if self.peek() == "]" or self.peek() == "-":
            while self.peek() == "-":
                items.append(_sign(ord(self.take())))
            if not items and self.skip("]"):
                items.append(_sign(ord("]")))
        while True:
            self.blanks()
            done, sign = self.skip("]"), next((s for s in ("&&", "--", "~~") if self.text.startswith(s, self.at)), "")
            if done or sign:
                x = f"(?:{'|'.join(items)})" if items else "(?!)"
                out = {"": x, "&&": f"(?:(?={out}){x})", "--": f"(?:(?!{x}){out})", "~~": f"(?:(?!{x}){out}|(?!{out}){x})"}[operator]
                if done:
                    return _none(self.folded(out)) if negated else out
                self.at, operator, items = self.at + 2, sign, []
            else:
                items.append(self.item())

    def item(self) -> str:
        if self.peek(2) == "[:" and (named := re.match(r"\[:(\^?)([a-z]+):\]", self.text[self.at :])) and named[2] in ASCII:
            self.at += named.end()
            x = f"[{ASCII[named[2]]}]"
            return _none(x) if named[1] else x
        if self.skip("["):
            return self.brackets()
        first = self.one()
        if isinstance(first, str):
            return first
        self.blanks()
        if self.peek() != "-" or self.peek(2) in ("-]", "--"):
            return _sign(first)
        self.take()
        self.blanks()
        last = self.one()
        if isinstance(last, str) or last < first:
            raise Invalid("no range")
        return f"[{_sign(first)}-{_sign(last)}]"

    def one(self) -> int | str:
        """A character's number, or a class."""
        c = self.take()
        if c != "\\":
            return ord(c)
        if self.peek() and self.peek() in "dswDSWpP":
            return self.escape()
        return self.code(self.take())


def compiles(spark: SparkSession, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """The pattern as Java takes it; None if it is no valid one, as with look-around and back references."""
    if pattern and all(c in string.ascii_letters + string.digits + " _" for c in pattern):
        return pattern
    try:
        out = _Reader(spark, pattern).whole()
    except (Invalid, RecursionError):
        return None
    return out if compiles(spark, out) else None
