"""Source files that do not parse: lexing, layout and table-driven parsing of fifteen languages.

A text is reduced in a few passes to terminals (comments vanish, literals become STR, numbers NUM,
names ID unless they are keywords), cut into lines, given the layout tokens of its language
(statement ends, indentation), and fed whole to the grammar's tables. The first token without an
action is the file's first unrecoverable error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.grammar import END, Parser, Tables
from skerry.llm.languages import GRAMMARS, SOFT
from skerry.session import spread, table

#: The registry's suffixes.
SUFFIX = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".dart": "dart",
}
#: Other spellings of the languages.
SPELLINGS = {
    "py": "python", "python3": "python", "python2": "python", "js": "javascript", "jsx": "javascript", "node": "javascript", "ecmascript": "javascript", "ts": "typescript", "tsx": "typescript",
    "golang": "go", "rs": "rust", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "c#": "csharp", "cs": "csharp", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "php8": "php", "php7": "php",
}
_C = r"//[^\n]*|/\*.*?\*/"
_DQ = r"\"(?:[^\"\\\n]|\\.)*\""
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_TDQ = r"\"\"\".*?\"\"\""
_PRE = r"(?m:^[ \t]*#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\.)*)"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"
_JSRE = r"(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
#: What vanishes or becomes one literal, per language: (pattern of comments, pattern of literals).
LITERALS = {
    "python": (r"#[^\n]*", r"(?i:\b[rbuft]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + _DQ.replace("\\n", "\\n") + "|" + _SQ + ")"),
    "javascript": (_C + r"|\A#![^\n]*", _DQ + "|" + _SQ + r"|`(?:[^`\\]|\\.)*`|" + _JSRE),
    "typescript": (_C, _DQ + "|" + _SQ + r"|`(?:[^`\\]|\\.)*`|" + _JSRE),
    "go": (_C, _DQ + r"|`[^`]*`|" + _CHAR),
    "rust": (_C, r"\bb?r(?P<fence>#+)\".*?\"(?P=fence)|\bb?r\"[^\"]*\"|\bb?\"(?:[^\"\\]|\\.)*\"|\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'"),
    "java": (_C, _TDQ + "|" + _DQ + "|" + _CHAR),
    "c": (_C + "|" + _PRE, r"\b[LuU]?" + _DQ + "|" + _DQ + "|" + _CHAR),
    "cpp": (_C + "|" + _PRE + r"|\[\[[^\]\n]*\]\]", r"(?:\b(?:u8|[LuU]))?\bR\"(?P<fence>[^()\\\s]{0,16})\(.*?\)(?P=fence)\"|\b(?:u8|[LuU])R\"(?P<fence2>[^()\\\s]{0,16})\(.*?\)(?P=fence2)\"|\b(?:u8|[LuU])\"(?:[^\"\\\n]|\\.)*\"|" + _DQ + "|" + _CHAR),
    "csharp": (_C + r"|(?m:^[ \t]*#(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|error|warning|line)\b[^\n]*)", r"\$?@\$?\"(?:[^\"]|\"\")*\"|\"\"\".*?\"\"\"|\$?" + _DQ + "|" + _CHAR),
    "ruby": (r"#[^\n]*|(?m:^=begin\b.*?^=end\b)", r"<<[~-]?(?P<quote>['\"]?)(?P<fence>[A-Z]\w*)(?P=quote)[^\n]*\n(?:.*?\n)??[ \t]*(?P=fence)\b|%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})(?<=[)\]}])|" + r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`\n]*`|(?<![:\w]):[A-Za-z_]\w*[?!]?|(?<![:\w]):\"[^\"\n]*\"|(?<=[(,=~\s])/(?![\s=])(?:\\.|[^/\\\n])+/[imx]*"),
    "php": (_C.replace("//[^\\n]*", r"//(?:(?!\?>)[^\n])*") + r"|#(?!\[)[^\n]*", r"<<<[ \t]*(?P<quote>['\"]?)(?P<fence>\w+)(?P=quote)\n(?:.*?\n)??[ \t]*(?P=fence)\b|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"),
    "swift": (_C + r"|(?m:^[ \t]*#(?:if|elseif|else|endif|sourceLocation|warning|error)\b[^\n]*)", r"#\"[^\n]*?\"#|" + _TDQ + "|" + _DQ),
    "kotlin": (_C + r"|\A#![^\n]*", _TDQ + "|" + _DQ + "|" + _CHAR),
    "scala": (_C, r"\b[a-z]{1,3}\"\"\".*?\"\"\"|\"\"\".*?\"\"\"|\b[a-z]{1,3}\"(?:[^\"\\\n]|\\.)*\"|" + _DQ + "|" + _CHAR),
    "dart": (_C, r"\br?'''.*?'''|\br?\"\"\".*?\"\"\"|\br\"[^\"\n]*\"|\br'[^'\n]*'|'''.*?'''|\"\"\".*?\"\"\"|" + _DQ + "|" + _SQ),
}
_NUM = re.compile(r"(?<![\w$])(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![\d.])|\d[\d_']*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)(?:_?[iuf](?:8|16|32|64|128|size)|[uU]?[lL]{1,2}|[lL][uU]|[fFdDmMnjJ]|[uU][lL]?)?(?![\w$])")
_PYNUM = re.compile(r"(?<!\w)(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0+(?![\d.])|[1-9][\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|0\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[jJ]?(?!\w)")
_NAME = re.compile(r"\.?[A-Za-z_$@\x80-\U0010ffff][\w$]*[?!]?(?=[^=]|\Z)|\.?[A-Za-z_$@\x80-\U0010ffff][\w$]*")
_PLAIN = re.compile(r"\.?[^\W\d][\w]*")
_DOLLAR = re.compile(r"\.?[^\W\d][\w$]*|\$[\w$]*")

#: Operators by class; longer ones are tried first.
_COMMON = {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", ",": ",", ";": ";", ":": ":", ".": ".", "+": "PM", "-": "PM", "*": "PM", "&": "PM", "/": "BIN", "%": "BIN", "^": "BIN", "|": "BIN", "||": "BIN", "&&": "BIN", "==": "BIN", "!=": "BIN", "<=": "BIN", ">=": "BIN", "<<": "BIN", "!": "NOT", "~": "NOT", "<": "LT", ">": "GT", "=": "ASG", "?": "Q", "->": "ARROW", "=>": "FAT", "::": "DC", "...": "ELL", "++": "INC", "--": "INC", **{x + "=": "ASG" for x in ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>")}}
OPERATORS = {
    "python": {k: v for k, v in _COMMON.items() if k not in ("!", "?", "&&", "||", "::", "=>", "++", "--")} | {"<": "BIN", ">": "BIN", ">>": "BIN", "**": "STST", "*": "STAR", "/": "SLASH", "//": "BIN", ":=": "ASGW", "@": "@", "**=": "ASG", "//=": "ASG", "@=": "ASG", "&": "BIN"},
    "javascript": _COMMON | {"===": "BIN", "!==": "BIN", "**": "BIN", "**=": "ASG", "??": "BIN", "??=": "ASG", "||=": "ASG", "&&=": "ASG", "?.": "QDOT", ">>": "BIN", ">>>": "BIN", "@": "@", "#": "#", "&": "BIN", "->": "BAD", "::": "BAD"},
    "go": _COMMON | {":=": "ASG", "<-": "LARR", ">>": "BIN", "&^": "BIN", "&^=": "ASG", "->": "BAD", "=>": "BAD", "::": "BAD", "?": "BAD", "~": "NOT", "^": "PM"},
    "rust": {k: v for k, v in _COMMON.items() if k not in ("++", "--")} | {"..": "DD", "..=": "DD", "#": "#", "@": "AT_", "|": "BAR", "||": "BIN"},
    "java": _COMMON | {"@": "AT", ">>>=": "ASG", "=>": "BAD"},
    "c": _COMMON | {">>": "BIN", "=>": "BAD", "::": "BAD"},
    "cpp": _COMMON | {"<=>": "BIN", "=>": "BAD"},
    "csharp": _COMMON | {"??": "BIN", "??=": "ASG", "..": "BIN", "->": "BAD", "@": "BAD"},
    "ruby": _COMMON | {"**": "STST", "=~": "BIN", "!~": "BIN", "===": "BIN", "<=>": "BIN", "..": "DD", "...": "DD", "&.": "QDOT", "|": "BAR", "||=": "ASG", "&&=": "ASG", ">>": "BIN", "**=": "ASG", "++": "BAD", "--": "BAD", "@": "BAD"},
    "php": _COMMON | {"===": "BIN", "!==": "BIN", "<=>": "BIN", "**": "BIN", "??": "BIN", "??=": "ASG", ".=": "ASG", ".": "BIN", "?->": "QARROW", "\\": "BS", "@": "AT", "#[": "HASHB", "<>": "BIN", ">>": "BIN", "->": "ARROW"},
    "swift": {k: v for k, v in _COMMON.items() if k not in ("++", "--")} | {"===": "BIN", "!==": "BIN", "??": "BIN", "..<": "DD", "&+": "BIN", "@": "AT", "&": "PM", "#": "BAD", "=>": "BAD", "::": "BAD"},
    "kotlin": _COMMON | {"?:": "ELVIS", "!!": "NN", "?.": "QDOT", "..": "DD", "..<": "DD", "===": "BIN", "!==": "BIN", "@": "AT", "=>": "BAD", "&": "BAD", "|": "BAD"},
    "scala": _COMMON | {"<-": "LARR", "@": "AT", "#": "HASH", "::": "BIN", ":::": "BIN", ":+": "BIN", "+:": "BIN", "++": "BIN", "--": "BIN", "->": "BIN", "<:": "LT", ">:": "GT", "<%": "LT", ">>": "BIN"},
    "dart": _COMMON | {"..": "DD", "?.": "QDOT", "?..": "DD", "??": "BIN", "??=": "ASG", "~/": "BIN", "~/=": "ASG", "@": "AT", "->": "BAD", "::": "BAD", "&": "BIN"},
}
OPERATORS["typescript"] = OPERATORS["javascript"] | {">>": "BIN"}
#: Keywords that are ordinary names elsewhere; they count as keywords only where they can be meant.
LINE_END = {"javascript", "typescript", "go", "swift", "kotlin", "scala", "ruby"}
#: A line that begins so goes on with the line before.
CONTINUES = {
    "javascript": {".", "QDOT", ",", ")", "]", "BIN", "PM", "ASG", "LT", "GT", "Q", ":", "FAT", "else", "catch", "finally", "instanceof", "in", "(", "["},
    "go": set(),
    "swift": {".", ",", ")", "]", "BIN", "Q", "ASG", "ARROW", "else", "catch", "as", "asq", "is", "where"},
    "kotlin": {".", "QDOT", ",", ")", "]", "BIN", "ELVIS", "ASG", "else", "catch", "finally", "as", "asq", "ARROW", ":"},
    "scala": {".", ",", ")", "]", "BIN", "ASG", "else", "catch", "finally", "yield", "match", "extends", "with", "FAT"},
    "ruby": {".", "QDOT"},
}
CONTINUES["typescript"] = CONTINUES["javascript"]
#: A line that ends so goes on with the next one.
HANGS = {
    "javascript": {"BIN", "PM", "ASG", "LT", "GT", "Q", ":", ",", ".", "QDOT", "NOT", "FAT", "(", "[", "{", "else", "do", "return_", "typeof", "new", "in", "of", "extends", ";", "NL"},
    "swift": {"BIN", "PM", "ASG", "Q_", ":", ",", ".", "(", "[", "{", "else", "ARROW", "in", ";", "NL"},
    "kotlin": {"BIN", "PM", "ASG", "ELVIS", ":", ",", ".", "QDOT", "(", "[", "{", "else", "ARROW", ";", "NL"},
    "scala": {"BIN", "PM", "ASG", ":", ",", ".", "(", "[", "{", "else", "FAT", "LARR", "extends", "with", "match", "yield", ";", "NL"},
    "ruby": {"BIN", "PM", "ASG", "Q", ",", ".", "QDOT", "(", "[", "{", "FAT", "LT", "GT", "NOT", "and", "or", "not", ";", "NL"},
}
HANGS["typescript"] = HANGS["javascript"]
GO_ENDS = {"ID", "NUM", "STR", "INC", ")", "]", "}", "return", "break", "continue", "fallthrough", "interface"}


#: Strings with code inside: (opening quote, whether it may span lines, opening and closing mark of code), by language.
_JS_T = ((r"`", True, "${", "}"),)
_NESTED = {
    "javascript": _JS_T, "typescript": _JS_T,
    "swift": ((r'"""', True, "\\(", ")"), (r'"', False, "\\(", ")")),
    "kotlin": ((r'"""', True, "${", "}"), (r'"', False, "${", "}")),
    "scala": ((r'\b[a-z]{1,6}"""', True, "${", "}"), (r'\b[a-z]{1,6}"', False, "${", "}")),
    "csharp": ((r'\$"""', True, "{", "}"), (r'(?:\$@|@\$)"', True, "{", "}"), (r'\$"', False, "{", "}")),
    "dart": ((r"""'\''""", True, "${", "}"), (r'"""', True, "${", "}"), (r"'", False, "${", "}"), (r'"', False, "${", "}")),
    "ruby": ((r'"', True, "#{", "}"), (r"`", False, "#{", "}")),
    "php": ((r'"', True, "{$", "}"),),
    "python": ((r'(?i:\b(?:f|rf|fr))"""', True, "{", "}"), (r"(?i:\b(?:f|rf|fr))'''", True, "{", "}"), (r'(?i:\b(?:f|rf|fr))"', False, "{", "}"), (r"(?i:\b(?:f|rf|fr))'", False, "{", "}")),
}
_NESTED["dart"] = ((r"'''", True, "${", "}"), *_NESTED["dart"][1:])
#: Where code inside a string may hold a quote again.
_DEEP = {"javascript": r"\$\{[^{}`]*`", "typescript": r"\$\{[^{}`]*`", "swift": r'\\\([^\n"]*"', "kotlin": r'\$\{[^{}"\n]*"', "scala": r'\$\{[^{}"\n]*"', "csharp": r'\$@?"[^"\n]*\{[^{}"\n]*"', "dart": r"\$\{[^{}\n]*?['\"]", "ruby": r'#\{[^{}"\n]*"', "php": r'\{\$[^{}"\n]*"', "python": r"""(?i)\bf['"][^'"\n]*\{[^{}'"\n]*['"]"""}
_DEEP = {k: re.compile(v) for k, v in _DEEP.items()}


class Strings:
    """A lexer with a stack of modes, which folds strings that hold code that holds strings.

    A mode is code, with the mark that ends it, or a string; brackets in code are counted, so that only
    the right one ends it. What is no string with code inside is left as it stands.
    """

    def __init__(self, name: str, comments: str):
        self.kinds = _NESTED[name]
        opens = "|".join(f"(?P<s{i}>{k[0]})" for i, k in enumerate(self.kinds))
        plain = {"javascript": _DQ + "|" + _SQ, "typescript": _DQ + "|" + _SQ, "ruby": r"'(?:[^'\\]|\\.)*'|\?[\"'`]", "php": r"'(?:[^'\\]|\\.)*'", "csharp": r"@\"(?:[^\"]|\"\")*\"|" + _DQ + "|" + _CHAR, "scala": r'"""(?:.*?)"""|' + _DQ + "|" + _CHAR, "kotlin": _CHAR, "dart": r"\br'[^'\n]*'|\br\"[^\"\n]*\""}.get(name, r"(?!)")
        if name == "python":
            plain = r'"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?'''|" + _DQ + "|" + _SQ
        self.next = re.compile(f"(?P<skip>{comments})|{opens}|(?P<plain>{plain})|(?P<bracket>[(){{}}\\[\\]])", re.S)
        self.body = []
        for opening, many, code, _ in self.kinds:
            quote = re.sub(r".*?((['\"`])\2*)$", r"\1", opening)
            line = "" if many else "\n"
            escape = r"\\(?!\()." if code.startswith("\\") else r"\\."
            self.body.append((re.compile(f"(?P<end>{re.escape(quote)})|(?P<code>{re.escape(code)})|{escape}|[^{line}]" if not many else f"(?P<end>{re.escape(quote)})|(?P<code>{re.escape(code)})|{escape}|.", re.S), quote))

    def fold(self, text: str) -> str:
        out, at = [], 0
        while m := self.next.search(text, at):
            kind = m.lastgroup
            if kind and kind[0] == "s" and kind[1:].isdigit():
                end, deep = self._string(text, m.end(), int(kind[1:]), 0)
                if end is None:
                    at_next = m.end()
                    out.append(text[at:at_next])
                    at = at_next
                    continue
                whole = text[m.start() : end]
                out.append(text[at : m.start()])
                out.append("§ " + "\x01" * whole.count("\n") if deep else whole)
                at = end
            else:
                out.append(text[at : m.end()])
                at = m.end()
        return "".join([*out, text[at:]])

    def _string(self, text: str, at: int, kind: int, depth: int) -> tuple[int | None, bool]:
        """(end of the string whose contents begin at ``at``, whether it holds code)."""
        pattern, _ = self.body[kind]
        deep = False
        while m := pattern.match(text, at):
            at = m.end()
            if m.lastgroup == "end":
                return at, deep
            if m.lastgroup == "code":
                if depth > 40:
                    return None, deep
                deep = True
                end = self._code(text, at, self.kinds[kind][3], depth + 1)
                if end is None:
                    return None, deep
                at = end
        return None, deep

    def _code(self, text: str, at: int, close: str, depth: int) -> int | None:
        level = 0
        pair = {")": "(", "}": "{"}[close]
        while m := self.next.search(text, at):
            kind = m.lastgroup
            at = m.end()
            if kind and kind[0] == "s" and kind[1:].isdigit():
                end, _ = self._string(text, at, int(kind[1:]), depth)
                if end is None:
                    return None
                at = end
            elif kind == "bracket":
                if m.group() == pair:
                    level += 1
                elif m.group() == close:
                    if level == 0:
                        return at
                    level -= 1
        return None


_BRANCH = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|else|elif|elseif|endif)\b(.*)")


def first_branches(text: str) -> str:
    """The text with only the first branch of each conditional of the preprocessor (the second where the first
    is switched off by a constant); lines keep their numbers."""
    out, stack = [], []
    for line in text.split("\n"):
        m = _BRANCH.match(line)
        word = m[1] if m else ""
        if word in ("if", "ifdef", "ifndef"):
            on = not (word == "if" and m[2].strip() in ("0", "false"))
            stack.append([on, on])
        elif word in ("else", "elif", "elseif") and stack:
            stack[-1] = [not stack[-1][1], True]
        elif word == "endif" and stack:
            stack.pop()
        out.append(line if m or all(on for on, _ in stack) else "")
    return "\n".join(out)


_COMPOUND = {"if", "while", "for", "with", "def", "class", "else", "elif", "try", "except", "finally", "async", "match", "case"}


def no_target(toks: tuple[str, ...]) -> bool:
    """Whether a logical line of Python assigns to what can't be assigned to: a call, a literal, an operation."""
    depth, at = 0, 0
    opened: list[int] = []
    colon = None
    for i, t in enumerate(toks):
        if t in ("(", "[", "{"):
            opened.append(i)
            depth += 1
        elif t in (")", "]", "}"):
            depth -= 1
            if opened:
                last = opened.pop()
        elif depth == 0 and t == "lambda":
            return False
        elif depth == 0 and t == ":":
            colon = i if colon is None or toks[at] in _COMPOUND else colon
        elif depth == 0 and t == "ASG":
            lo, hi = at, i
            if colon is not None:
                lo, hi = (colon + 1, i) if toks[at] in _COMPOUND else (at, colon)
            end = toks[hi - 1] if hi > lo else ""
            if end in ("NUM", "STR", "True", "False", "None", "ELL"):
                return True
            if end == ")" and last > lo and toks[last - 1] in ("ID", ")", "]", "STR"):
                return True
            at, colon = i + 1, None
    return False


class Language:
    """One language's lexer, layout and parser."""

    def __init__(self, name: str):
        self.name = name
        grammar = GRAMMARS[name]
        heads = {r.split(":")[0].strip() for r in grammar.strip().splitlines() if ":" in r}
        words = {s.rstrip("?*+") for r in grammar.splitlines() if ": " in r for s in r.split(": ", 1)[1].split()}
        self.keywords = {w for w in words - heads if re.fullmatch(r"[A-Za-z_]+", w) and not w.isupper()} | ({"BEGIN"} & words)
        self.keywords |= {"__FILE__", "__method__"} & words
        self.parser = Parser(Tables(grammar, SOFT.get(name, "")))
        comments, literals = LITERALS[name]
        self.strip = re.compile(f"(?P<comment_>{comments})|(?:{literals})", re.S)
        self.strings = Strings(name, comments) if name in _NESTED else None
        ops = OPERATORS[name]
        self.ops = ops
        self.token = re.compile(r"[A-Za-z_]+|§|0|" + "|".join(re.escape(o) for o in sorted(ops, key=len, reverse=True)) + r"|\S")
        self.lines: dict[str, tuple] = {}
        self.names: dict[str, str] = {}

    def _literal(self, m: re.Match) -> str:
        v = m.group()
        if m["comment_"] is not None:
            return " " + "\x01" * v.count("\n") if "\n" in v else " "
        return "§ " + "\x01" * v.count("\n") if "\n" in v else "§ "

    def _word(self, m: re.Match) -> str:
        w = m.group()
        got = self.names.get(w)
        if got is None:
            if len(self.names) > 60_000:
                self.names.clear()
            dotted = w[0] == "."
            bare = w[1:] if dotted else w
            if self.name == "php":
                low = bare.lower()
                got = ("." if dotted else "") + (low if low in self.keywords and not dotted else "a")
                if low in ("self", "parent"):
                    got = "a"
            elif dotted and not (self.name == "rust" and bare == "await") and not (self.name == "swift" and bare in ("init", "self")) and not (self.name in ("java", "scala") and bare in ("class", "this", "super", "new", "match")) and not (self.name == "ruby" and bare == "class"):
                got = ".a"
            else:
                got = ("." if dotted else "") + (bare if bare in self.keywords else "a")
            self.names[w] = got
        return got

    def reduce(self, text: str) -> str:
        """The text with literals, numbers and names folded."""
        n = self.name
        if self.strings and _DEEP[n].search(text):
            text = self.strings.fold(text)
        s = self.strip.sub(self._literal, text)
        if n == "python":
            s = re.sub(r"\\\r?\n", "  \x01", s)
            s = _PYNUM.sub("0", s)
            return _PLAIN.sub(self._word, s)
        if n == "rust":
            s = _without_macros(s)
            s = re.sub(r"'[a-z_]\w*", " 'a ", s)
            s = re.sub(r"#!?\[(?:[^\[\]]|\[[^\]]*\])*\]", lambda m: "\x01" * m.group().count("\n"), s)
        if n == "ruby":
            s = re.sub(r"\b([A-Za-z_]\w*[?!]?):(?![:\w])", " \x02 ", s)
            s = re.sub(r"@{1,2}(?=[A-Za-z_])|\$(?=[\w!@])", "", s)
            s = _NUM.sub("0", s)
            return _NAME.sub(self._word, s)
        if n == "php":
            s = re.sub(r"\$[A-Za-z_]\w*", " \x03 ", s)
        if n == "kotlin":
            s = re.sub(r"\breturn@\w+", " \x04 ", s)
            s = re.sub(r"\b(?:break|continue)@\w+", " \x05 ", s)
            s = re.sub(r"\bas\?", " asq ", s)
            s = re.sub(r"!(in|is)\b", r" n\1 ", s)
            s = re.sub(r"`[^`\n]*`", "a", s)
        if n == "swift":
            s = re.sub(r"\bas[?!]", " asq ", s)
            s = re.sub(r"#(?:selector|available|file|line|function|keyPath)\b", "a", s)
            s = re.sub(r"\\\.(?=\w)", "a.", s)
            s = re.sub(r"`(\w+)`", r"a", s)
        s = _NUM.sub("0", s)
        if n in ("javascript", "typescript"):
            s = s.replace("#", " ")
            return _DOLLAR.sub(self._word, s)
        if n in ("java", "c", "cpp", "dart"):
            return _DOLLAR.sub(self._word, s)
        return _PLAIN.sub(self._word, s)

    _SPECIAL = {"§": "STR", "0": "NUM", "\x02": "LABEL", "\x03": "VAR", "\x04": "RETAT", "\x05": "BRKAT"}

    def terminals(self, line: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(terminals, bracket steps) of a folded line; remembered."""
        got = self.lines.get(line)
        if got is None:
            out = []
            kw, ops, special = self.keywords, self.ops, self._SPECIAL
            src = line.replace("'a", "\x06") if self.name == "rust" else line
            for t in self.token.findall(src):
                if t in special:
                    out.append(special[t])
                elif t == "\x06":
                    out.append("LIFE")
                elif t in ops:
                    out.append(ops[t])
                elif t in kw:
                    out.append(t)
                elif t == "a" or (t.isalpha() and t.isascii()):
                    out.append("ID")
                elif t != "\x01":
                    out.append("BAD")
            if self.name in ("kotlin", "scala"):
                # a name between two operands is an infix call
                ends, starts = {"ID", "NUM", "STR", ")", "]"}, {"ID", "NUM", "STR", "("}
                for i in range(1, len(out) - 1):
                    if out[i] == "ID" and out[i - 1] in ends and out[i + 1] in starts and (i < 2 or out[i - 2] not in ("fun", "def", "val", "var", "class", "object", "import", "package")) and out[i - 1] != "INFIX":
                        out[i] = "INFIX"
            steps = tuple(t for t in out if t in "([{}])" and len(t) == 1)
            got = self.lines[line] = (tuple(out), steps)
            if len(self.lines) > 25_000:
                self.lines.clear()
        return got

    def first_error(self, text: str) -> tuple[int, str] | None:
        """(line, token) of the first unrecoverable error, or None. A text without tokens is valid."""
        text = text.lstrip("\ufeff")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.strip():
            return None
        got = self._php(text) if self.name == "php" else self._parse(self.reduce(text))
        if got and self.name in ("c", "cpp", "csharp", "swift") and "#" in text and _BRANCH.search(text):
            # branches that exclude one another need not fit together
            got = self._parse(self.reduce(first_branches(text)))
        return got

    def _php(self, text: str) -> tuple[int, str] | None:
        if "<?" not in text:
            # plain text is a page without code; source of another language under this suffix is not
            return None if text.lstrip().startswith("<") else (1, "text without an opening tag")
        head, _, code = text.partition("<?")
        if head.strip() and not head.lstrip().startswith(("<", "#!")):
            return 1, "text before the opening tag"
        code = re.sub(r"^(?:php|=)", "", code)
        code = re.sub(r"\?>.*?(?:<\?(?:php|=)?|\Z)", lambda m: ";" + "\n" * m.group().count("\n"), code, flags=re.S)
        return self._parse(self.reduce("\n" * head.count("\n") + code))

    def _parse(self, s: str) -> tuple[int, str] | None:
        p = self.parser
        p.reset()
        if self.name == "python":
            return self._python(s)
        feed = p.feed
        ends = self.name in LINE_END
        go = self.name == "go"
        hang, cont = HANGS.get(self.name, set()), CONTINUES.get(self.name, set())
        stack: list[str] = []
        prev, prev_inside, skipped, tail = None, False, 0, None
        pending: tuple[str, ...] | None = None
        at = 0
        for no, line in enumerate(s.split("\n"), 1):
            if "\x01" in line:
                lost = line.count("\x01")
                line = line.replace("\x01", "")
            else:
                lost = 0
            line = line.strip()
            no += skipped
            skipped += lost
            if not line:
                continue
            toks, steps = self.terminals(line)
            if not toks:
                continue
            if ends:
                if pending is not None:
                    if tail is not None and not prev_inside:
                        if go:
                            nl = tail in GO_ENDS
                        else:
                            nl = (tail not in hang or pending[0] == "import") and toks[0] not in cont
                        if nl:
                            pending = (*pending, "NL")
                    k = feed(pending)
                    if k >= 0:
                        return at, pending[k]
                for b in steps:
                    if b in "([{":
                        stack.append(b)
                    elif stack:
                        stack.pop()
                prev_inside = bool(stack) and stack[-1] != "{"
                pending, tail, at = toks, toks[-1], no
            else:
                k = feed(toks)
                if k >= 0:
                    return no, toks[k]
                at = no
        if ends and pending is not None:
            if not prev_inside:
                pending = (*pending, "NL")
            k = feed(pending)
            if k >= 0:
                return at, pending[k]
        return None if feed((END,)) < 0 else (at, "end of file")

    def _python(self, s: str) -> tuple[int, str] | None:
        feed = self.parser.feed
        indents = [0]
        depth = skipped = at = 0
        buffer: tuple[str, ...] = ()
        for no, line in enumerate(s.split("\n"), 1):
            lost = line.count("\x01")
            no += skipped
            skipped += lost
            body = line.replace("\x01", "")
            if not body.strip():
                continue
            stripped = body.strip()
            toks, steps = self.terminals(stripped)
            if "match" in toks or "case" in toks:
                soft = toks[0] in ("match", "case") and toks[-1] == ":" and len(toks) > 2 and toks[1] not in ("ASG", ".", ":", ")", ",")
                toks = tuple(toks[0] if i == 0 and soft else "ID" if t in ("match", "case") else t for i, t in enumerate(toks))
            if not depth:
                wide = body.expandtabs(8)
                level = len(wide) - len(wide.lstrip(" \f"))
                lead: tuple[str, ...] = ()
                if level > indents[-1]:
                    indents.append(level)
                    lead = ("INDENT",)
                else:
                    n = 0
                    while level < indents[-1]:
                        indents.pop()
                        n += 1
                    if level != indents[-1]:
                        return no, "indentation"
                    lead = ("DEDENT",) * n
                buffer = lead + toks
            else:
                buffer = buffer + toks
            for b in steps:
                depth += 1 if b in "([{" else -1
            if depth < 0:
                depth = 0
            at = no
            if depth and len(buffer) < 400:
                continue
            if not depth and "ASG" in buffer and no_target(tuple(t for t in buffer if t not in ("INDENT", "DEDENT"))):
                return no, "ASG"
            line_toks = buffer if depth else (*buffer, "NL")
            k = feed(line_toks)
            if k >= 0:
                return no, line_toks[k]
            buffer = ()
        if depth or buffer:
            return at, "end of file"
        k = feed(("DEDENT",) * (len(indents) - 1) + (END,))
        return None if k < 0 else (at, "end of file")


_MACRO = re.compile(r"\bmacro_rules!\s*\w+\s*([({\[])")


def _without_macros(s: str) -> str:
    """Folded Rust with each macro definition, a tree of any tokens, replaced by an empty item."""
    at, out = 0, []
    while m := _MACRO.search(s, at):
        depth, end = 0, None
        for k in re.finditer(r"[(){}\[\]]", s[m.start(1) :]):
            depth += 1 if k.group() in "({[" else -1
            if depth == 0:
                end = m.start(1) + k.end()
                break
        if end is None:
            break
        out += [s[at : m.start()], ";", "\x01" * 0 + "\n" * s.count("\n", m.start(), end)]
        at = end
    return "".join([*out, s[at:]])


_MADE: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _MADE:
        _MADE[name] = Language(name)
    return _MADE[name]


def language_of(path: str | None, lang: str | None) -> str | None:
    """The registry's language of the lower-cased suffix, else the one that ``lang`` spells."""
    base = (path or "").rsplit("/", 1)[-1].lower()
    dot = base.rfind(".")
    if dot >= 0 and base[dot:] in SUFFIX:
        return SUFFIX[base[dot:]]
    w = (lang or "").strip().lower()
    w = SPELLINGS.get(w, w)
    return w if w in GRAMMARS else None


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, lines, tokens = [], [], []
        for path, lang, text in zip(*(b.column(c).to_pylist() for c in ("path", "lang", "text"))):
            name = language_of(path, lang)
            err = language(name).first_error(text) if name and text else None
            langs.append(name)
            lines.append(err[0] if err else None)
            tokens.append(err[1] if err else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("repo"), pa.array(langs, pa.string()), pa.array(lines, pa.int32()), pa.array(tokens, pa.string())], ["id", "repo", "language", "error_line", "error_token"])


def check_syntax(df: DataFrame, id_col: str, path_col: str, lang_col: str, text_col: str, repo_col: str) -> DataFrame:
    """``(id, repo, language, error_line, error_token)`` of every file; a null line means no error.

    A file whose language neither its suffix nor its ``lang`` tells has a null language and is never
    an error; null and empty texts are valid; null ids are dropped; repeated rows count once; an
    empty table gives an empty result; other columns are ignored. Texts are parsed whole.
    """
    src = df.where(F.col(id_col).isNotNull()).select(*(F.col(c).alias(a) for c, a in ((id_col, "id"), (path_col, "path"), (lang_col, "lang"), (text_col, "text"), (repo_col, "repo"))))
    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(_check, f"id {kind}, repo string, language string, error_line int, error_token string").dropDuplicates(["id"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_syntax(table(spark, sf_dir, "source_files"), "file_id", "file_path", "lang", "text", "repo_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("error_line is not null").select(F.col("id").alias("file_id"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, files that do not parse and their share, per repository and language."""
    f = _files(spark, sf_dir).where("language is not null").groupBy(F.col("repo").alias("repo_id"), "language")
    return f.agg(F.count("*").alias("files"), F.count("error_line").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
SQL: dict[str, str] = {}
