"""Lexers: text to tokens (class, nesting, whether a top-level statement may end here).

What no rule of the language knows becomes a token of class ``error``; a marker of an unresolved merge at the start
of a line, outside literals and comments, one of class ``conflict``. No grammar has either class.
"""

from __future__ import annotations

import unicodedata

import regex as re

OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {v: k for k, v in OPEN.items()}
_CONFLICT = re.compile(r"(?:<{7}|>{7}|={7}|\|{7})(?=[ \t\r\n]|$)")


class Tokens:
    """Columns of one text's tokens. ``nest``: +1 opens, -1 closes, ``kind`` names the bracket pair."""

    def __init__(self):
        self.cls: list[str] = []
        self.nest: list[int] = []
        self.kind: list[str] = []
        self.end: list[bool] = []

    def add(self, cls: str, nest: int = 0, kind: str = "", end: bool = False) -> None:
        self.cls.append(cls)
        self.nest.append(nest)
        self.kind.append(kind)
        self.end.append(end)

    def punct(self, p: str) -> None:
        if p in OPEN:
            self.add(p, 1, p)
        elif p in CLOSE:
            self.add(p, -1, CLOSE[p])
        else:
            self.add(p)


def _line_start(text: str, at: int) -> bool:
    return at == 0 or text[at - 1] in "\r\n"


# --- Rust ------------------------------------------------------------------------------------------------------

RUST_WORDS = set(
    "as async await box break const continue crate default dyn else enum extern false fn for if impl in let loop match mod move mut "
    "pub raw ref return self Self static struct super trait true type union unsafe use where while yield auto".split()
)
_RUST_SOFT = {"default", "union", "auto", "raw", "box", "yield"}
_RUST = re.compile(
    r"""(?P<space>\s+|//[^\r\n]*)|(?P<block>/\*)|(?P<raw>(?:b|c)?r(?P<h>\#*)"(?s:.*?)"(?P=h))|(?P<rawbad>(?:b|c)?r\#*")
    |(?P<str>(?:b|c)?"(?s:[^"\\]|\\.)*")|(?P<char>b?'(?:[^'\\\r\n\t]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
    |(?P<life>'(?:r\#)?[\p{L}_]\w*)|(?P<num>0[xob][0-9a-fA-F_]+\w*|\d[\d_]*(?:\.(?!\.|[\p{L}_])[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<id>(?:r\#)?[\p{L}_]\w*)|(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%^!&|=<>@.,;:\#$?(){}\[\]~])""",
    re.X,
)
_RUST_ITEM = {"pub", "fn", "struct", "enum", "impl", "trait", "const", "static", "type", "mod", "use", "extern", "unsafe", "async", "#", "union", "id"}


def lex_rust(text: str) -> Tokens:
    t, at, n = Tokens(), 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith("#!", at) and not re.match(r"#!\s*\[", text[at:]):
        at = len(text.splitlines()[0])
    free = 0  # depth inside an attribute or a macro call
    while at < n:
        if text[at] in "<>=|" and _line_start(text, at) and (m := _CONFLICT.match(text, at)):
            t.add("conflict")
            at = m.end()
            continue
        m = _RUST.match(text, at)
        if not m:
            t.add("error")
            at += 1
            continue
        what, s = m.lastgroup, m.group()
        at = m.end()
        if what == "space":
            continue
        if what == "block":
            depth = 1
            while depth and at < n:
                two = text[at : at + 2]
                depth += (two == "/*") - (two == "*/")
                at += 2 if two in ("/*", "*/") else 1
            if depth:
                t.add("error")
            continue
        if what == "rawbad":
            t.add("error")
            break
        if what == "op":
            opens, closes = s in OPEN, s in CLOSE
            if opens and not free:
                back = t.cls[-3:]
                attribute = s == "[" and (back[-1:] == ["#"] or back[-2:] == ["#", "!"])
                # A call name!(...), or name! other {...} as macro_rules has it.
                macro = back[-1:] == ["!"] and back[-2:-1] and back[-2] in ("id", "crate", "self", "super") or (
                    len(back) == 3 and back[1] == "!" and back[0] == "id" and back[2] == "id" and s in "{("
                )
                if attribute or macro:
                    t.punct(s)
                    free = 1
                    continue
            if free:
                free += opens - closes
                t.punct(s) if opens or closes else t.add("mt")
            else:
                t.punct(s)
                continue
            continue
        cls = s if what == "id" and s in RUST_WORDS else "str" if what == "raw" else what
        if what == "id" and s == "_":
            cls = "_"
        if cls in _RUST_SOFT:
            # Soft keywords count as such only before another word of an item.
            ahead = re.match(r"\s+[\p{L}_]", text[at:])
            if not ahead or cls in ("box", "yield"):
                cls = "id"
        if what == "num" and not re.fullmatch(
            r"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[\d_]+)(?:[iu](?:8|16|32|64|128|size))?|[\d_]+\.?[\d_]*(?:[eE][+-]?[\d_]+)?(?:f32|f64)?", s
        ):
            cls = "error"
        t.add("mt" if free and cls != "error" else cls)
    depth = 0
    for i, c in enumerate(t.cls):
        depth += t.nest[i]
        follows = t.cls[i + 1] if i + 1 < len(t.cls) else "$"
        t.end[i] = depth <= 0 and (c == ";" or c == "}") and (follows in _RUST_ITEM or follows == "$")
    return t


# --- ECMAScript and TypeScript -----------------------------------------------------------------------------------

SCRIPT_WORDS = set(
    "async of get set static type interface readonly as from declare namespace abstract keyof is infer satisfies asserts module private "
    "public protected implements override accessor out let yield await break case catch class const continue debugger default delete do else enum export extends "
    "false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_TS_ONLY = {"type", "interface", "readonly", "declare", "namespace", "abstract", "keyof", "is", "infer", "satisfies", "asserts", "module", "private", "public", "protected", "implements", "override", "accessor", "out"}
_SOFT = _TS_ONLY | {"async", "of", "get", "set", "static", "as", "from", "let", "yield", "await"}
_SCRIPT = re.compile(
    r"""(?P<space>[^\S\r\n\u2028\u2029]+|//[^\r\n\u2028\u2029]*)|(?P<nl>[\r\n\u2028\u2029]+)|(?P<block>/\*(?s:.*?)\*/)|(?P<blockbad>/\*)
    |(?P<str>"(?:[^"\\\r\n]|\\(?s:\r\n|.))*"|'(?:[^'\\\r\n]|\\(?s:\r\n|.))*')
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
    |(?P<private>\#[\p{L}_$][\w$\u200c\u200d]*)|(?P<id>(?:[\p{L}_$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<assignop>\*\*=|<<=|&&=|\|\|=|\?\?=|\+=|-=|\*=|/=|%=|&=|\|=|\^=)
    |(?P<op>\.\.\.|=>|===|!==|==|!=|<=|<<|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%=<>!&|^~?:;,.(){}\[\]@])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[\p{L}\d_$]*")
_TEMPLATE = re.compile(r"(?s)(?:[^`\\$]|\\.|\$(?!\{))*")
_VALUE = {"id", "num", "str", "regex", "tpl", "}tpl", ")", "]", "}", "this", "super", "true", "false", "null", "private"} | _SOFT
_CAN_END = _VALUE | {"return", "break", "continue", "debugger", "++", "--", "void", "!"}
_NO_NEW = {"in", "instanceof", "else", "catch", "finally", "extends", "implements", "as", "satisfies", "is", "of", "from"}
_HEAD = {"if", "for", "while", "with"}
#: What goes on with a member of a class from the line before; all other words can be names of members.
_MEMBER_GOES_ON = {"in", "instanceof", "extends", "implements"}


def lex_script(text: str, typed: bool) -> Tokens:
    t, at, n = Tokens(), 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    if text.startswith("#!", at):
        at = len(text.splitlines()[0])
    stack: list[tuple[str, str]] = []  # (bracket, class before it)
    newline, closed_head = False, False
    heads: list[list[int]] = []  # of classes whose body is still to come: (depth of brackets, open type brackets)

    def in_head(cls: str) -> bool:
        """Whether ``cls`` opens the body of a class."""
        if cls == "class":
            heads.append([len(stack), 0])
        elif heads and heads[-1][0] > len(stack):
            heads.pop()
        elif heads and heads[-1][0] == len(stack):
            if cls in "<>":
                heads[-1][1] += 1 if cls == "<" else -1
            elif heads[-1][1] <= 0 and (cls in (":", "=", ";", "{") or cls == "(" and t.cls[-1] == "class"):
                heads.pop()  # after the last four, class was only a name
                return cls == "{"
        return False

    def ends_member(prev: str, cls: str) -> bool:
        """Whether a new line between members of a class ends the one before."""
        before = t.cls[-2] if len(t.cls) > 1 else ""
        ended = prev == ">" or prev in _CAN_END and (prev != "!" or before in _VALUE) or (before, prev) == ("as", "const")
        named = prev in SCRIPT_WORDS and before in (";", "{", "}")
        fresh = cls in ("id", "num", "str", "private", "@", "[", "*") or cls in SCRIPT_WORDS and cls not in _MEMBER_GOES_ON
        return fresh and (named or ended)

    def put(cls: str) -> None:
        nonlocal newline, closed_head
        if newline and t.cls:
            prev = t.cls[-1]
            inner = stack[-1][0] if stack else "{"
            fresh = (cls in SCRIPT_WORDS and cls not in _NO_NEW) or cls in ("id", "num", "str", "private", "@", "!", "~", "++", "--", "conflict", "error", "*" if prev == ";" else "id")
            if prev == "]" and cls == "[":
                fresh = False
            if inner == "{" and prev in _CAN_END and fresh and not (prev == ")" and closed_head) and prev != "!":
                t.add(";", end=not stack)
            elif stack and stack[-1] == ("{", "class body") and ends_member(prev, cls):
                t.add(";")
        newline = False
        body = in_head(cls)
        if cls in OPEN:
            stack.append((cls, "class body" if body else t.cls[-1] if t.cls else ""))
            t.punct(cls)
        elif cls in CLOSE:
            closed_head = False
            if stack:
                _, before = stack.pop()
                closed_head = cls == ")" and (before in _HEAD or before == "await")
            t.punct(cls)
        else:
            t.punct(cls) if cls != ";" else t.add(";", end=not stack)

    def template(at: int, first: bool) -> int:
        m = _TEMPLATE.match(text, at)
        at = m.end()
        if at >= n:
            put("error")
            return n
        if text[at] == "`":
            if first:
                put("tpl")
            else:
                if stack:
                    stack.pop()
                t.add("}tpl", -1, "tpl")
            return at + 1
        if first:
            put("tpl{")
            t.nest[-1], t.kind[-1] = 1, "tpl"
            stack.append(("tpl", ""))
        else:
            t.add("tpl|")
        return at + 2

    while at < n:
        c = text[at]
        if c in "<>=|" and _line_start(text, at) and (m := _CONFLICT.match(text, at)):
            put("conflict")
            at = m.end()
            continue
        if c == "`":
            at = template(at + 1, True)
            continue
        if c == "}" and stack and stack[-1][0] == "tpl":
            at = template(at + 1, False)
            continue
        if c == "/" and not text.startswith(("//", "/*"), at):
            prev = t.cls[-1] if t.cls else ""
            if prev not in _VALUE or (prev == ")" and closed_head) or prev == "}" and newline:
                if m := _REGEX.match(text, at):
                    put("regex")
                    at = m.end()
                    continue
        m = _SCRIPT.match(text, at)
        if not m:
            put("error")
            at += 1
            continue
        what, s = m.lastgroup, m.group()
        at = m.end()
        if what == "space":
            continue
        if what == "nl":
            newline = True
            continue
        if what == "block":
            newline = newline or "\n" in s or "\r" in s
            continue
        if what == "blockbad":
            put("error")
            break
        if what == "id" and s in SCRIPT_WORDS and (typed or s not in _TS_ONLY) and not (t.cls and t.cls[-1] in (".", "?.") and s not in _SOFT):
            put(s)
        elif what == "id" and s in SCRIPT_WORDS and t.cls and t.cls[-1] in (".", "?."):
            put("id")
        elif what == "num" and at < n and (text[at].isalnum() or text[at] in "_$"):
            put("error")
        elif what == "op":
            put(s)
        else:
            put(what)
    return t


# --- Bash --------------------------------------------------------------------------------------------------------

_BASH_WORDS = {"if", "then", "elif", "else", "fi", "for", "while", "until", "do", "done", "case", "esac", "function", "select", "{", "}", "[[", "!", "time"}
_NEXT_IS_COMMAND = {"nl", ";", "&", "&&", "||", "|", "(", "$(", "{", "then", "do", "else", "elif", "if", "while", "until", "!", "time", ";;", "^", "case)", "=)"}
_BASH_OP = re.compile(r"&&|\|\||;;&|;;|;&|\|&|&>>|&>|[;&|()]")
_REDIR = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<>|<&|>>|>&|>\||[<>](?!\())")
_NESTS = {"if": "if", "case": "case", "do": "do", "{": "{"}
_UNNESTS = {"fi": "if", "esac": "case", "done": "do", "}": "{"}


class _Bash:
    def __init__(self, text: str):
        self.text, self.n, self.t = text.replace("\r\n", "\n"), 0, Tokens()
        self.n = len(self.text)
        self.heredocs: list[tuple[str, bool]] = []
        self.broken = False

    def fail(self) -> int:
        self.t.add("error")
        self.broken = True
        return self.n

    def run(self) -> Tokens:
        at = self.commands(0, False)
        if at < self.n and not self.broken:
            self.t.add("error")
        depth = 0
        for i, c in enumerate(self.t.cls):
            depth += self.t.nest[i]
            self.t.end[i] = depth <= 0 and c == "nl" and not (i and self.t.cls[i - 1] in ("&&", "||", "|", ")"))
        return self.t

    def commands(self, at: int, inner: bool) -> int:
        """Lex up to the end, or the ) that closes a substitution."""
        text, t = self.text, self.t
        command, parens = True, 0
        cases: list[str] = []  # word, in or pattern of each open case; command while in its lists
        want_in = 0  # words since for or select
        while at < self.n and not self.broken:
            c = text[at]
            if c in " \t":
                at += 1
                continue
            if text.startswith("\\\n", at):
                at += 2
                continue
            if c == "#":
                while at < self.n and text[at] != "\n":
                    at += 1
                continue
            if c in "\n\r":
                at += 1
                t.add("nl")
                at = self.bodies(at)
                command, want_in = True, 2 if want_in == 2 else 0
                continue
            if c in "<>" and _line_start(text, at) and (m := _CONFLICT.match(text, at)):
                t.add("conflict")
                at = m.end()
                continue
            state = cases[-1] if cases else ""
            if m := _REDIR.match(text, at):
                if not (m.group()[0].isdigit() or m.group()[0] == "{") or at == 0 or text[at - 1] in " \t\n;|&(":
                    t.add("redir")
                    op = m.group().lstrip("0123456789")
                    at = m.end()
                    while at < self.n and text[at] in " \t":
                        at += 1
                    if op.startswith("<<") and not op.startswith("<<<"):
                        start = at
                        at = self.word(at)
                        raw = text[start:at]
                        self.heredocs.append((re.sub(r"[\"'\\]", "", raw), op.endswith("-")))
                    continue
            if command and text.startswith("((", at):
                close = self.arithmetic(at + 2)
                if close is not None:
                    t.add("((")
                    at, command = close, want_in > 0
                    want_in = 0
                    continue
            if m := _BASH_OP.match(text, at):
                op = m.group()
                at = m.end()
                if op == "(":
                    if state == "pattern":
                        t.add("(")  # its ) closes the pattern
                        continue
                    t.add("(", 1, "(")
                    parens += 1
                    command = True
                elif op == ")":
                    if state == "pattern":
                        t.add(")")
                        cases[-1] = "list"
                        command = True
                    elif parens:
                        parens -= 1
                        t.add(")", -1, "(")
                        command = True  # a function's body or an operator follows
                    elif inner:
                        return at - 1
                    else:
                        return self.fail()
                elif op in (";;", ";&", ";;&"):
                    t.add(";;")
                    if cases:
                        cases[-1] = "pattern"
                    command = True
                else:
                    t.add({"|&": "|", "&>": "redir", "&>>": "redir"}.get(op, op))
                    command = op not in ("&>", "&>>")
                    if op == ";" and want_in != 2:
                        want_in = 0
                continue
            start = at
            if command and text.startswith("[[", at) and at + 2 < self.n and text[at + 2] in " \t\n":
                at = self.condition(at + 2)
                command = False
                continue
            m = re.compile(r"[^\s;&|()<>\"'`$\\]+(?=[\s;&|()<>]|$)").match(text, at)
            plain = m.group() if m else ""
            if state == "word" and plain != "in":
                at = self.word(at)
                cases[-1] = "in"
                continue
            if state == "in" and plain == "in":
                t.add("in")
                cases[-1] = "pattern"
                at, command = m.end(), True
                continue
            if state == "pattern" and plain != "esac":
                at = self.word(at)
                continue
            if want_in == 1 and plain == "in":
                t.add("in")
                at, want_in, command = m.end(), 0, False
                continue
            reserved = plain in _BASH_WORDS and (command or (want_in and plain in ("do", "{")))
            if reserved:
                at = m.end()
                if plain in _NESTS:
                    t.add(plain, 1, _NESTS[plain])
                elif plain in _UNNESTS:
                    t.add(plain, -1, _UNNESTS[plain])
                else:
                    t.add(plain)
                command = plain not in ("for", "select", "case", "function", "[[")
                if plain in ("for", "select"):
                    want_in = 2
                    at2 = re.compile(r"[ \t]*").match(text, at).end()
                    if text.startswith("((", at2):
                        close = self.arithmetic(at2 + 2)
                        if close is None:
                            return self.fail()
                        t.add("((")
                        at, command, want_in = close, True, 0
                elif plain == "case":
                    cases.append("word")
                elif plain == "esac" and cases:
                    cases.pop()
                continue
            at = self.word(at)
            if at == start:
                return self.fail()
            if want_in == 2:
                want_in, command = 1, True
                # the name; ``in``, ``do`` or a separator follows
                continue
            if want_in == 1:
                want_in = 0
            # An assignment leaves the next word in the command's place.
            command = bool(re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=", text[start:at])) and not (t.cls and t.cls[-1] == ")") and False
            if t.cls and len(t.cls) > 1 and t.cls[-2] == "function":
                command = True
        if inner and not self.broken:
            return self.fail()
        if self.heredocs and not self.broken:
            self.bodies(self.n)
        return at

    def bodies(self, at: int) -> int:
        """Skip the here-documents that were announced on the line just ended."""
        for mark, tabs in self.heredocs:
            while at < self.n:
                stop = self.text.find("\n", at)
                stop = self.n if stop < 0 else stop
                line = self.text[at:stop]
                at = min(stop + 1, self.n)
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
            else:
                self.fail()
                break
        self.heredocs = []
        return at

    def arithmetic(self, at: int) -> int | None:
        depth = 0
        while at < self.n:
            c = self.text[at]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    return at + 2 if self.text.startswith("))", at) else None
                depth -= 1
            elif c == "\n" and depth == 0 and self.text.startswith("\n\n", at):
                return None
            at += 1
        return None

    def condition(self, at: int) -> int:
        text, t = self.text, self.t
        t.add("[[", 1, "[[")
        while at < self.n and not self.broken:
            c = text[at]
            if c in " \t":
                at += 1
            elif c == "\n":
                t.add("nl")
                at += 1
            elif text.startswith("]]", at) and (at + 2 >= self.n or text[at + 2] in " \t\r\n;&|)"):
                t.add("]]", -1, "[[")
                return at + 2
            elif text.startswith(("&&", "||"), at):
                t.add(text[at : at + 2])
                at += 2
            elif t.cls[-1] == "w" and re.search(r"=~\s*$", text[max(0, at - 6) : at]):
                # The pattern of =~ goes to the next white space outside brackets.
                m = re.compile(r"(?:\\.|\[[^\]\n]*\]|\$\{[^}\n]*\}|\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)|[^\s])+").match(text, at)
                t.add("w")
                at = m.end()
            elif c in "()":
                t.add(c)
                at += 1
            elif c in "<>":
                t.add("redir")
                at += 1
            elif c in ";&|":
                return self.fail()
            else:
                at = self.word(at)
        return self.fail() if not self.broken else self.n

    def word(self, at: int) -> int:
        """One word; substitutions in it are lexed as tokens between its parts."""
        text, t, start = self.text, self.t, at
        t.add("w")
        while at < self.n and not self.broken:
            c = text[at]
            if c in " \t\n;&|)":
                break
            if c in "<>":
                if text.startswith(("<(", ">("), at):
                    at = self.substitution(at + 2)
                    continue
                break
            if c == "(":
                if at > start and text[at - 1] == "=" and re.match(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=\(", text[start : at + 1]):
                    return self.array(at + 1)
                if at > start and text[at - 1] in "@?*+!":
                    close = text.find(")", at)
                    if close < 0:
                        return self.fail()
                    at = close + 1
                    continue
                break
            if c == "\\":
                at += 2
            elif c == "'":
                close = text.find("'", at + 1)
                if close < 0:
                    return self.fail()
                at = close + 1
            elif text.startswith("$'", at):
                m = re.compile(r"(?s)\$'(?:[^'\\]|\\.)*'").match(text, at)
                if not m:
                    return self.fail()
                at = m.end()
            elif c == '"':
                at = self.quoted(at + 1)
            elif c == "`":
                m = re.compile(r"(?s)`(?:[^`\\]|\\.)*`").match(text, at)
                if not m:
                    return self.fail()
                at = m.end()
            elif c == "$":
                at = self.dollar(at)
            else:
                at += 1
        return min(at, self.n)

    def quoted(self, at: int) -> int:
        text = self.text
        while at < self.n and not self.broken:
            c = text[at]
            if c == '"':
                return at + 1
            if c == "\\":
                at += 2
            elif c == "$":
                at = self.dollar(at)
            elif c == "`":
                m = re.compile(r"(?s)`(?:[^`\\]|\\.)*`").match(text, at)
                if not m:
                    return self.fail()
                at = m.end()
            else:
                at += 1
        return self.n if self.broken else self.fail()

    def dollar(self, at: int) -> int:
        text = self.text
        if text.startswith("$((", at) and (close := self.arithmetic(at + 3)) is not None:
            return close
        if text.startswith("$(", at):
            return self.substitution(at + 2)
        if text.startswith("${", at):
            return self.braces(at + 2)
        return at + 1

    def braces(self, at: int) -> int:
        text = self.text
        while at < self.n and not self.broken:
            c = text[at]
            if c == "}":
                return at + 1
            if c == "\\":
                at += 2
            elif c == "'":
                close = text.find("'", at + 1)
                at = at + 1 if close < 0 else close + 1
            elif c == '"':
                at = self.quoted(at + 1)
            elif c == "$":
                at = self.dollar(at)
            else:
                at += 1
        return self.n if self.broken else self.fail()

    def substitution(self, at: int) -> int:
        self.t.add("$(", 1, "$(")
        at = self.commands(at, True)
        if self.broken:
            return self.n
        self.t.add(")", -1, "$(")
        return at + 1

    def array(self, at: int) -> int:
        text, t = self.text, self.t
        t.add("=(", 1, "=(")
        while at < self.n and not self.broken:
            c = text[at]
            if c in " \t":
                at += 1
            elif c == "\n":
                t.add("nl")
                at += 1
            elif c == "#" and text[at - 1] in " \t\n(":
                while at < self.n and text[at] != "\n":
                    at += 1
            elif c == ")":
                t.add(")", -1, "=(")
                return at + 1
            elif c in ";&|<>(":
                return self.fail()
            else:
                at = self.word(at)
        return self.n if self.broken else self.fail()


def lex_bash(text: str) -> Tokens:
    return _Bash(text).run()


# --- Python ------------------------------------------------------------------------------------------------------

PYTHON_WORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield match case type".split()
)
_PYTHON = re.compile(
    r"""(?P<space>[ \t\f]+|\\(?:\r\n|\r|\n)|\#[^\r\n]*)|(?P<nl>\r\n|\r|\n)
    |(?P<str>(?i:(?P<lead>[bfrut]|br|rb|fr|rf|tr|rt)?)(?P<quote>\"\"\"|\'\'\'|"|'))
    |(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    |(?P<id>[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]*)|(?P<assignop>\*\*=|//=|>>=|<<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=)
    |(?P<op>\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^~<>=,:;.(){}\[\]])""",
    re.X,
)
#: A decimal integer may not begin with 0 unless it is 0.
_OLD_OCTAL = re.compile(r"0[\d_]*[1-9][\d_]*")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b|[^\w]|$")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_ESCAPE = re.compile(r"\\(?s:N\{(?P<name>[^{}]+)\}|(?P<bad>x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!(?:000[\da-fA-F]|0010)[\da-fA-F]{4})|N)|.)")
_BLANK = re.compile(r"[ \t\f]*")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")


class _Python:
    """Tokens of Python, indentation and replacement fields of f-strings included: ``indent`` and ``dedent``, and ``f(`` .. ``f)`` around
    fields ``f{`` .. ``f}``, whose format follows ``f:``."""

    def __init__(self, text: str):
        self.text, self.n, self.t, self.levels = text, len(text), Tokens(), [(0, 0)]

    def error(self, at: int) -> int:
        self.t.add("error")
        return at + 1

    def run(self) -> Tokens:
        text, t = self.text, self.t
        at, fresh, decorated = int(text.startswith("\ufeff")), True, False
        self.depth = 0
        while at < self.n:
            if fresh and self.depth == 0:
                m = _BLANK.match(text, at)
                rest = text[m.end() : m.end() + 1]
                if rest in ("", "#", "\r", "\n"):
                    stop = _LINE.match(text, at).end()
                    at = stop if stop > at else self.n
                    continue
                self.indentation(m.group())
                if len(self.levels) == 1 and t.cls and not decorated and not _GOES_ON.match(text, m.end()):
                    t.end[-1] = True
                decorated = rest == "@" and len(self.levels) == 1
                at, fresh = m.end(), False
            if text[at] in "\r\n" and self.depth == 0:
                at = _PYTHON.match(text, at).end()
                t.add("nl")
                fresh = True
                continue
            at = self.token(at)
        if t.cls and t.cls[-1] not in ("nl", "dedent"):
            t.add("nl")
        for _ in self.levels[1:]:
            t.add("dedent")
        return t

    def indentation(self, blank: str) -> None:
        # A form feed begins the column anew; tabs must mean the same for tab stops of eight and of one.
        blank = blank.rpartition("\f")[2]
        wide = narrow = 0
        for c in blank:
            wide, narrow = (wide // 8 * 8 + 8 if c == "\t" else wide + 1), narrow + 1
        top = self.levels[-1]
        if (wide > top[0]) != (narrow > top[1]) or (wide == top[0]) != (narrow == top[1]):
            self.t.add("error")
        elif wide > top[0]:
            self.levels.append((wide, narrow))
            self.t.add("indent")
        else:
            while self.levels[-1][0] > wide:
                self.levels.pop()
                self.t.add("dedent")
            if self.levels[-1] != (wide, narrow):
                self.t.add("error")

    def token(self, at: int) -> int:
        """Take one token, or white space, from ``at`` on; the place after it."""
        text, t = self.text, self.t
        if text[at] in "<>=|" and _line_start(text, at) and (m := _CONFLICT.match(text, at)):
            t.add("conflict")
            return m.end()
        m = _PYTHON.match(text, at)
        if not m:
            return self.error(at)
        what, s = m.lastgroup, m.group()
        if what in ("space", "nl"):
            # A line that is joined to nothing.
            if s[0] == "\\" and m.end() == self.n:
                t.add("error")
            return m.end()
        if m.group("str") is not None:
            return self.string(m)
        if what == "num":
            t.add("num" if not _OLD_OCTAL.fullmatch(s) and _AFTER_NUMBER.match(text, m.end()) else "error")
        elif what == "id":
            t.add(s if s in PYTHON_WORDS or s == "_" else "id")
        elif what == "op":
            self.depth = max(0, self.depth + (s in OPEN) - (s in CLOSE))
            t.punct(s)
        else:
            t.add(what)
        return m.end()

    def string(self, m) -> int:
        lead, quote, at = (m.group("lead") or "").lower(), m.group("quote"), m.end()
        if "f" in lead or "t" in lead:
            self.t.add("f(")
            end = self.formatted(at, quote, "r" in lead, None)
            self.t.add("f)" if end is not None else "error")
            return self.n if end is None else end
        start = at
        while True:
            if at >= self.n or (len(quote) == 1 and self.text[at] in "\r\n"):
                return self.error(self.n if at >= self.n else at)
            if self.text[at] == "\\":
                at += 3 if self.text.startswith("\r\n", at + 1) else 2
            elif self.text.startswith(quote, at):
                break
            else:
                at += 1
        body = self.text[start:at]
        sound = (body.isascii() if "b" in lead else True) and ("r" in lead or self.escapes(body, "b" in lead))
        self.t.add(("bytes" if "b" in lead else "str") if sound else "error")
        return at + len(quote)

    def escapes(self, body: str, raw_bytes: bool) -> bool:
        for m in _ESCAPE.finditer(body) if "\\" in body else ():
            if m.group("bad") and (not raw_bytes or m.group("bad") == "x"):
                return False
            if m.group("name") and not raw_bytes:
                try:
                    unicodedata.lookup(m.group("name"))
                except KeyError:
                    return False
        return True

    def formatted(self, at: int, quote: str, raw: bool, spec: int | None) -> int | None:
        """The literal parts and fields up to the closing quote, or of a format up to the field's brace. None where there is no end.

        ``spec`` is the nesting of a format.
        """
        text, literal = self.text, at
        while at < self.n:
            c = text[at]
            if c in "\r\n" and len(quote) == 1 and spec is None:
                return None
            if text.startswith(quote, at) and spec is None:
                if not raw and not self.escapes(text[literal:at], False):
                    self.t.add("error")
                return at + len(quote)
            if text.startswith(quote, at):
                return None
            if spec is not None and c == "}":
                return at
            if c == "\\" and not raw:
                if text.startswith("\\N{", at) and "}" in text[at:]:
                    at = text.index("}", at) + 1
                else:
                    at += 3 if text.startswith("\r\n", at + 1) else 1 if text[at + 1 : at + 2] in "{}" else 2
            elif c == "\\" and raw:
                at += 1 if text[at + 1 : at + 2] in "{}" else 2
            elif c == "{" and text.startswith("{{", at) and spec is None:
                at += 2
            elif c == "{":
                if not raw and not self.escapes(text[literal:at], False):
                    self.t.add("error")
                end = self.field(at + 1, quote, raw, 0 if spec is None else spec)
                if end is None:
                    return None
                at = literal = end
            elif c == "}":
                if not text.startswith("}}", at):
                    self.t.add("error")
                at += 2
            else:
                at += 1
        return None

    def field(self, at: int, quote: str, raw: bool, nesting: int) -> int | None:
        t, text, outer = self.t, self.text, self.depth
        t.add("f{", 1, "{")
        self.depth = outer + 1
        while at < self.n:
            c = text[at]
            if self.depth == outer + 1:
                if c == "}":
                    break
                if c == "!" and text[at + 1 : at + 2] != "=":
                    t.add("!")
                    at += 1
                    continue
                if c == ":":
                    t.add("f:")
                    stop = self.formatted(at + 1, quote, raw, nesting + 1) if nesting < 2 else None
                    if stop is None:
                        self.depth = outer
                        return None
                    at = stop
                    break
            at = self.token(at)
        self.depth = outer
        if at >= self.n:
            return None
        t.add("f}", -1, "{")
        return at + 1


def lex_python(text: str) -> Tokens:
    return _Python(text).run()


def lex(language: str, text: str) -> Tokens:
    if language == "rust":
        return lex_rust(text)
    if language in ("javascript", "typescript"):
        return lex_script(text, language == "typescript")
    return lex_bash(text) if language == "bash" else lex_python(text)
