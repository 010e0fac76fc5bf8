"""Lexers that run on pieces of a source file.

A piece is lexed from an entry state (code, or within a comment or string that spans lines) to an exit state; its
brackets are summed up as the closers it lacks openers for and the openers it leaves open. State maps and bracket
summaries of neighbouring pieces combine associatively (:func:`combine`), so a long file is checked piece by piece.
"""

from __future__ import annotations

import re
from functools import lru_cache

CODE = "code"
PAIRS = {")": "(", "]": "[", "}": "{"}
#: words that open a block which ``end`` closes
BLOCKS = frozenset("class module def begin case for if unless while until do".split())

#: Keywords of each language that cannot be an operand.
KEYWORDS = {
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set from as null true false",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits non yield",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while async await var get set init record partial where select from orderby group into join let on equals by ascending descending when with yield required file scoped global add remove",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool bool",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while macro_rules default",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield from int string float bool void null self mixed",
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False",
    "ruby": "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " interface type enum namespace declare abstract implements private protected public readonly keyof infer is asserts satisfies module override unique string number boolean any unknown never object symbol bigint"
KEYWORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_SPACE = re.compile(r"[ \t\r\f\v ﻿]*")
_NUMBER = r"0[xX][0-9a-fA-F_]+[a-zA-Z]*|0[bB][01_]+[a-zA-Z]*|0[oO][0-7_]+|(?:\d[\d_]*\.(?!\.)\d[\d_]*|\d[\d_]*\.(?![\w.])|\d[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?:[a-zA-Z]\w*)?"
_ID = r"[^\W\d]\w*"
_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_C_OPS = r"<<=|>>>=|>>=|\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|\?\?|\?\.(?!\d)|->|=>|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|\*\*|[-+*/%=<>!&|^~?:;,.@]"


def _spec(comment: str, strings: str, ops: str = _C_OPS, ident: str = _ID, block: bool = True) -> dict:
    parts = [f"(?P<c>{comment})", *([f"(?P<s>{strings})"] if strings else []), f"(?P<i>{ident})", f"(?P<n>{_NUMBER})", f"(?P<o>{ops})", r"(?P<k>[()\[\]{}])"]
    return {"re": re.compile("|".join(parts)), "block": block}


#: Tokens within a line; what may span lines is in _OPENERS.
SPECS = {
    "javascript": _spec(r"//[^\n]*|\A#![^\n]*", f"{_DQ}|{_SQ}", ident=r"#?[^\W\d][\w$]*|\$[\w$]*"),
    "java": _spec(r"//[^\n]*", f"{_DQ}|{_SQ}", ident=r"[^\W\d][\w$]*|\$\w+"),
    "csharp": _spec(r"//[^\n]*|(?:(?<=\n)|\A)[ \t]*#[^\n]*", rf"\$?{_DQ}|{_SQ}", ident=r"@?[^\W\d]\w*"),
    "c": _spec(r"//[^\n]*|(?:(?<=\n)|\A)[ \t]*#(?:\\\r?\n|[^\n])*", rf"(?:L|u8|u|U)?{_DQ}|{_SQ}"),
    "go": _spec(r"//[^\n]*", f"{_DQ}|{_SQ}", ops=r"<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||&\^|[=!<>+\-*/%&|^]=|[-+*/%=<>!&|^~:;,.]"),
    "rust": _spec(r"//[^\n]*|\A#![^\[\n][^\n]*", r"b?'(?:\\.[^']*|[^\\'\n])'", ops=r"'[^\W\d]\w*|<<=|>>=|\.\.\.|\.\.=|\.\.|->|=>|::|&&|\|\||[=!<>+\-*/%&|^]=|[-+*/%=<>!&|^~?:;,.@#$]"),
    "php": _spec(r"//[^\n]*|#(?!\[)[^\n]*", "", ops=r"<=>|\?->|" + _C_OPS + r"|\\|#", ident=r"\$?[^\W\d]\w*"),
    "ruby": _spec(r"#[^\n]*", r":\"[^\"\n]*\"|(?<![:\w)\]]):[^\W\d]\w*[?!=]?(?![\w])", ops=r"<=>|===|=~|!~|\.\.\.|&\.|\*\*=|\|\|=|&&=|<<=|>>=|<<|>>|\*\*|->|=>|::|\.\.|&&|\|\||[=!<>+\-*/%&|^]=|[-+*/%=<>!&|^~?:;,.]", ident=r"(?:@@|@|\$)?[^\W\d]\w*(?:[?!](?!=))?|\$[^\w\s]", block=False),
    "python": _spec(r"#[^\n]*", "", ops=r"\*\*=|//=|<<=|>>=|\.\.\.|:=|->|\*\*|//|<<|>>|[=!<>+\-*/%&|^@]=|[-+*/%=<>!&|^~:;,.@$?`]", block=False),
}
SPECS["typescript"] = SPECS["javascript"]

_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_REGEX = re.compile(r"/(?![*/ \t]?\n)(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = frozenset("( [ { } ; , = : ? ! & | + - * % < > ~ ^ && || => return typeof case in of == === != !== += -= ?? && ! delete void throw new else do if unless while until when and or not then elsif =~ !~".split())
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}

#: Literals and comments that may span lines, by language: what opens one and the state within it.
_OPENERS = {
    "java": [(re.compile('"""'), lambda m: 'text"""')],
    "csharp": [(re.compile(r'\$*("{3,})'), lambda m: f"raw{len(m[1])}"), (re.compile(r'(?:\$@|@\$|@)"'), lambda m: "verbatim")],
    "go": [(re.compile("`"), lambda m: "tick")],
    "rust": [(re.compile(r'b?r(#*)"'), lambda m: f"hash{len(m[1])}"), (re.compile('b?"'), lambda m: 'str"')],
    "php": [(re.compile(r"<<<[ \t]*([\"']?)(\w+)\1[ \t]*\n"), lambda m: f"doc:{m[2]}"), (re.compile("[\"']"), lambda m: f"str{m[0]}")],
    "ruby": [(re.compile("[\"'`]"), lambda m: f"str{m[0]}"), (re.compile(r"%[wWiIqQ]?([\[({<])"), lambda m: f"pct{_CLOSING[m[1]]}")],
    "python": [(re.compile(r"[rRbBuUfFtT]{0,2}(\"\"\"|''')"), lambda m: f"str{m[1]}"), (re.compile(r"[rRbBuUfFtT]{0,2}([\"'])"), lambda m: f"line{m[1]}")],
}
_FIRST = {"java": '"', "csharp": '"$@', "go": "`", "rust": 'br"', "php": "<\"'", "ruby": "\"'`%", "python": "rRbBuUfFtT\"'"}
_HEREDOC = re.compile(r"<<[~-]?([\"']?)([A-Z_]\w*)\1")
_RUBY_LINE = re.compile(r"(=begin\b|__END__[ \t]*(?:\n|\Z))")


@lru_cache(maxsize=512)
def _close(state: str) -> re.Pattern:
    """What ends a literal or comment, matched from within it; of line states only an escaped line end goes on."""
    if state == "block":
        return re.compile(r"[\s\S]*?\*/")
    if state in ('text"""', 'str"""', "str'''"):
        return re.compile(rf"(?:\\[\s\S]|[^\\])*?{state[-3:]}")
    if state.startswith("raw"):
        return re.compile(rf'[\s\S]*?"{{{state[3:]}}}')
    if state == "verbatim":
        return re.compile(r'(?:""|[^"])*"(?!")')
    if state == "tick":
        return re.compile("[^`]*`")
    if state.startswith("hash"):
        return re.compile(rf'[\s\S]*?"#{{{state[4:]}}}')
    if state.startswith("str"):
        q = state[3:]
        return re.compile(rf"(?:\\[\s\S]|[^{q}\\])*{q}")
    if state.startswith("line"):
        q = state[4:]
        return re.compile(rf"(?:\\[\s\S]|[^{q}\\\n])*{q}")
    if state.startswith("pct"):
        q = re.escape(state[3:])
        return re.compile(rf"[^{q}]*{q}")
    if state.startswith("doc:"):
        return re.compile(rf"(?:[^\n]*\n)*?[ \t]*{re.escape(state[4:])}(?=\W|\Z)")
    if state == "begin":
        return re.compile(r"(?:[^\n]*\n)*?=end[^\n]*")
    return re.compile(r"(?!)")


def states(language: str, text: str) -> list[str]:
    """Entry states that a later piece of this text can have: those of the language, with the marks the text holds."""
    out = [CODE]
    if SPECS[language]["block"]:
        out += [f"block{d}" for d in (1, 2, 3)] if language == "rust" else ["block"]
    if language in ("javascript", "typescript") and "`" in text:
        out += ["`", *(f"sub{j}" for j in range(4))]
    for rx, name in _OPENERS.get(language, ()):
        out += sorted({name(m) for m in rx.finditer(text)})
    if language == "ruby":
        out += sorted({f"doc:{m[2]}" for m in _HEREDOC.finditer(text)}) + [s for s, w in (("begin", "=begin"), ("end", "__END__")) if w in text]
    return out


def _nested(text: str, pos: int, depth: int) -> tuple[int, int]:
    """Where a nesting block comment ends, and how many are open there."""
    while depth and pos < len(text):
        a, b = text.find("/*", pos), text.find("*/", pos)
        if b < 0:
            return len(text), depth + (text.count("/*", pos) if a >= 0 else 0)
        if 0 <= a < b:
            depth, pos = depth + 1, a + 2
        else:
            depth, pos = depth - 1, b + 2
    return pos, depth


def lex(text: str, language: str, state: str = CODE, stack: list[str] | None = None, before: str = "") -> dict:
    """Tokens ``(kind, value, line break before)`` with their offsets, exit state, bracket summary, first lexical error.

    kinds: i identifier, k keyword, n number, s string, o operator, b bracket, p directive. ``open`` are the brackets
    that the text leaves open (template marks of JavaScript included), ``close`` those that it lacks openers for.
    ``stack`` are the brackets open before, if known. If not, ``unsure`` tells that a closing brace without an opener
    might close a substitution. ``before`` is the token before, which decides what a slash means.
    """
    spec, words = SPECS[language], KEYWORDS[language]
    match, space, n = spec["re"].match, _SPACE.match, len(text)
    out, at, own, closers, error, unsure = [], [], [], [], None, False
    js, rust, ruby, python = language in ("javascript", "typescript"), language == "rust", language == "ruby", language == "python"
    known = stack is not None
    under = list(stack) if known else ["`"] if state == "`" else ["`", "${"] + ["{"] * int(state[3:]) if state.startswith("sub") else []
    openers, first = _OPENERS.get(language, ()), _FIRST.get(language, "")
    pos, nl, exit_state, template, heredocs = 0, True, CODE, state == "`", []

    def leave(s: str, p: int) -> int:
        """Past the end of the literal or comment; -1 if it goes on after this text."""
        nonlocal exit_state
        if s.startswith("block") and rust:
            p, d = _nested(text, p, int(s[5:]))
            if d:
                exit_state = f"block{d}"
                return -1
            return p
        m = _close(s).match(text, p)
        if not m:
            exit_state = s
            return -1
        return m.end()

    inside = state if not (state == CODE or state == "`" or state.startswith("sub")) else ""
    if inside:
        pos = leave(inside, 0)
        if pos < 0 and not (inside.startswith("line") and not re.fullmatch(r"(?:\\[\s\S]|[^\\\n])*", text)):
            return {"tokens": out, "at": at, "exit": exit_state, "open": own, "close": closers, "error": None, "unsure": False, "last": before}
        if pos < 0:
            pos, exit_state, error = (text.find("\n") + 1 or n), CODE, "open line"
        if not inside.startswith(("block", "begin")):
            out.append(("s", inside[-1:], False))
            at.append(0)
    while True:
        if template:  # within a template literal
            pos = _TEMPLATE.match(text, pos).end()
            if pos >= n:
                exit_state = "`"
                break
            template = False
            if text[pos] == "`":
                if own:
                    own.pop()
                else:
                    closers.append("`")
                    if under:
                        under.pop()
                out.append(("s", "`", nl))
                at.append(pos)
                nl = False
                pos += 1
            else:
                own.append("${")
                out.append(("o", "${", False))
                at.append(pos)
                pos += 2
            continue
        pos = space(text, pos).end()
        if pos >= n:
            break
        ch = text[pos]
        if ch == "\n":
            nl = True
            pos += 1
            if heredocs:
                s = f"doc:{heredocs.pop(0)}"
                if (p := leave(s, pos)) < 0:
                    break
                pos = p
            continue
        if ch == "\\" and text[pos + 1 : pos + 2] in "\r\n":
            pos += 2
            continue
        if js and ch == "`":
            own.append("`")
            template = True
            pos += 1
            continue
        if ch in first:
            hit = None
            for rx, name in openers:
                if (m := rx.match(text, pos)) is not None:
                    hit = name(m)
                    break
            if hit and not (hit.startswith("pct") and out and (out[-1][0] in ("i", "n", "s") or out[-1][1] in (")", "]", "}")) and text[pos + 1 : pos + 2] not in "wWiIqQ"):
                p = leave(hit, m.end())
                if p < 0 and not hit.startswith("line"):
                    break
                if p < 0:
                    rest = re.compile(r"(?:\\[\s\S]|[^\\\n])*").match(text, m.end()).end()
                    if rest >= n and text.endswith("\\\n"):
                        break
                    exit_state, p, error = CODE, rest, error or "open string"
                out.append(("s", hit[-1:], nl))
                at.append(pos)
                nl = False
                pos = p
                continue
        if ruby and nl and (ch == "=" or ch == "_") and (pos == 0 or text[pos - 1] == "\n") and (m := _RUBY_LINE.match(text, pos)):
            if (p := leave("begin" if ch == "=" else "end", m.end())) < 0:
                break
            pos = p
            continue
        if ruby and ch == "<" and (m := _HEREDOC.match(text, pos)) and not (out and out[-1][0] in ("n",)) and not (out and out[-1][1] == "class"):
            heredocs.append(m[2])
            out.append(("s", "<<", nl))
            at.append(pos)
            nl = False
            pos = m.end()
            continue
        if ch == "/" and (js or ruby) and text[pos + 1 : pos + 2] not in ("/", "*") and ((not out and (not before or before in _BEFORE_REGEX)) or (out and out[-1][1] in _BEFORE_REGEX and out[-1][0] != "s")):
            m = _REGEX.match(text, pos)
            if m:
                out.append(("s", "/", nl))
                at.append(pos)
                nl = False
                pos = m.end()
                continue
        if ch == "/" and spec["block"] and text.startswith("/*", pos):
            p = leave("block1" if rust else "block", pos + 2)
            if p < 0:
                break
            if "\n" in text[pos:p]:
                nl = True
            pos = p
            continue
        m = match(text, pos)
        if not m:
            error = error or f"character {ch!r}"
            pos += 1
            continue
        kind, value = m.lastgroup, m.group()
        start, pos = pos, m.end()
        if kind == "c":
            if value[:1] in "# \t" and language == "c":
                out.append(("p", value, True))
                at.append(start)
            continue
        if kind == "k":
            kind = "b"
            if value in "([{":
                own.append(value)
            elif own:
                if value == "}" and own[-1] == "${":
                    own.pop()
                    template = True
                    out.append(("o", "}$", False))
                    at.append(start)
                    continue
                if own.pop() != PAIRS[value]:
                    error = error or f"bracket {value}"
            elif value == "}" and under and under[-1] == "${":
                under.pop()
                closers.append("}$")
                template = True
                out.append(("o", "}$", False))
                at.append(start)
                continue
            else:
                closers.append(value)
                if under and (known or value == "}"):
                    if under[-1] == PAIRS[value]:
                        under.pop()
                elif js and value == "}" and not known:
                    unsure = True
        elif kind == "i" and value in words:
            kind = "k"
        out.append((kind, value, nl))
        at.append(start)
        nl = False
    if heredocs and exit_state == CODE:
        exit_state = f"doc:{heredocs[0]}"
    if exit_state == CODE and js:
        full = under + own
        if "${" in full:
            exit_state = f"sub{full[len(full) - full[::-1].index('${') :].count('{')}"
    if ruby:
        own, closers = balance(out, language)
    return {"tokens": out, "at": at, "exit": exit_state, "open": own, "close": closers, "error": error, "unsure": unsure, "last": out[-1][1] if out else before}


def ruby_blocks(tokens: list):
    """(index, word, opens) of the keywords that open and close blocks of Ruby."""
    loop, n = False, len(tokens)
    for i, (kind, value, nl) in enumerate(tokens):
        prev = tokens[i - 1] if i else (None, None, True)
        if nl:
            loop = False
        if kind != "k" or prev[1] in (".", "&.", "::", "def"):
            continue
        if i + 1 < n and tokens[i + 1][1] == ":" and (prev[1] in ("{", ",", "(") or nl):
            continue  # a key
        if value == "def":
            j = i + 1
            while j < n and not tokens[j][2] and tokens[j][1] != "(":
                j += 1
            if j < n and tokens[j][1] == "(":
                d = 0
                while j < n:
                    d += (tokens[j][1] == "(") - (tokens[j][1] == ")")
                    j += 1
                    if not d:
                        break
                if j < n and tokens[j][1] == "=" and not tokens[j][2]:
                    continue  # a method without a block
            yield i, value, True
        elif value in ("class", "module", "begin", "case", "for"):
            loop = value == "for"
            yield i, value, True
        elif value in ("if", "unless", "while", "until") and ruby_start(tokens, i):
            loop = value in ("while", "until")
            yield i, value, True
        elif value == "do":
            if not loop:
                yield i, value, True
            loop = False
        elif value == "end":
            yield i, value, False


_STARTS = frozenset("; then do else begin | = ( { [ << ||= && || and or not ! -> ensure".split())


def ruby_start(tokens: list, i: int) -> bool:
    """Whether a statement or an operand starts at token i."""
    prev = tokens[i - 1] if i else (None, None, True)
    return i == 0 or (tokens[i][2] and not (prev[0] == "o" and prev[1] not in ("!", "?"))) or prev[1] in _STARTS


def balance(tokens: list, language: str) -> tuple[list[str], list[str]]:
    """Brackets, block keywords and template marks that tokens leave open, and closers without an opener."""
    events = {i: (w, opens) for i, w, opens in ruby_blocks(tokens)} if language == "ruby" else {}
    own, closers = [], []
    for i, (kind, value, _) in enumerate(tokens):
        if i in events:
            word, opens = events[i]
        elif kind == "b":
            word, opens = value, value in "([{"
        elif kind == "o" and value in ("${", "}$"):
            word, opens = value, value == "${"
        else:
            continue
        if opens:
            own.append(word)
        elif own:
            own.pop() if pairs(own[-1], word) else own.append(word)  # a mismatch stays and is told at the end
        else:
            closers.append(word)
    return own, closers


def pairs(opener: str, closer: str) -> bool:
    return {"end": opener in BLOCKS, "}$": opener == "${", "`": opener == "`"}.get(closer, opener == PAIRS.get(closer))


def summary(text: str, language: str, entries: list[str]) -> dict:
    """State map of one piece: entry state -> exit state, brackets, error."""
    out = {}
    for s in entries:
        r = lex(text, language, s)
        out[s] = {k: r[k] for k in ("exit", "open", "close", "error", "unsure")}
    return out


def join(x: dict, y: dict) -> dict:
    """What two neighbouring stretches do together, the second entered in the state in which the first is left."""
    opened, closed, error, i = list(x["open"]), y["close"], x["error"] or y["error"], 0
    while opened and i < len(closed):
        if not pairs(opened.pop(), closed[i]):
            error = error or f"bracket {closed[i]}"
        i += 1
    return {"exit": y["exit"], "open": opened + y["open"], "close": x["close"] + closed[i:], "error": error, "unsure": x["unsure"] or (y["unsure"] and "${" in x["open"])}


def combine(a: dict, b: dict) -> dict:
    """The state map of two neighbouring pieces, an associative operation."""
    return {s: join(x, b[x["exit"]]) if x["exit"] in b else x | {"unsure": True} for s, x in a.items()}


def verdict(x: dict) -> str | None:
    """What is wrong with a file, by what its pieces do together from the state of code."""
    if x["error"]:
        return x["error"]
    if x["exit"] not in (CODE, "end"):
        return f"open {x['exit']}"
    if x["close"] or x["open"]:
        return f"unbalanced {' '.join(x['close'] or x['open'])[:20]}"
    return None


def pieces(text: str, size: int) -> list[str]:
    """Cut at line ends, so that no token that must stay within its line is split."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size) + 1
        if cut <= at:
            cut = text.find("\n", at + size) + 1 or len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out
