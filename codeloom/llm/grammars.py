"""Local grammars: what the statements of a file with balanced brackets must look like.

Each check looks at neighbouring tokens, at what starts a statement and at how it ends. Python is parsed by its own
grammar. The grammars reject what no parser of the language accepts; they do not claim to be complete.
"""

from __future__ import annotations

import ast
import re
import warnings

from codeloom.llm.lexers import ruby_blocks, ruby_start

_OPERAND = ("i", "n", "s")
_BINARY = frozenset("= += -= *= /= %= == != === !== && || + / % . ?? |= &= ^= <<= >>= -> => <= >= << ~ =~ !~ := ** **=".split())
_STATEMENT = frozenset("return if for while try throw switch break continue foreach do goto".split())
#: What may start a declaration at the top of a file.
_TOP = {
    "java": frozenset("package import class interface enum record abstract final public private protected static strictfp sealed non @ ; module open default synchronized".split()),
    "go": frozenset("package import func type var const ;".split()),
    "rust": frozenset("use pub fn struct enum impl trait mod const static type extern unsafe async macro_rules union crate # ; let auto default".split()),
}
_NEEDS_PAREN = {
    "javascript": frozenset("if while switch for".split()),
    "java": frozenset("if while switch for catch synchronized".split()),
    "csharp": frozenset("if while switch for foreach lock".split()),
    "c": frozenset("if while switch for".split()),
    "php": frozenset("if while switch for foreach elseif catch".split()),
}
_NEEDS_PAREN["typescript"] = _NEEDS_PAREN["javascript"]
#: keywords after which an operand may follow without an operator, for languages that do not put types before names
_JS_LEADS = frozenset(
    "async await case class const default delete do else export extends function from get if import in instanceof let new of return set static throw typeof var void while with yield as interface type enum namespace declare abstract implements private protected public readonly keyof infer is asserts satisfies module override unique for catch finally try".split()
)


def python(text: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return f"python: {getattr(e, 'msg', e)}"[:80]
    except (RecursionError, MemoryError):
        return None
    return None


def _neighbours(tokens: list, language: str) -> str | None:
    """Operators without operands, operands without operators, keywords without their bracket."""
    js, c, ruby, php, go, rust = language in ("javascript", "typescript"), language == "c", language == "ruby", language == "php", language == "go", language == "rust"
    typed = language in ("java", "csharp", "c")
    paren = _NEEDS_PAREN.get(language, ())
    prev_kind = prev = before = before_kind = None
    for i, (kind, value, nl) in enumerate(tokens):
        if kind == "p":
            continue
        name_like = prev == "." or prev == "?." or prev == "->" or prev == "::" or prev == "?->"
        if kind == "k" and name_like:
            kind = "i"
        if prev_kind in _OPERAND and kind in _OPERAND:
            both_strings = prev_kind == "s" and kind == "s"
            if js:
                if not nl and not (both_strings and (value == "`" or prev == "`")) and not (kind == "s" and value[:1] == "`"):
                    if not (prev == "}$" or prev_kind == "i" and prev in _JS_LEADS):
                        return f"{prev} {value}"
            elif prev_kind == "n" or (kind == "n" and not (ruby and prev_kind == "i") and not rust):
                if not (ruby or go) or not nl:
                    return f"{prev} {value}"
            elif both_strings:
                if not (c or ruby or go and nl):
                    return "two strings"
            elif prev_kind == "s":
                if not (ruby or go) or not nl:
                    if not (c and re.fullmatch(r"[A-Z_][A-Za-z0-9_]*", value)):
                        return f"string {value}"
            elif kind == "s":
                if not ruby and not (c and re.fullmatch(r"[A-Z_][A-Za-z0-9_]*", prev)) and not go and not (rust and value[:1] == "'"):
                    return f"{prev} string"
            elif php or (go and not nl and before in ("=", ":=", "+", "return", "==")) or (rust and prev not in ("union", "auto", "default", "dyn", "macro_rules")):
                # PHP puts a type before a variable
                if not (go and nl) and not (php and prev[:1] != "$"):
                    return f"{prev} {value}"
        elif kind == "k" and value in _STATEMENT and prev_kind in _OPERAND and not name_like:
            if typed or php:
                if not (language == "csharp" and value == "switch"):  # an expression there
                    return f"{prev} {value}"
            elif js and not nl:
                return f"{prev} {value}"
        elif typed and kind == "o" and value == "." and prev_kind == "i" and before_kind in ("i",) and before != "." and not nl:
            return f"{before} {prev} ."
        if kind in ("b", "o") and value in (")", "]", "}", ";", ",") and prev_kind == "o" and prev in _BINARY:
            if not (value == "," and ruby) and not (rust and prev in ("=>", "..", "=")) and not (language == "csharp" and prev in ("==", "!=", "+", "/", "%", "<=", ">=", "<<", "~", "&&", "||")) and not (prev == "." and language == "go" and value == ")") and not (js and prev == "/"):
                return f"{prev} {value}"
        if value in paren and kind == "k":
            nxt = next(((k, v) for k, v, _ in tokens[i + 1 : i + 3] if k != "p"), ("", ""))
            if nxt[1] != "(" and not (value == "catch" and nxt[1] == "{") and not (value == "for" and nxt[1] == "await") and not (nxt[1] in (":", "=", ",", ")", ";", "?", "=>", ".") and js) and not (language == "csharp" and value == "switch" and nxt[1] == "{"):
                return f"{value} without ("
        if value in ("<<<<<<<", ">>>>>>>"):
            return "conflict"
        before, before_kind = prev, prev_kind
        prev_kind, prev = kind, value
    if prev_kind == "o" and prev in _BINARY and not (ruby and prev == "=>"):
        return f"{prev} at the end"
    return None


def _conflict(tokens: list) -> str | None:
    """Marks of a merge conflict: seven of one operator character at the start of a line, outside comments and strings."""
    run = ""
    for kind, value, nl in tokens:
        run = (value if nl else run + value) if kind == "o" and (nl or run) else ""
        if len(run) >= 7 and len(set(run)) == 1 and run[0] in "<>=|":
            return "conflict"
    return None


def _semicolons(tokens: list, language: str) -> str | None:
    """Statements end in ; or a block, within blocks and at the top."""
    stack = [["block", True]]  # what a bracket holds, whether its last statement has ended
    last = ""
    for i, (kind, value, _) in enumerate(tokens):
        if kind == "p":
            continue
        top = stack[-1]
        if kind == "b" and value == "{":
            enum = _head_has(tokens, i, "enum")
            listy = last in ("=", ",", "(", "[", "{", "return", "]", ":", "?", "??", "with", "switch") and not (last == ":" and top[0] == "block") and not (last == "{" and top[0] == "block")
            listy = listy or (top[0] == "list" and last not in (")", "=>", "->")) or (language == "csharp" and last != "=>" and _head_has(tokens, i, "new") and not any(_head_has(tokens, i, w) for w in ("class", "struct", "interface", "record", "where"))) or (language == "php" and _head_has(tokens, i, "match"))
            listy = listy or (language == "c" and last == ")" and _cast_before(tokens, i))
            stack.append(["enum" if enum else "list" if listy else "block", True])
        elif kind == "b" and value == "}":
            if len(stack) < 2:  # it closes a block that an earlier statement opened
                if not top[1]:
                    return "statement without ;"
                top[1] = True
                last = value
                continue
            what, ended = stack.pop()
            if what == "block" and not ended:
                return "statement without ;"
            stack[-1][1] = what == "block" or (what == "enum" and language != "c")
        elif kind == "b" and value in "([":
            stack.append(["paren", True])
            top[1] = False
        elif kind == "b" and value in ")]":
            if len(stack) > 1:
                stack.pop()
            stack[-1][1] = language == "csharp" and value == "]" and _attribute(tokens, i)
        elif value == ";" or (value == ":" and top[0] == "block" and _label(tokens, i)):
            top[1] = True
        else:
            top[1] = False
        last = value
    return None if stack[-1][1] else "statement without ; at the end"


def _head_has(tokens: list, i: int, word: str, most: int = 24) -> bool:
    """Whether the statement that leads to the brace at i has the word, back to the last ; or brace."""
    depth = 0
    for k in range(i - 1, max(-1, i - 1 - most), -1):
        kind, value, _ = tokens[k]
        if value in (")", "]") and kind == "b":
            depth += 1
        elif value in ("(", "[") and kind == "b":
            if not depth:
                return False
            depth -= 1
        elif not depth and (value in (";", "{", "}", "=>", "->") and kind in "ob"):
            return False
        elif not depth and value == word and kind in ("k", "i"):
            return True
    return False


def _cast_before(tokens: list, i: int) -> bool:
    depth = 0
    for k in range(i - 1, max(-1, i - 12), -1):
        kind, value, _ = tokens[k]
        if value == ")":
            depth += 1
        elif value == "(":
            depth -= 1
            if not depth:
                return k > 0 and (tokens[k - 1][1] in ("=", ",", "(", "return", "&") or tokens[k - 1][0] == "o")
    return False


def _attribute(tokens: list, i: int) -> bool:
    depth = 0
    for k in range(i, -1, -1):
        kind, value, nl = tokens[k]
        if kind != "b":
            continue
        if value in (")", "]", "}"):
            depth += 1
        elif value in ("(", "[", "{"):
            depth -= 1
            if not depth:
                return nl and (k == 0 or tokens[k - 1][1] in ("{", "}", ";", "]", ","))
    return False


def _label(tokens: list, i: int) -> bool:
    """case x: and default: and labels, but not ?: """
    for k in range(i - 1, max(-1, i - 16), -1):
        kind, value, _ = tokens[k]
        if value in ("?", "{", "}", ";") and kind in "ob":
            return value != "?" and i - k == 2
        if value in ("case", "default"):
            return True
    return False


def _top_level(tokens: list, language: str, first: bool, depth: int) -> str | None:
    """Each declaration at the top starts as one; ``depth`` brackets are open before."""
    allowed = _TOP.get(language)
    start = not depth
    for i, (kind, value, nl) in enumerate(tokens):
        if not depth and start and kind != "p":
            if allowed and value not in allowed and not (language == "rust" and i + 1 < len(tokens) and tokens[i + 1][1] in ("!", "::")):
                return f"{value} at the top"
            if language == "go" and first and i == 0 and value != "package":
                return "no package"
            start = False
        if kind == "b":
            if value in "([{":
                depth += 1
            else:
                depth -= 1
                if not depth and value == "}" and language != "go":
                    start = not (i + 1 < len(tokens) and tokens[i + 1][1] in (";", "=", ","))
        elif not depth and value == ";":
            start = True
        if language == "go" and not depth and i + 1 < len(tokens) and tokens[i + 1][2] and (kind in ("i", "n", "s") or value in (")", "]", "}", "return")):
            start = True
    if language == "java":
        # an import or a package is a dotted name
        for i, (kind, value, _) in enumerate(tokens[:-1]):
            if kind == "k" and value in ("package", "import") and tokens[i + 1][0] not in ("i", "k"):
                return f"{value} without a name"
    return None


_NAMED = {
    "java": ("class", "interface", "enum"), "csharp": ("class", "interface", "struct", "enum", "namespace", "using"), "typescript": ("interface", "enum", "namespace"), "php": ("namespace", "interface", "trait"),
    "go": ("package", "func", "type"), "rust": ("fn", "struct", "enum", "trait", "mod"),
}


def _names(tokens: list, language: str) -> str | None:
    words = _NAMED.get(language, ())
    for i, (kind, value, _) in enumerate(tokens[:-1]):
        if kind == "k" and value in words and (i == 0 or tokens[i - 1][1] not in (".", "?.", "->", "::", "?->", ":", "<", ",", "(")):
            k, v, _n = tokens[i + 1]
            if v == "{" or k in ("n", "s"):
                if value == "class" or language == "php" and value == "namespace" or language == "go" and value in ("type",):
                    if value == "class" and language == "java" or language == "csharp" and value == "class":
                        return f"{value} without a name"
                    continue
                if language == "csharp" and value in ("enum", "struct") or language == "rust" and value in ("struct", "enum") or value in ("interface",):
                    if i and tokens[i - 1][1] in ("where", ":", ","):
                        continue
                return f"{value} without a name"
    return None


def _c_words(tokens: list) -> str | None:
    """At most two identifiers in a row (a type and a name); upper-case words may be macros."""
    row = 0
    for kind, value, _ in tokens:
        if kind == "i" and not re.fullmatch(r"[A-Z_][A-Z0-9_]*", value):
            row += 1
            if row > 2:
                return f"{value} after two names"
        elif kind == "p" or kind != "k":
            row = 0
    return None


_DIRECTIVES = re.compile(r"\s*#\s*(?:include|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|pragma|error|warning|line|embed|\d+|$)")


def _ruby(tokens: list, depth: int) -> str | None:
    """Names of classes and methods, words that only stand within blocks, labels and braces where a statement starts."""
    n, events = len(tokens), {i: (w, opens) for i, w, opens in ruby_blocks(tokens)}
    for i, (kind, value, nl) in enumerate(tokens):
        prev = tokens[i - 1] if i else (None, None, True)
        word, opens = events.get(i, (None, False))
        if word:
            depth += 1 if opens else -1
            if word in ("class", "module", "def") and opens and i + 1 < n and tokens[i + 1][2]:
                return f"{word} without a name"
            if word in ("class", "module") and i + 1 < n and tokens[i + 1][1] != "<<" and not (tokens[i + 1][0] == "i" and tokens[i + 1][1][:1].isupper() or tokens[i + 1][1] == "::"):
                return f"{word} without a name"
        elif kind == "k" and value in ("elsif", "when") and depth <= 0 and prev[1] not in (".", "&.", "::", "def"):
            return f"{value} outside"
        if ruby_start(tokens, i) and kind == "i" and i + 1 < n and tokens[i + 1][1] == ":" and not tokens[i + 1][2] and (i == 0 or nl) and prev[1] not in ("(", "{", ",", "[", "|"):
            if not (i + 2 < n and tokens[i + 2][1] == ":"):
                return f"label {value}"
        if kind == "o" and value == ":" and i and prev[0] == "b" and prev[1] == ")":
            return "colon after a bracket"
    return None


def _commands(tokens: list) -> str | None:
    """Ruby: three bare words in a row are a command within a command, which needs brackets."""
    row = 0
    for kind, value, nl in tokens:
        if nl:
            row = 0
        row = row + 1 if kind == "i" and value[:1] not in "@$" else 0
        if row > 2:
            return f"{value} after two words"
    return None


#: Words that go on with the statement before a line break.
_GO_ON = frozenset("else catch finally while until where as instanceof in of and or not from do then elsif elif except rescue ensure when case default end implements extends throws".split())
_NEWLINE_ENDS = frozenset(") ] } return break continue fallthrough ++ --".split())


def boundaries(tokens: list, at: list[int], text: str, language: str, stack: list[str], begins: bool) -> list[int]:
    """Tokens at which a new statement begins that can be looked at by itself.

    ``stack`` are the brackets open before the tokens, of which all that are open at a boundary must be blocks. C-like
    statements end in ``;`` or ``}`` at a line's end, those of Go and Ruby at a line's end, those of Python before a line
    that is not indented. ``begins``: the first token begins the file.
    """
    out, open_, prev = [0] if begins and tokens else [], list(stack), None
    ruby, python, go = language == "ruby", language == "python", language == "go"
    events = {i: (w, opens) for i, w, opens in ruby_blocks(tokens)} if ruby else {}
    decorated = False
    for i, (kind, value, nl) in enumerate(tokens):
        if kind == "p":
            continue
        if nl and prev and not (begins and i == 0) and value not in _GO_ON:
            if python:
                new = not open_ and (at[i] == 0 or text[at[i] - 1] == "\n") and not decorated and kind != "b" or (not open_ and value in ("(", "[", "{") and (at[i] == 0 or text[at[i] - 1] == "\n") and not decorated)
            elif ruby:
                new = kind in ("i", "k") and all(x in ("class", "module", "def") for x in open_) and (prev[0] in ("i", "n", "s") or prev[1] in (")", "]", "}", "end"))
            elif go:
                new = kind in ("i", "k") and all(x == "{" for x in open_) and (prev[0] in ("i", "n", "s") or prev[1] in _NEWLINE_ENDS)
            else:
                new = (kind in ("i", "k") or value in ("@", "#")) and prev[1] in (";", "}") and prev[0] in ("o", "b") and all(x == "{" for x in open_)
            if new:
                out.append(i)
        if python and nl and (at[i] == 0 or text[at[i] - 1] == "\n"):
            decorated = value == "@"
        if i in events:
            if events[i][1]:
                open_.append(events[i][0])
            elif open_:
                open_.pop()
        elif kind == "b":
            if value in "([{":
                open_.append(value)
            elif open_:
                open_.pop()
        elif kind == "o" and value in ("${", "}$"):
            open_.append(value) if value == "${" else open_ and open_.pop()
        elif kind == "s" and value == "`" and open_ and open_[-1] == "`":
            open_.pop()
        prev = (kind, value)
    return out


def check(text: str, tokens: list, language: str, first: bool = True, depth: int = 0) -> str | None:
    """What the local grammar finds wrong with some statements, or None.

    ``first``: they begin the file; ``depth``: so many blocks are open before.
    """
    if language == "python":
        return python(text)
    real = [t for t in tokens if t[0] != "p"]
    if bad := _conflict(real):
        return bad
    if language == "c" and any(k == "p" and not _DIRECTIVES.match(v) for k, v, _ in tokens):
        return "directive"
    if not real:
        return None
    head = real[0]
    if first:
        if head[0] == "o" and head[1] in _BINARY | {"<", ">", ",", "?", ":", "*"} and not (language == "ruby" and head[1] in ("*", "::")) and not (head[1] in ("::", "*") and language in ("c", "rust")):
            return f"{head[1]} at the start"
        if language in ("javascript", "typescript") and head[1] == "{" and len(real) > 2 and real[1][0] == "s" and real[2][1] == ":":
            return "data"
    if bad := _neighbours(real, language):
        return bad
    if language in ("java", "csharp", "c", "php") and (bad := _semicolons(tokens, language)):
        return bad
    if bad := _top_level(real, language, first, depth):
        return bad
    if bad := _names(real, language):
        return bad
    if language == "c":
        return _c_words(tokens)
    if language == "ruby":
        return _ruby(real, depth) or _commands(real)
    return None
