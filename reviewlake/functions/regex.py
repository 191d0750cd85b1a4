"""Rule patterns are stored in ECMAScript syntax; these helpers render them for an engine.

Differences handled: ``\\s`` covers Unicode spaces, ``.`` stops at CR and at the two Unicode
separators, and ``\\b`` is an ASCII boundary (``java.util.regex`` treats accented letters as
word characters).
"""

from __future__ import annotations

from collections.abc import Iterator

SPACE_NO_NEWLINE = r"\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACE = r"\n" + SPACE_NO_NEWLINE
DOT = r"[^\n\r\x{2028}\x{2029}]"


def _tokens(pattern: str) -> Iterator[str]:
    """Yield escapes, whole character classes and single characters."""
    i = 0
    while i < len(pattern):
        j = i + 1
        if pattern[i] == "\\":
            j = i + 2
        elif pattern[i] == "[":
            while pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            j += 1
        yield pattern[i:j]
        i = j


def _wordlike(token: str) -> bool:
    return token in (r"\w", r"\d") or (len(token) == 1 and (token.isalnum() or token == "_"))


def render(pattern: str, flags: str = "", *, one_line: bool = False, java: bool = True) -> str:
    """Render ``pattern``.

    With ``one_line`` no match can contain a line feed, so the first match in a whole text lies
    on the first line that would match by itself.
    """
    space = SPACE_NO_NEWLINE if one_line else SPACE
    tokens = list(_tokens(pattern))
    out = []
    for i, token in enumerate(tokens):
        if token == r"\s":
            out.append(f"[{space}]")
        elif token == ".":
            out.append(DOT)
        elif token == r"\b" and java:
            following = tokens[i + 1] if i + 1 < len(tokens) else ""
            if following == "(":
                following = tokens[i + 2]
            out.append(r"(?<!\w)" if _wordlike(following) else r"(?!\w)")
        elif token.startswith("["):
            body = token.replace(r"\s", space)
            if one_line and token.startswith("[^"):
                body = body[:-1] + r"\n]"
            out.append(body)
        else:
            out.append(token)
    inline = "".join(f for f in flags if f in "ims")
    return (f"(?{inline})" if inline else "") + "".join(out)


def _close(tokens: list[str], start: int) -> int:
    depth = 0
    for i in range(start, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i], 0)
        if depth == 0:
            return i
    raise ValueError("unbalanced group")


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which every match contains at least one, or None if there is no useful set.

    A plain substring test on the raw bytes is far cheaper than a regex, so scans use these
    literals as a guard in front of the regex.
    """
    tokens = list(_tokens(pattern))
    alternatives: list[list[str]] = [[]]
    depth = 0
    for token in tokens:
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == "|" and depth == 0:
            alternatives.append([])
        else:
            alternatives[-1].append(token)
    chosen: list[str] = []
    for alternative in alternatives:
        best = _best_literals(alternative)
        if best is None:
            return None
        chosen += best
    return chosen


def _best_literals(tokens: list[str]) -> list[str] | None:
    options: list[list[str]] = []
    run = ""

    def flush() -> None:
        nonlocal run
        if run:
            options.append([run])
        run = ""

    i = 0
    while i < len(tokens):
        token, end = tokens[i], i
        if token == "(":
            end = _close(tokens, i)
        quantifier = tokens[end + 1] if end + 1 < len(tokens) else ""
        optional = quantifier in ("?", "*", "{")
        if token == "(":
            flush()
            inner = tokens[i + 1:end]
            if inner[:1] != ["?"] and not optional:
                found = required_literals("".join(inner))
                if found:
                    options.append(found)
        elif token == r"\b":
            pass
        elif token in ("*", "+", "?", "$", "^"):
            flush()
        elif token == "{":
            flush()
            end = tokens.index("}", i)
        elif token == "." or token.startswith("[") or (token[0] == "\\" and token[1].isalnum()):
            flush()
        elif optional:
            flush()
        else:
            run += token[-1]
        i = end + 1
    flush()
    good = [o for o in options if min(map(len, o)) >= 2]
    return max(good, key=lambda o: min(map(len, o))) if good else None
