"""JSON that isn't quite JSON: a reader that takes what is there and writes proper JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for JSON's three, numbers as JSON has them, and quotes with what closes them.
WORDS = {"true": "true", "True": "true", "false": "false", "False": "false", "null": "null", "None": "null", "undefined": "null", "NaN": "null"}
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_BLANK = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))+", re.DOTALL)
_BARE = {True: re.compile(r"[^,:\[\]{}\n\"]+"), False: re.compile(r"(?:[^,:\[\]{}\n\"]|:(?=\S))+")}
_COMMENT = re.compile(r"\s//|/\*|\s#")
#: What may follow a value's string: what ends it or begins the next one.
_AFTER = re.compile(r"\s*(?:[,:}\]\[{\"'“‘]|//|/\*|#|\Z)")
_COLON = re.compile(r"\s*:")


def _string(t: str, at: int, key: bool) -> tuple[str, int]:
    """The string that opens at a quote, and where it ends. A quote within a value that nothing follows as after a string
    is its own. A key ends at its first quote, or at a colon before it if no colon follows that; or with its line."""
    close, out, at, colon = QUOTES[t[at]], [], at + 1, None
    while at < len(t):
        c = t[at]
        if c == "\\" and at + 1 < len(t):
            n = t[at + 1]
            code = t[at + 2 : at + 6] if n == "u" else ""
            if re.fullmatch("[0-9a-fA-F]{4}", code):
                out.append(chr(int(code, 16)))
                at += 6
                continue
            out.append(ESCAPES.get(n, n))
            at += 2
            continue
        if c == close and key and colon and not _COLON.match(t, at + 1):
            break
        if c == close and (key or _AFTER.match(t, at + 1)):
            return "".join(out), at + 1
        if key and c == "\n":
            colon = colon or (len(out), at)
            break
        if key and c == ":" and colon is None:
            colon = len(out), at
        out.append(c)
        at += 1
    if colon:  # the key's quote is missing
        return "".join(out[: colon[0]]).strip(), colon[1]
    return "".join(out).rstrip("}] \n") if not key else "".join(out), at


def _scalar(t: str, at: int, key: bool) -> tuple[str, int]:
    """JSON text of the string, number or word that begins here, and where it ends."""
    if t[at] in QUOTES:
        said, at = _string(t, at, key)
    else:
        m = _BARE[key].match(t, at)
        if m is None:
            return '""', at + 1
        said = _COMMENT.split(m[0])[0].rstrip()
        known = [said] if key else said.split()
        if not key and known and all(w in WORDS or NUMBER.match(w) for w in known):  # several: commas are missing
            return WORDS.get(known[0], known[0]), at + len(known[0]) if len(known) > 1 else at + len(said)
        at = at + len(said) if len(said) < len(m[0]) else m.end()
    said = said.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return json.dumps(said, ensure_ascii=False), at


class _Open:
    """An open object or list: its bracket, what it holds so far, and a key that waits for its value."""

    def __init__(self, bracket: str):
        self.bracket, self.parts, self.key = bracket, [], None

    def add(self, text: str) -> None:
        if self.bracket == "[":
            self.parts.append(text)
        elif self.key is None and text[0] in "[{":  # a value where a key should be
            self.parts.append(f'"":{text}')
        elif self.key is None:
            self.key = text
        else:
            self.parts.append(f"{self.key}:{text}")
            self.key = None

    def closed(self) -> str:
        if self.key is not None:
            self.add("null")
        return f"{self.bracket}{','.join(self.parts)}{']' if self.bracket == '[' else '}'}"


def repaired(t: str) -> str | None:
    """Proper JSON text of the first object or list of a text; without any, of the scalar that the text is; null if empty.

    Taken as meant: text and code fences around the value, comments, strings in single, curly or no quotes, quotes inside
    strings, True, None and the like, commas and colons that are missing or too many, keys without values (null), values
    without keys (an empty one), brackets left open (closed at the end) and closing ones that nothing has opened (left out). One pass; nesting costs no stack."""
    begin = re.search(r"[\[{]", t)
    if begin is None:
        t = t.strip()
        return _scalar(t, 0, False)[0] if t else None
    at, stack, done = begin.start(), [], None
    while at < len(t) and done is None:
        if m := _BLANK.match(t, at):
            at = m.end()
            continue
        c = t[at]
        if c in "[{":
            stack.append(_Open(c))
            at += 1
        elif c in "]}":
            at += 1
            opens = "[" if c == "]" else "{"
            if all(s.bracket != opens for s in stack):
                continue
            while stack:
                own = stack.pop()
                if not stack:
                    done = own.closed()
                else:
                    stack[-1].add(own.closed())
                if own.bracket == opens:
                    break
        elif c in ",:":
            top = stack[-1]
            if c == "," and top.key is not None:
                top.add("null")
            at += 1
        else:
            top = stack[-1]
            key = top.bracket == "{" and top.key is None
            text, at = _scalar(t, at, key)
            top.add(text)
    while stack:
        own = stack.pop()
        done = own.closed()
        if stack:
            stack[-1].add(done)
    return done


def lenient(x: Column) -> Column:
    """JSON text of a text that is meant as JSON: proper JSON as it is, the rest as repaired says; null stays null. Only
    texts that don't parse go through Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else repaired(t))

    good = F.try_parse_json(x).isNotNull()
    return F.when(good, x).otherwise(run(F.when(~good, x)))
