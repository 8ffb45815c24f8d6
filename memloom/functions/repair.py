"""Damaged JSON objects, for the rows that the native parser refuses."""

from __future__ import annotations

import json
import re

#: A text up to its first opening bracket outside double quotes, if that is a brace.
OBJECT_FIRST = r'(?s)^[^\[{"]*+(?:"(?:[^"\\]++|\\.)*+"[^\[{"]*+)*+\{'
_OBJECT_FIRST = re.compile(OBJECT_FIRST)
_BARE = re.compile(r"""(?:(?!\s+["'])[^,:{}\[\]\n])*""")
_SPACE = re.compile(r"[\s,]*")
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_END = object()


class Reader:
    """Reads a value with a stack: quotes of both kinds, keys and words without quotes, commas too many or too few, and a text
    that stops (everything open is closed there)."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def string(self, quote: str) -> str:
        out, self.at = [], self.at + 1
        while self.at < len(self.text):
            char = self.text[self.at]
            if char == "\\" and self.at + 1 < len(self.text):
                pair = self.text[self.at : self.at + 2]
                if pair[1] == "u" and re.fullmatch("[0-9A-Fa-f]{4}", self.text[self.at + 2 : self.at + 6]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(pair[1], pair[1]))
                self.at += 2
                continue
            self.at += 1
            if char == quote:
                break
            out.append(char)
        return "".join(out)

    def word(self) -> object:
        """A value or key without quotes, up to what ends it."""
        raw = _BARE.match(self.text, self.at)[0]
        self.at += len(raw)
        raw = raw.strip()
        if raw in _WORDS:
            return _WORDS[raw]
        try:
            return json.loads(raw)
        except ValueError:
            return raw

    def skip(self) -> str:
        """The next character that is neither space nor comma, or nothing."""
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def scalar(self, char: str) -> object:
        return self.string(char) if char in "\"'" else self.word()

    def value(self) -> object:
        """The value at this place, None if it is an object without any `key:`."""
        top: list = []
        stack: list[tuple[object, str | None]] = [(top, None)]  # a container and the key that waits for its value
        while True:
            holder, key = stack[-1]
            char = self.skip()
            if not char or (char in "}]" and len(stack) > 1):
                self.at += 1
                stack.pop()
                if len(stack) <= 1:
                    return top[0] if top else None
                continue
            if isinstance(holder, dict) and key is None:
                name = self.scalar(char)
                if char in "{[" or self.skip() != ":":
                    if len(stack) == 2 and not holder:
                        return None
                    self.at += char in "{["
                    continue
                self.at += 1
                stack[-1] = (holder, str(name))
                if self.skip() in ("}", ""):
                    holder[str(name)] = None
                    stack[-1] = (holder, None)
                continue
            if char == ":":
                self.at += 1
                continue
            new = {} if char == "{" else [] if char == "[" else _END
            if new is _END:
                new = self.scalar(char)
            else:
                self.at += 1
            if isinstance(holder, dict):
                holder[key] = new
                stack[-1] = (holder, None)
            else:
                holder.append(new)
            if isinstance(new, dict | list) and char in "{[":
                stack.append((new, None))
            elif len(stack) == 1:
                return new


def recovered(text: str | None) -> str | None:
    """The first JSON object of a text as sound JSON; None if there is none, or if what comes first is an array."""
    found = _OBJECT_FIRST.match(text or "")
    if not found:
        return None
    at = found.end() - 1
    try:
        value, _ = json.JSONDecoder().raw_decode(text, at)
    except ValueError:
        value = Reader(text, at).value()
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
