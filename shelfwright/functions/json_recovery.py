"""The largest balanced JSON object inside free text."""

from __future__ import annotations

import json
import re

EMPTY = {"categories": [], "uncategorized": []}
#: A string up to its end (or to the text's, where it is never closed), or a brace outside of strings.
MARKS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|[{}]', re.DOTALL)


def largest_object(text: str | None) -> str | None:
    """The longest stretch of balanced braces, the first of equals; braces in strings don't count, whatever stands before them."""
    spans, open_ = [], []
    for m in MARKS.finditer(text or ""):
        if m.group() == "{":
            open_.append(m.start())
        elif m.group() == "}" and open_:
            first = open_.pop()
            if not open_:
                spans.append((first, m.end()))
    i, j = max(spans, key=lambda s: s[1] - s[0], default=(0, 0))
    return text[i:j] or None if spans else None


def recover(text: str | None):
    """The text as JSON, whatever kind of value it is; else its largest object, else the empty answer."""
    for candidate in (text, largest_object(text)):
        try:
            if candidate:
                return json.loads(candidate)
        except ValueError:
            continue
    return dict(EMPTY)
