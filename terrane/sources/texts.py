"""Small text formats: tag lists and indented key-value files. They are for literals and test corpora, not for data sets."""

from __future__ import annotations

import re

_PAIR = re.compile(r"""\s*(?P<key>"(?:\\.|[^"\\])*"|[^\s=,"]+)\s*=\s*(?P<value>"(?:\\.|[^"\\])*"|[^,\n]*?)\s*(?:,|\n|$)""")


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if text.startswith('"') else text


def _typed(text: str) -> str | int | float | bool:
    """A bare value as what it says: a number, yes and no being texts, true and false not."""
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"-?[0-9]*\.[0-9]+", text):
        return float(text)
    return {"true": True, "false": False}.get(text, text)


def parse_tags(text: str, typed: bool = False) -> dict:
    """``k=v, k="v"``, separated by commas or line breaks. Values are texts; if ``typed``, bare numbers and booleans are what they say."""
    out, at = {}, 0
    while text[at:].strip():
        m = _PAIR.match(text, at)
        if not m:
            raise ValueError(f"key=value expected at {text[at : at + 20]!r}")
        value = m["value"]
        out[_plain(m["key"])] = _typed(value) if typed and not value.startswith('"') else _plain(value)
        at = m.end()
    return out


def parse_fab(text: str) -> list[tuple[str, str, list]]:
    """``key: value`` lines nested by indentation, as (key, value, children); ``//`` starts a comment line. A line without a colon is a value
    with no key."""
    root: list = []
    levels = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.strip().startswith("//"):
            continue
        depth = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        m = re.match(r"\s*([^\s:=]+):(?:\s+(.*)|$)", line)
        key, value = (m[1], (m[2] or "").strip()) if m else ("", line.strip())
        while depth <= levels[-1][0]:
            levels.pop()
        node = (key, value, [])
        levels[-1][1].append(node)
        levels.append((depth, node[2]))
    return root
