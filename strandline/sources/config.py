"""Configuration: layered files, command-line values and environment files. Values are literals, never code."""

from __future__ import annotations

import ast
import os


def read_value(text: str):
    """A literal where the text is one, else the text."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null", ""):
        return None
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        return text


def parse_command_line(args: list[str]) -> dict:
    """--key=value, --key value and --flag."""
    out: dict = {}
    k = 0
    while k < len(args):
        name = args[k]
        if not name.startswith("--"):
            raise ValueError(f"expected --key, found {name!r}")
        if "=" in name:
            key, value = name[2:].split("=", 1)
            out[key] = read_value(value)
        elif k + 1 < len(args) and not args[k + 1].startswith("--"):
            out[name[2:]] = read_value(args[k + 1])
            k += 1
        else:
            out[name[2:]] = True
        k += 1
    return out


def _bare(line: str) -> str:
    """A line without its comment: a # outside quotes, at the start or after a blank."""
    quote = None
    for k, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " \t[{,:"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def _pieces(text: str, mark: str) -> list[str]:
    """text cut at marks that are outside quotes and brackets."""
    out, depth, quote, start = [], 0, None, 0
    for k, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'" and (text[start:k].strip() or ":")[-1] in ":,[{":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == mark and depth == 0:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def _pair(text: str) -> tuple[str, str] | None:
    """Key and rest of ``key: rest``; the colon is followed by a blank or ends the text."""
    parts = _pieces(text, ":")
    for k in range(1, len(parts)):
        rest = ":".join(parts[k:])
        if rest == "" or rest[0] in " \t":
            return ":".join(parts[:k]).strip().strip("\"'"), rest.strip()
    return None


def read_scalar(text: str):
    """A quoted text, a list in brackets, a mapping in braces, a number, true, false, null, or the text itself."""
    text = text.strip()
    low = text.lower()
    if text[:1] == "[" and text[-1:] == "]":
        return [read_scalar(x) for x in _pieces(text[1:-1], ",") if x.strip()]
    if text[:1] == "{" and text[-1:] == "}":
        pairs = [(_pair(x) or (x.strip(), "")) for x in _pieces(text[1:-1], ",") if x.strip()]
        return {k: read_scalar(v) for k, v in pairs}
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return ast.literal_eval(text)
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "~", ""):
        return None
    for number in (int, float):
        try:
            return number(text) if "_" not in text and low.lstrip("+-") not in ("nan", "inf", "infinity") else text
        except ValueError:
            continue
    return text


def parse_nested(text: str) -> dict:
    """Mappings, lists and scalars nested by indentation, in the part of YAML that configuration files use.

    Tabs as indentation, anchors, tags, block texts (| and >) and keys that repeat are errors, as what they mean would be lost."""
    lines = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = _bare(raw)
        body = line.strip()
        if not body or body in ("---", "..."):
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError(f"line {number}: a tab as indentation")
        lines.append((number, len(line) - len(line.lstrip(" ")), body))
    value, end = _block(lines, 0, lines[0][1]) if lines else ({}, 0)
    if end < len(lines):
        raise ValueError(f"line {lines[end][0]}: indentation that fits nothing above")
    if not isinstance(value, dict):
        raise ValueError("a configuration is a mapping of names")
    return value


def _value(lines: list[tuple[int, int, str]], at: int, indent: int, text: str, listed: bool = True):
    """What stands after a key or a dash at line at: text on the same line, else the block below."""
    if text:
        if text[0] in "&*!|>" or (text[0] in "[{" and text[-1] not in "]}"):
            raise ValueError(f"line {lines[at][0]}: {text[:20]!r} is not understood")
        return read_scalar(text), at + 1
    below = at + 1 < len(lines) and lines[at + 1]
    # a list may stand as far left as its key
    if below and (below[1] > indent or (listed and below[1] == indent and (below[2] + " ").startswith("- "))):
        return _block(lines, at + 1, below[1])
    return None, at + 1


def _block(lines: list[tuple[int, int, str]], at: int, indent: int):
    """The mapping or list that begins at line at with this indentation, and the line after it."""
    if (lines[at][2] + " ").startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][1] == indent and (lines[at][2] + " ").startswith("- "):
            number, _, body = lines[at]
            rest = body[1:].lstrip()
            if rest and rest[0] not in "[{\"'" and _pair(rest) or (rest + " ").startswith("- "):
                # a mapping or list that begins beside the dash: the dash counts as indentation
                lines[at] = (number, indent + len(body) - len(rest), rest)
                value, at = _block(lines, at, lines[at][1])
            else:
                value, at = _value(lines, at, indent, rest, listed=False)
            out.append(value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][1] == indent:
        number, _, body = lines[at]
        pair = _pair(body)
        if pair is None or (body + " ").startswith("- "):
            raise ValueError(f"line {number}: expected a key, found {body[:40]!r}")
        if pair[0] in found:
            raise ValueError(f"line {number}: the key {pair[0]!r} repeats")
        found[pair[0]], at = _value(lines, at, indent, pair[1])
    return found, at


def read_config_file(path: str) -> dict:
    """A YAML file: by a reader of all of YAML where one is installed, else by ``parse_nested``."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return parse_nested(text)
    return yaml.safe_load(text) or {}


def merged(old, new):
    """Mappings are merged name by name, anything else is replaced."""
    if isinstance(old, dict) and isinstance(new, dict):
        return old | {k: merged(old[k], v) if k in old else v for k, v in new.items()}
    return new


def layered(*layers: dict | str | None) -> dict:
    """Later layers win, name by name at every depth; a path is read, and a name with points is a path of names."""
    out: dict = {}
    for layer in layers:
        given = read_config_file(layer) if isinstance(layer, str) else (layer or {})
        for name, value in given.items():
            for part in reversed(str(name).split(".")[1:]):
                value = {part: value}
            out = merged(out, {str(name).split(".")[0]: value})
    return out


def read_env_file(path: str, into: dict | None = None) -> dict:
    """NAME=value lines; quotes and an export prefix are dropped, and what is set already stays."""
    found: dict = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                k, v = line.split("=", 1)
                found[k.strip()] = v.strip().strip("\"'")
    target = os.environ if into is None else into
    for k, v in found.items():
        target.setdefault(k, v)
    return found
