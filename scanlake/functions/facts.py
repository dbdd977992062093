"""Positional facts from source text: pattern hits with their brackets, arguments and scopes.

Spark has no expression that pairs brackets, so this one small helper runs inside
``mapInArrow`` over the files that a JVM-side ``rlike`` let through. It only finds and
locates; every decision (pairing, guarding, reachability) is made by joins over its rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = ("scan_id string, path string, kind string, start int, end int, line int, end_line int, g array<string>, "
          "open int, close int, close_line int, args array<string>, parens array<int>, braces array<int>, text string")
_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|[()\[\]{},]')
_OPENER = {")": "(", "]": "[", "}": "{"}
_OPENERS = ("(", "{", "[")
_BREAK = re.compile("\n")
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
#: Rows of a batch that goes back to the JVM.
_ROWS = 10_000


def _brackets(text: str) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Closing position per opening bracket, and the commas directly inside each bracket; quotes skipped."""
    stack: list[tuple[str, int]] = []
    held = {"(": 0, "[": 0, "{": 0}
    closes: dict[int, int] = {}
    commas: dict[int, list[int]] = {}
    for m in _TOKEN.finditer(text):
        ch = m[0]
        if ch in held:
            stack.append((ch, m.start()))
            held[ch] += 1
        elif ch == ",":
            if stack:
                commas.setdefault(stack[-1][1], []).append(m.start())
        elif ch in _OPENER:
            opener = _OPENER[ch]
            if held[opener]:
                while True:
                    kind, at = stack.pop()
                    held[kind] -= 1
                    if kind == opener:
                        closes[at] = m.start()
                        break
    return closes, commas


def _arguments(text: str, start: int, close: int, commas: Sequence[int]) -> list[str]:
    if not commas:
        part = text[start + 1:close].strip()
        return [part] if part else []
    edges = [start, *commas, close]
    parts = [text[a + 1:b].strip() for a, b in zip(edges, edges[1:])]
    return [p for p in parts if p]


def file_facts(text: str, patterns: Mapping[str, re.Pattern]) -> Iterator[tuple]:
    """All pattern hits of one text in position order. A hit that ends in a bracket carries its extent.

    Line and text are those of the hit's start, or of its group ``spot`` where the pattern has one.
    """
    closes, commas = _brackets(text)
    breaks = [m.start() for m in _BREAK.finditer(text)]
    row = lambda at: bisect_right(breaks, at - 1) + 1
    hits = sorted([(m.start(), kind, m) for kind, p in patterns.items() for m in p.finditer(text)], key=lambda h: h[:2])
    if not hits:
        return
    spots = {kind for kind, p in patterns.items() if "spot" in p.groupindex}
    pairs = sorted(closes.items())
    chain: list[tuple[int, int]] = []
    i, whole = 0, len(text)
    for at, kind, m in hits:
        while i < len(pairs) and pairs[i][0] < at:
            chain.append(pairs[i])
            i += 1
            while len(chain) > 1 and chain[-2][1] < chain[-1][0]:
                del chain[-2]
        if chain:
            chain = [c for c in chain if c[1] >= at]
        after = m.end()
        last = after - 1
        end = closes.get(last)
        tail = text[last:after]
        args = _arguments(text, last, end, commas.get(last, [])) if end is not None and tail == "(" else None
        n = row(m.start("spot") if kind in spots and m["spot"] is not None else at)
        begin = breaks[n - 2] + 1 if n > 1 else 0
        stop = breaks[n - 1] if n <= len(breaks) else whole
        line_of = lambda to: n if begin <= to <= stop else row(to)  # noqa: B023, E731
        parens: list[int] = []
        braces: list[int] = []
        for o, _ in chain:
            if text[o] == "(":
                parens.append(o)
            elif text[o] == "{":
                braces.append(o)
        yield (kind, at, after, n, line_of(max(at, last)), list(m.groups("")), last if tail in _OPENERS else None, end, None if end is None else line_of(end), args,
               parens, braces, text[begin:stop])


def _call_rows(text: str, call: re.Pattern) -> Iterator[tuple]:
    """(line, text, start, groups, arguments) of each hit that ends in a parenthesis or other bracket closed on its own line.

    The rows are those of ``file_facts`` with ``close_line = line``; what a call does not need, the brackets around it and its end, is not looked up.
    """
    closes = commas = breaks = None
    for m in call.finditer(text):
        if closes is None:
            closes, commas = _brackets(text)
            breaks = [b.start() for b in _BREAK.finditer(text)]
        at, last = m.start(), m.end() - 1
        close = closes.get(last)
        if close is None or text.find("\n", at, close) >= 0:
            continue
        n = bisect_right(breaks, at - 1)
        line = text[breaks[n - 1] + 1 if n else 0:breaks[n] if n < len(breaks) else len(text)]
        yield n + 1, line, at, list(m.groups("")), _arguments(text, last, close, commas.get(last, ())) if text[last] == "(" else None


def _in_batches(batches: Iterator[pa.RecordBatch], rows_of, schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of all texts as batches of bounded size, each row led by its scan and path; ``rows_of`` takes the columns after these."""
    names, types = zip(*[x.strip().split(" ") for x in schema.split(",")])
    kinds = [_TYPES[t] for t in types]
    held: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=list(names))
    for batch in batches:
        for scan_id, path, *given in zip(*[c.to_pylist() for c in batch.columns]):
            for r in rows_of(*given):
                held.append((scan_id, path, *r))
                if len(held) >= _ROWS:
                    yield made()
                    held.clear()
    if held:
        yield made()


def extract(files: DataFrame, patterns: Mapping[str, str], anchor: str) -> DataFrame:
    """Facts of every file whose content matches ``anchor`` (tested in the JVM before any transfer)."""
    sources = dict(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p) for k, p in sources.items()}
        yield from _in_batches(batches, lambda text: file_facts(text, compiled), SCHEMA)
    return files.filter(F.col("content").rlike(anchor)).select("scan_id", "path", "content").mapInArrow(run, SCHEMA)


def program_facts(files: DataFrame, call: str, shapes: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Functions and calls of files in several languages; every file is read once.

    ``files(scan_id, path, lang, has_functions, content)``; ``shapes`` gives header and style by language. Rows of kind ``function`` have name,
    params, start_line and end_line (exclusive), rows of kind ``call`` (on one line) have line, text, start, g and args.
    """
    shapes = dict(shapes)

    def rows(lang: str, has_functions: bool, content: str) -> Iterator[tuple]:
        if has_functions:
            header, style = heads[lang]
            for f in _function_rows(content, header, style):
                yield (lang, "function", *f, None, None, None, None, None)
        for r in _call_rows(content, calls["call"]):
            yield (lang, "call", None, None, None, None, *r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads.update({k: (re.compile(h), style) for k, (h, style) in shapes.items()})
        calls["call"] = re.compile(call)
        yield from _in_batches(batches, rows, schema)

    heads: dict[str, tuple] = {}
    calls: dict[str, re.Pattern] = {}
    schema = "scan_id string, path string, lang string, kind string, name string, params string, start_line int, end_line int, line int, text string, start int, g array<string>, args array<string>"
    return files.select("scan_id", "path", "lang", "has_functions", "content").mapInArrow(run, schema)


def functions_of(files: DataFrame, header: str, style: str, anchor: str) -> DataFrame:
    """Function rows (scan_id, path, name, params text, start_line, end_line exclusive).

    ``style`` says how a body ends: ``indent`` (next line not deeper), ``brace`` (closing
    bracket) or ``end`` (matching end line). ``header`` has groups (indent), name and params.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = re.compile(header)
        yield from _in_batches(batches, lambda text: _function_rows(text, head, style), schema)
    schema = "scan_id string, path string, name string, params string, start_line int, end_line int"
    return files.filter(F.col("content").rlike(anchor)).select("scan_id", "path", "content").mapInArrow(run, schema)


def _function_rows(content: str, head: re.Pattern, style: str) -> Iterator[tuple]:
    lines = content.replace("\r\n", "\n").split("\n")
    opened: list[list] = []  # [depth or indent, name, params, start]
    depth = 0
    for n, text in enumerate(lines, 1):
        told = text.lstrip()
        blank = not told or told[0] == "#"
        indent = len(text) - len(told)
        if style == "indent" and not blank:
            while opened and indent <= opened[-1][0]:
                _, name, params, start = opened.pop()
                yield name, params, start, n
        m = head.search(text)
        if m:
            part = lambda key: next((v for k, v in m.groupdict().items() if k.startswith(key) and v), "")
            if style == "brace" and "=>" in m.group() and "{" not in text[m.end():]:
                yield part("name"), part("params"), n, n + 1  # an arrow whose body is an expression
            else:
                opened.append([indent if style == "indent" else depth, part("name"), part("params"), n])
        if style == "end" and re.match(r"\s*end\b", text) and opened:
            _, name, params, start = opened.pop()
            yield name, params, start, n + 1
        if style == "brace":
            ups, downs = text.count("{"), text.count("}")
            depth += ups - downs
            while opened and depth <= opened[-1][0] and (ups or downs):
                _, name, params, start = opened.pop()
                yield name, params, start, n + 1
    for _, name, params, start in opened:
        yield name, params, start, len(lines) + 1
