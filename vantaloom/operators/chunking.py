"""Structure-aware chunking as column expressions.

Cutting at a fixed size, counting and injecting are built-in expressions. What folds
over a document's lines (headings, packing up to a size, splitting at a token budget)
maps Arrow batches: a fold of built-in expressions copies its arrays at every line and
is quadratic in a document's lines, while these are linear. Either way a document
never leaves its task and nothing is shuffled.

Cases: a null text gives null, an empty text no chunk; texts of any length are cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions.text import is_blank
from vantaloom.sources.runtime import ship_package

SECTION = "struct<heading:string,body:array<string>>"
_TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
_SECTION_TYPE = pa.struct([("heading", pa.string()), ("body", pa.list_(pa.string()))])
_ENTRY_TYPE = pa.struct([("parent", pa.string()), ("chunk", pa.string())])


def _by_value(work: Callable, returns: str, kind: pa.DataType) -> Callable:
    """A column function that applies ``work`` to each value that is not null."""
    ship_package(SparkSession.active())

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else work(v) for v in values.to_pylist()], kind)

    return F.arrow_udf(run, returnType=returns)


def fixed_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of (start, text): slices of ``size`` characters every ``size - overlap``; blank ones go."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(size)).alias("text")))
    return F.filter(cut, lambda c: ~is_blank(c["text"]))


def _sections(lines: list[str], max_level: int) -> list[tuple[str, list[str]]]:
    """(heading, body lines) between headings of the levels; a heading in a code fence is a line like any other."""
    heading = re.compile(rf"#{{1,{max_level}}}\s")
    cuts, fenced = [], False
    for i, line in enumerate(lines):
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced and heading.match(line):
            cuts.append(i)
    edges = [*cuts, len(lines)]
    first = [("", lines[: edges[0]])] if edges[0] else []
    return first + [(lines[a], lines[a + 1 : b]) for a, b in zip(cuts, edges[1:], strict=True)]


def _packed(heading: str, body: list[str], most: int) -> list[str]:
    """Stripped lines packed up to a size, the heading before each pack; blank lines go."""
    lines = [s for s in map(str.strip, body) if s]
    if not lines:
        return [heading.strip()] if heading.strip() else []
    packs, used = [], most
    head = [heading] if heading else []
    over = most - sum(len(h) + 1 for h in head)
    for line in lines:
        if not packs or used + 1 + len(line) > over:
            packs.append([line])
            used = len(line)
        else:
            packs[-1].append(line)
            used += 1 + len(line)
    return ["\n".join(head + pack).strip() for pack in packs]


def _entries(text: str, most: int, level: int) -> list[dict]:
    """Chunks with the text of the coarser section they lie in."""
    out = []
    for heading, body in _sections(text.split("\n"), level):
        whole = "\n".join(([heading] if heading else []) + body).strip() if body else heading.strip()
        for n, (own, lines) in enumerate(_sections(body or [""], 6)):
            chunks = _packed(heading if n == 0 and not own else own, lines, most)
            out.extend({"parent": whole, "chunk": c} for c in chunks)
    return out


def heading_sections(text: Column, max_level: int = 6) -> Column:
    """Array of (heading, body lines), cut at headings up to a level; lines in code fences are no headings."""
    return _by_value(lambda t: [{"heading": h, "body": b} for h, b in _sections(t.split("\n"), max_level)], f"array<{SECTION}>", pa.list_(_SECTION_TYPE))(text)


def section_chunks(section: Column, max_chars: int) -> Column:
    """Chunks of one section: stripped lines packed up to a size, the heading before each; blank lines go."""
    return _by_value(lambda s: _packed(s["heading"], s["body"], max_chars), "array<string>", pa.list_(pa.string()))(section)


def markdown_chunks(text: Column, max_chars: int = 1000) -> Column:
    """Array of chunks, cut at every heading."""
    return _by_value(lambda t: [c for h, b in _sections(t.split("\n"), 6) for c in _packed(h, b, max_chars)], "array<string>", pa.list_(pa.string()))(text)


def parent_chunks(text: Column, max_chars: int = 1000, parent_level: int = 2) -> Column:
    """Array of (parent text, chunk): the same cutting within sections of a coarser level."""
    return _by_value(lambda t: _entries(t, max_chars, parent_level), "array<struct<parent:string,chunk:string>>", pa.list_(_ENTRY_TYPE))(text)


def count_tokens(text: str) -> int:
    """A deterministic token counter: words, and other characters that are no white space."""
    return len(re.findall(_TOKEN, text, re.ASCII))


def _parts(text: str, max_tokens: int, counter: Callable[[str], int]) -> list[str]:
    if not text or counter(text) <= max_tokens:
        return [text]
    header, *lines = text.split("\n")
    room = max_tokens - counter(header) - 7
    budget = room if room > 0 else max_tokens
    groups, used = [], 0
    for line in lines:
        cost = counter(line) + 1
        if groups and used + cost <= budget:
            groups[-1].append(line)
            used += cost
        else:
            groups.append([line])
            used = cost
    return ["\n".join([f"{header} [part {i}/{len(groups)}]", *g]) for i, g in enumerate(groups, 1)]


def split_long(text: Column, max_tokens: int = 460, counter: Callable[[str], int] = count_tokens) -> Column:
    """Parts of an over-long chunk: its header line with a part mark, then whole lines up to the budget."""
    return _by_value(lambda t: _parts(t, max_tokens, counter), "array<string>", pa.list_(pa.string()))(text)


def inject(text: Column, description: Column) -> Column:
    """A description as a comment line after the header line; an empty one changes nothing."""
    at = F.call_function("instr", text, F.lit("\n"))
    header = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))
    return F.when(F.length(F.coalesce(description, F.lit(""))) == 0, text).otherwise(F.concat(header, F.lit("\n# "), description, F.lit("\n"), rest))


def explode_chunks(docs: DataFrame, chunks: Column, name: str = "chunk") -> DataFrame:
    """One row for each chunk of a document, with its place; the generic flat-map of a chunker."""
    return docs.select("*", F.posexplode(chunks).alias("ord", name))
