"""Chunking: one text to many overlapping pieces.

Windows with a fixed stride are native (a sequence of starts and a slice). Folds whose next start depends on the text before are
Arrow-batched Python functions, one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token budgets of sections by their name; a name is looked up whole, then by the first that it contains.
SECTION_TOKENS = {
    400: ["methods", "method", "methodology", "experiments", "experiment", "implementation"],
    600: ["ablation", "ablation study", "ablation studies", "discussion", "analysis", "evaluation", "results"],
    1000: ["abstract", "introduction", "background", "related work", "conclusion", "conclusions"],
}
DEFAULT_TOKENS, OVERLAP_CHARS, SYMBOL_CHARS = 800, 400, 6000


def line_windows(docs: DataFrame, size: int = 100, overlap: int = 20, keys: tuple[str, ...] = ("doc_id",), text: str = "text", trailing: bool = False) -> DataFrame:
    """(keys, chunk, start_line, end_line, content): windows of lines, 1-based and inclusive. A window that reaches the end is the
    last one, unless `trailing` windows are asked for."""
    step = size - overlap
    at = docs.select(*keys, F.split(text, "\n", -1).alias("_lines")).withColumn("_n", F.size("_lines"))
    last = F.col("_n") - 1 if trailing else F.greatest(F.col("_n") - overlap - 1, F.lit(0))
    at = at.select(*keys, "_lines", "_n", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk", "_start"))
    lines = F.slice("_lines", F.col("_start") + 1, F.lit(size))
    return at.select(*keys, "chunk", (F.col("_start") + 1).alias("start_line"), F.least(F.col("_start") + size, F.col("_n")).alias("end_line"), F.array_join(lines, "\n").alias("content"))


def fallback_chunks(files: DataFrame) -> DataFrame:
    """Line windows of files without symbols, with the ids and search texts of symbol chunks."""
    at = line_windows(files, keys=("relative_path", "language"), text="content")
    name = F.concat("relative_path", F.lit(":chunk_"), "chunk", F.lit(":"), "start_line")
    said = F.concat(F.lit("Code from "), "relative_path", F.lit(" ("), "language", F.lit(") lines "), "start_line", F.lit("-"), "end_line")
    return at.select(name.alias("chunk_id"), "relative_path", "language", F.lit("unknown").alias("symbol_type"), "start_line", "end_line", "content", said.alias("search_text"))


def context_lines(files: DataFrame, line: Column | str, around: int = 5, text: str = "content") -> Column:
    """The lines around a 1-based line."""
    lines = F.split(text, "\n", -1)
    line = F.col(line) if isinstance(line, str) else line
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(line + around - first + 1, F.lit(0))), "\n")


def section_tokens(name: Column | str) -> Column:
    """The token budget of a section by its name without a number."""
    name = F.col(name) if isinstance(name, str) else name
    bare = F.trim(F.regexp_replace(F.lower(F.trim(name)), r"^\d+\.?\s*", ""))
    out = F.when(F.lit(False), F.lit(0))
    for tokens, names in SECTION_TOKENS.items():
        out = out.when(bare.isin(*names), F.lit(tokens))
    for tokens, names in SECTION_TOKENS.items():
        for part in names:
            out = out.when(F.contains(bare, F.lit(part)), F.lit(tokens))
    return out.otherwise(F.lit(DEFAULT_TOKENS))


def pack_section(content: str, limit: int, start: int = 0) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) pieces of at most `limit` estimated tokens: whole paragraphs, or sentences of a longer paragraph. Each piece but
    the first begins with the first OVERLAP_CHARS characters of the last part before it; offsets count that overlap."""
    if not content:
        return
    if len(content) // 4 <= limit:
        yield start, start + len(content), content
        return
    parts: list[tuple[str, bool]] = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", content)):
        if len(para) // 4 > limit:
            cut = re.split(r"(?<=[.!?])\s+", para)
            parts += [(s, i == 0) for i, s in enumerate(cut)]
        elif para:
            parts.append((para, False))
    groups: list[list[str]] = []
    used = 0
    for part, fresh in parts:
        tokens = len(part) // 4
        if not groups or fresh or used + tokens > limit:
            if groups and not groups[-1]:
                groups.pop()
            groups.append([])
            used = 0
        groups[-1].append(part)
        used += tokens
    lead = ""
    for i, group in enumerate(groups):
        text = "\n\n".join(([lead] if lead and i else []) + group)
        yield start, start + len(text), text.strip()
        start, lead = start + len(text), group[-1][:OVERLAP_CHARS]


def snapped_windows(text: str, size: int, overlap: int, marks: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    """Windows of `size` characters that end after the last of `marks` in their second half, if there is one."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            snap = max(text.rfind(m, at, end) for m in marks)
            if snap > at + size // 2:
                end = snap + 1
        if piece := text[at:end].strip():
            yield at, end, piece
        at = end - overlap if end < len(text) else end


def pack_lines(text: str, header: str, limit: int = SYMBOL_CHARS) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content with header) of greedy runs of lines that fit, 0-based."""
    room, begin, used, lines = limit - len(header), 0, 0, text.split("\n")
    for i, line in enumerate(lines):
        if used + len(line) + 1 > room and i > begin:
            yield begin, i - 1, header + "\n".join(lines[begin:i])
            begin, used = i, 0
        used += len(line) + 1
    yield begin, len(lines) - 1, header + "\n".join(lines[begin:])


def _folded(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], fold: Callable[..., Iterator[tuple[int, int, str]]]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*[row[k] for k in keys], i, *piece) for row in frame.to_dict("records") for i, piece in enumerate(fold(*[row[c] for c in columns]))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk", "start_idx", "end_idx", "content"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "chunk int, start_idx long, end_idx long, content string"])
    return df.select(*dict.fromkeys([*keys, *columns])).mapInPandas(run, schema)


def section_chunks(sections: DataFrame, keys: tuple[str, ...] = ("doc_id", "section")) -> DataFrame:
    """Pieces of sections (keys, name, content) within the budgets of their names."""
    return _folded(sections.withColumn("_limit", section_tokens("name")), (*keys, "name"), ("content", "_limit"), lambda content, limit: pack_section(content or "", int(limit)))


def page_windows(pages: DataFrame, size: int = 500, overlap: int = 100, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Windows of each page's trimmed text that end at a full stop or line break."""
    return _folded(pages.withColumn("_text", F.trim(text)), keys, ("_text",), lambda t: snapped_windows(t or "", size, overlap, (".", "\n")))


def text_windows(docs: DataFrame, size: int = 500, overlap: int = 100, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Windows of plain text that end at an empty line or a full stop."""
    return _folded(docs, keys, (text,), lambda t: snapped_windows(t or "", size, overlap, ("\n\n", ".")))


def symbol_parts(symbols: DataFrame, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Symbols (keys, content, header) as runs of lines; start_idx and end_idx are the first and last line, 0-based."""
    return _folded(symbols, keys, ("content", "header"), lambda content, header: pack_lines(content or "", header or "") if len(content or "") > SYMBOL_CHARS else iter([(0, (content or "").count("\n"), content or "")]))


def paper_chunks(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """Papers by what is known of them: named sections by budget, unnamed PDF pages and plain texts by windows."""
    named = section_chunks(sections.filter("source_type = 'pdf' and name is not null"), ("paper_id", "section")).select("paper_id", "chunk", "content")
    pages = page_windows(sections.filter("source_type = 'pdf' and name is null"), keys=("paper_id",), text="content").select("paper_id", "chunk", "content")
    plain = text_windows(papers.filter("source_type != 'pdf'"), keys=("paper_id",), text="content").select("paper_id", "chunk", "content")
    return named.unionByName(pages).unionByName(plain)
