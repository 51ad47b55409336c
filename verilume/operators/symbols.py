"""Symbols of source files: definitions with their behaviour, and the texts by which they are searched.

Extraction is a Python function per file (a file is one row, so partitions are files); everything after it is native. Python is
parsed by its own grammar; the other languages by the shape of their definitions and balanced braces, with strings and
comments blanked out first. A file without symbols, or one that doesn't parse, gets line windows (chunking.fallback_chunks).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verilume.functions.text import dotted_calls, identifier_words, inline_comments, readable
from verilume.operators.chunking import SYMBOL_CHARS, fallback_chunks, symbol_parts

FLAGS = ["has_conditionals", "has_loops", "has_error_handling", "has_async", "has_validation", "has_mutations"]
SYMBOL = (
    "relative_path string, language string, symbol_type string, symbol_name string, parent_scope string, start_line int, end_line int, content string, signature string, "
    "parameters array<string>, return_type string, decorators array<string>, docstring string, conditionals int, loops int, handlers int, asyncs int, validations int, "
    "has_mutations boolean, return_behavior string"
)

#: What an algorithm is called by and the hint that it gives, in the order of the hints.
HINTS = [
    (r"(quick|merge|heap|bubble|insertion|selection|radix|counting|bucket)[\s_]?sort", "sorting algorithm"),
    (r"sort(ed|ing|er)?", "sorting"),
    (r"(binary|linear|depth[\s_]?first|breadth[\s_]?first|a[\s_]?star)[\s_]?search", "search algorithm"),
    (r"(bfs|dfs)", "graph traversal"),
    (r"(dijkstra|bellman[\s_]?ford|floyd[\s_]?warshall|kruskal|prim|tarjan|kosaraju)", "graph algorithm"),
    (r"(shortest[\s_]?path|minimum[\s_]?spanning[\s_]?tree|mst)", "graph algorithm"),
    (r"(traverse|preorder|inorder|postorder|level[\s_]?order)", "tree traversal"),
    (r"(balance|rotate|insert|delete)[\s_]?(tree|node|bst)?", "tree operation"),
    (r"(dynamic[\s_]?programming|dp|memoiz|tabulation)", "dynamic programming"),
    (r"(knapsack|longest[\s_]?common|edit[\s_]?distance|levenshtein)", "dynamic programming"),
    (r"(gradient[\s_]?descent|backprop|forward[\s_]?pass|backward[\s_]?pass)", "machine learning"),
    (r"(train|predict|fit|transform|inference|embed)", "machine learning"),
    (r"(loss|optimizer|activation|softmax|relu|sigmoid|tanh)", "neural network"),
    (r"(attention|transformer|encoder|decoder|lstm|gru|rnn|cnn|conv)", "deep learning"),
    (r"(hash[\s_]?map|hash[\s_]?table|dictionary|trie|bloom[\s_]?filter)", "data structure"),
    (r"(linked[\s_]?list|doubly[\s_]?linked|circular)", "linked list"),
    (r"(stack|queue|deque|heap|priority[\s_]?queue)", "data structure"),
    (r"(kmp|rabin[\s_]?karp|boyer[\s_]?moore|suffix[\s_]?(tree|array))", "string algorithm"),
    (r"(tokeniz|pars|regex|pattern[\s_]?match)", "string processing"),
    (r"(matrix|vector|tensor|dot[\s_]?product|cross[\s_]?product)", "linear algebra"),
    (r"(fft|fourier|convolution|correlation)", "signal processing"),
    (r"(prime|factorial|fibonacci|gcd|lcm|modular)", "mathematical"),
    (r"(validat|sanitiz|normaliz|encod|decod|compress|decompress)", "data processing"),
    (r"(encrypt|decrypt|hash|sign|verify)", "cryptography"),
    (r"(fetch|request|response|endpoint|route|middleware)", "web/API"),
    (r"(serialize|deserialize|marshal|unmarshal|json|xml)", "serialization"),
]
#: Frameworks and the strings that show their use.
FRAMEWORKS = {
    "fastapi": ["@app.get", "@app.post", "@router.", "FastAPI", "APIRouter"],
    "flask": ["@app.route", "Flask", "@blueprint."],
    "django": ["@login_required", "HttpResponse", "render", "models.Model"],
    "pytest": ["@pytest.", "def test_", "@fixture"],
    "sqlalchemy": ["Base", "Column", "relationship", "Session"],
    "pydantic": ["BaseModel", "Field", "validator"],
    "asyncio": ["async def", "await", "asyncio."],
    "dataclasses": ["@dataclass"],
    "typing": ["Optional", "Union", "List", "Dict", "Callable"],
}

#: Definitions by language: classes and functions; the first named group that matched is the name. The body is what the braces after it enclose.
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_C_FUNCTION = r"(?:^|(?<=[{};]))\s*(?!(?:if|for|while|switch|return|else|do|catch|new|throw)\b)(?:[\w:*&<>,~\[\]]+[ \t*&]+)*(?:[\w]+::)*" + _NAME.replace("[A-Za-z_$]", "[A-Za-z_~]") + r"\s*\((?P<args>[^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const|noexcept|override|throws\s+[\w.,\s]+|\s)*(?=\{)"
SHAPES = {
    "javascript": (rf"\bclass\s+{_NAME}[^{{;]*(?=\{{)", [rf"\bfunction\s*\*?\s*{_NAME}\s*\((?P<args>[^)]*)\)\s*(?=\{{)", rf"\b(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?\((?P<args>[^)]*)\)\s*=>\s*(?=\{{)"], rf"(?:^|(?<=[{{}};]))\s*(?:static\s+|async\s+|get\s+|set\s+|#)*(?!(?:if|for|while|switch|catch|function|return)\b){_NAME}\s*\((?P<args>[^)]*)\)\s*(?=\{{)"),
    "typescript": (rf"\b(?:class|interface|enum)\s+{_NAME}[^{{;]*(?=\{{)", [rf"\bfunction\s*{_NAME}\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{;]+?))?\s*(?=\{{)", rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^=]+?))?\s*=>\s*(?=\{{)"], rf"(?:^|(?<=[{{}};]))\s*(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|async\s+)*(?!(?:if|for|while|switch|catch|function|return)\b){_NAME}\s*\((?P<args>[^)]*)\)\s*(?::\s*(?P<ret>[^{{;]+?))?\s*(?=\{{)"),
    "java": (rf"\b(?:class|interface|enum|record)\s+{_NAME}[^{{;]*(?=\{{)", [], _C_FUNCTION),
    "go": (rf"\btype\s+{_NAME}\s+(?:struct|interface)\s*(?=\{{)", [rf"\bfunc\s+(?:\([^)]*\)\s*)?{_NAME}\s*\((?P<args>[^)]*)\)(?P<ret>[^{{]*)(?=\{{)"], None),
    "rust": (rf"\b(?:struct|enum|trait|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+{_NAME}[^{{;]*(?=\{{)", [rf"\bfn\s+{_NAME}\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)(?:\s*->\s*(?P<ret>[^{{]+?))?\s*(?:where[^{{]*)?(?=\{{)"], rf"\bfn\s+{_NAME}\s*(?:<[^>]*>)?\((?P<args>[^)]*)\)(?:\s*->\s*(?P<ret>[^{{]+?))?\s*(?:where[^{{]*)?(?=\{{)"),
    "c": (None, [_C_FUNCTION], None),
    "cpp": (rf"\b(?:class|struct)\s+{_NAME}[^{{;()]*(?=\{{)", [_C_FUNCTION], _C_FUNCTION),
}


def _row(path, language, kind, name, parent, first, last, content, signature, params, returns, decorators, doc, counts, mutates, gives):
    return (path, language, kind, name, parent, first, last, content, signature, params, returns, decorators, doc, *counts, mutates, gives)


def python_symbols(path: str, source: str) -> Iterator[tuple]:
    """The classes, functions outside them and methods of a Python file; none if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = source.split("\n")

    def symbol(node, kind, parent):
        first, last = node.lineno, node.end_lineno
        a = getattr(node, "args", None)
        params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")] if a else []
        returns = ast.unparse(node.returns) if getattr(node, "returns", None) else None
        head = "class " + node.name if kind == "class" else ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") + f"{node.name}({ast.unparse(a)})" + (f" -> {returns}" if returns else "")
        of = lambda *kinds: [n for n in ast.walk(node) if isinstance(n, kinds)]
        counts = [len(of(ast.If, ast.IfExp, ast.Match)), len(of(ast.For, ast.AsyncFor, ast.While)), len(of(ast.Try, ast.Raise)), len(of(ast.AsyncFunctionDef, ast.Await)), len(of(ast.Assert))]
        targets = [t for n in of(ast.Assign, ast.AugAssign, ast.AnnAssign) for t in (n.targets if isinstance(n, ast.Assign) else [n.target])]
        mutates = any(isinstance(t, (ast.Attribute, ast.Subscript)) for t in targets)
        returned = of(ast.Return)
        inside = {id(r) for n in of(ast.If, ast.IfExp, ast.Match, ast.Try) for r in ast.walk(n) if isinstance(r, ast.Return)}
        gives = "void" if not returned else "conditional" if any(id(r) in inside for r in returned) else "value"
        return _row(path, "python", kind, node.name, parent, first, last, "\n".join(lines[first - 1 : last]), head, params, returns, [ast.unparse(d) for d in node.decorator_list], ast.get_docstring(node), counts, mutates, gives)

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield symbol(child, "class", parent)
                yield from visit(child, child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield symbol(child, "method" if parent else "function", parent)
            elif not isinstance(child, ast.expr):
                yield from visit(child, parent)

    yield from visit(tree, None)


def _blanked(source: str) -> str:
    """The source with the insides of strings and comments as spaces; lengths and lines stay."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _body_end(text: str, at: int) -> int:
    """The position after the brace that closes the one at or after `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def braced_symbols(path: str, language: str, source: str) -> Iterator[tuple]:
    """The classes, functions and methods of a file in a language of SHAPES; each place gives one symbol."""
    shape = SHAPES.get(language)
    if not shape:
        return
    bare = _blanked(source)
    classes, functions, methods = shape
    line_of = lambda at: source.count("\n", 0, at) + 1

    def symbol(m, kind, parent):
        at, end = m.start() + len(m[0]) - len(m[0].lstrip()), _body_end(bare, m.end())
        body, groups = bare[m.end() : end], m.groupdict()
        args = [re.split(r"[:=]", x)[0].strip() for x in re.split(r",(?![^<(\[]*[>)\]])", groups.get("args") or "") if x.strip()]
        if language in ("java", "c", "cpp"):
            args = [re.sub(r"\[.*", "", x).split()[-1].lstrip("*&") for x in args if x not in ("void",)]
        elif language == "go":
            args = [x.split()[0] for x in args]
        args = [a for a in args if a.lstrip("&").removeprefix("mut ").strip() not in ("self", "this")]
        count = lambda p: len(re.findall(p, body))
        counts = [count(r"\b(?:if|switch|match|case)\b"), count(r"\b(?:for|while|loop)\b"), count(r"\b(?:try|catch|throw|panic)\b"), count(r"\b(?:async|await)\b") + m[0].count("async"), count(r"\bassert\w*\b")]
        returned = count(r"\breturn\b")
        gives = "void" if not returned else "conditional" if counts[0] and returned > 1 else "value"
        doc = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:[@\w][^\n{};]*\s*)?$", source[:at], re.S)
        text = " ".join(re.sub(r"^\s*\*+ ?", "", x).strip() for x in doc[1].split("\n")).strip() if doc else None
        mutates = bool(re.search(r"\b(?:this|self)\s*(?:\.|->)\s*\w+\s*(?:[-+*/]?=)(?!=)|\w\[[^\]]*\]\s*=(?!=)", body))
        return _row(path, language, kind, m["name"], parent, line_of(at), line_of(max(at, end - 1)), source[at:end], " ".join(source[at : m.end()].split()), args, (groups.get("ret") or "").strip() or None, [], text, counts, mutates, gives), at, end

    spans, seen = [], set()
    for m in re.finditer(classes, bare, re.M) if classes else ():
        row, at, end = symbol(m, "class", None)
        spans.append((at, end, m["name"]))
        if language != "rust" or not m[0].startswith("impl"):
            yield row
    within = lambda at: next((n for a, b, n in spans if a < at < b), None)
    for pattern in [*functions, *([methods] if methods else [])]:
        for m in re.finditer(pattern, bare, re.M):
            place = m.start("name")
            parent = within(place)
            if place in seen or (pattern is methods and not parent):
                continue
            seen.add(place)
            yield symbol(m, "method" if parent else "function", parent)[0]


def symbols(files: DataFrame) -> DataFrame:
    """The symbols (SYMBOL) of code files (relative_path, language, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOL.split(", ")]
        for frame in frames:
            rows = [r for path, language, content in zip(frame["relative_path"], frame["language"], frame["content"].fillna(""), strict=True) for r in (python_symbols(path, content) if language == "python" else braced_symbols(path, language, content))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("relative_path", "language", "content").mapInPandas(run, SYMBOL)


def complexity(conditionals: Column, loops: Column, handlers: Column, asyncs: Column, lines: Column) -> Column:
    size = F.when(lines > 100, 5).when(lines > 50, 3).when(lines > 20, 1).otherwise(0)
    score = 2 * conditionals + 3 * loops + 2 * handlers + asyncs + size
    return F.when(score <= 3, "simple").when(score <= 8, "moderate").otherwise("complex")


def frameworks(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    hit = lambda strings: F.greatest(*[F.contains(code, F.lit(s)).cast("int") for s in strings], F.lit(0)) == 1
    return F.array_compact(F.array(*[F.when(hit(s), F.lit(name)) for name, s in FRAMEWORKS.items()]))


def hints(name: Column, docstring: Column, parameters: Column) -> Column:
    """Distinct hints of the name, docstring or parameters, in the table's order."""
    texts = [F.translate(F.lower(name), "_", " "), F.lower(F.coalesce(docstring, F.lit(""))), F.lower(F.array_join(parameters, " "))]
    return F.array_distinct(F.array_compact(F.array(*[F.when(texts[0].rlike(p) | texts[1].rlike(p) | texts[2].rlike(p), F.lit(h)) for p, h in HINTS])))


def short_doc(doc: Column | str, limit: int = 200) -> Column:
    """A docstring of at most `limit` characters: whole, its first sentence (with parameters and returns if they fit), or cut between words."""
    doc = F.trim(F.col(doc) if isinstance(doc, str) else doc)
    first = F.nullif(F.trim(F.regexp_extract(doc, r"^([^.!?\n]+[.!?])", 1)), F.lit(""))
    part = lambda name, until, chars: F.nullif(F.left(F.trim(F.regexp_extract(doc, rf"(?is)(?:{name}):?\s*\n?(.*?)(?=\n\s*\n|{until}|$)", 1)), F.lit(chars)), F.lit(""))
    extra = F.concat_ws("; ", F.concat(F.lit("params: "), part("Args|Parameters|Arguments", "Returns|Raises", 100)), F.concat(F.lit("returns: "), part("Returns?", "Raises", 50)))
    room = limit - F.length(first) - 4
    summary = F.when((room > 50) & (extra != "") & (F.length(extra) <= room), F.concat_ws(" ", first, extra)).otherwise(first)
    head = F.left(doc, F.lit(limit))
    word = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    cut = F.concat(F.when(F.length(word) > 0.7 * limit, word).otherwise(head), F.lit("..."))
    return F.when(F.length(doc) <= limit, doc).when(first.isNotNull() & (F.length(first) <= limit), summary).otherwise(cut)


def described(found: DataFrame) -> DataFrame:
    """Symbols with ids, flags, tiers, dependencies and the text that they are searched by."""
    n = F.size("parameters")
    shown = F.array_join(F.slice("parameters", 1, 3), ", ")
    takes = F.when(n == 0, "takes no parameters").when(n == 1, F.concat(F.lit("takes 1 parameter ("), F.get("parameters", F.lit(0)), F.lit(")"))).otherwise(F.concat(F.lit("takes "), n, F.lit(" parameters ("), shown, F.when(n > 3, ", ...").otherwise(""), F.lit(")")))
    at = found.withColumn("qualified_name", F.concat_ws(".", "parent_scope", "symbol_name")).withColumns({"has_conditionals": F.col("conditionals") > 0, "has_loops": F.col("loops") > 0, "has_error_handling": F.col("handlers") > 0, "has_async": F.col("asyncs") > 0, "has_validation": F.col("validations") > 0})
    at = at.withColumn("is_pure", ~(F.col("has_mutations") | F.col("has_error_handling") | F.col("has_async")) & (F.col("conditionals") <= 1))
    at = at.withColumn("complexity_tier", complexity(F.col("conditionals"), F.col("loops"), F.col("handlers"), F.col("asyncs"), F.col("end_line") - F.col("start_line") + 1))
    at = at.withColumns({"normalized_name_tokens": identifier_words("symbol_name"), "framework_patterns": frameworks("content"), "external_calls": dotted_calls("content"), "inline_comments": inline_comments("content"), "algorithm_hints": hints(F.col("symbol_name"), F.col("docstring"), F.col("parameters"))})
    where = F.concat(F.col("symbol_type"), F.lit(" "), F.coalesce(F.nullif(readable("normalized_name_tokens"), F.lit("")), F.col("symbol_name")), F.coalesce(F.concat(F.lit(" in class "), "parent_scope"), F.lit("")), F.lit(" in "), "language", F.lit(" file "), "relative_path", F.lit("."))
    said = [("has_conditionals", "contains conditional logic"), ("has_loops", "contains loops"), ("has_error_handling", "handles errors"), ("has_async", "is asynchronous"), ("has_validation", "performs validation"), ("is_pure", "is a pure function"), ("has_mutations", "mutates state")]
    does = F.nullif(F.concat_ws(", ", *[F.when(F.col(c), F.lit(t)) for c, t in said]), F.lit(""))
    listed = lambda c: F.nullif(F.array_join(F.slice(c, 1, 3), ", "), F.lit(""))
    callable_ = F.col("symbol_type").isin("function", "method")
    text = F.concat_ws(
        " ", where, F.concat(F.lit("implements "), listed("algorithm_hints"), F.lit(".")), F.when(callable_, F.concat(F.concat_ws(" and ", takes, F.concat(F.lit("returns "), "return_type")), F.lit("."))),
        F.concat(does, F.lit(".")), F.concat("complexity_tier", F.lit(" complexity.")), F.concat(F.lit("uses "), listed("framework_patterns"), F.lit(".")), F.concat(F.lit("documentation: "), F.nullif(short_doc("docstring"), F.lit(""))),
    )
    return at.withColumn("search_text", text).withColumn("chunk_id", F.concat_ws(":", "relative_path", "qualified_name", "start_line"))


def symbol_chunks(files: DataFrame) -> DataFrame:
    """(chunk_id, parent_chunk_id, relative_path, language, symbol_type, start_line, end_line, content, search_text, is_sub_chunk): symbols, those over
    SYMBOL_CHARS characters in parts with a context header, and line windows of files without symbols."""
    every = described(symbols(files))
    keys = ("chunk_id", "relative_path", "language", "symbol_type", "start_line", "search_text")
    doc = F.concat(F.lit("# "), F.translate(F.left("docstring", F.lit(100)), "\n", " "), F.lit("...\n"))
    header = F.concat(F.lit("# Context: "), F.coalesce("signature", F.concat_ws(" ", "symbol_type", "symbol_name")), F.lit("\n"), F.coalesce(doc, F.lit("")))
    small = every.filter(F.length("content") <= SYMBOL_CHARS).select("chunk_id", F.lit(None).cast("string").alias("parent_chunk_id"), "relative_path", "language", "symbol_type", "start_line", "end_line", "content", "search_text", F.lit(False).alias("is_sub_chunk"))
    parts = symbol_parts(every.filter(F.length("content") > SYMBOL_CHARS).withColumn("header", header), keys)
    first = (F.col("start_line") + F.col("start_idx")).cast("int")
    long = parts.select(F.concat(F.regexp_replace("chunk_id", r":\d+$", ""), F.lit(":"), first, F.lit("-"), "chunk").alias("chunk_id"), F.col("chunk_id").alias("parent_chunk_id"), "relative_path", "language", "symbol_type", first.alias("start_line"), (F.col("start_line") + F.col("end_idx")).cast("int").alias("end_line"), "content", F.concat("search_text", F.lit(" (part "), F.col("chunk") + 1, F.lit(")")).alias("search_text"), F.lit(True).alias("is_sub_chunk"))
    rest = fallback_chunks(files.join(every.select("relative_path").distinct(), "relative_path", "left_anti"))
    rest = rest.select("chunk_id", F.lit(None).cast("string").alias("parent_chunk_id"), "relative_path", "language", "symbol_type", "start_line", "end_line", "content", "search_text", F.lit(False).alias("is_sub_chunk"))
    return small.unionByName(long).unionByName(rest)
