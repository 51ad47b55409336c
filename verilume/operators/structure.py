"""Document structure: from page blocks, paragraphs or lines to named sections.

Blocks are rows (paper_id, seq, page, x0, y0, x1, y1, text, spans array<struct<text, size, bold>>). Everything is windows and
aggregates partitioned by paper, so papers are processed in parallel and one paper's blocks are sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verilume.functions.text import layout_key

#: Headings by pattern, in order, and the role they give.
_NAMES = "introduction|methods?|methodology|results?|discussion|conclusions?|background|related\\s+work|experiments?|analysis"
HEADINGS = [
    (r"(?iu)^\s*\d+\.?\s+(" + _NAMES + r"|implementation|evaluation|limitations?|future\s+work)\s*$", "section_header"),
    (r"(?iu)^\s*(abstract|" + _NAMES + r"|acknowledgments?|declarations?|data\s+availability|supplementary|appendix)\s*$", "section_header"),
    (r"(?iu)^\s*\d+\.\d+\.?\s+[\p{L}\p{N}_]", "subsection_header"),
    (r"(?iu)^\s*[A-Z]\.\s+[\p{L}\p{N}_]", "subsection_header"),
]
#: Headings that begin the list of references.
REFERENCES = r"(?iu)^\s*(?:references?|bibliography|works?\s+cited|literature\s+cited|\d+\.?\s+references?)\s*$"
#: Words in section names that decide about their claims, the leaving out first.
SKIPPED = "introduction|related work|prior work|background|conclusion|future work|future direction|acknowledgment|acknowledgement|reference|bibliography|abstract|appendix".split("|")
IMPORTANT = "method|approach|experiment|result|implementation|training|evaluation|architecture|dataset|data|setup|hyperparameter|configuration|config|ablation".split("|")
TITLE_CHARS, HEADER_CHARS = 200, 100


def _paper(*order: str):
    """A paper's rows, in this order."""
    window = Window.partitionBy("paper_id")
    return window.orderBy(*order) if order else window


def dominant_font(blocks: DataFrame) -> DataFrame:
    """`blocks` with size (the size with most characters, the smaller of equal ones last) and bold (over half of the characters)."""
    at = blocks.select("paper_id", "seq", F.explode("spans").alias("s")).select("paper_id", "seq", "s.size", F.length("s.text").alias("n"), "s.bold")
    weight = at.groupBy("paper_id", "seq", "size").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("b"))
    font = weight.groupBy("paper_id", "seq").agg(F.max_by("size", F.struct("n", "size")).alias("size"), (F.sum("b") > 0.5 * F.sum("n")).alias("bold"))
    return blocks.join(font, ["paper_id", "seq"], "left")


def repeated_blocks(blocks: DataFrame, min_pages: int = 3, share: float = 0.7, spread: float = 20.0) -> DataFrame:
    """(paper_id, layout): short texts that stand at about the same height on most pages."""
    pages = blocks.groupBy("paper_id").agg(F.count_distinct("page").alias("pages"))
    at = blocks.filter(F.length(F.trim("text")) < 100).withColumn("layout", layout_key("text")).filter("layout != ''")
    each = at.groupBy("paper_id", "layout").agg(F.count_distinct("page").alias("on"), (F.max("y0") - F.min("y0")).alias("range"))
    return each.join(pages, "paper_id").filter((F.col("pages") >= min_pages) & (F.col("on") >= share * F.col("pages")) & (F.col("range") <= spread)).select("paper_id", "layout")


def without_running_lines(blocks: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Leave out repeated blocks in the top and bottom tenth of a page."""
    edge = (F.col("y0") < 0.1 * page_height) | (F.col("y1") > 0.9 * page_height)
    found = repeated_blocks(blocks).withColumnRenamed("paper_id", "_p").withColumnRenamed("layout", "_l")
    return blocks.join(found, (F.col("paper_id") == F.col("_p")) & (layout_key("text") == F.col("_l")) & edge, "left_anti")


def reading_order(blocks: DataFrame, page_width: float = 612.0) -> DataFrame:
    """`blocks` with seq in reading order: two-column pages (four blocks or more, both halves well filled, the middle not) by column."""
    middle = page_width / 2
    mid = (F.col("x0") + F.col("x1")) / 2
    page = Window.partitionBy("paper_id", "page")
    n = F.count("*").over(page)
    share = lambda cond: F.count_if(cond).over(page) / n
    left, right = (mid < middle) & (F.col("x1") <= middle + 20), (mid >= middle) & (F.col("x0") >= middle - 20)
    two = (n >= 4) & (share(left) > 0.3) & (share(right) > 0.3) & (share(~left & ~right) < 0.15)
    at = blocks.withColumn("_column", F.when(two & (mid >= middle), 1).otherwise(0))
    order = _paper("page", "_column", "y0", "seq")
    return at.withColumn("seq", F.row_number().over(order) - 1).drop("_column")


def font_profile(blocks: DataFrame) -> DataFrame:
    """(paper_id, body, header, title): the sizes of half points by their use; 10, 12 and 14 where there is nothing larger."""
    at = blocks.withColumn("half", F.round(F.col("size") * 2) / 2).groupBy("paper_id", "half").agg(F.sum(F.length("text")).alias("n"))
    at = at.groupBy("paper_id").agg(F.max_by("half", F.struct("n", -F.col("half"))).alias("body"), F.sort_array(F.collect_set("half"), False).alias("sizes"))
    larger = F.filter("sizes", lambda s: s > F.col("body") + 0.5)
    return at.select("paper_id", F.coalesce("body", F.lit(10.0)).alias("body"), F.coalesce(F.get(larger, F.lit(1)), F.lit(12.0)).alias("header"), F.coalesce(F.get(larger, F.lit(0)), F.lit(14.0)).alias("title"))


def heading_role(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    out = F.when(F.lit(False), F.lit(""))
    for pattern, role in HEADINGS:
        out = out.when(text.rlike(pattern), F.lit(role))
    return out


def classify(blocks: DataFrame) -> DataFrame:
    """`blocks` (with size and bold) with role: a heading by its words, else by its font, else body."""
    at = blocks.join(font_profile(blocks), "paper_id", "left")
    title = (F.col("page") == 0) & (F.length("text") < TITLE_CHARS) & (F.col("size") >= F.col("title") - 0.5) & (F.col("size") > F.col("body") + 0.5)
    header = (F.length("text") < HEADER_CHARS) & (F.col("size") > F.col("body") + 0.5) & (F.col("bold") | (F.col("size") > F.col("body") + 1))
    role = F.coalesce(heading_role("text"), F.when(title, "title").when(header, "section_header").otherwise("body"))
    return at.withColumn("role", role).drop("body", "header", "title")


def before_references(blocks: DataFrame) -> DataFrame:
    """The blocks before the first heading of the references."""
    starts = F.col("text").rlike(REFERENCES) & (F.col("role").isin("section_header", "subsection_header", "title") | F.col("bold"))
    at = blocks.withColumn("_from", F.min(F.when(starts, F.col("seq"))).over(_paper()))
    return at.filter(F.col("_from").isNull() | (F.col("seq") < F.col("_from"))).drop("_from")


def abstract(blocks: DataFrame, blind: int = 10) -> DataFrame:
    """`blocks` with in_abstract: from the heading "abstract" to the next heading, or `blind` blocks if none follows."""
    head = F.lower(F.trim("text")).rlike(r"^abstract\s*[:.]?$")
    start = F.min(F.when(head, F.col("seq"))).over(_paper())
    at = blocks.withColumn("_start", start)
    follows = F.col("role").isin("section_header", "subsection_header") & (F.col("seq") > F.col("_start"))
    at = at.withColumn("_end", F.coalesce(F.min(F.when(follows, F.col("seq"))).over(_paper()), F.col("_start") + blind))
    return at.withColumn("in_abstract", F.coalesce((F.col("seq") >= F.col("_start")) & (F.col("seq") < F.col("_end")), F.lit(False))).drop("_start", "_end")


def sections(blocks: DataFrame) -> DataFrame:
    """(paper_id, section, name, section_type, content, start_page, end_page): gaps and islands between headings. Rows: role, text."""
    opens = F.col("role").isin("section_header", "title")
    first = F.row_number().over(_paper("seq")) == 1
    at = blocks.withColumn("section", F.sum((opens | first).cast("int")).over(_paper("seq")))
    head = first & ~opens & (F.col("role") == "body")
    said = F.when(opens | (first & (F.col("role") == "subsection_header")), F.lit(None)).when(F.col("role") == "subsection_header", F.concat(F.lit("\n"), F.trim("text"), F.lit("\n"))).otherwise(F.col("text"))
    at = at.withColumn("_said", said).withColumn("_name", F.when(head, "Body").when(opens | first, F.trim("text")))
    each = at.groupBy("paper_id", "section").agg(F.max("_name").alias("name"), F.sort_array(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("seq", "_said")))).alias("parts"), (F.min("page") + 1).alias("start_page"), (F.max("page") + 1).alias("end_page"))
    text = F.trim(F.array_join(F.transform("parts", lambda p: p["_said"]), "\n"))
    return each.select("paper_id", "section", "name", F.lit("body").alias("section_type"), text.alias("content"), "start_page", "end_page").filter("content != ''")


def with_offsets(rows: DataFrame, order: str, text: str, gap: int = 1) -> DataFrame:
    """`rows` with start_idx and end_idx of each text in the paper's texts joined by `gap` characters."""
    before = _paper(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return rows.withColumn("start_idx", start).withColumn("end_idx", F.col("start_idx") + F.length(text))


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """All steps from raw blocks to sections with offsets; the abstract is a section of its own, in front."""
    at = reading_order(without_running_lines(blocks))
    at = abstract(before_references(classify(dominant_font(at))))
    body = sections(at.filter("not in_abstract"))
    own = at.filter("in_abstract").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"), (F.min("page") + 1).alias("start_page"), (F.max("page") + 1).alias("end_page"))
    said = F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    said = F.trim(F.regexp_replace(said, r"(?i)^abstract:?\s*(\n|$)", ""))
    front = own.select("paper_id", F.lit(0).cast("long").alias("section"), F.lit("Abstract").alias("name"), F.lit("abstract").alias("section_type"), said.alias("content"), "start_page", "end_page").filter("content != ''")
    return with_offsets(front.unionByName(body), "section", "content")


def text_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, paragraph, start_idx): what lies between empty lines; blank ones are left out but counted in the offsets."""
    parts = docs.select(F.col(key), F.posexplode(F.split(text, "\n\n", -1)).alias("seq", "paragraph"))
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("start_idx", F.coalesce(F.sum(F.length("paragraph") + 2).over(before), F.lit(0)))
    return at.filter(F.trim("paragraph") != "")


def line_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = "Introduction", fallback_chars: int = 6000) -> DataFrame:
    """(key, section, name, content): lines grouped under markdown, numbered or capital headings; a text with one section at most
    gets slices of `fallback_chars` characters as well."""
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("seq", "line"))
    name = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in (r"^#+\s*(.+?)$", r"^(\d+\.?\s*[A-Z][^.\n]+)$", r"^([A-Z][A-Z\s]+)$")])
    at = lines.withColumn("_head", F.trim(name))
    order = Window.partitionBy(key).orderBy("seq")
    at = at.withColumn("section", F.sum(F.col("_head").isNotNull().cast("int")).over(order))
    each = at.groupBy(key, "section").agg(F.max("_head").alias("name"), F.sort_array(F.collect_list(F.when(F.col("_head").isNull(), F.struct("seq", "line")))).alias("parts"))
    each = each.filter(F.size("parts") > 0).select(key, "section", F.coalesce("name", F.lit(first)).alias("name"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("content"))
    single = docs.select(key, text).join(each.groupBy(key).count().filter("count > 1").select(key), key, "left_anti")
    cut = single.select(key, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / fallback_chars) - 1, F.lit(0)).cast("int"))).alias("i"), text).filter(F.length(text) > 0)
    cut = cut.select(key, (F.col("i") + 1000).cast("long").alias("section"), F.concat(F.lit("Section "), F.col("i") + 1).alias("name"), F.substring(F.col(text), F.col("i") * fallback_chars + 1, F.lit(fallback_chars)).alias("content"))
    return each.unionByName(cut)


#: Names that open a section when they stand alone in a line, with or without a number and a colon.
KNOWN_SECTION = r"^(\d+\.?\s*)?(abstract|introduction|background|related work|methods?|methodology|experiments?|results|discussion|conclusions?|references)\s*:?$"


def named_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: str = "Document") -> DataFrame:
    """(key, section, name, content): lines under markdown headings and lines that are a known section's name; what comes before the first
    (or a text without any) is named `whole`."""
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("seq", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+\S") | F.lower(F.trim("line")).rlike(KNOWN_SECTION)
    at = lines.withColumn("_head", head).withColumn("section", F.sum(F.col("_head").cast("int")).over(Window.partitionBy(key).orderBy("seq")))
    said = F.sort_array(F.collect_list(F.when(~F.col("_head"), F.struct("seq", "line"))))
    each = at.groupBy(key, "section").agg(F.max(F.when(F.col("_head"), F.trim(F.regexp_replace("line", r"^#+\s*", "")))).alias("name"), said.alias("parts"))
    content = F.trim(F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    return each.select(key, "section", F.coalesce("name", F.lit(whole)).alias("name"), content.alias("content")).filter("content != ''")


def is_important(name: Column | str) -> Column:
    """Whether a section may hold claims that code can be held against."""
    name = F.col(name) if isinstance(name, str) else name
    has = lambda words: F.lower(name).rlike("|".join(words))
    return F.when(has(SKIPPED), False).otherwise(has(IMPORTANT) | name.startswith("Section "))


def relevant_text(docs: DataFrame, budget: int = 15000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, excerpt): the beginning (3,000 characters or a third of the budget), then lines from the first marker on until the budget
    is used or the references begin."""
    head = min(3000, budget // 3)
    lines = docs.select(F.col(key), F.substring(text, 1, head).alias("_head"), F.posexplode(F.split(text, "\n", -1)).alias("seq", "line"))
    order = Window.partitionBy(key).orderBy("seq")
    marker = F.lower("line").rlike("method|experiment|result|implementation|training|evaluation|dataset|hyperparameter|setup")
    at = lines.withColumn("_on", F.max(marker.cast("int")).over(order)).withColumn("_off", F.max(F.lower(F.trim("line")).rlike(r"^(references|bibliography)").cast("int")).over(order))
    at = at.filter("_on = 1 and _off = 0").withColumn("_used", F.sum(F.length("line") + 1).over(order))
    tail = at.filter(F.col("_used") <= budget - head).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda p: p["line"]), "\n").alias("tail"))
    return docs.select(F.col(key), F.substring(text, 1, head).alias("_head")).join(tail, key, "left").select(key, F.concat_ws("\n", "_head", "tail").alias("excerpt"))
