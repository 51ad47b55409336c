"""Queries over page blocks, sections and windows, with the SQL that states the same result. The blocks are made of the lines of
all documents: six to a page, with running heads, headings, two columns in some papers, and fonts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilume.operators import chunking, structure
from verilume.plans import sql
from verilume.plans.catalog import query, read

HEADS = ["Abstract", "2 Methods", "References", "Related work"]

_BLOCKS = f"""lines AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
blocks AS (SELECT paper_id, seq, seq // 6 AS page, CASE seq % 6 WHEN 0 THEN 'Running head ' || (seq // 6) WHEN 3 THEN ([{', '.join(map(sql.quoted, HEADS))}])[(seq // 6) % 4 + 1] ELSE line END AS text,
  CASE WHEN seq % 2 = 0 THEN 50.0 ELSE 330.0 END AS x0, CASE WHEN seq % 2 = 0 THEN 280.0 ELSE 560.0 END + CASE WHEN paper_id % 3 = 0 THEN 200 ELSE 0 END AS x1, 20.0 + seq % 6 * 125 AS y0, 50.0 + seq % 6 * 125 AS y1,
  10.0 + CASE WHEN seq % 6 = 3 THEN 4 ELSE 0 END + CASE WHEN seq = 1 THEN 8 ELSE 0 END AS size, seq % 6 = 3 AS bold FROM lines)"""  # fmt: skip


def blocks(spark, sf_dir) -> DataFrame:
    at = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    page, place, wide = F.floor(F.col("seq") / 6), F.col("seq") % 6, F.when(F.col("paper_id") % 3 == 0, 200.0).otherwise(0.0)
    head = F.element_at(F.array(*map(F.lit, HEADS)), (page % 4 + 1).cast("int"))
    said = F.when(place == 0, F.concat(F.lit("Running head "), page)).when(place == 3, head).otherwise(F.col("line"))
    left = F.col("seq") % 2 == 0
    size = 10.0 + F.when(place == 3, 4.0).otherwise(0.0) + F.when(F.col("seq") == 1, 8.0).otherwise(0.0)
    return at.select(
        "paper_id", F.col("seq").cast("long"), page.cast("long").alias("page"), said.alias("text"), F.when(left, 50.0).otherwise(330.0).alias("x0"), (F.when(left, 280.0).otherwise(560.0) + wide).alias("x1"),
        (20.0 + place * 125).alias("y0"), (50.0 + place * 125).alias("y1"), size.alias("size"), (place == 3).alias("bold"),
    )


@query(f"""WITH {_BLOCKS}, spans AS (SELECT paper_id, seq, left(text, 5) AS t, size AS s, bold AS b FROM blocks UNION ALL SELECT paper_id, seq, substr(text, 6), size + paper_id % 2 * 0.5, seq % 2 = 0 FROM blocks),
w AS (SELECT paper_id, seq, s, sum(length(t)) AS n, sum(CASE WHEN b THEN length(t) ELSE 0 END) AS bn FROM spans GROUP BY ALL)
SELECT paper_id, seq, arg_max(s, {{'n': n, 's': s}})::DOUBLE AS size, sum(bn) > 0.5 * sum(n) AS bold FROM w GROUP BY paper_id, seq""")
def doc01_dominant_font(spark, sf_dir):
    span = lambda text, size, bold: F.struct(text.alias("text"), size.alias("size"), bold.alias("bold"))
    second = span(F.substring(F.col("text"), 6, F.length("text")), F.col("size") + F.col("paper_id") % 2 * 0.5, F.col("seq") % 2 == 0)
    spans = F.array(span(F.left("text", F.lit(5)), F.col("size"), F.col("bold")), second)
    return structure.dominant_font(blocks(spark, sf_dir).withColumn("spans", spans).drop("size", "bold")).select("paper_id", "seq", "size", "bold")


_LAYOUT = r"lower(trim(regexp_replace(text, '\d+', '#', 'g')))"
_RUNNING = f"""pages AS (SELECT paper_id, count(DISTINCT page) AS pages FROM blocks GROUP BY paper_id),
running AS (SELECT paper_id, layout FROM (SELECT paper_id, {_LAYOUT} AS layout, page, y0 FROM blocks WHERE length(trim(text)) < 100) JOIN pages USING (paper_id) WHERE layout <> ''
GROUP BY paper_id, layout, pages HAVING pages >= 3 AND count(DISTINCT page) >= 0.7 * pages AND max(y0) - min(y0) <= 20)"""


@query(f"WITH {_BLOCKS}, {_RUNNING} SELECT paper_id, layout FROM running")
def doc03_repeated_blocks(spark, sf_dir):
    return structure.repeated_blocks(blocks(spark, sf_dir))


@query(f"WITH {_BLOCKS}, {_RUNNING} SELECT paper_id, seq, text FROM blocks b WHERE NOT ((y0 < 79.2 OR y1 > 712.8) AND EXISTS (SELECT 1 FROM running r WHERE r.paper_id = b.paper_id AND r.layout = {_LAYOUT}))")
def doc04_without_running_lines(spark, sf_dir):
    return structure.without_running_lines(blocks(spark, sf_dir)).select("paper_id", "seq", "text")


@query(f"""WITH {_BLOCKS}, s AS (SELECT *, (x0 + x1) / 2 AS mid FROM blocks), f AS (SELECT *, mid < 306 AND x1 <= 326 AS l, mid >= 306 AND x0 >= 286 AS r FROM s),
two AS (SELECT paper_id, page, count(*) >= 4 AND count_if(l) / count(*) > 0.3 AND count_if(r) / count(*) > 0.3 AND count_if(NOT l AND NOT r) / count(*) < 0.15 AS two FROM f GROUP BY ALL)
SELECT paper_id, page, text, row_number() OVER (PARTITION BY paper_id ORDER BY page, CASE WHEN two AND mid >= 306 THEN 1 ELSE 0 END, y0, seq) - 1 AS seq FROM f JOIN two USING (paper_id, page)""")
def doc05_doc06_reading_order(spark, sf_dir):
    return structure.reading_order(blocks(spark, sf_dir)).select("paper_id", "page", "text", F.col("seq").cast("long"))


_PROFILE = """used AS (SELECT paper_id, round(size * 2) / 2 AS half, sum(length(text)) AS n FROM blocks GROUP BY ALL),
body AS (SELECT paper_id, arg_max(half, {'n': n, 'h': -half}) AS body, list_sort(list(half), 'DESC') AS sizes FROM used GROUP BY paper_id),
profile AS (SELECT paper_id, body::DOUBLE AS body, coalesce(larger[2], 12.0)::DOUBLE AS header, coalesce(larger[1], 14.0)::DOUBLE AS title FROM (SELECT paper_id, body, list_filter(sizes, lambda s: s > body + 0.5) AS larger FROM body))"""


@query(f"WITH {_BLOCKS}, {_PROFILE} SELECT * FROM profile")
def doc07_font_profile(spark, sf_dir):
    return structure.font_profile(blocks(spark, sf_dir))


_CLASSES = f"""classes AS (SELECT b.*, coalesce({sql.heading_role('text')}, CASE WHEN page = 0 AND length(text) < {structure.TITLE_CHARS} AND size >= title - 0.5 AND size > body + 0.5 THEN 'title'
WHEN length(text) < {structure.HEADER_CHARS} AND size > body + 0.5 AND (bold OR size > body + 1) THEN 'section_header' ELSE 'body' END) AS role FROM blocks b JOIN profile USING (paper_id))"""


@query(f"WITH {_BLOCKS}, {_PROFILE}, {_CLASSES} SELECT paper_id, seq, role FROM classes")
def doc08_font_roles(spark, sf_dir):
    return structure.classify(blocks(spark, sf_dir)).select("paper_id", "seq", "role")


_REFS = f"(regexp_matches(text, {sql.quoted(sql._plain(structure.REFERENCES))}) AND (role IN ('section_header', 'subsection_header', 'title') OR bold))"


@query(f"WITH {_BLOCKS}, {_PROFILE}, {_CLASSES}, s AS (SELECT *, min(CASE WHEN {_REFS} THEN seq END) OVER (PARTITION BY paper_id) AS stop FROM classes) SELECT paper_id, seq FROM s WHERE stop IS NULL OR seq < stop")
def doc09_before_references(spark, sf_dir):
    return structure.before_references(structure.classify(blocks(spark, sf_dir))).select("paper_id", "seq")


@query(f"""WITH {_BLOCKS}, {_PROFILE}, {_CLASSES}, s AS (SELECT *, min(CASE WHEN regexp_matches(lower(trim(text)), '^abstract\\s*[:.]?$') THEN seq END) OVER (PARTITION BY paper_id) AS a FROM classes),
e AS (SELECT *, coalesce(min(CASE WHEN role IN ('section_header', 'subsection_header') AND seq > a THEN seq END) OVER (PARTITION BY paper_id), a + 10) AS z FROM s)
SELECT paper_id, seq, coalesce(seq >= a AND seq < z, false) AS in_abstract FROM e""")
def doc10_abstract(spark, sf_dir):
    return structure.abstract(structure.classify(blocks(spark, sf_dir))).select("paper_id", "seq", "in_abstract")


@query()
def doc13_parse_blocks(spark, sf_dir):
    spans = F.array(F.struct("text", "size", "bold"))
    return structure.parse_blocks(blocks(spark, sf_dir).withColumn("spans", spans).drop("size", "bold"))


_NAMED = "(" + " OR ".join([r"regexp_matches(line, '^#{1,6}\s+\S')", f"regexp_matches(lower(trim(line)), {sql.quoted(structure.KNOWN_SECTION)})"]) + ")"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS seq FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE replace(replace(text, '. ', '.' || chr(10) || 'Results' || chr(10)), ', ', chr(10) || '## Part' || chr(10)) END AS x FROM documents)),
h AS (SELECT *, {_NAMED} AS head FROM l), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS section FROM h),
s AS (SELECT doc_id, section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+\\s*', '')) END) AS name, trim(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY seq)) AS content FROM g GROUP BY ALL)
SELECT doc_id, section::BIGINT AS section, coalesce(name, 'Document') AS name, content FROM s WHERE content <> ''""")
def doc15_named_sections(spark, sf_dir):
    more = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\nResults\n")), F.lit(", "), F.lit("\n## Part\n"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(more).alias("text"))
    return structure.named_sections(d)


_LINES = "SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents"


@query(rf"""WITH l AS ({_LINES}), h AS (SELECT *, trim(coalesce(nullif(regexp_extract(line, '^#+\s*(.+?)$', 1), ''), nullif(regexp_extract(line, '^(\d+\.?\s*[A-Z][^.\n]+)$', 1), ''), nullif(regexp_extract(line, '^([A-Z][A-Z\s]+)$', 1), ''))) AS head FROM l),
g AS (SELECT *, sum((head IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS section FROM h),
e AS (SELECT doc_id, section::BIGINT AS section, coalesce(max(head), 'Introduction') AS name, string_agg(line, chr(10) ORDER BY seq) FILTER (head IS NULL) AS content FROM g GROUP BY doc_id, section HAVING count_if(head IS NULL) > 0),
c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 6000) AS INT), 1))) AS i FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM e GROUP BY doc_id HAVING count(*) > 1))
SELECT * FROM e UNION ALL SELECT doc_id, i + 1000, 'Section ' || (i + 1), substr(text, i * 6000 + 1, 6000) FROM c""")
def doc16_line_sections(spark, sf_dir):
    return structure.line_sections(read(spark, sf_dir, "documents"))


@query(rf"""WITH l AS ({_LINES}), m AS (SELECT *, max(regexp_matches(lower(line), 'method|experiment|result|implementation|training|evaluation|dataset|hyperparameter|setup')::INT) OVER w AS on_, max(regexp_matches(lower(trim(line)), '^(references|bibliography)')::INT) OVER w AS off_ FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY seq) AS used FROM m WHERE on_ = 1 AND off_ = 0),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY seq) AS tail FROM u WHERE used <= 2000 GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), substr(text, 1, 1000), tail) AS excerpt FROM documents LEFT JOIN t USING (doc_id)""")
def doc18_relevant_text(spark, sf_dir):
    return structure.relevant_text(read(spark, sf_dir, "documents"), 3000)


_SNAP = "b + 500 - least(CASE WHEN contains(p, '.') THEN strpos(reverse(p), '.') ELSE 9999 END, CASE WHEN contains(p, chr(10)) THEN strpos(reverse(p), chr(10)) ELSE 9999 END)"
_ENDS = f"(SELECT *, CASE WHEN b + 500 < length(text) AND {_SNAP} > b + 250 THEN {_SNAP} + 1 ELSE least(b + 500, length(text)) END AS e FROM (SELECT *, substr(text, b + 1, 500) AS p FROM w))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, trim(text) AS text FROM documents), w AS (SELECT doc_id, text, 0 AS chunk, 0::BIGINT AS b FROM d WHERE text <> '' UNION ALL SELECT doc_id, text, chunk + 1, e - 100 FROM {_ENDS} WHERE e < length(text))
SELECT doc_id, chunk, b AS start_idx, e AS end_idx, trim(substr(text, b + 1, e - b), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM {_ENDS} WHERE trim(substr(text, b + 1, e - b), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def chk09_page_windows(spark, sf_dir):
    return chunking.page_windows(read(spark, sf_dir, "documents")).select("doc_id", "chunk", "start_idx", "end_idx", "content")


@query()
def chk05_chk07_section_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("section"), F.lit("Methods").alias("name"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"))
    return chunking.section_chunks(d)


@query("SELECT paper_id, count(*) AS chunks FROM (SELECT doc_id AS paper_id FROM documents WHERE text <> '') GROUP BY paper_id")
def chk11_short_papers(spark, sf_dir):
    """Every paper by the way that its kind asks for; short texts, so that each way gives one chunk."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 3 == 0, "text").otherwise("pdf").alias("source_type"), F.substring_index("text", " ", 1).alias("content"))
    s = d.withColumn("section", F.lit(0).cast("long")).withColumn("name", F.when(F.col("paper_id") % 3 == 1, "Methods"))
    return chunking.paper_chunks(d.filter("content != ''"), s.filter("content != ''")).groupBy("paper_id").agg(F.count("*").alias("chunks"))
