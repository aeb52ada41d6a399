"""Registered queries over texts, conversations and events; see ``registered`` for the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, cleaning, joblog, quality, repair, review
from .registered import JOBS, _derived, _sql, _table, register

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def docs(spark, d):
    return _table(spark, d, "documents")


# --- normal forms and scalar functions -------------------------------------------------------

RAW = "concat(replace(text, '. ', '.  \r\n\r\n\r\n\r\n'), chr(7), ' \t')"


@register(
    "r5_normalise_text",
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + RAW + ", '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', concat(chr(10), chr(10)), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.normalise_text(F.concat(F.replace("text", F.lit(". "), F.lit(".  \r\n\r\n\r\n\r\n")), F.lit("\x07 \t"))).alias("text"))


@register(
    "f6_excerpt",
    "SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE concat(regexp_replace(CASE WHEN contains(substr(t, 1, 80), ' ') THEN regexp_replace(substr(t, 1, 80), ' [^ ]*$', '') ELSE substr(t, 1, 80) END, '\\s+$', ''), '…') END AS excerpt FROM (SELECT doc_id, "
    + TRIM.format("text") + " AS t FROM documents)",
)
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.excerpt(F.col("text"), 80).alias("excerpt"))


MARKED = "concat(text, ' [FIGURE ', source, '-1] and [FIGURE p', cast(doc_id % 3 as string), ' — x] [FIGURE ', source, '-1]')"


@register("f7_figures", f"SELECT doc_id, list_aggregate(list_distinct(regexp_extract_all(t, '\\[FIGURE\\s+([^\\s\\]—]+)', 1)), 'count') AS n, regexp_extract(t, '\\[FIGURE\\s+([^\\s\\]—]+)', 1) AS first FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def _(spark, d):
    marked = docs(spark, d).selectExpr("doc_id", f"{MARKED} t")
    return marked.select("doc_id", tx.figures_in(F.col("t")).alias("f")).select("doc_id", F.size("f").cast("bigint").alias("n"), F.col("f")[0].alias("first"))


@register("c3_fold", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def _(spark, d):
    # ß is a letter of its own for NFKD, so both sides keep it
    return docs(spark, d).select("doc_id", tx.fold(F.col("text")).alias("folded"))


@register("c2_digit_key", "SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\s+(\\d)', '\\1', 'g'), '(\\d)\\s+', '\\1', 'g'), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM (SELECT doc_id, cast(i - 1 as int) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))")
def _(spark, d):
    """Keys of all lines of the texts."""
    return cleaning.split_lines(docs(spark, d)).select("doc_id", "line_no", tx.digit_key(F.col("line")).alias("key"))


@register("c4_same_text", "SELECT doc_id, regexp_replace(regexp_replace(trim(lower(strip_accents(t))), '\\s+', ' ', 'g'), '^[ .;:,!?]+|[ .;:,!?]+$', '', 'g') = regexp_replace(regexp_replace(trim(lower(strip_accents(upper(t)))), '\\s+', ' ', 'g'), '^[ .;:,!?]+|[ .;:,!?]+$', '', 'g') AS same FROM (SELECT doc_id, replace(text, 'ß', 's') AS t FROM documents)")
def _(spark, d):
    t = docs(spark, d).select("doc_id", F.replace("text", F.lit("ß"), F.lit("s")).alias("t"))
    return t.select("doc_id", (tx.same_text_key(F.col("t")) == tx.same_text_key(F.upper("t"))).alias("same"))


NOISE = "[\\p{L}\\p{N}_\\s.,;:!?''\"«»()\\[\\]{}\\-–—+*/=<>%°$€£§&@#^~|\\\\√∑∏∫∞≈≠≤≥±×÷→←↔⇒⇔∈∉⊂∪∩∅]"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


LINE_SQL = "SELECT doc_id, cast(i as int) AS line_no, p[i + 1] AS line FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@register(
    "c5_broken_lines",
    f"SELECT doc_id, line_no, CASE WHEN {_count('t', '\\(')} <> {_count('t', '\\)')} OR {_count('t', '\\[')} <> {_count('t', '\\]')} OR {_count('t', '\\{')} <> {_count('t', '\\}')} THEN 'PARENTHESE_NON_FERMEE' "
    f"WHEN length(t) >= 10 AND length(regexp_replace(t, '{NOISE}', '', 'g')) > 0.2 * length(t) THEN 'CARACTERES_INATTENDUS' WHEN contains(t, chr(65533)) THEN 'CARACTERE_ILLISIBLE' "
    f"WHEN len(w) > 0 AND list_sum(list_transform(w, lambda x: length(x))) / len(w) > 18 THEN 'MOTS_AGGLUTINES' ELSE '' END AS reason FROM (SELECT doc_id, line_no, t, regexp_extract_all(t, '[\\p{{L}}]{{2,}}') AS w FROM (SELECT doc_id, line_no, {TRIM.format('line')} AS t FROM ({LINE_SQL})))",
)
def _(spark, d):
    return cleaning.split_lines(docs(spark, d)).select("doc_id", "line_no", tx.broken_reason(F.col("line")).alias("reason"))


@register("c7_split_segments", f"SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) as int) AS ordinal, t AS original FROM (SELECT doc_id, line_no, {TRIM.format('line')} AS t FROM ({LINE_SQL})) WHERE t <> ''")
def _(spark, d):
    return repair.split_segments(docs(spark, d))


@register("c8_dehyphenate", "SELECT doc_id, regexp_replace(replace(text, 'th', concat('t-', chr(10), 'h')), '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g') AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.dehyphenate(F.replace("text", F.lit("th"), F.lit("t-\nh"))).alias("text"))


@register("c9_mend_elisions", "SELECT doc_id, regexp_replace(t, '(^|[^\\p{L}\\p{N}_])([cdjlmnstCDJLMNST]|[qQ][uU])([''’]) (\\p{L})', '\\1\\2\\3\\4', 'g') AS text FROM (SELECT doc_id, replace(text, ' de ', ' d'' ') AS t FROM documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.mend_elisions(F.replace("text", F.lit(" de "), F.lit(" d' "))).alias("text"))


_REWRITTEN = "CASE doc_id % 4 WHEN 0 THEN concat(text, text) WHEN 1 THEN replace(text, 'e', '') WHEN 2 THEN replace(text, ' ', '') ELSE concat(text, ' fin') END"


@register("c15_excessive_rewrite", f"SELECT doc_id, length(text) = 0 OR (abs(length(a) - length(text)) > 12 AND abs(length(a) - length(text)) / length(text) > 0.4) AS excessive FROM (SELECT doc_id, text, {_REWRITTEN} AS a FROM documents)")
def _(spark, d):
    return docs(spark, d).select("doc_id", tx.excessive_rewrite(F.col("text"), F.expr(_REWRITTEN)).alias("excessive"))


@register("c27_markdown_rows", f"SELECT doc_id, line_no, concat('| ', array_to_string(list_transform(p, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'))), ' | '), ' |') AS row, array_to_string(list_transform(p, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'))), '/') AS cells FROM (SELECT doc_id, line_no, string_split(replace(line, '|', ' '), ',') AS p FROM ({LINE_SQL}))")
def _(spark, d):
    """Lines as rows, cut into cells at their commas, and the cells read back."""
    lines = cleaning.split_lines(docs(spark, d))
    row = tx.markdown_row(F.split(F.replace("line", F.lit("|"), F.lit(" ")), ",", -1))
    return lines.select("doc_id", "line_no", row.alias("row"), F.array_join(tx.markdown_cells(row), "/").alias("cells"))


@register("x3_sentences", "SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?…])\\s+([«\"''(\\[]?[A-ZÀ-ÖØ-Þ0-9])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)))) AS s FROM documents) WHERE s <> '' GROUP BY doc_id")
def _(spark, d):
    return chunking.sentence_rows(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("sentence")).cast("bigint").alias("longest"))


# --- quality -------------------------------------------------------------------------------

LOW = tx.FRENCH
UP = tx.FRENCH.upper()
VOW = tx.VOWELS + tx.VOWELS.upper()
PLAUSIBLE = f"(regexp_matches(x, '^[{LOW}{UP}]{{1,2}}$') OR ((regexp_matches(x, '^[{LOW}{UP}][{LOW}]{{2,29}}$') OR regexp_matches(x, '^[{UP}]{{3,30}}$')) AND regexp_matches(x, '[{VOW}]')))"
USUAL = "".join("\\" + c if c in "\\[]^-" else "''" if c == "'" else c for c in quality.PUNCTUATION + quality.SYMBOLS)


def _assess_sql(table: str, keys: str) -> str:
    return (
        f"SELECT {keys}, cid, n, CASE WHEN n > 0 THEN good / n ELSE 0.0 END AS share, length(regexp_replace(s, '[{USUAL}]|\\p{{Latin}}|\\p{{N}}', '', 'g')) / greatest(length(s), 1) AS odd, length(text) AS characters "
        f"FROM (SELECT *, len(regexp_extract_all(s, '\\p{{L}}+')) AS n, len(list_filter(regexp_extract_all(s, '\\p{{L}}+'), lambda x: {PLAUSIBLE})) AS good FROM (SELECT *, len(regexp_extract_all(text, '\\(cid:\\d+\\)')) AS cid, regexp_replace(text, '\\(cid:\\d+\\)', ' ', 'g') AS s FROM {table}))"
    )


CID = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' (cid:12) (cid:3)') ELSE text END AS text FROM documents)"
CID_EXPR = "case when doc_id % 7 = 0 then concat(text, ' (cid:12) (cid:3)') else text end text"


@register(
    "a2_assess",
    f"SELECT doc_id, cast(format('{{:.4f}}', greatest(0.0, least(1.0, share * 0.7 + (1.0 - least(1.0, odd * 20)) * 0.3 - least(1.0, cid / greatest(1, n) * 10) * 0.3)) + 1e-9) as double) AS score, cast(cid as int) AS cid_markers, cast(format('{{:.5f}}', odd + 1e-9) as double) AS out_of_repertoire, cast(format('{{:.4f}}', share + 1e-9) as double) AS word_plausibility, cast(characters as int) AS characters FROM ({_assess_sql(CID, 'doc_id')})",
)
def _(spark, d):
    return quality.assess(docs(spark, d).selectExpr("doc_id", CID_EXPR)).select("doc_id", "quality.*")


@register("a3_corrupted_pages", f"SELECT doc_id, count(*) AS pages, sum(page_no) AS page_sum FROM ({_assess_sql(f'(SELECT doc_id, line_no + 1 AS page_no, line AS text FROM ({LINE_SQL}))', 'doc_id, page_no, text')}) WHERE regexp_matches(text, '\\S') AND (cid > 0 OR round(share, 4) < 0.8) GROUP BY doc_id")
def _(spark, d):
    pages = cleaning.split_lines(docs(spark, d)).select("doc_id", (F.col("line_no") + 1).alias("page_no"), F.col("line").alias("text"))
    bad = quality.corrupted_pages(pages)
    return bad.select("doc_id", F.size("pages").cast("bigint").alias("pages"), F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("page_sum"))


CHARS_SQL = "SELECT doc_id, i, ch, lag(ch) OVER w AS before, lead(ch) OVER w AS after FROM (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
BROKEN_CAPS = "[ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]"
ENCODING_SQL = (
    f"SELECT doc_id, cast(i as int) AS start, cast(i + 1 as int) AS end FROM ({CHARS_SQL}) WHERE regexp_matches(ch, '[{quality.MOJIBAKE}]') "
    f"OR (regexp_matches(ch, '{BROKEN_CAPS}') AND regexp_matches(before, '[\\p{{L}}]') AND regexp_matches(after, '[a-zà-öø-ÿ]'))"
)


@register("c10_encoding_issues", ENCODING_SQL)
def _(spark, d):
    return quality.encoding_issues(docs(spark, d), "doc_id").select("doc_id", "start", "end")


@register(
    "c11_unreadable_lines",
    f"SELECT doc_id, cast(start as int) AS start, cast(start + length(line) as int) AS end FROM (SELECT *, list_filter(regexp_extract_all(line, '\\p{{L}}+'), lambda x: length(x) > 2) AS w FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({LINE_SQL}))) "
    f"WHERE len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[{LOW}{UP}]+$') AND regexp_matches(x, '[{VOW}]'))) / len(w) < 0.5",
)
def _(spark, d):
    return quality.unreadable_lines(docs(spark, d), "doc_id").select("doc_id", "start", "end")


@register("c13_thin_sections", f"SELECT doc_id, line_no, length(t) AS n FROM (SELECT doc_id, line_no, {TRIM.format('line')} AS t FROM ({LINE_SQL})) WHERE length(t) < 25 AND NOT (NOT regexp_matches(t, '[.:;,!?]$') AND len(regexp_split_to_array(t, '\\s+')) >= 2 AND regexp_matches(t, '^\\p{{Lu}}'))")
def _(spark, d):
    cut = cleaning.split_lines(docs(spark, d)).withColumn("id", F.struct("doc_id", "line_no"))
    thin = quality.thin_sections(cut, "id", "line").select("id.*").join(cut.drop("id"), ["doc_id", "line_no"])
    return thin.select("doc_id", "line_no", F.char_length(F.regexp_replace("line", "^\\s+|\\s+$", "")).cast("bigint").alias("n"))


SHORT = "(?i)^(" + "|".join(quality.SHORT_WORDS) + ")$"
WORD_SQL = "SELECT doc_id, i, p[i] AS w FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS p FROM documents))"


@register("n1_ocr_runs", f"WITH t AS (SELECT doc_id, i, w, regexp_matches(w, '^\\p{{L}}{{1,2}}$') AND NOT regexp_matches(w, '{SHORT}') AS f FROM ({WORD_SQL}) WHERE w <> ''), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS g FROM t) SELECT doc_id, count(*) AS runs, sum(n) AS pieces FROM (SELECT doc_id, g, count(*) AS n FROM g WHERE f GROUP BY doc_id, g HAVING count(*) >= 3) GROUP BY doc_id")
def _(spark, d):
    runs = quality.ocr_runs(docs(spark, d), "doc_id")
    words = F.size(F.split("excerpt", "\\s+"))
    return runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(words).alias("pieces"))






_CELLS = "SELECT doc_id, regexp_replace(unnest(string_split(replace(text, '|', ' '), chr(10))), '^\\s+|\\s+$', '', 'g') AS c FROM documents"


@register("n2_duplicate_cells", f"SELECT doc_id, cast(sum(n - 1) as int) AS n FROM (SELECT doc_id, c, count(*) AS n FROM ({_CELLS}) WHERE length(c) >= 40 GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id")
def _(spark, d):
    """Every line of a text is a row with one cell."""
    table = F.concat(F.lit("| "), F.replace(F.replace("text", F.lit("|"), F.lit(" ")), F.lit("\n"), F.lit(" |\n| ")), F.lit(" |"))
    found = quality.duplicate_cells(docs(spark, d).select("doc_id", table.alias("text")), "doc_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


_TOKENS = "(SELECT doc_id, i, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM (SELECT doc_id, i, p[i] AS w FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\\s') AS p FROM documents))))"
_CUT = f"(SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({LINE_SQL}))"
_MATH = f"[{quality.MATH}]"
_AROUND = "substr(d.text, cast(greatest({0} - {2}, 0) + 1 as bigint), cast({1} + {2} - greatest({0} - {2}, 0) as bigint))"
ISSUES_SQL = (
    f"SELECT doc_id, 'THIN' AS kind, 0 AS start, length(text) AS \"end\", substr(t, 1, 60) AS excerpt FROM (SELECT doc_id, text, {TRIM.format('text')} AS t FROM documents) WHERE length(t) < 25 AND NOT (NOT contains(t, chr(10)) AND NOT regexp_matches(t, '[.:;,!?]$') AND len(string_split_regex(t, '\\s+')) >= 2 AND regexp_matches(t, '^\\p{{Lu}}')) "
    f"UNION ALL SELECT e.doc_id, 'ENCODING', e.start, e.\"end\", substr(d.text, greatest(e.start - 20, 0) + 1, CASE WHEN regexp_matches(substr(d.text, e.start + 1, 1), '[{quality.MOJIBAKE}]') THEN e.start + 20 ELSE e.\"end\" + 20 END - greatest(e.start - 20, 0)) FROM ({ENCODING_SQL}) e JOIN documents d USING (doc_id) "
    f"UNION ALL SELECT g.doc_id, CASE WHEN regexp_matches({_AROUND.format('g.a', 'g.b', 15)}, '[{quality.MATH}\\p{{Nd}}²³¹=+^]') THEN 'FORMULA' ELSE 'OCR_NOISE' END, cast(g.a as int), cast(g.b as int), substr(d.text, cast(g.a + 1 as bigint), cast(g.b - g.a as bigint)) FROM (SELECT doc_id, min(pos) AS a, max(pos + length(w)) AS b FROM "
    f"(SELECT *, i - row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS g FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, w, pos, regexp_matches(w, '^\\p{{L}}{{1,2}}$') AND NOT regexp_matches(w, '{SHORT}') AS f FROM {_TOKENS} WHERE w <> '')) WHERE f GROUP BY doc_id, g HAVING count(*) >= 3) g JOIN documents d USING (doc_id) "
    f"UNION ALL SELECT doc_id, 'UNREADABLE', cast(start as int), cast(start + length(line) as int), substr({TRIM.format('line')}, 1, 80) FROM (SELECT *, list_filter(regexp_extract_all(line, '\\p{{L}}+'), lambda x: length(x) > 2) AS w FROM {_CUT}) WHERE len(w) >= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^[{LOW}{UP}]+$') AND regexp_matches(x, '[{VOW}]'))) / len(w) < 0.5 "
    f"UNION ALL SELECT t.doc_id, 'FORMULA', cast(pos as int), cast(pos + 1 as int), {_AROUND.format('pos', 'pos + 1', 30)} FROM {_TOKENS} t JOIN documents d USING (doc_id) WHERE regexp_matches(w, '^{_MATH}$') AND (regexp_matches(substr(d.text, cast(greatest(pos - 3, 0) + 1 as bigint), cast(pos - greatest(pos - 3, 0) as bigint)), '^\\s*$') OR regexp_matches(substr(d.text, cast(pos + 2 as bigint), 3), '^\\s*$')) "
    f"UNION ALL SELECT doc_id, 'FORMULA', cast(start as int), cast(start + length(line) as int), substr({TRIM.format('line')}, 1, 80) FROM (SELECT *, regexp_replace(line, '[0-9]+\\)|\\b[a-zA-Z]{{1,3}}\\)', '', 'g') AS p FROM {_CUT}) WHERE regexp_matches(p, '{_MATH}') AND length(p) - length(replace(p, '(', '')) <> length(p) - length(replace(p, ')', ''))"
)


def issues_sql(table: str) -> str:
    return ISSUES_SQL.replace("FROM documents", f"FROM {table}").replace("JOIN documents", f"JOIN {table}")


def _whole_issues(spark, d):
    return quality.issues(docs(spark, d), "doc_id")


@register("u4_distinct_issues", f"SELECT doc_id, kind, start, \"end\", max(excerpt) AS excerpt FROM ({ISSUES_SQL}) GROUP BY ALL")
def _(spark, d):
    return quality.distinct_issues(_whole_issues(spark, d), "doc_id")


@register("a20_issue_summary", f"SELECT doc_id, kind, count(*) AS n FROM ({ISSUES_SQL}) GROUP BY ALL")
def _(spark, d):
    return quality.issue_summary(_whole_issues(spark, d), "doc_id")


_COSTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.WEIGHTS.items())


@register("c14_section_confidence", f"WITH e AS (SELECT doc_id, sum(CASE kind {_COSTS} END) AS cost FROM ({ISSUES_SQL}) GROUP BY doc_id) SELECT d.doc_id, round(greatest(0.0, 1.0 - coalesce(cost, 0) / greatest(1.0, length(text) / 1000)), 3) AS confidence FROM documents d LEFT JOIN e USING (doc_id)")
def _(spark, d):
    return quality.section_confidence(docs(spark, d), _whole_issues(spark, d), "doc_id")


# --- cleaning ------------------------------------------------------------------------------

PAGES = "SELECT source AS doc_id, doc_id AS page_no, concat('Cours ', source, chr(10), text, chr(10), 'Page ', cast(doc_id as string), ' / 9 9', chr(10), '| 1 |') AS text FROM documents"
PAGE_EXPR = ["source doc_id", "doc_id page_no", "concat('Cours ', source, chr(10), text, chr(10), 'Page ', cast(doc_id as string), ' / 9 9', chr(10), '| 1 |') text"]
KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\s+(\\d)', '\\1', 'g'), '(\\d)\\s+', '\\1', 'g'), '\\d+', '#', 'g'), '\\s+', ' ', 'g'))"
REPEATED = (
    f"WITH p AS ({PAGES}), l AS (SELECT doc_id, page_no, i, {TRIM.format('string_split(text, chr(10))[i]')} AS line FROM (SELECT doc_id, page_no, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM p)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS top, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i DESC) AS bottom FROM l WHERE line <> ''), "
    f"k AS (SELECT doc_id, {KEY} AS key, count(*) AS n FROM (SELECT DISTINCT doc_id, page_no, line FROM r WHERE (top <= 2 OR bottom <= 3) AND NOT starts_with(line, '|') AND regexp_matches(line, '\\d') AND length(line) BETWEEN 3 AND 120) GROUP BY ALL), "
    "s AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM p GROUP BY doc_id) SELECT k.doc_id, key FROM k JOIN s USING (doc_id) WHERE pages >= 3 AND n >= greatest(3, floor(pages * 0.04))"
)


@register("a6_repeated_lines", REPEATED)
def _(spark, d):
    return cleaning.repeated_lines(docs(spark, d).selectExpr(*PAGE_EXPR))


_PAGED_BY = "concat(source, '-', cast(doc_id // 200 as string))"  # 200 pages a document at most


@register("r6_assemble_pages", f"SELECT {_PAGED_BY} AS doc_id, string_agg(concat('## p. ', cast(doc_id as string), chr(10), chr(10), " + TRIM.format("text") + "), concat(chr(10), chr(10)) ORDER BY doc_id) FILTER (WHERE regexp_matches(text, '\\S')) AS text FROM documents GROUP BY ALL")
def _(spark, d):
    return cleaning.assemble_pages(docs(spark, d).selectExpr(f"{_PAGED_BY.replace('//', 'div')} doc_id", "doc_id page_no", "text"))


@register("r7_split_pages", "SELECT source AS doc_id, cast(doc_id as int) AS page_no, " + TRIM.format("text") + " AS text FROM documents")
def _(spark, d):
    # 200 documents a value: a source can be a third of all rows
    pages = cleaning.split_pages(cleaning.assemble_pages(docs(spark, d).selectExpr("struct(source, doc_id div 200 as part) doc_id", "doc_id page_no", "text")))
    return pages.withColumn("doc_id", F.col("doc_id.source")).withColumn("text", F.regexp_replace("text", "^\\s+|\\s+$", ""))


@register("j6_strip_furniture", f"WITH f AS ({REPEATED}), x AS ({PAGES}), y AS (SELECT doc_id, page_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, page_no, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM x)) SELECT y.doc_id, count(*) AS n FROM y WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = y.doc_id AND f.key = {KEY}) GROUP BY y.doc_id")
def _(spark, d):
    pages = docs(spark, d).selectExpr(*PAGE_EXPR)
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cleaning.strip_furniture(lines, cleaning.repeated_lines(pages)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("a8_vocabulary", "WITH w AS (SELECT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda x: length(x) >= 3))) AS word FROM documents UNION ALL SELECT doc_id, unnest(['" + "','".join(cleaning.CALENDAR) + "']) FROM documents) SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL")
def _(spark, d):
    return cleaning.vocabulary(docs(spark, d))


@register("x6_join_broken_lines", f"WITH l AS (SELECT doc_id, line_no, {TRIM.format('line')} AS line FROM ({LINE_SQL})), b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l), c AS (SELECT *, coalesce(before, '') <> '' AND regexp_matches(line, '^\\p{{Ll}}') AND NOT regexp_matches(before, '[.!?…:;»\"]\\s*$') AND NOT starts_with(before, '#') AND NOT regexp_matches(before, '^\\s*([-•*—]|\\d+[.)])\\s+') AND NOT regexp_matches(line, '^\\s*([-•*—]|\\d+[.)])\\s+') AS on_ FROM b) SELECT doc_id, count(*) FILTER (WHERE NOT on_) AS lines FROM c GROUP BY doc_id")
def _(spark, d):
    return cleaning.join_broken_lines(cleaning.split_lines(docs(spark, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@register("j8_apply_word_plan", f"SELECT doc_id, line_no, list_aggregate(list_transform(string_split(line, ' '), lambda w: CASE WHEN length(w) = 3 THEN concat('_', w) ELSE w END), 'string_agg', ' ') AS line FROM ({LINE_SQL})")
def _(spark, d):
    lines = cleaning.split_lines(docs(spark, d))
    words = lines.select("doc_id", F.explode(F.split("line", " ", -1)).alias("word")).filter(F.char_length("word") == 3).distinct()
    return cleaning.apply_word_plan(lines, words.withColumn("fixed", F.concat(F.lit("_"), "word")))


_WORDS_OF = "[\\p{L}\\p{Nl}\\p{No}]+"
_KNOWN = "(coalesce({0}.n, 0) >= 2 OR {1} IN ('" + "','".join(cleaning.GRAMMAR) + "'))"


def mend_sql(lines: str, vocabulary: str) -> str:
    """(doc_id, line_no, line) with neighbouring pieces joined, from such lines and (doc_id, word, n)."""
    return f"""
    SELECT l.doc_id, l.line_no, coalesce(string_agg(concat(CASE WHEN glued THEN '' ELSE gap END, token), '' ORDER BY i), '') || any_value(l.g[len(l.g)]) AS line FROM
    (SELECT doc_id, line_no, string_split_regex(line, '{_WORDS_OF}') AS g FROM {lines}) l LEFT JOIN
    (SELECT *, coalesce(lag(wants AND turn % 2 = 1) OVER (PARTITION BY doc_id, line_no ORDER BY i), false) AS glued FROM
     (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, wants, island ORDER BY i) AS turn FROM
      (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line_no, wants ORDER BY i) AS island FROM
       (SELECT f.*, coalesce(next_gap = ' ' AND a.n IS NOT NULL AND length(whole) >= 4 AND NOT ({_KNOWN.format('b', 'left_l')} AND {_KNOWN.format('c', 'right_l')}), false) AS wants FROM
        (SELECT doc_id, line_no, i, t[i] AS token, g[i] AS gap, g[i + 1] AS next_gap, lower(t[i]) AS left_l, lower(t[i + 1]) AS right_l, lower(t[i] || t[i + 1]) AS whole FROM
         (SELECT doc_id, line_no, t, g, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_WORDS_OF}') AS t, string_split_regex(line, '{_WORDS_OF}') AS g FROM {lines}))) f
        LEFT JOIN {vocabulary} a ON a.doc_id = f.doc_id AND a.word = f.whole LEFT JOIN {vocabulary} b ON b.doc_id = f.doc_id AND b.word = f.left_l LEFT JOIN {vocabulary} c ON c.doc_id = f.doc_id AND c.word = f.right_l)))) m
    ON l.doc_id = m.doc_id AND l.line_no = m.line_no GROUP BY l.doc_id, l.line_no"""


def _vocabulary_sql(table: str) -> str:
    words = f"SELECT doc_id, lower(unnest(list_filter(regexp_extract_all(text, '{_WORDS_OF}'), lambda x: length(x) >= 3))) AS word FROM {table} UNION ALL SELECT doc_id, unnest(['{"','".join(cleaning.CALENDAR)}']) FROM {table}"
    return f"SELECT doc_id, word, count(*) AS n FROM ({words}) GROUP BY ALL"


@register("j7_mend_words", f"WITH t AS (SELECT concat('cut ', doc_id) AS doc_id, replace(text, 'ch', 'c h') AS text FROM documents UNION ALL SELECT concat('whole ', doc_id), text FROM documents), l AS ({LINE_SQL.replace('FROM documents', 'FROM t')}), v AS ({_vocabulary_sql('documents')}) {mend_sql('l', "(SELECT concat(k, doc_id) AS doc_id, word, n FROM v, (SELECT unnest(['cut ', 'whole ']) AS k))")}")
def _(spark, d):
    """Words cut before an h, and whole ones, against the words of the text: all of it in the row of the document."""
    both = F.inline(F.array(*(F.struct(F.lit(k).alias("k"), t.alias("read")) for k, t in (("cut ", F.replace("text", F.lit("ch"), F.lit("c h"))), ("whole ", F.col("text"))))))
    pairs = docs(spark, d).select("doc_id", "text", both).select(F.concat("k", F.col("doc_id").cast("string")).alias("doc_id"), F.col("read").alias("text"), F.col("text").alias("by"))
    return cleaning.split_lines(cleaning.mend_texts(pairs, by="by"))


_DIRTY = "replace(replace(text, 'th', concat('t-', chr(10), 'h')), ' de ', concat(chr(10), 'd'' '))"
_GOES_ON = "coalesce(before, '') <> '' AND regexp_matches(line, '^\\p{Ll}') AND NOT regexp_matches(before, '[.!?…:;»\"]\\s*$') AND NOT starts_with(before, '#') AND NOT regexp_matches(before, '^\\s*([-•*—]|\\d+[.)])\\s+') AND NOT regexp_matches(line, '^\\s*([-•*—]|\\d+[.)])\\s+')"
_ELISION = "(^|[^\\p{L}\\p{N}_])([cdjlmnstCDJLMNST]|[qQ][uU])([''’]) (\\p{L})"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', concat(chr(10), chr(10)), 'g'), '^\\s+|\\s+$', '', 'g')"
CLEANED_CTE = (
    f"dirty AS (SELECT doc_id, regexp_replace({_DIRTY}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS text FROM documents), l0 AS (SELECT doc_id, line_no, {TRIM.format('line')} AS line FROM ({LINE_SQL.replace('FROM documents', 'FROM dirty')})), "
    f"l1 AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l0), l2 AS (SELECT *, sum(CASE WHEN {_GOES_ON} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l1), "
    "l3 AS (SELECT doc_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM l2 GROUP BY doc_id, island), joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l3 GROUP BY doc_id), "
    f"v AS ({_vocabulary_sql('joined')}), mended AS ({mend_sql('l3', 'v')}), whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM mended GROUP BY doc_id), "
    f"cleaned AS (SELECT doc_id, {_NORMAL.format(f"regexp_replace(regexp_replace(text, '{_ELISION}', '\\1\\2\\3\\4', 'g'), '{_ELISION}', '\\1\\2\\3\\4', 'g')")} AS text FROM whole)"
)


def dirty(spark, d):
    """Texts with words cut at line ends, lines broken before common words and loose elisions."""
    return docs(spark, d).select("doc_id", F.expr(_DIRTY.replace("chr(10)", "char(10)").replace("d''", "d\\'")).alias("text"))


@register("x7_clean_corpus", f"WITH {CLEANED_CTE} SELECT doc_id, text FROM cleaned")
def _(spark, d):
    return cleaning.clean_corpus(dirty(spark, d))


# --- passages ------------------------------------------------------------------------------


_PIECE_WORDS, _CARRIED = 296, 49  # words that fit 384 and 64 tokens at 1.3 a word


def chunk_sql(docs: str) -> str:
    """Passages of (doc_id, text) without headings and empty lines: sentences, or runs of words of long ones, packed in order by a walk from piece to piece."""
    tokens = "cast(floor(1.3 * greatest(1, {0})) as int)"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM ({docs})),
    s AS (SELECT doc_id, words, i, q[i] AS piece FROM (SELECT doc_id, words, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT doc_id, words, CASE WHEN {tokens.format('words')} <= 384 THEN [{TRIM.format('text')}] ELSE
      string_split(regexp_replace(text, '([.!?…])\\s+([«"''(\\[]?[A-ZÀ-ÖØ-Þ0-9])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)) END AS q FROM d))),
    t AS (SELECT doc_id, i, {TRIM.format('piece')} AS piece, list_filter(string_split_regex(piece, '\\s+'), lambda x: x <> '') AS w FROM s),
    r AS (SELECT doc_id, i, j, CASE WHEN {tokens.format('len(w)')} <= 384 THEN piece ELSE array_to_string(w[j * {_PIECE_WORDS} + 1 : (j + 1) * {_PIECE_WORDS}], ' ') END AS piece, w FROM (SELECT *, unnest(CASE WHEN {tokens.format('len(w)')} <= 384 THEN range(1) ELSE range((len(w) + {_PIECE_WORDS} - 1) // {_PIECE_WORDS}) END) AS j FROM t) WHERE len(w) > 0),
    p AS (SELECT doc_id, piece, len(list_filter(string_split_regex(piece, '\\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM r),
    k AS (SELECT doc_id, n, 0 AS chunk, w AS held, 0 AS carry FROM p WHERE n = 1 UNION ALL
      SELECT p.doc_id, p.n, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ THEN p.w ELSE held + p.w END, CASE WHEN NOT full_ THEN carry WHEN {tokens.format(f'(least(held, {_CARRIED}) + p.w)')} > 384 THEN 0 ELSE least(held, {_CARRIED}) END
      FROM (SELECT k.*, p2.w AS next, {tokens.format('(carry + held + p2.w)')} > 384 AS full_ FROM k JOIN p p2 ON p2.doc_id = k.doc_id AND p2.n = k.n + 1) k JOIN p ON p.doc_id = k.doc_id AND p.n = k.n + 1),
    c AS (SELECT k.doc_id, chunk, string_agg(piece, concat(chr(10), chr(10)) ORDER BY k.n) AS body, sum(w) AS held, min(carry) AS carry FROM k JOIN p ON p.doc_id = k.doc_id AND p.n = k.n GROUP BY k.doc_id, chunk),
    b AS (SELECT *, list_filter(string_split_regex(lag(body) OVER (PARTITION BY doc_id ORDER BY chunk), '\\s+'), lambda x: x <> '') AS before FROM c),
    o AS (SELECT doc_id, chunk, CASE WHEN carry > 0 THEN concat(array_to_string(before[len(before) - carry + 1 : len(before)], ' '), chr(10), chr(10), body) ELSE body END AS content, {tokens.format('(carry + held)')} AS size, carry + held AS words FROM b),
    e AS (SELECT *, lead(content) OVER w AS next, lead(words) OVER w AS next_words, lead(size) OVER w AS next_size, lead(chunk, 2) OVER w IS NULL AS before_last, lag(words) OVER w AS last_words, lead(chunk) OVER w IS NULL AS is_last FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY chunk))
    SELECT doc_id, cast(chunk as int) AS ordinal, concat('§', cast(chunk + 1 as string)) AS locator, CASE WHEN before_last AND next_size < 32 AND {tokens.format('(words + next_words)')} <= 384 THEN concat(content, chr(10), chr(10), next) ELSE content END AS content,
      CASE WHEN before_last AND next_size < 32 AND {tokens.format('(words + next_words)')} <= 384 THEN {tokens.format('(words + next_words)')} ELSE size END AS token_count
    FROM e WHERE NOT (is_last AND last_words IS NOT NULL AND size < 32 AND {tokens.format('(words + last_words)')} <= 384)"""


@register("x1_chunk_corpus", chunk_sql("SELECT doc_id, text FROM documents"))
def _(spark, d):
    return chunking.chunk_corpus(docs(spark, d), id_col="doc_id", text_col="text")


@register("x4_locators", f"SELECT doc_id, ordinal, concat('Cours > ', source, ' · ', locator) AS locator FROM ({chunk_sql('SELECT doc_id, text FROM documents')}) JOIN documents USING (doc_id)")
def _(spark, d):
    headed = docs(spark, d).select("doc_id", F.concat(F.lit("# Cours\n## "), "source", F.lit("\n"), "text").alias("text"))
    return chunking.chunk_corpus(headed, id_col="doc_id", text_col="text").select("doc_id", "ordinal", "locator")


_HEADED = "concat('# Cours', chr(10), '### ', source, chr(10), chr(10), replace(text, '. ', concat('.', chr(10), chr(10), '## ', lang, chr(10))))"


@register(
    "x2_split_blocks",
    f"WITH s AS (SELECT doc_id, source, lang, cast(i - 1 as int) AS n, regexp_replace(p[i], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, source, lang, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, source, lang, string_split(text, '. ') AS p FROM documents))) "
    "SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 as int) AS position, CASE WHEN n = 0 THEN concat('Cours > ', source) ELSE concat('Cours > ', lang) END AS path, CASE WHEN last THEN text ELSE concat(text, '.') END AS text FROM (SELECT *, n = max(n) OVER (PARTITION BY doc_id) AS last FROM s) WHERE NOT last OR text <> ''",
)
def _(spark, d):
    """A heading above every text, a level skipped, and one before every sentence but the first."""
    cut = chunking.split_blocks(docs(spark, d).select("doc_id", F.expr(_HEADED.replace("chr(10)", "char(10)")).alias("text")), "doc_id", "text")
    return cut.select("doc_id", "position", F.array_join("heading_path", " > ").alias("path"), "text")


@register(
    "n11_split_parts",
    f"WITH RECURSIVE l AS ({LINE_SQL}), d AS (SELECT doc_id, max(line_no) AS last FROM l GROUP BY doc_id), w AS (SELECT doc_id, line_no, 0 AS part_no, length(line) + 1 AS size FROM l WHERE line_no = 0 UNION ALL "
    "SELECT l.doc_id, l.line_no, CASE WHEN w.size + length(l.line) + 1 > 2000 THEN w.part_no + 1 ELSE w.part_no END, CASE WHEN w.size + length(l.line) + 1 > 2000 THEN length(l.line) + 1 ELSE w.size + length(l.line) + 1 END FROM w JOIN l ON l.doc_id = w.doc_id AND l.line_no = w.line_no + 1) "
    "SELECT w.doc_id, CASE WHEN length(t.text) <= 2000 THEN 0 ELSE part_no END AS part_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS part FROM w JOIN l ON l.doc_id = w.doc_id AND l.line_no = w.line_no JOIN documents t ON t.doc_id = w.doc_id GROUP BY ALL",
)
def _(spark, d):
    return chunking.split_parts(docs(spark, d), 2000, separator="\n", gap_cost=1)


@register("a4_chunk_stats", f"SELECT doc_id, count(*) AS chunks, median(n) AS median_tokens, max(n) AS max_tokens FROM (SELECT doc_id, len(string_split(line, ' ')) AS n FROM ({LINE_SQL})) GROUP BY doc_id")
def _(spark, d):
    from ..operators import tables

    chunks = cleaning.split_lines(docs(spark, d)).select("doc_id", F.size(F.split("line", " ", -1)).cast("bigint").alias("token_count"))
    return tables.chunk_stats(chunks, ["doc_id"])


# --- repair and review ---------------------------------------------------------------------

STATUS_SQL = f"SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) as int) AS ordinal, t AS original FROM (SELECT doc_id, line_no, {TRIM.format('line')} AS t FROM ({LINE_SQL})) WHERE t <> ''"
FOLDED = "regexp_replace(regexp_replace(trim(lower(strip_accents({0}))), '\\s+', ' ', 'g'), '^[ .;:,!?]+|[ .;:,!?]+$', '', 'g')"


def _proved(spark, d):
    """Every second line has a validated passage: itself with a full stop, or with a word more."""
    lines = repair.split_segments(docs(spark, d))
    proof = F.when(F.col("ordinal") % 4 == 0, F.concat("original", F.lit(" ."))).otherwise(F.concat("original", F.lit(" ja")))
    proofs = lines.filter("ordinal % 2 = 0").select("doc_id", "ordinal", proof.alias("proof_text"), (F.col("ordinal") % 40 / 100.0).alias("distance"), F.lit("course").alias("source"))
    return repair.repair(lines, proofs, ["doc_id", "ordinal"])


_C6 = (
    f"SELECT doc_id, ordinal, CASE WHEN ordinal % 2 = 0 AND (ordinal % 40) / 100.0 <= 0.18 THEN CASE WHEN (ordinal % 40) / 100.0 <= 0.02 OR (ordinal % 4 = 0 AND {FOLDED.format('original')} = {FOLDED.format("concat(original, ' .')")}) THEN 'inchange' ELSE 'corrige' END "
    f"WHEN {_count('original', '\\(')} <> {_count('original', '\\)')} OR {_count('original', '\\[')} <> {_count('original', '\\]')} OR {_count('original', '\\{')} <> {_count('original', '\\}')} OR (length(original) >= 10 AND length(regexp_replace(original, '{NOISE}', '', 'g')) > 0.2 * length(original)) OR contains(original, chr(65533)) "
    f"OR (len(regexp_extract_all(original, '\\p{{L}}{{2,}}')) > 0 AND list_sum(list_transform(regexp_extract_all(original, '\\p{{L}}{{2,}}'), lambda x: length(x))) / len(regexp_extract_all(original, '\\p{{L}}{{2,}}')) > 18) THEN 'a-verifier' ELSE 'inchange' END AS status FROM ({STATUS_SQL})"
)


@register("c6_line_status", _C6)
def _(spark, d):
    return _proved(spark, d).select("doc_id", "ordinal", "status")


@register("a22_repair_report", f"WITH s AS ({_C6}) SELECT d.doc_id, count(s.ordinal) AS segments, count(*) FILTER (WHERE status = 'corrige') AS corrected, count(*) FILTER (WHERE status = 'a-verifier') AS to_check FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id")
def _(spark, d):
    return repair.repair_report(_proved(spark, d), docs(spark, d)).select("doc_id", "segments", "corrected", "to_check")


EDITED = "replace(replace(text, 'th', '+'), 'é', '2')"


@register("a21_symbol_diff", f"SELECT doc_id, symbol, sum(n) AS change FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{review.BEARING}')) AS symbol, -1 AS n FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all({EDITED}, '{review.BEARING}')), 1 FROM documents) GROUP BY ALL HAVING sum(n) <> 0")
def _(spark, d):
    return review.symbol_diff(docs(spark, d).selectExpr("doc_id", "text", f"{EDITED} edited"), "doc_id", "text", "edited")




EDITED_COPY = "case doc_id % 3 when 0 then concat(text, ' ajout') when 1 then replace(text, ' de ', ' du ') else substr(text, 9) end"


@register("u3_multiset_diff", f"WITH a AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), b AS (SELECT doc_id, unnest(string_split({EDITED_COPY}, ' ')) AS w FROM documents) SELECT 'added' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def _(spark, d):
    """All words of all texts against those of an edited copy."""
    words = lambda text: docs(spark, d).select("doc_id", F.explode(F.split(F.expr(text), " ", -1)).alias("w"))
    added, removed = review.multiset_diff(words("text"), words(EDITED_COPY))
    return added.select(F.lit("added").alias("side"), "*").unionByName(removed.select(F.lit("removed").alias("side"), "*"))


FORMULAS = "concat(replace(text, 'th', '$'), case when doc_id % 3 = 0 then ' \\[ x' else ' \\( y \\)' end, case when doc_id % 5 = 0 then ' \\begin{a}' else '' end)"


@register("a23_formula_balance", f"SELECT doc_id, cast({_count('t', '\\$')} % 2 + abs({_count('t', '\\\\\\[')} - {_count('t', '\\\\\\]')}) + abs({_count('t', '\\\\\\(')} - {_count('t', '\\\\\\)')}) + abs({_count('t', '\\\\begin\\{')} - {_count('t', '\\\\end\\{')}) as int) AS orphans FROM (SELECT doc_id, {FORMULAS} AS t FROM documents)")
def _(spark, d):
    n = F.col("doc_id")
    text = F.concat(F.replace("text", F.lit("th"), F.lit("$")), F.when(n % 3 == 0, " \\[ x").otherwise(" \\( y \\)"), F.when(n % 5 == 0, " \\begin{a}").otherwise(""))
    return docs(spark, d).select("doc_id", review.formula_orphans(text).cast("int").alias("orphans"))


@register("c23_contradicted_quizzes", "SELECT doc_id, cast(length(text) % 3 as int) AS suggested FROM documents WHERE length(text) % 3 <> doc_id % 4")
def _(spark, d):
    n = F.col("doc_id")
    told = F.concat("text", F.lit(" La bonne réponse est donc la "), F.substring(F.lit("ABC"), F.char_length("text") % 3 + 1, F.lit(1)), F.lit(") ."))
    quizzes = docs(spark, d).select("doc_id", told.alias("explanation"), (n % 4).cast("int").alias("answer"))
    return review.contradicted_quizzes(quizzes).select("doc_id", "suggested")


TALK = "CASE turn % 3 WHEN 0 THEN concat(text, ' Je ne comprends toujours pas') WHEN 1 THEN concat('c''est faux ', text) ELSE text END"


@register("c25_intents", f"SELECT conv_id, turn, regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(faux|fausse|erreur|tromp|incorrect|pas juste|pas bon|n''est pas (?:ça|ca|correct)|v[ée]rifie|corrige)') AS contests_result, regexp_matches(t, '(?i)(comprends? (?:toujours |encore |vraiment )?pas|pas compris|je suis perdu|perdue?($|[^\\p{{L}}\\p{{N}}_])|explique(?:-le|-moi)? autrement|j''y arrive pas|c''est flou|pas clair)') AS does_not_understand FROM (SELECT conv_id, turn, {TALK} AS t FROM conversations)")
def _(spark, d):
    talk = _table(spark, d, "conversations").selectExpr("conv_id", "turn", "case turn % 3 when 0 then concat(text, ' Je ne comprends toujours pas') when 1 then concat('c\\'est faux ', text) else text end text")
    return review.intents(talk).drop("text")


@register("n8_recap", "WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN t WHEN length(t) <= CASE WHEN turn = last THEN 1500 ELSE 300 END THEN t ELSE concat(substr(t, 1, CASE WHEN turn = last THEN 1500 ELSE 300 END), '…') END AS recap FROM c WHERE t <> ''")
def _(spark, d):
    return review.recap(_table(spark, d, "conversations"))


@register("n9_repeated_answers")
def _(spark, d):
    return review.repeated_answers(_table(spark, d, "conversations"))


@register("j9_locate_quotes", "WITH f AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat, trim(regexp_replace(substr(text, 21, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 60 END), '\\s+', ' ', 'g')) AS q FROM documents), c AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE cast((length(flat) - length(replace(flat, q, ''))) // length(q) as int) END AS n FROM f) SELECT doc_id, n AS occurrences, CASE WHEN n = 1 THEN cast(strpos(flat, q) - 1 as int) END AS position, CASE WHEN q = '' THEN 'EMPTY' WHEN n = 0 THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' END AS code FROM c")
def _(spark, d):
    t = docs(spark, d).select("doc_id", "text")
    quotes = t.selectExpr("doc_id", "doc_id quote_id", "substr(text, 21, case when doc_id % 2 = 0 then 4 else 60 end) quote")
    return review.locate_quotes(t, quotes).drop("quote_id")


QKEY = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


EDGES = "regexp_replace(substr(text, 1, 40), '^[ «»\"'']+|[ «»\"'']+$', '', 'g')"


@register(
    "j10_attribute_findings",
    f"WITH s AS (SELECT concat(source, '-', cast(doc_id // 200 as string)) AS course_id, doc_id AS section_id, {QKEY.format('text')} AS body FROM documents), "
    f"q AS (SELECT doc_id AS finding_id, concat(source, '-', cast(doc_id // 200 as string)) AS course_id, {QKEY.format(EDGES)} AS q FROM documents), "
    "m AS (SELECT finding_id, count(*) AS n, min(section_id) AS section_id FROM q JOIN s USING (course_id) WHERE length(q) >= 12 AND (length(body) - length(replace(body, q, ''))) // length(q) = 1 GROUP BY finding_id) "
    "SELECT q.finding_id, m.section_id FROM q LEFT JOIN m ON q.finding_id = m.finding_id AND m.n = 1",
)
def _(spark, d):
    t = docs(spark, d).selectExpr("concat(source, '-', cast(doc_id div 200 as string)) course_id", "doc_id", "text")
    findings = t.selectExpr("doc_id finding_id", "course_id", "substr(text, 1, 40) quote")
    return review.attribute_findings(findings, t.selectExpr("course_id", "doc_id section_id", "text content"))


@register("j11_resolve_citations", "SELECT doc_id AS section_id, concat('S', cast(doc_id % 4 as string)) AS label, source AS document_id FROM documents WHERE doc_id % 2 = 0")
def _(spark, d):
    texts = docs(spark, d).selectExpr("doc_id section_id", "concat(text, ' [S', cast(doc_id % 4 as string), '] [P1] [S99] [S', cast(doc_id % 4 as string), ']') text")
    registry = docs(spark, d).filter("doc_id % 2 = 0").selectExpr("doc_id section_id", "concat('S', cast(doc_id % 4 as string)) label", "source document_id")
    return review.resolve_citations(texts, registry).select("section_id", "label", "document_id")


@register("j17_uncovered_sources", "SELECT doc_id // 10 AS assessment_id, doc_id AS source_id FROM documents WHERE NOT regexp_matches(text, '[0-9]')")
def _(spark, d):
    """An item for each document with a digit covers it, and its neighbour of the next assessment, which is none of its own."""
    sources = docs(spark, d).selectExpr("doc_id div 10 assessment_id", "doc_id source_id")
    held = docs(spark, d).filter(F.col("text").rlike("[0-9]")).selectExpr("doc_id div 10 assessment_id", "doc_id source_id")
    items = held.select("assessment_id", F.array(F.col("source_id"), F.col("source_id") + 10).alias("covers"))
    return review.uncovered_sources(items, sources).select("assessment_id", "source_id")


_COURSE = "concat(source, '-', cast(doc_id // 200 as string))"  # 200 documents a course at most


@register(
    "j18_apply_revisions",
    f"SELECT course_id, cast(row_number() OVER (PARTITION BY course_id ORDER BY b, n) - 1 as int) AS position, content FROM (SELECT {_COURSE} AS course_id, 0 AS b, doc_id AS n, CASE WHEN doc_id % 5 = 1 THEN concat('x', text) ELSE text END AS content FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT {_COURSE}, 1, doc_id, reverse(text) FROM documents WHERE doc_id % 5 = 2)",
)
def _(spark, d):
    t = docs(spark, d).selectExpr(f"{_COURSE.replace('//', 'div')} course_id", "doc_id", "cast(doc_id as string) heading", "text content")
    sections = t.selectExpr("course_id", "heading", "doc_id position", "content")
    ops = t.filter("doc_id % 5 < 3").selectExpr(
        "course_id", "doc_id op_no", "case doc_id % 5 when 0 then 'supprimer' when 1 then 'reecrire' else 'ajouter' end action",
        "case when doc_id % 5 = 2 then concat('new ', heading) else heading end heading", "case when doc_id % 5 = 1 then concat('x', content) else reverse(content) end content",
    )
    return review.apply_revisions(sections, ops).select("course_id", F.col("position").cast("int").alias("position"), "content")


_SHARE = "greatest(1, cast(round_even(points * 20 / greatest(sum(points) OVER (PARTITION BY a), 1), 0) as int))"


@register("n6_rebalance_points", f"WITH i AS (SELECT doc_id // 6 AS a, doc_id AS item_no, cast(length(text) % 7 as int) AS points FROM documents), s AS (SELECT *, {_SHARE} AS share FROM i) SELECT item_no, cast(CASE WHEN row_number() OVER (PARTITION BY a ORDER BY item_no) = 1 THEN greatest(1, share + 20 - sum(share) OVER (PARTITION BY a)) ELSE share END as int) AS points FROM s")
def _(spark, d):
    items = docs(spark, d).selectExpr("doc_id div 6 assessment_id", "doc_id item_no", "cast(length(text) % 7 as int) points", "20 total")
    return review.rebalance_points(items).select("item_no", "points")


@register("n10_fit_sources", "SELECT doc_id, least(length(text), greatest(800, 20000 // count(*) OVER (PARTITION BY source))) AS size, length(text) > greatest(800, 20000 // count(*) OVER (PARTITION BY source)) AS truncated FROM documents")
def _(spark, d):
    fitted = review.fit_sources(docs(spark, d).selectExpr("source request_id", "doc_id", "text"), 20000)
    return fitted.select("doc_id", F.char_length("text").cast("bigint").alias("size"), "truncated")


@register("n12_cap_items", "WITH i AS (SELECT source AS r, length(text) % 3 AS p, doc_id AS n FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY n) AS k, (SELECT count(DISTINCT p) FROM i j WHERE j.r = i.r) AS parts FROM i), f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p, n) AS z FROM c WHERE k <= ceil(8 / parts)) SELECT r AS request_id, n AS item_no FROM f WHERE z <= 8")
def _(spark, d):
    items = docs(spark, d).selectExpr("source request_id", "length(text) % 3 part_no", "doc_id item_no")
    return review.cap_items(items, 8).select("request_id", "item_no")


@register(
    "c34_classify_proposals",
    "WITH e AS (SELECT doc_id, concat('x', regexp_replace(text, '\\s+', '', 'g')) AS b FROM documents), c AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'incertain' WHEN 1 THEN replace(b, 'ß', 'ss') WHEN 2 THEN concat(b, b, repeat('abc', 40)) WHEN 3 THEN replace(b, 'en', '+') ELSE replace(b, 'th', 'a') END AS a FROM e) "
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNCERTAIN' WHEN a = b THEN 'UNCHANGED' WHEN abs(length(a) - length(b)) > 12 AND abs(length(a) - length(b)) / length(b) > 0.4 THEN 'REWRITTEN' WHEN doc_id % 5 = 3 THEN 'SYMBOLS_CHANGED' ELSE 'FORM_ONLY' END AS verdict FROM c",
)
def _(spark, d):
    """What is proposed depends on the letters of the text, and so does the verdict."""
    n = F.col("doc_id") % 5
    before = F.concat(F.lit("x"), F.regexp_replace("text", "\\s+", ""))
    swap = lambda a, b: F.replace(before, F.lit(a), F.lit(b))
    after = F.when(n == 0, "incertain").when(n == 1, swap("ß", "ss")).when(n == 2, F.concat(before, before, F.repeat(F.lit("abc"), F.lit(40)))).when(n == 3, swap("en", "+")).otherwise(swap("th", "a"))
    return review.classify_proposals(docs(spark, d).select("doc_id", before.alias("before"), after.alias("after"))).select("doc_id", "verdict")


@register("c35_accept_correction", f"SELECT doc_id, doc_id % 3 <> 0 AND length(a) >= 0.4 * length(text) AND lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS accepted FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN reverse(substr(text, 1, length(text) // 3)) WHEN 1 THEN concat(' ', replace(text, ' ', '  ')) WHEN 2 THEN concat(text, '   ') ELSE {_REWRITTEN} END AS a FROM documents)")
def _(spark, d):
    """Third parts, other blanks and rewritten texts as proposals."""
    why = F.when(F.col("doc_id") % 3 == 0, " ").otherwise("wrong sign")
    made = F.expr(f"CASE doc_id % 5 WHEN 0 THEN reverse(substr(text, 1, length(text) div 3)) WHEN 1 THEN concat(' ', replace(text, ' ', '  ')) WHEN 2 THEN concat(text, '   ') ELSE {_REWRITTEN} END")
    return docs(spark, d).select("doc_id", review.accept_correction(F.col("text"), made, why).alias("accepted"))


_FAILED = "CASE doc_id % 9 WHEN 0 THEN replace(text, ' de ', ' Quota ') WHEN 1 THEN concat(text, ' Invalid API key') WHEN 2 THEN concat('Model x', source, ' was not found. ', text) ELSE text END"


@register(
    "c36_failure_cause",
    f"SELECT doc_id, CASE WHEN s = 402 OR regexp_matches(m, 'credit|quota|billing') THEN 'CREDIT' WHEN s IN (401, 403) OR regexp_matches(m, 'api key|unauthorized|forbidden') THEN 'KEY' WHEN s = 404 OR regexp_matches(m, 'model.*not found|no such model') THEN 'MODEL_MISSING' ELSE 'SILENT' END AS cause FROM (SELECT doc_id, 400 + doc_id % 7 AS s, lower({_FAILED}) AS m FROM documents)",
)
def _(spark, d):
    """Texts as messages, some with the words that tell a cause."""
    return docs(spark, d).select("doc_id", review.failure_cause((F.lit(400) + F.col("doc_id") % 7), F.expr(_FAILED)).alias("cause"))


# --- job log -------------------------------------------------------------------------------

SECONDS = "epoch_us(ts) / 1000000.0"
JOB_SQL = _sql(JOBS, "events").replace(" FROM ", f", {SECONDS} AS submitted_at, {SECONDS} + round(value) AS started_at, {SECONDS} + 2 * round(value) AS finished_at FROM ")


def jobs(spark, d):
    """Every event a job: submitted at its time, started after ``value`` seconds, finished after as many again."""
    t = _table(spark, d, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0)
    timed = t.selectExpr("*", "s submitted_at", "s + round(value) started_at", "s + 2 * round(value) finished_at")
    return timed.selectExpr(*(f"{e} {n}" for n, e in JOBS.items()), "submitted_at", "started_at", "finished_at")


@register("q1_queue_positions", f"WITH j AS ({JOB_SQL}) SELECT a.job_id, count(b.job_id) AS ahead FROM j a LEFT JOIN j b ON (b.submitted_at < a.submitted_at OR (b.submitted_at = a.submitted_at AND b.job_id < a.job_id)) AND b.started_at > a.submitted_at AND (b.lane = 'student' OR a.lane = 'teacher') GROUP BY a.job_id")
def _(spark, d):
    return joblog.queue_positions(jobs(spark, d))


_MEANS = f"j AS ({JOB_SQL}), m AS (SELECT lane, finished_at, job_id, avg(finished_at - started_at) OVER (PARTITION BY lane ORDER BY finished_at, job_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS mean FROM j WHERE status = 'done')"


@register("q2_mean_durations", f"WITH {_MEANS} SELECT j.job_id, round(coalesce((SELECT arg_max(mean, struct_pack(t := m.finished_at, k := m.job_id)) FROM m WHERE m.lane = j.lane AND m.finished_at <= j.submitted_at), CASE j.lane WHEN 'student' THEN 35.0 ELSE 150.0 END), 3) AS mean_seconds FROM j")
def _(spark, d):
    return joblog.mean_at_submission(jobs(spark, d)).select("job_id", F.round("mean_seconds", 3).alias("mean_seconds"))


_AHEAD = "a AS (SELECT a.job_id, count(b.job_id) AS ahead FROM j a LEFT JOIN j b ON (b.submitted_at < a.submitted_at OR (b.submitted_at = a.submitted_at AND b.job_id < a.job_id)) AND b.started_at > a.submitted_at AND (b.lane = 'student' OR a.lane = 'teacher') GROUP BY a.job_id)"
_LANE = "(SELECT j.job_id, coalesce(arg_max(m.mean, struct_pack(t := m.finished_at, k := m.job_id)), {1}) AS mean FROM j LEFT JOIN m ON m.lane = '{0}' AND m.finished_at <= j.submitted_at GROUP BY j.job_id)"


@register(
    "q3_announced_wait",
    f"WITH {_MEANS}, {_AHEAD}, s AS {_LANE.format('student', '35.0')}, t AS {_LANE.format('teacher', '150.0')}, "
    "r AS (SELECT a.job_id, any_value(a.submitted_at) AS at, arg_max(struct_pack(s := b.started_at, f := b.finished_at, lane := b.lane), struct_pack(t := b.started_at, k := b.job_id)) AS r FROM j a LEFT JOIN j b ON b.started_at < a.submitted_at GROUP BY a.job_id) "
    "SELECT j.job_id, ahead, round(ahead * t.mean + CASE WHEN r.r.f > r.at THEN greatest(0.0, CASE WHEN r.r.lane = 'student' THEN s.mean ELSE t.mean END - (r.at - r.r.s)) ELSE 0.0 END + CASE WHEN j.lane = 'student' THEN s.mean ELSE t.mean END, 3) AS wait_seconds FROM j JOIN a USING (job_id) JOIN s USING (job_id) JOIN t USING (job_id) JOIN r USING (job_id)",
)
def _(spark, d):
    return joblog.announced_wait(jobs(spark, d)).withColumn("wait_seconds", F.round("wait_seconds", 3))


@register("q4_outcomes", f"WITH j AS ({JOB_SQL}) SELECT lane, status, count(*) AS jobs, round(avg(finished_at - started_at), 3) AS mean_seconds, round(max(finished_at - started_at), 3) AS max_seconds FROM j GROUP BY ALL")
def _(spark, d):
    out = joblog.outcomes(jobs(spark, d))
    return out.select("lane", "status", "jobs", F.round("mean_seconds", 3).alias("mean_seconds"), F.round("max_seconds", 3).alias("max_seconds"))
