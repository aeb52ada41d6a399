"""Yearly schedules: Markdown tables of weeks, chapters and objectives become ordered chapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import saved
from .cleaning import CALENDAR

MONTHS = list(CALENDAR[:12])
#: Words of a header cell (folded) and the role they give its column, in order of precedence.
ROLES = {
    "weeks": ("periode", "periodes"),
    "part": ("partie", "parties"),
    "chapter": ("lecon", "lecons", "contenu", "contenus", "theme", "chapitre"),
    "objectives": ("objectif", "objectifs", "competence", "competences"),
    "assessments": ("acquis", "evaluer", "evaluation", "evaluations"),
}
#: How weekly hours and the header fields are written.
HOURS = "(?iU)\\(?\\s*(\\d{1,2})\\s*(?:h|heures?)\\s*/\\s*semaine\\s*\\)?"
FIELD = "(?imU)({0})\\s*:\\s*(.+?)(?=\\s{{2,}}|\\s*(?:discipline|niveau|annee|année)\\s*:|$)"


def _strip(c: Column, chars: str = "\\s") -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def month_of(cells: Column) -> Column:
    """The month that stands alone in a row, ``Mois de ...`` or the bare name; else null."""
    filled = F.filter(cells, lambda c: c != "")
    name = F.trim(F.regexp_replace(tx.fold(F.get(filled, F.lit(0))), "^mois\\s+d[eu']?\\s*", ""))
    plain = F.array(*(tx.fold(F.lit(m)) for m in MONTHS))
    at = F.array_position(plain, name)
    return F.when((F.size(filled) == 1) & (at > 0), F.element_at(F.array(*map(F.lit, MONTHS)), at.cast("int")))


def weeks_of(cell: Column) -> Column:
    return F.transform(F.regexp_extract_all(cell, F.lit("(?i)semaine\\s*(\\d{1,2})"), F.lit(1)), lambda w: w.cast("int"))


def items_of(cell: Column) -> Column:
    """The entries of a numbered list in a cell."""
    parts = F.filter(F.split(cell, "(?<!\\d)(?=\\d{1,2}\\.\\s)", -1), lambda p: F.trim(p) != "")
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(_strip(p, " .;"), "^\\d{1,2}\\.\\s*", "")))
    return F.filter(plain, lambda p: p != "")


def header_roles(cells: Column) -> Column:
    """Column numbers of the roles (-1: none): each cell takes the first role it names that is still free."""
    names = list(ROLES)

    def step(acc: Column, folded: Column) -> Column:
        wants = [(acc[n] < 0) & reduce(lambda a, b: a | b, (F.contains(folded, F.lit(k)) for k in ROLES[n])) for n in names]
        taken = F.lit(False)
        fields = []
        for n, w in zip(names, wants, strict=True):
            fields.append(F.when(w & ~taken, acc["i"]).otherwise(acc[n]).alias(n))
            taken = taken | w
        return F.struct((acc["i"] + 1).alias("i"), *fields)

    return F.aggregate(F.transform(cells, tx.fold), F.struct(F.lit(0).alias("i"), *(F.lit(-1).alias(n) for n in names)), step)


def split_chapter(raw: Column) -> Column:
    """Struct (title, details): what follows in parentheses or as a numbered plan is detail."""
    text = F.regexp_replace(_strip(F.regexp_replace(raw, "(?i)^\\s*chapitre\\s*\\d+\\s*:?\\s*", "")), "[ .;]+$", "")
    paren = text.rlike("(?s)^[^(]+\\(.*\\)$")
    plan = text.rlike("(?s)^.+?\\s*\\d{1,2}\\)\\s")
    title = F.when(paren, F.regexp_extract(text, "(?s)^([^(]+)\\(", 1)).when(plan, F.regexp_extract(text, "(?s)^(.+?)\\s*\\d{1,2}\\)\\s", 1)).otherwise(text)
    details = F.when(paren, F.regexp_extract(text, "(?s)^[^(]+\\((.*)\\)$", 1)).when(plan, F.regexp_extract(text, "(?s)^.+?(\\s*\\d{1,2}\\)\\s.*)$", 1)).otherwise("")
    return F.struct(_strip(title, " :–-").alias("title"), _strip(details).alias("details"))


def unique_folded(values: Column) -> Column:
    """Values in order, of those with one folded key the first; empty keys dropped."""
    keyed = F.transform(values, lambda v: F.struct(v.alias("v"), F.trim(tx.fold(v)).alias("k")))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        new = (x["k"] != "") & ~F.array_contains(acc["keys"], x["k"])
        add = lambda field, value: F.when(new, F.concat(acc[field], F.array(value))).otherwise(acc[field]).alias(field)
        return F.struct(add("keys", x["k"]), add("out", x["v"]))

    return F.aggregate(keyed, F.struct(none.alias("keys"), none.alias("out")), step)["out"]


def header_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, school_year, weekly_hours, subject, grade_label) read in the first forty lines; null where missing."""
    head = F.array_join(F.slice(F.split("text", "\r\n|\n|\r"), 1, 40), "\n")
    year = "(\\d{4})\\s*[–—-]\\s*(\\d{4})"
    # each pattern goes over the head once, what follows reads its short match
    found = docs.select("doc_id", head.alias("head")).select(
        "doc_id",
        F.regexp_extract("head", year, 0).alias("year"),
        F.when(F.col("head").rlike("(?iU)/\\s*semaine"), F.regexp_extract("head", HOURS, 1)).otherwise("").alias("hours"),
        *(F.regexp_extract("head", FIELD.format(n), 2).alias(n) for n in ("discipline", "niveau")),
    )
    field = lambda n: F.nullif(_strip(F.regexp_replace(_strip(F.col(n), " |"), HOURS, ""), " ()|"), F.lit(""))
    return found.select(
        "doc_id",
        F.when(F.col("year") != "", F.concat_ws("-", F.regexp_extract("year", year, 1), F.regexp_extract("year", year, 2))).alias("school_year"),
        F.nullif("hours", F.lit("")).cast("int").alias("weekly_hours"),
        field("discipline").alias("subject"),
        field("niveau").alias("grade_label"),
    )


def schedule_rows(docs: DataFrame) -> DataFrame:
    """Table rows with their month, role cells and the number of their chapter (0: before the first)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r", -1)).alias("line_no", "line"))
    # only what stands at the ends of a line tells whether the pattern has to go over it
    edged = F.left("line", F.lit(1)).rlike("\\s") | F.right("line", F.lit(2)).rlike("\\s$")
    rows = rows.withColumn("line", F.when(edged, _strip(F.col("line"))).otherwise(F.col("line"))).filter(F.col("line").startswith("|"))
    # a header names the weeks
    rows = rows.withColumn("may_head", tx.fold_contains(F.col("line"), ROLES["weeks"]))
    rows = rows.withColumn("cells", tx.markdown_cells(F.col("line"))).withColumn("month_row", month_of(F.col("cells")))
    by_doc = Window.partitionBy("doc_id")
    in_order = by_doc.orderBy("line_no")
    rows = rows.withColumn("month", F.last("month_row", ignorenulls=True).over(in_order)).filter("month_row is null")
    rows = rows.withColumn("roles", F.when(F.col("may_head"), header_roles(F.col("cells"))))
    header = F.min(F.when(F.col("roles.weeks") >= 0, F.struct("line_no", "roles"))).over(by_doc)
    rows = rows.withColumn("header", header).filter("header is null or line_no != header.line_no").withColumn("ruled", F.coalesce(F.col("line_no") > F.col("header.line_no"), F.lit(False)))
    cell = lambda n, i: F.coalesce(F.get("cells", i), F.lit("")) if n is None else F.when(F.col(f"header.roles.{n}") >= 0, F.coalesce(F.get("cells", F.col(f"header.roles.{n}")), F.lit(""))).otherwise("")
    pick = lambda n, other: F.when(F.col("ruled"), cell(n, None)).otherwise(other).alias(f"{n}_cell")
    rest = F.array_join(F.slice("cells", F.lit(3), F.greatest(F.size("cells") - 2, F.lit(0))), " ")
    rows = rows.select(
        "doc_id", "line_no", "month", "ruled",
        pick("weeks", cell(None, F.lit(0))), pick("chapter", cell(None, F.lit(1))), pick("objectives", rest), pick("assessments", F.lit("")), pick("part", F.lit("")),
    ).withColumn("weeks", weeks_of(F.col("weeks_cell")))
    opens = (F.size("weeks") > 0) & (F.col("chapter_cell") != "")
    rows = rows.withColumn("opens", opens).withColumn("nth", F.sum(F.col("opens").cast("int")).over(in_order))
    new = F.col("opens") & (~F.col("chapter_cell").rlike("(?i)\\(\\s*suite") | (F.col("nth") == 1))
    return rows.withColumn("new", new).withColumn("chapter_no", F.sum(F.col("new").cast("int")).over(in_order))


def parse_plannings(docs: DataFrame) -> dict[str, DataFrame]:
    """``entries`` (doc_id, position, chapter, details, part, objectives, assessments, periods) and ``plannings`` with header fields and warnings."""
    rows = saved(schedule_rows(docs), "schedule")
    mine = rows.filter("chapter_no > 0 and (opens or objectives_cell != '' or assessments_cell != '')")
    tests = F.when(F.col("new") | ~F.col("opens"), items_of(F.col("assessments_cell"))).otherwise(F.array().cast("array<string>"))
    ordered = lambda value: F.sort_array(F.collect_list(F.struct("line_no", value.alias("v"))))
    grouped = mine.groupBy("doc_id", "chapter_no").agg(
        F.min_by("chapter_cell", "line_no").alias("raw"),
        F.min_by("part_cell", "line_no").alias("part"),
        ordered(items_of(F.col("objectives_cell"))).alias("o"),
        ordered(tests).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("opens"), F.struct("line_no", "month", "weeks")))).alias("p"),
    )
    flat = lambda c: unique_folded(F.flatten(F.transform(c, lambda x: x["v"])))
    entries = grouped.withColumn("t", split_chapter(F.col("raw"))).select(
        "doc_id",
        F.col("chapter_no").cast("int").alias("position"),
        F.col("t.title").alias("chapter"),
        F.col("t.details").alias("details"),
        "part",
        flat("o").alias("objectives"),
        flat("a").alias("assessments"),
        F.transform("p", lambda x: F.struct(x["month"].alias("month"), x["weeks"].alias("weeks"))).alias("periods"),
    )
    found = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.bool_or(F.exists("periods", lambda p: p["month"].isNull())).alias("no_month"))
    loose = rows.groupBy("doc_id").agg(
        F.bool_or(~F.col("ruled") & (F.size("weeks") > 0)).alias("no_header"),
        F.bool_or((F.size("weeks") > 0) & (F.col("chapter_cell") == "") & (F.col("chapter_no") == 0) & ((F.col("objectives_cell") != "") | (F.col("assessments_cell") != ""))).alias("orphan"),
    )
    told = header_fields(docs).join(found, "doc_id", "left").join(loose, "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    warnings = {
        "PLANNING_HEADER_NOT_FOUND": yes("no_header"),
        "PLANNING_ROW_WITHOUT_CHAPTER": yes("orphan"),
        "PLANNING_NOT_RECOGNISED": F.col("entries").isNull(),
        "PLANNING_YEAR_MISSING": F.col("school_year").isNull(),
        "PLANNING_SUBJECT_MISSING": F.col("subject").isNull(),
        "PLANNING_GRADE_MISSING": F.col("grade_label").isNull(),
        "PLANNING_MONTH_MISSING": yes("no_month"),
    }
    plannings = told.withColumn("warnings", F.array_compact(F.array(*(F.when(c, F.lit(w)) for w, c in warnings.items())))).drop("no_month", "no_header", "orphan")
    return {"entries": entries, "plannings": plannings}
