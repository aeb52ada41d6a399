"""Review of edits, courses, quizzes and conversations: deterministic checks over whole tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import quotes, repeats

#: Signs that bear meaning.
BEARING = "[0-9+\\-*/=<>%°±×÷≈≠≤≥∞√∑∏∫∈∉⊂⊃∪∩∅→←↔⇒⇔∀∃∂∇‖αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ]"
#: Compatibility forms of digits and signs that count as the plain ones.
_COMPAT = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼₀₁₂₃₄₅₆₇₈₉₊₋₌＋－＝０１２３４５６７８９", "0123456789+−=0123456789+−=+-=0123456789")
#: How an explanation announces its answer, and how students contest a result or say that they are lost.
ANNOUNCED = (
    "(?iu)(?:la\\s+)?(?:bonne\\s+)?r[ée]ponse\\s+(?:correcte\\s+|juste\\s+|exacte\\s+)?(?:est|:)\\s*(?:donc\\s+)?"
    "(?:la\\s+|le\\s+)?(?:choix\\s+|proposition\\s+|option\\s+)?\\(?([A-D])\\s*[)\\].,:\\s]"
)
CONTESTS = "(?iU)\\b(faux|fausse|erreur|tromp|incorrect|pas juste|pas bon|n'est pas (?:ça|ca|correct)|v[ée]rifie|corrige)"
LOST = (
    "(?iU)(comprends? (?:toujours |encore |vraiment )?pas|pas compris|je suis perdu|perdue?\\b"
    "|explique(?:-le|-moi)? autrement|j'y arrive pas|c'est flou|pas clair)"
)
#: Characters kept of the last answer, and of those before.
LAST_KEPT, EARLIER_KEPT = 1500, 300


def bearing_signs(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), *_COMPAT), F.lit(BEARING), F.lit(0))


def symbol_diff(pairs: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """(id, symbol, change): how many more or fewer of each bearing sign there are afterwards."""
    side = lambda c, n: pairs.select(id_col, F.explode(bearing_signs(F.col(c))).alias("symbol"), F.lit(n).alias("n"))
    both = side(before, -1).unionByName(side(after, 1))
    return both.groupBy(id_col, "symbol").agg(F.sum("n").alias("change")).filter("change != 0")


def multiset_diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of b beyond those of a, and of a beyond those of b, counting repeats.

    Both sides read one grouping, so the rows are shuffled once.
    """
    both = b.withColumn("_n", F.lit(1)).unionByName(a.withColumn("_n", F.lit(-1)))
    net = both.groupBy(*b.columns).agg(F.sum("_n").alias("_n"))

    def repeated(df: DataFrame) -> DataFrame:
        # a row as often as it counts, in runs of 10,000
        runs = df.withColumn("_i", F.explode(F.expr("sequence(0, (_n - 1) div 10000)")))
        return runs.withColumn("_i", F.explode(F.expr("sequence(1, least(10000, _n - _i * 10000))"))).drop("_i", "_n")

    return repeated(net.filter("_n > 0")), repeated(net.filter("_n < 0").withColumn("_n", -F.col("_n")))


def formula_orphans(text: Column) -> Column:
    """Formula delimiters without a partner."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    return F.abs(n("\\\\\\[") - n("\\\\\\]")) + F.abs(n("\\\\\\(") - n("\\\\\\)")) + n("\\$") % 2 + F.abs(n("\\\\begin\\{") - n("\\\\end\\{"))


def outside_formulas(text: Column) -> Column:
    """The text with its formulas taken out; an unclosed one takes the rest."""
    return F.regexp_replace(text, "(?s)(\\\\\\(|\\\\\\[|\\\\begin\\{).*?(\\\\\\)|\\\\\\]|\\\\end\\{|$)|\\$[^$]*(\\$|$)", " ")


def text_damage(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add formula_orphans, stray_accents and naked_commands."""
    text = F.coalesce(text_col, F.lit(""))
    accents = F.regexp_count(text, F.lit("(?<![\\p{L}\\p{Nl}\\p{No}])[\\u0300-\\u036f]"))
    commands = F.regexp_count(outside_formulas(text), F.lit("\\\\[a-zA-Z]{2,}"))
    return df.withColumn("formula_orphans", formula_orphans(text)).withColumn("stray_accents", accents).withColumn("naked_commands", commands)


def announced_answer(explanation: Column) -> Column:
    """0 to 3 for the letter that an explanation gives as right, null if it gives none."""
    letter = F.upper(F.regexp_extract(explanation, ANNOUNCED, 1))
    return F.when(letter != "", F.ascii(letter) - F.ascii(F.lit("A")))


def contradicted_quizzes(quizzes: DataFrame) -> DataFrame:
    """Quizzes whose explanation announces another answer than the recorded one, with ``suggested``."""
    told = quizzes.withColumn("suggested", announced_answer(F.col("explanation")))
    return told.filter(F.col("suggested").isNotNull() & ~F.col("suggested").eqNullSafe(F.col("answer")))


def intents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add contests_result and does_not_understand."""
    text = F.coalesce(text_col, F.lit(""))
    return df.withColumn("contests_result", text.rlike(CONTESTS)).withColumn("does_not_understand", text.rlike(LOST))


def recap(turns: DataFrame, speaker: str = "assistant") -> DataFrame:
    """Turns with blanks collapsed; the last one of the speaker kept long, its earlier ones short, blank ones dropped."""
    text = F.trim(tx.collapse_blanks(F.coalesce("text", F.lit(""))))
    last = F.max(F.when(F.col("role") == speaker, F.col("turn"))).over(Window.partitionBy("conv_id"))
    limit = F.when(F.col("turn") == F.col("last"), LAST_KEPT).otherwise(EARLIER_KEPT)
    short = F.when(F.char_length("text") <= limit, F.col("text")).otherwise(F.concat(F.substr("text", F.lit(1), limit), F.lit("…")))
    kept = turns.withColumn("last", last).withColumn("text", text).filter("text != ''")
    return kept.select("conv_id", "turn", "role", F.when(F.col("role") == speaker, short).otherwise(F.col("text")).alias("recap"))


def repeated_answers(turns: DataFrame, speaker: str = "assistant", least: float = 0.5) -> DataFrame:
    """(conv_id, turn, earlier): answers that repeat an earlier one of their conversation."""

    text = F.lower(F.trim(tx.collapse_blanks(F.coalesce("text", F.lit("")))))
    own = turns.filter(F.col("role") == speaker).select("conv_id", "turn", text.alias("t")).filter("t != ''")
    return repeats.repeated(own, least)


def locate_quotes(texts: DataFrame, asked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, quote_id, occurrences, position, code): the one place of each quote, blanks collapsed on both sides.

    The position is that in the collapsed text, from 0.
    """
    flat = texts.select(id_col, tx.collapse_blanks(F.coalesce("text", F.lit(""))).alias("flat"))
    asked = asked.select(id_col, "quote_id", F.trim(tx.collapse_blanks(F.coalesce("quote", F.lit("")))).alias("q"))
    found = asked.join(flat, id_col, "left").withColumn("occurrences", F.coalesce(tx.occurrences(F.col("flat"), F.col("q")), F.lit(0)))
    code = F.when(F.col("q") == "", "EMPTY").when(F.col("occurrences") == 0, "NOT_FOUND").when(F.col("occurrences") > 1, "AMBIGUOUS")
    at = F.when(F.col("occurrences") == 1, F.expr("locate(q, flat)") - 1)
    return found.select(id_col, "quote_id", "occurrences", at.alias("position"), code.alias("code"))


def quote_key(text: Column) -> Column:
    return F.lower(F.trim(tx.collapse_blanks(text)))


def finding_places(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """(finding_id, section_id, occurrences): sections of its course that hold the quote of a finding, of ``quotes.ANCHOR`` characters or more."""
    q = findings.select("finding_id", "course_id", quote_key(F.regexp_replace("quote", "^[ «»\"']+|[ «»\"']+$", "")).alias("q"))
    s = sections.select("course_id", "section_id", quote_key(F.coalesce("content", F.lit(""))).alias("body"))
    return q.join(quotes.quoted_places(q, s), ["course_id", "q"]).select("finding_id", "section_id", "occurrences")


def attribute_findings(findings: DataFrame, sections: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(finding_id, section_id): the only section of the course that holds the quote exactly once, else null."""
    once = (finding_places(findings, sections) if places is None else places).filter("occurrences = 1")
    only = once.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n"), F.min("section_id").alias("section_id")).filter("n = 1")
    return findings.select("finding_id").join(only.select("finding_id", "section_id"), "finding_id", "left")


def cited_labels(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label): labels such as [S1] or [P2] in a text, each once."""
    found = F.array_distinct(F.regexp_extract_all(text_col, F.lit("\\[([SP]\\d+)\\]"), F.lit(1)))
    return df.select(id_col, F.explode(found).alias("label"))


def resolve_citations(texts: DataFrame, registry: DataFrame, id_col: str = "section_id") -> DataFrame:
    """Cited labels with their passages; labels that the registry does not know drop out."""
    return cited_labels(texts, id_col, "text").join(registry, [id_col, "label"])


def place_figures(paragraphs: DataFrame, registry: DataFrame) -> DataFrame:
    """(section_id, par_no, figure): after the first paragraph that cites its passage, unless the section shows it already."""
    cited = cited_labels(paragraphs.withColumn("at", F.struct("section_id", "par_no")), "at", "text").select("at.section_id", "at.par_no", "label")
    wanted = cited.join(registry, ["section_id", "label"]).select("section_id", "par_no", F.explode("figures").alias("figure"))
    there = paragraphs.select("section_id", F.explode(tx.figures_in(F.col("text"))).alias("figure")).distinct()
    return wanted.join(there, ["section_id", "figure"], "left_anti").groupBy("section_id", "figure").agg(F.min("par_no").alias("par_no"))


def uncovered_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of an assessment that no item covers."""
    covered = items.select("assessment_id", F.explode("covers").alias("source_id")).distinct()
    return sources.join(covered, ["assessment_id", "source_id"], "left_anti")


def rebalance_points(items: DataFrame) -> DataFrame:
    """Points pro rata to the announced total, one at least, halves to even; the rest goes to the first item."""
    w = Window.partitionBy("assessment_id")
    awarded = F.when(F.sum("points").over(w) == 0, 1).otherwise(F.sum("points").over(w))
    share = F.greatest(F.lit(1), F.bround(F.col("points") * F.col("total") / awarded, 0).cast("int"))
    shared = items.withColumn("share", share)
    drift = F.col("total") - F.sum("share").over(w)
    first = F.row_number().over(w.orderBy("item_no")) == 1
    return shared.withColumn("points", F.when(first, F.greatest(F.lit(1), F.col("share") + drift)).otherwise(F.col("share")).cast("int")).drop("share")


def cap_items(items: DataFrame, count: int) -> DataFrame:
    """At most ceil(count / parts) items of each part, then the first ``count`` of all."""
    parts = items.groupBy(F.col("request_id").alias("_request")).agg(F.count_distinct("part_no").alias("_parts"))
    nth = F.row_number().over(Window.partitionBy("request_id", "part_no").orderBy("item_no"))
    # no part gives more than ``count``: tasks drop the others before the shuffle
    first = items.withColumn("_nth", nth).filter(F.col("_nth") <= count)
    kept = first.join(parts, F.col("request_id").eqNullSafe(F.col("_request"))).filter(F.col("_nth") <= F.ceil(F.lit(count) / F.col("_parts"))).drop("_request")
    total = F.row_number().over(Window.partitionBy("request_id").orderBy("part_no", "item_no"))
    return kept.withColumn("_all", total).filter(F.col("_all") <= count).drop("_parts", "_nth", "_all")


def fit_sources(sources: DataFrame, budget: int, least: int = 800) -> DataFrame:
    """Each source of a request cut to its equal share of the budget, and whether it was."""
    share = F.greatest(F.lit(least), F.floor(F.lit(budget) / F.count(F.lit(1)))).cast("int")
    shares = sources.groupBy(F.col("request_id").alias("_request")).agg(share.alias("share"))
    shared = sources.join(shares, F.col("request_id").eqNullSafe(F.col("_request"))).drop("_request")
    return shared.withColumn("truncated", F.char_length("text") > F.col("share")).withColumn("text", F.substr("text", F.lit(1), F.col("share")))


def classify_proposals(edits: DataFrame, uncertain: str = "INCERTAIN") -> DataFrame:
    """Add ``verdict``: UNCERTAIN, UNCHANGED, REWRITTEN, SYMBOLS_CHANGED or FORM_ONLY, and the changed symbols."""
    before, after = F.trim(F.coalesce("before", F.lit(""))), F.trim(F.coalesce("after", F.lit("")))
    a, b = bearing_signs(before), bearing_signs(after)
    count = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    signs = F.array_sort(F.array_union(a, b))
    changed = F.filter(F.transform(signs, lambda c: F.struct(c.alias("symbol"), (count(b, c) - count(a, c)).alias("change"))), lambda s: s["change"] != 0)
    told = edits.withColumn("symbols", changed)
    verdict = (
        F.when((after == "") | F.upper(after).startswith(uncertain), "UNCERTAIN")
        .when(before == after, "UNCHANGED")
        .when(tx.excessive_rewrite(before, after), "REWRITTEN")
        .when(F.size("symbols") > 0, "SYMBOLS_CHANGED")
        .otherwise("FORM_ONLY")
    )
    return told.withColumn("verdict", verdict)


def apply_revisions(sections: DataFrame, operations: DataFrame) -> DataFrame:
    """Sections after operations (course_id, op_no, action, heading, content): keep, drop, rewrite, append.

    Actions are supprimer, reecrire and ajouter (fixed values); of several on one heading the
    last counts.  Rewriting or dropping an unknown heading and adding a known one do nothing.
    """
    keys = ["course_id", "heading"]
    w = Window.partitionBy(*keys).orderBy(F.desc("op_no"))
    ops = operations.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("content", "new_content")
    both = sections.join(ops, keys, "full_outer")
    known = F.col("position").isNotNull()
    keep = F.when(known, F.coalesce(F.col("action") != "supprimer", F.lit(True))).otherwise(F.col("action") == "ajouter")
    text = F.when(known & F.coalesce(F.col("action") == "reecrire", F.lit(False)), F.col("new_content")).when(known, F.col("content")).otherwise(F.col("new_content"))
    order = F.struct(F.when(known, 0).otherwise(1).alias("a"), F.coalesce("position", F.lit(0)).alias("b"), F.coalesce("op_no", F.lit(0)).alias("c"))
    kept = both.filter(keep).select(*keys, text.alias("content"), order.alias("o"))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("course_id").orderBy("o")) - 1).drop("o")


def failure_cause(status: Column, message: Column) -> Column:
    """Why a job failed, from its status and message: credit, key, model or silent."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 402) | m.rlike("credit|quota|billing"), "CREDIT")
        .when(status.isin(401, 403) | m.rlike("api key|unauthorized|forbidden"), "KEY")
        .when((status == 404) | m.rlike("model.*not found|no such model"), "MODEL_MISSING")
        .otherwise("SILENT")
    )


def accept_correction(original: Column, proposed: Column, explanation: Column) -> Column:
    """A correction counts if an error is named, it keeps 40 % of the length, and it differs."""
    named = F.coalesce(F.trim(explanation), F.lit("")) != ""
    return named & (F.char_length(proposed) >= 0.4 * F.char_length(original)) & (quote_key(proposed) != quote_key(original))
