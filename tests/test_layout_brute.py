"""Fonts, word plans, column starts and pages by columns against plain Python over the registered queries' own words."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow import catalog
from folioflow.operators import encoding, layout
from folioflow.plans import registered_layout as registered

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


def rounded(x):
    """Half to even, as both sides deal places to slots."""
    return round(x)


def test_column_starts_equal_a_greedy_vote(spark):
    placed = registered.words(spark, str(DIR))
    metrics = layout.layout_metrics(placed)
    lined = layout.visual_lines(placed, metrics).select("doc_id", "page_no", "line_no", "x0", "x1").collect()
    width = {(r["doc_id"], r["page_no"]): r["width"] for r in registered.sizes(placed).collect()}
    rows = defaultdict(list)
    for r in lined:
        rows[r["doc_id"], r["page_no"], r["line_no"]].append((r["x0"], r["x1"]))
    votes = defaultdict(list)
    for (doc, page, _), words in rows.items():
        words.sort()
        for i, (x0, _) in enumerate(words):
            if i == 0 or x0 - words[i - 1][1] > 12:
                votes[doc, page, rounded(x0 / 6)].append(x0)
    pages = defaultdict(list)
    for (doc, page, _), xs in votes.items():
        if len(xs) >= 2:
            pages[doc, page].append((-len(xs), min(xs)))
    want = set()
    for key, found in pages.items():
        kept = []
        for _, x in sorted(found):
            if all(abs(x - k) >= 0.15 * width[key] for k in kept):
                kept.append(x)
        want |= {(*key, x) for x in kept}
    got = catalog.queries()["a17_clustered_boundaries"](spark, str(DIR)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_pages_by_columns_equal_a_reading_in_order(spark):
    placed = registered.words(spark, str(DIR))
    sizes = {r["doc_id"]: (r["line_height"], r["line_gap"]) for r in layout.layout_metrics(placed).collect()}
    pages = defaultdict(list)
    for r in placed.select("doc_id", "page_no", "word_no", "text", "x0", "x1", "top", "bottom").collect():
        over = [min(r["x1"], b) - max(r["x0"], a) for a, b in ((0.0, 270.0), (270.0, 560.0))]
        pages[r["doc_id"], r["page_no"]].append((r["top"], r["x0"], r["bottom"], r["text"], 0 if over[0] >= over[1] else 1))
    want = {}
    for key, words in pages.items():
        height, gap = sizes[key[0]]
        rows, top, last = [], None, None  # each row: words by column
        for t, _, bottom, text, column in sorted(words, key=lambda w: w[:2]):
            new_line = top is None or abs(t - top) > height * layout.LINE_MERGE
            if not rows or (new_line and t - last > gap * layout.ROW_BREAK):
                rows.append(([], []))
            top = t if new_line else top
            rows[-1][column].append(text)
            last = bottom if last is None else max(last, bottom)
        want[key] = "\n".join(" ".join(a) if not b else f"| {' '.join(a)} | {' '.join(b)} |" for a, b in rows)
    got = {(r["doc_id"], r["page_no"]): r["text"] for r in catalog.queries()["x8_render_columns"](spark, str(DIR)).collect()}
    assert got == want and any("|" in t for t in got.values())


def damaged(spark):
    """Words of three fonts: one whose accents were read in another encoding, one whole, one of few words."""
    seen, real = encoding.CANDIDATES[0]
    good = ["élève", "théorème", "où", "déjà", "forêt", "école", "leçon", "maïs", "fenêtre", "règle", "mère", "père", "bonté", "été", "lycée", "hôtel", "dîner", "âge", "île", "pré"]
    rows = []
    for doc in (1, 2):
        for n, w in enumerate(good * 4):
            bad = w.encode(real, "replace").decode(seen, "replace")
            rows += [(doc, "A", bad), (doc, "B", w if n % 3 else "mot"), (doc, "Symbol", bad)]
        rows += [(doc, "C", w) for w in good[:3]]
    return spark.createDataFrame(rows, "doc_id int, font string, text string")


def test_font_tables_equal_readings_counted_one_by_one(spark):
    words = damaged(spark)
    reads = {}
    for i, c in enumerate(encoding.CANDIDATES):
        for r in words.select("text", encoding.repaired(F.col("text"), c).alias("read")).distinct().collect():
            reads[i, r["text"]] = r["read"]
    from folioflow.operators import quality

    texts = sorted({t for k in reads for t in (k[1], reads[k])})
    judged = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.regexp_count("t", F.lit(quality.LETTER + "+")), F.regexp_count("t", F.lit(f"(?<!{quality.LETTER})(?:{quality.WORD})(?!{quality.LETTER})")), F.regexp_count("t", F.lit(quality.ANY_LETTER + "+"))
    )
    counts = {r[0]: tuple(r)[1:] for r in judged.collect()}
    fonts = defaultdict(Counter)
    for r in words.collect():
        fonts[r["doc_id"], r["font"]][r["text"]] += 1
    want = {}
    for key, held in fonts.items():
        fit = {}
        before = sum(counts[t][2] * k for t, k in held.items())
        for i in range(-1, len(encoding.CANDIDATES)):
            n, good, after = (sum(counts[t if i < 0 else reads[i, t]][c] * k for t, k in held.items()) for c in range(3))
            fit[i] = (round(good / n + 1e-12, 4) if n else 0.0) / (max(1.0, after / before) if before else 1.0)
        able = [i for i in fit if i == -1 or fit[i] >= fit[-1] + encoding.MARGIN]
        best = max(able, key=lambda i: (fit[i], -i))
        want[key] = -1 if "Symbol" in key[1] or sum(held.values()) < encoding.SAMPLE else best
    got = {(r["doc_id"], r["font"]): r["candidate"] for r in encoding.choose_font_tables(words).collect()}
    assert got == want and set(got.values()) > {-1}


def test_word_plan_equals_a_check_of_every_occurrence(spark):
    words = damaged(spark)
    tables = encoding.choose_font_tables(words)
    chosen = {(r["doc_id"], r["font"]): r["candidate"] for r in tables.collect()}
    seen = defaultdict(set)
    for r in words.collect():
        c = chosen[r["doc_id"], r["font"]]
        seen[r["doc_id"], r["text"]].add(c)
    reads = {}
    for c in {c for cs in seen.values() for c in cs}:
        read = F.col("text") if c < 0 else encoding.repaired(F.col("text"), encoding.CANDIDATES[c])
        for r in words.select("text", encoding.rescue(read).alias("fixed")).distinct().collect():
            reads[c, r["text"]] = r["fixed"]
    want = set()
    for (doc, text), cs in seen.items():
        fixed = {reads[c, text] for c in cs}
        if len(fixed) == 1 and fixed != {text}:
            want.add((doc, text, fixed.pop()))
    assert {tuple(r) for r in encoding.word_plan(words, tables).collect()} == want and want
