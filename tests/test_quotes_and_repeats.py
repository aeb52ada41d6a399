"""Quotes found by anchors and repeated answers found by bounds, against every pair."""

import random
from difflib import SequenceMatcher

import pytest

from folioflow.operators import quotes, repeats, review

FINDING = "finding_id long, course_id string, severity string, quote string"
SECTION = "course_id string, section_id long, content string"


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randint(0, vocabulary):x}" for _ in range(n))


def brute(findings, sections):
    flat = lambda t: " ".join(t.split()).lower()
    out = {}
    for f in findings:
        q = flat(f[3].strip(" «»\"'")) if f[3] else ""
        out[f[0]] = {s[1]: flat(s[2] or "").count(q) for s in sections if len(q) >= 12 and f[1] is not None and s[0] == f[1] and q in flat(s[2] or "")}
    return out


def test_places_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "STEP", 50)  # windows over the edges of pieces
    rng = random.Random(1)
    sections = [(rng.choice(["a", "b", None]), i, rng.choice([None, "", "short", *[words(rng, 60)] * 9])) for i in range(80)]
    sections += [("a", 100, sections[0][2]), ("b", 101, "Répété mot à mot, " * 5), ("b", 102, "répété  mot\nà mot, une fois")]
    findings = [(i, rng.choice(["a", "b", None]), "haute", q) for i, q in enumerate([None, "", "x", "onze lettre", "répété mot à mot,", "« répété mot à mot »", "Répété mot à mot, répété mot à mot", "nowhere to be found"] * 3)]
    for _, i, text in sections:
        if text and len(text) > 40:
            at = rng.randint(0, len(text) - 30)
            findings.append((1000 + i, rng.choice(["a", "b"]), "basse", text[at : at + rng.randint(12, 30)].strip()))
    findings.append((999, "a", "basse", sections[0][2]))
    f, s = spark.createDataFrame(findings, FINDING), spark.createDataFrame(sections, SECTION)
    got = {}
    for r in review.finding_places(f, s).collect():
        got.setdefault(r["finding_id"], {})[r["section_id"]] = r["occurrences"]
    want = brute(findings, sections)
    assert got == {k: v for k, v in want.items() if v}
    told = {r["finding_id"]: r["section_id"] for r in review.attribute_findings(f, s).collect()}
    single = {k: [i for i, n in v.items() if n == 1] for k, v in want.items()}
    assert told == {k: v[0] if len(v) == 1 else None for k, v in single.items()} and any(told.values())


def test_a_course_of_many_sections_and_findings(spark):
    """Candidates grow with the findings, not with findings times sections."""
    rng = random.Random(2)
    sections = [("c", i, words(rng, 40, 4000)) for i in range(5000)]
    findings = [(i, "c", "haute", " ".join(sections[i][2].split()[5:12])) for i in range(5000)]
    s, f = spark.createDataFrame(sections, SECTION).repartition(4), spark.createDataFrame(findings, FINDING).repartition(4)
    told = {r["finding_id"]: r["section_id"] for r in review.attribute_findings(f, s).collect()}
    assert told == {i: i for i in range(5000)}
    plan = review.attribute_findings(f, s)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_findings_or_sections(spark):
    f, s = spark.createDataFrame([(1, "a", "x", "a quote of some length")], FINDING), spark.createDataFrame([("a", 1, "here is a quote of some length")], SECTION)
    assert review.finding_places(f.limit(0), s).collect() == [] == review.finding_places(f, s.limit(0)).collect()
    assert [tuple(r) for r in review.finding_places(f, s).collect()] == [(1, 1, 1)]


# --- repeated answers


def brute_repeats(turns, least=0.5):
    out = {}
    own = [(c, n, " ".join((t or "").split()).lower()) for c, n, r, t in turns if r == "assistant"]
    for c, n, t in own:
        hits = [m for d, m, o in own if d == c and c is not None and m < n and t and o and SequenceMatcher(None, t, o).ratio() >= least]
        if hits:
            out[c, n] = min(hits)
    return out


def changed(rng, text, share):
    parts = text.split(" ")
    return " ".join(words(rng, 1) if rng.random() < share else p for p in parts)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    turns = []
    for c in range(14):
        said = []
        for n in range(18):
            size = rng.choice([1, 3, 12, 60, 140])
            text = changed(rng, rng.choice(said), rng.choice([0, 0.2, 0.45, 0.6, 0.8])) if said and rng.random() < 0.5 else words(rng, size)
            said.append(text)
            turns.append((c, n, rng.choice(["assistant"] * 4 + ["user"]), text))
    turns += [(None, 1, "assistant", "x"), (None, 2, "assistant", "x"), (50, 1, "assistant", None), (50, 2, "assistant", ""), (50, 3, "assistant", "a" * 300), (50, 4, "assistant", "a" * 300), (50, 4, "assistant", "Ja"), (50, 5, "assistant", "ja")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    want = brute_repeats(turns)
    for block in (512, 4):
        got = {(r["conv_id"], r["turn"]): r["earlier"] for r in repeats.repeated(df.filter("role = 'assistant'").selectExpr("conv_id", "turn", "lower(trim(regexp_replace(coalesce(text, ''), '\\\\s+', ' '))) t").filter("t != ''"), 0.5, block).collect()}
        assert got == want
    assert {(r["conv_id"], r["turn"]): r["earlier"] for r in review.repeated_answers(df).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_nothing(seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([50, 90, 150]), 40) for _ in range(25)]
    texts += [changed(rng, rng.choice(texts), rng.choice([0.1, 0.4, 0.5, 0.6])) for _ in range(35)]
    found, measured = repeats.earliest_repeats(texts, [99] * len(texts), texts, list(range(len(texts))), 0.5)
    want = [min((j for j, y in enumerate(texts) if SequenceMatcher(None, x, y).ratio() >= 0.5), default=None) for x in texts]
    assert found == want


def test_a_conversation_of_ten_thousand_turns(spark):
    """Few pairs are measured, and no task holds the conversation."""
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(1500)]
    turns = [(1, n, "assistant", base[n] if n < 1500 else base[rng.randint(0, 1499)]) for n in range(10_000)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(4)
    got = {r["turn"]: r["earlier"] for r in review.repeated_answers(df).collect()}
    at = {t: n for n, t in enumerate(base)}
    want = {n: at[t] for _, n, _, t in turns if n >= 1500 and SequenceMatcher(None, t, t).ratio() >= 0.5}
    assert {n: e for n, e in got.items() if n >= 1500} == {n: got[n] for n in want} and all(got[n] <= e for n, e in want.items())


def test_large_files_are_not_read(spark, tmp_path):
    from folioflow.sources import files

    (tmp_path / "a.md").write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PDF").write_bytes(b"y" * 100)
    read = files.read_files(spark, str(tmp_path), 50)
    assert [(r["media_type"], bytes(r["content"])) for r in read.collect()] == [("text/markdown", b"x" * 10)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [LessThanOrEqual(length,50)" in plan or "LessThanOrEqual(length,50)" in plan
    large = files.oversized_files(spark, str(tmp_path), 50)
    assert [(r["path"].rsplit("/", 1)[1], r["media_type"], r["length"], r["code"]) for r in large.collect()] == [("b.PDF", "application/pdf", 100, "DOCUMENT_TOO_LARGE")]
    assert "content" not in large._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
