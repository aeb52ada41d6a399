"""Merkle manifests, periodic runs and language identification against plain Python, with hard cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import langid, merkle, queries, runs

DIR = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
tables = pytest.mark.skipif(not DIR.exists(), reason="no test tables")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- Merkle manifests


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        yield level[i // 8 * 8 : i], level[i + 1 : i // 8 * 8 + 8]
        i //= 8


def leaf_of(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def brute_merkle(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r["lang"]].append(r)
    names = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        parts[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
    trees = [tree_of([leaf_of(r, r["text"]) for r in parts[k]]) for k in names]
    top = tree_of([t[-1][0] for t in trees])
    for t, k in enumerate(names):
        for i, r in enumerate(parts[k]):
            way = [*siblings(trees[t], i), *siblings(top, t)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            held = leaf_of(r, text)
            for left, right in way:
                held = H("".join(left) + held + "".join(right))
            root = top[-1][0]
            yield r["doc_id"], trees[t][0][i], trees[t][-1][0], root, H("".join("".join(a) + "".join(b) for a, b in way)), held, held == root


def check_merkle(df, **options):
    got = [tuple(r) for r in merkle.merkle_report(df, **options).collect()]
    want = list(brute_merkle([r.asDict() for r in df.collect()]))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@tables
def test_merkle_equals_brute_force(spark):
    got = check_merkle(spark.read.parquet(str(DIR / "documents.parquet")))
    assert {r[-1] for r in got} == {True, False}


def test_merkle_many_levels_by_shuffles_and_broadcasts(spark):
    rows = [(i * 3, "s", "en" if i % 50 else f"l{i % 7}", i, f"Text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert check_merkle(df, near=3) == check_merkle(df, near=3)
    check_merkle(df)


def test_merkle_hard_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (1, "s", None, 0, ""), (None, "s", "é", 1, "Ä" * 200_000), (None, "s", "é", 1, "B"), (-5, "s", "é", 1, "C"), (0, "s", "Z", 1, "D" * 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    check_merkle(df)
    check_merkle(df.filter("doc_id = 0"))  # one leaf is subroot and root
    check_merkle(df.filter("doc_id = 1"))
    many = spark.createDataFrame([(i, "s", f"l{i:03}", 1, "x") for i in range(70)], SCHEMA)  # more parts than one run holds
    check_merkle(many)


def test_merkle_of_nothing_and_names_that_clash(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_report(empty).collect() == []
    more = spark.createDataFrame([(1, "s", "en", 1, "A"), (2, "s", "en", 1, "B")], SCHEMA)
    for name in ("tree", "at", "digest", "row", "part", "idx", "path", "leaf", "root", "n", "ended"):
        more = more.withColumn(name, F.lit("x"))
    got = {tuple(r) for r in merkle.merkle_report(more).collect()}
    assert got == set(brute_merkle([r.asDict() for r in more.collect()]))


def test_merkle_proofs_with_other_columns(spark):
    df = spark.range(20).selectExpr("id", "id % 2 k", "cast(id as string) v")
    rows = merkle.proofs(df, F.col("k"), F.col("id"), merkle.row_digest(F.col("v")), {"id": F.col("id")})
    assert rows.filter(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
    assert rows.filter(merkle.fold(merkle.row_digest(F.lit("other")), F.col("path")) == F.col("root")).count() == 0


@tables
def test_merkle_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    rows = con.execute(queries.oracle_sql()["op11_merkle"])
    names = [c[0] for c in rows.description]
    df = queries.queries()["op11_merkle"](spark, str(DIR))
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rows.fetchall())


# --- periodic runs


def brute_runs(words):
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and (s, i - s + q) not in seen:  # smaller periods came first
                seen.add((s, i - s + q))
                out.append((s, i - s + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_rest(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_report(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, H("".join("%d,%d,%d\n" % r for r in found)), H(brute_rest(words, found))


def random_texts(rng, n):
    for _ in range(n):
        letters, words = "abcdefgh"[: rng.choice([1, 2, 3, 4, 8])], []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            words += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
        yield rng.choice([" ", "\n", " \t "]).join(words)


def check_runs(texts):
    lists, rest = runs.runs_and_rest(pa.array(texts, pa.string()))
    for text, found, left in zip(texts, lists, rest.to_pylist(), strict=True):
        words = WORD.findall(text or "")
        want = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want, text
        assert left == brute_rest(words, want)


def test_runs_equal_brute_force():
    check_runs([None, "", " \n", "a", "a a a a a", "a a a a a a", "\x0bx y\rx y x y x y\x0c", "é é é é é é", *random_texts(random.Random(3), 1500)])


def test_runs_of_words_that_share_a_hash(monkeypatch):
    real = runs.word_hashes
    monkeypatch.setattr(runs, "word_hashes", lambda *a: real(*a) % np.uint64(3))
    monkeypatch.setattr(runs, "mix", lambda x: x % np.uint64(5))
    check_runs(list(random_texts(random.Random(4), 200)))


def test_runs_of_long_texts():
    unit = " ".join(f"w{i}" for i in range(1000))
    text = f"start {' '.join([unit] * 5)} end " + "x " * 100_000
    (found,), rest = runs.runs_and_rest(pa.array([text]))
    assert [(r["start"], r["length"], r["period"]) for r in found] == [(1, 5000, 1000), (5002, 100_000, 1)]
    assert rest[0].as_py() == f"start {unit} end x"


@tables
def test_runs_report_equals_brute_force(spark):
    docs = spark.read.parquet(str(DIR / "documents.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {tuple(r) for r in queries.queries()["op12_runs"](spark, str(DIR)).collect()}
    assert got == {brute_report(*r) for r in rows} and len(got) == len(rows)
    assert sum(r[1] > 0 for r in got) >= 15


def test_runs_report_of_hard_rows(spark):
    rows = [(None, None), (None, "a " * 40), *((i, t) for i, t in enumerate([None, "", "one", *random_texts(random.Random(5), 60)])), *((i, f"{i} b c d e f g h i j k l m n o") for i in range(40)), (7, "a a a a a a"), (7, "a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "collapsed", "start", "best")})
    assert sorted(map(str, (tuple(r) for r in runs.runs_report(df).collect()))) == sorted(str(brute_report(*r)) for r in rows)
    assert runs.runs_report(df.limit(0)).collect() == []
    kept = runs.collapse(df.select("best", "text", "runs")).first()
    assert kept.asDict(True) == {"best": 1, "text": None, "runs": [], "collapsed": ""}


# --- languages


def value(score, path, penalty):
    return sum(score[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_best_paths_equal_all_paths():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 3, 5, 6, 7, 1, 4] * 6
    score = -rng.random((sum(sizes), 3)) * rng.choice([0.1, 1, 4], (sum(sizes), 1))
    row = np.repeat(np.arange(len(sizes)), sizes)
    for penalty in (0.0, 0.3, 1.0, 3.0):
        path, at = langid.best_paths(score, row, penalty), 0
        for n in sizes:
            part = score[at : at + n]
            assert value(part, path[at : at + n], penalty) == pytest.approx(max(value(part, p, penalty) for p in product(range(3), repeat=n)))
            at += n


def test_words_are_stretches_of_letters_of_one_script():
    text = "Ça-va? Привет, abcд! 12 été 日本語 कि क्षेत्र"
    words = langid.words_of(pa.array([None, text, ""]))
    found = [text[a : a + e - s] for a, s, e in zip(words.at, words.starts, words.stops)]
    assert found == ["Ça", "va", "Привет", "abc", "д", "été", "日本語", "कि", "क्षेत्र"]
    assert set(words.row.tolist()) == {1}
    assert [langid.SCRIPTS[k] for k in words.script] == ["Latin", "Latin", "Cyrillic", "Latin", "Cyrillic", "Latin", "Han", "Devanagari", "Devanagari"]


EN = "the house of the man with the dog and that which they thought was through there"
DE = "das haus des mannes mit dem hund und das welches sie dachten durch die straße war nicht"
RU = "дом человека с собакой и то что они думали было там через улицу"


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, lang, " ".join(rng.choice(words.split()) for _ in range(40))) for i, (lang, words) in enumerate(product(("en", "de", "ru"), [None] * 20)) for words in [{"en": EN, "de": DE, "ru": RU}[lang]]]
    rows += [(1000 + i, "xx", t) for i, t in enumerate([None, "", "12 34"])]
    return langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_spans_of_mixed_texts(model):
    text = f"{EN}. {DE}! {RU}; 99"
    lang, score, spans = model.label(pa.array([text, EN.upper(), "Здравствуйте", "日本語", "12 !", None, ""]))
    assert model.langs == ("de", "en", "ru")
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in spans[0]] == [("en", EN), ("de", DE), ("ru", RU)]
    assert lang[1:3] == ["en", "ru"] and lang[3] in model.langs and lang[4:] == ["und"] * 3
    assert score[4:] == [0.0] * 3 and score[1] == 1.0 and 0 < score[0] < 0.5
    assert spans[4:] == [[], [], []]


@tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(str(DIR / "documents.parquet"))
    got = queries.queries()["op13_langid"](spark, str(DIR)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in got if r["held_out"]}
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)


def test_held_out_rows_and_ids_teach_nothing(spark):
    rows = [(i, "en", EN) for i in range(40)] + [(i + 100, "de", DE) for i in range(40)]
    taught = [(i, lang if zlib.crc32(str(i).encode()) % 4 != 2 else "zz", t if zlib.crc32(str(i).encode()) % 4 != 2 else "zz zz") for i, lang, t in rows]
    one, two = (langid.train(spark.createDataFrame(r, "doc_id long, lang string, text string")) for r in (rows, taught))
    assert one.langs == two.langs == ("de", "en") and (one.table == two.table).all()


def test_languages_of_hard_tables(spark):
    schema = "doc_id long, lang string, text string"
    none = spark.createDataFrame([(1, None, "abc"), (2, None, None)], schema)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.language_report(none).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.language_report(none.limit(0)).collect() == []
    rows = [(None, "en", EN), (None, None, EN), (3, "en", EN), (3, "en", EN), (4, "de", DE * 3000), (5, "de", DE)]
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("lang_pred", "score", "spans", "n", "same", "bucket", "held_out")})
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in langid.language_report(df).collect())
    assert got == [("3", "en"), ("3", "en"), ("4", "de"), ("5", "de"), ("None", "en"), ("None", "en")]


def test_the_sample_is_bounded_and_takes_copies_once(spark):
    rows = [(i, "en", f"text {i} {EN}") for i in range(3000)] + [(i + 5000, "en", EN) for i in range(3000)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 200, 3)
    assert 20 < sample.count() < 300 and sample.count() == sample.distinct().count()
    assert langid.buckets_for(0) == langid.buckets_for(4) == 1 << 18 and langid.buckets_for(100) * 100 <= langid.TABLE


def test_url_verdicts_equal_sql_on_linked_hosts(spark, tmp_path):
    """Chains and rings of links, with and without a scheme: the SQL's unrolled rounds come as close to the fixed point."""
    duckdb = pytest.importorskip("duckdb")
    names = ["bad.net", "good.org", *(f"c{i}.io" for i in range(12)), "r0.io", "r1.io", "r2.io"]
    links = {i: [i - 1, 0] for i in range(3, 14)} | {2: [0], 14: [15, 1], 15: [16], 16: [14, 13], 1: [14]}
    rows = [(i, f"http://{h}{'/fr/x' if h == 'good.org' else '/p'}", "".join(f'<a href="{"" if j % 2 else "https:"}//{names[j]}/y">y</a>' for j in links.get(i, []))) for i, h in enumerate(names)]
    rows += [(90, None, "x"), (91, "nothing", None), (92, "HTTP://Sub.Example.com/de/1?q#f", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = con.execute(queries.oracle_sql()["op10_urls"])
    columns = [c[0] for c in got.description]
    want = {tuple(r) for r in queries.queries()["op10_urls"](spark, str(tmp_path)).select(*columns).collect()}
    assert set(got.fetchall()) == want and len({r[columns.index("verdict")] for r in want}) == 2


def test_scratch_tables_go_when_cleared(spark):
    from folioflow import scratch

    merkle.merkle_report(spark.createDataFrame([(1, "s", "en", 1, "A")], SCHEMA)).collect()
    made = list(scratch._MADE)
    assert made and scratch.clear(spark) == len(made) and scratch.clear(spark) == 0
    assert not any(Path(p.removeprefix("file://")).exists() for p in made)
