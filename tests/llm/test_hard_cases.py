"""Planted hard cases of the operators: words made to collide, large groups of near copies, cut sizes, broken files, rows without ids."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from folioflow.llm import bpe, hashing, jaccard, media, mixing, scratch, secrets, seqfiles, sharding, topk, toxicity, urls  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def mirrored(n):
    """Two words whose polynomial hashes modulo a power of two agree."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [w for n in (1024, 2048, 4096) for w in mirrored(n)]


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = [*PAIRS, *("x" * k for k in range(1, 200)), *("".join(rng.choice("ab") for _ in range(rng.randint(1, 90))) for _ in range(3000)), "\0", "\0\0", "a\0", "a"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    found = defaultdict(set)
    for w, h in zip(words, hashing.word_hashes(raw, starts, ends).tolist()):
        found[h].add(w)
    assert len(found) == len(set(words))
    assert hashing.same_words(raw, starts, ends, raw, starts, ends).all()
    other = starts[::-1]
    assert hashing.same_words(raw, starts, ends, raw, other, ends[::-1]).tolist() == [a == b for a, b in zip(words, words[::-1])]


def test_mirrored_words_in_joins_search_and_tokens(spark):
    from tokenizers import Tokenizer

    table = spark.createDataFrame(list(enumerate(PAIRS)), "doc_id long, text string").coalesce(1)
    assert all(r["component_id"] == r["id"] for r in jaccard.cluster(table).collect())
    found = topk.search(table.selectExpr("doc_id id", "text"), table.selectExpr("doc_id query_id", "text"), 3).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {(i, i) for i in range(len(PAIRS))}
    library = Tokenizer.from_file(PATH)
    for r in bpe.encode(table, PATH).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"], add_special_tokens=False).ids
    for r in seqfiles.sequence_report(spark, table, PATH, partitions=1).collect():
        ids = np.array([*library.encode(PAIRS[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes()) and r["n_tokens"] == len(ids)


def test_tokens_of_words_that_share_a_hash(monkeypatch):
    """Nearly all words of a slice and of the cache share hashes here, and still all ids are the library's."""
    from tokenizers import Tokenizer

    library, real = Tokenizer.from_file(PATH), hashing.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: real(*a) % np.uint64(5))
    coder, rng = bpe.SpeculativeBPE(PATH), random.Random(2)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(40)) + " <|endoftext|> x<|endoftext|>" for _ in range(5)]
        ids, at = coder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def components(sets, num, den):
    """Smallest index reached by links, from all pairs of sets of integers."""
    names = {e: i for i, e in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[e] for e in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    link = den * both >= num * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while True:
        new = np.where(link, label[None, :], len(sets)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("edits", "seed"), [((1, 4), 1), ((3, 9), 2), ((8, 14), 3)])
def test_two_thousand_near_copies_of_one_text(spark, edits, seed):
    """Below, at and above what still links: all pairs share parts, and no link is lost."""
    rng = random.Random(seed)
    base = ["b%d" % i for i in range(150)]
    texts = []
    for _ in range(2000):
        copy = list(base)
        for _ in range(rng.randint(*edits)):
            copy[rng.randrange(150)] = "z%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)})
    want = components(sets, 8, 10)
    got = {r["id"]: r["component_id"] for r in jaccard.cluster(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 8, 10).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_keys_need_only_the_fullest_parts():
    """Sets at the very edge of the threshold, of any sizes, share a key."""
    rng = np.random.default_rng(8)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        tiles = jaccard.Tiles(num, den)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            common = rng.integers(1, 1 << 62, n)
            room = n * (den - num) // num  # so many more elements in the union still link
            left = int(rng.integers(0, room + 1))
            a, b = (np.unique(np.concatenate([common, rng.integers(1, 1 << 62, k)]).astype(np.uint64)) for k in (left, room - left))
            if den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                assert len(np.intersect1d(tiles.keys(a), tiles.keys(b)))


def test_keep_one_decides_by_row(spark):
    word = lambda p: " ".join(p + str(i) for i in range(60))
    base = word("a")
    rows = [(3, base), (9, base), (9, word("c")), (7, word("d")), (7, word("e")), (None, base), (None, word("f")), (None, word("f")), (5, None), (5, None), (4, word("d") + " more"), (8, "x"), (8, "X")]
    table = spark.createDataFrame([(i, t, "s", "m", "r") for i, t in rows], "doc_id long, text string, n string, hi string, _row0 string")
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    x = next(t for i, t in got if i == 8)
    assert got == Counter({(3, base): 1, (9, word("c")): 1, (4, word("d") + " more"): 1, (7, word("e")): 1, (None, word("f")): 1, (5, None): 2, (8, x): 1})
    assert jaccard.keep_one(table.limit(0)).count() == 0


SMALL = topk.Sizes(shard_rows=40, block_rows=8, query_rows=6, pass_rows=2, shards_per_task=2, frequent=0.1)


def corpus(n, seed=5):
    """Texts of three vocabularies with common and rare words, and some equal rows."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        v = "xyz"[i % 3]
        texts.append(" ".join(rng.choice([v + str(min(int(rng.expovariate(0.12)), 60)), v + str(rng.randrange(900))]) for _ in range(rng.choice([5, 30, 80]))))
    return texts + texts[:7] + ["", "w" * 3000, "common " * 5000]


def scores(texts, query):
    counts = [Counter(t.split()) for t in texts]
    mean, df = sum(sum(c.values()) for c in counts) / len(texts), Counter(w for c in counts for w in c)
    out = []
    for c in counts:
        size = sum(c.values())
        out.append(math.fsum(q * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, q in Counter(query.split()).items() if c[w]))
    return out


def test_topk_over_many_shards_blocks_and_tasks(spark):
    texts = corpus(400)
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = [(i, texts[i]) for i in range(0, len(texts), 20)] + [(20, texts[3]), (20, texts[20])]
    got = defaultdict(list)
    for r in topk.search(table, spark.createDataFrame(asked, "query_id long, text string"), 5, SMALL).collect():
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for q in {i for i, _ in asked}:
        want = Counter()
        for i, t in asked:
            if i == q:
                best = sorted(((-round(s, 6), k) for k, s in enumerate(scores(texts, t)) if s > 0))[:5]
                want += Counter((r + 1, k) for r, (_, k) in enumerate(best))
        assert Counter((r, k) for r, k, _ in got[q]) == want, q  # each repeated query row has its own results


def test_topk_skips_blocks():
    texts = corpus(600)
    mean = sum(len(t.split()) for t in texts) / len(texts)
    shards = []
    for at in range(0, len(texts), 200):
        row, term, tf, lengths = topk.counted(pa.array(texts[at : at + 200]))
        shard = topk.make_shard([(np.arange(at, at + len(lengths)), row, term, tf, lengths)])
        shards.append((shard, topk.make_maxima(shard, mean, SMALL)))
    df = Counter(t for s, _ in shards for t, n in zip(s["terms"].tolist(), np.diff(s["starts"]).tolist()) for _ in range(n))
    row, term, tf, _ = topk.counted(pa.array(texts[:30]))
    idf = np.array([math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
    block = {"ids": np.arange(30), "starts": np.searchsorted(row, np.arange(31)), "terms": term, "weights": tf * idf}
    searcher = topk.Searcher(block, 5, mean, SMALL)
    for shard, peaks in shards:
        searcher.add(shard, peaks)
    assert searcher.seen == 30 * sum(-(-len(s["ids"]) // 8) for s, _ in shards)
    assert searcher.skipped > 0.4 * searcher.seen
    for q in range(30):
        want = sorted(((-round(s, 6), k) for k, s in enumerate(scores(texts, texts[q])) if s > 0))[:5]
        assert searcher.found[q][: len(want)].tolist() == [k for _, k in want]


def test_topk_scores_few_rows_exactly_and_copies_in_bounded_lists(monkeypatch):
    """Postings are summed in units rounded up: rows wait for their exact score until all shards are read, copies beyond the limit don't."""
    texts = corpus(600) + ["x1 x2 x3 y5 z7"] * 90 + ["x1 " * 40_000 + "x2"]
    sizes = topk.Sizes(shard_rows=40, block_rows=8, query_rows=30, pass_rows=7, frequent=0.1, candidates=12, postings=50)
    mean = sum(len(t.split()) for t in texts) / len(texts)
    order = random.Random(8).sample(range(len(texts)), len(texts))
    shards = []
    for at in range(0, len(texts), 40):
        some = np.array(order[at : at + 40])
        row, term, tf, lengths = topk.counted(pa.array([texts[i] for i in some]))
        shard = topk.make_shard([(some, row, term, tf, lengths)])
        shards.append((shard, topk.make_maxima(shard, mean, sizes)))
    df = Counter()
    for s, _ in shards:
        df.update(dict(zip(s["terms"].tolist(), np.diff(s["starts"]).tolist())))
    asked = texts[:20] + ["x1 x2 x3 y5 z7", "x1 x2", "y5 " * 700 + "z7"]
    row, term, tf, _ = topk.counted(pa.array(asked))
    idf = np.array([math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) for t in term.tolist()])
    block = {"ids": np.arange(len(asked)), "starts": np.searchsorted(row, np.arange(len(asked) + 1)), "terms": term, "weights": tf * idf}
    searcher = topk.Searcher(block, 5, mean, sizes)
    scored, exact = [], searcher._exact
    monkeypatch.setattr(searcher, "_exact", lambda some, *rest: scored.append(len(some)) or exact(some, *rest))
    for shard, peaks in shards:
        searcher.add(shard, peaks, lambda shard=shard: shard)
        assert np.bincount(searcher.kept["query"]).max() <= 12 + 5
    found = searcher.found
    assert sum(scored) < 25 * len(asked)
    for q, text in enumerate(asked):
        want = sorted((-round(s, 9), k) for k, s in enumerate(scores(texts, text)) if s > 0)[:5]
        assert found[q].tolist() == [k for _, k in want], q
        assert searcher.kept["low"][searcher.kept["query"] == q].tolist() == pytest.approx([-s for s, _ in want], abs=1e-8)


def test_mixing_without_ids_and_without_words(spark):
    rng = random.Random(4)
    rows = [(None, " ".join(rng.choice("abcdefgh") for _ in range(20)) + " %d" % i, "a") for i in range(400)] + [(i, " ".join(["w"] * 20), "b") for i in range(400)]
    rows += [(1000 + i, "", "c") for i in range(20)] + [(2000, "few words", "c"), (3000, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, target = Counter(), {}
    size = {"a": 400 * 21, "b": 400 * 20, "c": 2}
    for r in mixing.mix_report(table).collect():
        s = next((k for k, v in size.items() if r["source_size"] == v), None)
        total[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(total[s] - target[s]) <= 42 for s in "abc")
    copies = Counter((r["doc_id"], r["text"]) for r in mixing.mix_rows(table).collect())
    assert max(copies.values()) <= 3
    assert mixing.mix_rows(table).columns == table.columns and mixing.mix_rows(table.limit(0)).count() == 0


def full(kind, *parts):
    return media.full(kind, *parts)


def track(stsz, stco, stsc, mdhd=None, sync=None):
    head = full(b"mdhd", bytes(8), struct.pack(">IIHH", 1000, 77, 0, 0)) if mdhd is None else mdhd
    tables = [full(b"stsd", struct.pack(">I", 1), media.box(b"abcd", bytes(8))), stsz, stco, stsc]
    tables += [full(b"stss", struct.pack(">I", len(sync)), *(struct.pack(">I", s) for s in sync))] if sync else []
    return media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", media.box(b"stbl", *tables))))


def test_media_tables_of_other_writers():
    """Several tracks, sizes that differ, runs of chunks, wide places and key frames."""
    data = bytes(range(200))
    first = track(full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", 3, 1, 4, 1, 5)), full(b"co64", struct.pack(">I", 3), struct.pack(">3Q", 100, 20, 50)), full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 3, 1, 1)), sync=[1, 4])
    second = track(full(b"stsz", struct.pack(">II", 6, 2)), full(b"stco", struct.pack(">I", 1), struct.pack(">I", 10)), full(b"stsc", struct.pack(">I", 1), struct.pack(">3I", 1, 2, 1)))
    whole = media.box(b"free", data) + media.box(b"moov", first, second)
    a, b = media.tracks(whole)
    assert a["codec"] == "abcd" and (a["timescale"], a["duration"]) == (1000, 77)
    assert list(zip(a["starts"].tolist(), a["ends"].tolist())) == [(100, 103), (103, 104), (20, 24), (24, 25), (50, 55)] and a["sync"].tolist() == [0, 3]
    assert media.read_samples(whole, a) == whole[100:104] + whole[20:25] + whole[50:55]
    assert list(zip(b["starts"].tolist(), b["ends"].tolist())) == [(10, 16), (16, 22)] and b["sync"].tolist() == [0, 1]


def test_media_broken_containers(spark):
    good = media.write_container(bytes(range(192)) * 40)
    moov = media.box(b"moov", track(full(b"stsz"), full(b"stco"), full(b"stsc"), mdhd=media.box(b"mdhd")))
    huge = media.box(b"moov", track(full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), full(b"stco", struct.pack(">I", 0xFFFFFFFF), struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 1), struct.pack(">3I", 1, 0xFFFFFFFF, 1))))
    assert media.tracks(moov)[0]["codec"] == "abcd" and not len(media.tracks(moov)[0]["starts"])
    assert len(media.tracks(huge)[0]["starts"]) <= len(huge)
    rng = random.Random(7)
    cases = [good[:k] for k in range(0, 700)] + [moov, huge, b"", None, b"\0" * 50]
    for _ in range(500):  # bytes changed at random in the boxes before the payload
        cut = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            cut[rng.randrange(800)] = rng.choice([0, 1, 255, rng.randrange(256)])
        cases.append(bytes(cut))
    for data in cases:
        for t in media.tracks(data or b""):
            assert len(media.read_samples(data, t)) == int((t["ends"] - t["starts"]).sum())
    rows = media.probe(spark.createDataFrame([(i, bytearray(c) if c is not None else None, "x") for i, c in enumerate(cases[::50])], "id long, media binary, codec string"), with_payload=True).collect()
    assert len(rows) == len(cases[::50]) and all(isinstance(r["codec"], str) for r in rows)


def test_sequences_over_several_batches_and_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    texts = [" ".join(rng.choice(["stone", "water", "light", "wind"]) for _ in range(rng.choice([0, 3, 900]))) for _ in range(60)] + ["x" * 4000, None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in seqfiles.sequence_report(spark, table, PATH, partitions=3, folder=f"file://{tmp_path}/a", length=4).collect()}
    at, stream = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        stream.append(ids)
    stream = np.concatenate(stream)
    names = sorted({p.name.split(".")[0] for p in (tmp_path / "a").iterdir()})
    assert len(names) == 3 and not [p for p in (tmp_path / "a").iterdir() if "tmp" in p.name]
    before = 0
    for name in names:
        file = seqfiles.SequenceFile(f"file://{tmp_path}/a", name)
        n = sum(int(b.column(1).values.to_numpy(zero_copy_only=False).sum()) for b in file.ids)
        assert len(file.ids) > 1 and file.per == 4 * seqfiles.BATCH
        for start in range(0, n - 700, 611):  # across batches
            assert np.array_equal(file.span(start, 700), stream[before + start : before + start + 700])
        before += n
    assert before == len(stream)


def test_files_that_an_earlier_attempt_has_left(tmp_path):
    fs = pa.fs.LocalFileSystem()
    (tmp_path / "t1").write_text("a")
    seqfiles.put_in_place(fs, f"{tmp_path}/t1", f"{tmp_path}/final")
    (tmp_path / "t2").write_text("a")
    seqfiles.put_in_place(fs, f"{tmp_path}/t2", f"{tmp_path}/final")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["final"]


def test_sharding_of_rows_without_ids(spark):
    rows = [(None, "text %d" % i, "a") for i in range(300)] + [(1, "one %d" % i, None) for i in range(300)] + [(2, "same", "b")] * 10
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 610 and max(counts.values()) - min(counts.values()) <= 1
    for key in (None, 1):  # each source is dealt evenly
        own = Counter(r["shard"] for r in got if r["doc_id"] == key)
        assert max(own.values()) - min(own.values()) <= 2


def test_secrets_of_rows_without_ids_and_of_one_id(spark):
    rows = [(None, "password=abcdefghijkl"), (None, "ghp_" + "a1B2" * 9), (1, "plain"), (1, "token: abcdefghijklm"), (2, ""), (3, None), (4, "-----BEGIN PRIVATE KEY-----")]
    table = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], "doc_id long, text string, secrets string, _kinds0 string")
    got = {(r["doc_id"], r["text"]): [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in secrets.scan(table).collect()}
    assert len(got) == 7
    assert got[(None, rows[0][1])] == [("assign", 0, 21)] and got[(None, rows[1][1])] == [("github", 0, 40)]
    assert got[(1, "plain")] == [] and got[(1, rows[3][1])] == [("assign", 0, 20)] and got[(3, None)] == [] and got[(4, rows[6][1])][0][0] == "pem"


def test_many_secrets_in_one_long_text(spark):
    text = "é ".join("token=abcdefghijkl%d" % i for i in range(2000))
    row = secrets.redact(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"token=[A-Za-z0-9]+", text)]
    assert [(s["start"], s["end"]) for s in row["secrets"]] == want and row["text"] == "é ".join(["[assign]"] * 2000)


def test_contradicting_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "word%d" % (i % 5)) for i in range(60)], "doc_id long, text string")
    labels = [(i, 1, i % 2) for i in range(60)] + [(i, 1, 1 - i % 2) for i in range(30)] + [(i, 1, i % 2) for i in range(40, 60)]
    sample, counts = toxicity.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 100, 1)
    assert sample.count() == sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30, 60))


def test_urls_with_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x", None, "h"), (1, "http://a.io/x", None, "h"), (None, None, "<a href='http://b.io/'>", "h"), (2, "http://b.net/", "", "h")], "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["host"], r["verdict"]) for r in urls.judge(pages).collect())
    assert got == Counter({(1, "a.io", "allow"): 2, (None, "", "allow"): 1, (2, "b.net", "block"): 1})


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        scratch.shared_folder(Session(), "x")


def test_pipeline_on_awkward_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _secrets string, _keep0 string, row string, key string, ids string"
    labels = [(i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, "plain words %d and more of them" % i, "en", "a" if i % 2 else None, 5, "own", "k", "r", "y", "z") for i in range(12)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None, None, None), (50, "", None, "b", None, "own", None, None, None, None), (51, "password=abcdefghijklm", None, "b", 21, "own", None, None, None, None), (52, "long " * 30000, None, "b", None, "own", None, None, None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
                assert all(r["_secrets"] in ("own", None) for r in out.collect())
            if name == "secret_scan" and data:
                assert next(r for r in out.collect() if r["doc_id"] == 51)["text"] == "[assign]"
            if not data:
                assert out.count() == 0
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert all(r["round_trip"] for r in docs.collect())


def test_topk_counts_and_main_terms():
    texts = ["b a b", None, "", "A a é é", "one", " , ", "x y z x"]
    row, term, tf, lengths = topk.counted(pa.array(texts))
    words = [(t or "").lower().replace(",", " ").split() for t in texts]
    name = {w: int(topk.terms(pa.array([w]))[0][0]) for ws in words for w in ws}
    want = Counter((i, name[w]) for i, ws in enumerate(words) for w in ws)
    assert dict(zip(zip(row.tolist(), term.tolist(), strict=True), tf.tolist(), strict=True)) == want
    assert lengths.tolist() == [len(ws) for ws in words] and (np.diff(row) >= 0).all()
    best = [min((-n, t) for (r, t), n in want.items() if r == i)[1] if ws else 0 for i, ws in enumerate(words)]
    assert topk._main_terms(row, term, tf, len(texts)).tolist() == best
    none = topk.counted(pa.array([], pa.string()))
    assert len(none[0]) == 0 and topk._main_terms(*none[:3], 0).tolist() == []
