"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, langid, media, merkle, mixing, runs, secrets, seqfiles, sharding, topk, toxicity, urls


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(table(spark, sf_dir, "documents"))


def op6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqfiles.sequence_report(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_report(table(spark, sf_dir, "documents"))


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_topk": op2_topk,
        "op3_bpe": op3_bpe,
        "op4_mixing": op4_mixing,
        "op5_media": op5_media,
        "op6_sequences": op6_sequences,
        "op7_sharding": op7_sharding,
        "op8_secrets": op8_secrets,
        "op9_toxicity": op9_toxicity,
        "op10_urls": op10_urls,
        "op11_merkle": op11_merkle,
        "op12_runs": op12_runs,
        "op13_langid": op13_langid,
    }


def urls_sql(rounds: int = 160, damping: float = 0.85) -> str:
    """The query op10_urls in DuckDB: the rounds of both rankings unrolled, so many that what is left is below a thousandth of the query's tolerance."""
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}')"
    rules = sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda value: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'" for h, p, v in rules)
    base = f"{1 - damping} * s.seed"
    steps = ", ".join(
        f"r{i + 1} AS MATERIALIZED (SELECT s.kind, s.host, {base} + {damping} * coalesce(g.got, 0) AS rank FROM seeds s LEFT JOIN (SELECT r.kind, e.dst AS host, sum(r.rank * e.share) AS got FROM r{i} r JOIN shares e ON r.kind = e.kind AND r.host = e.src GROUP BY ALL) g USING (kind, host))"
        for i in range(rounds)
    )
    link = urls.HREF.replace("'", "''")
    return f"""
    WITH cut AS (SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, CASE {fits('rule')} END AS rule, CASE {fits('verdict')} END AS told FROM cut),
    found AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda u: {host("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")}))) AS dst FROM ruled),
    edges AS (SELECT src, dst, count(*) AS n FROM found WHERE dst <> '' AND src <> '' AND dst <> src GROUP BY ALL),
    known AS (SELECT host, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM (SELECT host, 1 AS n, CASE WHEN told = 'allow' THEN 1 ELSE 0 END AS good, CASE WHEN told = 'block' THEN 1 ELSE 0 END AS bad FROM ruled WHERE host <> '' UNION ALL SELECT dst, 0, 0, 0 FROM edges) GROUP BY host),
    seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, CASE WHEN n > 0 THEN good / n ELSE 0.0 END AS seed FROM known UNION ALL SELECT 'distrust', host, CASE WHEN n > 0 THEN bad / n ELSE 0.0 END FROM known),
    both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
    shares AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
    r0 AS MATERIALIZED (SELECT s.kind, s.host, {base} AS rank FROM seeds s), {steps},
    relative AS (SELECT kind, host, CASE WHEN avg(rank) OVER (PARTITION BY kind) > 0 THEN rank / avg(rank) OVER (PARTITION BY kind) ELSE 0.0 END AS v FROM r{rounds}),
    hosts AS (SELECT host, round(max(CASE WHEN kind = 'trust' THEN v END), 9) AS trust, round(max(CASE WHEN kind = 'distrust' THEN v END), 9) AS distrust FROM relative GROUP BY host)
    SELECT page_id, r.host, path, rule, CASE WHEN told IS NOT NULL THEN told WHEN distrust > 1.0 AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict FROM ruled r LEFT JOIN hosts h ON r.host = h.host
    """


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB, byte by byte; needs a table ``crc`` whose list ``steps`` has the 256 remainders."""
    step = "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1)))), {step}), 4294967295)"


CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS steps)"


def merkle_sql(levels: int = 10, levels_over: int = 4) -> str:
    """The query op11_merkle in DuckDB: levels are unrolled, enough for ``8 ** levels`` rows a language and ``8 ** levels_over`` languages.

    Proofs are folded here from the table of all nodes, level by level, not by doubling.
    """
    enc = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(enc, ("doc_id", "source", "lang", "n_chars")), enc(text)]) + ")"
    lower = f"translate(text, '{urls.UPPER}', '{urls.LOWER}')"

    def climb(name: str, nodes: str, levels: int) -> str:
        """Tables name0.. of (tree, idx, n, digest, held, way): one row a leaf; digest of its node, its folded self and siblings so far."""
        out = f"{name}0 AS ({nodes})"
        for k in range(levels):
            out += f""",
    {name}_n{k} AS (SELECT tree, idx, min(digest) AS digest, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k} GROUP BY tree, idx),
    {name}_g{k} AS (SELECT tree, idx // 8 AS up, min(n) AS n, list(digest ORDER BY idx) AS run FROM {name}_n{k} GROUP BY ALL),
    {name}{k + 1} AS (SELECT l.* EXCLUDE (idx, digest, held, way), idx // 8 AS idx,
        CASE WHEN g.n > 1 THEN sha256(list_aggregate(run, 'string_agg', '')) ELSE digest END AS digest,
        CASE WHEN g.n > 1 THEN sha256(coalesce(list_aggregate(run[:idx % 8], 'string_agg', ''), '') || held || coalesce(list_aggregate(run[idx % 8 + 2:], 'string_agg', ''), '')) ELSE held END AS held,
        CASE WHEN g.n > 1 THEN way || coalesce(list_aggregate(run[:idx % 8], 'string_agg', ''), '') || coalesce(list_aggregate(run[idx % 8 + 2:], 'string_agg', ''), '') ELSE way END AS way
        FROM {name}{k} l JOIN {name}_g{k} g ON l.tree = g.tree AND l.idx // 8 = g.up)"""
        return out

    rows = f"""SELECT doc_id, leaf, coalesce('v' || lang, 'n') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS digest,
        CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN tampered ELSE leaf END AS held, '' AS way
        FROM (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf(lower)} AS tampered FROM documents), crc"""
    parts = f"SELECT tree AS part, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, digest, digest AS held, '' AS way FROM (SELECT tree, min(digest) AS digest FROM a{levels} GROUP BY tree)"
    folded = "held"
    for k in range(levels_over):
        folded = f"CASE WHEN g{k}.n > 1 THEN sha256(coalesce(list_aggregate(g{k}.run[:(o.first // {8**k}) % 8], 'string_agg', ''), '') || {folded} || coalesce(list_aggregate(g{k}.run[(o.first // {8**k}) % 8 + 2:], 'string_agg', ''), '')) ELSE {folded} END"
    joins = " ".join(f"JOIN b_g{k} g{k} ON g{k}.up = o.first // {8 ** (k + 1)}" for k in range(levels_over))
    return f"""
    WITH {CRC_SQL}, {climb("a", rows, levels)}, {climb("b", parts, levels_over)},
    o AS (SELECT t.part, z.idx AS first, t.digest AS root, t.way AS over FROM b{levels_over} t JOIN b0 z ON t.part = z.part),
    done AS (SELECT doc_id, leaf, a.digest AS subroot, root, sha256(way || over) AS proof_sha256, {folded} AS folded_root FROM a{levels} a JOIN o ON a.tree = o.part {joins})
    SELECT *, folded_root = root AS verified FROM done
    """


def oracle_sql() -> dict[str, str]:
    return {"op10_urls": urls_sql(), "op11_merkle": merkle_sql()}
