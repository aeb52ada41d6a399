"""Registered queries: each operator over whole driver tables, or over tables that Spark derives from them.

Derived tables are written once as expressions that Spark and DuckDB both understand, so a
query and its SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine_distance, score
from ..operators import chunking, cleaning, joblog, quality, rangefiles, repair, retrieval, review, tables
from ..schemas import Scope
from ..scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LIBRARY = {
    "external_id": "cast(doc_id as string)",
    "course_id": "case when doc_id % 4 < 2 then source else '' end",
    "role": "case doc_id % 4 when 0 then 'published_course' when 1 then 'teacher_material' when 2 then 'official_curriculum' else 'past_paper' end",
    "title": "substr(text, 1, 40)",
    "country": "'sn'",
    "subject": "source",
    "level": "case when doc_id % 3 = 0 then '' else 'lycee' end",
    "track": "''",
    "grade": "'terminale'",
    "curriculum_version": "'2024'",
    "language": "lang",
    "embedding_model": "case when doc_id % 50 = 7 then 'b' else 'a' end",
    "content": "text",
    "characters": "n_chars",
    "indexed_at": "doc_id * 60",
}
NOTEBOOK = LIBRARY | {"student_account_id": "concat('u', cast(doc_id % 37 as string))"}
JOBS = {
    "job_id": "event_id",
    "lane": "case when event_type in ('view', 'click') then 'student' else 'teacher' end",
    "status": "case when event_type = 'error' then 'failed' else 'done' end",
}


def _sql(columns: dict[str, str], table: str, where: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}{f' WHERE {where}' if where else ''}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def register(name: str, sql: str = ""):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def library(spark: SparkSession, d: str) -> DataFrame:
    return _derived(_table(spark, d, "documents"), LIBRARY)


def notebook(spark: SparkSession, d: str) -> DataFrame:
    return _derived(_table(spark, d, "documents"), NOTEBOOK)


LIB = _sql(LIBRARY, "documents")
NOTE = _sql(NOTEBOOK, "documents")
SCOPE = Scope("sn", "src0", "terminale", "2024", "en")
IN_SCOPE = "country = 'sn' AND subject = 'src0' AND grade = 'terminale' AND curriculum_version = '2024' AND language = 'en'"
SHORT = ["external_id", "course_id", "indexed_at"]
INCOMING = LIBRARY | {"course_id": "concat(source, '-new')", "indexed_at": "doc_id * 60 + 1"}
INC = _sql(INCOMING, "documents", "doc_id % 10 = 0")


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """The changed tenth of the documents: the batch that table maintenance puts in."""
    return _derived(_table(spark, d, "documents").filter("doc_id % 10 = 0"), INCOMING)


# --- table maintenance ---------------------------------------------------------------------


@register("w1_upsert_documents", f"WITH c AS ({LIB}), i AS ({INC}) SELECT external_id, course_id, indexed_at FROM c WHERE external_id NOT IN (SELECT external_id FROM i) UNION ALL SELECT external_id, course_id, indexed_at FROM i")
def _(spark, d):
    return tables.upsert_documents(library(spark, d), incoming(spark, d)).select(*SHORT)


BANDED = "substr(external_id, 1, 1) = '1' AND cast(external_id as bigint) % 10 = 0"


@register("w1_upsert_ranges", f"WITH c AS ({LIB}), i AS (SELECT * FROM ({INC}) WHERE {BANDED}) SELECT external_id, course_id, indexed_at, content FROM c WHERE external_id NOT IN (SELECT external_id FROM i) AND NOT substr(external_id, 1, 1) = '3' UNION ALL SELECT external_id, course_id, indexed_at, content FROM i")
def _(spark, d):
    """The library as files by ranges of ids: a batch whose ids lie side by side, then a deletion."""
    lib = library(spark, d)
    stored = rangefiles.RangeTable(spark, shared_folder(spark, "ranges"), lib.schema, rows_per_file=20_000)
    stored.replace(lib)
    stored.upsert(incoming(spark, d).filter(BANDED))
    stored.delete(lib.filter("substr(external_id, 1, 1) = '3'").select("external_id"))
    return stored.current().select(*SHORT, "content")


_OLD_CHUNKS = "(SELECT cast(doc_id as string) AS external_id, cast(i as int) AS ordinal, p[i + 1] AS content FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"


@register(
    "w2_replace_chunks",
    f"SELECT * FROM {_OLD_CHUNKS} WHERE cast(external_id as bigint) % 10 <> 0 UNION ALL SELECT external_id, cast(ordinal + 5 as int), concat('neu ', content) FROM {_OLD_CHUNKS} WHERE cast(external_id as bigint) % 10 = 0 AND ordinal % 2 = 0 UNION ALL SELECT concat('new', external_id), ordinal, content FROM {_OLD_CHUNKS} WHERE cast(external_id as bigint) % 30 = 0",
)
def _(spark, d):
    """Lines as passages; replaced documents keep every second line, marked and with other ordinals, and some documents are new."""
    def chunks(where: str, mark: str = "") -> DataFrame:
        picked = _table(spark, d, "documents").filter(where)
        return picked.select(F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("external_id"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "content"))

    old, new = chunks("true"), chunks("doc_id % 30 = 0", "new")
    made = chunks("doc_id % 10 = 0").filter("ordinal % 2 = 0").select("external_id", (F.col("ordinal") + 5).alias("ordinal"), F.concat(F.lit("neu "), "content").alias("content")).unionByName(new)
    return tables.replace_chunks(old, incoming(spark, d).select("external_id").unionByName(new.select("external_id").distinct()), made)


@register("w3_delete_documents", f"WITH c AS ({LIB}) SELECT external_id, cast(external_id as bigint) % 17 = 0 AS deleted FROM c WHERE cast(external_id as bigint) % 17 = 0 UNION ALL SELECT concat('gone', cast(doc_id as string)), false FROM documents WHERE doc_id % 34 = 0 UNION ALL SELECT concat('kept', external_id), NULL FROM c WHERE cast(external_id as bigint) % 17 <> 0 UNION ALL SELECT concat('chunk', external_id, '-', ordinal, ' ', content), NULL FROM {_OLD_CHUNKS} WHERE cast(external_id as bigint) % 17 <> 0")
def _(spark, d):
    """Answers for what was asked, and the documents and passages (lines) that are left."""
    docs = library(spark, d)
    asked = docs.filter("cast(external_id as bigint) % 17 = 0").select("external_id")
    absent = docs.filter("cast(external_id as bigint) % 34 = 0").select(F.concat(F.lit("gone"), "external_id").alias("external_id"))
    chunks = docs.select("external_id", F.posexplode(F.split("content", "\n", -1)).alias("ordinal", "content"))
    left, lines, flags = tables.delete_documents(docs, chunks, asked.unionByName(absent))
    names = left.select(F.concat(F.lit("kept"), "external_id").alias("external_id")).unionByName(lines.select(F.concat(F.lit("chunk"), "external_id", F.lit("-"), F.col("ordinal").cast("string"), F.lit(" "), "content").alias("external_id")))
    return flags.unionByName(names.withColumn("deleted", F.lit(None).cast("boolean")))


KEYED_DOCS = "SELECT cast(doc_id // 2 as string) AS external_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 10 = 1"
KEYED_CHUNKS = "SELECT cast(doc_id // 3 as string) AS external_id, cast(case when doc_id % 11 = 0 then 4 when doc_id % 13 = 0 then 0 else doc_id % 3 end as int) AS ordinal FROM documents"


@register(
    "w4_check_keys",
    f"WITH d AS ({KEYED_DOCS}), c AS ({KEYED_CHUNKS}), o AS (SELECT external_id, ordinal, count(*) n FROM c GROUP BY ALL) "
    "SELECT 'DUPLICATE_DOCUMENT' AS violation, external_id, count(*) AS n FROM d GROUP BY external_id HAVING count(*) > 1 "
    "UNION ALL SELECT 'DUPLICATE_ORDINAL', external_id, count(*) FROM o WHERE n > 1 GROUP BY external_id "
    "UNION ALL SELECT 'ORDINAL_GAP', external_id, max(ordinal) + 1 - count(*) FROM o GROUP BY external_id HAVING max(ordinal) + 1 <> count(*)",
)
def _(spark, d):
    t = _table(spark, d, "documents")
    docs = t.filter("doc_id % 2 = 0 or doc_id % 10 = 1").selectExpr("cast(doc_id div 2 as string) external_id")
    chunks = t.selectExpr("cast(doc_id div 3 as string) external_id", "cast(case when doc_id % 11 = 0 then 4 when doc_id % 13 = 0 then 0 else doc_id % 3 end as int) ordinal")
    return tables.check_keys(docs, chunks)


@register(
    "w5_validate_roles",
    f"SELECT external_id, CASE WHEN role IN ('published_course', 'teacher_material') AND c = '' THEN 'COURSE_REQUIRED' WHEN role NOT IN ('published_course', 'teacher_material') AND c <> '' THEN 'COURSE_FORBIDDEN' END AS code "
    f"FROM (SELECT external_id, role, CASE WHEN cast(external_id as bigint) % 7 = 0 THEN '' WHEN cast(external_id as bigint) % 7 = 1 THEN subject ELSE course_id END AS c FROM ({LIB}))",
)
def _(spark, d):
    n = F.col("external_id").cast("bigint")
    docs = library(spark, d).withColumn("course_id", F.when(n % 7 == 0, "").when(n % 7 == 1, F.col("subject")).otherwise(F.col("course_id")))
    good, bad = tables.validate_roles(docs)
    return good.select("external_id", F.lit(None).cast("string").alias("code")).unionByName(bad.select("external_id", "code"))


@register(
    "w6_gate_embeddings",
    "WITH c AS (SELECT cast(vec_id // 2 as string) AS external_id, CASE WHEN vec_id % 9 = 0 THEN 32 ELSE len(embedding) END AS n FROM embeddings), "
    "g AS (SELECT external_id, min(n) lo, max(n) hi FROM c GROUP BY external_id) "
    "SELECT d.external_id, cast(hi as int) AS dimension, CASE WHEN lo IS NULL THEN 'NO_PASSAGE' WHEN lo <> hi THEN 'MIXED_DIMENSIONS' END AS code FROM (SELECT DISTINCT cast(doc_id as string) AS external_id FROM documents) d LEFT JOIN g USING (external_id)",
)
def _(spark, d):
    chunks = _table(spark, d, "embeddings").selectExpr("cast(vec_id div 2 as string) external_id", "case when vec_id % 9 = 0 then slice(embedding, 1, 32) else embedding end embedding")
    return tables.gate_embeddings(library(spark, d), chunks)


OWNED = ["external_id", "student_account_id", "indexed_at"]
NINC = _sql(NOTEBOOK | {"indexed_at": "doc_id * 60 + 1"}, "documents", "doc_id % 10 = 0")


_NOTES = f"SELECT 'chunk ' || external_id || '-0' AS external_id, student_account_id, indexed_at FROM ({NOTE})"


@register(
    "w7_upsert_notebook",
    f"WITH c AS ({NOTE}), i AS ({NINC}) SELECT external_id, student_account_id, indexed_at FROM c WHERE external_id NOT IN (SELECT external_id FROM i) UNION ALL SELECT external_id, student_account_id, indexed_at FROM i "
    f"UNION ALL SELECT * FROM ({_NOTES}) WHERE external_id NOT IN (SELECT 'chunk ' || external_id || '-0' FROM i) UNION ALL SELECT 'chunk ' || external_id || '-' || k, student_account_id, indexed_at FROM i, (SELECT unnest([1, 2]) AS k)",
)
def _(spark, d):
    """Documents, and their passages: one each before, two other ones without an owner for those that come in."""
    docs = notebook(spark, d)
    fresh = docs.filter("cast(external_id as bigint) % 10 = 0").withColumn("indexed_at", F.col("indexed_at") + 1)
    old = docs.select("external_id", "student_account_id", F.lit(0).alias("ordinal"), "indexed_at")
    made = fresh.select("external_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), "indexed_at")
    kept, chunks = tables.upsert_notebook(docs, old, fresh, made)
    return kept.select(*OWNED).unionByName(chunks.withColumn("external_id", F.concat(F.lit("chunk "), "external_id", F.lit("-"), F.col("ordinal").cast("string"))).select(*OWNED))


@register(
    "w8_delete_notebook",
    f"SELECT external_id, student_account_id, indexed_at FROM ({NOTE}) WHERE NOT (cast(external_id as bigint) % 17 = 0 AND cast(external_id as bigint) % 2 = 0) "
    f"UNION ALL SELECT * FROM ({_NOTES}) WHERE NOT (cast(regexp_extract(external_id, '[0-9]+') as bigint) % 17 = 0 AND cast(regexp_extract(external_id, '[0-9]+') as bigint) % 2 = 0)",
)
def _(spark, d):
    docs = notebook(spark, d)
    n = F.col("external_id").cast("bigint")
    asked = docs.filter(n % 17 == 0).select("external_id", F.when(n % 2 == 0, F.col("student_account_id")).otherwise("someone else").alias("student_account_id"))
    kept, chunks = tables.delete_notebook(docs, docs.select(*OWNED), asked)
    return kept.select(*OWNED).unionByName(chunks.select(F.concat(F.lit("chunk "), "external_id", F.lit("-0")).alias("external_id"), "student_account_id", "indexed_at"))


@register("a5_audit_index", f"WITH s AS (SELECT language, embedding_model, len(embedding) AS n FROM ({LIB}) JOIN embeddings ON external_id = cast(vec_id as string)), g AS (SELECT language, embedding_model, count(*) AS chunks, min(n) AS min_dimension, max(n) AS max_dimension FROM s GROUP BY ALL) SELECT language, embedding_model, chunks, cast(min_dimension as int) AS min_dimension, cast(max_dimension as int) AS max_dimension, min(min_dimension) OVER (PARTITION BY language) <> max(max_dimension) OVER (PARTITION BY language) AS mixed_dimensions, min(embedding_model) OVER (PARTITION BY language) <> max(embedding_model) OVER (PARTITION BY language) AS several_models FROM g")
def _(spark, d):
    chunks = _table(spark, d, "embeddings").selectExpr("cast(vec_id as string) external_id", "embedding")
    return tables.audit_index(library(spark, d), chunks, ["language"])


# --- listing -------------------------------------------------------------------------------


@register("f1_scope_filter", f"SELECT external_id, role, level FROM ({LIB}) WHERE {IN_SCOPE} AND level = 'lycee'")
def _(spark, d):
    scope = Scope(**(SCOPE.terms() | {"level": "lycee"}))
    return library(spark, d).filter(retrieval.scope_filter(scope)).select("external_id", "role", "level")


@register("f2_list_documents", f"SELECT external_id, title, indexed_at FROM ({LIB}) WHERE {IN_SCOPE} ORDER BY indexed_at DESC, external_id LIMIT 20 OFFSET 5")
def _(spark, d):
    return retrieval.list_documents(library(spark, d), SCOPE, limit=20, offset=5).select("external_id", "title", "indexed_at")


@register("k3_page", f"SELECT external_id, characters FROM ({LIB}) ORDER BY characters DESC, external_id LIMIT 25 OFFSET 50")
def _(spark, d):
    return retrieval.page(library(spark, d).select("external_id", "characters"), [F.desc("characters"), F.col("external_id")], 25, 50)


@register("a1_count_documents", f"SELECT count(*) AS n FROM ({LIB}) WHERE {IN_SCOPE} AND role = 'past_paper'")
def _(spark, d):
    return retrieval.count_documents(library(spark, d), SCOPE, role="past_paper")


@register("f3_list_course_documents", f"SELECT external_id, indexed_at FROM ({LIB}) WHERE course_id = 'src1'")
def _(spark, d):
    return retrieval.list_course_documents(library(spark, d), "src1").select("external_id", "indexed_at")


@register("f4_get_document", f"SELECT * FROM ({LIB}) WHERE external_id = '17'")
def _(spark, d):
    return retrieval.get_document(library(spark, d), "17")


@register("f5_list_notebook", f"SELECT external_id, subject FROM ({NOTE}) WHERE student_account_id = 'u5' AND subject = 'src5'")
def _(spark, d):
    return tables.list_notebook(notebook(spark, d), "u5", "src5").select("external_id", "subject")


# --- search --------------------------------------------------------------------------------

PASSAGES = "SELECT e.vec_id AS chunk_id, e.embedding, e.label, d.lang AS language, d.text AS content, concat('u', cast(d.doc_id % 37 as string)) AS student_account_id, cast(d.doc_id // 3 as string) AS external_id, case e.label % 3 when 0 then 'published_course' when 1 then 'teacher_material' else 'official_curriculum' end AS role FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id"
DIST = "list_cosine_distance(cast(p.embedding as DOUBLE[]), cast(q.embedding as DOUBLE[]))"


def passages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").selectExpr(
        "doc_id chunk_id", "lang language", "text content", "concat('u', cast(doc_id % 37 as string)) student_account_id", "cast(doc_id div 3 as string) external_id"
    )
    role = F.when(F.col("label") % 3 == 0, "published_course").when(F.col("label") % 3 == 1, "teacher_material").otherwise("official_curriculum")
    return _table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id").withColumn("role", role).join(docs, "chunk_id")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every passage whose id is divisible by 20."""
    return passages(spark, d).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "language", "student_account_id")


def _ranked(on: str, part: str = "", where: str = "") -> str:
    return (
        f"p AS ({PASSAGES}), q AS (SELECT chunk_id AS query_id, * FROM p WHERE chunk_id % 20 = 0), "
        f"r AS (SELECT q.query_id, p.chunk_id, p.role, p.content, p.external_id, {DIST} AS distance, row_number() OVER (PARTITION BY q.query_id{part} ORDER BY round({DIST}, 9), p.chunk_id) AS rank FROM p JOIN q ON {on}{where})"
    )


SCORE = "round(greatest(0.0, least(1.0, 1.0 - distance)), 6) + 0.0"


@register("j1_chunk_documents", f"SELECT e.vec_id, d.title FROM embeddings e JOIN (SELECT * FROM ({LIB}) WHERE {IN_SCOPE}) d ON cast(e.vec_id as string) = d.external_id")
def _(spark, d):
    chunks = _table(spark, d, "embeddings").withColumn("external_id", F.col("vec_id").cast("string"))
    return retrieval.passages(chunks, library(spark, d).filter(retrieval.scope_filter(SCOPE)), ["title"]).select("vec_id", "title")


@register(
    "j2_scoped_knn",
    f"WITH {_ranked('p.language = q.language')} SELECT query_id, chunk_id, cast(rank as int) AS rank, {SCORE} AS score, 'OK' AS evidence, CASE WHEN length(content) <= 120 THEN content ELSE concat(regexp_replace(CASE WHEN contains(substr(content, 1, 120), ' ') THEN regexp_replace(substr(content, 1, 120), ' [^ ]*$', '') ELSE substr(content, 1, 120) END, '\\s+$', ''), '…') END AS excerpt "
    "FROM (SELECT query_id, chunk_id, rank, distance, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content FROM r WHERE rank <= 5)",
)
def _(spark, d):
    found = retrieval.hits(retrieval.search(passages(spark, d), asked(spark, d), ["language"], 5), length=120)
    full = retrieval.with_evidence(asked(spark, d).select("query_id"), found.select("query_id", "chunk_id", "rank", "score", "excerpt"))
    return full.select("query_id", "chunk_id", "rank", "score", "evidence", "excerpt")


@register("k2_knn_many", f"WITH {_ranked('true')} SELECT query_id, chunk_id, cast(rank as int) AS rank FROM r WHERE rank <= 3")
def _(spark, d):
    near = retrieval.search(passages(spark, d).drop("language", "student_account_id"), asked(spark, d).drop("language", "student_account_id"), [], 3)
    return near.select("query_id", "chunk_id", "rank")


@register("k1_knn_one", f"WITH p AS ({PASSAGES}), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT chunk_id FROM p, q ORDER BY round({DIST}, 9), chunk_id LIMIT 10")
def _(spark, d):
    vector = _table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]
    return retrieval.search_one(passages(spark, d), list(vector), 10).select("chunk_id")


_PROOF = _ranked("p.language = q.language", ", p.role")


@register("j3_find_proofs", f"WITH {_PROOF}, b AS (SELECT query_id, chunk_id, role, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), chunk_id) n FROM r WHERE rank <= 3 AND chunk_id <> query_id) SELECT query_id AS segment_id, chunk_id, role FROM b WHERE n = 1")
def _(spark, d):
    near = retrieval.search(passages(spark, d), asked(spark, d), ["language"], 3, by=["role"]).filter("chunk_id <> query_id")
    return retrieval.rank_nearest(near.drop("rank"), ["query_id"], 1).select(F.col("query_id").alias("segment_id"), "chunk_id", "role")


_OWN = _ranked("p.student_account_id = q.student_account_id")


@register("j4_search_notebook", f"WITH {_OWN} SELECT query_id, chunk_id, cast(rank as int) AS rank FROM r WHERE rank <= 4")
def _(spark, d):
    return retrieval.search_notebook(passages(spark, d), asked(spark, d).select("query_id", "vector", "student_account_id")).select("query_id", "chunk_id", "rank")


@register("j5_notebook_document", f"WITH {_OWN} SELECT query_id, chunk_id, cast(rank as int) AS rank FROM r WHERE rank <= 4 AND external_id = '20'")
def _(spark, d):
    return retrieval.search_notebook(passages(spark, d), asked(spark, d).select("query_id", "vector", "student_account_id"), document="20").select("query_id", "chunk_id", "rank")


@register("k4_fallback", f"WITH {_PROOF}, m AS (SELECT *, CASE role WHEN 'teacher_material' THEN 1 WHEN 'published_course' THEN 2 ELSE 3 END place FROM r WHERE rank <= 2 AND round(distance, 6) < 0.8), f AS (SELECT query_id, min(place) place FROM m GROUP BY query_id) SELECT m.query_id, chunk_id, role FROM m JOIN f ON m.query_id = f.query_id AND m.place = f.place")
def _(spark, d):
    near = retrieval.search(passages(spark, d), asked(spark, d), ["language"], 2, by=["role"]).filter(F.round("distance", 6) < 0.8)
    return retrieval.fallback_hits(near, ["teacher_material", "published_course", "official_curriculum"]).select("query_id", "chunk_id", "role")


@register("k5_evidence", f"WITH {_OWN}, h AS (SELECT query_id, chunk_id FROM r WHERE rank <= 2 AND {SCORE} >= 0.3 AND chunk_id <> query_id) SELECT q.query_id, h.chunk_id, CASE WHEN h.chunk_id IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'OK' END AS evidence FROM q LEFT JOIN h USING (query_id)")
def _(spark, d):
    queries = asked(spark, d).select("query_id", "vector", "student_account_id")
    found = retrieval.hits(retrieval.search_notebook(passages(spark, d), queries, k=2), min_score=0.3).filter("chunk_id <> query_id").select("query_id", "chunk_id")
    return retrieval.with_evidence(queries.select("query_id"), found)


@register("k6_score", f"WITH p AS ({PASSAGES}), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), r AS (SELECT chunk_id, {DIST} AS distance FROM p, q) SELECT chunk_id, {SCORE} AS score FROM r")
def _(spark, d):
    vector = F.array(*(F.lit(float(x)) for x in _table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]))
    return passages(spark, d).select("chunk_id", score(cosine_distance(F.col("embedding"), vector)).alias("score"))


@register("n5_assemble_context", f"WITH {_PROOF}, h AS (SELECT query_id AS request_id, chunk_id, step, rank FROM (SELECT *, 1 AS step FROM r WHERE rank <= 2 UNION ALL SELECT *, 2 FROM r WHERE rank <= 3)), f AS (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY step, rank) n FROM h), k AS (SELECT * FROM f WHERE n = 1) SELECT request_id, chunk_id, concat('S', cast(row_number() OVER (PARTITION BY request_id ORDER BY step, rank, chunk_id) as string)) AS label FROM k")
def _(spark, d):
    near = retrieval.search(passages(spark, d), asked(spark, d), ["language"], 3, by=["role"]).select(F.col("query_id").alias("request_id"), "chunk_id", "rank")
    steps = near.filter("rank <= 2").withColumn("step", F.lit(1)).unionByName(near.withColumn("step", F.lit(2)))
    return retrieval.assemble_context(steps).select("request_id", "chunk_id", "label")


@register("k7_knn_approximate", f"WITH {_ranked('true')} SELECT query_id, chunk_id, cast(rank as int) AS rank FROM r WHERE rank <= 5")
def _(spark, d):
    """The SQL is that of the exact search: the given vectors have no clusters, so all cells are asked, by one-byte codes, and 20 candidates a place are measured."""
    near = retrieval.search_approx(passages(spark, d), asked(spark, d).select("query_id", "vector"), 5, homes=1, probes=None, keep=10)
    return near.select("query_id", "chunk_id", "rank")
