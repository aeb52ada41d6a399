"""Secret scans over a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived that every match must
satisfy: clauses that must all hold, each a choice of sets of trigrams.  Postings of just
those trigrams are written as an index, each rule's query intersects them, and only
candidate documents are matched with the rule's expression.  Rules without a mandatory
trigram scan all documents.  Built from SQL functions only.

Candidates are few: a bitmap of the hashes of their ids, of fixed size, is broadcast, and
only rows that it lets through are joined with the candidates by id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: More alternatives than this are not told apart in a query.
MOST_STRINGS = 64
#: Bits of the bitmap of candidates: 128 rows of 4 KB.
BITMAP = 1 << 22
#: Items that one step of a running sum copies.
STEP = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A match counts if the characters of ``group`` are ``least`` or more."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed expressions of the base kinds; their lengths are tested after matching.
BASE = (
    Rule("assign", f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token')))}|{either_case('api')}_?{either_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    # runs are matched whole, so the least length may stand in the expression
    Rule("hex", "[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


class _Pattern:
    """The parts of an expression that decide which strings its matches hold.

    Nodes: a set of characters (None: any), ("cat", nodes), ("or", nodes), ("rep", node, least, most).
    Knows characters, escapes, classes, groups, choices, repeats and anchors.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def node(self):
        choices = [self._row()]
        while self._next("|"):
            choices.append(self._row())
        return choices[0] if len(choices) == 1 else ("or", choices)

    def _next(self, sign: str) -> bool:
        hit = self.text.startswith(sign, self.at)
        self.at += len(sign) if hit else 0
        return hit

    def _row(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self._one()
            least, most = self._repeat()
            if part != ("cat", []):
                parts.append(part if (least, most) == (1, 1) else ("rep", part, least, most))
        return ("cat", parts)

    def _repeat(self) -> tuple[int, int | None]:
        for sign, found in (("*", (0, None)), ("+", (1, None)), ("?", (0, 1))):
            if self._next(sign):
                break
        else:
            if not self._next("{"):
                return 1, 1
            inner = self.text[self.at : self.text.index("}", self.at)]
            self.at += len(inner) + 1
            low, comma, high = inner.partition(",")
            found = int(low or 0), (int(high) if high else None) if comma else int(low)
        self._next("?")
        return found

    def _one(self):
        if self._next("("):
            if self._next("?") and not self._next(":"):
                raise ValueError(f"group of an unknown kind: {self.text}")
            inner = self.node()
            self._next(")")
            return inner
        if self._next("["):
            return self._class()
        if self._next("."):
            return None
        if self._next("^") or self._next("$"):
            return ("cat", [])
        return self._char()

    def _char(self) -> frozenset[str] | None:
        sign = self.text[self.at]
        self.at += 1
        if sign != "\\":
            return frozenset(sign.lower())
        kind = self.text[self.at]
        self.at += 1
        if kind == "x":
            self.at += 2
            return frozenset(chr(int(self.text[self.at - 2 : self.at], 16)).lower())
        if kind in "dDsSwW":
            return None
        if kind in "bB":
            return ("cat", [])
        return frozenset({"n": "\n", "r": "\r", "t": "\t"}.get(kind, kind).lower())

    def _class(self) -> frozenset[str] | None:
        negated, signs, first = self._next("^"), set(), True
        while first or self.text[self.at] != "]":
            first = False
            low = self._char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
                if low is None or high is None:
                    return self._rest_of_class()
                low = frozenset(chr(c).lower() for c in range(ord(min(low)), ord(max(high)) + 1))
            if low is None:
                return self._rest_of_class()
            signs |= low
        self.at += 1
        return None if negated else frozenset(signs)

    def _rest_of_class(self) -> None:
        self.at = self.text.index("]", self.at) + 1


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """Clauses, all of which every match satisfies: of each clause's sets of lower-case trigrams it holds one.  Empty if nothing is mandatory."""
    clauses: list[set[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            clause = {s for s in sets if not any(o < s for o in sets)}
            if clause not in clauses:
                clauses.append(clause)

    def exact(node) -> set[str] | None:
        """All strings of a node, or None if they are not few."""
        if node is None or isinstance(node, frozenset):
            return None if node is None or len(node) > MOST_STRINGS else set(node)
        if node[0] == "or":
            sets = [exact(x) for x in node[1]]
            out = None if any(s is None for s in sets) else set().union(*sets)
        elif node[0] == "cat":
            out = {""}
            for x in node[1]:
                step = exact(x)
                if step is None or len(out) * len(step) > MOST_STRINGS:
                    return None
                out = {a + b for a in out for b in step}
        else:
            _, inner, least, most = node
            inner = exact(inner)
            if inner is None or most is None or most > 8 or (len(inner) + 1) ** most > MOST_STRINGS:
                return None
            out, power = set(), {""}
            for k in range(most + 1):
                out |= power if k >= least else set()
                power = {a + b for a in power for b in inner}
        return out if out is not None and len(out) <= MOST_STRINGS else None

    def walk(node) -> None:
        """Close what the strings of a node's parts, one after the other, must spell."""
        now = {""}
        for x in node[1] if isinstance(node, tuple) and node[0] == "cat" else [node]:
            step = exact(x)
            if step is not None and len(now) * len(step) <= MOST_STRINGS:
                now = {a + b for a in now for b in step}
                continue
            close(now)
            now = step if step is not None else {""}
            if step is None and isinstance(x, tuple):
                if x[0] == "cat":
                    walk(x)
                elif x[0] == "rep" and x[2] > 0:
                    walk(x[1])
        close(now)

    walk(_Pattern(pattern).node())
    return clauses


def build_index(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id) of the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for c in trigram_query(r.pattern) for s in c for t in s})
    low = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted)))
    return low.select("id", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, kinds): the rules whose trigram query an id satisfies."""
    asked = [(r.kind, c, i, t, len(s), len(query)) for r in rules for query in [trigram_query(r.pattern)] for c, clause in enumerate(query) for i, s in enumerate(sorted(map(sorted, clause))) for t in s]
    # one row for each trigram of the rules: bounded by the rules, not by the data
    query = F.broadcast(postings.sparkSession.createDataFrame(asked, "kind string, clause int, choice int, trigram string, need int, clauses int"))
    return (
        postings.join(query, "trigram")
        .groupBy("id", "kind", "clause", "choice", "need", "clauses")
        .agg(F.count_distinct("trigram").alias("n"))
        .filter("n = need")
        .groupBy("id", "kind", "clauses")
        .agg(F.count_distinct("clause").alias("n"))
        .filter("n = clauses")
        .groupBy("id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results over an array of integers, from 0: in steps, so that no long array is copied again and again."""

    def within(first: Column, items: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(join(a["at"], x))).alias("out")))

    def step(acc: Column, at: Column) -> Column:
        done = within(acc["at"], F.slice(values, at, STEP))
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    steps = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(steps, start, step)["out"])


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule in code points: the text between matches gives the starts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.transform(found, F.char_length)
    sizes = F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)), lengths, lambda gap, n: F.char_length(gap) + n)
    rows = F.arrays_zip(running(sizes, lambda a, b: a + b).alias("end"), lengths.alias("n"), F.transform(counted, F.char_length).alias("counted"))
    kept = F.filter(rows, lambda r: r["counted"] >= rule.least)
    spans = F.transform(kept, lambda r: F.struct((r["end"] - r["n"]).alias("start"), F.lit(order).alias("rank"), r["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")


def _in_bitmap(docs: DataFrame, id_col: str, hits: DataFrame, mark: str) -> DataFrame:
    """``docs`` plus ``mark``: whether the bitmap of the hashes of candidates' ids holds the row's (false for null)."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    of = hits.select(h("id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias(f"{mark}_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(f"{mark}_m"))
    place = F.bitmap_bit_position(h(id_col)).cast("int")
    byte = F.conv(F.hex(F.substr(F.col(f"{mark}_m"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place % 8).bitwiseAND(1) == 1
    joined = docs.join(F.broadcast(of), F.bitmap_bucket_number(h(id_col)) == F.col(f"{mark}_b"), "left")  # BITMAP bits at most
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(bit & F.col(id_col).isNotNull(), F.lit(False)).alias(mark))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` plus ``secrets``: spans (start, rank, end, kind) in order, end exclusive, in code points.

    Matches of a kind are leftmost and do not overlap; kinds may.  Null and empty texts have
    none.  Rows of equal ids are candidates together and each matched on its own text; rows
    without an id are matched with all rules.  An input column of the output's name is
    replaced; other columns may have any names.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    postings = scratch.save(build_index(docs, indexed, id_col, text_col), "postings")
    hits = scratch.save(candidates(postings, indexed), "hits")
    scratch.drop("postings")
    docs = docs.drop(out)
    taken = {c.lower() for c in docs.columns}
    mark = next(n for n in (f"_kinds{i}" for i in range(len(taken) + 1)) if not any(t.startswith(n) for t in taken))
    text, every = F.col(text_col), F.array(*(F.lit(r.kind) for r in rules))

    def found(df: DataFrame, kinds: Column) -> DataFrame:
        spans = reduce(F.concat, (F.coalesce(F.when(F.array_contains(kinds, r.kind), _spans(text, r, i)), _no_spans()) for i, r in enumerate(rules)))
        return df.select(*docs.columns, F.when(text.isNull(), _no_spans()).otherwise(F.array_sort(spans)).alias(out))

    always = F.array(*(F.lit(r.kind) for r in rules if r not in indexed)).cast("array<string>")
    marked = _in_bitmap(docs, id_col, hits, mark)
    others = marked.filter(~F.col(mark))
    likely = marked.filter(F.col(mark)).join(hits.select(F.col("id").alias(f"{mark}_id"), F.col("kinds").alias(f"{mark}_k")), F.col(id_col) == F.col(f"{mark}_id"), "left")
    by_hits = F.concat(always, F.coalesce(F.col(f"{mark}_k"), F.array().cast("array<string>")))
    return found(others, F.when(F.col(id_col).isNull(), every).otherwise(always)).unionByName(found(likely, by_hits))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """The text with every span replaced by ``[kind]``; of overlapping spans the first names the rest."""
    text, spans = F.col(text_col), F.col(spans_col)
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    rows = F.arrays_zip(spans.alias("s"), F.concat(F.array(F.lit(0)), ends).alias("at"))
    part = lambda r: F.when(r["s"]["start"] >= r["at"], F.concat(F.substr(text, r["at"] + 1, r["s"]["start"] - r["at"]), F.lit("["), r["s"]["kind"], F.lit("]"))).otherwise("")
    done = F.concat(F.array_join(F.transform(F.slice(rows, 1, F.size(spans)), part), ""), F.substr(text, F.element_at(ends, -1) + 1))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, and all spans."""
    names = [r.kind for r in BASE]
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets", F.filter("secrets", lambda s: s["rank"] < len(BASE)).alias("base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, names), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
