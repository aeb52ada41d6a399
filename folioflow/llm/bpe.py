"""BPE encoding and decoding by speculation, for whole slices of texts at once.

A greedy longest match proposes the tokens of each new word.  A sequence of tokens is the
BPE encoding of its bytes exactly when every adjacent pair, merged on its own, comes back
as that pair; so all adjacent pairs of a slice are checked together against a table of
known pairs, and only words with a failing pair (and unknown pairs) are merged step by
step.  Words are found by 64-bit hashes, and their bytes are compared with those of the
word found; words that only share a hash are encoded on their own.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns, text_bytes
from .hashing import same_words, word_hashes

#: Words that a worker remembers before it forgets the unused; bounds memory, not results.
CACHE_WORDS = 300_000
#: Words of more bytes are merged one by one, in n log n steps.
LONG = 200
#: Classes of characters: neither letter nor digit, letter, number, space, other white space.
OTHER, LETTER, NUMBER, SPACE, BLANK, UNKNOWN = 0, 1, 2, 3, 4, 255
#: White space of the word pattern (fixed value: the Unicode property).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NEVER = np.int64(1 << 62)
ALONE = 0xFFFFFFFF
NO_CHILD = 255


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Words:
    """Where the words of byte-level BPE begin.

    Contractions such as 's; runs of letters, of numbers, of other signs, each with one space
    before it; runs of white space without their last character if a word follows.
    """

    def __init__(self):
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[WHITE] = BLANK
        self.kind[0x20] = SPACE

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                self.kind[p] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(p))[0], OTHER)
            kinds = self.kind[points]
        return kinds

    def starts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Byte positions where words begin; no word crosses an edge."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        first = raw[lead].astype(np.int32)
        points = first.copy()
        for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            some = np.flatnonzero((first >= low) & (first < low + bits + 1))
            value = first[some] & bits
            for k in range(1, more + 1):
                value = value << 6 | raw[np.minimum(lead[some] + k, len(raw) - 1)] & 0x3F
            points[some] = value
        points = np.minimum(points, 0x10FFFF)
        kind = self._kinds(points)
        n = len(kind)
        edge = np.zeros(len(raw) + 1, bool)
        edge[edges] = True
        edge = np.append(edge[lead], True)
        white = kind >= SPACE
        before = np.append(OTHER, kind[:-1])
        white_before = before >= SPACE
        word_next = np.append(~white[1:], False) & ~edge[1:]
        start = edge[:-1] | (white & (~white_before | word_next)) | (~white & np.where(white_before, before != SPACE, kind != before))
        for i in np.flatnonzero((points == 39) & start).tolist():
            tail = "".join(chr(p) for p, e in zip(points[i + 1 : i + 3].tolist(), edge[i + 1 : i + 3].tolist(), strict=True) if not e) if i + 1 < n and not edge[i + 1] else ""
            size = 2 if tail[:2] in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") and tail else 0
            if size:
                start[i + 1] = False
                if i + 1 + size < n and not edge[i + 1 + size]:
                    start[i + 1 + size] |= kind[i + 1 + size] == LETTER
        return lead[start]


class SpeculativeBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        model = spec["model"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(s): i for s, i in model["vocab"].items()}
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens") or []}
        token = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for b, i in [*ids.items(), *self.added.items()]:
            token[i] = b
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.ends = np.cumsum([len(t) for t in token])
        self.sizes = np.diff(self.ends, prepend=0)
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            pairs.append((ids[a] << 32 | ids[b], rank << 32 | ids[a + b]))
        pairs.sort()
        self.pair_codes, self.pair_costs = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.cost_of = dict(pairs)
        self._trie(ids)
        self.words = Words()
        self.known, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)  # pair codes, sorted, and whether each holds
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    def _trie(self, ids: dict[bytes, int]) -> None:
        """Nodes level by level, so that the children of a node are neighbours.

        ``row`` is a node's row of ``rank`` (-1: a leaf); ``rank[row, byte]`` tells which child, ``child`` where they begin.
        """
        prefixes = sorted({b[:k] for b in ids for k in range(1, len(b) + 1)}, key=lambda p: (len(p), p))
        number = {b"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
        self.child = np.full(len(number), -1, np.int32)
        self.row = np.full(len(number), -1, np.int32)
        self.row[0] = 0
        rows = 1
        for p in prefixes:
            parent = number[p[:-1]]
            if self.child[parent] < 0:
                self.child[parent] = number[p]
                if parent:
                    self.row[parent] = rows
                    rows += 1
        self.rank = np.full((rows, 256), NO_CHILD, np.uint8)
        for p in prefixes:
            if len(p) > 1:  # the first level has a node for every byte
                parent = number[p[:-1]]
                self.rank[self.row[parent], p[-1]] = number[p] - self.child[parent]
        self.ends_at = np.array([-1, *(ids.get(p, -1) for p in prefixes)], np.int32)

    def propose(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: (word, token) in order."""
        n = len(raw)
        stop = np.repeat(ends, ends - starts)
        best, size = np.full(n, -1, np.int32), np.zeros(n, np.int64)
        live, node, depth = np.arange(n), 1 + raw.astype(np.int32), 1
        while len(live):
            token = self.ends_at[node]
            hit = token >= 0
            best[live[hit]], size[live[hit]] = token[hit], depth
            row = self.row[node]
            go = (row >= 0) & (live + depth < stop[live])
            live, node, row = live[go], node[go], row[go]
            rank = self.rank[row, raw[live + depth]]
            depth += 1
            ok = rank != NO_CHILD
            live, node = live[ok], self.child[node[ok]] + rank[ok]
        words, tokens = [], []
        word, at = np.arange(len(starts)), starts.copy()
        while len(word):
            words.append(word)
            tokens.append(best[at])
            at = at + size[at]
            go = at < ends[word]
            word, at = word[go], at[go]
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order].astype(np.int64)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_costs[at], NEVER)

    def merge(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words side by side, each by its lowest rank, leftmost of equals: (word, token) in order."""
        done_w, done_t = [], []
        long = ends - starts > LONG
        for w in np.flatnonzero(long).tolist():
            tokens = self._merge_long(self.byte[raw[starts[w] : ends[w]]].tolist())
            done_w.append(np.full(len(tokens), w))
            done_t.append(np.array(tokens, np.int64))
        word = np.flatnonzero(~long)
        sizes = (ends - starts)[word]
        token, word = self.byte[raw[_ranges(starts[word], sizes)]], np.repeat(word, sizes)
        cost = np.full(len(token), NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        cost[inside] = self._costs(token[inside] << 32 | token[inside + 1])
        while len(token):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(cost, first), np.diff(np.append(first, len(word))))
            ended = low == NEVER
            if ended.any():
                done_w.append(word[ended])
                done_t.append(token[ended])
                word, token, cost, low = (x[~ended] for x in (word, token, cost, low))
                if not len(token):
                    break
            at = np.flatnonzero(cost == low)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            token[at] = cost[at] & 0xFFFFFFFF
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # the merged tokens' places once their right halves are gone
            word, token, cost = word[keep], token[keep], cost[keep]
            for i in (moved - 1, moved):
                i = i[(i >= 0) & (i + 1 <= len(word))]
                last = i + 1 >= len(word)
                j = np.where(last, i, i + 1)
                joined = ~last & (word[i] == word[j])
                fresh = np.full(len(i), NEVER)
                fresh[joined] = self._costs(token[i[joined]] << 32 | token[j[joined]])
                cost[i] = fresh
        if not done_w:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(done_w), np.concatenate(done_t)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _merge_long(self, part: list[int]) -> list[int]:
        n, get = len(part), self.cost_of.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r >> 32, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] == a else -1
            if j < 0 or part[j] != b:
                continue
            part[i], part[j] = self.cost_of[a << 32 | b] & 0xFFFFFFFF, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := get(part[i] << 32 | part[k])) is not None:
                    heapq.heappush(heap, (r >> 32, i, part[i], part[k]))
            if (h := left[i]) >= 0 and (r := get(part[h] << 32 | part[i])) is not None:
                heapq.heappush(heap, (r >> 32, h, part[h], part[i]))
        return [t for t in part if t >= 0]

    def check(self, codes: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair (first << 32 | second, or a lone token with ALONE) returns it."""
        unique, inverse = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == unique[seen]
        if len(fresh := unique[~seen]):
            a, b = fresh >> 32, fresh & ALONE
            both = np.stack([a, np.where(b == ALONE, 0, b)], 1)
            sizes = self.sizes[both]
            sizes[b == ALONE, 1] = 0
            raw = self.bytes[_ranges((self.ends - self.sizes)[both].ravel(), sizes.ravel())]
            stops = np.cumsum(sizes.sum(axis=1))
            word, token = self.merge(raw, stops - sizes.sum(axis=1), stops)
            count = np.bincount(word, minlength=len(fresh))
            lead = np.cumsum(count) - count
            good = (count == np.where(b == ALONE, 1, 2)) & (token[lead] == a)
            two = np.flatnonzero(good & (b != ALONE))
            good[two] = token[lead[two] + 1] == b[two]
            order = np.argsort(np.concatenate([self.known, fresh]), kind="stable")
            self.known, self.holds = np.concatenate([self.known, fresh])[order], np.concatenate([self.holds, good])[order]
            at = np.searchsorted(self.known, unique)
        return self.holds[at][inverse]

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, and how many each has: proposed, checked, merged where the check fails."""
        sizes = ends - starts
        raw = raw[_ranges(starts, sizes)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, token = self.propose(raw, starts, ends)
        same = np.append(word[1:] == word[:-1], False)
        lone = np.bincount(word, minlength=len(starts)) == 1
        right = np.where(same, np.append(token[1:], 0), ALONE)
        tested = same | lone[word]
        ok = np.ones(len(word), bool)
        ok[tested] = self.check((token[tested] << 32) | right[tested])
        bad = np.zeros(len(starts), bool)
        bad[word[~ok]] = True
        redo = np.flatnonzero(bad)
        if len(redo):
            again, merged = self.merge(raw, starts[redo], ends[redo])
            keep = ~bad[word]
            word, token = np.concatenate([word[keep], redo[again]]), np.concatenate([token[keep], merged])
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        return token.astype(np.uint32), np.bincount(word, minlength=len(starts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's begin (one more than rows); nulls are empty."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        special, edges = self._special(raw, offsets)
        starts = self.words.starts(raw, edges)
        if len(special):
            inside = np.searchsorted(special[:, 0], starts, side="right") - 1
            starts = starts[(inside < 0) | (starts >= special[inside, 1]) | (starts == special[inside, 0])]
        ends = np.append(starts[1:], len(raw))
        keys, first, which = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        seen = at < len(self.keys)
        seen[seen] = self.keys[at[seen]] == keys[seen]
        fresh = np.flatnonzero(~seen)
        if len(fresh):
            some = first[fresh]
            flat, n = self._learn(raw, starts[some], ends[some], special)
            if len(self.keys) + len(fresh) > CACHE_WORDS:  # keep what this slice uses
                self._keep(at[seen])
            size = ends[some] - starts[some]
            order = np.argsort(np.concatenate([self.keys, keys[fresh]]), kind="stable")
            joined = lambda x, y: np.concatenate([x, y])[order]
            self.keys, self.at, self.begin = joined(self.keys, keys[fresh]), joined(self.at, len(self.flat) + np.cumsum(n) - n), joined(self.begin, len(self.text) + np.cumsum(size) - size)
            self.n, self.size = joined(self.n, n), joined(self.size, size)
            self.flat, self.text = np.concatenate([self.flat, flat]), np.concatenate([self.text, raw[_ranges(starts[some], size)]])
            at = np.searchsorted(self.keys, keys)
        slot = at[which]
        place, sizes, flat = self.at[slot], self.n[slot], self.flat
        odd = np.flatnonzero(~same_words(raw, starts, ends, self.text, self.begin[slot], self.begin[slot] + self.size[slot]))
        if len(odd):  # another word's hash
            more, n = self._learn(raw, starts[odd], ends[odd], special)
            place[odd], sizes[odd], flat = len(flat) + np.cumsum(n) - n, n, np.concatenate([flat, more])
        total = np.append(0, np.cumsum(sizes))
        return flat[_ranges(place, sizes)], total[np.searchsorted(starts, offsets)]

    def _keep(self, slots: np.ndarray) -> None:
        """Forget all words but these."""
        self.flat, self.text = self.flat[_ranges(self.at[slots], self.n[slots])], self.text[_ranges(self.begin[slots], self.size[slots])]
        self.keys, self.n, self.size = self.keys[slots], self.n[slots], self.size[slots]
        self.at, self.begin = np.cumsum(self.n) - self.n, np.cumsum(self.size) - self.size

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``learn``, and for words that are added tokens the one id of each."""
        flat, n = self.learn(raw, starts, ends)
        hit = np.flatnonzero(np.isin(starts, special[:, 0]))
        if not len(hit):
            return flat, n
        lead = np.cumsum(n) - n
        keep = np.ones(len(flat), bool)
        keep[_ranges(lead[hit], n[hit])] = False
        keep[lead[hit]] = True
        flat[lead[hit]] = special[np.searchsorted(special[:, 0], starts[hit]), 2]
        n[hit] = 1
        return flat[keep], n

    def _special(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end, id) of added tokens, leftmost and longest first, none across rows; and all edges."""
        data, found = raw.tobytes(), []
        for text, token in sorted(self.added.items(), key=lambda x: -len(x[0])):
            at = data.find(text)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(text) <= offsets[row + 1] and all(at >= e or at + len(text) <= s for s, e, _ in found):
                    found.append((at, at + len(text), token))
                at = data.find(text, at + 1)
        special = np.array(sorted(found), np.int64).reshape(-1, 3)
        edges = np.concatenate([offsets, special[:, 0], special[:, 1]])
        return special, edges[edges <= len(raw)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids; bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        fit = np.minimum(ids, len(self.sizes) - 1).astype(np.int64)
        sizes = np.where(ids < len(self.sizes), self.sizes[fit], 0)
        data = self.bytes[_ranges((self.ends - self.sizes)[fit], sizes)].tobytes()
        places = np.append(0, np.cumsum(sizes))[offsets]
        try:
            data.decode()
            whole = all(p == len(data) or data[p] & 0xC0 != 0x80 for p in places.tolist())
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.Array.from_buffers(pa.string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(data)])
        cuts = places.tolist()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], pa.string())  # noqa: B905


@functools.lru_cache(maxsize=4)
def load(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


def binary_rows(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = False, decoded_col: str | None = None) -> DataFrame:
    """Add ``ids_col`` (BINARY: little-endian unsigned 32-bit ids) and ``n_tokens``.

    Null and empty texts give no ids.  Strings of added tokens in a text are those tokens.
    With ``decoded_col`` the ids are also decoded again, in the same worker.  An input column
    with the name of an output column is replaced.  No shuffle.  A text is coded whole, however
    long; repeated rows stay and get equal ids; an empty table stays empty.
    """

    def make(batch: pa.RecordBatch) -> list:
        coder = load(path)
        ids, offsets = coder.encode(batch.column(text_col))
        out = [binary_rows(ids, offsets), pa.array(np.diff(offsets))]
        return [*out, coder.decode(ids, offsets)] if decoded_col else out

    fields = [T.StructField(ids_col, T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False)]
    fields += [T.StructField(decoded_col, T.StringType(), False)] if decoded_col else []
    return append_columns(df, make, fields, text_col, (text_col,) if drop_text else ())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``, the text of the ids; null ids give an empty text."""

    def make(batch: pa.RecordBatch) -> list:
        column = batch.column(ids_col)
        raw, offsets = text_bytes(column)
        return [load(path).decode(np.frombuffer(raw.tobytes(), "<u4"), offsets // 4)]

    return append_columns(df, make, [T.StructField(text_col, T.StringType(), False)], ids_col)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and digests of the ids and of the text decoded from them.

    Null texts count as empty; long texts are coded whole; repeated rows stay; other columns are
    not read; an empty table gives no rows.
    """
    coded = encode(df.select("doc_id", "text"), path, drop_text=True, decoded_col="decoded")
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
