"""Benchmark decontamination: the CGK embedding, bit-sampling LSH and exact edit distance.

The CGK random walk reads a string and, step by step, puts out the byte it stands on and moves on or not as
a random bit for that step and byte says. Strings at a small edit distance give walks at a small Hamming
distance. Walks begin at every word of a document and at every word of an item, and reach over some fifty
characters: an edit in one part of a passage leaves the windows of the others alone, while walks over a whole
item of many edits would no longer agree anywhere. Each of several tables samples some steps of one of two
independent walks; windows that agree in all samples of a table are candidates, and the whole item is then held
against its place in the document by exact edit distance. There are as many tables as it takes to find edited
copies of the items themselves with the recall that is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, without_ids

#: Steps of a walk, independent walks, most tables, and steps that a table samples.
STEPS, WALKS, TABLES, SAMPLES = 64, 2, 16, 16
#: Share of items with RATIO edits that are to be found, and items and copies of each on which tables are tried.
RECALL, TRIED, COPIES = 0.98, 60, 3
#: Edits allowed, as a share of the item's characters.
RATIO = 0.15
#: Characters of items in one pass over the documents; more items take more passes.
ITEM_CHARS = 4_000_000
_BLOCK = 1 << 15

_rng = np.random.default_rng(20)
_MOVE = _rng.integers(0, 2, (WALKS, STEPS, 256)).astype(np.int64)
#: A table samples from the first two thirds of its walk or from all of it.
_SAMPLED = [np.sort(_rng.choice(STEPS if t // WALKS % 2 else 2 * STEPS // 3, SAMPLES, replace=False)) for t in range(TABLES)]
_FACTOR = _rng.integers(1, 2**63, (TABLES, STEPS), dtype=np.int64).astype(np.uint64) | np.uint64(1)
_USE = [[[t for t in range(w, TABLES, WALKS) if j in _SAMPLED[t]] for j in range(STEPS)] for w in range(WALKS)]


def normal(text: str) -> str:
    """Case folded, runs of white space as one space."""
    return " ".join(text.casefold().split())


def walks(data: np.ndarray, starts: np.ndarray, tables: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A key per table for each start, and where the longest walk ended. data: bytes, padded by STEPS zeros."""
    keys = [np.zeros(len(starts), np.uint64) for _ in range(tables)]
    c, move, wide = np.empty(len(starts), np.uint8), np.empty(len(starts), np.int64), np.empty(len(starts), np.uint64)
    end = starts
    for w in range(min(WALKS, tables)):
        at = starts.copy()
        for j in range(STEPS):
            np.take(data, at, out=c, mode="clip")
            if use := [t for t in _USE[w][j] if t < tables]:
                wide[:] = c
                for t in use:
                    keys[t] += wide * _FACTOR[t, j]
            np.take(_MOVE[w, j], c, out=move, mode="clip")
            at += move
        end = np.maximum(end, at)
    return [k ^ (k >> np.uint64(29)) for k in keys], end


def word_starts(data: np.ndarray) -> np.ndarray:
    """Places after a space or line end and at the beginning, which hold neither."""
    gap = (data == 32) | (data == 10)
    first = ~gap
    first[1:] &= gap[:-1]
    return np.flatnonzero(first)


def masks(item: str) -> dict:
    out: dict = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edit_search(item: str, peq: dict, text: str) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and where in text the first such part ends (bit-parallel)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for k, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, k
    return best, end


@dataclass
class Index:
    """Windows of a bounded set of items by key, a sorted table each."""

    ids: list
    texts: list
    ratio: float = RATIO
    tables: int = 0  # by the recall that is asked for, if 0
    keys: list = field(default_factory=list)
    windows: list = field(default_factory=list)  # item << 32 | bytes from the item's start
    short: list = field(default_factory=list)  # items that no walk fits into

    def __post_init__(self) -> None:
        self.texts = [normal(t) for t in self.texts]
        self.tables = self.tables or tables_for(self.texts, self.ratio)
        found: list = [[] for _ in range(self.tables)]
        where = []
        for i, t in enumerate(self.texts):
            raw = np.frombuffer(t.encode(), np.uint8)
            if not len(raw):
                continue
            starts = word_starts(raw)
            keys, ends = walks(np.concatenate([raw, np.zeros(STEPS, np.uint8)]), starts, self.tables)
            inside = ends <= len(raw)
            if inside.sum() < 4 or len(raw) < 2 * STEPS // 3:
                self.short.append(i)
            where.append((np.int64(i) << 32) | starts[inside])
            for t_, k in zip(found, keys):
                t_.append(k[inside])
        where = np.concatenate(where) if where else np.zeros(0, np.int64)
        for k in found:
            k = np.concatenate(k) if k else np.zeros(0, np.uint64)
            order = np.argsort(k, kind="stable")
            self.keys.append(k[order])
            self.windows.append(where[order])

    def most(self, i: int) -> int:
        return int(self.ratio * len(self.texts[i]))

    def prepare(self) -> None:
        self.peq = [masks(t) for t in self.texts]
        self.quick = []
        for k in self.keys:
            q = np.zeros(1 << 20, bool)
            q[(k >> np.uint64(44)).astype(np.int64)] = True
            self.quick.append(q)

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (item, byte at which the item would begin)."""
        out = []
        for a in range(0, len(starts), _BLOCK):
            some = starts[a : a + _BLOCK]
            for key, quick, keys, windows in zip(walks(data, some, self.tables)[0], self.quick, self.keys, self.windows):
                near = np.flatnonzero(quick[(key >> np.uint64(44)).astype(np.int64)])
                if not len(near):
                    continue
                lo, hi = np.searchsorted(keys, key[near], "left"), np.searchsorted(keys, key[near], "right")
                n = hi - lo
                if n.sum():
                    w = windows[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    out.append(np.stack([w >> 32, np.repeat(some[near], n) - (w & 0xFFFFFFFF)], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def verify(self, i: int, raw: bytes, begin: int) -> tuple[int, int] | None:
        """Distance and character at which the match ends, if the item is near byte `begin` of the document."""
        item, slack = self.texts[i], 4 * self.most(i) + 16
        a = max(0, begin - slack)
        part = raw[a : max(0, begin) + len(item.encode()) + slack].decode("utf-8", "ignore")
        at = part.find(item)
        dist, end = (0, at + len(item)) if at >= 0 else edit_search(item, self.peq[i], part)
        return (dist, len(raw[:a].decode("utf-8", "ignore")) + end) if dist <= self.most(i) else None

    def short_places(self, i: int, raw: bytes):
        """Where a short item may begin: one of most + 1 pieces of it must be there unchanged."""
        item, n = self.texts[i], self.most(i) + 1
        cuts = [len(item) * k // n for k in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            piece, at = item[a:b].encode(), -1
            while piece and (at := raw.find(piece, at + 1)) >= 0:
                yield at - len(item[:a].encode())

    def search(self, texts: list) -> list[tuple[int, int, int, int]]:
        """Rows (text, item, distance, end): the best place of each item in each text that holds it."""
        out = []
        for lo, hi in slices(texts, 1 << 20):
            raws = [normal(t).encode() if t else b"" for t in texts[lo:hi]]
            ends = np.cumsum([len(r) + 1 for r in raws])
            data = np.frombuffer(b"\n".join(raws) + b"\n" + bytes(STEPS), np.uint8)
            found: dict = {}
            rows = self.candidates(data, word_starts(data[:-STEPS])) if len(self.texts) > len(self.short) or self.windows[0].size else np.zeros((0, 2), np.int64)
            owner = np.searchsorted(ends, np.clip(rows[:, 1], 0, ends[-1] - 1), "right")
            seen: dict = {}
            for (i, begin), d in zip(rows.tolist(), owner.tolist()):
                # a start before its text's own belongs to the text of its window, which is the next one
                for d in {d, min(d + 1, len(raws) - 1)}:
                    begin_in = begin - (int(ends[d - 1]) if d else 0)
                    near = seen.setdefault((d, i), [])
                    if begin_in <= len(raws[d]) and all(abs(begin_in - x) > self.most(i) // 2 for x in near) and found.get((d, i), (1, 0))[0]:
                        near.append(begin_in)
                        if (got := self.verify(i, raws[d], begin_in)) and got < found.get((d, i), (1 << 30, 0)):
                            found[d, i] = got
            for i in self.short:
                for d, raw in enumerate(raws):
                    last = None
                    for begin in self.short_places(i, raw):
                        if begin != last and (got := self.verify(i, raw, begin)) and got < found.get((d, i), (1 << 30, 0)):
                            found[d, i] = got
                        last = begin
            out += [(lo + d, i, *got) for (d, i), got in found.items()]
        return out


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """text after so many random insertions, deletions and substitutions."""
    out, letters = list(text), sorted(set(text)) or ["x"]
    for _ in range(edits):
        at, kind, c = int(rng.integers(len(out) + 1)), rng.integers(3), letters[rng.integers(len(letters))]
        out[at : at + (kind > 0)] = [c] if kind < 2 else []
    return "".join(out)


def tables_for(texts: list[str], ratio: float = RATIO, recall: float = RECALL) -> int:
    """The number of tables with which edited copies of (a bounded sample of) the items are candidates often enough."""
    rng = np.random.default_rng(4)
    some = [t for t in texts if len(t) >= STEPS]
    some = [some[i] for i in sorted(rng.permutation(len(some))[:TRIED])]
    if not some:
        return WALKS
    copies = [(i, edited(t, int(ratio * len(t)), rng).encode()) for i, t in enumerate(some) for _ in range(COPIES)]
    found = np.zeros((len(copies), TABLES), bool)
    index = Index(list(range(len(some))), some, ratio, TABLES)
    for k, (i, raw) in enumerate(copies):
        data = np.frombuffer(raw + bytes(STEPS), np.uint8)
        for t, key in enumerate(walks(data, word_starts(data[:-STEPS]), TABLES)[0] if raw else []):
            own = index.keys[t][index.windows[t] >> 32 == i]
            found[k, t] = np.isin(key, own).any()
    got = np.logical_or.accumulate(found, 1).mean(0)
    enough = np.flatnonzero(got >= recall)
    return int(enough[0]) + 1 if len(enough) else TABLES


def contaminated(docs: DataFrame, items: DataFrame, ratio: float = RATIO) -> DataFrame:
    """doc_id, item_id, distance and end_char for each document and item (item_id, text) that it holds.

    Both are compared with case folded and white space as single spaces; a document holds an item if some
    part of it lies within ratio times the item's characters in edit distance. distance is the least found
    and end_char where that part ends in the normal form. Null and empty items and documents match nothing;
    rows that repeat an id are searched each. Items are read in blocks of about ITEM_CHARS characters.
    """
    items = items.where("text IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // ITEM_CHARS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # ITEM_CHARS characters, about
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], ratio))

        def run(b, shared=shared):
            index = shared.value
            if not hasattr(index, "quick"):
                index.prepare()
            ids, got = b.column(0).to_pylist(), index.search(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, *_ in got], pa.int64()), pa.array([index.ids[i] for _, i, *_ in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] for x in got], pa.int64())], names=["doc_id", "item_id", "distance", "end_char"])

        part = map_arrow(docs, run, "doc_id long, item_id long, distance long, end_char long")
        out = part if out is None else out.unionByName(part)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs less those that hold an item."""
    return without_ids(docs, contaminated(docs, items).select("doc_id"))
