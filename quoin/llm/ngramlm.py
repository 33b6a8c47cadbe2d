"""A trigram language model in Elias-Fano tries, counted and queried in pieces.

Documents are cut into blocks of about two million tokens; a block has its own sorted vocabulary of word hashes
and is written once to the shared folder. An n-gram (w1, w2, w3) belongs to the piece of its nearer context word
w2, a range of hashes. A block sends each piece one row: the distinct trigrams of its documents about these
words, with counts from training documents. A piece sums the counts, builds its trie and answers the rows it
got; a block scores its documents from the answers. Words that make up a large share of all tokens are spread:
their trigrams by w1, and their bigrams, in addition, by w3. So nothing that grows with the vocabulary is
collected or broadcast, no hot word lands in one task, and every row stands for hundreds of tokens: blocks and
pieces grow with the square root of the data beyond some tens of GB, so that rows grow with the data.

The trie of a piece holds contexts from the nearest word outwards:

    contexts      w2: sorted hashes
    successors    (w2, w3): identifiers of w3, sorted within w2
    children      (w2, w1): identifiers of w1, sorted within w2
    grams         (w2, w1, w3): the place of w3 among the successors of w2, sorted within (w2, w1)

and monotone pointers from each context to its successors, its children and their grams. All sequences are
made monotone by a base a context, coded by Elias-Fano and memory-mapped; a lookup is a successor search within
the range of its context. successors and grams hold a smoothed probability, contexts and children the weight
that is left to the shorter context, each as 8 bits of its logarithm.

Probabilities are smoothed towards the shorter context:

    p(w3 | w1 w2) = (c(w1 w2 w3) + K3 * p(w3 | w2)) / (c(w1 w2) + K3)
    p(w3 | w2)    = (c(w2 w3) + K2 * p(w3)) / (c(w2) + K2)
    p(w3)         = (c(w3) + 1) / (N + V + 1)
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_mod, stored_by, table
from .words import word_hashes

#: Tokens of a block, and tokens whose trigrams a piece holds, at least.
BLOCK_TOKENS, PIECE_TOKENS = 1_500_000, 1_000_000
#: Pieces at least, and tokens that a row from a block to a piece stands for at least.
PIECES, ROW_TOKENS = 160, 256
#: Strength of the shorter context.
K3, K2 = 2.0, 1000.0
#: Share of all tokens from which a word's count is known everywhere; at most its inverse are.
COMMON = 2.0**-20
#: Common words with short identifiers.
SHORT = 0xFFFF
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_ID = np.uint64(33)  # bits of an identifier within a context: a short one, or 32 bits of the hash
_ONE = np.uint64(1)
#: Quantised log10: code 1 is LOW, code 255 is 0, with finer steps towards 0; code 0 is absence.
LOW = -9.0


def quantise(p: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.clip(np.log10(np.maximum(p, 1e-300)) / LOW, 0, 1))
    return np.rint(255 - 254 * root).astype(np.uint8)


def dequantised() -> np.ndarray:
    return np.concatenate([[0.0], 10 ** (LOW * ((254 - np.arange(255)) / 254) ** 2)])


class Select:
    """Places of the i-th 1 (or 0) in a bit vector of 64-bit words, by ranks of groups of eight words."""

    def __init__(self, words: np.ndarray, ones: bool):
        self.words, self.ones = words, ones
        bits = np.bitwise_count(words).astype(np.int64)
        per = (bits if ones else 64 - bits).reshape(-1, 8).sum(1)
        self.rank = np.concatenate([[0], np.cumsum(per)])

    def __call__(self, i: np.ndarray) -> np.ndarray:
        group = np.searchsorted(self.rank, i, "right") - 1
        left, word = i - self.rank[group], group * 8
        current = np.zeros(len(i), np.uint64)
        open_ = np.ones(len(i), bool)
        for k in range(8):
            w = self.words[group * 8 + k]
            w = w if self.ones else ~w
            n = np.bitwise_count(w).astype(np.int64)
            here = open_ & (left < n)
            current[here], word[here] = w[here], group[here] * 8 + k
            open_ &= ~here
            left = np.where(open_, left - n, left)
        at = np.zeros(len(i), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            low = (current >> at) & ((_ONE << np.uint64(step)) - _ONE)
            n = np.bitwise_count(low).astype(np.int64)
            over = left >= n
            left = np.where(over, left - n, left)
            at = np.where(over, at + np.uint64(step), at)
        return word * 64 + at.astype(np.int64)


class EliasFano:
    """A monotone sequence of 64-bit integers: low bits packed, high bits in unary; arrays may be memory maps."""

    def __init__(self, high: np.ndarray, low: np.ndarray, n: int, bits: int):
        self.high, self.low, self.n, self.bits = high, low, n, np.uint64(bits)
        self.one, self.zero = Select(high, True), Select(high, False)

    @staticmethod
    def code(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = np.zeros(max(8, -(-(n + (top >> bits) + 2) // 512) * 8) * 8, np.uint8)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        low = np.zeros(-(-n * bits // 64) + 1, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            word, shift = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            cut = np.flatnonzero((place & 63) + bits > 64)
            np.bitwise_or.at(low, word[cut] + 1, part[cut] >> (np.uint64(64) - shift[cut]))
        return high.view(np.uint64), low, n, bits

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i * int(self.bits)
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        out = self.low[word] >> shift
        cut = shift + self.bits > np.uint64(64)
        out[cut] |= self.low[word[cut] + 1] << (np.uint64(64) - shift[cut])
        return out & np.uint64((1 << int(self.bits)) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.one(i) - i).astype(np.uint64) << self.bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1: a successor search that starts at the bucket of its high bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        bucket = (x >> self.bits).astype(np.int64)
        live = np.flatnonzero(bucket < self.zero.rank[-1])
        bucket = bucket[live]
        before = np.where(bucket > 0, self.zero(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        after = self.zero(bucket) - bucket
        want = x[live] & np.uint64((1 << int(self.bits)) - 1)
        while len(live):  # halve the ranges; most hold one entry or none
            some = before < after
            live, before, after, want = live[some], before[some], after[some], want[some]
            mid = (before + after) >> 1
            got = self._low(mid)
            hit = got == want
            out[live[hit]] = mid[hit]
            less = got < want
            before, after = np.where(less, mid + 1, before), np.where(less, after, mid)
            live, before, after, want = live[~hit], before[~hit], after[~hit], want[~hit]
        return out


class Trie:
    """The trie of a piece. contexts: sorted hashes; successors: rank of the context << 33 | identifier; children
    likewise; grams: for each its child and the place of its last word among all successors; and codes."""

    def __init__(self, contexts, successors, children, gram_child, gram_successor, codes: dict):
        rank = np.arange(len(contexts) + 1, dtype=np.uint64) << _ID
        after, born = np.searchsorted(successors, rank), np.searchsorted(children, rank)  # where those of each context begin
        wide = np.diff(after)
        base = np.concatenate([[0], np.cumsum(np.diff(born) * wide)])
        owner = (children >> _ID).astype(np.int64)
        c = owner[gram_child]
        grams = base[c] + (gram_child - born[c]) * wide[c] + gram_successor - after[c]
        parts = {"contexts": contexts, "successors": successors, "children": children, "grams": grams.astype(np.uint64), "after": after.astype(np.uint64), "born": born.astype(np.uint64), "base": base.astype(np.uint64)}
        self.file = tempfile.NamedTemporaryFile()  # the task's own; gone when closed
        coded = {name: EliasFano.code(x) for name, x in parts.items()}
        for high, low, *_ in coded.values():
            self.file.write(high.tobytes() + low.tobytes())
        for x in codes.values():
            self.file.write(x.tobytes())
        self.file.flush()
        at, self.levels, self.codes = 0, {}, {}
        for name, (high, low, n, bits) in coded.items():
            maps = []
            for a in (high, low):
                maps.append(np.memmap(self.file.name, np.uint64, "r", at, len(a)))
                at += a.nbytes
            self.levels[name] = EliasFano(*maps, n, bits)
        for name, x in codes.items():
            self.codes[name] = np.memmap(self.file.name, np.uint8, "r", at, len(x)) if len(x) else x
            at += len(x)

    def code(self, name: str, at: np.ndarray) -> np.ndarray:
        """Codes at places; 0 for place -1."""
        out, known = np.zeros(len(at), np.uint8), np.flatnonzero(at >= 0)
        out[known] = self.codes[name][at[known]]
        return out

    def find(self, name: str, rank: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of identifiers in the ranges of their contexts, -1 where the context or the identifier is unknown."""
        out, known = np.full(len(ids), -1, np.int64), np.flatnonzero(rank >= 0)
        out[known] = self.levels[name].find((rank[known].astype(np.uint64) << _ID) | ids[known])
        return out

    def gram(self, rank: np.ndarray, child: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Places of the grams of children and successors, given by their places, of contexts."""
        out, known = np.full(len(rank), -1, np.int64), np.flatnonzero((child >= 0) & (successor >= 0))
        r, where = np.unique(rank[known], return_inverse=True)
        after, born, base = (self.levels[n][r].astype(np.int64) for n in ("after", "born", "base"))
        wide = self.levels["after"][r + 1].astype(np.int64) - after
        place = base[where] + (child[known] - born[where]) * wide[where] + successor[known] - after[where]
        out[known] = self.levels["grams"].find(place.astype(np.uint64))
        return out

    def close(self) -> None:
        self.levels, self.codes = {}, {}
        self.file.close()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, each number's bytes apart from one another."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    sizes = np.array([len(raw), *(len(a) for a in arrays)], "<i8").tobytes()
    return sizes + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    total, *sizes = np.frombuffer(data, "<i8", len(kinds) + 1).tolist()
    raw = np.frombuffer(pa.decompress(data[8 * len(kinds) + 8 :], total, codec="zstd", asbytes=True) if total else b"", np.uint8)
    out, at = [], 0
    for n, kind in zip(sizes, kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


def _pack_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a count, and the counts that do not fit."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.int64)


def _counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def size_for(tokens: float, least: int) -> int:
    """Tokens of a block or piece: the base size, or more where rows between them would become small."""
    return max(least, math.isqrt(int(ROW_TOKENS * tokens)))


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs (doc_id, text, train): ids, tokens a document, the sorted vocabulary with its counts in
    training documents, and tokens as places in it (a start before and an end after each document)."""
    names = ["block", "n", "seen", "started", "ids", "known", "lengths", "train", "vocab", "counts", "tokens"]
    # By the optimizer's estimate of the input's size; some four bytes a token.
    about = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 4
    if about > 1e17:  # not known without reading it
        about = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) / 6
    most = size_for(about, BLOCK_TOKENS)

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, train, lengths, words, size = [], [], [], [], 0

        def block():
            nonlocal ids, train, lengths, words, size, made
            n, t = np.concatenate(lengths), np.concatenate(train)
            flat = np.concatenate(words)
            ends = np.cumsum(n)
            first = np.concatenate([[0], ends[:-1]])
            shift = np.arange(len(n))
            out = np.empty(len(flat) + 2 * len(n), np.uint64)
            place = np.arange(len(flat)) + 2 * np.repeat(shift, n) + 1
            out[place], out[first + 2 * shift], out[ends + 2 * shift + 1] = flat, START, END
            vocab, tokens = np.unique(out, return_inverse=True)
            counts = np.bincount(tokens[np.repeat(t, n + 2)], minlength=len(vocab))
            every = pa.concat_arrays(ids)
            bits = every.is_valid().to_numpy(False)
            row = [pa.array([(part << 32) + made]), pa.array([len(out)]), pa.array([int(n[t].sum() + t.sum())]), pa.array([int(t.sum())]),
                   *(pa.array([x], pa.binary()) for x in (every.fill_null(0).to_numpy(False).tobytes(), bits.tobytes(), n.astype("<i4").tobytes(), t.tobytes(), vocab.tobytes(), pack(*_pack_counts(counts)), pack(tokens.astype("<u4"))))]
            ids, train, lengths, words, size, made = [], [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in batches:
            for lo, hi, hashes, at in word_hashes(b.column(1), 4 << 20):
                ids.append(b.column(0).slice(lo, hi - lo))
                train.append(b.column(2).slice(lo, hi - lo).to_numpy(False).astype(bool))
                lengths.append(np.diff(at))
                words.append(hashes)
                size += len(hashes)
                if size >= most:
                    yield block()
        if ids:
            yield block()

    kinds = "block long, n long, seen long, started long, ids binary, known binary, lengths binary, train binary, vocab binary, counts binary, tokens binary"
    return stored_by(docs.mapInArrow(run, kinds), "lm-blocks", "block", max(16, min(1 << 16, int(about / most))))


def _per_block(frame: DataFrame, f, columns: list[str], schema: str) -> DataFrame:
    """f on each block's columns, as bytes; it gives record batches."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from f(*(b.column(k)[i].as_py() for k in range(b.num_columns)))

    return frame.select(*columns).mapInArrow(run, schema)


def piece_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two hashes, spread over all pieces."""
    x = (a + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _common_words(blocks: DataFrame, pieces: int, least: float) -> tuple[dict, int]:
    """Training counts of words that occur at least `least` times (1 / COMMON words at most), and the number of words."""

    def emit(vocab, counts):
        h, n = np.frombuffer(vocab, np.uint64), _counts(*unpack(counts, "u1", "i8"))
        h, n = h[n > 0], n[n > 0]
        piece = piece_of(h, pieces)  # rises with h
        cuts = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(h)]):
            yield pa.RecordBatch.from_arrays([pa.array([piece[a]]), pa.array([pack(h[a:b], *_pack_counts(n[a:b]))], pa.binary())], names=["piece", "words"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, "u8", "u1", "i8") for x in pdf["words"]]
        h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([_counts(*p[1:]) for p in parts]), minlength=len(h)).astype(np.int64)
        top = n >= least
        return pd.DataFrame({"h": [*h[top].view(np.int64), 0], "n": [*n[top], int((h != START).sum())], "types": [False] * int(top.sum()) + [True]})

    rows = _per_block(blocks, emit, ["vocab", "counts"], "piece long, words binary").groupBy("piece").applyInPandas(total, "h long, n long, types boolean").collect()
    return {r["h"] & (2**64 - 1): r["n"] for r in rows if not r["types"]}, sum(r["n"] for r in rows if r["types"])


class Common:
    """The common words: their counts; which are hot, so that they are spread; and short identifiers."""

    def __init__(self, counts: dict, hot_from: float):
        self.hashes = np.array(sorted(counts), np.uint64)
        self.counts = np.array([counts[int(h)] for h in self.hashes], np.int64)
        self.hot = (self.counts >= hot_from) | (self.hashes == START)
        order = np.lexsort((self.hashes, -self.counts))[:SHORT]
        self.short = np.full(len(self.hashes), SHORT, np.uint16)
        self.short[order] = np.arange(len(order))

    def place(self, words: np.ndarray) -> np.ndarray:
        """Places of hashes among the common words, or -1."""
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, at, -1) if len(self.hashes) else np.full(len(words), -1)

    def are_hot(self, words: np.ndarray) -> np.ndarray:
        at = self.place(words)
        return (at >= 0) & self.hot[at] if len(self.hashes) else np.zeros(len(words), bool)

    def shorts(self, words: np.ndarray) -> np.ndarray:
        at = self.place(words)
        return np.where(at >= 0, self.short[at], np.uint16(SHORT)).astype(np.uint16) if len(self.hashes) else np.full(len(words), SHORT, np.uint16)


class Grams:
    """The distinct trigrams of a block, and the distinct bigrams of its hot words, each in the order of pieces."""

    def __init__(self, vocab, tokens, lengths, common: Common, pieces: int):
        n = lengths.astype(np.int64) + 2
        ends = np.cumsum(n)
        event = np.ones(len(tokens), bool)
        event[ends - n] = False  # nothing predicts a start
        at = np.flatnonzero(event)
        t = tokens.astype(np.int64)
        before = at - 2
        before[(ends - n + 1)[: len(n)] - np.arange(len(n)) - 1] += 1  # the first word's context is start, start
        bits = max(1, int(len(vocab) - 1).bit_length())
        if 3 * bits <= 64:
            key = (t[at - 1].astype(np.uint64) << np.uint64(2 * bits)) | (t[before].astype(np.uint64) << np.uint64(bits)) | t[at].astype(np.uint64)
            key, self.where = np.unique(key, return_inverse=True)
            mask = np.uint64((1 << bits) - 1)
            self.w2, self.w1, self.w3 = ((key >> np.uint64(s) & mask).astype(np.int64) for s in (2 * bits, bits, 0))
        else:  # a text of very many different words
            pair, of = np.unique(t[at - 1] * len(vocab) + t[before], return_inverse=True)
            own, last = np.unique(t[at], return_inverse=True)
            key, self.where = np.unique(of * len(own) + last, return_inverse=True)
            pair, self.w3 = pair[key // len(own)], own[key % len(own)]
            self.w2, self.w1 = pair // len(vocab), pair % len(vocab)
        self.at, self.bits = at, bits
        hot = common.are_hot(vocab)[self.w2]
        piece = np.where(hot, piece_of(_mixed(vocab[self.w2], vocab[self.w1], 1), pieces), piece_of(vocab[self.w2], pieces))
        self.order = np.argsort(piece, kind="stable")  # within a piece by w2, w1, w3
        self.piece, self.hot = piece[self.order], hot
        both, self.pair_of_hot = np.unique(self.w2[hot] * len(vocab) + self.w3[hot], return_inverse=True)
        self.b2, self.b3 = both // len(vocab), both % len(vocab)
        piece = piece_of(_mixed(vocab[self.b2], vocab[self.b3], 2), pieces)
        self.pair_order = np.argsort(piece, kind="stable")
        self.pair_piece = piece[self.pair_order]

    def cuts(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the trigrams and the pairs of each piece begin, and the end."""
        return np.searchsorted(self.piece, pieces), np.searchsorted(self.pair_piece, pieces)


def _contexts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places of runs of equal words, and how long the runs are."""
    first = np.flatnonzero(np.diff(words, prepend=-1))
    return first, np.diff(np.append(first, len(words)))


def _identifiers(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    out = short.astype(np.uint64)
    out[short == SHORT] = long.astype(np.uint64) | (_ONE << np.uint64(32))
    return out


_ASKED = ("u8", "i4", "u2", "u4", "u2", "u4", "u1", "i8", "u8", "i4", "u2", "u4", "u1", "i8")


def answers_of(asked: list[list[np.ndarray]], common: Common, k3: float = K3, k2: float = K2) -> list[tuple]:
    """Builds a piece's trie from the counts in all rows, and answers each: for trigrams the part of their
    probability that comes from here and the weight left to the rest, the counts of contexts, and for pairs the same two."""
    where = lambda k: np.cumsum([0, *(len(r[k]) for r in asked)])
    cat = lambda k: np.concatenate([r[k] for r in asked])
    ids = lambda s, l: np.concatenate([_identifiers(r[s], r[l]) for r in asked])
    count = lambda s, l: np.concatenate([_counts(r[s], r[l]) for r in asked])
    # A hot word's pairs are a context of their own, beside its trigrams.
    tag = np.uint64(0x5555555555555555)
    own, place = np.unique(np.concatenate([cat(0), cat(8) ^ tag]), return_inverse=True)
    n_contexts = len(cat(0))
    rank = np.repeat(place[:n_contexts], cat(1)).astype(np.uint64)
    w1, w3, n = ids(2, 3), ids(4, 5), count(6, 7)
    pair_rank, b3, bn = np.repeat(place[n_contexts:], cat(9)).astype(np.uint64), ids(10, 11), count(12, 13)
    before, of12 = np.unique((rank << _ID) | w1, return_inverse=True)
    last, of3 = np.unique(w3, return_inverse=True)
    gram, of = np.unique(of12 * max(1, len(last)) + of3, return_inverse=True)
    g12, gw3 = gram // max(1, len(last)), last[gram % max(1, len(last))] if len(last) else w3
    g_rank = before[g12] & ~((_ONE << _ID) - _ONE)
    after, of13 = np.unique(np.concatenate([g_rank | gw3, (pair_rank << _ID) | b3]), return_inverse=True)
    g13, p13 = of13[: len(gram)], of13[len(gram) :]
    c3 = np.bincount(of, weights=n, minlength=len(gram))
    c12 = np.bincount(g12, weights=c3, minlength=len(before))
    c13 = np.bincount(g13, weights=c3, minlength=len(after)) + np.bincount(p13, weights=bn, minlength=len(after))
    of_after = (after >> _ID).astype(np.int64)
    c2 = np.bincount(of_after, weights=c13, minlength=len(own))
    hot = common.are_hot(own)  # pairs of these words are elsewhere
    at = common.place(own ^ tag)
    paired = np.zeros(len(own), bool)
    paired[place[n_contexts:]] = True
    total = np.where(paired, common.counts[at] if len(common.counts) else 0, c2)
    seen = total > 0
    new = np.cumsum(seen) - 1  # ranks of contexts in the trie
    renamed = lambda x: (new[(x >> _ID).astype(np.int64)].astype(np.uint64) << _ID) | (x & ((_ONE << _ID) - _ONE))
    k12, k13, some = c12 > 0, c13 > 0, c3 > 0
    to12, to13 = np.cumsum(k12) - 1, np.cumsum(k13) - 1
    codes = {
        "left": quantise(k2 / (total[seen] + k2)), "next": quantise(c13[k13] / (total[of_after[k13]] + k2)),
        "child_left": quantise(k3 / (c12[k12] + k3)), "gram": quantise(c3[some] / (c12[g12[some]] + k3)),
    }
    trie = Trie(own[seen], renamed(after[k13]), renamed(before[k12]), to12[g12[some]], to13[g13[some]], codes)
    try:
        value, one = dequantised(), np.uint8(255)
        r = trie.levels["contexts"].find(own)
        s = trie.find("successors", r[of_after], after & ((_ONE << _ID) - _ONE))
        c = trie.find("children", r[(before >> _ID).astype(np.int64)], before & ((_ONE << _ID) - _ONE))
        gr = (g_rank >> _ID).astype(np.int64)
        found = trie.gram(r[gr], c[g12], s[g13])
        left, child_left = (np.where(x == 0, one, x) for x in (trie.code("left", r), trie.code("child_left", c)))  # all is left where a context is unknown
        nxt = trie.code("next", s)
        here, rest = value[trie.code("gram", found)], value[child_left[g12]]
        cold = ~hot[gr]
        here = here + np.where(cold, rest * value[nxt[g13]], 0.0)
        rest = rest * np.where(cold, value[left[gr]], 1.0)
        here, rest = np.where(here > 0, quantise(here), 0).astype(np.uint8)[of], quantise(rest)[of]
        pair_here, pair_rest = nxt[p13], left[pair_rank.astype(np.int64)]
    finally:
        trie.close()
    contexts = c2.astype(np.int64)[place[:n_contexts]]
    cuts = zip(where(4)[:-1], where(4)[1:], where(0)[:-1], where(0)[1:], where(10)[:-1], where(10)[1:])
    return [(here[a:b], rest[a:b], contexts[i:j], pair_here[x:y], pair_rest[x:y]) for a, b, i, j, x, y in cuts]


def score_texts(docs: DataFrame, k3: float = K3, k2: float = K2) -> DataFrame:
    """Scores of docs (doc_id, text, train): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: one token, the end. Rows that repeat an id are documents each. Without training
    documents every word is unknown. train null counts as false. k3 and k2 weigh the shorter context.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    blocks = _blocks(rows)
    size, n_all, started = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "seen", "started")]).first()
    per_piece = size_for(size, PIECE_TOKENS)
    pieces = max(PIECES, -(-size // per_piece))
    counts, v_all = _common_words(blocks, pieces, max(1.0, COMMON * size))
    counts[int(START)] = started
    shared = docs.sparkSession.sparkContext.broadcast(Common(counts, max(per_piece / 4, COMMON * size)))  # 1 / COMMON words at most

    def emit(block, lengths, train, vocab, tokens):
        common = shared.value
        vocab, lengths = np.frombuffer(vocab, np.uint64), np.frombuffer(lengths, np.int32)
        (tokens,) = unpack(tokens, "u4")
        g = Grams(vocab, tokens, lengths, common, pieces)
        seen = np.repeat(np.frombuffer(train, bool), lengths + 1)
        n = np.bincount(g.where[seen], minlength=len(g.w2))
        bn = np.bincount(g.pair_of_hot, weights=n[g.hot], minlength=len(g.b2)).astype(np.int64)[g.pair_order]
        n, w1, w2, w3 = (x[g.order] for x in (n, g.w1, g.w2, g.w3))
        b2, b3 = g.b2[g.pair_order], g.b3[g.pair_order]
        short, long = common.shorts(vocab), (vocab >> np.uint64(11)).astype(np.uint32)
        word = lambda w: (short[w], long[w][short[w] == SHORT])
        some = np.union1d(g.piece, g.pair_piece)
        (ta, pa_), (tb, pb) = g.cuts(some), g.cuts(some + 1)
        for k, a, b, c, d in zip(some.tolist(), ta, tb, pa_, pb):
            first, many = _contexts(w2[a:b])
            pair_first, pair_many = _contexts(b2[c:d])
            payload = pack(vocab[w2[a:b][first]], many.astype("<i4"), *word(w1[a:b]), *word(w3[a:b]), *_pack_counts(n[a:b]), vocab[b2[c:d][pair_first]], pair_many.astype("<i4"), *word(b3[c:d]), *_pack_counts(bn[c:d]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["piece", "block", "grams"])

    asked = _per_block(blocks, emit, ["block", "lengths", "train", "vocab", "tokens"], "piece long, block long, grams binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        got = answers_of([unpack(x, *_ASKED) for x in pdf["grams"]], shared.value, k3, k2)
        return pd.DataFrame({"block": pdf["block"], "piece": pdf["piece"], "answer": [pack(*x) for x in got]})

    answers = asked.groupBy("piece").applyInPandas(answer, "block long, piece long, answer binary")
    value = dequantised()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, common = left.iloc[0], shared.value
        vocab, lengths = np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["lengths"], np.int32)
        (tokens,) = unpack(row["tokens"], "u4")
        g = Grams(vocab, tokens, lengths, common, pieces)
        here, rest = np.zeros(len(g.w2)), np.ones(len(g.w2))
        pair_here, pair_rest = np.zeros(len(g.b2)), np.ones(len(g.b2))
        seen, w2 = np.zeros(len(vocab), np.int64), g.w2[g.order]
        (ta, pa_), (tb, pb) = g.cuts(right["piece"].to_numpy()), g.cuts(right["piece"].to_numpy() + 1)
        for data, a, b, c, d in zip(right["answer"], ta, tb, pa_, pb):
            h, r, n, ph, pr = unpack(data, "u1", "u1", "i8", "u1", "u1")
            here[g.order[a:b]], rest[g.order[a:b]] = value[h], value[r]
            pair_here[g.pair_order[c:d]], pair_rest[g.pair_order[c:d]] = value[ph], value[pr]
            seen[w2[a:b][_contexts(w2[a:b])[0]]] = n
        at = common.place(vocab)
        if len(common.counts):
            seen = np.where(at >= 0, common.counts[at], seen)
        seen[int(np.searchsorted(vocab, END))] = started  # as often as there are training documents
        base = np.log10((seen + 1) / (n_all + v_all + 1))
        p = 10 ** base[g.w3]
        p[g.hot] = pair_here[g.pair_of_hot] + pair_rest[g.pair_of_hot] * p[g.hot]
        p = (here + rest * p)[g.where]
        token = tokens[g.at]
        size = lengths.astype(np.int64) + 1
        first = np.cumsum(size) - size
        ids = pd.array(np.frombuffer(row["ids"], np.int64), "Int64")
        ids[~np.frombuffer(row["known"], bool)] = pd.NA
        total = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({"doc_id": ids, "n_tokens": size, "n_known": total((seen[token] > 0).astype(np.int64)), "train_tokens": n_all, "base_score": total(base[token]), "score": total(np.log10(p))})

    to_score = blocks.select("block", "ids", "known", "lengths", "vocab", "tokens").groupBy("block")
    return to_score.cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs.withColumn("train", id_mod(F.col("doc_id"), 7) != 2))
    return scored.withColumn("held_out", id_mod(F.col("doc_id"), 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
