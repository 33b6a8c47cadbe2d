"""Chat formatting as prefix trees.

Conversations that share their initial turns share those turns' tokens. A conversation is a path of turns;
paths sorted by the running hashes of their turns are the depth-first order of the forest, so that a range
sort spreads even one hot first turn over many tasks. Each task walks its range and packs trees: a segment
for each turn, its tokens once, position ids that go on from the parent's, and for each segment the
intervals of tokens that it may attend to, which are its ancestors' and its own.

A pack ends where the tree ends, or where it would pass a bound; the next pack then repeats the turns on the
path to where the tree goes on.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning to this template or to other chat templates; inside texts they are escaped.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
#: Vocabulary of a public byte-level BPE; None: a token is a code point.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACK_TOKENS = 1 << 16

SCHEMA = T.StructType([
    T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.ArrayType(T.IntegerType())),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("parent", T.IntegerType()),
        T.StructField("loss_start", T.IntegerType()), T.StructField("loss_stop", T.IntegerType()),
        T.StructField("attends", T.ArrayType(T.IntegerType()))]))),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.IntegerType())]))),
])


def escape(text: str) -> str:
    """Backslashes doubled, and a backslash after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Codec:
    """Tokens of a template: control strings have ids of their own after the vocabulary's."""

    def __init__(self, vocabulary: str | None):
        if vocabulary:
            import public_tokenizers
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.bpe, self.first = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
            self.bytes = {v: k for k, v in ranks.items()}
        else:
            self.bpe, self.first = None, 0x110000
        self.marks = {TURN: self.first, TEXT: self.first + 1, END: self.first + 2}
        self.names = {v: k for k, v in self.marks.items()}

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text) if self.bpe else list(map(ord, text))

    def decode(self, tokens) -> str:
        if self.bpe:
            return b"".join(self.names[t].encode() if t >= self.first else self.bytes[t] for t in tokens).decode()
        return "".join(self.names[t] if t >= self.first else chr(t) for t in tokens)

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The tokens of a turn and where those of its text begin and end."""
        head = [self.marks[TURN], *self.encode(escape(role)), self.marks[TEXT]]
        body = self.encode(escape(text))
        return [*head, *body, self.marks[END]], len(head), len(head) + len(body)


@lru_cache(maxsize=2)
def codec(vocabulary: str | None) -> Codec:
    return Codec(vocabulary)


class Packer:
    """Walks conversations in depth-first order and gives finished packs."""

    def __init__(self, code: Codec, most: int):
        self.code, self.most = code, most
        self.clear()

    def clear(self) -> None:
        self.tokens, self.places, self.segments, self.convs = [], [], [], []
        self.path: list = []  # (hash, segment) of the conversation before

    def done(self) -> dict | None:
        out = {"tokens": self.tokens, "position_ids": self.places, "segments": self.segments, "conversations": self.convs} if self.convs else None
        self.clear()
        return out

    def add(self, conv_id, path: bytes, turns: list[tuple[str, str]]):
        """Adds a conversation (8 bytes of path a turn); yields the pack before, if it ends here."""
        keys = [path[i : i + 8] for i in range(0, len(path), 8)]
        same = 0
        while same < min(len(keys), len(self.path)) and self.path[same][0] == keys[same]:
            same += 1
        if self.convs and (same == 0 or (same < len(keys) and len(self.tokens) > self.most)):
            yield self.done()
            same = 0
        del self.path[same:]
        for key, (role, text) in zip(keys[same:], turns[same:]):
            parent = self.path[-1][1] if self.path else -1
            tokens, a, b = self.code.turn(role, text)
            start = len(self.tokens)
            begin = 0 if parent < 0 else self.places[self.segments[parent]["stop"] - 1] + 1
            spans = list(self.segments[parent]["attends"]) if parent >= 0 else []
            if spans and spans[-1] == start:
                spans[-1] = start + len(tokens)
            else:
                spans += [start, start + len(tokens)]
            self.tokens += tokens
            self.places += range(begin, begin + len(tokens))
            loss = (start + a, start + b) if role == "assistant" else (start, start)
            self.segments.append({"start": start, "stop": start + len(tokens), "parent": parent, "loss_start": loss[0], "loss_stop": loss[1], "attends": spans})
            self.path.append((key, len(self.segments) - 1))
        self.convs.append({"conv_id": conv_id, "segment": self.path[-1][1]})


def turn_path(turns: list[tuple[str, str]]) -> bytes:
    """8 bytes a turn: a running hash of the turns so far."""
    out, before = [], b""
    for role, text in turns:
        before = hashlib.sha256(before + len(role.encode()).to_bytes(8) + role.encode() + text.encode()).digest()
        out.append(before[:8])
    return b"".join(out)


def format_chats(rows: DataFrame, vocabulary: str | None = VOCABULARY, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs (SCHEMA) of conversations given as rows (conv_id, turn, role, text).

    Turns follow turn, then role and text, so that repeated turns have an order too; a null turn is first.
    Null role and text are empty. Rows with a null conv_id are one conversation. Each conversation is in one
    pack; attends holds starts and stops of the tokens that a segment's tokens may see, up to themselves.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def paths(batches):
        for b in batches:
            keys = [turn_path(list(zip(r, t))) for r, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *b.columns], names=["path", *b.schema.names])

    sorted_ = (convs.mapInArrow(paths, "path binary, conv_id long, roles array<string>, texts array<string>")
               .repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
    kind = pa.schema([("tokens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())),
                      ("segments", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("loss_start", pa.int32()), ("loss_stop", pa.int32()), ("attends", pa.list_(pa.int32()))]))),
                      ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("segment", pa.int32())])))])

    def packs(batches):
        packer = Packer(codec(vocabulary), pack_tokens)
        for b in batches:
            ready = []
            for path, conv, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
                ready += packer.add(conv, path, list(zip(roles, texts)))
            if ready:
                yield pa.RecordBatch.from_pylist(ready, kind)
        if (last := packer.done()) is not None:
            yield pa.RecordBatch.from_pylist([last], kind)

    return sorted_.mapInArrow(packs, SCHEMA)


_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def read_back(packs: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Per conversation what its packed tokens say: turns, text under the loss mask, and length as formatted."""

    def digest(parts) -> str:
        h = hashlib.sha256()
        for p in parts:
            h.update(p.encode())
        return h.hexdigest()

    def run(batches):
        code = codec(vocabulary)
        for b in batches:
            out = []
            for tokens, segments, convs in zip(b.column(0), b.column(2).to_pylist(), b.column(3).to_pylist()):
                tokens = tokens.values.to_numpy(zero_copy_only=False)
                shown = [code.decode(tokens[s["start"] : s["stop"]].tolist()) for s in segments]
                loss = [unescape(code.decode(tokens[s["loss_start"] : s["loss_stop"]].tolist())) for s in segments]
                for c in convs:
                    at, path = c["segment"], []
                    while at >= 0:
                        path.append(at)
                        at = segments[at]["parent"]
                    path.reverse()
                    text = "".join(shown[i] for i in path)
                    turns = [(unescape(r), unescape(t)) for r, t in _PARSE.findall(text)]
                    kept = [loss[i] for i in path]
                    out.append((c["conv_id"], len(turns), digest(x for r, t in turns for x in (r, "\n", t, "\n")), sum(map(len, kept)), digest(kept), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i in (2, 4) else pa.array(c, pa.int64()) for i, c in enumerate(map(list, zip(*out)))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, formatted and read back from the packs."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(more)))


OP5_SQL = r"""
WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     escaped AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|<SYS>>|</SYS>>|s>|/s>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS e FROM every)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(e) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
