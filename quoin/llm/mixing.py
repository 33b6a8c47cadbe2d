"""Mixing overlapping sources to target weights by min-cost flow.

Documents are counted by membership pattern (the set of sources they belong to). The words of a pattern
flow to the quotas of its sources; the k-th pass over the same words costs k, so that repetition is
convex and the cheapest flow repeats as little as it can. Documents are then picked by a seeded hash
until their pattern's flow is spent.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stored, table

#: Documents that a bucket of the hash holds on average, and the most buckets; one bucket a pattern is looked at in detail.
BUCKET, LOG2_BUCKETS = 256, 16


def quotas(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of total by weight; none above cap times its size, the excess reshared among the others."""
    out, open_, left = {}, [s for s in sizes if weights.get(s, 0) > 0], total
    out.update({s: 0.0 for s in sizes if s not in open_})
    while open_:
        w = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / w > cap * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / w for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


@dataclass
class Network:
    """A flow network; solve() sends as much as possible at the least cost along shortest paths."""

    to: list = field(default_factory=list)
    cap: list = field(default_factory=list)
    cost: list = field(default_factory=list)
    out: dict = field(default_factory=dict)

    def edge(self, a, b, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, s, t) -> None:
        while True:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out.get(x, ()):
                    y = self.to[e]
                    if self.cap[e] > 0 and dist[x] + self.cost[e] < dist.get(y, math.inf):
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if t not in dist:
                return
            path, y = [], t
            while y != s:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def route(patterns: list[tuple[tuple, int]], quota: dict, max_repeat: int) -> list[dict]:
    """For each (sources, words) pattern the words it sends to each of its sources.

    A source that no pattern shares with another has its own words alone, and needs no network.
    """
    shared = {s for members, _ in patterns if len(members) > 1 for s in members}
    net, lanes = Network(), []
    for i, (members, words) in enumerate(patterns):
        if not shared.intersection(members):
            lanes.append({s: min(quota.get(s, 0), max_repeat * words) for s in members})
            continue
        for k in range(max_repeat):
            net.edge("from", ("p", i), words, k)
        lanes.append({s: net.edge(("p", i), ("s", s), max_repeat * words) for s in members})
    for s, q in quota.items():
        if s in shared:
            net.edge(("s", s), "to", q)
    net.solve("from", "to")
    return [{s: net.cap[e ^ 1] for s, e in lane.items()} if shared.intersection(lane) else lane for lane in lanes]


def mix(docs: DataFrame, weigh, share: float = 1.5, max_repeat: int = 2, seed: int = 17, max_patterns: int = 1_000_000) -> DataFrame:
    """Pick documents so that each source's words come near its quota.

    docs: size (words) and members (array of source names; null is a source as any other), and further columns,
    which are carried along; draw (long), if there, is what documents are drawn by, else doc_id.
    weigh: function from the sorted list of sources (code point order, null last) to {source: weight}.
    Adds size, members, pattern_size (words of documents with just these members), target (quota that the flow
    gave the pattern's sources, exact where a document has one source), copies (how often the document is taken)
    and taken (copies times size); names that docs has besides get a trailing _.

    Documents without members, of size 0 or null are never taken. Rows with an equal draw go in or out together.
    The table of patterns is collected: more than max_patterns raise ValueError.
    """
    names = F.array_sort(F.array_distinct(F.coalesce("members", F.array().cast("array<string>"))))
    carried = [c for c in docs.columns if c not in ("size", "members", "draw")]
    h = F.xxhash64(F.lit(seed), "draw" if "draw" in docs.columns else "doc_id")
    given = docs.select(*[F.col(c).alias(f"_of_{c}") for c in carried], F.coalesce("size", F.lit(0)).cast("long").alias("size"), names.alias("members"), h.alias("h"))
    if carried == ["doc_id"]:
        given = rows = stored(given, "mix-rows")
    else:  # texts are not written
        rows = stored(given.select("size", "members", "h"), "mix-rows")
    spark = docs.sparkSession
    found = rows.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((tuple(r["members"]), r["words"], r["n"]) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict = {}
    for members, words, _ in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = share * sum(words for members, words, _ in patterns if members)
    target = quotas({s: sizes[s] for s in order}, weigh(order), total, max_repeat)
    flows = route([(m, w) for m, w, _ in patterns], {s: math.floor(q + 0.5) for s, q in target.items()}, max_repeat)

    bits = min(LOG2_BUCKETS, max(0, math.ceil(math.log2(max([1, *(n for *_, n in patterns)]) / BUCKET))))
    plan = [(list(m), w, float(target[m[0]]) if len(m) == 1 else float(sum(f.values())), *(divmod(sum(f.values()), w) if w else (0, 0))) for (m, w, _), f in zip(patterns, flows)]
    schema = "members array<string>, pattern_size long, target double, base long, rest long"
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # one row a pattern, at most max_patterns
    same = F.col("l.members").eqNullSafe(F.col("r.members"))
    bucket = F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")
    planned = lambda x: x.alias("l").join(plan_df.alias("r"), same).select("l.*", bucket.alias("bucket"), "pattern_size", "target", "base", "rest")
    rows = planned(rows)

    # The bucket of each pattern in which its rest runs out, from sums a bucket.
    sums = rows.where("rest > 0").groupBy("members", "rest", "bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
            .where("before <= rest AND before + words > rest")
            .select("members", F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("room")))
    edge = F.broadcast(stored(edge, "mix-edge"))  # one row a pattern at most
    edged = lambda x: x.alias("l").join(edge.alias("r"), same, "left").drop(F.col("r.members"))
    rows = edged(rows)

    # Within it, documents in hash order as long as they fit, and one more where that comes nearer.
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        room, keep, sizes = int(pdf["room"].iloc[0]), [], pdf["words"].tolist()
        for words in sizes:
            keep.append(words <= room)
            room -= words if keep[-1] else 0
        over, i = min(((abs(room - w), i) for i, w in enumerate(sizes) if not keep[i]), default=(room, -1))
        if over < room:
            keep[i] = True
        return pdf.loc[keep, ["members", "h"]].assign(extra=1)

    last = rows.where("bucket = edge AND size > 0").groupBy("members", "room", "h").agg(F.sum("size").alias("words"))
    fits = last.groupBy("members").applyInPandas(fit, "members array<string>, h long, extra long")
    fits = stored(fits, "mix-fits")
    out = edged(planned(given)).alias("l").join(fits.alias("r"), (F.col("l.h") == F.col("r.h")) & same, "left")
    extra = F.when(F.col("bucket") < F.col("edge"), 1).when(F.col("bucket") == F.col("edge"), F.coalesce("extra", F.lit(0))).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("base") + extra).otherwise(0).cast("long")
    added = {"size": F.col("size"), "members": F.col("l.members"), "pattern_size": F.col("pattern_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("size")}
    free = lambda c: c if c not in carried else free(c + "_")
    return out.select(*[F.col(f"_of_{c}").alias(c) for c in carried], *[x.alias(free(c)) for c, x in added.items()])


def cycle_weights(sources: list) -> dict:
    """3, 1, 2 and again, by place."""
    return {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it; a null text has size 0, a null source is a source."""
    return mix_documents(table(spark, sf_dir, "documents"))


def _sized(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, n_words(F.col("text")).alias("size"), F.array("source").alias("members"), F.xxhash64("doc_id", "text").alias("draw"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken of documents."""
    mixed = mix(_sized(docs, "doc_id"), cycle_weights)
    return mixed.select("doc_id", "size", F.col("members")[0].alias("source"), F.col("pattern_size").alias("source_size"), "target", "copies", "taken")


def taken_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with all their columns, and copies, how often it takes them (copies_ if
    docs has a column of that name)."""
    plain = docs.select([F.col(c).alias(f"_doc_{c}") for c in docs.columns] + ["doc_id", "text", "source"])
    mixed = mix(_sized(plain, *[f"_doc_{c}" for c in docs.columns]), cycle_weights).where("copies > 0")
    copies = "copies"
    while copies in docs.columns:
        copies += "_"
    return mixed.select(*[F.col(f"_doc_{c}").alias(c) for c in docs.columns], F.col("copies").alias(copies))
