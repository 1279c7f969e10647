"""Token shards, packable spans, bin packing and materialised bins."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import OrderedDict
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .order import ranked

EOS, PAD, PAD_SEGMENT = 1, 0, -1
MIN_SPAN = 8


def token_ids(c: str = "text") -> Column:
    """Stand-in token ids, the same in SQL: the length of each word, plus two for the end and padding ids."""
    return F.transform(T.words(c), lambda w: (F.length(w) + 2).cast("int"))


def assign(df: DataFrame, per_shard: int, *keys: str) -> DataFrame:
    """Adds shard: runs of so many documents, in order of doc_id (which tells rows apart), within the keys. Only keys and ids
    are ordered; texts meet their shard by id."""
    places = ranked(df.select(*keys, "doc_id"), list(keys), ["doc_id"])
    return df.join(places.select("doc_id", F.floor(F.col("place") / per_shard).cast("long").alias("shard")), "doc_id")


def lru(accesses: list, capacity: int) -> list[bool]:
    """Whether each access finds its shard among the capacity shards used last."""
    held: OrderedDict = OrderedDict()
    out = []
    for key in accesses:
        out.append(key in held)
        held[key] = None
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
    return out


def cache_hits(reads: DataFrame, reader: str, order: str, key: str, capacity: int) -> DataFrame:
    """(reader, hits, misses) of a cache of shards for each reader, whose reads go one after the other."""
    kind = reads.schema[reader].dataType.simpleString()

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = lru(g.sort_values(order)[key].tolist(), capacity)
        return pd.DataFrame({reader: g[reader].iloc[:1], "hits": [sum(found)], "misses": [len(found) - sum(found)]})

    return reads.select(reader, order, key).groupBy(reader).applyInPandas(one, f"{reader} {kind}, hits bigint, misses bigint")


def spans(df: DataFrame, seq_len: int, *keys: str) -> DataFrame:
    """(keys.., shard, doc_id, token_start, token_end, n_tokens, sample_id): each document's tokens within the shard's
    stream, cut into pieces of at most seq_len - 1; pieces under 8 tokens are left out."""
    w = W.partitionBy(*keys, "shard").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("n", T.n_words("text")).withColumn("doc_start", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    cut = seq_len - 1
    out = out.withColumn("token_start", F.explode(F.expr(f"sequence(doc_start, doc_start + n - 1, {cut})")))
    out = out.withColumn("token_end", F.least(F.col("token_start") + cut, F.col("doc_start") + F.col("n"))).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    name = F.concat_ws("-", *keys, F.col("shard").cast("string"))
    out = out.where(F.col("n_tokens") >= MIN_SPAN).withColumn("sample_id", F.concat(name, F.lit(":"), F.col("token_start").cast("string"), F.lit("-"), F.col("token_end").cast("string")))
    return out.select(*keys, "shard", "doc_id", "token_start", "token_end", "n_tokens", "sample_id")


def fit(costs: list[int], room: int, best: bool, max_open: int | None = None) -> list[int]:
    """The bin of each item in turn: the first open bin with room, or the one that it leaves least of (ties: the first
    opened); with max_open, the fullest is closed before another opens."""
    if not max_open:
        return fit_any(costs, room, best)
    used: list[int] = []
    open_: list[int] = []
    out = []
    for c in costs:
        if c > room:
            raise ValueError(f"an item of {c} doesn't fit a bin of {room}")
        pick, left = -1, room + 1
        for b in open_:
            rest = room - used[b] - c
            if rest >= 0 and (not best or rest < left):
                pick, left = b, rest
                if not best:
                    break
        if pick < 0:
            if max_open and len(open_) >= max_open:
                open_.remove(max(open_, key=lambda b: (used[b], -b)))
            pick = len(used)
            used.append(0)
            open_.append(pick)
        used[pick] += c
        out.append(pick)
    return out


def fit_any(costs: list[int], room: int, best: bool) -> list[int]:
    """fit() with all bins open: bins stand in heaps by the room left, so an item looks at the distinct rooms only."""
    heaps: dict[int, list[int]] = {}
    rooms: list[int] = []  # those with a bin, ascending
    out, bins = [], 0
    for c in costs:
        if c > room:
            raise ValueError(f"an item of {c} doesn't fit a bin of {room}")
        enough = rooms[bisect_left(rooms, c) :]
        if enough:
            rest = enough[0] if best else min(enough, key=lambda r: heaps[r][0])
            pick = heappop(heaps[rest])
            if not heaps[rest]:
                del heaps[rest], rooms[bisect_left(rooms, rest)]
        else:
            rest, pick, bins = room, bins, bins + 1
        if rest > c:
            if rest - c not in heaps:
                heaps[rest - c] = []
                insort(rooms, rest - c)
            heappush(heaps[rest - c], pick)
        out.append(pick)
    return out


def policy(decreasing: bool, best: bool, max_open: int | None = None) -> Callable[[pd.DataFrame, int], pd.DataFrame]:
    def run(g: pd.DataFrame, room: int) -> pd.DataFrame:
        g = g.assign(cost=g.n_tokens + 1)
        g = g.sort_values(["cost", "sample_id"], ascending=[False, True]) if decreasing else g.sort_values("sample_id")
        g["bin"] = fit(g.cost.tolist(), room, best, max_open)
        g["bin_offset"] = g.groupby("bin").cost.cumsum() - g.cost
        g["segment"] = g.groupby("bin").cumcount()
        return g

    return run


POLICIES: dict[str, Callable[[pd.DataFrame, int], pd.DataFrame]] = {
    "first_fit": policy(False, False),
    "best_fit": policy(False, True),
    "first_fit_decreasing": policy(True, False),
    "best_fit_decreasing": policy(True, True, 8),
}
PACKED = "lane string, chunk bigint, sample_id string, doc_id bigint, n_tokens bigint, bin bigint, bin_offset bigint, segment bigint"


def register_policy(name: str, run: Callable[[pd.DataFrame, int], pd.DataFrame]) -> None:
    """Add a packer: it gets a lane's samples and the room of a bin, and adds bin, bin_offset and segment."""
    POLICIES[name] = run


def pack(samples: DataFrame, name: str, seq_len: int, chunk: int = 20_000) -> DataFrame:
    """Samples (lane, sample_id, doc_id, n_tokens) placed into bins by a policy. Packing is sequential, so a lane is cut
    into chunks of so many samples by sample_id, packed each on its own: no task gets a whole large lane."""
    n = F.row_number().over(W.partitionBy("lane", "_slice").orderBy("sample_id"))
    counts = samples.groupBy("lane").agg(F.count("*").alias("_n"))
    cut = samples.join(counts, "lane").withColumn("_slice", F.pmod(F.xxhash64("sample_id"), F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)))).withColumn("_rank", n)
    run = POLICIES[name]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return run(g, seq_len)[["lane", "chunk", "sample_id", "doc_id", "n_tokens", "bin", "bin_offset", "segment"]]

    return cut.select("lane", F.col("_slice").alias("chunk"), "sample_id", "doc_id", "n_tokens").groupBy("lane", "chunk").applyInPandas(one, PACKED)


def first_bins(counts: dict[int, int], room: int, bins: int, max_open: int) -> list[tuple[int, int, int, int, int]]:
    """(cost, place among the items of that cost, bin, bin_offset, segment) of what best-fit-decreasing puts into the first
    bins, from how many items have each cost. Open bins only depend on costs; where they repeat within a cost, whole periods
    are skipped, and it ends once no first bin can take more."""
    out, open_, opened = [], [], 0  # an open bin: [used, number, items]
    least = min(counts, default=0)
    for c in sorted(counts, reverse=True):
        left, seen = counts[c], {}
        while left:
            if opened >= bins and not any(b[1] < bins and b[0] + least <= room for b in open_):
                return out
            key = tuple((b[0], min(b[1], bins), b[2] if b[1] < bins else 0) for b in open_)
            if opened > bins and key in seen:
                left %= seen[key] - left
                seen = {}
                if not left:
                    break
            seen[key] = left
            fits = [b for b in open_ if b[0] + c <= room]
            if fits:
                b = max(fits, key=lambda x: (x[0], -x[1]))
            else:
                if len(open_) >= max_open:
                    open_.remove(max(open_, key=lambda x: (x[0], -x[1])))
                b = [0, opened, 0]
                opened += 1
                open_.append(b)
            if b[1] < bins:
                out.append((c, counts[c] - left, b[1], b[0], b[2]))
            b[0] += c
            b[2] += 1
            left -= 1
    return out


def pack_first(samples: DataFrame, seq_len: int, bins: int, max_open: int = 8) -> DataFrame:
    """The first bins of best-fit-decreasing over all samples as one lane: the driver gets how many there are of each cost,
    and the samples that the bins hold are the first of their costs by sample_id."""
    counts = {r.n_tokens + 1: r["count"] for r in samples.groupBy("n_tokens").count().collect()}
    placed = first_bins(counts, seq_len, bins, max_open)
    most = max((p[1] for p in placed), default=0) + 1
    rank = F.row_number().over(W.partitionBy("n_tokens").orderBy("sample_id"))
    own = samples.where(F.col("n_tokens").isin(sorted({p[0] - 1 for p in placed}))).withColumn("_rank", rank).where(F.col("_rank") <= most)
    at = samples.sparkSession.createDataFrame([(c - 1, k + 1, *x) for c, k, *x in placed], "n_tokens bigint, _rank int, bin bigint, bin_offset bigint, segment bigint")
    return own.join(F.broadcast(at), ["n_tokens", "_rank"]).select("lane", F.lit(0).cast("long").alias("chunk"), "sample_id", "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "bin", "bin_offset", "segment")


def pad_only(samples: DataFrame) -> DataFrame:
    """One sample a bin."""
    bin_ = F.col("place")
    return ranked(samples.select("lane", "sample_id", "doc_id", "n_tokens"), ["lane"], ["sample_id"]).select("lane", F.lit(0).cast("long").alias("chunk"), "sample_id", "doc_id", "n_tokens", bin_.cast("long").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("segment"))


def utilisation(packed: DataFrame, seq_len: int) -> DataFrame:
    """One row: bins, positions, content, padding, utilisation; an end token after each sample."""
    bins = packed.groupBy("lane", "chunk", "bin").agg(F.sum(F.col("n_tokens") + 1).alias("used"))
    out = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("content_tokens"))
    out = out.withColumn("positions", F.col("bins") * seq_len).withColumn("padding_tokens", F.col("positions") - F.col("content_tokens"))
    return out.withColumn("utilisation", F.round(F.col("content_tokens") / F.greatest(F.lit(1), F.col("positions")), 6))


def bins(packed: DataFrame, tokens: DataFrame, seq_len: int) -> DataFrame:
    """(lane, chunk, bin, input_ids, loss_mask, segment_ids, position_ids, attention_mask, n_samples, content_tokens,
    loss_tokens): bins as arrays. tokens: (sample_id, ids). A position bears loss if it stands in the segment of the one
    before it; padding never does."""
    each = packed.join(tokens, "sample_id").groupBy("lane", "chunk", "bin").agg(F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("s"))
    ids = F.flatten(F.transform("s", lambda x: F.concat(x["ids"], F.array(F.lit(EOS)))))
    seg = F.flatten(F.transform("s", lambda x: F.array_repeat(x["segment"].cast("int"), F.size(x["ids"]) + 1)))
    pos = F.flatten(F.transform("s", lambda x: F.sequence(F.lit(0), F.size(x["ids"]))))
    each = each.select("lane", "chunk", "bin", F.size("s").cast("long").alias("n_samples"), ids.alias("i"), seg.alias("g"), pos.alias("p")).withColumn("n", F.size("i"))
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(seq_len) - F.col("n")))
    out = each.select("lane", "chunk", "bin", "n_samples", F.col("n").cast("long").alias("content_tokens"), pad("i", PAD).alias("input_ids"), pad("g", PAD_SEGMENT).alias("segment_ids"), pad("p", 0).alias("position_ids"))
    same = F.transform("segment_ids", lambda x, k: ((k > 0) & (x != PAD_SEGMENT) & (x == F.get("segment_ids", k - 1))).cast("int"))
    out = out.withColumn("loss_mask", same).withColumn("attention_mask", F.transform("segment_ids", lambda x: (x != PAD_SEGMENT).cast("int")))
    return out.withColumn("loss_tokens", F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).cast("long"))


def _array_hash(ids: pd.Series, mask: pd.Series, segments: pd.Series, positions: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(b"".join(np.asarray(x, "<i8").tobytes() for x in r)).hexdigest() for r in zip(ids, mask, segments, positions)])


def array_hash(*arrays: str) -> Column:
    """SHA-256 over the four arrays of a bin as little-endian 64-bit integers."""
    return F.pandas_udf(_array_hash, "string")(*arrays)


def relation(segments: np.ndarray) -> np.ndarray:
    """For rows of segment ids, whether position i (second axis) attends to j (third): j is not after it, in its segment and
    real, or is itself."""
    n = segments.shape[1]
    same = (segments[:, :, None] == segments[:, None, :]) & (segments[:, None, :] != PAD_SEGMENT)
    return same & np.tri(n, dtype=bool) | np.eye(n, dtype=bool)


def attention(binned: DataFrame) -> DataFrame:
    """(lane, chunk, bin, i, j): position i attends to j."""

    def run(segments: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in np.argwhere(relation(np.array([s]))[0]).tolist()] for s in segments])

    pairs = F.pandas_udf(run, "array<struct<i:int,j:int>>")("segment_ids")
    return binned.select("lane", "chunk", "bin", F.inline(pairs))


def attention_checks(binned: DataFrame, relation: Callable[[np.ndarray], np.ndarray] = relation) -> DataFrame:
    """(causal, within_segment, every_position_attends_itself) of each bin; its relation is built in its row only."""

    def run(segments: pd.Series) -> pd.DataFrame:
        out = []
        for s in segments:
            seg = np.asarray(s)
            i, j = np.nonzero(relation(seg[None])[0])
            inside = (i == j) | ((seg[i] == seg[j]) & (seg[j] != PAD_SEGMENT))
            out.append((bool((j <= i).all()), bool(inside.all()), int((i == j).sum()) == len(seg)))
        return pd.DataFrame(out, columns=["causal", "within_segment", "every_position_attends_itself"])

    return binned.select(F.pandas_udf(run, "causal boolean, within_segment boolean, every_position_attends_itself boolean")("segment_ids").alias("r")).select("r.*")
