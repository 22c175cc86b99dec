"""Problem 8: long spans that stand word for word in more than one document.

Difference-cover anchors. Windows are hashed only where their position modulo PERIOD lies in COVER. COVER is a perfect
difference set: any two positions have a shift below PERIOD that takes both into it, so two documents with a common span
of at least ``PERIOD - 1 + window`` characters have a common anchor inside it. Four stages:

1. each document's anchors are hashed and sent, in packed blocks, to the bucket of their hash;
2. a bucket keeps the anchors that more than one document has;
3. around these the match is extended: every window of the full length that holds a kept anchor is hashed (128 bits) and
   sent to its bucket, exact copies of a text only once;
4. a full window that two texts have is a common span: the buckets give the pairs of texts, and each text's shared starts.

Only stages 1 and 3 read texts; what they send is about an eighth of a hash a character, and the windows in question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.session import BROADCAST_LIMIT_BYTES, cut_lineage, shuffle_partitions, spread

#: A perfect difference set modulo 73.
PERIOD, COVER = 73, (0, 1, 12, 20, 26, 30, 33, 35, 57)
MIN_SPAN = 120
#: Code points hashed at a time and hashes packed at a time; both bound a task's memory.
BLOCK_CHARS, PACK = 1_000_000, 1_000_000
#: Hashes that a bucket, which one task reads at once, is meant to hold: with documents and positions about 16 MB.
BUCKET_ROWS = 500_000
#: Documents of one pack that may send the same hash to its bucket; beyond that two stand for all, and the rest are known to
#: share it: they are handed on by any bucket's task.
HOT = 64
#: Documents of a common window, or copies of a text, whose pairs one task makes; beyond that tiles of so many meet.
TILE = 512

_BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_PACKED = "bucket int, hot boolean, n int, h binary, h2 binary, doc binary, pos binary"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2**64."""
    size = max(n + 1, BLOCK_CHARS + 4096)
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        got = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = got
    return got


def window_hashes(codes: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` code points that begin at the positions ``at``."""
    up, down = _power(_BASES[which], len(codes))
    values = _mix(codes.astype(np.uint64) + np.uint64(1 + which))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(codes)], out=sums[1:])
    return _mix((sums[at + width] - sums[at]) * down[at])


def _blocks(batch_ids: list, texts: list, width: int) -> Iterator[tuple[list, list, list, np.ndarray]]:
    """Texts grouped to about BLOCK_CHARS: (ids, offsets of each text's first position, lengths, code points).

    A longer text is walked in parts that overlap by ``width - 1``.
    """
    ids, firsts, sizes, parts, waiting = [], [], [], [], 0
    for i, text in zip(batch_ids, texts):
        for at in range(0, max(1, len(text) - width + 1), BLOCK_CHARS):
            part = text[at : at + BLOCK_CHARS + width - 1] if len(text) > BLOCK_CHARS else text
            if waiting and waiting + len(part) > BLOCK_CHARS:
                yield ids, firsts, sizes, np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
                ids, firsts, sizes, parts, waiting = [], [], [], [], 0
            ids.append(i)
            firsts.append(at)
            sizes.append(len(part))
            parts.append(part)
            waiting += len(part)
    if parts:
        yield ids, firsts, sizes, np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes that are all alike take no room."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def _from_planes(data: bytes, n: int, kind=np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack(buckets: int, apart: bool, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, h2: np.ndarray | None = None) -> Iterator[dict]:
    """Packed blocks of hashes, one a bucket. ``apart``: what more than HOT documents have is known to be shared and goes to any bucket."""
    where = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    second = h if h2 is None else h2
    order = np.lexsort((doc, second, h, where))
    h, doc, pos, where, second = h[order], doc[order], pos[order], where[order], second[order]
    h2 = None if h2 is None else second
    hot = np.zeros(len(h), dtype=bool)
    if apart and len(h):
        run = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])]))
        size = np.diff(np.concatenate([run, [len(h)]]))
        for a, n in zip(run[size > HOT].tolist(), size[size > HOT].tolist()):
            own = doc[a : a + n]
            fresh = np.flatnonzero(own[1:] != own[:-1])
            if len(fresh) >= HOT:
                hot[a + 1 : a + n] = True
                hot[a + 1 + fresh[-1]] = False  # the first and one of the last document stay for the bucket
    for kind in (False, True):
        mask = hot == kind
        if not mask.any():
            continue
        hh, dd, pp, ww = h[mask], doc[mask], pos[mask], where[mask]
        if kind:  # in even parts, from another bucket on for each pack
            ww = np.sort((int(dd[0]) + np.arange(len(ww)) * min(buckets, 1 + len(ww) // 10_000) // len(ww)) % buckets)
        hh2 = None if h2 is None else h2[mask]
        cuts = np.searchsorted(ww, np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                yield {
                    "bucket": b, "hot": kind, "n": int(j - i),
                    "h": _planes(np.diff(hh[i:j], prepend=np.uint64(0))), "h2": None if hh2 is None else _planes(hh2[i:j]),
                    "doc": _planes(dd[i:j].astype(np.int64)), "pos": _planes(pp[i:j].astype(np.int64)),
                }


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    h, h2, doc, pos, hot = [], [], [], [], []
    for row in table.to_pylist():
        n = row["n"]
        h.append(np.cumsum(_from_planes(row["h"], n), dtype=np.uint64))
        if row["h2"] is not None:
            h2.append(_from_planes(row["h2"], n))
        doc.append(_from_planes(row["doc"], n, np.int64))
        pos.append(_from_planes(row["pos"], n, np.int64))
        hot.append(np.full(n, row["hot"]))
    return np.concatenate(h), np.concatenate(h2) if h2 else None, np.concatenate(doc), np.concatenate(pos), np.concatenate(hot)


def _send(buckets: int, apart: bool, hashed: Iterator[tuple], packed: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Gathers arrays (h, doc, pos, h2 or None) to packs."""
    held, waiting = [], 0

    def flush():
        rows = list(_pack(buckets, apart, *(None if col[0] is None else np.concatenate(col) for col in zip(*held))))
        return pa.RecordBatch.from_pylist(rows, schema=packed)

    for piece in hashed:
        held.append(piece)
        waiting += len(piece[0])
        if waiting >= PACK:
            yield flush()
            held, waiting = [], 0
    if waiting:
        yield flush()


def _packed_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("n", pa.int32()), *((c, pa.binary()) for c in ("h", "h2", "doc", "pos"))])


def _anchors(texts: DataFrame, min_span: int, buckets: int) -> DataFrame:
    """Stage 1, of (doc, text)."""
    width = min_span - PERIOD + 1

    def run(batches):
        period = np.array(COVER, dtype=np.int64)

        def hashed():
            for batch in batches:
                ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for own, firsts, sizes, codes in _blocks(ids, texts_, width):
                    longest = max(sizes)
                    cover = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + period).ravel()
                    at, doc, pos, offset = [], [], [], 0
                    for i, first, size in zip(own, firsts, sizes):
                        if first % PERIOD:
                            mine = np.flatnonzero(np.isin((first + np.arange(size - width + 1)) % PERIOD, period))
                        else:
                            mine = cover[: np.searchsorted(cover, size - width + 1)]
                        at.append(mine + offset)
                        pos.append(mine + first)
                        doc.append(np.full(len(mine), i, dtype=np.int64))
                        offset += size
                    starts = np.concatenate(at)
                    if len(starts):
                        yield window_hashes(codes, starts, width), np.concatenate(doc), np.concatenate(pos), None

        yield from _send(buckets, True, hashed(), _packed_schema())

    return texts.mapInArrow(run, _PACKED)


def _by_bucket(packed: DataFrame, buckets: int, work: Callable[[pa.Table], pa.Table], shape: str) -> DataFrame:
    """What ``work`` makes of each bucket; a partition is a bucket."""

    def run(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return packed.repartitionById(buckets, "bucket").mapInArrow(run, shape)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Stage 2: (h, doc, pos) of the anchors of more than one document."""
    h, _, doc, pos, hot = _unpack(table)
    order = np.lexsort((doc, h, hot))
    h, doc, pos, hot = h[order], doc[order], pos[order], hot[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (hot[1:] != hot[:-1])]))
    end = np.concatenate([begin[1:], [len(h)]]).astype(np.int64)
    keep = np.repeat((doc[begin] != doc[end - 1]) | hot[begin], end - begin)
    return pa.table({"h": pa.array(h[keep].view(np.int64)), "doc": pa.array(doc[keep]), "pos": pa.array(pos[keep])})


def _full_windows(questioned: DataFrame, min_span: int, buckets: int, apart: bool) -> DataFrame:
    """Stage 3, of (doc, text, at: positions of anchors)."""
    width = min_span - PERIOD + 1

    def run(batches):
        def hashed():
            for batch in batches:
                ids, texts, anchors = (batch.column(i).to_pylist() for i in range(3))
                for i, text, found in zip(ids, texts, anchors):
                    at = np.unique(np.array(found, dtype=np.int64))
                    low, high = np.maximum(at + width - min_span, 0), np.minimum(at, len(text) - min_span) + 1
                    low, high = low[low < high], high[low < high]
                    if not len(low):
                        continue
                    low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1]]))
                    low, high = low[low < high], high[low < high]
                    counts = high - low
                    starts = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                    for block in range(int(starts[0]), int(starts[-1]) + 1, BLOCK_CHARS):
                        mine = starts[np.searchsorted(starts, block) : np.searchsorted(starts, block + BLOCK_CHARS)]
                        if not len(mine):
                            continue
                        a = int(mine[0])
                        codes = np.frombuffer(text[a : int(mine[-1]) + min_span].encode("utf-32-le"), dtype=np.uint32)
                        h, h2 = (window_hashes(codes, mine - a, min_span, k) for k in (0, 1))
                        yield h, np.full(len(mine), i, dtype=np.int64), mine, h2

        yield from _send(buckets, apart, hashed(), _packed_schema())

    return questioned.mapInArrow(run, _PACKED)


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and positions ordered by window, and the begin and end of each window that several documents have."""
    h, h2, doc, pos, hot = _unpack(table)
    order = np.lexsort((doc, h2, h, hot))
    h, h2, doc, pos, hot = h[order], h2[order], doc[order], pos[order], hot[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (hot[1:] != hot[:-1])]))
    end = np.concatenate([begin[1:], [len(h)]])
    several = (doc[begin] != doc[end - 1]) | hot[begin]
    return h, h2, doc, pos, begin[several], end[several]


def _sharing(table: pa.Table) -> pa.Table:
    """Stage 4: (w, v, n, doc), the n documents of each window of this bucket that several have.

    Neighbouring windows of one passage mostly have the same documents; one window stands for each such set.
    """
    h, h2, doc, _, begin, end = _groups(table)
    if not len(begin):
        return pa.table({name: pa.array([], pa.int64()) for name in ("w", "v", "n", "doc")})
    member = np.repeat(np.arange(len(begin)), end - begin)
    at = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(len(member))
    doc, w, v = doc[at], h[at], h2[at]
    once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (member[1:] != member[:-1])])
    doc, member, w, v = doc[once], member[once], w[once], v[once]
    begin = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]]))
    size = np.diff(np.concatenate([begin, [len(doc)]]))
    mixed = doc.astype(np.uint64)
    sums = [np.add.reduceat(_mix(mixed * np.uint64(k)), begin) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    _, distinct = np.unique(np.stack([*sums, size.astype(np.uint64)], axis=1), axis=0, return_index=True)
    first, size = begin[distinct], size[distinct]
    keep = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    return pa.table({"w": pa.array(w[keep].view(np.int64)), "v": pa.array(v[keep].view(np.int64)), "n": pa.array(np.repeat(size, size)), "doc": pa.array(doc[keep])})


def _pairs_of_members(members: DataFrame, by: list[str]) -> DataFrame:
    """(a, b), a < b: the pairs of documents within each group of (by..., n, doc), n being its size.

    A group is cut into tiles of about TILE documents, and each pair of tiles is a key of its own, so that no task has more
    than TILE * TILE pairs of a group to make.
    """
    cut = members.select(*by, "doc", F.ceil(F.col("n") / TILE).alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("doc"), "tiles"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    left = cut.select(*by, F.col("doc").alias("a"), F.col("tile").alias("i"), every.alias("j"))
    right = cut.select(*by, F.col("doc").alias("b"), every.alias("i"), F.col("tile").alias("j"))
    return left.join(right, [*by, "i", "j"]).filter("a < b").select("a", "b")


def _window_starts(table: pa.Table) -> pa.Table:
    """Stage 4: (doc, pos) of the windows that several documents have."""
    _, _, doc, pos, begin, end = _groups(table)
    counts = end - begin
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return pa.table({"doc": pa.array(doc[at]), "pos": pa.array(pos[at])})


def _texts(docs: DataFrame, key: str, text: str, min_span: int) -> DataFrame:
    """(doc, text) of the texts long enough for a span."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= min_span))


def _classes(texts: DataFrame) -> DataFrame:
    """(doc, rep): the smallest doc with exactly the same text, for texts that several documents have."""
    hashed = texts.select("doc", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(7), F.reverse("text")).alias("y"), F.length("text").alias("z"))
    firsts = hashed.groupBy("x", "y", "z").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).filter("rep < top").drop("top")
    return hashed.join(firsts, ["x", "y", "z"]).select("doc", "rep").distinct()


def _buckets(texts: DataFrame, rows: float) -> int:
    """Buckets for so many hashes: as many as a shuffle has partitions, more where they would become too large."""
    return max(shuffle_partitions(texts.sparkSession), math.ceil(rows / BUCKET_ROWS))


def _windows_in_question(texts: DataFrame, classes: DataFrame, min_span: int, apart: bool) -> tuple[DataFrame, int]:
    """Stages 1 to 3, and the number of buckets."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = _buckets(texts, chars * len(COVER) / PERIOD)
    anchors = _by_bucket(_anchors(texts, min_span, buckets), buckets, _shared_anchors, "h long, doc long, pos long")
    copies = classes.filter("doc != rep").select("doc", F.lit(True).alias("copy"))
    anchors = cut_lineage(anchors.join(copies, "doc", "left").filter("copy is null").drop("copy"))
    real = anchors.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("h")
    per_doc = cut_lineage(anchors.join(real, "h").groupBy("doc").agg(F.collect_set("pos").alias("at")))
    size = per_doc.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    if 16 * size[0] + 8 * size[1] <= BROADCAST_LIMIT_BYTES // 4:
        per_doc = F.broadcast(per_doc)
    joined = texts.join(per_doc, "doc").select("doc", "text", "at")
    # a window for each character between the anchors of a run, and as many as the period at its ends
    buckets = _buckets(texts, size[1] * PERIOD / len(COVER) + 2 * PERIOD * size[0])
    return _full_windows(joined, min_span, buckets, apart), buckets


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents with a common span of min_span or more code points.

    One row a pair, also for exact copies; documents with null, empty or shorter texts and null keys have none, rows that
    come twice count once, other columns are not read, an empty table gives an empty result. The key must be a whole
    number. The result has as many rows as there are pairs, so a passage in k documents costs k * (k - 1) / 2 rows; they are
    made in tiles, by many tasks.
    """
    texts = spread(_texts(docs, key, text, min_span))
    classes = cut_lineage(_classes(texts))
    windows, buckets = _windows_in_question(texts, classes, min_span, False)
    members = cut_lineage(_by_bucket(windows, buckets, _sharing, "w long, v long, n long, doc long"))
    between = _pairs_of_members(members, ["w", "v"]).distinct()
    left, right = (classes.select(F.col("rep").alias(c), F.col("doc").alias(f"doc_{c}")) for c in ("a", "b"))
    full = between.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("doc_a", "a").alias("u"), F.coalesce("doc_b", "b").alias("v"))
    sizes = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    within = _pairs_of_members(classes.join(sizes, "rep"), ["rep"]).toDF("u", "v")
    return full.unionByName(within).select(F.least("u", "v").alias("doc_id_a"), F.greatest("u", "v").alias("doc_id_b"))


def shared_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """One row per document: doc_id, n_chars, spans (array of begin, end), shared_chars and shared_part of its text.

    A span is a maximal run of characters that lie in windows of min_span which other documents have too; a document
    with an exact copy elsewhere shares its whole text if that is long enough. Documents without a shared span have an
    empty array and 0; null and empty texts have 0 characters and part 0. Repeated rows of a key count once; null keys
    are left out. A hot passage is cheap here: no pairs are made.
    """
    texts = spread(_texts(docs, key, text, min_span))
    classes = cut_lineage(_classes(texts))
    windows, buckets = _windows_in_question(texts, classes, min_span, True)
    starts = _by_bucket(windows, buckets, _window_starts, "doc long, pos long")

    def merge(table: pa.Table) -> pa.Table:
        doc, pos = table.column("doc").to_numpy(), table.column("pos").to_numpy()
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + min_span)]))
        end = np.concatenate([begin[1:], [len(doc)]]) - 1
        return pa.table({"doc": doc[begin], "begin": pos[begin], "end": pos[end] + min_span})

    slots = 4 * shuffle_partitions(docs.sparkSession)
    spans = starts.withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(slots))).groupBy("slot").applyInArrow(merge, "doc long, begin long, end long")
    by_doc = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    members = classes.withColumnRenamed("doc", "member")
    by_doc = by_doc.join(members, by_doc["doc"] == members["rep"], "left").select(F.coalesce("member", "doc").alias("doc"), "spans")
    every = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long").alias("n_chars")).filter("doc is not null")
    every = every.groupBy("doc").agg(F.max("n_chars").alias("n_chars"))
    copied = classes.select("doc", F.lit(True).alias("copied"))
    none = F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_chars").alias("end")))
    out = every.join(by_doc, "doc", "left").join(copied, "doc", "left").withColumn("spans", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", none)))
    shared = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    part = F.coalesce(F.try_divide(shared.cast("double"), F.col("n_chars").cast("double")), F.lit(0.0))
    return out.select(F.col("doc").alias("doc_id"), "n_chars", "spans", shared.alias("shared_chars"), part.alias("shared_part"))
