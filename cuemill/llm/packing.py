"""Filling containers of fixed capacity with whole documents, the related ones together.

Method: lexical retrieval packing. Each shard holds an inverted index with BM25 weights over tokens.
The largest unused document seeds a container; the index returns its unused neighbours, which fill
the window greedily; the last stretch is filled with the subset of the nearest neighbours that comes
closest to the capacity.

Scale: the index is sharded by content. Items whose tokens are nearest to the same two of ``CLUSTERS``
centroids, which are fitted on at most ``SAMPLE`` documents, share a bucket; neighbouring buckets
fill shards of about ``shard_items``, and a bucket that is larger is cut by a hash of key and copy. So
neither a hot source nor repeated rows make a large shard, and a shard's memory and time are bounded.
Placement depends on keys and texts only: how the input is split, and a task tried again, change
nothing, but which of a key's repeated rows goes where. The few items of a shard's loose containers
meet those of ``LOOSE_SHARDS`` other shards once more. Items are written once; two shuffles, each of
token counts per document only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.encoding import _slices, shared_model, worker_encoder
from cuemill.llm.streams import to_batches
from cuemill.session import checkpoint

SHARD_ITEMS = 4096
#: Documents from which the shards' centroids are fitted, and the number of these.
SAMPLE, CLUSTERS = 2000, 64
#: Shards whose loose items are packed together in the second round.
LOOSE_SHARDS = 256
#: A container counts as loose below this share of its capacity.
LOOSE = 0.985
#: Neighbours among which the last stretch of a container is filled exactly.
NEIGHBOURS = 96
K1, B = 1.2, 0.75

_FOUND = pa.schema([("bucket", pa.int64()), ("copy", pa.int64()), ("key", pa.string()), ("piece_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
_FOUND_SQL = "bucket bigint, copy bigint, key string, piece_no bigint, start_token bigint, n_tokens bigint, terms binary, counts binary"
_ITEM = pa.schema([("shard", pa.int64()), ("key", pa.string()), ("piece_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
_ITEM_SQL = "shard bigint, key string, piece_no bigint, start_token bigint, n_tokens bigint, terms binary, counts binary"
_PLACED = pa.schema([("skey", pa.int64()), ("container", pa.int64()), ("place", pa.int64()), *list(_ITEM)[1:]])
_PLACED_SQL = "skey bigint, container bigint, place bigint, " + _ITEM_SQL.split(", ", 1)[1]
_OUT = pa.schema([("container_id", pa.int64()), ("place", pa.int64()), ("key", pa.string()), ("piece_no", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])
_OUT_SQL = "container_id bigint, place bigint, key string, piece_no bigint, start_token bigint, n_tokens bigint"


class Index:
    """An inverted index of one shard with BM25 weights; terms in more than half of the items say
    nothing about them and have no weight."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        self.n = len(terms)
        lengths = np.array([c.sum() for c in counts], np.float64)
        term = np.concatenate(terms) if self.n else np.zeros(0, np.int32)
        item = np.repeat(np.arange(self.n), [len(t) for t in terms])
        count = np.concatenate(counts).astype(np.float64) if self.n else np.zeros(0)
        known, number, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0.0)
        weight = idf[number] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[item] / max(lengths.mean() if self.n else 1.0, 1.0)))
        kept = weight > 0
        order = np.argsort(number[kept], kind="stable")
        self._items, self._weights = item[kept][order], weight[kept][order]
        self._starts = np.searchsorted(number[kept][order], np.arange(len(known) + 1))
        ends = np.cumsum([len(t) for t in terms]) if self.n else np.zeros(0, np.int64)
        self._numbers = [number[e - len(t) : e] for e, t in zip(ends, terms, strict=True)]

    def keep(self, wanted: np.ndarray) -> None:
        """Leaves the postings of unwanted items out, which then score 0; weights stay as they are."""
        kept = wanted[self._items]
        self._starts = np.concatenate([[0], np.cumsum(kept)])[self._starts]
        self._items, self._weights = self._items[kept], self._weights[kept]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every item for the terms of ``seed``."""
        numbers = self._numbers[seed]
        first, last = self._starts[numbers], self._starts[numbers + 1]
        lengths = last - first
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.n)
        postings = np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1])
        return np.bincount(self._items[postings], self._weights[postings], self.n)


def best_subset(sizes: list[int], space: int) -> list[int]:
    """Positions of items whose sizes sum up to as much of ``space`` as possible, early ones preferred."""
    mask = (1 << space + 1) - 1
    reach = [1]
    for size in sizes:
        reach.append(reach[-1] | reach[-1] << size & mask)
    total, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(sizes), 0, -1):
        if not reach[i - 1] >> total & 1:
            chosen.append(i - 1)
            total -= sizes[i - 1]
    return chosen[::-1]


def pack(sizes: list[int], terms: list[np.ndarray], counts: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers as lists of item positions; every item is in exactly one. Sizes are 0 to ``capacity``."""
    n = len(sizes)
    size = np.array(sizes, np.int64)
    index = Index(terms, counts)
    free = np.ones(n, bool)
    containers: list[list[int]] = []
    indexed = n
    for seed in np.argsort(-size, kind="stable").tolist():
        if not free[seed] or (size[seed] == 0 and containers):
            continue
        free[seed] = False
        chosen, space = [seed], int(capacity - size[seed])
        fits = free & (size <= space) & (size > 0)
        if fits.any():
            if (left := int(free.sum())) < 0.75 * indexed:
                index.keep(free)
                indexed = left
            score = index.scores(seed)
            near = np.flatnonzero(fits)
            near = near[np.argsort(-score[near], kind="stable")]
            sizes_near = size[near]
            position = 0
            while position < len(near) and space > capacity // 2:
                if sizes_near[position] <= space:
                    chosen.append(int(near[position]))
                    free[near[position]] = False
                    space -= int(sizes_near[position])
                position += 1
            rest = near[position:]
            rest = rest[size[rest] <= space][:NEIGHBOURS]
            if len(rest) and size[rest].sum() > 0:
                for i in best_subset(size[rest].tolist(), space):
                    chosen.append(int(rest[i]))
                    free[rest[i]] = False
                    space -= int(size[rest[i]])
            loose = np.flatnonzero(free & (size > 0) & (size <= space))
            while len(loose):
                item = int(loose[np.argmax(size[loose])])
                chosen.append(item)
                free[item] = False
                space -= int(size[item])
                loose = np.flatnonzero(free & (size > 0) & (size <= space))
        containers.append(chosen)
    if containers:
        containers[-1] += [int(i) for i in np.flatnonzero(free)]
    return containers


class Centroids:
    """Directions of term vectors, fitted by spherical k-means; the weight of a term falls with the share
    of the fitted documents that have it."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], clusters: int, rounds: int = 8):
        size = 1 + max((int(t.max()) for t, _ in vectors if len(t)), default=0)
        df = np.zeros(size)
        for terms, _ in vectors:
            df[terms] += 1
        self._idf = np.log((len(vectors) + 1) / (df + 0.5)).astype(np.float32)
        units = [(terms, self._unit(terms, counts)) for terms, counts in vectors if len(terms)]
        k = max(1, min(clusters, len(units)))
        self._weights = np.zeros((size, k), np.float32)
        for i in range(k if units else 0):
            terms, unit = units[i * len(units) // k]
            self._weights[terms, i] = unit
        for _ in range(rounds if units else 0):
            moved = np.zeros_like(self._weights)
            for terms, unit in units:
                moved[terms, int((unit @ self._weights[terms]).argmax())] += unit
            norm = np.sqrt((moved * moved).sum(0))
            self._weights = np.where(norm > 0, moved / np.maximum(norm, 1e-9), self._weights)
        self._weights = np.ascontiguousarray(self._weights[:, self._chain()])

    def _chain(self) -> list[int]:
        """The centroids in an order in which each is followed by the nearest of those left."""
        near = self._weights.T @ self._weights
        order, left = [0], set(range(1, near.shape[0]))
        while left:
            order.append(max(left, key=lambda i: (near[order[-1], i], -i)))
            left.remove(order[-1])
        return order

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts).astype(np.float32) * self._idf[terms]
        return x / max(float(np.sqrt((x * x).sum())), 1e-9)

    def bucket(self, terms: np.ndarray, counts: np.ndarray) -> int:
        """The nearest and the second nearest centroid as one number; 0 for no terms that are known."""
        known = terms < len(self._idf)
        terms, counts = terms[known], counts[known]
        if not len(terms):
            return 0
        near = self._unit(terms, counts) @ self._weights[terms]
        first = int(near.argmax())
        near[first] = -1
        return first * CLUSTERS + int(near.argmax())


def shards_of_buckets(counts: dict[int, int], shard_items: int) -> tuple[list[tuple[int, int, int]], int]:
    """(bucket, first shard, number of shards) of each bucket, and the number of all shards. Neighbouring
    buckets share a shard while they fit; a larger one has its own."""
    out: list[tuple[int, int, int]] = []
    shard = filled = 0
    for bucket in sorted(counts):
        n = counts[bucket]
        if filled and filled + n > shard_items:
            shard, filled = shard + 1, 0
        parts = max(1, -(-n // shard_items))
        out.append((bucket, shard, parts))
        if parts > 1:
            shard, filled = shard + parts, 0
        else:
            filled += n
    return out, shard + (filled > 0)


def _arrays(rows: list[tuple]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    return [r[-3] for r in rows], [np.frombuffer(r[-2], np.int32) for r in rows], [np.frombuffer(r[-1], np.uint16) for r in rows]


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.unique(ids, return_counts=True)
    return terms.astype(np.int32), np.minimum(counts, 65535).astype(np.uint16)


def fit_centroids(texts: DataFrame, shared, capacity: int, sample: int, clusters: int) -> Centroids:
    """Centroids of the documents (key, text) whose keys have the ``sample`` least hashes, each key once
    and with at most ``capacity`` tokens."""
    hashed = texts.where("text is not null").select(F.xxhash64("key").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Centroids([], clusters)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, counts = _terms(np.array(encoder.ids(text)[:capacity], np.int32))
                yield pa.RecordBatch.from_pydict({"h": [h], "terms": [terms.tobytes()], "counts": [counts.tobytes()]}, schema=pa.schema([("h", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())]))

    chosen = hashed.where(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))
    rows = sorted(chosen.mapInArrow(encode, "h bigint, terms binary, counts binary").collect())
    return Centroids([(np.frombuffer(bytes(r.terms), np.int32), np.frombuffer(bytes(r.counts), np.uint16)) for r in rows], clusters)


def pack_documents(documents: DataFrame, key: str, text: str, *, capacity: int, shard_items: int = SHARD_ITEMS, sample: int = SAMPLE, clusters: int = CLUSTERS, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """container_id, place (from 1), ``key``, piece_no, start_token (from 0), n_tokens.

    Every row is in one container, whole, unless its text alone has more tokens than ``capacity``:
    then pieces of just the capacity fill containers of their own and the rest is packed like a row.
    Null and empty texts have no tokens; each is in some container and takes no space. Repeated rows
    are packed each. Other columns are ignored; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if not 1 <= clusters <= CLUSTERS:
        raise ValueError(f"clusters must be 1 to {CLUSTERS}")
    shared = shared_model(documents, path, pattern)
    spark = documents.sparkSession
    texts = documents.select(documents[key].cast("string").alias("key"), documents[text].cast("string").alias("text"))
    fitted = spark.sparkContext.broadcast(fit_centroids(texts, shared, capacity, sample, clusters))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        def rows() -> Iterator[tuple]:
            encoder = worker_encoder(shared)
            seen: Counter = Counter()
            for batch in batches:
                for part in _slices(batch, 1):
                    lists = encoder.batch_ids(part.column(1).to_pylist())
                    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                    for row, name in enumerate(part.column(0).to_pylist()):
                        ids = values[offsets[row] : offsets[row + 1]]
                        copy = seen[name]
                        seen[name] += 1
                        whole = len(ids) // capacity if len(ids) > capacity else 0
                        for piece in range(whole):
                            yield -1, copy, name, piece + 1, piece * capacity, capacity, b"", b""
                        rest = ids[whole * capacity :]
                        if len(rest) or not whole:
                            terms, counts = _terms(rest)
                            yield fitted.value.bucket(terms, counts), copy, name, whole + 1, whole * capacity, len(rest), terms.tobytes(), counts.tobytes()

        yield from to_batches(rows(), _FOUND, 1024)

    found = checkpoint(texts.mapInArrow(items, _FOUND_SQL))
    # Buckets are pairs of centroids: at most CLUSTERS squared.
    sizes = {r.bucket: r["count"] for r in found.where("bucket >= 0").groupBy("bucket").count().collect()}
    known, shards = shards_of_buckets(sizes, shard_items)
    placed_in = F.broadcast(spark.createDataFrame([*known, (-1, 0, max(shards, 1))], "bucket bigint, first bigint, parts bigint"))
    shard = F.col("first") + F.pmod(F.xxhash64("key", "copy", "piece_no"), F.col("parts"))
    sharded = found.join(placed_in, "bucket").select(F.when(F.col("bucket") < 0, -1 - shard).otherwise(shard).alias("shard"), *_ITEM.names[1:])

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def place(shard: int, rows: list[tuple]) -> Iterator[tuple]:
            rows.sort(key=lambda r: (r[1] is None, r[1] or "", r[2]))
            if shard < 0:
                for number, row in enumerate(rows):
                    yield -1 - (zlib.crc32(f"{shard}:{number}".encode())), (shard << 24) - number, 1, *row[1:5], b"", b""
                return
            for number, chosen in enumerate(pack(*_arrays(rows), capacity)):
                loose = sum(rows[i][4] for i in chosen) < LOOSE * capacity
                for position, i in enumerate(chosen):
                    if loose:
                        yield shard // LOOSE_SHARDS, -1, 0, *rows[i][1:]
                    else:
                        yield -1 - zlib.crc32(f"{shard}:{number}".encode()), shard << 24 | number, position + 1, *rows[i][1:5], b"", b""

        def out() -> Iterator[tuple]:
            current, rows = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[0] != current and rows:
                        yield from place(current, rows)
                        rows = []
                    current = row[0]
                    rows.append(row)
            if rows:
                yield from place(current, rows)

        yield from to_batches(out(), _PLACED, 1024)

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def place(group: int, rows: list[tuple]) -> Iterator[tuple]:
            rows.sort(key=lambda r: (r[3] is None, r[3] or "", r[4]))
            for begin in range(0, len(rows), shard_items):
                part = rows[begin : begin + shard_items]
                for number, chosen in enumerate(pack(*_arrays(part), capacity)):
                    for position, i in enumerate(chosen):
                        yield 1 << 62 | group << 32 | begin + number, position + 1, *part[i][3:7]

        def out() -> Iterator[tuple]:
            current, rows = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[0] < 0:
                        yield row[1], row[2], *row[3:7]
                        continue
                    if row[0] != current and rows:
                        yield from place(current, rows)
                        rows = []
                    current = row[0]
                    rows.append(row)
            if rows:
                yield from place(current, rows)

        yield from to_batches(out(), _OUT)

    key_type = documents.schema[key].dataType.simpleString()
    by_shard = sharded.repartition("shard").sortWithinPartitions("shard")
    placed = by_shard.mapInArrow(first_round, _PLACED_SQL).repartition("skey").sortWithinPartitions("skey")
    packed = placed.mapInArrow(second_round, _OUT_SQL)
    return packed.withColumn("key", packed["key"].cast(key_type)).withColumnRenamed("key", key)
