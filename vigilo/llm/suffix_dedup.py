"""Suffix-array dedup with a logarithmic index family.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.

Suffixes are sparse and bucketed. Every ``LENGTH``-byte window chooses an
anchor, the smallest hashed ``ANCHOR``-gram in it, so equal windows choose equal
anchors wherever they stand; the windows of one anchor are shipped as one
short context to the anchor's bucket. Contexts that a task has already seen in
a smaller document are decided there and not shipped, so a passage that very
many documents share costs a bucket one context for each task.

A bucket takes its contexts in batches by document id. Each batch gets a suffix
array (its windows in the order of a 64-bit fingerprint of their ``LENGTH``
bytes) that is merge-scanned against the levels of the index for long matches;
then it becomes a level itself, and levels of like size merge until sizes grow
geometrically. A level keeps each distinct window once, with its smallest
document. Two different windows of one bucket share a fingerprint with a
chance of about windows^2 / 2^65: 1e-6 for a bucket of the default size.

What the buckets find goes back to blocks of documents, where the runs of
each are joined and cut from the whole text.

A null text is empty. Texts under ``LENGTH`` bytes lose nothing. Rows without
an id have no order: they stay whole and remove nothing. Rows that repeat an
id are each cut by smaller ids only, so exact repeats of a row stay. Other
columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilo.llm.common import arrow_schema, give_back, ranges
from vigilo.llm.ngram_join import mixed, multipliers

LENGTH = 50              # bytes of a match
ANCHOR = 12              # bytes of an anchor
PLACE_BITS = 22          # of a position in a chunk
SQUEEZE = 5              # level of compression of what is moved
SLICE = 1_000_000        # bytes of contexts fingerprinted together


@dataclass(frozen=True)
class Settings:
    bucket_bytes: int = 5_000_000    # of text for each bucket, about
    batch_windows: int = 500_000   # of a level-0 suffix array
    block_bytes: int = 8_000_000     # of text for each block of documents, about
    chunk_bytes: int = 2_000_000     # of texts that a task works on together
    piece_bytes: int = 1_000_000     # of a longer text, which comes in pieces


# ---- contexts ---------------------------------------------------------------


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; zeros beyond the end."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        out[:-step] |= out[step:] << np.uint64(8 * step)
    return out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    low, span = keys, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def anchored_spans(data: np.ndarray, piece_start: np.ndarray, piece_length: np.ndarray) -> tuple:
    """(piece, first window, windows, anchor place) of every run of windows
    with the same anchor, over the concatenated pieces."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    word = eight_bytes(data)
    gram = mixed(word)
    word = word[4:]
    word += np.uint64(0x9E3779B97F4A7C15)
    gram[:-4] ^= mixed(word)  # bytes 4 to 12
    del word
    place = np.uint64((1 << PLACE_BITS) - 1)
    gram &= ~place
    gram |= np.arange(len(gram), dtype=np.uint64)
    low = (window_minima(gram[:len(data) - ANCHOR + 1], LENGTH - ANCHOR + 1) & place).astype(np.int32)
    del gram
    windows = np.maximum(piece_length - LENGTH + 1, 0)
    start = ranges(piece_start, windows).astype(np.int32)
    piece = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    anchor = low[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
                           if len(start) else np.zeros(0, dtype=bool))
    count = np.diff(np.append(first, len(start)))
    return piece[first], start[first].astype(np.int64), count, anchor[first].astype(np.int64)


class Fingerprints:
    """Polynomial hashes modulo 2^64 of stretches of a byte array."""

    def __init__(self, most: int):
        base = int(multipliers(1, 3)[0])
        self.table = multipliers(256, 4)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, base, dtype=np.uint64)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, pow(base, -1, 1 << 64), dtype=np.uint64)]))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.table[data] * self.powers[:len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end) -> np.ndarray:
        return mixed((prefixes[end] - prefixes[start]) * self.inverses[start])


def pieces(texts: list[bytes], s: Settings) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text numbers, offsets, bytes) in chunks; a long text is cut into
    pieces that overlap so that each window is in exactly one."""
    which, offset, data, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), s.piece_bytes):
            part = text[at:at + s.piece_bytes + LENGTH - 1]
            if data and size + len(part) > s.chunk_bytes:
                yield which, offset, data
                which, offset, data, size = [], [], [], 0
            which.append(i)
            offset.append(at)
            data.append(part)
            size += len(part)
    if data:
        yield which, offset, data


SHIPPED = "bucket int, count int, local int, packed binary, contexts binary"


def shipper(buckets: int, keyed: bool, s: Settings) -> Callable:
    """Task function: rows (doc_id, row_key, text) to one row for each chunk and
    bucket. ``packed`` holds, for ``count`` contexts and then ``local`` decided
    runs: document ids (as differences), row keys if ``keyed``, starts, window
    counts and anchor offsets."""
    schema = arrow_schema(SHIPPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(s.chunk_bytes + s.piece_bytes + LENGTH)
        squeeze = zstandard.ZstdCompressor(level=SQUEEZE)
        for ids, keys, texts in row_chunks(batches, s):
            for which, offset, data in pieces(texts, s):
                out = chunk(ids, keys, np.array(which), np.array(offset), data, prints, squeeze)
                if out is not None:
                    yield out
        del prints
        give_back()

    def chunk(ids, keys, which, offset, data, prints, squeeze):
        length = np.array([len(d) for d in data], dtype=np.int64)
        start = np.cumsum(length) - length
        joined = np.frombuffer(b"".join(data), dtype=np.uint8)
        piece, lo, count, anchor = anchored_spans(joined, start, length)
        if not len(piece):
            return None
        prefixes = prints.prefixes(joined)
        whole = prints.of(prefixes, lo, lo + count + LENGTH - 1)
        doc, key = ids[which[piece]], keys[which[piece]]
        # Of equal contexts, those of the smallest document are shipped; the
        # others are decided here.
        order = np.argsort(whole)
        first = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
        smallest = np.empty(len(doc), dtype=np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(doc))))
        decided = doc > smallest
        anchors = prints.of(prefixes, anchor, anchor + ANCHOR)
        bucket = ((anchors >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(2 * bucket + decided, kind="stable")  # places ascend already
        bucket, decided, lo, count, doc, key, anchor = (x[order] for x in (bucket, decided, lo, count, doc, key, anchor))
        at = lo - start[piece[order]] + offset[piece[order]]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        rows = {"bucket": [], "count": [], "local": [], "packed": [], "contexts": []}
        a = 0
        for b in ends:
            shipped = int((~decided[a:b]).sum())
            context = joined[ranges(lo[a:a + shipped], count[a:a + shipped] + LENGTH - 1)].tobytes()
            packed = b"".join((np.diff(doc[a:b], prepend=0).tobytes(), key[a:b].tobytes() if keyed else b"",
                               at[a:b].astype(np.int64).tobytes(), count[a:b].astype(np.uint8).tobytes(),
                               (anchor - lo)[a:b].astype(np.uint8).tobytes()))
            rows["bucket"].append(int(bucket[a]))
            rows["count"].append(shipped)
            rows["local"].append(int(b - a - shipped))
            rows["packed"].append(squeeze.compress(packed))
            rows["contexts"].append(squeeze.compress(context))
            a = b
        return pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def row_chunks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc ids, row keys, texts as bytes) of about a chunk's size."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
            t = (t or "").encode()
            if texts and size + len(t) > s.chunk_bytes:
                yield np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int64), texts
                ids, keys, texts, size = [], [], [], 0
            ids.append(i)
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int64), texts


# ---- the index of a bucket --------------------------------------------------


class IndexFamily:
    """Levels of suffix arrays whose sizes grow geometrically. A level is
    (window fingerprints in order, smallest document of each)."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan_and_add(self, windows: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Whether each window of a new batch starts in a smaller document, in
        the batch or in a level; then the batch is added."""
        order = np.argsort(windows)
        keys, docs = windows[order], documents[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool))
        unique, least = keys[first], np.minimum.reduceat(docs, first) if len(first) else docs
        smallest = least.copy()
        for known, owner in self.levels:
            at = np.minimum(np.searchsorted(known, unique), len(known) - 1)
            smallest = np.where(known[at] == unique, np.minimum(smallest, owner[at]), smallest)
        found = np.empty(len(windows), dtype=bool)
        found[order] = docs > np.repeat(smallest, np.diff(np.append(first, len(keys))))
        self.add(unique, least)
        return found

    def add(self, keys: np.ndarray, owners: np.ndarray) -> None:
        if not len(keys):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            other, others = self.levels.pop()
            # Windows of the level that the smaller one knows too take the smaller owner;
            # the others of the smaller one are inserted at their places.
            at = np.searchsorted(other, keys)
            inside = np.minimum(at, len(other) - 1)
            both = other[inside] == keys
            others[inside[both]] = np.minimum(others[inside[both]], owners[both])
            keys, owners = np.insert(other, at[~both], keys[~both]), np.insert(others, at[~both], owners[~both])
        self.levels.append((keys, owners))


FOUND = "block int, spans binary"


def unpack(table: pa.Table, keyed: bool) -> tuple[dict, np.ndarray]:
    """Arrays of a bucket's contexts, their bytes joined, and the decided runs."""
    open_ = zstandard.ZstdDecompressor()
    kinds = (("doc", np.int64), ("key", np.int64), ("at", np.int64), ("count", np.uint8), ("offset", np.uint8))
    parts = {False: {k: [] for k, _ in kinds}, True: {k: [] for k, _ in kinds}}
    contexts = []
    for n, local, packed, context in zip(*(table.column(c).to_pylist() for c in ("count", "local", "packed", "contexts"))):
        data, place, total = open_.decompress(packed), 0, n + local
        for name, kind in kinds:
            if name == "key" and not keyed:
                column = documents
            else:
                column = np.frombuffer(data, dtype=kind, count=total, offset=place)
                place += column.nbytes
            if name == "doc":
                column = documents = np.cumsum(column)
            parts[False][name].append(column[:n])
            parts[True][name].append(column[n:])
        contexts.append(open_.decompress(context) if n else b"")
    joined = {d: {k: np.concatenate(v) for k, v in p.items()} for d, p in parts.items()}
    return joined, np.frombuffer(b"".join(contexts), dtype=np.uint8)


def shared_anchors(data: np.ndarray, start: np.ndarray, offset: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each context's anchor is in more than one document of the bucket."""
    gram = np.zeros(len(start), dtype=np.uint64)
    more = np.zeros(len(start), dtype=np.uint64)
    for k in range(8):
        gram |= data[start + offset + k].astype(np.uint64) << np.uint64(8 * k)
    for k in range(8, ANCHOR):
        more |= data[start + offset + k].astype(np.uint64) << np.uint64(8 * (k - 8))
    _, group = np.unique(mixed(gram) ^ mixed(more + np.uint64(1)), return_inverse=True)
    low = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    high = np.full(len(low), np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    return low[group] < high[group]


def bucket_scanner(blocks: int, keyed: bool, s: Settings) -> Callable:
    """Task function of one bucket: the runs of windows that start in a smaller
    document, by block of documents."""
    schema = arrow_schema(FOUND)

    def run(table: pa.Table) -> pa.Table:
        parts, data = unpack(table, keyed)
        del table
        own, local = parts[False], parts[True]
        length = own["count"].astype(np.int64) + LENGTH - 1
        start = np.cumsum(length) - length
        keys, ats, counts = [local["key"]], [local["at"]], [local["count"].astype(np.int64)]
        if len(start):
            use = np.flatnonzero(shared_anchors(data, start, own["offset"].astype(np.int64), own["doc"]))
            use = use[np.argsort(own["doc"][use], kind="stable")]
            rank = np.unique(own["doc"], return_inverse=True)[1].astype(np.int32)  # in the order of ids
            prints, index = Fingerprints(SLICE + 512), IndexFamily()
            sizes = np.cumsum(own["count"][use].astype(np.int64))
            lo = 0
            while lo < len(use):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + s.batch_windows)))
                batch = use[lo:hi]
                windows = np.concatenate([fingerprints(prints, data, start[b], length[b]) for b in slices(batch, length)])
                n = own["count"][batch].astype(np.int64)
                found = index.scan_and_add(windows, np.repeat(rank[batch], n))
                del windows
                # Runs of found windows within each context.
                context = np.repeat(np.arange(len(batch)), n)
                within = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
                edge = np.concatenate([[True], (context[1:] != context[:-1]) | (found[1:] != found[:-1])])
                runs = np.flatnonzero(edge)
                size = np.diff(np.append(runs, len(found)))
                hit = found[runs]
                runs, size = runs[hit], size[hit]
                keys.append(own["key"][batch][context[runs]])
                ats.append(own["at"][batch][context[runs]] + within[runs])
                counts.append(size)
                lo = hi
        key, at, count = (np.concatenate(x) for x in (keys, ats, counts))
        block = block_of(key, blocks)
        order = np.lexsort((at, key, block))
        block = block[order]
        rows = np.column_stack([key[order], at[order], count[order]])
        squeeze = zstandard.ZstdCompressor(level=3)
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)) if len(block) else []
        out = {"block": [], "spans": []}
        a = 0
        for b in ends:
            out["block"].append(int(block[a]))
            out["spans"].append(squeeze.compress(np.ascontiguousarray(rows[a:b].T).tobytes()))
            a = b
        del parts, data, own, local, rows, keys, ats, counts, key, at, count, order
        give_back()
        return pa.Table.from_pydict(out, schema=schema)

    return run


def slices(batch: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Contexts a bounded number of bytes at a time."""
    ends = np.cumsum(length[batch])
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
        yield batch[lo:hi]
        lo = hi


def fingerprints(prints: Fingerprints, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Fingerprints of all windows of some contexts."""
    prefixes = prints.prefixes(data[ranges(start, length)])
    first = ranges(np.cumsum(length) - length, length - LENGTH + 1)
    return prints.of(prefixes, first, first + LENGTH)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


# ---- documents --------------------------------------------------------------


def removed(size: int, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mask of the bytes under runs of windows."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + count + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cut(docs: DataFrame, finish: Callable, ddl: str, s: Settings = Settings()) -> DataFrame:
    """Find what repeats in ``docs`` and hand every row to ``finish``.

    ``finish(table, masks)`` gets some rows with all their columns and, for
    each, its text's bytes and the mask of those that go; it returns columns
    for ``ddl``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = (max(1, -(-total // n)) for n in (s.bucket_bytes, s.block_bytes))
    # A row is known by its id; only where ids repeat, by id and text.
    keyed = bool(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).collect())
    row_key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) if keyed else F.col("doc_id").cast("bigint")
    known = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), row_key.alias("row_key"), "text")
    found = (known.mapInArrow(shipper(buckets, keyed, s), SHIPPED).repartition(buckets, "bucket")
             .groupBy("bucket").applyInArrow(bucket_scanner(blocks, keyed, s), FOUND))
    # Column names that no input column has.
    longer = "_" * max([0, *(len(c) for c in docs.columns)])
    key_name, block_name = "_row_key" + longer, "_block" + longer
    rows = docs.withColumn(key_name, F.when(F.col("doc_id").isNotNull(), row_key))
    moved = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in rows.schema]
                         + [T.StructField(block_name, T.IntegerType())])
    moved_schema = to_arrow_schema(moved)

    def squeeze_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts are moved compressed, with the block they belong to."""
        squeeze = zstandard.ZstdCompressor(level=SQUEEZE)
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            keys = batch.column(key_name)
            block = block_of(keys.fill_null(0).to_numpy(zero_copy_only=False), blocks)
            for i in np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False)):
                block[i] = zlib.crc32(texts[i] or b"") % blocks
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"text": [None if t is None else squeeze.compress(t) for t in texts], block_name: block}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in ("text", block_name)
                                              else columns[f.name].cast(f.type) for f in moved_schema], schema=moved_schema)
        del squeeze
        give_back()

    schema = arrow_schema(ddl)

    def run(spans: pa.Table, table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(open_.decompress(x), dtype=np.int64).reshape(3, -1) for x in spans.column("spans").to_pylist()]
        key, at, count = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int64)
        order = np.argsort(key, kind="stable")
        key, at, count = key[order], at[order], count[order]
        row_keys = table.column(key_name).to_pylist()
        packed = table.column("text").to_pylist()
        whole = [None if t is None else open_.decompress(t) if t else b"" for t in packed]
        text = pa.array([None if t is None else t.decode() for t in whole], type=pa.string())
        table = table.drop_columns([key_name, block_name]).set_column(table.column_names.index("text"), "text", text)
        masks = []
        for k, data in zip(row_keys, whole):
            data = data or b""
            lo, hi = (np.searchsorted(key, k, side=x) for x in ("left", "right")) if k is not None else (0, 0)
            masks.append((data, removed(len(data), at[lo:hi], count[lo:hi])))
        out = pa.table(finish(table, masks), schema=schema)
        del masks, whole, text, table, spans
        give_back()
        return out

    return (found.groupBy("block").cogroup(rows.mapInArrow(squeeze_texts, moved).groupBy(block_name))
            .applyInArrow(run, ddl))


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document its bytes, those removed, their runs, and a digest of the rest."""
    def finish(table, masks):
        out = {"doc_id": table.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for data, gone in masks:
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    return cut(docs.select("doc_id", "text"), finish, DIGESTS, s)


def deduplicate(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text`` and ``n_chars`` (where
    there is one) counted anew. A character that lost some of its bytes goes;
    a null text stays null."""
    names = docs.columns

    def finish(table, masks):
        out = {c: table.column(c) for c in names}
        out["text"] = [None if t is None else np.frombuffer(d, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
                       for t, (d, gone) in zip(table.column("text").to_pylist(), masks)]
        if "n_chars" in names:
            out["n_chars"] = [None if t is None else len(t) for t in out["text"]]
        return out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return cut(docs, finish, ddl, s)
