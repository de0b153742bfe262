"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two link when the Jaccard similarity
of their sets is at least the threshold.

1. Documents with equal sets are one class; its smallest id represents it.
2. MinHash bands bring representatives together (a pair at the threshold is
   missed with a probability below 1e-7). Bands give links to the smallest
   id only, and their components are the groups inside which pairs are
   compared: no pair is written out.
3. In a group, MinHash values are compared a few at a time. After each step a
   pair is dropped when the posterior probability (uniform prior) that its
   similarity reaches the threshold is below the tolerance.
4. The rest is verified on the whole sets. A group beyond a block's size is
   compared block against block in separate tasks.

The result counts every link: for a document, the number of other documents
with similarity at or above the threshold (copies included), and the smallest
id of its class of linked documents.

A text of fewer than five words is one shingle of all its words. Null texts
and texts without words have no set and no links, and are classes of their
own. Rows without an id take no part and get a null class. Rows that repeat an
id count as one document. Ties do not arise: links are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import arrow_schema, give_back, ranges, text_chunks, to_batch, written
from vigilo.llm.graph import components

CHUNK = 4_000_000


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: str = "0.8"       # an exact decimal
    bands: int = 32
    band_rows: int = 4
    step: int = 16               # hashes compared before the posterior is looked at
    tolerance: float = 1e-6
    block_rows: int = 2_048      # documents of a group that are compared in one task
    group_rows: int = 2_048      # documents of small groups that share a task, about
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], words: int, known: dict[bytes, int]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    factors = multipliers(words, 1)
    if len(known) > 200_000:
        known.clear()
    out = []
    for text in texts:
        tokens = text.encode().split()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        if len(h) >= words:
            n = len(h) - words + 1
            out.append(np.unique(mixed(sum(h[k:k + n] * factors[k] for k in range(words)))))
        else:
            out.append(mixed((h * factors[:len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h)
    return out


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of one set."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at:at + 1024, None] * factors[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, s: Settings) -> np.ndarray:
    parts = sig.reshape(s.bands, s.band_rows).astype(np.uint64)
    key = np.arange(s.bands, dtype=np.uint64)
    for k in range(s.band_rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.astype(np.int64)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, d1, d2, n, keys): digest and size of each set, and its band keys."""
    ddl = "doc_id bigint, d1 bigint, d2 bigint, n int, keys array<bigint>"
    schema = arrow_schema(ddl)

    def run(batches):
        factors, known = multipliers(s.hashes, s.seed), {}
        for ids, texts in text_chunks(batches, CHUNK):
            out = {"doc_id": ids, "d1": [], "d2": [], "n": [], "keys": []}
            done: dict = {}  # copies in the chunk are sketched once
            for shingles in shingle_sets(texts, s.words, known):
                digest = xxhash.xxh128_digest(shingles.tobytes())
                if digest not in done:
                    done[digest] = band_keys(signature(shingles, factors), s) if len(shingles) else []
                out["d1"].append(int.from_bytes(digest[:8], "little", signed=True))
                out["d2"].append(int.from_bytes(digest[8:], "little", signed=True))
                out["n"].append(len(shingles))
                out["keys"].append(done[digest])
            yield to_batch(out, schema)
        known.clear()
        give_back()

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, ddl)


def least_matches(s: Settings) -> dict[int, int]:
    """For each number of hashes compared, the matches below which a pair is
    dropped: with a uniform prior the posterior P(similarity >= t | m of n) is
    P(Binomial(n + 1, t) <= m)."""
    t = float(Fraction(s.threshold))
    out = {}
    for n in range(s.step, s.hashes + 1, s.step):
        total, m = 0.0, -1
        while total < s.tolerance:
            m += 1
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def similar_pairs(left: np.ndarray, right: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, flat: np.ndarray,
                  starts: np.ndarray, s: Settings, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of ``left`` x ``right`` (places; only left < right if they are the same block)."""
    t = Fraction(s.threshold)
    same = left is right
    values, ids = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(values), dtype=bool)
    found_a, found_b = [], []
    for k, a in enumerate(left):
        others = right[k + 1:] if same else right
        # Sizes alone bound the similarity.
        lo, hi = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        others = others[lo * t.denominator >= hi * t.numerator]
        matches = np.zeros(len(others), dtype=np.int64)
        for n, m in least.items():
            if not len(others):
                break
            matches += (sigs[others, n - s.step:n] == sigs[a, n - s.step:n]).sum(axis=1)
            keep = matches >= m
            others, matches = others[keep], matches[keep]
        if not len(others):
            continue
        own = ids[starts[a]:starts[a] + sizes[a]]
        marked[own] = True
        for at in range(0, len(others), 4_096):
            b = others[at:at + 4_096]
            hits = marked[ids[ranges(starts[b], sizes[b])]]
            common = np.add.reduceat(hits, np.cumsum(sizes[b]) - sizes[b], dtype=np.int64)
            linked = b[common * t.denominator >= t.numerator * (sizes[a] + sizes[b] - common)]
            found_a.append(np.full(len(linked), a))
            found_b.append(linked)
        marked[own] = False
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


LINKED = "doc_id bigint, links bigint, root bigint"


def comparer(s: Settings):
    """Function of one task's documents: their links, and the smallest linked one."""
    schema = arrow_schema(LINKED)

    def run(table: pa.Table) -> pa.Table:
        factors, least = multipliers(s.hashes, s.seed), least_matches(s)
        ids = table.column("doc_id").to_numpy()
        # A repeated row stands next to its like; one of them is enough.
        order = np.lexsort((ids, table.column("component").to_numpy()))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        table = table.take(pa.array(order))
        ids, group = ids[order], table.column("component").to_numpy()
        block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        out = {"doc_id": [], "links": [], "root": []}
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        lo = 0
        for hi in ends:
            own = sets[lo:hi]
            sizes = np.array([len(x) for x in own])
            starts = np.cumsum(sizes) - sizes
            sigs = np.stack([signature(x, factors) for x in own])
            first = np.flatnonzero(block[lo:hi] == block[lo:hi].min())
            second = np.flatnonzero(block[lo:hi] != block[lo:hi].min())
            i, j = (table.column(c)[lo].as_py() for c in ("i", "j"))
            if i == j:
                second = first
            a, b = similar_pairs(first, second, sigs, sizes, np.concatenate(own), starts, s, least)
            weight = copies[lo:hi]
            links = (np.bincount(a, weights=weight[b], minlength=hi - lo)
                     + np.bincount(b, weights=weight[a], minlength=hi - lo)).astype(np.int64)
            root = local_roots(hi - lo, a, b)
            has = np.flatnonzero(links)
            out["doc_id"].append(ids[lo:hi][has])
            out["links"].append(links[has])
            out["root"].append(ids[lo:hi][root[has]])
            lo = hi
        return pa.table({k: np.concatenate(v) for k, v in out.items()}, schema=schema)

    return run


def representatives(sketched: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, copies, keys): the smallest document of each set."""
    return (sketched.where("n > 0").groupBy("d1", "d2")
            .agg(F.min(F.struct("doc_id", "keys")).alias("least"), F.count(F.lit(1)).alias("copies"))
            .select(F.col("least.doc_id").alias("doc_id"), "d1", "d2", "copies", F.col("least.keys").alias("keys")))


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(doc_id, component): representatives that share a band, by component."""
    bands = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = (bands.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
              .where("low < high").select("key", "low"))
    links = bands.join(shared, "key").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    return components(links).select(F.col("vertex").alias("doc_id"), F.col("smallest").alias("component"))


def compare(docs: DataFrame, reps: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, links, root) of the representatives that link within their groups."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / s.block_rows).cast("int")
    members = (groups.join(sizes, "component").select("doc_id", "component", blocks.alias("blocks"))
               .join(reps.select("doc_id", "copies"), "doc_id"))
    n_tasks = max(1, -(-groups.count() // s.group_rows))
    texts = docs.select(F.col("doc_id"), "text").join(members, "doc_id").select("doc_id", "text", "component", "blocks", "copies")
    ddl = "doc_id bigint, component bigint, blocks int, copies bigint, shingles binary"
    schema = arrow_schema(ddl)

    def run(batches):
        known: dict = {}
        for batch in batches:
            c = batch.to_pydict()
            sets = shingle_sets([t or "" for t in c["text"]], s.words, known)
            full = [k for k, x in enumerate(sets) if len(x)]
            yield to_batch({**{n: [c[n][k] for k in full] for n in ("doc_id", "component", "blocks", "copies")},
                            "shingles": [sets[k].tobytes() for k in full]}, schema)
        known.clear()
        give_back()

    rows = texts.mapInArrow(run, ddl).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A block meets every block of its group, itself included; one block: itself only.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(n_tasks))).otherwise(F.col("component"))
    rows = rows.withColumn("task", task).withColumn("whole", F.col("blocks") == 1)
    return rows.groupBy("whole", "task", "i", "j").applyInArrow(comparer(s), LINKED)


def jaccard_join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document.

    ``n_copies`` counts the documents with the same set, itself included.
    """
    sketched = written(sketches(docs, s), "sketches")
    reps = written(representatives(sketched), "representatives")
    groups = written(candidate_groups(reps), "groups")
    linked = written(compare(docs, reps, groups, s), "linked")
    links = linked.groupBy("doc_id").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    decided = (reps.select(F.col("doc_id").alias("rep"), "d1", "d2", "copies")
               .join(links.withColumnRenamed("doc_id", "rep"), "rep", "left")
               .join(classes.withColumnRenamed("vertex", "rep"), "rep", "left")
               .select("d1", "d2", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                       F.coalesce("smallest", "rep").alias("class")))
    own = sketched.select("doc_id", "d1", "d2", "n")
    full = own.where("n > 0").join(decided, ["d1", "d2"]).select(
        "doc_id", F.col("class").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"))
    rest = own.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
                                     F.lit(1).cast("bigint").alias("n_copies"))
    nameless = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("bigint").alias("class_id"),
                                                   F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return full.unionByName(rest).unionByName(nameless)


def representatives_only(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with all
    their columns; of rows that repeat an id, all stay or go. Rows without an
    id stay."""
    joined = jaccard_join(docs, s)
    # A column name that no input column has.
    other = "_other" + "_" * max([0, *(len(c) for c in docs.columns)])
    others = joined.where("doc_id IS NOT NULL AND class_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(others, docs["doc_id"] == others[other], "left_anti")
