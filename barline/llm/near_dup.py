"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

1. A document's word shingles are hashed; each falls into one of many buckets, and a bucket
   keeps its smallest value as a leading-zero count and some mantissa bits in 16 bits.  For its
   bands, an empty bucket borrows the register of the first used one in an order of its own, so
   every register agrees with the probability of the similarity, in sets of any size.
2. Documents of equal sets are one class from here on, named by its smallest id.
3. Bands of five registers meet by a join.  In a bucket of a band every class is paired with the
   smallest one only; each class takes the partner it shares most bands with.  These pairs
   are confirmed on the full sets and give first components.
4. Classes that share several bands with their partner form families.  A family of several
   components is compared in blocks of bounded size, by counts of common shingles, and gives
   links that connect what is alike, not pairs.
5. Buckets that hold several families pair what lies outside their largest one with the
   rest, after a size test and a corrected estimate from the registers.  Confirmed pairs are
   added.  Pairs inside a component can't change the answer and are never made.

No bucket, group or number of partners is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import linked
from .graph import Scratch
from .tables import map_batches, row_blocks, text_bytes
from .words import LOWER, find_words, hash_words, joined_hash, mixed

EMPTY = 0xFFFF


@dataclass(frozen=True)
class Near:
    """Shingles of so many words are alike from so many hundredths on.

    48 bands of 5 registers miss a pair at 0.8 with probability 5e-9.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    registers: int = 5  # of a band
    mantissa: int = 10
    broadcast_ids: int = 500_000  # ids of 8 bytes that may be broadcast; more are joined by a shuffle
    task_shingles: int = 400_000  # shingles compared with one document in one task
    block_shingles: int = 200_000  # shingles of a block of a family, each document counting as document_cost more
    document_cost: int = 100


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each row, in order.

    Only A-Z are lower-cased.  Fewer words than a shingle has are one shingle; no word, none.
    """
    raw = LOWER[raw]
    starts, ends, rows = find_words(raw, offsets)
    words = hash_words(raw, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    hashes, owners = [], []
    for size in range(1, width + 1):
        picked = count >= width if size == width else count == size
        first = np.flatnonzero(picked[rows]) if len(rows) else rows
        first = first[first + size <= len(rows)]
        first = first[rows[first + size - 1] == rows[first]]
        if len(first):
            hashes.append(joined_hash(*(words[first + k] for k in range(size))))
            owners.append(rows[first])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return owners[new], hashes[new]


def registers(rows: np.ndarray, hashes: np.ndarray, count: int, p: Near) -> np.ndarray:
    """HyperMinHash registers: the smallest value of each bucket as zeros and mantissa; EMPTY without one."""
    size = p.bands * p.registers
    least = np.full(count * size, np.uint64(1 << 63))
    values = mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    bucket = ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, rows * size + bucket, (values >> np.uint64(11)) + np.uint64(1))
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(54 - exponent, 0, 62)
    bits = ((fraction - 0.5) * 2 * (1 << p.mantissa)).astype(np.int64)
    packed = (zeros << p.mantissa | bits).astype(np.uint16)
    packed[least == np.uint64(1 << 63)] = EMPTY
    return packed.reshape(count, size)


def densified(packed: np.ndarray, probes: int = 16) -> np.ndarray:
    """Registers in which an empty bucket holds that of the first used one in its own random order.

    Rows without any register stay empty.  The first probes are made for all rows at once; rows
    with few used buckets then look for the least rank among these.
    """
    size = packed.shape[1]
    order = np.argsort(mixed(np.arange(1, size * size + 1, dtype=np.uint64)).reshape(size, size), axis=1)
    out = packed.copy()
    for k in range(min(probes, size)):
        row, at = np.nonzero(out == EMPTY)
        out[row, at] = packed[row, order[at, k]]
    rank = np.argsort(order, axis=1)
    for row in np.flatnonzero((out == EMPTY).any(1) & (packed != EMPTY).any(1)):
        used, left = np.flatnonzero(packed[row] != EMPTY), np.flatnonzero(out[row] == EMPTY)
        out[row, left] = packed[row, used[rank[left][:, used].argmin(1)]]
    return out


def band_keys(packed: np.ndarray, p: Near) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every band of the rows that have a register in use."""
    parts = densified(packed).reshape(len(packed), p.bands, p.registers)
    used = np.repeat((packed != EMPTY).any(1), p.bands)
    keys = joined_hash(*(parts[:, :, k].ravel().astype(np.uint64) for k in range(p.registers)))
    keys = joined_hash(keys, np.tile(np.arange(p.bands, dtype=np.uint64), len(packed)))
    at = np.flatnonzero(used)
    return at // p.bands, keys[at].view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, p: Near) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of rows of registers, corrected for chance collisions, and the registers it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    count = used.sum(1)
    share = ((a == b) & used).sum(1) / np.maximum(count, 1)
    chance = 1 / 3 / (1 << p.mantissa)  # equal zeros, then equal mantissas
    return np.maximum(share - chance, 0) / (1 - chance), count


def sketches(docs: DataFrame, p: Near) -> DataFrame:
    """doc_id, n, two digests of the set, and the registers of every whole text."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        n, first, second, packed = [], [], [], []
        for a, b in row_blocks(offsets):
            rows, hashes = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.words)
            n.append(np.bincount(rows, minlength=b - a))
            at = np.searchsorted(rows, np.arange(b - a + 1))
            for sums, salt in ((first, 1), (second, 2)):
                total = np.concatenate([[0], np.cumsum(mixed(hashes + np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            packed += [r.tobytes() for r in registers(rows, hashes, b - a, p)]
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.record_batch(
            [batch.column("doc_id"), join(n), join(first), join(second), pa.array(packed, pa.binary())], ["doc_id", "n", "d1", "d2", "registers"]
        )

    return map_batches(docs.select("doc_id", "text"), sketch, "doc_id long, n long, d1 long, d2 long, registers binary")


def _bands(classes: DataFrame, p: Near) -> DataFrame:
    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        rows, keys = band_keys(packed, p)
        at = pa.array(rows)
        return pa.record_batch([pa.array(keys), batch.column("id").take(at), batch.column("n").take(at)], ["key", "id", "n"])

    return map_batches(classes.select("id", "n", "registers"), split, "key long, id long, n long")


def _only(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """docs joined with ids(doc_id, ...); broadcast while their number is below the bound."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id")


def _with_sets(texts: DataFrame, other: str, kind: str, p: Near) -> DataFrame:
    """doc_id, hashes (bytes of the sorted set) and one more column of texts(doc_id, text, ...)."""

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column("text"))
        sets = []
        for a, b in row_blocks(offsets):
            rows, hashes = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.words)
            sets += [s.tobytes() for s in np.split(hashes, np.searchsorted(rows, np.arange(1, b - a)))]
        return pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.binary()), batch.column(other)], ["doc_id", "hashes", other])

    return map_batches(texts.select("doc_id", "text", other), shingles, f"doc_id long, hashes binary, {other} {kind}")


def common_shingles(sets: list[np.ndarray], at_once: int = 2048) -> np.ndarray:
    """How many shingles each two sets have in common."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.flatnonzero(seen > 1)
    place = np.full(len(kinds), -1)
    place[several] = np.arange(len(several))
    place = place[number]
    order = np.argsort(place, kind="stable")
    place, owners = place[order], owners[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, len(several), at_once):
        own = slice(*np.searchsorted(place, [first, first + at_once]))
        table = np.zeros((len(sets), at_once), np.float32)
        table[owners[own], place[own] - first] = 1
        both += table @ table.T
    return both.astype(np.int64)


def family_links(docs: DataFrame, rows: DataFrame, p: Near, scratch: Scratch) -> DataFrame:
    """Links (u, v) that connect all like documents of each family of rows(family, id, n).

    A family is dealt into blocks of about block_shingles; every two blocks meet in one task,
    which returns at most one link for each document.
    """
    loads = rows.groupBy("family").agg(F.ceil(F.sum(F.col("n") + p.document_cost) / p.block_shingles).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    other = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct("family", F.least(block, k).alias("low"), F.greatest(block, k).alias("high"), block.alias("own")),
    )
    roles = scratch.write(rows.join(loads, "family").select(F.col("id").alias("doc_id"), other.alias("meets")))

    def compare(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("hashes", "ascending")])
        ids, own = part.column("doc_id").to_numpy(), part.column("own").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        both = common_shingles(sets)
        alike = (both > 0) & (100 * both >= p.percent * (sizes[:, None] + sizes[None] - both))
        if (own != own[0]).any():  # two blocks: the pairs inside one are another task's
            alike &= own[:, None] != own[None]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label, np.where(alike, label[None], len(ids)).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": ids[label[at]], "v": ids[at]})

    kind = "array<struct<family:long,low:long,high:long,own:long>>"
    sets = _with_sets(_only(docs.select("doc_id", "text"), roles, p.broadcast_ids), "meets", kind, p)
    moved = sets.select("doc_id", "hashes", F.explode("meets").alias("meet")).select("doc_id", "hashes", "meet.*")
    return moved.groupBy("family", "low", "high").applyInArrow(compare, "u long, v long")


def confirmed(docs: DataFrame, pairs: DataFrame, p: Near, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose full sets are alike.

    Rows of v travel to u; u with very many partners is spread over several tasks.  A task
    holds one set of u at a time and streams its partners past it.
    """
    pairs = scratch.write(pairs.select("u", "v", "n"))
    load = pairs.groupBy("u").agg(F.ceil(F.sum("n") / p.task_shingles).alias("parts"))
    to = pairs.join(load, "u").select(
        F.col("v").alias("doc_id"),
        F.struct(F.col("u"), F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"), F.lit(1).alias("role")).alias("place"),
    )
    own = load.select(
        F.col("u").alias("doc_id"),
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.col("u"), k.alias("part"), F.lit(0).alias("role")))).alias("place"),
    )
    roles = scratch.write(to.unionByName(own).groupBy("doc_id").agg(F.collect_list("place").alias("places")))

    kind = "array<struct<u:long,part:long,role:int>>"
    sets = _with_sets(_only(docs.select("doc_id", "text"), roles, p.broadcast_ids), "places", kind, p)
    moved = sets.select("doc_id", "hashes", F.explode("places").alias("place")).select("place.*", "doc_id", "hashes")

    def compare(batches):
        u, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for to, role, other, raw in zip(*(batch.column(c).to_pylist() for c in ("u", "role", "doc_id", "hashes"))):
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    u, known = to, own
                    continue
                both = np.searchsorted(known, own)
                both = int((known[np.minimum(both, len(known) - 1)] == own).sum()) if len(known) else 0
                if to == u and both and 100 * both >= p.percent * (len(known) + len(own) - both):
                    found.append((to, other))
            yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt = moved.repartition("u", "part").sortWithinPartitions("u", "part", "role")
    return dealt.select("u", "role", "doc_id", "hashes").mapInArrow(compare, "u long, v long")


def _estimated(pairs: DataFrame, classes: DataFrame, p: Near) -> DataFrame:
    """Pairs whose estimate is not below the bound by more than six deviations."""
    own = classes.select("id", "registers")
    joined = pairs.join(own.select(F.col("id").alias("u"), F.col("registers").alias("a")), "u").join(
        own.select(F.col("id").alias("v"), F.col("registers").alias("b")), "v"
    )

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in "ab")
        similar, count = estimates(a, b, p)
        share = p.percent / 100
        keep = similar >= share - 6 * np.sqrt(share * (1 - share) / np.maximum(count, 1)) - 1 / 16 * (count < 64)
        return batch.select(["u", "v", "n"]).filter(pa.array(keep))

    return map_batches(joined.select("u", "v", "n", "a", "b"), likely, "u long, v long, n long")


def near_duplicates(spark: SparkSession, docs: DataFrame, p: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text).

    component_id is the smallest id linked directly or over others.  Null and empty texts have no
    shingle and link with nothing.  Rows with a null id link with nothing and are kept, with a
    null component.  Rows that share an id are one document of several texts.  An empty table
    gives no rows.  Other columns are not read.
    """
    scratch = Scratch(spark)
    all_docs = docs.select("doc_id", "text")
    docs = all_docs.where(F.col("doc_id").isNotNull())
    drawn = scratch.write(sketches(all_docs, p))
    full = drawn.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # the smallest id of each set stands for it
    classes = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "registers")).alias("least"))
    classes = scratch.write(classes.select("d1", "d2", "n", F.col("least.doc_id").alias("id"), F.col("least.registers").alias("registers")))

    found = linked(
        _bands(classes, p),
        lambda pairs, own: confirmed(docs, pairs, p, own),
        p.percent,
        scratch,
        lambda pairs: _estimated(pairs, classes, p),
        lambda rows, own: family_links(docs, rows, p, own),
    )
    return _answer(drawn, classes, found)


def _answer(drawn: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    named = classes.join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    rows = drawn.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def one_of_each(spark: SparkSession, docs: DataFrame, p: Near = Near()) -> DataFrame:
    """docs with the document of the smallest id of each group of near duplicates, all columns kept."""
    scratch = Scratch(spark)
    gone = near_duplicates(spark, docs.select("doc_id", "text"), p).where("not kept").select("doc_id").distinct()
    return docs.join(scratch.write(gone), "doc_id", "left_anti").select(*docs.columns)
