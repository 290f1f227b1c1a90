"""Log probabilities of whole documents under a hashed maximum-entropy model and a word-count base.

Word counts, the vocabulary, the first weights, the gradient steps and the chances of words that
share a leaf of the model's tree come from all training documents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maxent
from .graph import Scratch
from .tables import fold_of, row_blocks, text_bytes
from .words import LOWER, find_words, hash_words, joined_hash

END = int(joined_hash(np.array([7], np.uint64), np.array([7], np.uint64)).view(np.int64)[0])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Model:
    """Parameters; the weights are averaged after every round, and rounds grow with the documents."""

    shape: maxent.Shape | None = None  # None follows the corpus
    least_count: int = 3  # words as frequent have a leaf of their own, as far as half of all leaves go
    rounds: int = 2  # at least
    learners: int = 0  # tasks that learn side by side, at most; 0 takes those that read the table
    learner_tokens: int = 1_000_000  # of a learner at least, so that small partitions are learned from together
    block_tokens: int = 1_500_000  # tokens whose words are kept together in one task
    tokens_per_shared_leaf: int = 500  # so that the chances kept for words never seen, one count a leaf, stay small

    def rounds_of(self, documents: int) -> int:
        """One more for every sixteen times as many documents, from a million on."""
        return max(self.rounds, round(np.log(max(documents, 1) / 1_000) / np.log(16)))


def document_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token: words by white space, A-Z lower-cased, then one end for each row."""
    raw = LOWER[raw]
    starts, ends, rows = find_words(raw, offsets)
    count = len(offsets) - 1
    words = np.concatenate([hash_words(raw, starts, ends).view(np.int64), np.full(count, END)])
    rows = np.concatenate([rows, np.arange(count)])
    order = np.argsort(rows, kind="stable")
    return rows[order], words[order]


def _tokens(batch: pa.RecordBatch):
    raw, offsets = text_bytes(batch.column("text"))
    for a, b in row_blocks(offsets):
        rows, words = document_tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, rows, words


def word_counts(docs: DataFrame, block_tokens: int = Model.block_tokens) -> DataFrame:
    """word (hash) and n of all tokens of the documents; counted in the task first."""

    def count(batches):
        held, size = [], 0

        def flush():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(words), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, _, words in _tokens(batch):
                held.append(words)
                size += len(words)
                if size >= block_tokens:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Trained:
    """Sorted hashes of the words with a leaf of their own, the leaf of each, the two tables of weights
    and the counts plus one of all words that share a leaf; those stand behind the own ones, by hash."""

    shape: maxent.Shape
    words: np.ndarray
    ids: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray
    shared: np.ndarray

    def ids_of(self, words: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(words, return_inverse=True)
        out = len(self.words) + kinds % len(self.shared)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, kinds), len(self.words) - 1)
            out = np.where(self.words[at] == kinds, self.ids[at], out)
        return out[back]


def start_model(counts: DataFrame, total: int, m: Model) -> Trained:
    """Frequent words and the end of a text with leaves of their own, the others dealt by hash over
    shared leaves, and weights from their counts.

    Each shared leaf holds one count more, for a word never seen, as the base holds one for all of
    them.  There are so few shared leaves that these counts weigh little; leaves beyond stay unused.
    """
    shape = m.shape
    if shape is None:
        shape = maxent.shape_of(counts.where(F.col("n") >= m.least_count).count(), total)
    top = counts.where((F.col("n") >= m.least_count) | (F.col("word") == END))
    top = top.orderBy((F.col("word") == END).desc(), F.col("n").desc(), "word").limit(shape.words // 2).toPandas()  # bounded by the leaves
    words, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    size = min(shape.words - len(words), max(1, total // m.tokens_per_shared_leaf))
    sums = counts.groupBy(F.pmod("word", F.lit(size)).alias("leaf")).agg(F.sum(F.col("n") + 1).alias("n")).toPandas()  # a row for each leaf
    shared = np.ones(size, np.int64)  # for a word never seen
    shared[sums["leaf"].to_numpy(np.int64)] += sums["n"].to_numpy(np.int64)
    np.subtract.at(shared, words % size, n + 1)
    order = np.argsort(words)
    leaves = np.zeros(shape.words)
    leaves[: len(words) + size] = np.concatenate([n + 1, shared])
    return Trained(shape, words[order], order, *maxent.start(leaves, shape), shared)


def train_round(docs: DataFrame, model: Trained, learners: int) -> Trained:
    """Every task passes over its documents from the same weights; the changes of each row of
    weights are averaged over the tasks that changed it, so a context met in one task counts whole.
    The model travels once, and is removed from the executors when the round ends."""
    s, block = model.shape, 1024
    widths = model.by_class.shape[1], model.by_word.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        old = shared.value
        by_class, by_word = old.by_class.copy(), old.by_word.copy()
        squares = maxent.new_squares(by_class, by_word)
        for batch in batches:
            for _, _, rows, words in _tokens(batch):
                maxent.train(by_class, by_word, old.ids_of(words), rows, s, squares=squares, words=words)
        for table, (new, start) in enumerate(((by_class, old.by_class), (by_word, old.by_word))):
            for first in range(0, len(new), block):
                change = new[first : first + block] - start[first : first + block]
                at = np.flatnonzero(change.any(1))
                if len(at):  # changes travel as half floats
                    parts = [pa.array([x]) for x in (table, first, at.astype(np.int16).tobytes(), change[at].astype(np.float16).tobytes())]
                    yield pa.record_batch(parts, ["t", "first", "at", "change"])

    def average(part: pa.Table) -> pa.Table:
        table, first = part.column("t")[0].as_py(), part.column("first")[0].as_py()
        width = widths[table]
        total, n = np.zeros((block, width)), np.zeros(block)
        for at, change in zip(part.column("at").to_pylist(), part.column("change").to_pylist()):
            at = np.frombuffer(at, np.int16)
            total[at] += np.frombuffer(change, np.float16).reshape(-1, width)
            n[at] += 1
        mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.table({"t": [table], "first": [first], "change": pa.array([mean.tobytes()], pa.binary())})

    changes = docs.select("text").coalesce(learners).mapInArrow(learn, "t long, first long, at binary, change binary")
    changes = changes.groupBy("t", "first").applyInArrow(average, "t long, first long, change binary")
    tables = model.by_class.copy(), model.by_word.copy()
    means = changes.toPandas()  # the size of the weights at most
    shared.destroy()
    for t, first, change in means.itertuples(index=False):
        own = tables[t][first : first + block]
        own += np.frombuffer(change, np.float32).reshape(block, -1)[: len(own)]
    return replace(model, by_class=tables[0], by_word=tables[1])


def train_model(train: DataFrame, counts: DataFrame, total: int, m: Model) -> Trained:
    """The start model after gradient steps over every training document once, a part of them in each round."""
    model = start_model(counts, total, m)
    rounds = m.rounds_of(train.count())
    learners = m.learners or max(1, total // m.learner_tokens)
    for k in range(rounds):
        part = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        model = train_round(part, model, learners)
    return model


def _drafts(docs: DataFrame, trained: Broadcast, m: Model) -> DataFrame:
    """Rows of two kinds.  A document: its tokens, the model's part of its score, and the places of its
    distinct words in its block with their numbers.  A block: its distinct words in order."""

    def draft(batches):
        model = trained.value
        codec, held, size, number = pa.Codec("zstd", 1), [], 0, 0
        task = TaskContext.get().partitionId()

        def flush():
            block = task << 24 | number
            kinds, back = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            places, docs, done = [], [], 0
            for batch, rows, words, chances in held:
                own = back[done : done + len(words)]
                done += len(words)
                first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                sums = np.add.reduceat(chances, first[:-1])
                for k in range(batch.num_rows):
                    at, n = np.unique(own[first[k] : first[k + 1]], return_counts=True)
                    packed = np.concatenate([np.diff(at, prepend=0), n]).astype(np.int32).tobytes()
                    places.append(codec.compress(packed, asbytes=True))
                    docs.append((len(at), int(first[k + 1] - first[k]), float(sums[k])))
            known = (model.ids_of(kinds) < len(model.words)).tobytes()
            ids = [x for h in held for x in h[0].column("doc_id").to_pylist()]
            columns = [
                pa.array([block] * (len(ids) + 1), pa.int64()),
                pa.array([*ids, None], pa.int64()),
                pa.array([d[0] for d in docs] + [len(kinds)], pa.int64()),
                pa.array([d[1] for d in docs] + [0], pa.int64()),
                pa.array([d[2] for d in docs] + [None], pa.float64()),
                pa.array([*places, None], pa.binary()),
                pa.array([None] * len(ids) + [kinds.tolist()], pa.list_(pa.int64())),
                pa.array([None] * len(ids) + [known], pa.binary()),
            ]
            return pa.record_batch(columns, ["block", "doc_id", "kinds", "n_tokens", "chance", "places", "words", "known"])

        for batch in batches:
            for a, b, rows, words in _tokens(batch):
                ids = model.ids_of(words)
                chances = maxent.log_chances(model.by_class, model.by_word, ids, rows, model.shape, words=words)
                far = ids >= len(model.words)
                chances[far] -= np.log(model.shared[ids[far] - len(model.words)])  # its share of the leaf, but for its own count
                held.append((batch.slice(a, b - a), rows, words, chances))
                size += len(words)
                if size >= m.block_tokens:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    schema = "block long, doc_id long, kinds long, n_tokens long, chance double, places binary, words array<long>, known binary"
    return docs.select("doc_id", "text").mapInArrow(draft, schema)


def lm_scores(spark: SparkSession, docs: DataFrame, m: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Documents of the fold with crc32(doc_id) mod 7 = 2 are never learned from.  A null text counts
    as empty and has its end alone; repeated rows count each in learning.  With nothing to learn
    from all counts are 0.  Words without a leaf of their own share the chance of theirs in
    proportion to their counts plus one, so the score is a proper log10 probability.
    """
    scratch = Scratch(spark)
    held_out = fold_of(F.col("doc_id"), 7) == 2
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out)
    counts = scratch.write(word_counts(train, m.block_tokens))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = train_model(train, counts, total, m)
    base_of = total + distinct + 1

    trained = spark.sparkContext.broadcast(model)
    drafts = scratch.write(_drafts(docs, trained, m))
    trained.destroy()
    blocks = drafts.where("words is not null").select("block", F.posexplode("words").alias("at", "word"), "known")
    seen = blocks.select("block", "at", "word").join(counts, "word").select("block", "at", "n")
    texts = drafts.where("words is null").select("block", "doc_id", "kinds", "n_tokens", "chance", "places")
    flags = drafts.where("words is not null").select("block", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("n"), "known")
    seen = seen.select("block", "at", "n", F.lit(None).cast("binary").alias("known")).unionByName(flags)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        flagged = [x for x in right.column("known").to_pylist() if x is not None]
        known = np.frombuffer(flagged[0], bool) if flagged else np.zeros(0, bool)
        right = right.filter(right.column("at").is_valid())
        c = np.zeros(len(known), np.int64)
        c[right.column("at").to_numpy()] = right.column("n").to_numpy()
        base, other = np.log10((c + 1) / base_of), np.where(known, 0.0, np.log10(c + 1))
        codec, rows = pa.Codec("zstd", 1), []
        for doc_id, kinds, tokens, chance, packed in zip(*(left.column(x).to_pylist() for x in ("doc_id", "kinds", "n_tokens", "chance", "places"))):
            raw = np.frombuffer(codec.decompress(packed, 8 * kinds, asbytes=True), np.int32)
            at, n = np.cumsum(raw[:kinds]), raw[kinds:]
            rows.append((doc_id, tokens, int(n[c[at] > 0].sum()), total, float(base[at] @ n), float(chance / np.log(10) + other[at] @ n)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    seen = seen.withColumnRenamed("block", "of_block")
    rows = texts.groupBy("block").cogroup(seen.groupBy("of_block")).applyInArrow(finish, schema)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
