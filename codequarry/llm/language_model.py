"""An n-gram language model in Elias-Fano tries, spread over shards, and the scores of all texts.

Texts are cut into chunks of word numbers once.  First for words, then for
bigrams, a chunk sends what it holds with training counts to the shard that a
hash names; the shard sums the counts, builds its trie level (for bigrams with
quantised smoothed probabilities), looks up what each chunk asked for, and
replies.  Chunks are bucketed by number, so only messages are shuffled.
Frequent contexts are spread like all others, since a shard is chosen by the
whole n-gram.  Probabilities are smoothed towards the shorter context
(Dirichlet prior): ``p(w | h) = (c(h w) + prior * p(w)) / (c(h) + prior)``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import elias_fano as ef
from codequarry.llm import words as w
from codequarry.llm.tables import bucketed, remainder

PRIOR = 50.0
CHUNK_BYTES = 8 << 20
SHARD_TOKENS = 3_000_000
END = w.mix(np.array([0xE0F], np.uint64))[0]
NOWHERE = np.uint64(2**62 - 1)
START = np.uint64(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed buffer, byte planes together."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        head.append(struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3), len(a)))
        body.append(planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(buffer: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    raw = zstandard.ZstdDecompressor().decompress(buffer)
    count, = struct.unpack_from("<I", raw, 0)
    at, out = 4, []
    kinds = []
    for _ in range(count):
        kind, n = struct.unpack_from("<3sQ", raw, at)
        kinds.append((np.dtype(kind.decode().strip()), n))
        at += struct.calcsize("<3sQ")
    for kind, n in kinds:
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _step(values: np.ndarray) -> np.ndarray:
    """Differences between neighbours, which compress better than sorted values."""
    return np.diff(values, prepend=values.dtype.type(0))


def _with_ends(words: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end mark after each text, and the token counts."""
    counts = words.counts
    at = np.cumsum(counts + 1) - 1
    out = np.empty(len(words.hashes) + len(counts), np.uint64)
    mark = np.zeros(len(out), bool)
    mark[at] = True
    out[mark], out[~mark] = END, words.hashes
    return out, counts + 1


def chunks(docs: DataFrame, trained_on: F.Column) -> DataFrame:
    """``chunk, texts, tokens, table, n_tokens``: whole texts as numbers into a chunk's own word table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 28
        for batch in batches:
            for part in w.parts(batch, "text", CHUNK_BYTES):
                hashes, counts = _with_ends(w.tokenize(part.column("text"), w.WHITE_SPACE))
                table, index, seen = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-seen, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                ids = part.column("doc_id")
                texts = pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8),
                             counts, part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8))
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([texts], pa.binary()), pa.array([pack(place[index])], pa.binary()),
                     pa.array([pack(table[order])], pa.binary()), pa.array([len(index)])],
                    ["chunk", "texts", "tokens", "table", "n_tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", trained_on.alias("train"))
    return chosen.mapInArrow(run, "chunk long, texts binary, tokens binary, table binary, n_tokens long")


def _train_mask(texts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(texts[3].astype(bool), texts[2])


def _order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of n-grams by context and word, from one key where both fit into it."""
    if len(word) and max(int(context.max()), int(word.max())) < 1 << 32:
        return np.argsort((context << np.uint64(32)) | word)
    return np.lexsort((word, context))


def _requests(chunk: int, shards: int, context: np.ndarray, word: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One message for each shard, sorted by context and word."""
    order, bounds = _shard_order(shards, context, word)
    for s in range(shards):
        at = order[bounds[s]:bounds[s + 1]]
        if len(at):
            blob = pack(_step(context[at]), word[at], *(m[at] for m in more))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([chunk]), pa.array([blob], pa.binary())], ["shard", "chunk", "blob"])


def _shard_order(shards: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which :func:`_requests` sends distinct n-grams, and where each shard begins."""
    order = _order(context, word)
    shard = (w.mix(context * np.uint64(0x9E3779B97F4A7C15) + word) % np.uint64(shards))[order]
    turn = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.uint64), kind="stable")
    return order[turn], np.searchsorted(shard[turn], np.arange(shards + 1))


class _Shard:
    """The messages of all chunks to one shard: their n-grams, and the sums of those seen in training."""

    def __init__(self, group: pa.Table) -> None:
        self.group, self.shard = group, group.column("shard")[0].as_py()
        self.asked = [unpack(b) for b in group.column("blob").to_pylist()]
        for a in self.asked:
            a[0] = np.cumsum(a[0], dtype=np.uint64)
        context, word, count = (np.concatenate([a[i] for a in self.asked]) for i in range(3))
        order = _order(context, word)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[order].astype(np.int64), first)
        self.first, self.total = order[first[total > 0]], total[total > 0]
        self.context, self.word = context[self.first], word[self.first]
        self.distinct = context[order[first]], word[order[first]]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def level(self, log10: np.ndarray) -> ef.Level:
        return ef.mapped(ef.Level.encode(self.context, self.word, log10, self.total))

    def found(self, trie: ef.Level) -> Iterator[np.ndarray]:
        """The place of each message's n-grams in the trie, or -1; every distinct one is looked up once."""
        place = trie.find(*self.distinct)
        begin = 0
        for a in self.asked:
            yield place[self.which[begin:begin + len(a[0])]]
            begin += len(a[0])

    def replies(self, blobs: list[bytes], *more: pa.Array) -> list:
        return [self.group.column("shard"), self.group.column("chunk"), pa.array(blobs, pa.binary()), *more]


def _served_words(requests: DataFrame, shards: int) -> DataFrame:
    """``shard, chunk, reply, n, distinct``: every word's number, by falling frequency within its shard, and its count.

    ``n`` and ``distinct`` are the shard's training tokens and words, told once, in its first reply.
    """
    def run(group: pa.Table) -> pa.Table:
        of = _Shard(group)
        trie = of.level(np.zeros(len(of.total)))
        rank = np.empty(len(of.total), np.int64)
        rank[np.argsort(-of.total, kind="stable")] = np.arange(len(of.total))
        blobs = []
        for at in of.found(trie):
            there = at >= 0
            ids, counts = np.full(len(at), NOWHERE), np.zeros(len(at), np.uint32)
            ids[there], counts[there] = (rank[at[there]] * shards + of.shard + 1).astype(np.uint64), trie.counts[at[there]]
            blobs.append(pack(ids, counts))
        told = np.arange(len(blobs)) == 0
        return pa.table(of.replies(blobs, pa.array(told * int(of.total.sum())), pa.array(told * len(of.total))), names=["shard", "chunk", "reply", "n", "distinct"])

    return requests.groupBy("shard").applyInArrow(run, "shard int, chunk long, reply binary, n long, distinct long")


def _served_pairs(requests: DataFrame, totals: tuple[int, int, int], prior: float) -> DataFrame:
    """``shard, chunk, reply``: the quantised probability of every bigram asked for, 0 where training has none."""
    def run(group: pa.Table) -> pa.Table:
        of = _Shard(group)
        history, words = (np.concatenate([a[i] for a in of.asked])[of.first] for i in (3, 4))
        lower = 10.0 ** _base(words, totals)
        trie = of.level(np.log10((of.total + prior * lower) / (history + prior)))
        blobs = []
        for at in of.found(trie):
            there = at >= 0
            codes = np.zeros(len(at), np.uint16)
            codes[there] = trie.codes[at[there]]
            blobs.append(pack(codes))
        return pa.table(of.replies(blobs), names=["shard", "chunk", "reply"])

    return requests.groupBy("shard").applyInArrow(run, "shard int, chunk long, reply binary")


def _base(counts: np.ndarray, totals: tuple[int, int, int]) -> np.ndarray:
    """The base distribution's log10 probabilities of words with these training counts."""
    return np.log10((counts + 0.5) / (totals[0] + 0.5 * (totals[1] + 1)))


def _gathered(order: np.ndarray, bounds: np.ndarray, replies: pa.Table, kinds: list) -> list[np.ndarray]:
    """Replies put back in the order of the chunk's own table."""
    out = [np.zeros(len(order), kind) for kind in kinds]
    for s, blob in zip(replies.column("shard").to_pylist(), replies.column("reply").to_pylist(), strict=True):
        for whole, part in zip(out, unpack(blob), strict=True):
            whole[order[bounds[s]:bounds[s + 1]]] = part
    return out


def _word_requests(cut: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table, = unpack(row["table"])
                tokens, = unpack(row["tokens"])
                count = np.bincount(tokens[_train_mask(unpack(row["texts"]))], minlength=len(table)).astype(np.uint32)
                yield from _requests(row["chunk"], shards, _level_one(table)[0], _level_one(table)[1], count)

    return cut.mapInArrow(run, "shard int, chunk long, blob binary")


def _level_one(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash as a two-part key: the trie's first level spells it in two halves."""
    return table >> np.uint64(32), table & np.uint64(2**32 - 1)


def _numbered(cut: DataFrame, replies: DataFrame, shards: int) -> DataFrame:
    """Chunks whose table holds word numbers and training counts in place of hashes."""
    schema = pa.schema([("chunk", pa.int64()), ("texts", pa.binary()), ("tokens", pa.binary()), ("table", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return schema.empty_table()
        table, = unpack(left.column("table")[0].as_py())
        order, bounds = _shard_order(shards, *_level_one(table))
        ids, counts = _gathered(order, bounds, right, [np.uint64, np.uint32])
        told = [pa.array([sum(right.column(c).to_pylist())]) for c in ("n", "distinct")]
        return pa.table([left.column("chunk"), left.column("texts"), left.column("tokens"), pa.array([pack(ids, counts)], pa.binary()), *told], schema=schema)

    return (cut.select("chunk", "texts", "tokens", "table").groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(run, "chunk long, texts binary, tokens binary, table binary, n long, distinct long"))


class _Chunk:
    """A numbered chunk: the words of each token, and the distinct bigrams."""

    def __init__(self, row: dict, totals: tuple[int, int, int]) -> None:
        self.texts = unpack(row["texts"])
        self.tokens, = unpack(row["tokens"])
        self.ids, self.counts = unpack(row["table"])
        self.begins = np.cumsum(self.texts[2]) - self.texts[2]
        self.base = _base(self.counts, totals)
        word = self.ids[self.tokens]
        history = np.empty_like(word)
        history[1:], history[self.begins] = word[:-1], START
        self.history_seen = np.empty(len(word), np.uint32)
        self.history_seen[1:] = self.counts[self.tokens[:-1]]
        self.history_seen[self.begins] = totals[2]
        known = (history != NOWHERE) & (word != NOWHERE)
        key = np.where(known, w.mix(history * np.uint64(0x9E3779B97F4A7C15) + word), np.uint64(0))
        _, first, self.which = np.unique(key, return_index=True, return_inverse=True)
        self.asked = known[first]
        at = self.at = first[self.asked]
        self.history, self.word = history[at], word[at]

    def messages(self, chunk: int, shards: int) -> Iterator[pa.RecordBatch]:
        train = _train_mask(self.texts)
        count = np.bincount(self.which[train], minlength=len(self.asked)).astype(np.uint32)[self.asked]
        return _requests(chunk, shards, self.history, self.word, count, self.history_seen[self.at], self.counts[self.tokens[self.at]])

    def log10(self, codes: np.ndarray, prior: float) -> np.ndarray:
        """Each token's log probability: the trie's, or the base scaled down by what its history leaves over."""
        full = np.zeros(len(self.asked), np.uint16)
        full[self.asked] = codes
        code = full[self.which]
        return np.where(code > 0, ef.restore(code), self.base[self.tokens] + np.log10(prior / (self.history_seen + prior)))


def _pair_requests(numbered: DataFrame, shards: int, totals: tuple[int, int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _Chunk(row, totals).messages(row["chunk"], shards)

    return numbered.mapInArrow(run, "shard int, chunk long, blob binary")


def _scored(numbered: DataFrame, replies: DataFrame, shards: int, totals: tuple[int, int, int], prior: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return schema.empty_table()
        chunk = _Chunk(left.to_pylist()[0], totals)
        codes, = _gathered(*_shard_order(shards, chunk.history, chunk.word), right, [np.uint16])
        ids, there, counts, train = chunk.texts

        def sums(values: np.ndarray) -> pa.Array:
            return pa.array(np.add.reduceat(values, chunk.begins))

        return pa.table(
            [pa.array(ids, mask=there == 0), pa.array(train == 0), pa.array(counts), sums((chunk.counts[chunk.tokens] > 0).astype(np.int64)),
             pa.array(np.full(len(ids), totals[0])), sums(chunk.base[chunk.tokens]), sums(chunk.log10(codes, prior))], schema=schema)

    return (numbered.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def language_scores(docs: DataFrame, prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs (doc_id, text)``.

    Learns from the rows whose id's remainder by 5 is not 1 (a null id
    counts as 0) and scores all.  A null or empty text is one end mark.
    ``score`` is the log10 probability of the whole text under the bigram
    trie, with probabilities quantised to about 0.0001.  Rows may repeat and
    extra columns are ignored; no rows, or none to learn from, leave every
    count at zero.  The work is spread over shards of about ``shard_tokens``
    tokens, so it grows with the texts and nothing is held whole.
    """
    cut = bucketed(chunks(docs, remainder(F.col("doc_id"), 5) != 1), "chunks", "chunk")
    shards = max(1, -(-(cut.agg(F.sum("n_tokens")).first()[0] or 0) // shard_tokens))
    numbered = bucketed(_numbered(cut, _served_words(_word_requests(cut, shards), shards), shards), "numbered", "chunk")
    n, distinct = numbered.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_texts = docs.filter(remainder(F.col("doc_id"), 5) != 1).count()
    totals, numbered = (n, distinct, n_texts), numbered.drop("n", "distinct")
    replies = _served_pairs(_pair_requests(numbered, shards, totals), totals, prior)
    return _scored(numbered, replies, shards, totals, prior)
