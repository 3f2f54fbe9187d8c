"""Benchmark decontamination with suffix arrays over shards of the documents.

A shard is a few megabytes of whole texts as word hashes.  Its suffix array
is sparse: only suffixes whose first words also begin some test window are
sorted.  Every distinct test window is found in it by binary search, one word
after the other; neighbouring finds on the same diagonal are then joined into
the longest verbatim matches with their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import words as w

WINDOW = 10
BLOCK_WORDS = 2_000_000
HEAD = 4
HEAD_BITS = 22

MATCH_TYPE = "array<struct<item_id:string,item_pos:int,doc_pos:int,n_words:int>>"
SCHEMA = f"doc_id long, text_key long, n_words long, n_hit long, matches {MATCH_TYPE}"


@dataclass
class Test:
    """Distinct windows of the test items: ``rows`` holds their words, zero past ``length``.

    Window ``u`` begins at the places ``at[first[u]:first[u + 1]]``, each an item and a position.
    """

    rows: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray
    position: np.ndarray
    names: list
    heads: dict[int, np.ndarray]


def _heads(hashes: np.ndarray, size: int) -> np.ndarray:
    return (w.windows(hashes, size) >> np.uint64(64 - HEAD_BITS)).astype(np.int64)


def test_windows(names: list, items: list[np.ndarray], window: int) -> Test:
    """The windows of all items; an item shorter than ``window`` is one, an empty one has none."""
    rows, item, position = [], [], []
    for k, words in enumerate(items):
        size = min(window, len(words))
        for j in range(len(words) - size + 1 if size else 0):
            row = np.zeros(window, np.uint64)
            row[:size] = words[j:j + size]
            rows.append(row)
            item.append(k)
            position.append(j)
    every = np.array(rows, np.uint64).reshape(-1, window)
    distinct, place = np.unique(every, axis=0, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    first = np.searchsorted(place.ravel()[order], np.arange(len(distinct) + 1))
    length = (distinct != 0).sum(axis=1)
    heads = {}
    for size in np.unique(np.minimum(length, HEAD)).tolist():
        table = np.zeros(1 << HEAD_BITS, bool)
        for row in distinct[np.minimum(length, HEAD) == size]:
            table[_heads(row[:size], size)] = True
        heads[size] = np.packbits(table)
    return Test(distinct, length, first, np.array(item, np.int64)[order], np.array(position, np.int64)[order], names, heads)


def suffix_array(words: w.Words, test: Test) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes that can match: their positions and their first words (zero past the text's end)."""
    n, window = len(words.hashes), test.rows.shape[1]
    keep = np.zeros(n, bool)
    for size, table in test.heads.items():
        if n >= size:
            keep[:n - size + 1] |= np.unpackbits(table).view(bool)[_heads(words.hashes, size)]
    at = np.flatnonzero(keep)
    end = words.first[np.searchsorted(words.first, at, "right")]
    columns = np.zeros((window, len(at)), np.uint64)
    for k in range(window):
        inside = at + k < end
        columns[k, inside] = words.hashes[at[inside] + k]
    order = np.lexsort(columns[::-1])
    return at[order], columns[:, order]


def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """Binary search for each value inside its own range of the column."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low[open_] + high[open_]) >> 1
        less = column[middle] <= value[open_] if right else column[middle] < value[open_]
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    return low


def find(test: Test, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test window the range of suffixes that begin with it."""
    low = np.zeros(len(test.rows), np.int64)
    high = np.full(len(test.rows), columns.shape[1], np.int64)
    for k in range(test.rows.shape[1]):
        live = np.flatnonzero((low < high) & (k < test.length))
        if not len(live):
            break
        value = test.rows[live, k]
        begin = _bound(columns[k], low[live], high[live], value, right=False)
        high[live] = _bound(columns[k], begin, high[live], value, right=True)
        low[live] = begin
    return low, high


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges, and which range each came from."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def matches(words: w.Words, test: Test) -> tuple[np.ndarray, np.ndarray]:
    """Maximal matches as rows (text, item, item position, text position, words), and a flag for each word hit."""
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    at, columns = suffix_array(words, test)
    low, high = find(test, columns)
    found = np.flatnonzero(low < high)
    if not len(found):
        return np.empty((0, 5), np.int64), hit[:-1].astype(bool)
    place, owner = _spread(low[found], high[found])
    start, which = at[place], found[owner]
    np.add.at(hit, start, 1)
    np.add.at(hit, start + test.length[which], -1)
    source, again = _spread(test.first[which], test.first[which + 1])
    start, size = start[again], test.length[which][again]
    item, position = test.item[source], test.position[source]
    text = np.searchsorted(words.first, start, "right") - 1
    local = start - words.first[text]
    order = np.lexsort((position, local - position, item, text))
    text, item, position, local, size = (x[order] for x in (text, item, position, local, size))
    new = np.ones(len(text), bool)
    new[1:] = ((text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (local[1:] - position[1:] != local[:-1] - position[:-1])
               | (position[1:] != position[:-1] + 1))
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], len(text)) - 1
    length = position[final] + size[final] - position[begin]
    return np.column_stack((text[begin], item[begin], position[begin], local[begin], length)), np.cumsum(hit)[:-1] > 0


def _tests(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Test]:
    """The items in blocks of a bounded number of words, so that a broadcast stays bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.parts(batch, "text"):
                words = w.tokenize(part.column("text"), w.NOT_ALPHANUMERIC)
                values = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(values, pa.binary())], ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    cut = items.mapInArrow(run, "item_id string, words binary")
    total = cut.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block_words)))
    for block in range(blocks):
        part = cut.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block) if blocks > 1 else cut
        rows = part.distinct().toArrow()
        yield test_windows(rows.column("item_id").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()], window)


def _matched(docs: DataFrame, test: Test) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(test)
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.names
        for batch in batches:
            for part in w.parts(batch, "text"):
                words = w.tokenize(part.column("text"), w.NOT_ALPHANUMERIC)
                rows, hit = matches(words, shared.value)
                of_text: list[list] = [[] for _ in range(part.num_rows)]
                for text, item, position, local, size in rows.tolist():
                    of_text[text].append({"item_id": names[item], "item_pos": position, "doc_pos": local, "n_words": size})
                sums = np.append(0, np.cumsum(hit))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(words.counts),
                     pa.array(sums[words.first[1:]] - sums[words.first[:-1]]), pa.array(of_text, kind)],
                    ["doc_id", "text_key", "n_words", "n_hit", "matches"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return texts.mapInArrow(run, SCHEMA)


def _union_of_spans(spans: F.Column) -> F.Column:
    """The number of words covered by spans sorted by ``doc_pos``."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n"))

    def add(acc: F.Column, s: F.Column) -> F.Column:
        end = s["doc_pos"] + s["n_words"]
        return F.struct(F.greatest(acc["until"], end).alias("until"),
                        (acc["n"] + F.greatest(end - F.greatest(acc["until"], s["doc_pos"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, matches`` for every row of ``docs (doc_id, text)``.

    ``matches`` lists the longest verbatim matches of at least ``window``
    words (or of a whole shorter item) with their places, counted in words
    from 0; ``n_hit`` is the number of words inside any of them.  A null or
    wordless text has no words, an item without words matches nothing, items
    and rows may repeat, a null id stays null, extra columns are ignored, and
    an empty benchmark hits nothing.  Nothing is shuffled unless the benchmark
    exceeds ``block_words``: it is then met block by block and the finds of a
    row are joined.
    """
    found = [_matched(docs, test) for test in _tests(benchmark, window, block_words)]
    if len(found) == 1:
        return found[0].drop("text_key")
    keys = ["doc_id", "text_key", "n_words"]
    every = found[0].withColumn("block", F.lit(0))
    for k, more in enumerate(found[1:], 1):
        every = every.union(more.withColumn("block", F.lit(k)))
    copies = F.sum(F.when(F.col("block") == 0, 1).otherwise(0)).cast("int").alias("copies")
    merged = every.groupBy(*keys).agg(copies, F.array_distinct(F.flatten(F.collect_set("matches"))).alias("matches"))
    by_place = F.array_sort("matches", lambda a, b: a["doc_pos"] - b["doc_pos"])
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("doc_id", "n_words", _union_of_spans(by_place).alias("n_hit"), "matches"))


def digest(found: DataFrame) -> DataFrame:
    """Per document the counts and a hash of the items found; an item without an id is not named."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull())))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a match, all columns as they are; null and wordless texts stay.

    Rows pass through the search and leave it whole, so nothing is shuffled.
    """
    clean = docs
    for test in _tests(benchmark, window, block_words):
        clean = _without_hits(clean, test)
    return clean


def _without_hits(docs: DataFrame, test: Test) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.parts(batch, "text"):
                words = w.tokenize(part.column("text"), w.NOT_ALPHANUMERIC)
                sums = np.append(0, np.cumsum(matches(words, shared.value)[1]))
                yield part.filter(pa.array(sums[words.first[1:]] == sums[words.first[:-1]]))

    return docs.mapInArrow(run, docs.schema)
