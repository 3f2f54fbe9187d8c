"""Near-duplicate documents: an inverted join of MinHash signature coordinates.

1. Every text becomes its set of five-word shingles, a key of the whole set
   and a signature of ``COORDINATES`` minima.  Texts with equal sets form one
   class; only its smallest document goes on.
2. A class is posted under coordinate-value pairs.  Two signatures that agree
   in at least ``matches`` coordinates must share one of the first
   ``COORDINATES - matches + 1`` pairs of each in any common order, so only
   that prefix is posted, rarest pairs first (a fixed-size sketch of the
   counts gives the order).
3. Short lists are merged into pairs.  Long lists are skipped at first: their
   members meet a few leaders, so that groups of copies become one component.
   Members of long lists that are still apart then meet over the rarest of
   their own shingles, with exact prefix, size and position filters.
4. Pairs whose signatures collide often enough are confirmed on full sets.

``matches`` is the highest count at which a link of just the similarity asked
for is missed with a probability below ``MISS``; more similar links are missed
far less often.  No step caps partners or candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import words as w
from codequarry.llm.components import components
from codequarry.llm.tables import stored

SHINGLE = 5
COORDINATES = 64
MISS = 1e-6
SHORT_LIST = 24
LEADER_ROUNDS = 2
BLOCK = 512
SKETCH = 1 << 16
SHINGLE_SKETCH = 1 << 18
MEMBERSHIP_BITS = 22

_rng = np.random.default_rng(617)
_FLIPS = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_FACTORS = _rng.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)


def matches_for(percent: int) -> int:
    """The match threshold for a similarity in percent, from the binomial distribution of collisions."""
    p, below = percent / 100, 0.0
    for hits in range(COORDINATES + 1):
        below += math.comb(COORDINATES, hits) * p**hits * (1 - p) ** (COORDINATES - hits)
        if below > MISS:
            return max(1, hits)
    return COORDINATES


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's permutation over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.uint32(2**32 - 1))
    for begin in range(0, len(x), 1 << 14):
        np.minimum(least, ((x[begin:begin + (1 << 14), None] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    return least


def _set_sums(shingles: np.ndarray) -> tuple[int, int]:
    one = w.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()
    two = w.mix(shingles + np.uint64(0x14057B7EF767814F)).sum()
    return tuple(np.array([one, two], np.uint64).view(np.int64).tolist())


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, key_a, key_b, sig, marks`` of every row of ``docs``.

    ``sig`` holds the coordinates (null for a text without words), ``marks``
    their lowest bytes, which is all that counting collisions needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.parts(batch, "text"):
                rows: list[list] = [[], [], [], [], []]
                for s in w.shingle_sets(w.tokenize(part.column("text"), w.WHITE_SPACE), SHINGLE):
                    sums = _set_sums(s) if len(s) else (0, 0)
                    sig = signature(s) if len(s) else None
                    marks = None if sig is None else sig.astype(np.uint8).tobytes()
                    for column, value in zip(rows, (len(s), *sums, None if sig is None else sig.tobytes(), marks), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
                    ["doc_id", "n_shingles", "key_a", "key_b", "sig", "marks"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, sig binary, marks binary")


def _sketch(reps: DataFrame) -> np.ndarray:
    """Counts of coordinate-value pairs by hash bucket; its size does not depend on the data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            tokens = _tokens(batch.column("sig"))
            counts += np.bincount((w.mix(tokens) & np.uint64(SKETCH - 1)).astype(np.int64).ravel(), minlength=SKETCH)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    rows = reps.select("sig").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH, np.int64)
    sketch[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return sketch


def _tokens(sigs: pa.Array) -> np.ndarray:
    values = np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return values.astype(np.uint64) | _PLACES


def _postings(reps: DataFrame, matches: int) -> DataFrame:
    """``token, node, n``: each representative under the rarest pairs of its prefix."""
    sketch = reps.sparkSession.sparkContext.broadcast(_sketch(reps))
    kept = COORDINATES - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tokens = _tokens(batch.column("sig"))
            mixed = w.mix(tokens)
            count = sketch.value[(mixed & np.uint64(SKETCH - 1)).astype(np.int64)]
            order = np.lexsort((mixed, count), axis=1)[:, :kept]
            chosen = np.take_along_axis(tokens, order, axis=1)
            again = np.repeat(np.arange(batch.num_rows), kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen.view(np.int64).ravel()), batch.column("node").take(pa.array(again)),
                 batch.column("n").take(pa.array(again))], ["token", "node", "n"])

    return reps.select("node", "n", "sig").mapInArrow(run, "token long, node long, n long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sizes_fit(n_a: str, n_b: str, percent: int) -> F.Column:
    """Sets whose sizes alone rule out the similarity are no candidates."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _colliding(pairs: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``matches`` coordinates."""
    marks = reps.select("node", "marks")
    both = (pairs.join(marks.withColumnsRenamed({"node": "a", "marks": "m_a"}), "a")
            .join(marks.withColumnsRenamed({"node": "b", "marks": "m_b"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m_a, m_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("m_a", "m_b"))
            keep = pa.array((m_a == m_b).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, members``: whole shingle sets of the documents named in ``nodes``.

    A bit table of fixed size keeps other texts out before they are cut into
    words; the few that slip through find no partner in the join that follows.
    """
    bits = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MEMBERSHIP_BITS))
    named = nodes.select(F.col("node").alias("doc_id")).select(bits.cast("int").alias("bit")).distinct().toArrow()
    table = np.zeros(1 << MEMBERSHIP_BITS, bool)
    table[named.column("bit").to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(wanted.value).view(bool)
        for batch in batches:
            asked = batch.filter(pa.array(flags[batch.column("bit").to_numpy(zero_copy_only=False)]))
            for part in w.parts(asked, "text"):
                sets = [s.tobytes() for s in w.shingle_sets(w.tokenize(part.column("text"), w.WHITE_SPACE), SHINGLE)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["node", "members"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    return texts.withColumn("bit", bits.cast("int")).mapInArrow(run, "node long, members binary")


def _sets_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    return stored(_full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    both = (pairs.join(sets.withColumnsRenamed({"node": "a", "members": "s_a"}), "a")
            .join(sets.withColumnsRenamed({"node": "b", "members": "s_b"}), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
                shared = int((two[at] == one).sum()) if len(two) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(one) + len(two) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _with_component(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with each node's present component, cut to lists that hold more than one."""
    joined = postings.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return stored(joined, "listed")


def _open_lists(listed: DataFrame) -> DataFrame:
    return listed.groupBy("token").agg(
        F.count("*").alias("m"), F.min("comp").alias("_low"), F.max("comp").alias("_high"),
    ).filter("_low <> _high").select("token", "m")


def _led_pairs(listed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of long lists against one leader per list, unless already linked."""
    rank = F.xxhash64("node", F.lit(turn))
    leaders = listed.groupBy("token").agg(
        F.min(F.struct(rank.alias("r"), "node", "n", "comp")).alias("l"),
        F.min("comp").alias("_low"), F.max("comp").alias("_high"),
    ).filter("_low <> _high").select("token", F.col("l.node").alias("l_node"), F.col("l.n").alias("l_n"), F.col("l.comp").alias("l_comp"))
    met = listed.join(stored(leaders, "leaders"), "token").filter("comp <> l_comp").filter(_sizes_fit("n", "l_n", percent))
    return met.select(*_ordered("node", "l_node")).distinct()


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, pos, marks``: the shingles among which two linked sets must share one, rarest first.

    ``pos`` is a shingle's place in its set's order, which bounds how much two
    sets that first meet there can still share.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SHINGLE_SKETCH, np.int64)
        for batch in batches:
            for x in batch.column("members"):
                counts += np.bincount(_bucket(np.frombuffer(x.as_buffer(), np.uint64)), minlength=SHINGLE_SKETCH)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    rows = sets.select("members").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SHINGLE_SKETCH, np.int64)
    sketch[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("node").to_pylist(), batch.column("members"), batch.column("marks").to_pylist()
            for node, x, marks in zip(*columns, strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                kept = len(own) - -(-len(own) * percent // 100) + 1
                order = np.lexsort((own, shared.value[_bucket(own)]))[:kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[order].view(np.int64)), pa.array(np.full(kept, node)), pa.array(np.full(kept, len(own))),
                     pa.array(np.arange(kept)), pa.array([marks] * kept, pa.binary())],
                    ["token", "node", "n", "pos", "marks"])

    return sets.mapInArrow(post, "token long, node long, n long, pos long, marks binary")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SHINGLE_SKETCH - 1)).astype(np.int64)


def _rest_pairs(rare: DataFrame, labels: DataFrame, percent: int, matches: int, lowest: bool) -> DataFrame:
    """Pairs of different components that pass the exact prefix and position filters and whose signatures collide.

    A shingle's list of m members is dealt into blocks; each pair of blocks is
    one group that compares arrays, signatures included, so what fails never
    becomes a row.  A text
    that differs from its group in more than the similarity allows has only
    rare shingles in its prefix and meets nobody.  With ``lowest`` each member
    of a group keeps its lowest partner only, which joins most of a group of
    copies by few pairs; a last round without it makes the links complete.
    """
    listed = _with_component(rare, labels)
    lists = stored(_open_lists(listed).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "open")
    own = listed.join(lists, "token").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = (own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, n, comp, pos, mine = (group[c].to_numpy() for c in ("node", "n", "comp", "pos", "mine"))
        marks = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(-1, COORDINATES)
        across = group["low"].iat[0] != group["high"].iat[0]
        found, met = [], np.zeros(len(group), bool)
        for i in np.argsort(node, kind="stable"):
            fit = (comp != comp[i]) & (node > node[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            fit &= (100 + percent) * np.minimum(n - pos, n[i] - pos[i]) >= percent * (n + n[i])
            at = np.flatnonzero(fit & (mine != mine[i]) if across else fit)
            at = at[(marks[at] == marks[i]).sum(axis=1) >= matches]
            if lowest:
                at = at[~met[at]]
                met[at] = True
            found.append(np.column_stack((np.full(len(at), node[i]), node[at])))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"], dtype="int64")

    columns = ["token", "low", "high", "mine", "node", "n", "comp", "pos", "marks"]
    return dealt.select(*columns).groupBy("token", "low", "high").applyInPandas(run, "a long, b long").distinct()


def _same_id(real: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Links between the classes of one ``doc_id``, which is one document however many texts it has."""
    again = stored(real.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    nodes = real.join(again, "doc_id", "left_semi").join(classes, keys).select("doc_id", "node")
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return stored(nodes.join(least, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Documents are linked when ``100 * |intersection| >= percent * |union|`` of
    their shingle sets; ``component_id`` is the smallest id reachable over
    links and ``kept`` marks it.  A null or blank text has no shingles and
    stands alone.  Rows that repeat a ``doc_id`` are one document with several
    texts.  A row with a null id is linked with nothing, has a null component
    and is kept.  Extra columns are ignored; no rows give no rows.
    """
    matches = matches_for(percent)
    found = stored(signatures(docs), "signatures")
    real = found.filter("n_shingles > 0 and doc_id is not null")
    keys = ["n_shingles", "key_a", "key_b"]
    classes = stored(real.groupBy(*keys).agg(F.min("doc_id").alias("node")), "classes")
    reps = stored(
        real.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *keys], "left_semi").dropDuplicates(["doc_id", *keys])
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sig", "marks"), "representatives")

    posted = stored(_postings(reps, matches), "postings")
    lists = stored(posted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1"), "lists")
    shared = stored(posted.join(lists, "token"), "shared")
    short = shared.filter(F.col("m") <= SHORT_LIST).drop("m")
    other = short.select("token", F.col("node").alias("o_node"), F.col("n").alias("o_n"))
    merged = short.join(other, "token").filter("node < o_node").filter(_sizes_fit("n", "o_n", percent))
    pairs = merged.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()

    candidates = stored(_colliding(pairs, reps, matches), "candidates")
    links = stored(_confirmed(candidates, _sets_of(candidates, docs), percent), "links").union(_same_id(real, classes, keys))
    labels = stored(components(links), "labels")
    listed = _with_component(shared.filter(F.col("m") > SHORT_LIST).drop("m"), labels)
    for turn in range(LEADER_ROUNDS):
        if _open_lists(listed).isEmpty():
            break
        candidates = stored(_colliding(_led_pairs(listed, turn, percent), reps, matches), "candidates")
        links = links.union(stored(_confirmed(candidates, _sets_of(candidates, docs), percent), "links"))
        labels = stored(components(links), "labels")
        listed = _with_component(listed.drop("comp"), labels)
    left_open = stored(listed.join(_open_lists(listed), "token", "left_semi").select("node").distinct(), "left_open")
    if not left_open.isEmpty():
        sets = stored(_full_sets(docs, left_open).join(left_open, "node", "left_semi"), "sets")
        marked = sets.join(reps.select("node", "marks"), "node")
        rare = stored(_rare_first(marked, percent), "rare")
        for lowest in (True, False):
            candidates = stored(_rest_pairs(rare, labels, percent, matches, lowest), "candidates")
            if candidates.isEmpty():
                break
            links = links.union(stored(_confirmed(candidates, sets, percent), "links"))
            labels = stored(components(links), "labels")

    of_class = classes.join(labels, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))
    of_class = stored(of_class, "components")
    judged = found.select("doc_id", *keys).join(of_class, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return judged.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
