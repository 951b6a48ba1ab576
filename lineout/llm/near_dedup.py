"""Near-duplicate groups by bottom-k sketches, inverted lists and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lineout.llm.common import map_arrow, stored
from lineout.llm.components import connected_components
from lineout.llm.words import blocks, mixed, shingles, words

SHINGLE = 5
PERCENT = 75  # linked if 100 * shared >= PERCENT * union
K = 128  # values retained per document
# Of the K smallest values of a union, a linked pair shares at least 3/4 on
# average and falls below this many with a chance under 1e-7.
SHARED = 70
FREQUENT = 16  # values retained by more documents come last in the index order
FILTER_BITS = 1 << 22  # bits of the maps by which rows are left out before a join

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>"


def _row_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, row = shingles(words(batch.column("text")), SHINGLE)
    values = hashes.view(np.int64)
    ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
    return [np.unique(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = _row_sets(batch)
        digests = np.array(
            [(mixed(s.view(np.uint64)).sum(), mixed(~s.view(np.uint64)).sum()) for s in sets], np.uint64
        ).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()),
             pa.array(digests[:, 1].copy()), _lists([s[:K] for s in sets])],
            ["doc_id", "n_shingles", "d1", "d2", "sketch"],
        )


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _set_reader(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets of the documents whose bit is set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = _id_bits(ids)
            batch = batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(_row_sets(batch))], ["node", "values"])

    return read


def _bitmap(values: DataFrame) -> np.ndarray:
    """A bit map of fixed size of the longs in the only column: FILTER_BITS / 64 rows at most reach the driver."""
    marks = map_arrow(values.select(F.col(values.columns[0]).alias("id")), _marks, "word long, bits long")
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for row in marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        bitmap[row.word] = row.bits
    return bitmap.view(np.uint8)


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, values): the whole sorted sets of the given documents, and of a few that share their bits.

    The bit map leaves the other documents out without moving a text; the joins
    that follow are by node, so the few more do no harm.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return stored(map_arrow(found, _set_reader(_bitmap(nodes)), "node long, values array<long>"))


def _value_reader(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tag, value) of the retained values whose bit is set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            values, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            tags = np.repeat(batch.column("tag").to_numpy(zero_copy_only=False), at)
            bit = _id_bits(values)
            keep = ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(tags[keep]), pa.array(values[keep])], ["tag", "value"])

    return read


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = _id_bits(batch.column("id").to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
    longs = bitmap.view(np.int64)
    used = np.flatnonzero(longs)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(longs[used])], ["word", "bits"])


def _linked(a: str, b: str) -> Column:
    """Estimate by the union's sketch first, then the exact test on full sets."""
    first_a, first_b = F.slice(a, 1, K), F.slice(b, 1, K)
    union = F.slice(F.array_sort(F.array_union(first_a, first_b)), 1, K)
    agree = F.size(F.array_intersect(union, F.array_intersect(first_a, first_b)))
    # A union of at most K values is seen as a whole; then the bar is below the exact one.
    passes = agree >= F.floor(F.size(union) * F.lit(SHARED / K))
    shared = F.size(F.array_intersect(a, b)).cast("long")
    return passes & (100 * shared >= PERCENT * (F.size(a) + F.size(b) - shared))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents are linked."""
    pairs = stored(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _full_sets(docs, nodes)
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a")
    return stored(joined.filter(_linked("set_a", "set_b")).select("a", "b").distinct())


def index_lists(sketches: DataFrame, reps: DataFrame) -> DataFrame:
    """Inverted lists of retained values with at least two members: (value, node, n, at, kept, size).

    Any fixed order of values serves: a linked pair shares SHARED retained values
    (3/4 of the larger sketch if that is small), so it shares one of the first
    retained - SHARED + 1 of each side. Values that many documents retain come
    last, so a passage in many texts is indexed only by documents that hold little
    else. ``at`` is the value's place in the node's order of ``kept`` values.
    """
    spread = sketches.select("tag", F.explode("sketch").alias("value"))
    frequent = stored(spread.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > FREQUENT))
    # Few values are frequent: the bit map spares moving all others to meet them.
    maybe = map_arrow(sketches.select("tag", "sketch"), _value_reader(_bitmap(frequent)), "tag long, value long")
    late = maybe.join(frequent, "value").groupBy("tag").agg(F.collect_list(F.struct("size", "value")).alias("late"))
    nodes = sketches.join(reps, "tag").join(late, "tag", "left")
    late_values = F.transform("late", lambda s: s["value"])
    ordered = F.when(F.col("late").isNull(), F.col("sketch")).otherwise(
        F.concat(F.array_except("sketch", late_values), F.transform(F.sort_array("late"), lambda s: s["value"]))
    )
    kept = F.size("sketch")
    needed = F.least(F.lit(SHARED), F.ceil(kept * F.lit(PERCENT / 100)).cast("int"))
    posted = nodes.select(
        F.col("rep").alias("node"), F.col("n_shingles").alias("n"), kept.alias("kept"),
        (kept - F.coalesce(F.size("late"), F.lit(0))).alias("early"),
        F.posexplode(F.slice(ordered, F.lit(1), kept - needed + 1)).alias("at", "value"),
    )
    columns = ["value", "node", "n", "at", "kept"]
    in_list = W.partitionBy("value")  # at most FREQUENT rows
    rare = posted.filter("at < early").select(*columns).withColumn("size", F.count(F.lit(1)).over(in_list)).filter("size > 1")
    common = posted.filter("at >= early").select(*columns)
    sizes = common.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    common = common.join(sizes, "value").withColumn("size", F.greatest("size", F.lit(FREQUENT + 1)))
    return stored(rare.unionByName(common))


def full_lists(sets: DataFrame) -> DataFrame:
    """Inverted lists as above over whole sets, ordered by how many of the given sets hold a value."""
    spread = sets.select("node", F.size("values").alias("n"), F.explode("values").alias("value"))
    held = spread.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    order = W.partitionBy("node").orderBy("size", "value")
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("node"))
    placed = spread.join(held, "value").withColumn("at", (alone + F.row_number().over(order) - 1).cast("int"))
    wanted = placed.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT / 100)))
    return stored(wanted.select("value", "node", F.col("n").cast("long").alias("n"), "at", F.col("n").alias("kept"), "size"))


def _may_link() -> Column:
    """Whether the members (node, n, at, kept) and (b, n_b, at_b, kept_b) of a list can still be linked.

    By size, and by how much the two can share if this value is the first they
    share in the order; the list of their first shared value lets any link pass.
    """
    sizes = 100 * F.least("n", "n_b") >= PERCENT * F.greatest("n", "n_b")
    whole = (F.col("kept") == F.col("n")) & (F.col("kept_b") == F.col("n_b"))
    exact = F.ceil(PERCENT * (F.col("n") + F.col("n_b")) / F.lit(100.0 + PERCENT) - 1e-9)
    rest = F.least(F.col("kept") - F.col("at"), F.col("kept_b") - F.col("at_b"))
    return sizes & (rest >= F.when(whole, exact).otherwise(F.lit(SHARED)))


def _renamed(lists: DataFrame, *more: str) -> DataFrame:
    return lists.select("value", F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "at", "kept", *more)])


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.filter(_may_link()).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Each member with its list's hub: the one with the fewest rarer values before, so the least edited."""
    hub = F.min(F.struct((F.col("at") / F.col("kept")).alias("share"), "node", "n", "at", "kept")).alias("hub")
    hubs = lists.groupBy("value").agg(hub).select("value", F.col("hub.node").alias("b"), *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("n", "at", "kept")])
    return _pairs(lists.join(hubs, "value").filter("node <> b"))


def _open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists that hold several components of the links so far, with each member's component."""
    groups = connected_components(links)
    placed = stored(lists.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    several = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return placed.join(several.select("value"), "value", "left_semi")


def _cross_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of list members in different components."""
    return _pairs(lists.join(_renamed(lists, "component"), "value").filter("node < b AND component <> component_b"))


def candidate_links(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """All links that the components need: (a, b).

    Members are first compared with their list's hub only, one row per member.
    Where a list still holds several components, pairs across components follow;
    a group of copies that the hub has joined is never expanded. Lists of frequent
    values are replaced for that step: their members are indexed again by whole
    sets, which admits only pairs that differ in few rare shingles.
    """
    tried = stored(_hub_pairs(lists))
    links = _verified(tried, docs)
    still_open = stored(_open_lists(lists, links))
    pairs = stored(_cross_pairs(still_open.filter(F.col("size") <= FREQUENT)).join(tried, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(_verified(pairs, docs)))
    tried = tried.unionByName(pairs)

    members = stored(still_open.filter(F.col("size") > FREQUENT).select("node").distinct())
    whole = full_lists(_full_sets(docs, members).join(members, "node", "left_semi"))
    pairs = stored(_hub_pairs(stored(_open_lists(whole, links)).select(*whole.columns)).join(tried, ["a", "b"], "left_anti"))
    links = stored(links.unionByName(_verified(pairs, docs)))
    tried = tried.unionByName(pairs)
    pairs = _cross_pairs(stored(_open_lists(whole, links))).join(tried, ["a", "b"], "left_anti")
    return links.unionByName(_verified(pairs, docs))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct ``SHINGLE``-word shingles over lower-cased
    words (the whole text if shorter), as 64-bit hashes. Documents are linked at
    ``PERCENT`` percent Jaccard similarity, tested on whole sets; component_id is
    the smallest id reachable, and that document is kept.

    Equal sets collapse to one node before anything is compared. Null or empty
    texts have no shingles and are linked with nothing. A row without an id stands
    alone: component_id null, kept. Rows that share an id are one document, linked
    with whatever any of them is linked with. An empty table gives no rows.
    """
    read = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _sketched, SKETCH)
    sketches = stored(read.withColumn("tag", F.monotonically_increasing_id()))
    usable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "d1", "d2"]
    classes = stored(usable.groupBy(*key).agg(F.min(F.struct("doc_id", "tag")).alias("r")).select(*key, "r.doc_id", "r.tag").withColumnRenamed("doc_id", "rep"))
    members = stored(usable.select("doc_id", *key).join(classes.select(*key, "rep"), key).select("doc_id", "rep"))
    homes = members.groupBy("doc_id").agg(F.min("rep").alias("home"))
    same_id = members.join(homes, "doc_id").filter("rep <> home").select(F.col("home").alias("a"), F.col("rep").alias("b"))
    lists = index_lists(usable.select("tag", "n_shingles", "sketch"), classes.select("tag", "rep"))
    found = connected_components(candidate_links(lists, docs).unionByName(same_id))
    ends = homes.join(found.withColumnRenamed("node", "home"), "home", "left").select("doc_id", F.coalesce("component", "home").alias("c"))
    rows = sketches.select("doc_id", "n_shingles").join(ends, "doc_id", "left")
    component = F.coalesce("c", "doc_id").alias("component_id")
    return rows.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
