"""Near-duplicate documents by a blocked sparse product of document by n-gram incidence.

A document's set is its distinct shingles of ``SHINGLE`` words. Two documents link when the Jaccard
likeness of their sets is at least ``PERCENT``/100. The result is exact: the links' components.

The product of the incidence matrix with its transpose is never formed. It is cut down by bounds
that follow from the sizes of the sets alone:

* Equal sets are one row of the matrix, whatever the number of documents.
* All shingles have one order, and a set can link only with sets that share one of its first
  ``n - ceil(0.75 n) + 1`` shingles. Very frequent shingles come last in the order, so a passage
  that many documents share is not among the first ones of documents that are mostly other text.
* Blocks of documents learn from buckets of shingles which of these another block has too; only
  those become entries of the matrix.
* A pair is compared in full only if its sizes, the places of a shared shingle and the number of
  shared first shingles (the accumulated overlap) leave the threshold within reach. All that two
  sets share comes at or behind the first shingle that they share, so the smaller one shares some of
  its first ``n - ceil(6/7 n) + 1``: documents of one template whose own text is too long for a link
  share none of these and don't meet on the template at all.

Pairs inside a component are not enumerated. First each column of the matrix names one row as its
leader, the one with the earliest place (in a group of edited copies: the original), and rows are
compared with a few leaders. The links found give components. Then every pair of a column whose
rows are in different components is judged, leaving out pairs inside the column's largest
component. A pair that would link is in one of the two: no link between components is lost. Rows that
share a passage without linking do meet on it, as long as it is not frequent.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle has one shingle, the whole sequence; rows that repeat
a doc_id are one node, linked by any of their texts; rows without a doc_id have no component;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.components import connected_components
from lonja.llm.shared_hashes import ANSWERED, ASKED, HASH_BYTES, answer, answers_for, ask
from lonja.llm.text import ASCII_LOWER, NOT_SPACE, bounded, mixed, powers, utf8, word_bounds, word_hashes
from lonja.runtime import release, releases_staged, stage

SHINGLE = 5
PERCENT = 75
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: A shingle is frequent if it is in more sets than one in so many, and at least in FREQUENT_LEAST.
FREQUENT_SHARE = 1000
FREQUENT_LEAST = 64
#: How often a shingle must be in one slice of texts to be counted there.
FREQUENT_IN_SLICE = 4
#: With how many leaders a row is compared at first. Later pairs make up for the others.
LEADERS = 1
#: How many ids, of 8 bytes, may go to every executor.
IDS_TO_SEND = 1 << 21

_MEMBER, _OFTEN = "member", "often"
_SEEN = "kind string, doc_id bigint, n bigint, low bigint, high bigint, token bigint"
_SENT = "doc_id bigint, n bigint, token bigint, place bigint, known bigint"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(texts)
    starts, ends = word_bounds(data, offsets, NOT_SPACE)
    words = word_hashes(ASCII_LOWER[data], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    steps = powers(SHINGLE)
    grams = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for place in range(SHINGLE):
        grams += words[place : place + len(grams)] * steps[place]
    grams = mixed(grams)
    for first, last in zip(bounds.tolist(), bounds[1:].tolist()):
        if last - first >= SHINGLE:
            yield np.unique(grams[first : last - SHINGLE + 1])
        elif last > first:
            short = (words[first:last] * steps[: last - first]).sum(keepdims=True)
            yield mixed(short ^ np.uint64(0x5851F42D4C957F2D + last - first))
        else:
            yield np.zeros(0, np.uint64)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    low = mixed(tokens + np.uint64(1)).sum(dtype=np.uint64)
    high = mixed(tokens ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(low.astype(np.int64)), int(high.astype(np.int64))


def _prefix(size: int) -> int:
    return size - -(-PERCENT * size // 100) + 1


def _distinct_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """The distinct sets of some texts, and the number of each text's set (-1: empty)."""
    sets, numbers, which = [], {}, []
    for tokens in shingle_sets(texts):
        if not len(tokens):
            which.append(-1)
            continue
        key = (len(tokens), *_digest(tokens))
        if key not in numbers:
            numbers[key] = len(sets)
            sets.append(tokens)
        which.append(numbers[key])
    return sets, which


def _rows(schema: str, kind: str, count: int, **columns) -> dict[str, pa.Array]:
    """Columns of a schema: those given, the kind, and nulls."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    columns["kind"] = pa.array([kind] * count, pa.string())
    types = {f.split()[0]: kinds[f.split()[1]] for f in schema.split(", ")}
    return {n: columns[n] if n in columns else pa.nulls(count, t) for n, t in types.items()}


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set as size and digest, and the shingles that many sets of a slice have."""
    for batch in bounded(batches, limit=BLOCK_BYTES):
        sets, which = _distinct_sets(batch.column("text"))
        digests = [(len(s), *_digest(s)) for s in sets] + [(0, None, None)]
        mine = [digests[w] for w in which]
        columns = {name: pa.array([d[k] for d in mine], pa.int64()) for k, name in enumerate(("n", "low", "high"))}
        yield pa.RecordBatch.from_pydict(_rows(_SEEN, _MEMBER, len(mine), doc_id=batch.column("doc_id"), **columns))
        tokens, counts = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= FREQUENT_IN_SLICE
        columns = {"token": pa.array(tokens[often].view(np.int64)), "n": pa.array(counts[often].astype(np.int64))}
        yield pa.RecordBatch.from_pydict(_rows(_SEEN, _OFTEN, int(often.sum()), **columns))


def frequent_shingles(seen: DataFrame) -> np.ndarray:
    """The hashes of the shingles that come last in the order, sorted.

    No more than the average size of a set times ``FREQUENT_SHARE``, for any number of documents.
    """
    least = max(FREQUENT_LEAST, seen.where(F.col("kind") == _MEMBER).count() // FREQUENT_SHARE)
    counted = seen.where(F.col("kind") == _OFTEN).groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= least).select("token")
    return np.sort(np.array([r["token"] for r in found.toLocalIterator()], np.int64).view(np.uint64))


class _Block:
    """The distinct sets of a block's chosen documents, with the documents' smallest ids."""

    def __init__(self, table: pa.Table, chosen: pa.Array, frequent: np.ndarray):
        self.number = table["block"][0].as_py()
        table = table.filter(pc.is_in(table["doc_id"], value_set=chosen))
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = table["doc_id"].to_pylist()
        self.sets, self.which = [], []
        numbers: dict = {}
        for batch in bounded(table.select(["text"]).to_batches(), limit=BLOCK_BYTES):
            sets, which = _distinct_sets(batch.column("text"))
            digests = [(len(s), *_digest(s)) for s in sets]
            for tokens, key in zip(sets, digests):
                if key not in numbers:
                    numbers[key] = len(self.sets)
                    self.sets.append(tokens)
            self.which += [numbers[digests[w]] if w >= 0 else -1 for w in which]
        self.owner = [None] * len(self.sets)
        for doc_id, which in zip(reversed(self.doc_ids), reversed(self.which)):
            if which >= 0:
                self.owner[which] = doc_id
        firsts = []
        for tokens in self.sets:
            wanted = _prefix(len(tokens))
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                late = frequent[at] == tokens
                tokens = np.concatenate([tokens[~late][:wanted], tokens[late][:wanted]])
            firsts.append(tokens[:wanted])
        lengths = np.array([len(f) for f in firsts], np.int64)
        self.tokens = np.concatenate(firsts or [np.zeros(0, np.uint64)])
        self.holder = np.repeat(np.arange(len(firsts)), lengths)
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.distinct, self.token, counts = np.unique(self.tokens, return_inverse=True, return_counts=True)
        self.twice = counts > 1


def _ask(buckets: int, frequent):
    def run(table: pa.Table, chosen: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ask(0, np.zeros(0, np.uint64), buckets)
        block = _Block(table, chosen["doc_id"].combine_chunks(), frequent.value)
        return ask(block.number, block.distinct, buckets)

    return run


def _entries(columns) -> pa.Table:
    names = ("doc_id", "n", "token", "place", "known")
    return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, columns)})


def _send(buckets: int, frequent):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _entries(np.zeros((5, 0), np.int64))
        chosen = told["doc_id"].combine_chunks().drop_null()
        answers = told.filter(pc.is_valid(told["bucket"]))
        block = _Block(table, chosen, frequent.value)
        used = (block.twice | answers_for(block.distinct, buckets, answers))[block.token]
        holder = block.holder[used]
        owner = np.array(block.owner, np.int64)
        sizes = np.array([len(s) for s in block.sets], np.int64)
        # how many shingles before each one another set has too
        before = np.cumsum(used) - used
        known = before - before[np.flatnonzero(block.place == 0)][block.holder]
        tokens = block.tokens[used].view(np.int64)
        return _entries([owner[holder], sizes[holder], tokens, block.place[used], known[used]])

    return run


def _least_overlap(n: Column, m: Column) -> Column:
    """The smallest overlap at which two sets of these sizes link."""
    return F.ceil((n + m) * PERCENT / F.lit(100.0 + PERCENT) - 1e-9)


def _within_reach(n: Column, m: Column, place: Column, other: Column, known: Column, other_known: Column) -> Column:
    """Whether two sets can link that share a shingle at these places, it and others.

    They share at most that one, all behind it, and of those before it the ones that any other set
    has: what is a document's own is shared with none.
    """
    most = F.lit(1) + F.least(known, other_known) + F.least(n - place - 1, m - other - 1)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (most >= _least_overlap(n, m))


def _within_reach_of_first(n: Column, m: Column, place: Column, other: Column) -> Column:
    """Whether two sets can link whose first shared shingle is at these places."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (
        F.least(n - place, m - other) >= _least_overlap(n, m)
    )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, limit=BLOCK_BYTES):
        tokens = [t.view(np.int64) for t in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "tokens"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets link; staged. Only sets of some pair are made.

    Their ids go to the texts while they are few enough for that, and meet them in a shuffle if not.
    """
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "paired-ids")
    few = wanted.count() <= IDS_TO_SEND
    needed = texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    sets = stage(needed.mapInArrow(_whole_sets, "doc_id bigint, tokens array<bigint>"), "whole-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("b_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    whole = F.size("a_tokens") + F.size("b_tokens") - both
    linked = (both > 0) & (100 * both >= PERCENT * whole)
    found = stage(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"), "verified-links")
    release(wanted, sets)
    return found


def _leader_pairs(firsts: DataFrame) -> DataFrame:
    """Each row with the leaders of most of its columns: (a, b)."""
    leaders = firsts.groupBy("token").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("place", "n", "doc_id", "known")).alias("leader")
    )
    leaders = leaders.where(F.col("rows") > 1).select(
        "token",
        F.col("leader.doc_id").alias("b"),
        F.col("leader.n").alias("m"),
        F.col("leader.place").alias("other"),
        F.col("leader.known").alias("other_known"),
    )
    shared = (
        firsts.join(leaders, "token")
        .where(F.col("doc_id") != F.col("b"))
        .where(_within_reach(*map(F.col, ("n", "m", "place", "other", "known", "other_known"))))
        .groupBy(F.col("doc_id").alias("a"), "b")
        .count()
    )
    best = Window.partitionBy("a").orderBy(F.desc("count"), "b")
    return shared.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LEADERS).select("a", "b")


def _other_pairs(firsts: DataFrame, component: DataFrame) -> DataFrame:
    """All pairs in different components that can still link: (a, b); staged.

    Pairs inside a column's largest component are never formed. A pair that links has a column where
    the smaller set (of equal ones that of the smaller id) is among its first ``n - ceil(6/7 n) + 1``
    shingles, so a row without such a column is the larger one of its pairs or in none.
    """
    rows = (
        firsts.join(component, "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .select("token", "doc_id", "n", "place", "known", "component")
    )
    sizes = rows.groupBy("token", "component").count()
    columns = sizes.groupBy("token").agg(
        F.count(F.lit(1)).alias("components"), F.max(F.struct("count", "component")).alias("largest")
    )
    columns = columns.where(F.col("components") > 1).select("token", F.col("largest.component").alias("largest"))
    rows = stage(rows.join(columns, "token"), "open-columns")
    n, m = F.col("n"), F.col("m")
    early = rows.where(F.col("place") <= n - _least_overlap(n, n)).select("doc_id", "n").distinct()
    smaller = rows.join(early, ["doc_id", "n"], "left_semi")
    names = {"doc_id": "other_id", "n": "m", "place": "other", "known": "other_known", "component": "other_component"}

    def met(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        larger = larger.drop("largest").withColumnsRenamed(names)
        places = n, m, F.col("place"), F.col("other")
        in_order = (n < m) | ((n == m) & (F.col("doc_id") < F.col("other_id")))
        apart = F.col("component") != F.col("other_component")
        near = _within_reach(*places, F.col("known"), F.col("other_known"))
        return smaller.join(larger, "token").where(in_order & apart & near).select(
            "doc_id", "other_id", "n", "m", _within_reach_of_first(*places).alias("may_be_first")
        )

    outside = F.col("component") != F.col("largest")
    pairs = met(smaller.where(outside), rows).union(met(smaller.where(~outside), rows.where(outside)))
    # a pair of sets is judged by its own sizes: ids may hold several
    shared = pairs.groupBy("doc_id", "other_id", "n", "m").agg(
        F.count(F.lit(1)).alias("shared"), F.bool_or("may_be_first").alias("near")
    )
    enough = shared.where(F.col("near") & (F.col("shared") >= _least_shared(n, m)))
    a, b = F.least("doc_id", "other_id").alias("a"), F.greatest("doc_id", "other_id").alias("b")
    found = stage(enough.select(a, b).distinct(), "other-pairs")
    release(rows)
    return found


def _least_shared(n: Column, m: Column) -> Column:
    """How many first shingles two sets must share at least to link."""

    def outside(size: Column) -> Column:  # shingles that are not among the first ones
        return F.ceil(size * PERCENT / F.lit(100.0)) - 1

    overlap = _least_overlap(n, m)
    return F.least(overlap - outside(n), overlap - outside(m))


def _incidence(texts: DataFrame, class_ids: DataFrame, frequent) -> DataFrame:
    """The entries of the matrix that two rows share among their first shingles; staged."""
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 1
    blocks = math.ceil(size / BLOCK_BYTES)
    buckets = max(min(blocks, 256), math.ceil(size / 20 * HASH_BYTES / BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    in_blocks, chosen = texts.select("doc_id", "text", block), class_ids.select("doc_id", block)
    asked = in_blocks.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_ask(buckets, frequent), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    told = answered.unionByName(chosen, allowMissingColumns=True)
    sent = in_blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(buckets, frequent), _SENT)
    return stage(sent, "shingles")


@releases_staged
def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = stage(texts.mapInArrow(_see, _SEEN), "shingle-sets")
    members = seen.where(F.col("kind") == _MEMBER).select("doc_id", "n", "low", "high")
    numbered = F.col("doc_id").isNotNull()
    classes = members.where(numbered & (F.col("n") > 0)).groupBy("n", "low", "high")
    classes = stage(classes.agg(F.min("doc_id").alias("class_id")), "set-classes")
    class_ids = classes.select(F.col("class_id").alias("doc_id")).distinct()
    frequent = spark.sparkContext.broadcast(frequent_shingles(seen))
    texts = texts.where(numbered)
    firsts = _incidence(texts, class_ids, frequent)

    pairs = stage(_leader_pairs(firsts), "leader-pairs")
    links = _verified(pairs, texts)
    component = connected_components(links)
    release(pairs, links)
    pairs = _other_pairs(firsts, component)
    release(firsts)
    more = _verified(pairs, texts)
    release(pairs)
    if more.head(1):
        ties = component.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        component, before = connected_components(ties.union(more)), component
        release(before)
    release(more)

    known = members.join(classes, ["n", "low", "high"], "left").select("doc_id", "n", "class_id")
    repeated = known.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("a"))
    repeated = repeated.where(numbered & (F.col("a") != F.col("b")))
    if repeated.head(1):  # texts that share an id tie their classes together
        pairs = known.join(repeated.select("doc_id", "b"), "doc_id").where("class_id <> b")
        ties = component.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        component = connected_components(ties.union(pairs.select(F.col("class_id").alias("a"), "b")))
    component = component.select(F.col("doc_id").alias("class_id"), "component")
    found = F.coalesce("component", "class_id", "doc_id")
    return known.join(component, "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(numbered, found).alias("component_id")
    )
