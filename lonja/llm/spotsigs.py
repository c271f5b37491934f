"""SpotSigs: signatures of content words that follow common words.

Every common word of a text is an anchor; its signature is the anchor with the ``CHAIN`` content
words that follow it (words are letters and digits of any script, lowered). Boilerplate without
running text has few anchors, so signatures stand for what a document says. Where no anchor stands
before a word or the ``REACH`` - 1 content words ahead of it, the word starts a chain of its own
without an anchor, so that lists, tables and texts of other languages have fingerprints too. That
depends on the words nearby only: what two texts share gives the same signatures in both, whatever
common words stand elsewhere. The set of signature hashes is the fingerprint.

``near_duplicates`` compares sets: they are partitioned by length, a set meets only partitions
within the threshold's reach, there only sets that share one of its rarest signatures, and the
Jaccard likeness is computed in full only for those.

Everything is DataFrame functions. Defined results: a null text is an empty one; a text without
words has an empty fingerprint, and two empty fingerprints are alike (1); the next document is the
one with the next doc_id, of rows that share an id the one whose text hashes next, and after the
last comes the first; a row without a doc_id stands outside of that order and is followed by
nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common_words import COMMON_WORDS
from lonja.runtime import stage

CHAIN = 2
REACH = 4
THRESHOLD = 0.75
_GLUE = "\x01"
_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _anchor_pattern() -> str:
    """The common words, grouped by their first letters; longer words are passed over at once."""
    heads = sorted({w[0] for w in _WORDS})
    groups = (f"{h}(?:{'|'.join(w[1:] for w in _WORDS if w[0] == h)})" for h in heads)
    longest = max(map(len, _WORDS))
    return rf"(?<=[ {_GLUE}])(?=[^ ]{{1,{longest}}} )({'|'.join(groups)}) "


_ANCHORS = _anchor_pattern()


def _units(text: Column) -> Column:
    """The content words, each with the common words before it glued on."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    glued = F.regexp_replace(words, _ANCHORS, f"$1{_GLUE}")
    return F.filter(F.split(glued, " "), lambda u: u != "")


def _content(unit: Column) -> Column:
    return F.substring_index(unit, _GLUE, -1)


def _signatures(units: Column, anchors: Column) -> Column:
    """The sorted distinct signatures of glued words; ``anchors`` tells which have an anchor."""
    following = [F.slice(units, 1 + n, F.greatest(F.size(units) - n, F.lit(0))) for n in range(1, CHAIN)]
    rows = F.arrays_zip(
        units.alias("c0"),
        *(f.alias(f"c{n + 1}") for n, f in enumerate(following)),
        *(F.slice(F.concat(F.array_repeat(F.lit(False), n), anchors), 1, F.size(units)).alias(f"a{n}") for n in range(REACH)),
    )

    def chain(row: Column, anchor: Column) -> Column:
        return F.hash(anchor, *(_content(row[f"c{n}"]) for n in range(CHAIN)))

    def chains(row: Column) -> Column:
        parts = F.split(row["c0"], _GLUE)
        anchored = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda anchor: chain(row, anchor))
        return F.when(row["a0"], anchored).otherwise(F.array(chain(row, F.lit(""))))

    def starts(row: Column) -> Column:
        covered = row["a1"]
        for n in range(2, REACH):
            covered = covered | row[f"a{n}"]
        return row["a0"] | ~covered

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(rows, starts), chains))))


def with_signatures(df: DataFrame, text: str, signatures: str) -> DataFrame:
    """Add the signatures of a text column."""
    df = df.withColumn("_units", _units(F.col(text)))
    df = df.withColumn("_anchors", F.transform("_units", lambda u: F.instr(u, _GLUE) > 0))
    return df.withColumn(signatures, _signatures(F.col("_units"), F.col("_anchors"))).drop("_units", "_anchors")


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard likeness of two sets of signatures."""
    both = F.size(F.array_intersect(left, right))
    whole = F.size(left) + F.size(right) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def _successors(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``n_chars`` with the ``next_id`` and ``next_key`` in the ids' order.

    Ids are dealt out by range. Only the first id of each range, one row per partition, is ordered
    in one place.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = texts.where(F.col("doc_id").isNotNull()).select("doc_id", "key", "n_chars").distinct()
    ids = ids.repartitionByRange(parts, "doc_id", "key").withColumn("part", F.spark_partition_id())
    ids = stage(ids, "id-order")
    ordered = Window.partitionBy("part").orderBy("doc_id", "key")
    ids = ids.withColumn("next", F.lead(F.struct("doc_id", "key")).over(ordered))
    firsts = ids.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        "part",
        F.coalesce(F.lead("first").over(whole.orderBy("part")), F.min("first").over(whole)).alias("after"),
    )
    following = F.coalesce("next", "after")
    return ids.join(firsts, "part").select(
        "doc_id", "key", "n_chars", following["doc_id"].alias("next_id"), following["key"].alias("next_key")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's signatures, those of its edited text, and the likeness to its neighbours.

    In the edited text the last half gives way to as many characters from the start of the next
    document. Texts are shuffled once, and once more as the halves that move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"), F.char_length(text).cast("long").alias("n_chars"))
    order = _successors(texts)
    held = texts.where(F.col("doc_id").isNotNull()).select("doc_id", "key", "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # the texts' side is the same in both joins, so it is shuffled once
    wanted = order.select(
        F.col("doc_id").alias("to_id"), F.col("key").alias("to_key"), "n_chars",
        F.col("next_id").alias("doc_id"), F.col("next_key").alias("key"),
    )
    moved = with_signatures(wanted.join(held, ["doc_id", "key"]), "text", "next_signatures").select(
        F.col("to_id").alias("doc_id"),
        F.col("to_key").alias("key"),
        F.substring("text", F.lit(1), half).alias("head"),
        "next_signatures",
    )
    moved = moved.dropDuplicates(["doc_id", "key"])
    nothing = F.lit("").alias("head"), F.array().cast("array<int>").alias("next_signatures")
    joined = held.join(moved, ["doc_id", "key"]).unionByName(
        texts.where(F.col("doc_id").isNull()).select("doc_id", "key", "text", *nothing)
    )
    joined = joined.withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    joined = joined.withColumn("edited", F.concat(kept, "head"))
    joined = with_signatures(with_signatures(joined, "text", "signatures"), "edited", "edited_signatures")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited",
        "signatures",
        "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def near_duplicates(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (``a``, ``b``) of different sets at least ``threshold`` alike, by their smallest ids.

    ``signed`` has ``doc_id`` and ``signatures``; equal sets are compared once.
    """
    sets = signed.where(F.size("signatures") > 0).groupBy("signatures").agg(F.min("doc_id").alias("id"))
    sets = stage(sets.withColumn("n", F.size("signatures")), "signature-sets")
    spots = sets.select("id", "n", F.explode("signatures").alias("spot"))
    rarity = spots.groupBy("spot").count()
    rank = Window.partitionBy("id").orderBy("count", "spot")
    first = spots.join(rarity.where("count > 1"), "spot").withColumn("place", F.row_number().over(rank))
    single = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))  # signatures of no other set come first
    first = first.withColumn("place", F.col("place") + single).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    # a partition holds lengths within one factor of the threshold; a set meets its own and the next
    length = F.floor(F.log(1 / threshold, F.col("n").cast("double")) + 1e-9)
    first = first.select("id", "n", "spot", length.alias("part"))
    other = first.select(
        F.col("id").alias("other"), F.col("n").alias("m"), "spot", F.explode(F.array("part", F.col("part") + 1)).alias("part")
    )
    within = (F.least("n", "m") >= threshold * F.greatest("n", "m")) & (F.col("id") != F.col("other"))
    pairs = first.join(other, ["spot", "part"]).where(within)
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("signatures").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("signatures").alias("right"))
    alike = likeness(F.col("left"), F.col("right"))
    return pairs.join(left, "a").join(right, "b").where(alike >= threshold).select("a", "b", alike.alias("likeness"))
