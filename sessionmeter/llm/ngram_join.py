"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are runs of characters other than the space and U+0009 to U+000D, in lower case (A-Z); a text of fewer words
than a shingle is one shingle. Texts with the same set are one class. Steps:

1. MinHash signatures; bands and rows follow from the recall wanted of pairs at the threshold (`banding`).
2. Classes that share a band hang together: components over one edge per class and band, not over pairs.
3. Each class's full set goes to its component, cut into blocks of about `BLOCK` classes; two blocks at a time meet in a
   task, which counts exact intersections. It returns a row per class: links and a root, never pairs.
4. Components over these roots give the groups.

Copies are never compared: a class stands for them, and its size counts in the links of others. A document without a
word is a class and a group of its own, without links. Null ids and repeated rows are rows like any other; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import WordHashes, byte_words, fresh, mix, ready
from sessionmeter.llm.graph import bit_filter, bit_place, components, stored, unstore

SHINGLE = 5
# the threshold as a fraction, compared in whole numbers
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.999
MOST_HASHES = 256
BLOCK = 96
BITS = 25
COLUMNS = 1 << 14


def banding(threshold: float = NUMERATOR / DENOMINATOR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands that still find a pair at the threshold with the wanted recall."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, ceil(log(1 - recall) / log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of([w.lower() for w in words])
    size = min(SHINGLE, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[k : len(h) - size + 1 + k]
    return np.unique(mix(out))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(1)
        self._a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self._b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self._bands, self._rows = bands, rows

    def bands(self, shingle_set: np.ndarray) -> np.ndarray:
        """A hash per band."""
        x = (shingle_set >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self._a), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), 2048):
            low = np.minimum(low, (x[s : s + 2048, None] * self._a + self._b).min(0))
        parts = low.reshape(self._bands, self._rows).astype(np.uint64)
        h = np.arange(self._bands, dtype=np.uint64)
        for k in range(self._rows):
            h = mix(h ^ parts[:, k] * np.uint64(0x9E3779B97F4A7C15))
        return h.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n (shingles), digest of the set, band hashes; stored, so that `row` stays."""
    bands, rows = banding()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        hashes, signer = WordHashes(), Signer(bands, rows)
        for part in batches:
            sets = [shingles(t, hashes) for t in part["text"]]
            yield pd.DataFrame(
                {
                    "row": part["row"], "doc_id": part["doc_id"], "text_hash": part["text_hash"], "n": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "bands": [signer.bands(s) if len(s) else None for s in sets],
                }
            )

    rows_in = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text",
    )
    out = rows_in.mapInPandas(sign, "row long, doc_id long, text_hash long, n long, digest binary, bands array<long>")
    return stored(out, "signatures")


def linked(keys: list[int], weights: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(class, documents linked, root) of the classes with a link; with sides, only pairs across them count."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    close = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n[:, None] + n[None, :])
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    root = np.array(keys, np.int64)
    while True:  # the least key that a chain of links reaches
        spread = np.where(close, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, spread)
        if (new == root).all():
            break
        root = new
    links = close @ weights
    return [(keys[i], int(links[i]), int(root[i])) for i in np.flatnonzero(links)]


def classes_and_links(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, class_row, class_doc, class_size, n_links, group_row, group_doc of every row of `docs`."""
    ready(docs.sparkSession)
    sig = signed(docs)
    classes = sig.where("digest is not null").groupBy("digest").agg(
        F.min("row").alias("c"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("size")
    )
    # one row stands for the class; its own id finds its text again
    reps = stored(
        sig.select(F.col("row").alias("c"), "doc_id", "text_hash", "n", "bands").join(classes, "c"), "classes"
    )
    band = reps.select("c", F.posexplode("bands").alias("band", "hash"))
    leads = band.groupBy("band", "hash").agg(F.min("c").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    near = components(band.join(leads, ["band", "hash"]).select(F.col("c").alias("a"), F.col("lead").alias("b")))
    sized = near.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    member = stored(
        near.join(sized, "root")
        .select(F.col("node").alias("c"), F.col("root").alias("component"), F.ceil(F.col("k") / BLOCK).cast("long").alias("blocks"))
        .join(reps.select("c", "doc_id", "text_hash", "digest", "size"), "c"),
        "members",
    )
    joined = _verified(docs, member)
    unstore(member)
    links = joined.groupBy("c").agg(F.sum("links").alias("links"))
    several = joined.where("blocks > 1").select(F.col("c").alias("a"), F.col("root").alias("b"))
    roots = joined.where("blocks = 1").select(F.col("c").alias("node"), "root").union(components(several))
    # a class that is a root in one block pair and a member in another is reached by the components above
    per_class = (
        classes.join(links, "c", "left").join(roots.groupBy(F.col("node").alias("c")).agg(F.min("root").alias("root")), "c", "left")
        .select("digest", "c", "first_doc", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "c").alias("group_row"))
    )
    # the group's least id is found among classes, of which even a large group has fewer than rows
    least = per_class.groupBy("group_row").agg(F.min("first_doc").alias("group_doc"))
    per_class = per_class.join(least, "group_row")
    wordless = F.col("c").isNull()
    return sig.select("row", "doc_id", "text_hash", "digest").join(per_class, "digest", "left").select(
        "row", "doc_id", "text_hash",
        F.coalesce("c", "row").alias("class_row"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("first_doc")).alias("class_doc"),
        F.coalesce("size", F.lit(1)).alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("group_row", "row").alias("group_row"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("group_doc")).alias("group_doc"),
    )


def _verified(docs: DataFrame, member: DataFrame) -> DataFrame:
    """c, links, root, blocks from the tasks that compare two blocks of a component."""
    wanted = np.frombuffer(bit_filter(member, bit_place(F.xxhash64("doc_id", "text_hash"), BITS), BITS), np.uint8)

    def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in batches:
            bit = part["bit"].to_numpy()
            part = part[(wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            yield pd.DataFrame(
                {"doc_id": part["doc_id"], "text_hash": part["text_hash"], "shingles": [shingles(t, hashes).tobytes() for t in part["text"]]}
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    ).where("text is not null").withColumn("bit", bit_place(F.xxhash64("doc_id", "text_hash"), BITS))
    sets = texts.mapInPandas(full_sets, "doc_id long, text_hash long, shingles binary")
    own = member.select("c", "component", "blocks", "size", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    found = own.join(sets, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    block = F.pmod(F.xxhash64("c"), F.col("blocks"))
    pairs = (
        found.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "blocks", "c", "size", "shingles")
    )

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("c").sort_values("c")  # repeated rows bring a set twice
        within = key[1] == key[2]
        if len(part) < 2:
            got = []
        else:
            sets_ = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
            got = linked(part["c"].tolist(), part["size"].to_numpy(np.int64), sets_, None if within else part["block"].to_numpy())
        blocks_ = part["blocks"].iloc[0]
        return pd.DataFrame([(c, n, r, blocks_) for c, n, r in got], columns=["c", "links", "root", "blocks"]).astype("int64")

    return stored(pairs.groupBy("component", "i", "j").applyInPandas(compare, "c long, links long, root long, blocks long"), "links")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least id with the same set), group_id (least id of the group), n_links (documents linked)."""
    return classes_and_links(docs).select("doc_id", F.col("class_doc").alias("class_id"), F.col("group_doc").alias("group_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the least id, with all columns; rows equal in id and text count once."""
    rows = stored(classes_and_links(docs).select("row", "doc_id", "text_hash", "group_row"), "groups")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keep = rows.groupBy("group_row").agg(F.min(least).alias("_k")).select(F.col("_k.row").alias("row"))
    chosen = rows.join(keep, "row").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    marked = chosen.join(repeated, same, "left").select("_id", "_hash", F.col("_rows").isNotNull().alias("_again"))
    marked = marked.toDF(*[fresh(docs, c) for c in marked.columns])
    id_, hash_, again_ = marked.columns
    kept = docs.join(marked, docs["doc_id"].cast("long").eqNullSafe(marked[id_]) & (F.xxhash64(docs["text"]) == marked[hash_]))
    single = kept.where(~F.col(again_)).select(*docs.columns)
    again = kept.where(F.col(again_)).dropDuplicates([id_, hash_]).select(*docs.columns)
    return single.unionByName(again)
