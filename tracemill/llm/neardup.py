"""Near-duplicate documents by circulant MinHash, confirmed by exact Jaccard similarity of word shingles.

A shingle's 64-bit hash is taken to a 32-bit universe by a first permutation; a second permutation, whose argument is
shifted circularly by k, gives the k-th coordinate: two permutations make the whole signature. Signatures are cut into
bands; documents that share a band are candidates, and candidates are linked if their full shingle sets have
100 * intersection >= 75 * union. With 30 bands of 4 rows a pair at exactly 0.75 is missed with probability 1.2e-5.

Equal sets are one class from the start, and only classes are compared. Each set's shingles are also counted, odd or
even, in 1,024 places: two sets differ by at least one shingle where these differ, so that most pairs that aren't similar
enough are ruled out, and none that is, before full sets are compared. Inside a bucket no list of all pairs is
made: each member meets a few centres, links are joined to components, and what is left of the bucket (members of different
components that have not met) meets further centres, round after round, until nothing is left; a round's
work is bounded by its centres times the rows, and no pair between components is dropped.

Edge cases: null and empty texts, and those of white space, have no shingles and are linked with nothing; texts of fewer
than five words have one; rows with a null id take no part (component null, kept); rows that repeat an id and text are
the same document; of rows that share an id with different texts each has its own text's component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_staged, free_names, masked_places, mix64, place_mask, sliced, staged

WORDS, PERCENT = 5, 75
BANDS, ROWS = 30, 4
#: Centres that a bucket's members meet in the second round, 32 times as many in each later one, up to the most;
#: places that large classes are dealt out to.
CENTRES, MOST_CENTRES, DEALT = 128, 1 << 16, 16
MAX_WORDS = 150_000
#: Bits of a set's parities.
PARITY = 1024
MARK = F.xxhash64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Shingler:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The words' hashes; bytes.lower() and bytes.split() know just A-Z and just 20 and 09 to 0D."""
        if not text:
            return np.zeros(0, np.uint64)
        words = text.encode().lower().split()
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > MAX_WORDS:
                known.clear()
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    found[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(found, np.uint64)

    def set_of(self, text: str | None) -> np.ndarray:
        """The distinct shingles' hashes, sorted."""
        h = self.hashes(text)
        n = len(h)
        if not n:
            return h
        if n < WORDS:
            return mix64((h * ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        s = h[: n - WORDS + 1] * ODD[0]
        for k in range(1, WORDS):
            s = s + h[k : n - WORDS + 1 + k] * ODD[k]
        return np.unique(mix64(s))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of coordinates for each non-empty set."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        group = sets[first:last]
        x = (mix64(np.concatenate(group) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in group])[:-1]])
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.add(x, np.uint32(k * 0x01000193 & 0xFFFFFFFF), out=y)  # the circular shift
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(13), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            out[first:last, k] = np.minimum.reduceat(y, starts)
        first = last
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix64(key * ODD[r] + parts[:, :, r])
    return key.view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """For each of PARITY places of a set's hashes, whether an odd number of them falls there: as 64-bit words.

    Places where two sets' words differ hold at least one shingle that only one of the sets has, so their number is a
    lower bound of what the sets don't share.
    """
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & PARITY - 1, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, a, b, keys): mark tells texts of one id apart; the set's size, its digest in two halves, and its
    bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in sliced(batches):
            sets = [make.set_of(t) for t in batch.column(2).to_pylist()]
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), np.int64).reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys(signatures([sets[i] for i in full])), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "a", "b", "keys"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", MARK("text").alias("mark"), "text").mapInArrow(run, f"doc_id {key}, mark long, n long, a long, b long, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s, bits): the full shingle set of each wanted document (node, doc_id, mark), and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler()
        for batch in sliced(batches, 200):
            sets = [make.set_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))], ["node", "s", "bits"])

    chosen = docs.select("doc_id", MARK("text").alias("mark"), "text").join(wanted, ["doc_id", "mark"]).select("node", "text")
    return chosen.mapInArrow(run, "node long, s array<long>, bits array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("x"), F.col("s").alias("xs"))
    right = sets.select(F.col("node").alias("y"), F.col("s").alias("ys"))
    both = pairs.join(left, "x").join(right, "y").withColumn("i", F.size(F.array_intersect("xs", "ys")))
    return both.where(F.col("i") * 100 >= (F.size("xs") + F.size("ys") - F.col("i")) * PERCENT).select("x", "y")


def may_link() -> Column:
    """Whether the sizes n and cn and the parities bits and cbits leave a link possible: with j percent asked, at most
    (100 - j) / (100 + j) of both sizes' sum is not shared."""
    most = (F.col("n") + F.col("size")) * (100 - PERCENT)
    sizes = F.abs(F.col("n") - F.col("size")) * (100 + PERCENT) <= most
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("cbits")[i])) for i in range(PARITY // 64)), F.lit(0))
    return sizes & (apart * (100 + PERCENT) <= most)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (x, y): root is the smallest node reachable.

    Stars, large and small in turn, until nothing changes: every node ends beside its root. Groups are only ever reduced
    to their minimum and joined back, never listed.
    """
    now = staged(edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    while not _is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "edges")
        drop_staged(now)
        now = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._staged_path = now._staged_path
    return out


def _is_stars(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("child")))
    return ends.groupBy("node").agg(F.sum("child").alias("c"), F.min("child").alias("low")).where("c > 1 or c = 1 and low = 0").isEmpty()


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root) of the classes that are linked with others, roots aside. classes: (node, doc_id, mark, keys), where
    doc_id and mark name a row of ``docs`` that has the class's set."""
    rows = classes.select("node", F.posexplode("keys").alias("band", "key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    buckets = staged(rows.join(full, "key").dropDuplicates(["key", "node"]), "buckets")
    sets = staged(full_sets(docs, classes.select("node", "doc_id", "mark").join(buckets.select("node").distinct(), "node")), "sets")
    members = staged(buckets.join(sets.select("node", F.size("s").alias("n"), "bits").join(classes.select("node", "keys"), "node"), "node"), "members")
    drop_staged(buckets)
    mine = ["key", "band", "node", "n", "keys", "bits"]
    roots: DataFrame | None = None
    active, centres_each = members, CENTRES
    while True:
        if roots is None:  # the first round: every member meets its bucket's smallest
            now = active.withColumn("root", F.col("node"))
            centres = now.groupBy("key").agg(F.min(F.struct("node", "n", "root", "keys", "bits")).alias("c"))
            fresh = F.lit(True)
        else:
            now = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            # a pair between components has a member outside the bucket's largest one: those are the centres
            parts = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
            main = parts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", F.col("top.root").alias("main"))
            left = active
            active = staged(now.join(main, "key").select(*mine, "root", "main"), "active")
            if left is not members:
                drop_staged(left)
            if active.isEmpty():
                break
            now = active.drop("main")
            outside = active.where("root <> main").withColumn("place", F.pmod(F.xxhash64("node", "key"), F.lit(centres_each)))
            centres_each = min(centres_each * 32, MOST_CENTRES)
            centres = outside.groupBy("key", "place").agg(F.min(F.struct("node", "n", "root", "keys", "bits")).alias("c"))
            # a pair that shares several bands meets in the first of them only: whole keys, which are the buckets' own, so that
            # what is left out here is in an earlier bucket together
            earlier = lambda keys: F.slice(keys, 1, F.greatest("band", F.lit(1)))
            fresh = (F.col("band") == 0) | ~F.arrays_overlap(earlier("keys"), earlier("ck"))
        centres = staged(centres.select("key", F.col("c.node").alias("cn"), F.col("c.n").alias("size"), F.col("c.root").alias("cr"), F.col("c.keys").alias("ck"), F.col("c.bits").alias("cbits")), "centres")
        meets = now.join(centres, "key").where("node <> cn and root <> cr").where(may_link()).where(fresh)
        pairs = meets.select(F.least("node", "cn").alias("x"), F.greatest("node", "cn").alias("y")).distinct()
        found = staged(confirmed(pairs, sets), "links")
        if roots is None or not found.isEmpty():
            before = roots
            roots = components(found if before is None else found.union(before.select(F.col("node").alias("x"), F.col("root").alias("y"))))
            if before is not None:
                drop_staged(before)
        drop_staged(found)
        left = active
        active = staged(now.join(centres.select("key", F.col("cn").alias("node")), ["key", "node"], "left_anti").select(*mine), "left")
        if left is not members:
            drop_staged(left)
        drop_staged(centres)
    drop_staged(active, members, sets)
    return roots


def component_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = staged(signed(docs), "signed")
    some = found.where("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "mark")).alias("least")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).cast("int")
    classes = some.groupBy("a", "b").agg(least, F.max("doc_id").alias("top"), F.first("keys").alias("keys"), place_mask(place).alias("mask"))
    classes = staged(classes.select("a", "b", "least.*", "top", "keys", "mask", F.monotonically_increasing_id().alias("node")), "classes")
    roots = linked(docs, classes.select("node", "doc_id", "mark", "keys"))
    # a class or a component may be a large part of all rows: what belongs to it is dealt out to DEALT places, and what is
    # told about it goes to those that have any
    spread = F.pmod(F.xxhash64("node"), F.lit(DEALT)).cast("int")
    ends = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "doc_id"), "node").withColumn("place", spread)
    firsts = ends.groupBy("root", "place").agg(F.min("doc_id").alias("component_id")).groupBy("root").agg(F.min("component_id").alias("component_id"), place_mask(F.col("place")).alias("mask"))
    firsts = firsts.select("root", "component_id", masked_places(F.col("mask"), DEALT).alias("place"))
    named = ends.join(firsts, ["root", "place"]).select("node", "component_id")
    told = classes.select("a", "b", "node", "doc_id", "top", "mask").join(named, "node", "left").where("component_id is not null or top > doc_id")
    told = told.select("a", "b", F.coalesce("component_id", "doc_id").alias("component_id"), masked_places(F.col("mask"), DEALT).alias("place"))
    rows = found.where("doc_id is not null").select("doc_id", "mark", "n", "a", "b", F.when(F.col("n") > 0, place).alias("place"))
    out = rows.join(told, ["a", "b", "place"], "left").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = found.where("doc_id is null").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return component_rows(docs).drop("mark")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` that are kept: of each component those of its smallest id, each row by its own
    text. Rows with neither id nor component stay."""
    mark, = free_names(docs.columns, "mark")
    gone = component_rows(docs).where("not kept").select("doc_id", F.col("mark").alias(mark)).distinct()
    return docs.withColumn(mark, MARK("text")).join(gone, ["doc_id", mark], "left_anti").select(*map(col, docs.columns))


#: DuckDB SQL for ``near_duplicates``'s rows: all pairs that share a shingle, then reachability.
NEARDUP_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT i.x, i.y FROM i JOIN n p ON p.doc_id = i.x JOIN n q ON q.doc_id = i.y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id, n.doc_id = min(r.y) AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
