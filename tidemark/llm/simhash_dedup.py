"""SimHash near-duplicates by covering locality-sensitive hashing.

Pagh's covering construction (SODA 2016): every bit position i gets a random vector m(i) of radius+1 bits, and
table v (each non-zero vector) hashes the bits i with <m(i), v> = 1. Up to ``radius`` differing positions cannot
span all radius+1 dimensions, so some table ignores them all: every pair within the radius collides in it.

Work is on distinct fingerprints. A table's buckets of up to ``pair_bucket`` fingerprints give their pairs. In a
larger bucket, with radius 2, two fingerprints are within the radius exactly if they meet at one value at most
one flip away from each; all fingerprints meeting at a value are hung on the smallest, which needs rows in
proportion to the bucket instead of to its square. Both ways are exact, so the switch changes no result.

With a ``similarity``, two documents are near-duplicates if the Jaccard similarity of their sets of shingles (as
64-bit hashes) is at least that. The covering search then only proposes pairs; the others come from prefix filtering
(Chaudhuri et al., 2006): in any fixed order of all shingles, sets of n and m shingles with similarity t share one
among the first n - ceil(t n) + 1 and m - ceil(t m) + 1. Shingles that are frequent in a sample of the texts go last
in that order, which keeps the buckets small and changes no result. The first shingle that two similar sets share stands
early enough in both for all others to follow, so a bucket compares only members with such places (Xiao et al., 2008).
Similar sets also share many of these first shingles, as few of either may be missing from the other: only pairs that do
are verified, on the whole sets. First each member of a bucket is compared with three of its members. One is that with
the fewest shingles ahead of the bucket's: edited copies have their own ones there, so it is the least edited copy, to
which most similar ones are similar. Then the pairs of a bucket that are not yet in one component are compared, and they
alone are formed; members that stay apart still meet in pairs where their sizes and places allow the similarity. Shingles
of one set alone and texts without a pair are held back by sieves of bits before any shuffle, and tables go when their
last reader is written.
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, emptied, joined_evenly, pick, sieved, table, text_batches, written

SHINGLE, SEED, RADIUS = 3, 42, 2
CHUNK = 1 << 16
#: Members of a posting that one task compares with the others.
DEALT = 4096
#: Bits a key of the sieves: one in about as many rows passes in vain, and the driver holds each sieve while it sends it.
SPARSE = 32
#: One in SAMPLE texts tells which shingles are frequent: the first COMMON of those seen COMMON_LEAST times. They change speed alone.
SAMPLE, COMMON_LEAST, COMMON = 16, 3, 1 << 16


def shingles(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, in order and with repeats; a shorter text is one shingle, null counts as empty.

    Words are found in arrays and hashed CHUNK shingles at a time, so that a long text needs few bytes beside its own.
    """
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(first):
        return np.zeros(0, np.uint64)
    lengths = np.flatnonzero(~space & np.append(space[1:], True)) + 1 - first
    joined = raw[~space | np.append(~space[1:], False)]  # each word after one space
    joined[np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))] = 32
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1
    ends = (starts + lengths)[min(size, len(starts)) - 1 :]
    whole, digest, n = joined.tobytes(), xxhash.xxh64_intdigest, len(ends)
    out = np.empty(n, np.uint64)
    for i in range(0, n, CHUNK):
        spans = zip(starts[i : min(n, i + CHUNK)].tolist(), ends[i : i + CHUNK].tolist())
        out[i : i + CHUNK] = np.fromiter((digest(whole[a:b], seed) for a, b in spans), np.uint64)
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer; zero without hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer; null counts as empty."""
    return majority(shingles(text, size, seed))


def row_keys(id_: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes, k1 and k2, that rows share only if id and text are equal."""
    parts = [id_.isNull(), id_, text.isNull(), text]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, k1, k2, fp long) of every row of (id, k1, k2, text)."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, size, seed) for t in texts], dtype="int64")

    return docs.select("id", "k1", "k2", fingerprint("text").alias("fp"))


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks as signed integers; see the module's docstring."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1 << (radius + 1)) for _ in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def links(fps: DataFrame, pair_bucket: int = 8) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that connect all pairs within radius 2, and no others."""
    masks = F.array(*[F.lit(m) for m in covering_masks()])
    tables = fps.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("t", "b"))
    sizes = tables.groupBy("t", "b").agg(F.count("*").alias("n")).where("n > 1")
    full = written(tables.join(sizes, ["t", "b"]), "simhash-buckets")
    few = full.where(F.col("n") <= pair_bucket).groupBy("t", "b").agg(F.collect_list("fp").alias("fps"))
    few = few.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))
    few = few.where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))
    # one row for each flip of a bit and the fingerprint itself, once for each fingerprint however many large buckets hold it
    flips = F.array(F.lit(0), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(64)])
    crowded = full.where(F.col("n") > pair_bucket).select("fp").distinct()
    many = crowded.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))
    meet = many.groupBy("at").agg(F.min("fp").alias("v"), F.max("fp").alias("_max")).where("v != _max").drop("_max")
    hung = many.join(meet, "at").where("fp != v").select(F.col("fp").alias("u"), "v")
    return few.unionByName(hung)


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that are frequent in a sample of the different texts of (id, text), the most frequent last; COMMON at most."""

    @F.pandas_udf("array<long>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingles(t, size)).view(np.int64) for t in texts])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    often = sample.select(F.explode(distinct("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST)
    top = often.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()["h"].to_numpy()
    return top[::-1].astype(np.int64).view(np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n sorted different shingles: by hash, then the common ones (sorted) by rank."""
    n = len(hashes)
    if not n:
        return hashes
    most = n + 1 + -(n * similarity.numerator) // similarity.denominator
    place = np.searchsorted(common, hashes)
    known = np.append(common, np.uint64(0))[place] == hashes
    known &= place < len(common)
    late = hashes[known][np.argsort(rank[place[known]])]
    return np.concatenate((hashes[~known], late))[:most]


def shingle_sets(docs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """(id, k1, k2, t, fp, c, n, prefix) of (id, k1, k2, text): t is the text's hash, c the set's, n its size."""
    frequent = common_shingles(docs, size)
    rank = np.argsort(frequent)
    common = frequent[rank]

    @F.pandas_udf("fp long, c long, n long, prefix array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = shingles(text, size)
            alone = np.unique(hashes)
            out.append((majority(hashes), set_hash(alone), len(alone), prefix(alone, common, rank, similarity).view(np.int64)))
        return pd.DataFrame(out, columns=["fp", "c", "n", "prefix"])

    return docs.select("id", "k1", "k2", F.xxhash64("text").alias("t"), describe("text").alias("got")).select("id", "k1", "k2", "t", "got.*")


def set_hash(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def lengths_fit(n: str, m: str, similarity: Fraction) -> Column:
    p, q = similarity.numerator, similarity.denominator
    return (F.col(n) * q >= F.col(m) * p) & (F.col(m) * q >= F.col(n) * p)


def least_shared(n: str, m: str, similarity: Fraction) -> Column:
    """Of two sets with the similarity, how many shingles they share at least: p / (p + q) of both sizes."""
    p, q = similarity.numerator, similarity.denominator
    return F.ceil((F.col(n) + F.col(m)) * p / F.lit(p + q) - F.lit(1e-6))


def places_fit(n: str, m: str, i: str, j: str, similarity: Fraction) -> Column:
    """Whether the shingle at places i and j, from 0, can be the first that two similar sets share: enough must follow it."""
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= least_shared(n, m, similarity)


def hopeful(pairs: DataFrame, classes: DataFrame, similarity: Fraction) -> DataFrame:
    """The different pairs (u, v) of sets c, u below v, whose sizes and prefixes allow the similarity."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct()
    heads = classes.select("c", "n", "prefix")
    pairs = pairs.join(heads.toDF("u", "nu", "x"), "u").join(heads.toDF("v", "nv", "y"), "v").where(lengths_fit("nu", "nv", similarity))
    # what a set's prefix may miss of the shared shingles is no more than what the set may
    least = least_shared("nu", "nv", similarity) + F.least(F.size("x") - F.col("nu"), F.size("y") - F.col("nv"))
    return written(pairs.where(F.size(F.array_intersect("x", "y")) >= least).select("u", "v"), "simhash-pairs")


def whole_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(c, hashes) of the sets that occur in pairs; each from one text, which is the only time that texts are moved for it."""

    @F.pandas_udf("c long, hashes array<long>")
    def again(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingles(t, size)) for t in texts]
        return pd.DataFrame([(set_hash(x), x.view(np.int64)) for x in sets], columns=["c", "hashes"])

    wanted = pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct().join(classes, "c").select("t", F.col("c").alias("_c"), "rows")
    wanted = written(wanted, "simhash-wanted")
    texts = joined_evenly(sieved(docs.select(F.xxhash64("text").alias("t"), "text"), wanted, "t", SPARSE), wanted, ["t"], "rows")
    texts = texts.groupBy("_c").agg(F.first("text").alias("text"))
    return written(texts.select("_c", again("text").alias("got")).where("got.c = _c").select(F.col("_c").alias("c"), "got.hashes"), "simhash-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of the pairs that have the similarity, by their whole sets."""
    p, q = similarity.numerator, similarity.denominator
    both = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    shared = both.withColumn("_n", F.size(F.array_intersect("x", "y")).cast("long"))
    enough = (p + q) * F.col("_n") >= p * (F.size("x").cast("long") + F.size("y"))
    return written(shared.where(enough).select("u", "v"), "simhash-similar")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs whose sets are not yet in one component."""
    at = roots.select(F.col("node").alias("_node"), "root")
    rooted = pairs.join(at.toDF("_u", "_ru"), F.col("u") == F.col("_u"), "left").join(at.toDF("_v", "_rv"), F.col("v") == F.col("_v"), "left")
    return rooted.where(F.coalesce("_ru", "u") != F.coalesce("_rv", "v")).select("u", "v")


def similar(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """Links (u, v) that connect what the pairs of sets c with the similarity connect, and no others.

    One pair of each set comes first, that with the smallest partner. Other pairs count only where they would connect
    what is still apart, so that a group of copies costs whole sets in proportion to its members, not to its pairs.
    """
    pairs = hopeful(pairs, classes, similarity)
    sets = whole_sets(docs, pairs, classes, size)
    first = verified(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), sets, similarity)
    rest = verified(apart(pairs, written(components(first, "simhash-links"), "simhash-roots")), sets, similarity)
    emptied(pairs, sets)
    return first.unionByName(rest)


def unlike(rooted: DataFrame, similarity: Fraction, chunk: int = DEALT) -> DataFrame:
    """(u, v) of sets that share a posting but no component, where sizes and places allow the similarity.

    In each posting all members meet only those outside the component with most members there, each two components on
    one side. Members of that component are never compared with each other, and like members of another one no oftener than they
    meet the largest, so the work is at most twice that of the pairs across components. Members of large postings are
    dealt out in chunks, to each of which the others are sent.
    """
    counts = rooted.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h")
    counts = counts.agg(F.max(F.struct("k", "root"))["root"].alias("most"), F.count("*").alias("_r"), F.sum("k").alias("_k")).where("_r > 1")
    counts = written(counts.select("h", "most", "_k", F.ceil(F.col("_k") / chunk).cast("int").alias("chunks")), "simhash-apart")
    dealt = joined_evenly(sieved(rooted, counts, "h", SPARSE), counts, ["h"], "_k")
    x = dealt.select("h", F.pmod(F.xxhash64("c"), "chunks").cast("int").alias("at"), *[F.col(a).alias(b) for a, b in (("c", "u"), ("n", "nu"), ("i", "iu"), ("root", "ru"), ("most", "most"))])
    y = dealt.where("root != most").select("h", F.explode(F.expr("sequence(0, chunks - 1)")).alias("at"), *[F.col(a).alias(b) for a, b in (("c", "v"), ("n", "nv"), ("i", "iv"), ("root", "rv"))])
    fit = lengths_fit("nu", "nv", similarity) & places_fit("nu", "nv", "iu", "iv", similarity)
    return x.join(y, ["h", "at"]).where(((F.col("ru") == F.col("most")) | (F.col("ru") < F.col("rv"))) & fit).select("u", "v")


def similar_links(docs: DataFrame, classes: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """(u, v) links among the different sets c that connect all pairs with the similarity, and no others."""
    holders = classes.groupBy("fp").agg(F.min("c").alias("p"))
    near = links(classes.select("fp").distinct())
    near = near.join(holders.toDF("u", "pu"), "u").join(holders.toDF("v", "pv"), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
    same = classes.join(holders, "fp").select(F.col("c").alias("u"), F.col("p").alias("v"))
    postings = classes.select("c", "n", F.posexplode("prefix").alias("i", "h"))
    often = written(postings.groupBy("h").agg(F.count("*").alias("_k")).where("_k > 1"), "simhash-often")
    full = written(joined_evenly(sieved(postings, often, "h", SPARSE), often, ["h"], "_k"), "simhash-postings")
    one = F.struct("c", "n", "i")
    pivots = full.groupBy("h").agg(F.min_by(one, F.struct("i", "c")).alias("_a"), F.max(one).alias("_b"), F.min_by(one, F.xxhash64("c")).alias("_c"), F.count("*").alias("_k"))
    stars = joined_evenly(full, written(pivots, "simhash-pivots"), ["h"], "_k")
    stars = stars.select(F.col("c").alias("u"), "n", "i", F.explode(F.array("_a", "_b", "_c")).alias("v")).select("u", "n", "i", F.col("v.c").alias("v"), F.col("v.n").alias("m"), F.col("v.i").alias("j"))
    stars = stars.where(lengths_fit("n", "m", similarity) & places_fit("n", "m", "i", "j", similarity)).select("u", "v")
    first = similar(docs, near.unionByName(same).unionByName(stars), classes, size, similarity)
    roots = written(components(first, "simhash-links"), "simhash-roots")
    rooted = full.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = written(rooted, "simhash-rooted")
    emptied(full)
    rest = similar(docs, unlike(rooted, similarity), classes, size, similarity)
    emptied(rooted)
    return first.unionByName(rest)


def classified(texts: DataFrame, size: int, similarity: float | None, keep_rows: bool = True) -> tuple[DataFrame, DataFrame, str]:
    """Rows, labels and their common column: a class of texts that the search takes for one (a fingerprint or a set).

    Rows are (id, k1, k2, class) of every row of (id, k1, k2, text), labels (class, rows, best) of every class; best is
    the first of its component's rows by (id is null, id, k1, k2). Without ``keep_rows`` the rows of a search by similarity
    are not stored: reading them would compute them again.
    """
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("rep"), F.count("*").alias("rows")
    if similarity is None:
        base, node = written(fingerprints(texts, size), "simhash-fp"), "fp"
        classes = written(base.groupBy("fp").agg(*one), "simhash-classes")
        found = links(classes.select("fp"))
    else:
        least, node = Fraction(str(similarity)), "c"
        if not 0 < least <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        text_batches(texts.sparkSession)
        base = shingle_sets(texts, size, least)
        if keep_rows:
            base = written(base, "simhash-fp")
        same = [F.first(x).alias(x) for x in ("n", "prefix")]
        # texts with one set may differ in their order or repeats of shingles, and so in fp
        classes = written(base.groupBy("c").agg(*one, F.min("t").alias("t"), F.min("fp").alias("fp"), *same), "simhash-classes")
        found = similar_links(texts, classes, size, least)
    roots = written(components(found, "simhash-links"), "simhash-roots")
    linked = written(classes.join(roots, classes[node] == roots.node).select(node, "rows", "rep", "root"), "simhash-linked")
    best = written(linked.groupBy("root").agg(F.min("rep").alias("best"), F.count("*").alias("_n")), "simhash-best")
    alone = classes.join(roots, classes[node] == roots.node, "left_anti").select(node, "rows", F.col("rep").alias("best"))
    labels = joined_evenly(linked, best, ["root"], "_n").select(node, "rows", "best").unionByName(alone)
    labels = written(labels, "simhash-labels")
    emptied(classes)
    return base, labels, node


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row for each input row: id, fp, component_id (smallest id reachable by links).

    Links are pairs of fingerprints within radius 2 or, given a similarity, pairs of texts whose sets of shingles
    have that Jaccard similarity at least, whatever their fingerprints. Null texts count as empty; documents without
    words have fingerprint zero and no shingle, and link with each other. Null ids keep their row; component_id is
    the smallest non-null id, null where a component has none. Repeated rows stay. An empty table gives an empty
    result. Texts may be of any length: a row's work and memory grow with its text alone.
    """
    texts = pick(docs, id=id_col, text=text_col)
    base, labels, node = classified(texts.select("id", *row_keys(F.col("id"), F.col("text")), "text"), size, similarity)
    return joined_evenly(base.select("id", *{"fp", node}), labels, [node], "rows").select("id", "fp", F.col("best.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row, with all its columns, of each component: the first by id (nulls last), then by a hash of id and text.

    Rows that agree in id and text count once, as the one whose other columns have the smallest hash. Rows of one id and
    unlike texts are in components of their own, so none of them goes for another's sake. Null and empty texts, and
    texts without words, are one component. An empty table gives an empty result.
    """
    names = [f"x{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    keys = row_keys(id_, text)
    _, labels, _ = classified(plain.select(id_.alias("id"), *keys, text.alias("text")), size, similarity, keep_rows=False)
    winners = labels.select("best.k1", "best.k2").distinct()
    order = F.xxhash64(*[c for c, kind in plain.dtypes if "map<" not in kind and kind != "variant"])
    rows = plain.select(*keys, F.struct(*names).alias("row"), order.alias("order"))
    # equal rows meet before the shuffle, so that none of them fills a task
    rows = rows.groupBy("k1", "k2").agg(F.min_by("row", "order").alias("row"))
    return rows.join(winners, ["k1", "k2"], "left_semi").select("row.*").toDF(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
