"""Operator 4, benchmark decontamination: DataFrame and SQL functions only.

Texts and benchmark items become words (letters and digits, lower case) and five-word shingles as
64-bit hashes. A window is as long as the item it is held against. A window can reach the threshold
only if enough of its places hold shingles of an item, so windows are cut only there, one for each
such place: moving a window's start to the first of them never lowers the similarity. Each window
gets a SimHash; RADIUS + 1 blocks of its bits are looked up in an index of the items' blocks, which
finds every item whose fingerprint differs in at most RADIUS bits; the exact similarity of weighted
shingles (weight: how often one occurs) decides.

The benchmark is read in slices of at most SLICE_SHINGLES shingles, each of which fits into a small
broadcast; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import table

K = 5
THRESHOLD = (3, 4)  # 0.75
RADIUS = 24
SLICE_SHINGLES = 500_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _grams(words: Column, k: int) -> Column:
    window = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), window)).otherwise(F.array().cast("array<bigint>"))


def _adds(bit: int):
    """Adds a hash's bits bit and 32 + bit to the two halves of a sum."""
    return lambda total, h: total + F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(0x0000000100000001))


def fingerprint(grams: Column) -> Column:
    """64-bit SimHash: bit b is set if more than half of the hashes have it. Two bits are counted in one long."""
    n = F.size(grams)
    bits = []
    for b in range(32):
        both = F.aggregate(grams, F.lit(0).cast("long"), _adds(b))
        bits.append(F.when(both.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > n, F.lit(1 << b)).otherwise(F.lit(0).cast("long")))
        high = (1 << (32 + b)) - ((1 << 64) if b == 31 else 0)
        bits.append(F.when(F.shiftrightunsigned(both, 32) * 2 > n, F.lit(high).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, x: a.bitwiseOR(x), bits)


def _cuts() -> list[tuple[int, int]]:
    """(first bit, bits) of the RADIUS + 1 blocks."""
    edges = [round(64 * j / (RADIUS + 1)) for j in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _blocks(fp: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in _cuts()])


def _first_equal(difference: Column) -> Column:
    """The first block in which two fingerprints agree, so that each pair is found once."""
    out = F.lit(RADIUS + 1)
    for j, (a, n) in reversed(list(enumerate(_cuts()))):
        out = F.when(F.shiftrightunsigned(difference, a).bitwiseAND(F.lit((1 << n) - 1)) == 0, F.lit(j)).otherwise(out)
    return out


def _common(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of the two counts."""
    plain = F.size(F.array_intersect(a, b))
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    weighted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    return F.when((F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b)), plain).otherwise(weighted)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each worked out once, however often it is used later."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def windows(docs: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(doc_id, m, s, wg): windows of docs (doc_id, text) as arrays of shingles, for items of m shingles.

    sizes has (h, m): which sizes of items hold a shingle. A window of w <= m shingles needs
    3/7 of (m + w) in common with an item, so it is cut only if it holds as many places with a shingle
    of any item of that size, and begins at such a place or ends with the text. Of equal windows the
    first stays. Places are sorted once, and one look ahead tells whether a window holds enough, so the
    work grows with the text.
    """
    text = F.xxhash64("text")  # with doc_id it names a row, so that rows without doc_id do not meet on one key
    split = docs.select("doc_id", text.alias("t"), F.explode(F.array(_words(F.col("text")))).alias("words"))
    places = split.select("doc_id", "t", F.posexplode(_grams(F.col("words"), k)).alias("i", "h")).join(F.broadcast(sizes), "h")
    places = places.groupBy("doc_id", "t", "m").agg(F.collect_set("i").alias("p"))
    places = places.where(7 * F.size("p") >= 3 * (F.col("m") + F.least(F.size("p"), F.col("m"))))
    near = places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("m", F.array_sort("p").alias("p"))).alias("near")).withColumnRenamed("doc_id", "id")
    held = docs.join(near, F.col("doc_id").eqNullSafe(F.col("id")) & (text == F.col("t"))).select("doc_id", "near", F.explode(F.array(_words(F.col("text")))).alias("words"))
    held = held.select("doc_id", "near", F.explode(F.array(_grams(F.col("words"), k))).alias("grams"))
    held = held.select("doc_id", "grams", F.inline("near")).withColumn("w", F.least("m", F.size("grams")))
    held = held.withColumns({"need": F.expr("(3 * (m + w) + 6) div 7").cast("int"), "tail": F.size("grams") - F.col("w")})
    starts = "concat(filter(p, (s, j) -> s < tail AND get(p, j + need - 1) < s + w), if(get(p, size(p) - need) >= tail, array(tail), array()))"
    held = _once(held, cut=F.expr(f"array_sort(transform({starts}, s -> struct(xxhash64(slice(grams, s + 1, w)) AS h, s AS s)))"))
    first = "filter(cut, (x, j) -> j = 0 OR get(cut, j - 1).h <> x.h)"
    return held.select("doc_id", "m", F.expr(f"inline(transform({first}, x -> struct(x.s AS s, slice(grams, x.s + 1, w) AS wg)))"))


def _slice(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    sizes = items.select("m", F.explode(F.array_distinct("g")).alias("h")).distinct()
    marked = _once(windows(docs, sizes, k), wf=fingerprint(F.col("wg")))
    index = _once(items, f=fingerprint(F.col("g"))).select("item_id", "n_item", "m", "f", F.posexplode(_blocks(F.col("f"))).alias("block", "bits"))
    looked_up = marked.select("*", F.posexplode(_blocks(F.col("wf"))).alias("block", "bits")).join(F.broadcast(index), ["m", "block", "bits"])
    compared = _once(looked_up, differs=F.col("wf").bitwiseXOR(F.col("f")))
    near = compared.where((F.bit_count("differs") <= RADIUS) & (F.col("block") == _first_equal(F.col("differs"))))
    near = near.select("doc_id", "n_item", "s", "wg").join(F.broadcast(items.select("n_item", "item_id", "g")), "n_item")
    common = _once(near, common=_common(F.col("wg"), F.col("g"))).withColumn("all", F.size("wg") + F.size("g") - F.col("common"))
    found = common.where(THRESHOLD[1] * F.col("common") >= THRESHOLD[0] * F.col("all"))
    return found.select("doc_id", "item_id", F.col("s").cast("long").alias("first_word"), (F.col("common") / F.col("all")).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each document with each item that a window of it repeats.

    similarity is that of the best window and first_word the place (from 0) of the first such window.
    The threshold is 0.75 on five-word shingles; an item of fewer words is one shingle of all its
    words, and a text shorter than an item is one window. Null and empty texts and items, and items
    without a letter or digit, match nothing. Rows with a null doc_id are one document without id;
    repeated rows give one result. Further columns are not read; empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", F.explode(F.array(_words(F.col("text")))).alias("words")).where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(K)))
    sizes = items.groupBy("k").agg(F.sum(F.size("words")).alias("shingles")).orderBy("k").collect()  # at most K rows
    parts = []
    for k, shingles in sizes:
        own = items.where(F.col("k") == k).select("item_id", _grams(F.col("words"), k).alias("g")).withColumns({"m": F.size("g"), "n_item": F.xxhash64("item_id", "g")}).dropDuplicates(["item_id", "n_item"])
        slices = -(-shingles // SLICE_SHINGLES)
        parts += [_slice(docs, own if slices == 1 else own.where(F.pmod(F.xxhash64("item_id", "g"), F.lit(slices)) == j), k) for j in range(slices)]
    if not parts:
        return docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("first_word")).where("false")
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("similarity", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best")["col2"]).alias("first_word"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity, first_word of every document that holds a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
