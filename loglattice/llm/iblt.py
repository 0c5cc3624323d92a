"""Document fingerprints by invertible Bloom lookup sketches (operator 5).

Native: DataFrame functions alone. The elements of a document are the digests
(XXH64) of its distinct paragraphs, the lines of its text. A sketch has three tables
of cells; a digest goes to one cell of each. A cell holds how many digests it got,
their exclusive or, and the exclusive or of their check hashes. Sketches subtract
cell by cell, so paragraphs that two versions share cancel; peeling then takes
digests out of cells that hold one alone until all cells are empty. If some are left,
both sketches are built larger, by ``GROWTH`` each time, until peeling succeeds.

A document of many paragraphs has sketches for parts of its digests (by their lowest
bits after mixing), so that work stays linear in its length.

The fingerprint is the smallest sketch of all paragraphs, written out: their number,
then the cells. Likeness comes from sketches of the same kind, made anew of the parts of
both texts' digests and as large as peeling them takes; the smallest one of all
paragraphs can be peeled for a few differences alone. After ``ATTEMPTS`` sizes, of which
the last has 2,048 cells a table for some 24 digests, a part's sets are compared as they
are; only digests that share all cells at every size come to that. Likeness is the Jaccard index of the paragraph sets, from the size of the recovered
difference: (a + b - d) / (a + b + d); two versions without paragraphs have 1.

Null texts count as empty, and an empty text has one paragraph, the empty one. Equal
texts have equal fingerprints. Documents with null ids come first; of several rows
with one id, the next document of each is the one after it by text. A table of one
document has itself as its next. Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

TABLES = 3
#: Cells of each table of the smallest sketch, and its growth after a failure.
CELLS, GROWTH, ROUNDS = 8, 4, 24
#: Digests of a part, on average, and the attempts after which a part's sets are compared as they are.
PART, ATTEMPTS = 24, 5


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(digest: Column, table: int, cells: int) -> Column:
    """The cell of ``table`` that the digest goes to."""
    return F.shiftrightunsigned(digest, 20 * table).bitwiseAND(F.lit(cells - 1)).cast("int")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: lambdas do not share common expressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(items: Column, cells: int) -> Column:
    """Array of cells (n, key, check), table after table."""

    def table(t: int) -> Column:
        def cell(i: Column) -> Column:
            own = F.filter(items, lambda d: _place(d, t, cells) == i)
            return _let(own, lambda x: F.struct(F.size(x).alias("n"), _xor(x).alias("key"), _xor(F.transform(x, _check)).alias("check")))

        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell)

    return F.concat(*map(table, range(TABLES)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(difference: Column, cells: int) -> Column:
    """How many digests the sketches differ in; null if some could not be recovered."""
    state = F.struct(difference.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("over"))

    def step(s: Column, _: Column) -> Column:
        alone = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        taken = F.array_distinct(F.transform(alone, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
        pure = F.transform(taken, lambda p: F.struct(p["n"].alias("n"), p["key"].alias("key"), _check(p["key"]).alias("check"), *[(_place(p["key"], t, cells) + t * cells).alias(f"at{t}") for t in range(TABLES)]))

        def without(pure: Column) -> Column:
            def left(c: Column, j: Column) -> Column:
                own = F.filter(pure, lambda p: (p["at0"] == j) | (p["at1"] == j) | (p["at2"] == j))
                rest = lambda x: F.struct(F.aggregate(x, c["n"], lambda a, p: a - p["n"]).alias("n"), F.aggregate(x, c["key"], lambda a, p: a.bitwiseXOR(p["key"])).alias("key"), F.aggregate(x, c["check"], lambda a, p: a.bitwiseXOR(p["check"])).alias("check"))
                return _let(own, lambda x: F.when(F.size(x) == 0, c).otherwise(rest(x)))

            cut = F.struct(F.transform(s["cells"], left).alias("cells"), (s["found"] + F.size(pure)).alias("found"), F.lit(False).alias("over"))
            return F.when(F.size(pure) == 0, stop).otherwise(cut)

        stop = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(True).alias("over"))
        return F.when(s["over"], stop).otherwise(_let(pure, without))

    clear = lambda s: ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, lambda s: F.when(clear(s), s["found"]))


def serialised(items: Column) -> Column:
    """The fingerprint: the number of paragraphs and the smallest sketch, in hexadecimal."""
    cell = lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"]))
    return F.lower(F.concat_ws("-", F.size(items).cast("string"), F.concat_ws("_", F.transform(sketch(items, CELLS), cell))))


def differences(pairs: DataFrame) -> DataFrame:
    """pair, d: the paragraphs that differ between arrays ``a`` and ``b`` of each row; ``pair`` is a key."""
    parts = F.greatest(F.size("a"), F.size("b")) / PART
    parts = F.when(parts <= 2, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(parts))).cast("int"))
    sized = pairs.withColumn("parts", parts)
    cut = sized.filter("parts > 1").select("pair", "parts", F.explode(F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(0).alias("side"))), F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(1).alias("side"))))).alias("x"))
    cut = cut.select("pair", F.pmod(F.xxhash64("x.d", F.lit(11)), F.col("parts")).alias("part"), "x.d", "x.side").groupBy("pair", "part")
    cut = cut.agg(F.collect_list(F.when(F.col("side") == 0, F.col("d"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("d"))).alias("b"))
    rest = sized.filter("parts = 1").select("pair", F.lit(0).cast("long").alias("part"), "a", "b").unionByName(cut)
    cells, done = CELLS, None
    for attempt in range(ATTEMPTS + 1):
        if attempt < ATTEMPTS:
            d = peel(subtract(sketch(F.col("a"), cells), sketch(F.col("b"), cells)), cells)
        else:
            d = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
        tried = written(rest.withColumn("d", d), f"iblt-{attempt}")
        found = tried.filter("d is not null").select("pair", "d")
        done = found if done is None else done.unionByName(found)
        rest = tried.filter("d is null").select("pair", "part", "a", "b").repartition(shuffle_partitions(pairs.sparkSession), "pair", "part")
        if not rest.limit(1).count():
            break
        cells *= GROWTH
    return done.groupBy("pair").agg(F.sum("d").alias("d"))


def _buckets(docs: DataFrame) -> tuple[Column, list[tuple[int, int]]]:
    """The bucket of a doc_id, and (bucket, the bucket of the rows that precede its first one).

    Buckets are ranges of doc_id between quantiles; there are a few for each shuffle partition.
    """
    count = 4 * shuffle_partitions(docs.sparkSession)
    probabilities = [i / count for i in range(1, count)]
    bounds = sorted(set(docs.approxQuantile("doc_id", probabilities, 1 / (4 * count)))) if count > 1 else []
    if not bounds:
        return F.lit(0), bounds
    limits, count = F.lit([int(x) for x in bounds]).cast("array<long>"), len(bounds)

    def further(place: Column, step: Column) -> Column:
        here = place + step
        return F.when((here <= count) & (F.element_at(limits, F.least(here, F.lit(count))) <= F.col("doc_id")), here).otherwise(place)

    # By halving: the number of bounds at or below the id
    steps = F.lit([1 << i for i in reversed(range(count.bit_length()))]).cast("array<int>")
    place = F.aggregate(steps, F.lit(0), further)
    return F.coalesce(place, F.lit(0)), bounds


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next: each document with the text after it in ascending doc_id order, the last with the first.

    Documents are dealt by ranges of doc_id. The first document of each range goes to the
    range before it as well, so that every pair of neighbours meets in one range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket, bounds = _buckets(docs.select("doc_id").filter("doc_id is not null"))
    ids = rows.select("doc_id", bucket.alias("bucket"))
    firsts = sorted((r["bucket"], r["least"]) for r in ids.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least")).collect())
    if not firsts:
        return rows.withColumn("next", F.col("text"))
    before = [(b, firsts[i - 1][0], least["doc_id"]) for i, (b, least) in enumerate(firsts)]
    to = spark.createDataFrame(before, "bucket int, goes int, first long")
    dealt = rows.withColumn("bucket", bucket).join(F.broadcast(to), "bucket")
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    copies = F.when(is_first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("goes").alias("bucket"), F.lit(True).alias("guest"))))
    copies = copies.otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))
    both = dealt.select("doc_id", "text", F.inline(copies))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return both.select("doc_id", "text", "guest", F.lead("text").over(order).alias("next")).filter("not guest").select("doc_id", "text", F.coalesce("next", "text").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs)
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    held = written(
        rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next")).alias("after")).withColumn("row", F.monotonically_increasing_id()),
        "paragraphs",
    )
    asked = held.select("row", F.col("own").alias("a"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("changed").alias("b")), F.struct(F.lit(1).alias("which"), F.col("after").alias("b")))).alias("x"))
    found = differences(asked.select(F.struct("row", "x.which").alias("pair"), "a", F.col("x.b").alias("b")))
    near = written(found.groupBy(F.col("pair.row").alias("row")).agg(F.max(F.when(F.col("pair.which") == 0, F.col("d"))).alias("d_edited"), F.max(F.when(F.col("pair.which") == 1, F.col("d"))).alias("d_next")), "differences")

    def likeness(d: str, other: str) -> Column:
        total = F.size("own") + F.size(other)
        return F.when(total + F.col(d) > 0, (total - F.col(d)) / (total + F.col(d))).otherwise(F.lit(1.0))

    return held.join(near, "row").select(
        "doc_id", "n_chars", "edited_sha256", serialised(F.col("own")).alias("fingerprint"), serialised(F.col("changed")).alias("edited_fingerprint"), likeness("d_edited", "changed").alias("near_edited"), likeness("d_next", "after").alias("near_next")
    )
