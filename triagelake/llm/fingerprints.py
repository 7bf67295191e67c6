"""Fingerprints of documents as invertible Bloom lookup tables of their paragraphs.

A paragraph is a line, or a run of up to 12 words of a longer one; its digest is 64 bits. A table has three parts of 2^bits cells;
a digest is added to one cell of each part, which keeps a count, the XOR of digests and the XOR of a check hash. Its cell in a smaller
table is the cell's number modulo the smaller size, so tables fold, and the tables of two versions are subtracted at the size of the smaller.
Subtracting cancels what they share. Peeling then recovers the rest: a cell that holds one
digest (count 1 or -1, and the check fits) gives it away, and taking it out of its other cells opens those. Rounds of peeling go
through the parts in turn, as a digest is in one cell only of each. A table that cannot be peeled is built anew four times as large.

How large a table the difference of two versions needs is estimated first, from strata: the digests are split into strata that hold three quarters,
three sixteenths, ... of them, and each stratum keeps 64 bits, of which a digest turns one over. The bits in which two versions' strata differ say how many
digests do. A fingerprint string holds all of it: number of digests, bits, strata and the cells of a table about as large as the text has paragraphs.

Everything is DataFrame functions over (key, cell) rows. A document's digests are written once, in a table bucketed by its key, so neither
tables nor peeling shuffle anything. The neighbour in id order comes from a range-partitioned table of ids, joined over partition borders.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import materialise, scratch_path

#: Words of a line that make a paragraph, at most.
PIECE = r"(?:\S++[^\S\n]*+){1,12}+"
KEY = ["k1", "k2"]
#: Cells in each part of a table at least, as a power of two.
FOLD = 4
#: Strata; one of more differing bits than FULL is too full to count by.
STRATA, FULL = 6, 24
#: Rounds of peeling before a table counts as failed; sizes tried at most (the last is 4^11 times the first).
ROUNDS, LEVELS = 14, 12
CELL, FOUND = 0, 1


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), 0), lambda p: F.xxhash64(F.rtrim(p))))


def _cell(digest: Column, part: Column, mask: Column, seed: int) -> Column:
    """The number of the cell of `part` that holds a digest."""
    return F.shiftleft(part.cast("long"), 40) + F.xxhash64(digest, part, F.lit(seed)).bitwiseAND(mask)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _mask(bits: Column) -> Column:
    return F.pow(F.lit(2.0), bits).cast("long") - 1


def strata(digests: Column) -> Column:
    """STRATA words of 64 bits: a digest turns a bit over in one, by a hash of its own; each holds a quarter of what is left by those before."""
    def stratum(h: Column) -> Column:
        lowest = h.bitwiseAND(-h)
        return F.least(F.floor(F.bit_count(lowest - 1) / 2), F.lit(STRATA - 1))

    hashed = F.transform(digests, lambda d: F.xxhash64(d, F.lit("stratum")))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    none = F.array_repeat(F.lit(0).cast("long"), STRATA)
    return F.aggregate(hashed, none, lambda words, h: F.transform(words, lambda w, i: F.when(i == stratum(h), w.bitwiseXOR(bit(h))).otherwise(w)))


def estimated_difference(a: Column, b: Column) -> Column:
    """About how many digests two versions differ in, from their strata: by the first stratum that isn't too full, and all after it."""
    turned = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(STRATA)]
    # d digests turn 32 * (1 - (1 - 1 / 32)^d) of 64 bits over, on average.
    count = [F.ln(F.lit(1.0) - F.least(t, F.lit(31)) / F.lit(32.0)) / F.lit(math.log(1 - 1 / 32)) for t in turned]
    found = F.lit(float(4 ** (STRATA - 1))) * count[-1]
    for i in reversed(range(STRATA - 1)):
        found = F.when(turned[i] <= FULL, F.lit(float(4**i)) * reduce(Column.__add__, count[i:])).otherwise(found)
    return found


def _bits(cells_wanted: Column) -> Column:
    """The size of a table with so many cells at least."""
    return F.greatest(F.ceil(F.log2(F.greatest(cells_wanted, F.lit(1.0)) / F.lit(3.0))), F.lit(FOLD)).cast("int")


def cells(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Tables of rows (keys, mask, digest, sign): (keys, mask, kind, at, count, x, check) for cells that aren't empty."""
    rows = rows.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("at", _cell(F.col("digest"), F.col("part"), F.col("mask"), seed))
    grouped = rows.groupBy(*keys, "mask", "at").agg(F.sum("sign").alias("count"), F.bit_xor("digest").alias("x"), F.bit_xor(_check(F.col("digest"))).alias("check"))
    return grouped.filter("count <> 0 OR x <> 0 OR check <> 0").withColumn("kind", F.lit(CELL))


def peel(table: DataFrame, keys: list[str], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Peels tables: rows of kind FOUND have a recovered digest in x and its sign in count; cells that are left didn't peel."""
    columns = ["kind", "at", "count", "x", "check"]
    for turn in range(rounds):
        part = turn % 3
        pure = (F.col("kind") == CELL) & (F.shiftright("at", 40) == part) & F.col("count").isin(1, -1) & (F.col("check") == _check(F.col("x")))
        row = lambda kind, at, count, x, check: F.struct(F.lit(kind).alias("kind") if isinstance(kind, int) else kind, at.alias("at"), count.alias("count"), x.alias("x"), check.alias("check"))
        found = [row(FOUND, F.col("x"), F.col("count"), F.col("x"), F.lit(0).cast("long"))]
        found += [row(CELL, _cell(F.col("x"), F.lit(p), F.col("mask"), seed), -F.col("count"), F.col("x"), F.col("check")) for p in range(3) if p != part]
        same = F.array(row(F.col("kind"), F.col("at"), F.col("count"), F.col("x"), F.col("check")))
        table = table.select(*keys, "mask", F.explode(F.when(pure, F.array(*found)).otherwise(same)).alias("r")).select(*keys, "mask", *(F.col(f"r.{c}").alias(c) for c in columns))
        table = table.groupBy(*keys, "mask", "kind", "at").agg(F.sum("count").alias("count"), F.bit_xor("x").alias("x"), F.bit_xor("check").alias("check"))
        table = table.filter(f"kind = {FOUND} OR count <> 0 OR x <> 0 OR check <> 0")
    return table


def differences(pairs: DataFrame, level: int, with_digests: bool) -> DataFrame:
    """One row a pair (KEY, pair): left, the cells that didn't peel, differ, how many digests were recovered, and if asked for only, those with their signs.

    `pairs` has arrays of digests a and b, and estimate, how many they may differ in. Tables have twice as many cells at least, four times as
    many for each level. At level 0 they are the fingerprints' own tables, folded and subtracted, unless those are smaller. Pairs without a difference have no row.
    """
    bits = _bits(F.col("estimate") * 2.0) + 2 * level
    signed = F.concat(F.transform("a", lambda d: F.struct(d.alias("digest"), F.lit(1).cast("long").alias("sign"))), F.transform("b", lambda d: F.struct(d.alias("digest"), F.lit(-1).cast("long").alias("sign"))))
    keys = [*KEY, "pair"]
    rows = pairs.select(*keys, _mask(bits).alias("mask"), F.explode(signed).alias("d")).select(*keys, "mask", "d.digest", "d.sign")
    peeled = peel(cells(rows, keys, level), keys, level)
    found = F.when(F.col("kind") == FOUND, F.struct(F.col("x").alias("digest"), F.col("count").alias("sign")))
    wanted = [F.count(F.when(F.col("kind") == CELL, 1)).alias("left"), F.count(found).alias("differ"), *([F.collect_list(found).alias("only")] if with_digests else [])]
    return peeled.groupBy(*keys).agg(*wanted)


def fingerprint_strings(rows: DataFrame, names: list[str]) -> DataFrame:
    """For arrays of digests in columns `names`, with strata in `<name>_strata` (KEY, ...): one row a key with each one's fingerprint in `<name>_print`.

    A fingerprint is number of digests, bits of the table, strata, and the cells that aren't empty in order (at.count.x.check), in hex but for counts; the
    table has a cell for each digest at least.
    """
    size = lambda n: F.size(n)
    bits = lambda n: _bits(size(n).cast("double"))
    tagged = lambda i, n: F.transform(n, lambda d: F.struct(F.lit(i).alias("which"), _mask(bits(n)).alias("mask"), d.alias("digest")))
    flat = rows.select(*KEY, F.explode(F.concat(*(tagged(i, n) for i, n in enumerate(names)))).alias("d")).select(*KEY, "d.which", "d.mask", "d.digest", F.lit(1).cast("long").alias("sign"))
    table = cells(flat, [*KEY, "which"], 0)
    cell = F.struct("at", F.concat_ws(".", F.hex("at"), F.col("count").cast("string"), F.hex("x"), F.hex("check")).alias("text"))
    lists = table.groupBy(*KEY).agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == i, cell))), lambda c: c["text"]), ";").alias(f"{n}_cells") for i, n in enumerate(names)))
    heads = rows.select(*KEY, *(F.concat_ws(" ", size(n).cast("string"), bits(n).cast("string"), F.array_join(F.transform(f"{n}_strata", F.hex), ",")).alias(f"{n}_head") for n in names))
    out = heads.join(lists, KEY, "left")
    return out.select(*KEY, *(F.concat_ws(" ", f"{n}_head", F.coalesce(f"{n}_cells", F.lit(""))).alias(f"{n}_print") for n in names))


def subtract(tables: DataFrame, keys: list[str], a: str, b: str, rounds: int = ROUNDS) -> DataFrame:
    """Subtracts and peels stored fingerprints a and b (columns of strings): (keys, left, only, likeness), from the strings alone.

    left is the number of cells that didn't peel (0: only is whole), only has (digest, sign), sign 1 for digests of a; likeness is null where left
    isn't 0. Keys are unique; rows without a difference have left 0 and no digests.
    """
    part = lambda name, i: F.element_at(F.split(name, " "), i)
    number = lambda text: F.conv(text, 16, -10).cast("long")
    shared = _mask(F.least(part(a, 2).cast("int"), part(b, 2).cast("int")))

    def side(name: str, sign: int) -> Column:
        cell = lambda c: F.struct(number(c[0]).alias("at"), (c[1].cast("long") * sign).alias("count"), number(c[2]).alias("x"), number(c[3]).alias("check"))
        return F.transform(F.filter(F.split(part(name, 4), ";"), lambda t: t != ""), lambda t: cell(F.split(t, r"\.")))

    rows = tables.select(*keys, shared.alias("mask"), F.explode(F.concat(side(a, 1), side(b, -1))).alias("c")).select(*keys, "mask", "c.*")
    folded = F.shiftleft(F.shiftright("at", 40), 40) + F.col("at").bitwiseAND(F.col("mask"))
    rows = rows.groupBy(*keys, "mask", folded.alias("at")).agg(F.sum("count").alias("count"), F.bit_xor("x").alias("x"), F.bit_xor("check").alias("check"))
    peeled = peel(rows.filter("count <> 0 OR x <> 0 OR check <> 0").withColumn("kind", F.lit(CELL)), keys, 0, rounds)
    found = F.when(F.col("kind") == FOUND, F.struct(F.col("x").alias("digest"), F.col("count").alias("sign")))
    peeled = peeled.groupBy(*keys).agg(F.count(F.when(F.col("kind") == CELL, 1)).alias("left"), F.collect_list(found).alias("only"))
    none = F.array().cast("array<struct<digest:bigint,sign:bigint>>")
    out = tables.join(peeled, keys, "left").withColumns({"left": F.coalesce("left", F.lit(0).cast("long")), "only": F.coalesce("only", none)})
    both = part(a, 1).cast("long") + part(b, 1).cast("long")
    return out.select(*keys, "left", "only", F.when(both == 0, F.lit(1.0)).when(F.col("left") == 0, F.lit(1.0) - F.size("only") / both).alias("likeness"))


def next_in_order(ids: DataFrame) -> DataFrame:
    """For distinct (k1, k2, id, n): to_k1, to_k2, the row before it in order of id (before the first: the last), and want, a quarter of that row's n.

    Ids are sorted in ranges; the last row of a range is joined to the first of the next by a table with one row a range.
    """
    spark = ids.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(ids.repartitionByRange(ranges, "id", "k1", "k2").withColumn("range", F.spark_partition_id()), "id-ranges")
    order = F.struct("id", "k1", "k2", "n")
    ends = ranged.groupBy("range").agg(F.max(F.struct(F.col("id").isNotNull(), order)).getField("col2").alias("last"))
    line = Window.orderBy("range")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("__before"))
    before = F.lag(order).over(Window.partitionBy("range").orderBy("id", "k1", "k2"))
    out = ranged.withColumn("before", before).join(F.broadcast(ends), "range").withColumn("before", F.coalesce("before", "__before"))
    return out.select("k1", "k2", F.col("before.k1").alias("to_k1"), F.col("before.k2").alias("to_k2"), F.floor(F.col("before.n") / 4).cast("int").alias("want"))


def write_bucketed(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder in buckets of KEY, as many as there are shuffle partitions, and reads them as a table."""
    spark = rows.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY).option("path", path).saveAsTable(table)
    return spark.table(table)


def recover(pairs: DataFrame, with_digests: bool) -> DataFrame:
    """What differs in each pair (KEY, pair, a, b), retrying larger until every table has peeled: (KEY, pair, differ and, if asked for, only)."""
    done = []
    for level in range(LEVELS):
        found = materialise(differences(pairs, level, with_digests), "differences")
        done.append(found.filter("left = 0").drop("left"))
        failed = found.filter("left > 0").select(*KEY, F.col("pair").alias("__pair"))
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # One row a key on this side, so that the buckets of the other are what the join needs.
        failed = failed.groupBy(*KEY).agg(F.collect_set("__pair").alias("__open"))
        pairs = pairs.join(failed, KEY).filter(F.array_contains("__open", F.col("pair"))).drop("__open")
    raise RuntimeError("a table of paragraph digests did not peel at any size")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_digests: bool = True) -> DataFrame:
    """Fingerprints of every document and its edited text, and what differs between it, the edited text and the next document.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next document in order of id;
    the last one's next is the first. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id and
    (with_digests) only_edited, only_next: arrays of (digest, sign), sign 1 for digests that only the document has. Fingerprints are those of
    fingerprint_strings; near_edited and near_next come from subtracting tables of the same digests at the size that the difference needs, and
    `subtract` finds the same from two strings where their tables are large enough. Likeness is twice the
    shared digests by all digests of both, 1 where neither has any. A null text is empty. Rows that repeat an id are ordered by hashes;
    rows that repeat id and text are one document and answered once each. Null ids come first. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64(F.lit(1), "id", "text"), "k2": F.xxhash64(F.lit(2), "text", "id")})
    ids = rows.select(*KEY, "id", F.length("text").alias("n")).groupBy(*KEY, "id").agg(F.max("n").alias("n"))
    order = next_in_order(ids)
    whole = rows.groupBy(*KEY).agg(F.max("id").alias("id"), F.max("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # Both uses of `whole` read all of its columns, so that its text is shuffled once.
    heads = whole.join(order, KEY).filter("copies > 0")
    heads = heads.select(F.col("to_k1").alias("k1"), F.col("to_k2").alias("k2"), F.col("id").alias("next_id"), F.expr("left(text, want)").alias("head"), paragraph_digests(F.col("text")).alias("next"))
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.col("head"))
    base = whole.join(heads, KEY).select(*KEY, "id", "copies", "next_id", F.length("text").cast("long").alias("n_chars"), F.col("text"), edited.alias("__edited"), "next")
    base = base.select(*KEY, "id", "copies", "next_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("__edited")).alias("edited"), "next")
    base = write_bucketed(base.select("*", *(strata(F.col(n)).alias(f"{n}_strata") for n in ("own", "edited", "next"))), "digests")

    def pair(i: int, b: str) -> Column:
        return F.struct(F.lit(i).alias("pair"), F.col("own").alias("a"), F.col(b).alias("b"), estimated_difference(F.col("own_strata"), F.col(f"{b}_strata")).alias("estimate"))

    pairs = base.select(*KEY, F.explode(F.array(pair(0, "edited"), pair(1, "next"))).alias("p")).select(*KEY, "p.*")
    found = recover(pairs, with_digests)
    of = lambda p, c: F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}_{p}")
    found = found.groupBy(*KEY).agg(*(of(p, c) for p in (0, 1) for c in (["differ", "only"] if with_digests else ["differ"])))
    out = base.join(fingerprint_strings(base, ["own", "edited"]), KEY).join(found, KEY, "left")

    def like(differ: str, other: str) -> Column:
        both = F.size("own") + F.size(other)
        return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.coalesce(F.col(differ), F.lit(0)) / both)

    none = F.array().cast("array<struct<digest:bigint,sign:bigint>>")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    digests = [F.coalesce("only_0", none).alias("only_edited"), F.coalesce("only_1", none).alias("only_next")] if with_digests else []
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("own_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        like("differ_0", "edited").alias("near_edited"), like("differ_1", "next").alias("near_next"), "next_id", *digests,
    )
