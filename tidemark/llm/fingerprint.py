"""Document fingerprints as invertible Bloom lookup tables over paragraph digests.

DataFrame functions only. A paragraph is a run of words of one line that ends
with the line or after a word whose last character is one of ENDS (marks that
close sentences, some digits and some of the less usual last letters), or else
after MOST words, and has at least LEAST words if the line does; so the cuts
move with the content and an added word changes few paragraphs. Its digest is 64 bits. A sketch is a table of cells (count, xor
of digests, xor of their checks); each digest is in one cell of each of four
subtables. The sketch of one version less that of another holds only the
paragraphs that differ, and peeling recovers their digests: a cell of one
digest gives it away, and taking it out of its other cells uncovers more.
Peeling goes subtable by subtable, so that no digest is taken out twice. Where
it fails, it is done again with a larger table and other places, over and over
until it succeeds.

The fingerprint string is a small sketch of fixed size, so equal texts have
equal fingerprints; likenesses are peeled from sketches with room for both
versions' paragraphs. Likeness is common over all distinct paragraphs; two
texts without words are alike (1). Null text is empty. A null id comes last in
descending order; equal ids stand in descending order of their text's hash. A
single document follows itself. Repeated rows each have a row; empty tables
give none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise, partitions

ENDS, LEAST, MOST = ".!?05gkpwGKPW", 5, 32
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09]++(?=[^\x20\x09-\x0D])"
PARAGRAPH = r"(?:%s++%s){0,%d}+(?:%s++(?<![%s])%s){0,%d}+%s++" % (_WORD, _GAP, LEAST - 1, _WORD, ENDS, _GAP, MOST - LEAST, _WORD)
#: Subtables of a sketch, and cells of each in the fingerprint string.
TABLES, SMALL = 4, 6
#: Passes over the subtables of a table; what is left then is sketched anew.
ROUNDS = 16
#: Documents of a block, and the most blocks: what one task sorts, and the bound of the list of blocks.
BLOCK, MOST_BLOCKS, SPLITS = 200, 1 << 16, 256


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(digest: Column, table: int, size: Column, seed: int) -> Column:
    """Cell number of a digest in a subtable of `size` cells; the number's remainder by TABLES is the subtable."""
    return F.pmod(F.xxhash64(digest, F.lit(seed * 101 + table)), size) * TABLES + table


def _check(digest: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 7001), digest)


def fingerprint(found: Column) -> Column:
    """The sketch of TABLES x SMALL cells as text: count and xor of the digests of each cell."""

    def cell(table: int, at: int) -> Column:
        own = F.filter(found, lambda d: F.pmod(F.shiftright(d, 13 * table), F.lit(SMALL)) == at)
        return F.concat_ws(":", F.hex(F.size(own)), F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))))

    return F.lower(F.concat_ws(",", *(cell(t, j) for t in range(TABLES) for j in range(SMALL))))


def decode(pairs: DataFrame, ids: list[str], seed: int = 1, room: float = 0.5) -> DataFrame:
    """ids, only_left, only_right, decoded: numbers of digests in one of the two versions only.

    pairs: ids (unique), left, right (arrays of digests). Each subtable has `room` cells a digest and 12 more.
    """
    size = F.ceil(F.lit(room) * (F.size("left") + F.size("right")) + 12)
    signed = F.concat(F.transform("left", lambda d: F.struct(d.alias("d"), F.lit(1).cast("long").alias("n"))), F.transform("right", lambda d: F.struct(d.alias("d"), F.lit(-1).cast("long").alias("n"))))
    rows = pairs.select(*ids, size.alias("size"), F.explode(signed).alias("x")).select(*ids, "size", "x.d", "x.n")
    cells = rows.select(*ids, "size", "n", "d", F.explode(F.array(*(_place(F.col("d"), t, F.col("size"), seed) for t in range(TABLES)))).alias("cell"))
    sums = [F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")]
    live = (F.col("n") != 0) | (F.col("k") != 0)
    cells = cells.select(*ids, "size", "cell", "n", F.col("d").alias("k"), _check(F.col("d"), seed).alias("h")).groupBy(*ids, "size", "cell").agg(*sums).where(live)
    none = F.lit(0).cast("long")

    def part(cell: Column, n: Column, k: Column, h: Column) -> Column:
        return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))

    for r in range(ROUNDS):
        t, k, n = r % TABLES, F.col("k"), F.col("n")
        pure = (F.pmod("cell", F.lit(TABLES)) == t) & (F.col("cell") >= 0) & (F.abs(n) == 1) & (F.col("h") == _check(k, seed))
        found = part(F.when(n > 0, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1), none, none)
        away = [part(_place(k, u, F.col("size"), seed), -n, k, F.col("h")) for u in range(TABLES) if u != t]
        kept = part(F.col("cell"), n, k, F.col("h"))
        moved = cells.select(*ids, "size", F.explode(F.when(pure, F.array(found, *away)).otherwise(F.array(kept))).alias("x")).select(*ids, "size", "x.*")
        cells = moved.groupBy(*ids, "size", "cell").agg(*sums).where(live)
    return cells.groupBy(*ids).agg(
        F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("only_left"),
        F.sum(F.when(F.col("cell") == -2, F.col("n")).otherwise(0)).alias("only_right"),
        (F.max("cell") < 0).alias("decoded"),
    )


def _likeness(n_left: Column, n_right: Column, only_left: Column, only_right: Column) -> Column:
    """Common over all digests, with both the left and the right side's numbers of what is common averaged."""
    common = F.greatest(((n_left - only_left) + (n_right - only_right)) / 2, F.lit(0.0))
    every = n_left + n_right - common
    return F.when(every > 0, F.least(F.lit(1.0), common / every)).otherwise(1.0)


def with_next(docs: DataFrame) -> DataFrame:
    """block, place, doc_id, text, next_text: each document with the next in descending id; (block, place) is unique.

    Ids are dealt into blocks of consecutive ids by approximate quantiles; an id that is several quantiles is dealt into as
    many blocks by its texts' hashes. A window orders each block, and the last of a block takes the head of the next block
    that has rows.
    """
    lowest = -(1 << 63)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_key"))
    total = docs.count()
    splits = max(1, min(SPLITS, total // BLOCK))
    cuts = docs.agg(F.percentile_approx("_key", [i / splits for i in range(1, splits)] or [0.5], 20000).alias("c")).first()["c"] if splits > 1 else []
    cuts = sorted(cuts or [])
    fine = max(1, min(MOST_BLOCKS // SPLITS, total // (splits * BLOCK * 10)))
    ends = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    key = F.col("_key")
    below, upto = F.size(F.filter(ends, lambda c: c < key)), F.size(F.filter(ends, lambda c: c <= key))
    # an equal division of the ids between two cuts, or of one hot id's hashes, keeps their order
    low = F.when(upto > 0, F.try_element_at(ends, F.greatest(upto, F.lit(1)))).otherwise(F.col("_key"))
    high = F.coalesce(F.try_element_at(ends, upto + 1), F.col("_key"))
    # in floating point, since a difference of ids may exceed a long
    share = F.col("_key").cast("double") - low.cast("double")
    width = F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0))
    inner = F.least(F.lit(fine - 1), F.floor(share / width * fine))
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    among = F.least(F.floor(rank / F.lit(float(1 << 62)) * (upto - below)), upto - below - 1)
    block = F.when(upto - below > 1, (below + 1 + among) * fine).otherwise(upto * fine + inner)
    docs = docs.withColumn("block", block.cast("long")).withColumn("_rank", rank)
    # tasks of a quarter of the usual size: the peeling's tables of cells then fit in memory
    docs = docs.repartition(4 * partitions(docs.sparkSession), "block")
    docs = docs.drop("_key")  # from here every use reads the same columns, so that one exchange serves all
    w = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("_rank"), F.desc("text"))
    rows = docs.select("block", "doc_id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("_lead"))
    blocks = docs.select("block").distinct()
    chain = Window.orderBy(F.desc("block"))  # at most MOST_BLOCKS rows
    following = blocks.select("block", F.lead("block").over(chain).alias("_next"), F.max("block").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"))
    following = following.select(F.col("block").alias("_of"), F.coalesce("_next", "_first").alias("_from"))
    heads = rows.where(F.col("place") == 1).select(F.col("block").alias("_from"), F.col("text").alias("_head"))
    heads = following.join(heads, "_from").select(F.col("_of").alias("block"), "_head")
    joined = rows.join(heads, "block", "left")
    return joined.select("block", "place", "doc_id", "text", F.coalesce("_lead", "_head").alias("next_text"))


def _sides(rows: DataFrame) -> DataFrame:
    """block, place, pair, left, right: the text's digests against the edited (0) and the next (1) text's."""
    both = F.array(F.struct(F.lit(0).alias("pair"), F.col("b").alias("right")), F.struct(F.lit(1).alias("pair"), F.col("c").alias("right")))
    return rows.select("block", "place", F.explode(both).alias("x"), F.col("a").alias("left")).select("block", "place", "x.pair", "left", "x.right")


def _by_pair(found: DataFrame) -> DataFrame:
    """only_left0 .. decoded1 of each (block, place); a pair that left no cell differs in nothing."""
    columns = [F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}{p}") for p in (0, 1) for c in ("only_left", "only_right", "decoded")]
    return found.groupBy("block", "place").agg(*columns)


def _filled(rows: DataFrame) -> DataFrame:
    return rows.fillna({f"{c}{p}": v for p in (0, 1) for c, v in (("only_left", 0), ("only_right", 0), ("decoded", True))})


def op1(documents: DataFrame, room: float = 0.5) -> DataFrame:
    """One row per document: fingerprints of the text and of its edited text, and likenesses to the edited and the next text."""
    spark = documents.sparkSession
    rows = with_next(documents.select("doc_id", "text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("block", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    out = rows.select("*", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"))
    out = _filled(out.join(_by_pair(decode(_sides(rows), ["block", "place", "pair"], room=room)), ["block", "place"], "left"))
    failed = ~(F.col("decoded0") & F.col("decoded1"))
    sizes = [F.size(x).alias(f"n{x}") for x in "abc"]
    out = out.select(*(c for c in out.columns if c not in "abc"), *sizes, *(F.when(failed, F.col(x)).alias(x) for x in "abc"))
    # Both sides of the join come from one exchange by block; with this setting it needs no other.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    out = materialise(out)
    done, rest, seed = out.where(~failed), out.where(failed), 1
    while not rest.isEmpty():
        seed, room = seed + 1, room * 4
        again = _by_pair(decode(_sides(rest), ["block", "place", "pair"], seed=seed, room=room))
        found = materialise(_filled(rest.drop(*again.columns[2:]).join(again, ["block", "place"], "left")).select(*out.columns))
        done, rest = done.unionByName(found.where(~failed)), found.where(failed)
    near = [_likeness(F.col("na"), F.col(x), F.col(f"only_left{p}"), F.col(f"only_right{p}")) for p, x in ((0, "nb"), (1, "nc"))]
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"), F.col("na").alias("n_paragraphs"))
