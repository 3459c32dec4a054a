"""Document fingerprints from closed syncmers (operator 4); DataFrame
functions only.

A text is read as units: words of up to 24 letters or digits, single
characters of scripts written without spaces, and single marks.  A window of
six units is an anchor if, among the hashes of its five inner pairs, the
smallest stands at either edge (a closed syncmer).  Whether a window is an
anchor depends on the window alone, so an edit touches only the anchors it
overlaps.  An anchor has the place of its first occurrence; the likeness of two
texts is the share of their distinct anchors in common, 2 * common / (a + b),
and like the positional match it is taken over all of them.  All of them are printed
too (anchors, edited_anchors); fingerprint is a short form beside them, the 64
anchors with the smallest hashes.

The anchors of a text are made once, where the documents stand sorted: the
document before reads them from its row, and the edited text makes only those
whose windows reach beyond the units it shares with the text.

Defined cases: a null text is empty; an empty text has an empty fingerprint;
a text of fewer than six units has itself as its only anchor; two empty
fingerprints are alike (1), an empty and another are not (0); rows without an
id come first in the order, ties in the order are broken by the text; a
single document is its own next one; extra columns are not carried; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm._common import buckets_for

WINDOW, INNER = 6, 2
KEPT = 64
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
UNITS = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]{{1,24}}|\S"
#: 40 bits of an anchor's hash are kept.
_MASK = (1 << 40) - 1


_NONE = "cast(array() AS array<struct<h: bigint, p: int>>)"


def hashes(text: str) -> Column:
    """Hashes of the units of the column ``text``, in their order."""
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(UNITS), F.lit(0)), lambda x: F.xxhash64(x))


def with_windows(df: DataFrame, units: str, out: str, first: str = "0") -> DataFrame:
    """Adds ``out``: array<struct<h: long, p: int>> of the anchors among the
    windows of the units hashed in the column ``units``, in their order; the
    first unit has the place ``first``."""
    edge = WINDOW - INNER  # index of the last inner pair
    pairs = [f"get(__s, i + {j})" for j in range(edge + 1)]
    of = [f"get({units}, i + {j})" for j in range(WINDOW)]
    df = df.withColumn("__s", F.expr(f"transform({units}, (x, i) -> xxhash64(x, get({units}, i + 1)))"))
    return df.withColumn(out, F.expr(f"""
        CASE WHEN size({units}) < {WINDOW} THEN {_NONE} ELSE transform(
          filter(sequence(0, size({units}) - {WINDOW}),
                 i -> least({pairs[0]}, {pairs[-1]}) <= least({", ".join(pairs[1:-1])})),
          i -> struct(xxhash64({", ".join(of)}) & {_MASK}L AS h, i + {first} AS p)) END""")).drop("__s")


def with_distinct(df: DataFrame, text: str, size: str, found: str, out: str) -> DataFrame:
    """Adds ``out``: the distinct anchors, ascending by hash, of the column
    ``text`` of ``size`` units, whose windows gave ``found``."""
    df = df.withColumn("__a", F.expr(f"""
        CASE WHEN {size} = 0 THEN {_NONE}
        WHEN {size} < {WINDOW} THEN array(struct(xxhash64({text}) & {_MASK}L AS h, 0 AS p))
        ELSE sort_array({found}) END"""))
    return df.withColumn(out, F.expr("filter(__a, (x, i) -> i = 0 OR x.h <> get(__a, i - 1).h)")).drop("__a")


def with_anchors(df: DataFrame, text: str, out: str, kept: int | None = KEPT) -> DataFrame:
    """Adds ``out``: array<struct<h: long, p: int>> of the distinct anchors of
    the column ``text``, ascending by hash; the first ``kept`` or all."""
    df = with_windows(df.withColumn("__h", hashes(text)), "__h", "__w")
    df = with_distinct(df, text, "size(__h)", "__w", out).drop("__h", "__w")
    return df if kept is None else df.withColumn(out, F.slice(out, 1, kept))


def as_text(anchors: str) -> Column:
    """``hash.place`` of all anchors, joined by commas."""
    return F.expr(f"concat_ws(',', transform({anchors}, x -> concat(lower(lpad(hex(x.h), 10, '0')), '.', x.p)))")


def short_form(printed: str) -> Column:
    """The KEPT first of printed anchors."""
    return F.substring_index(printed, ",", KEPT)


def likeness(a: str, b: str) -> Column:
    """Likeness of two texts by the columns of the hashes of all their anchors."""
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D "
                  f"ELSE 2 * size(array_intersect({a}, {b})) / cast(size({a}) + size({b}) AS double) END")


def with_next(docs: DataFrame, carried: list[str], prepare, per_bucket: int = 512,
              most_buckets: int = 50_000) -> DataFrame:
    """Adds ``next``: struct of ``carried`` of the document after each one
    (doc_id ascending, then ``text``; the first after the last).  ``prepare``
    adds columns to the rows where they are dealt and sorted: its columns are
    neither shuffled nor sorted.

    Documents stand in buckets of neighbouring ids, one window each; the first
    document of a bucket also visits the bucket before it.  Which that is
    comes from the ids alone; there are at most ``most_buckets`` of them.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    buckets = min(buckets_for(n, per_bucket), most_buckets)
    width = (high - low) // buckets + 1
    place = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    docs = docs.withColumn("__b", place)
    # at most most_buckets + 1 rows
    heads = docs.groupBy("__b").agg(F.min("doc_id").alias("__first")).repartition(1)
    order = Window.orderBy("__b")
    heads = (heads.withColumn("__before", F.coalesce(F.lag("__b").over(order), F.max("__b").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        .withColumn("__last", F.lag("__b").over(order).isNull())
        .select(F.col("__b").alias("__own"), "__first", "__before", "__last"))
    met = docs.join(F.broadcast(heads), (F.col("__b") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    # of several rows with a bucket's first id, the least text visits: the window sorts them
    guests = met.withColumn("__b", F.col("__before")).withColumn("__guest", F.when(F.col("__last"), 2).otherwise(1)).select(
        *docs.columns, "__guest")
    both = docs.withColumn("__guest", F.lit(0)).unionByName(guests).repartition("__b")
    both = prepare(both.sortWithinPartitions("__b", "__guest", "doc_id", "text"))
    rows = Window.partitionBy("__b").orderBy("__guest", "doc_id", "text")
    return (both.withColumn("next", F.lead(F.struct(*carried)).over(rows))
            .where("__guest = 0").drop("__b", "__guest"))


def with_own(rows: DataFrame) -> DataFrame:
    """Adds n_chars and the distinct anchors of ``text`` (h, p: arrays of their
    hashes and places), and what the edited text shares with it: ``cut``
    characters and ``shared`` units up to the last blank of the part that stays
    (no unit spans a blank), and ``joint``, the hashes of the last of these
    units, whose windows reach beyond them."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("__kept", F.expr("substring(text, 1, cast(n_chars - n_chars div 4 AS int))"))
    rows = rows.withColumn("cut", F.expr("length(__kept) - length(substring_index(__kept, ' ', -1))")).drop("__kept")
    rows = rows.withColumn("__head", F.expr("substring(text, 1, cut)")).withColumn("__rest", F.expr("substring(text, cut + 1)"))
    rows = rows.withColumn("__hh", hashes("__head")).withColumn("__hr", hashes("__rest")).drop("__head", "__rest")
    rows = (rows.withColumn("__h", F.concat("__hh", "__hr")).withColumn("shared", F.size("__hh"))
            .withColumn("joint", F.expr(f"slice(__hh, greatest(size(__hh) - {WINDOW - 2}, 1), {WINDOW - 1})"))
            .drop("__hh", "__hr"))
    rows = with_distinct(with_windows(rows, "__h", "__w"), "text", "size(__h)", "__w", "__own").drop("__h", "__w")
    return rows.withColumn("h", F.col("__own.h")).withColumn("p", F.col("__own.p")).drop("__own")


def with_changed(rows: DataFrame) -> DataFrame:
    """Adds ``changed``: the distinct anchors of the column ``edited``.  Windows
    within the units it shares with the text are the text's own; only those
    that reach beyond are made."""
    rows = rows.withColumn("__tail", F.expr("substring(edited, cut + 1)"))
    rows = rows.withColumn("__ht", hashes("__tail")).drop("__tail")
    rows = rows.withColumn("__h", F.concat("joint", "__ht")).withColumn("__n", F.expr("shared + size(__ht)")).drop("__ht")
    rows = with_windows(rows, "__h", "__w", "shared - size(joint)")
    rows = rows.withColumn("__w", F.expr(f"concat(filter(own, x -> x.p <= shared - {WINDOW}), __w)"))
    return with_distinct(rows, "edited", "__n", "__w", "changed").drop("__h", "__n", "__w")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, aligned_edited, anchors and edited_anchors of every
    row of ``docs`` (doc_id, text).

    The edited text has its last quarter replaced by the start of the next
    document; aligned_edited is the share of the common anchors that stand
    at the same shift as most of them (by the median shift).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # texts move; anchors are made after, once for every text, and the next document's are read from its row
    rows = with_next(base, ["text", "h"], with_own)
    rows = rows.withColumn("own", F.arrays_zip("h", "p")).withColumn("edited", F.expr(
        "concat(substring(text, 1, cast(n_chars - n_chars div 4 AS int)), "
        "substring(next.text, 1, cast(n_chars div 4 AS int)))"))
    rows = with_changed(rows)
    # a common anchor's two places stand side by side
    rows = rows.withColumn("__m", F.expr(
        "sort_array(concat(transform(own, x -> struct(x.h AS h, 0 AS side, x.p AS p)), "
        "transform(changed, x -> struct(x.h AS h, 1 AS side, x.p AS p))))"))
    rows = rows.withColumn("__shifts", F.expr(
        "sort_array(filter(transform(__m, (x, i) -> CASE WHEN x.side = 1 AND get(__m, i - 1).h = x.h "
        "THEN x.p - get(__m, i - 1).p END), x -> x IS NOT NULL))"))
    aligned = F.expr("CASE WHEN size(__shifts) = 0 THEN 0D ELSE size(filter(__shifts, "
                     "x -> x = get(__shifts, size(__shifts) div 2))) / cast(size(__shifts) AS double) END")
    rows = rows.withColumn("anchors", as_text("own")).withColumn("edited_anchors", as_text("changed"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), short_form("anchors").alias("fingerprint"),
        short_form("edited_anchors").alias("edited_fingerprint"), likeness("h", "changed.h").alias("near_edited"),
        likeness("h", "next.h").alias("near_next"), aligned.alias("aligned_edited"), "anchors", "edited_anchors")
