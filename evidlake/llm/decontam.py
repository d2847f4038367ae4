"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every text becomes lower-case words; every K words in a row are hashed; of each WINDOW hashes in a
row the least (the last one on ties) is kept. Equal passages of K + WINDOW - 1 = SPAN words keep the
same hash at the same place, so joining kept hashes of documents and items finds each shared passage
of SPAN words. A hit is then extended word by word on both sides; it counts when SPAN words agree.
Items of fewer words are one passage each: their length is both K and span, and every hash is kept.

Documents without a run of neighbouring words that items hold as neighbours can't share a passage and
are passed over before hashing. Kept hashes of the items are put into the documents' scan as a set when
there are at most INLINE_PRINTS of them; the joins that follow see only hits then. Above that the join
does it all, with the words around every kept hash. No document text is shuffled as a whole.

Edge cases: null and wordless texts have no words, no hits and are clean; wordless items are ignored;
repeated document rows are judged one by one; items that repeat count by item_id; null item_ids are
ignored; of equal hashes in a window the last is kept, in documents and items alike; very long texts are
one row like others; empty tables give clean documents or no rows; other columns, whatever their names,
are ignored by `contaminate` and returned unchanged by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import few, let, picked, plain, settle

#: Words are runs of anything else, in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
K = 8
WINDOW = SPAN - K + 1
INLINE_PRINTS = 50_000
INLINE_PAIRS = 200_000
#: A kept hash carries its place in the low bits, inverted, so that the last of equals is the least.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def pieces_between(text: Column) -> Column:
    """Words of a text in lower case; the first and the last may be empty, which no word equals."""
    text = F.coalesce(text, F.lit(""))
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow), BETWEEN)


def words(text: Column) -> Column:
    return let(pieces_between(text), lambda w: F.filter(w, lambda x: x != ""))


def word_count(w: Column) -> Column:
    empty = (F.get(w, F.lit(0)) == "").cast("int") + (F.get(w, F.size(w) - 1) == "").cast("int")
    return F.greatest(F.size(w) - empty, F.lit(0)).cast("long")


def pair(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1))


def has_run(w: Column, known: list[int], least: int) -> Column:
    """Whether `least` pairs of neighbouring words in a row are all known."""
    marks = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.when(pair(w, i).isin(known), "1").otherwise("0"))
    return F.when(F.size(w) > least, F.array_join(marks, "").contains("1" * least)).otherwise(False)


def kept(w: Column, k: int, window: int, row, known: list[int] | None = None) -> Column:
    """row(hash, at) for each kept hash of an array of words (of those in `known`, if given), at counting from 0.

    The place of a window's least hash never moves back, so a hash kept twice is kept by neighbours.
    """

    def hashed(i):
        gram = F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return gram.bitwiseAND(F.lit(~PLACE)).bitwiseOR((F.lit(PLACE) - i).cast("long").bitwiseAND(F.lit(PLACE)))

    def pick(least):
        value = lambda i: F.get(least, i).bitwiseAND(F.lit(~PLACE))
        at = lambda i: i + F.pmod(F.lit(PLACE) - F.get(least, i) - i, F.lit(PLACE + 1)).cast("int")

        def wanted(i):
            new = (i == 0) | (F.get(least, i) != F.get(least, i - 1)) if window > 1 else F.lit(True)
            return new if known is None else value(i).isin(known) & new

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(least) - 1), wanted), lambda i: row(value(i), at(i)))

    def winnow(h):
        if window == 1:
            return pick(h)
        return let(F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.least(*[F.get(h, i + j) for j in range(window)])), pick)

    return F.when(F.size(w) >= k + window - 1, let(F.transform(F.sequence(F.lit(0), F.size(w) - k), hashed), winnow))


def around(w: Column, at: Column, k: int, reach: int) -> Column:
    """The gram at a place with up to `reach` words on either side: struct(left nearest first, gram, right)."""
    start = F.greatest(at - reach, F.lit(0))
    left = F.reverse(F.slice(w, start + 1, at - start))
    return F.struct(left.alias("left"), F.slice(w, at + 1, F.lit(k)).alias("gram"), F.slice(w, at + k + 1, F.lit(reach)).alias("right"))


def agreeing(a: Column, b: Column) -> Column:
    """How many first elements of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first_off = F.array_position(same, False)
    return F.when(first_off > 0, first_off - 1).otherwise(F.size(same)).cast("int")


def _hits(w: Column, gram: int, window: int, least: int, known: list[int] | None) -> Column:
    """Kept hashes of a document with the words around them; only those in `known`, if given."""
    row = lambda h, at: F.struct(F.lit(least).alias("least"), F.lit(gram).alias("k"), h.alias("hash"), at.alias("at"), around(w, at, gram, least - gram).alias("here"))
    return F.coalesce(kept(w, gram, window, row, known), F.array())


def contaminate(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", span: int = SPAN, k: int = K, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and `carry`."""
    extra = list(carry or {})
    if not carry:
        docs, name = plain(docs)
        id_col, text_col = name(id_col), name(text_col)
    pool = settle(picked(items, item=item_col, text=item_text).where("item is not null").select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0))
    shorts = [r.n for r in pool.where(F.size("w") < span).select(F.size("w").alias("n")).distinct().orderBy("n").collect()]  # at most span - 1 lengths
    schemes = [(k, span - k + 1, span)] + [(n, 1, n) for n in shorts]

    prints = None
    for gram, window, least in schemes:
        fit = pool.where(F.size("w") >= span if least == span else F.size("w") == least)
        one = fit.select("item", "w", F.explode(kept(F.col("w"), gram, window, lambda h, at: F.struct(h.alias("hash"), at.alias("at")))).alias("p")).select("item", F.lit(least).alias("least"), F.col("p.hash").alias("hash"), around(F.col("w"), F.col("p.at"), gram, least - gram).alias("there"))
        prints = one if prints is None else prints.unionByName(one)
    prints = settle(prints)
    sample = prints.select("least", "hash").limit(INLINE_PRINTS + 1).collect()
    inline = len(sample) <= INLINE_PRINTS

    # Pairs of neighbouring words of the items: a passage needs a run of them, so most documents stop here.
    run = min([span, *shorts]) - 1
    pairs = pool.where(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: pair(F.col("w"), i))).alias("p")).distinct().limit(INLINE_PAIRS + 1).collect() if run else []
    screen = has_run(F.col("_w"), [r.p for r in pairs], run) if run and len(pairs) <= INLINE_PAIRS else F.lit(True)

    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), pieces_between(F.col(text_col)).alias("_w"), *[c.alias(n) for n, c in (carry or {}).items()])
    hits = []
    for gram, window, least in schemes:
        known = list({r.hash for r in sample if r.least == least}) if inline else None
        hits.append(_hits(F.col("_w"), gram, window, least, known))
    rows = base.select("_row", "doc_id", word_count(F.col("_w")).alias("n_words"), F.when(screen, F.concat(*hits)).alias("_hits"), *extra)
    rows = rows.select("_row", "doc_id", "n_words", *extra, F.explode_outer("_hits").alias("_h"))
    # A row without hits gets a key of its own, so that the join can spread such rows.
    rows = rows.select("_row", "doc_id", "n_words", *extra, F.coalesce("_h.hash", -1 - F.col("_row")).alias("hash"), F.coalesce("_h.least", F.lit(-1)).alias("least"), "_h.k", "_h.at", "_h.here")

    joined = rows.join(F.broadcast(prints) if inline else prints, ["least", "hash"], "left")
    left, right = agreeing(F.col("here.left"), F.col("there.left")), agreeing(F.col("here.right"), F.col("there.right"))
    ends = F.when(F.col("here.gram") == F.col("there.gram"), F.struct((F.col("at") - left).alias("s"), (F.col("at") + F.col("k") + right).alias("e")))
    spans = joined.select("_row", "doc_id", "n_words", *extra, "least", "item", ends.alias("_x")).withColumn("_ok", F.col("_x.e") - F.col("_x.s") >= F.col("least"))
    per_row = spans.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in extra],
        F.collect_set(F.when(F.col("_ok"), F.col("_x"))).alias("_spans"), F.collect_set(F.when(F.col("_ok"), F.col("item").cast("string"))).alias("_items"),
    )
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["s"], acc["end"]))).cast("int").alias("n"), F.greatest(acc["end"], s["e"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    out = per_row.withColumn("n_hit", covered)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *extra,
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The documents that aren't contaminated, all columns. Rows are told apart by id and a hash of the text.

    What is contaminated goes to the documents as (id, hash), by broadcast up to a counted bound.
    """
    rows, name = plain(docs)
    mark = F.xxhash64(name(text_col))
    judged = contaminate(rows, items, id_col=name(id_col), text_col=name(text_col), carry={"mark": mark}, **how)
    bad = settle(judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct())
    kept = rows.join(few(bad), F.col(name(id_col)).eqNullSafe(F.col("bad_id")) & (mark == F.col("bad_mark")), "left_anti")
    return kept.toDF(*docs.columns)
