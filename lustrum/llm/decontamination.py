"""Benchmark decontamination by winnowing, DataFrame operations only.

Every word has a hash, every k consecutive words have one of their words' hashes.  The
least hash within a window (``span`` words) is the window's fingerprint; of neighbouring
windows with one fingerprint only the first is kept, so that about two of ``span - k + 2``
go on.  Equal windows have equal fingerprints, so every shared span of a window's length
meets in the join of the documents' kept fingerprints with those of the benchmark items.
Each hit is then extended over the neighbouring windows that share its fingerprint, and
each of these is verified word by word against the items' windows.  An item shorter than
a window is one window of its own length; all lengths are told in the same pass.

The documents are read once: words are hashed where they are read, and only windows
whose fingerprint some item has, and one row a document, go on.  The benchmark's
fingerprints are broadcast if a count finds them few enough; else the documents' kept
fingerprints are shuffled with their places, and the documents with hits read again.

Defined results: a null text has no words, hits or items; an empty benchmark hits
nothing; rows alike in doc_id and text get the same result each; items alike in id are
one item; the hash of no items is that of the empty string; extra columns of either
table aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

SPAN, K = 10, 5
#: fingerprints that are broadcast at most (16 bytes each)
BROADCAST = 1_000_000
#: windows that a kept one stands for at most
REACH = 16
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["doc_id", "th"]


def _words(df: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the array ``words`` of ``df.text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))
    parts = df.select(*keep, F.split(low, _BETWEEN, -1).alias("parts"))
    first = F.when(F.get("parts", F.lit(0)) == "", 2).otherwise(1)
    last = F.size("parts") - F.when(F.element_at("parts", -1) == "", 1).otherwise(0)
    return parts.select(*[c for c in parts.columns if c != "parts"], F.slice("parts", first, F.greatest(F.lit(0), last - first + 1)).alias("words"))


class _Winnow:
    """Fingerprints of windows of several lengths, the longest of which is ``span``."""

    def __init__(self, span: int, k: int, lengths: list[int]):
        self.span, self.k, self.lengths = span, k, lengths

    def hashed(self, worded: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, words, and g1, g2 ... with the hashes of as many consecutive words."""
        each = worded.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("each"))

        def grams(m: int) -> Column:
            at = F.sequence(F.lit(0), F.size("each") - m)
            run = F.transform(at, lambda i: F.xxhash64(*[F.get("each", i + j) for j in range(m)]))
            return F.when(F.size("each") < m, F.array().cast("array<bigint>")).otherwise(run)

        return each.select(*keep, "words", *[grams(m).alias(f"g{m}") for m in sorted({min(self.k, s) for s in self.lengths})])

    def places(self, s: int, low: int = 0) -> Column:
        """A number for each window of ``s`` words that starts at ``low`` or behind."""
        base, last = self.span + 1, F.size("words").cast("long") - s
        return F.when(last < low, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(low * base + s).cast("long"), last * base + s, F.lit(base).cast("long")))

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with s (the window's length) and at (its first word's place) from ``place``; -1 is no window's."""
        base = F.lit(self.span + 1)
        return rows.withColumns({"s": F.pmod("place", base).cast("int"), "at": F.floor(F.col("place") / base).cast("int")})

    def least(self, s: int, at: Column) -> Column:
        m = min(self.k, s)
        each = [F.get(f"g{m}", at + i) for i in range(s - m + 1)]
        return F.least(*each) if len(each) > 1 else each[0]

    def fingerprint(self) -> Column:
        """Of the window of length s at ``at``; lengths don't share fingerprints."""
        out = None
        for s in self.lengths:
            one = self.least(s, F.col("at")) if s == self.span else F.xxhash64(self.least(s, F.col("at")), F.lit(s))
            out = F.when(F.col("s") == s, one) if out is None else out.when(F.col("s") == s, one)
        return out

    def fresh(self) -> Column:
        """Whether a window's fingerprint isn't that of the window before it, or that one is too far back."""
        out = F.col("at") % REACH == 0
        for s in self.lengths:
            out = out | ((F.col("s") == s) & (self.least(s, F.col("at") - 1) != self.least(s, F.col("at"))))
        return out

    def extended(self) -> Column:
        """The places of the windows that a kept one stands for, itself included."""

        def alike(s: int) -> Column:
            last = F.least(F.lit(REACH - 1), F.size("words") - s - F.col("at"))
            return F.filter(F.sequence(F.lit(0), last), lambda j: self.least(s, F.col("at") + j) == self.least(s, F.col("at")))

        out = F.lit(None)
        for s in self.lengths:
            out = F.when(F.col("s") == s, alike(s)).otherwise(out)
        return out


def _text() -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, F.col("s")), " ")


def _verifiable(met: DataFrame, win: _Winnow, keep: list[str]) -> DataFrame:
    """Windows with their texts from kept ones that some item's fingerprint met."""
    each = met.select(*keep, "words", "s", "at", F.explode(win.extended()).alias("j"))
    return each.select(*keep, "words", "s", (F.col("at") + F.col("j")).alias("at")).select(*keep, "s", "at", _text().alias("w"))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated."""
    per_item = durable(_words(items, [F.col("item_id").cast("string").alias("item_id")]))
    sizes = per_item.select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < span)).distinct()
    win = _Winnow(span, k, [span, *sorted(r[0] for r in sizes.collect())])  # fewer lengths than ``span``
    n = F.size("words")
    whole = F.when(n >= span, win.places(span)).when(n > 0, F.array(n.cast("long")))
    known = win.hashed(per_item.where(n > 0), ["item_id"]).withColumn("place", F.explode(whole))
    known = durable(win.placed(known).select("item_id", "s", win.fingerprint().alias("fp"), _text().alias("w")).distinct())
    fps = known.select(F.col("fp").alias("known_fp")).distinct()
    few = known.count() <= BROADCAST

    worded = _words(docs, [F.col("doc_id"), F.xxhash64("text").alias("th")])
    every = F.concat(*[win.places(s) for s in win.lengths])
    if few:  # one pass: a row a document (place -1), and the windows whose fingerprint some item has
        at = win.placed(win.hashed(worded, _KEY).withColumn("place", F.explode(F.concat(F.array(F.lit(-1).cast("long")), every))))
        is_doc = F.col("place") < 0
        at = at.where(is_doc | win.fresh()).withColumn("fp", F.when(~is_doc, win.fingerprint()))
        met = at.join(F.broadcast(fps), at["fp"] == F.col("known_fp"), "left").where(is_doc | F.col("known_fp").isNotNull())
        alone = F.when(is_doc, F.array(F.lit(0))).otherwise(win.extended())
        each = met.select(*_KEY, "words", "s", "at", F.when(is_doc, n.cast("long")).alias("n_words"), F.explode(alone).alias("j"))
        each = each.withColumn("at", F.col("at") + F.col("j"))
        rows = durable(each.select(*_KEY, "n_words", "s", "at", F.when(F.col("n_words").isNull(), _text()).alias("w")))
        marks, found = rows.where("n_words is not null").select(*_KEY, "n_words"), rows.where("n_words is null").select(*_KEY, "s", "at", "w")
    else:  # places are shuffled, and no texts but those of documents with hits
        marks = worded.select(*_KEY, n.cast("long").alias("n_words"))
        at = win.placed(win.hashed(worded, _KEY).withColumn("place", F.explode(every)))
        kept = at.where(win.fresh()).select(*_KEY, "s", "at", win.fingerprint().alias("fp"))
        hits = durable(kept.join(fps, kept["fp"] == F.col("known_fp")).select(*_KEY, "s", "at"))
        per_doc = hits.groupBy(*_KEY).agg(F.collect_set(F.struct("s", "at")).alias("kept")).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "kept")
        own = worded.join(per_doc, worded["doc_id"].eqNullSafe(F.col("hit_id")) & (worded["th"] == F.col("hit_th")))
        own = own.select(*_KEY, "words", "kept").dropDuplicates(_KEY)
        met = win.hashed(own, [*_KEY, "kept"]).withColumn("one", F.explode("kept")).withColumns({"s": F.col("one.s"), "at": F.col("one.at")})
        found = durable(_verifiable(met, win, _KEY))

    sure = found.join(known.select("item_id", "s", "w").distinct(), ["s", "w"])
    reach = F.struct(F.col("at").alias("a"), (F.col("at") + F.col("s")).alias("b"))
    per_doc = sure.groupBy(*_KEY).agg(F.sort_array(F.collect_set(reach)).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate("spans", zero, lambda x, p: F.struct(F.greatest(x["end"], p["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(x["end"], p["a"]))).alias("n")), lambda x: x["n"])
    per_doc = per_doc.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), union.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("named"))
    out = marks.join(per_doc, marks["doc_id"].eqNullSafe(F.col("hit_id")) & (marks["th"] == F.col("hit_th")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(*_KEY, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("named", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
