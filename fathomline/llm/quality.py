"""Quality rules by distribution divergence, with DataFrame functions only.

A text's histograms of character classes and of its language's common words are
compared with the language's own, gathered from all documents of that language,
by Jensen-Shannon distance (base 2: 0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch

_SPACES = " \t\n\x0b\x0c\r"
_GAP, _WORDY = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"
#: Runs that hold no symbol and nothing of the classes below; taken out first, they leave little to count in.
_COMMON_RUNS = "[a-z\u00df-\u00ff ]+"
#: Character classes counted one by one; the others are white space, symbols and the rest (letters).
_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "mark": ".,;:!?'\"-()[]{}/\\_",
}
_HISTOGRAM = ("space", "symbol", "upper", "digit", "mark", "rest")
#: A language's common words: so many of the most frequent ones.
COMMON_WORDS = 24
#: More languages than these are joined by a shuffle rather than sent to all executors.
BROADCAST_LANGUAGES = 1_000
#: Of more languages than these, a text's words are looked up in its own language's common words only, one by one.
LISTED_LANGUAGES = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are compared by a 64-bit hash of their words' hashes. Sorted with their positions, equal ones
    are neighbours; the positions of repeated ones, sorted, cover at most three
    words each, less where the next begins within them.
    """

    def windows(own: Column) -> Column:
        # the last two have no window and are cut off
        later = lambda k: F.slice(own, k, F.greatest(F.size(own), F.lit(1)))
        two = F.zip_with(own, later(2), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(two, later(3), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(own) - 2, F.lit(0)))

    def repeated(s: Column) -> Column:
        flagged = F.transform(
            s,
            lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]),
        )
        return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        spans = F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts repeat nothing, which a set tells without sorting
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(_let(placed, repeated), covered))

    return _let(_let(F.transform(words, lambda x: F.xxhash64(x)), windows), count)


def base(text: Column, words: Column, rest: Column) -> dict[str, Column]:
    """The base columns of a text with its words and what is left of it without common runs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORDY))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(rest, _SYMBOLS).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def _count(text: Column, characters: str) -> Column:
    """How often these characters are in a text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of one length; null if either is all zero."""

    def share(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return _let(total, lambda t: F.transform(a, lambda x: F.try_divide(x.cast("double"), t)))

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).when(x.isNotNull(), F.lit(0.0))

    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return _let(total, lambda t: F.sqrt(F.when(t > 0, t).when(t.isNotNull(), F.lit(0.0))))


def common_words(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang") -> DataFrame:
    """For each language its most frequent words, array common (by count, then code point), and their counts; last, of all other words."""
    words = docs.select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word"))
    counts = scratch.save(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "counts")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    # totals by plain aggregation; the ranking keeps a few rows of each partition before it shuffles
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    out = total.join(top, total["lang"].eqNullSafe(top["lang"]), "left").select(total["lang"], "total", F.coalesce("top", F.array().cast("array<struct<rank:int,word:string,n:bigint>>")).alias("top"))
    known = F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return out.select(
        "lang",
        F.transform("top", lambda x: x["word"]).alias("common"),
        F.concat(F.transform("top", lambda x: x["n"]), F.array(F.col("total") - known)).alias("common_ref"),
    )


def measure(docs: DataFrame, common: DataFrame, broadcast: bool, key: str = "doc_id", text: str = "text", lang: str = "lang", listed: list[str] | None = None) -> DataFrame:
    """Per document its key, language, base columns and both histograms. listed: all languages' common words, if they are few."""
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # columns that others use more than once are projected first, so each is computed once
    rows = rows.withColumns({"_words": words_of(F.col("_text")), "_rest": F.regexp_replace("_text", _COMMON_RUNS, "")})
    met = rows.join(F.broadcast(common) if broadcast else common, F.col("_lang").eqNullSafe(F.col("lang")), "left")
    text_ = F.col("_text")
    # words that can be common ones; those of other languages are not counted
    if listed is not None:
        hits = F.filter("_words", lambda w: w.isin(listed))
    else:
        hits = _let(F.coalesce("common", F.array().cast("array<string>")), lambda c: F.filter("_words", lambda w: F.array_contains(c, w)))
    counted = _let(hits, lambda h: F.transform("common", lambda c: F.size(h) - F.size(F.array_remove(h, c))))
    columns = base(text_, F.col("_words"), F.col("_rest"))
    classes = {name: _count(F.col("_rest"), chars) for name, chars in _CLASSES.items()}
    out = met.select("key", F.col("_lang").alias("lang"), "common_ref", F.length("_text").alias("_n"), *(c.alias(n) for n, c in columns.items()), *(c.alias(n) for n, c in classes.items()), counted.alias("_hits"))
    hit = F.aggregate("_hits", F.lit(0), lambda s, x: s + x)
    space = F.col("_n") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("upper") - F.col("digit") - F.col("mark")
    return out.select(
        "key",
        "lang",
        *columns,
        F.array(*(c.cast("long") for c in (space, F.col("n_symbols"), F.col("upper"), F.col("digit"), F.col("mark"), rest))).alias("classes"),
        F.concat(F.transform("_hits", lambda x: x.cast("long")), F.array(F.col("n_words") - hit)).alias("common"),
        "common_ref",
    )


def judge(
    docs: DataFrame,
    scratch: Scratch,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.45,
    min_reference_words: int = 2_000,
) -> DataFrame:
    """One row per row of docs: key, base columns, class_distance, word_distance, base_failed, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the
    words are in repeated 3-word windows. A text that passes is kept unless one of
    its distances to its language is above its limit. A language (null is one) of
    fewer than min_reference_words words tells nothing, so its texts are kept; so
    are texts shorter than min_words, as far as the distances go. Null and empty
    texts have no words and fail. Repeated rows are judged one by one and alike.
    An empty table gives an empty result; other columns of docs are not read.
    """
    common = scratch.save(common_words(docs, scratch, text, lang), "common")
    languages = common.count()
    few = languages <= BROADCAST_LANGUAGES
    listed = None
    if 0 < languages <= LISTED_LANGUAGES:
        listed = sorted(r[0] for r in common.select(F.explode("common")).distinct().collect()) or None  # COMMON_WORDS of each language at most
    rows = scratch.save(measure(docs, common, few, key, text, lang, listed), "measured")
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(_HISTOGRAM))]
    reference = rows.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    reference = reference.select(F.col("lang").alias("_lang"), "ref_words", F.array(*(f"c{i}" for i in range(len(_HISTOGRAM)))).alias("class_ref"))
    met = rows.join(F.broadcast(reference) if few else reference, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    met = met.withColumn("class_distance", divergence(F.col("classes"), F.col("class_ref")))
    met = met.withColumn("word_distance", divergence(F.col("common"), F.col("common_ref"))).withColumn("base_failed", failed)
    guarded = (F.col("ref_words") < min_reference_words) | (F.col("n_words") < min_words)
    far = (F.col("class_distance") > max_class_distance) | (F.col("word_distance") > max_word_distance)
    verdict = guarded | ~F.coalesce(far, F.lit(False))
    return met.select(
        F.col("key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "class_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & verdict).alias("kept"),
    )
