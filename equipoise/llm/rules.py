"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over the whole text; there are no user
functions and no shuffle. Null and empty texts have no words and fail the base
rule. Rows are independent, so repeated rows get equal results; columns other
than the id and the text are not read.

The stop-word rule knows the languages of ``STOP_WORDS``. It is left out for a text
with more than 2 % of its characters in letters of other alphabets (Cyrillic, Polish,
Turkish, Chinese, ...), of which the list can say nothing. Languages outside the list that
write the same letters are still measured by it; pass other ``rules`` for them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import hashes, window_hashes

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with you "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui se sur un une "
    "auch auf das dem den der die ein eine für ist mit nicht sich sie und von zu "
    "al como con del el ella las lo los no para por su una y"
).split()

#: The letters of these languages.
_LETTERS = "a-zàâäáæçéèêëíîïñóôöœßúùûüÿ"


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= statistic <= high``; None leaves a side open. The
    rule is left out where the statistic ``unless`` is over ``above``."""

    statistic: str
    low: float | None = None
    high: float | None = None
    unless: str | None = None
    above: float = 0.0


#: The threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None, unless="other_letter_ratio", above=0.02),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bar_line_ratio", None, 0.5),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Statistic name -> expression over the counts of ``text_counts``.
STATISTICS = {
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "other_letter_ratio": lambda: _ratio("n_other_letters", "word_chars"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "bar_line_ratio": lambda: _ratio("n_bar_lines", "n_lines"),
}


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document over the whole text. ``n_other_letters``, letters of
    other alphabets, is counted where under 2 % of the words are stop words, else 0.

    ``n_repeat_words`` counts the words that lie in an 8-word window found twice
    or more in the text. Windows are compared by a 64-bit hash. Texts whose
    window hashes are all distinct need no more than that; for the others the
    windows are sorted by hash, and the covered words are summed over the
    positions of the repeated ones."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    df = df.select(id_col, "__t", F.array_remove(F.split("__t", _SPACE), "").alias("__w"),
                   F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    bare = F.lower(F.regexp_replace(F.array_join("__w", " "), r"[.,;:!?]", ""))
    df = df.select(
        id_col,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__lines", lambda x: x.rlike(r"\|.*\|"))).cast("long").alias("n_bar_lines"),
        F.size(F.filter(F.split(bare, " "), lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        hashes(F.col("__w")).alias("__h"), "__t",
    )
    other = F.length(F.regexp_replace(F.lower("__t"), rf"[^\p{{L}}]+|[{_LETTERS}]+", ""))
    df = df.withColumn("n_other_letters", F.when(50 * F.col("n_stop_words") < F.col("n_words"), other).otherwise(0).cast(
        "long")).drop("__t")
    df = df.withColumn("__h8", window_hashes(F.col("__h"), 8)).drop("__h")
    again = F.size(F.array_distinct("__h8")) < F.size("__h8")
    df = df.withColumn("__s", F.when(again, F.sort_array(
        F.transform("__h8", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("__h8")

    def repeated(e: Column, j: Column) -> Column:
        before, after = F.get("__s", j - 1)["h"], F.get("__s", j + 1)["h"]
        return F.when((e["h"] == before) | (e["h"] == after), e["p"])

    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.filter(
        F.transform("__s", repeated), lambda p: p.isNotNull())))).drop("__s")
    cover = F.transform("__p", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("__p", j + 1) - p, F.lit(8))))
    return df.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("__p")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for the whole threshold table."""
    sides = []
    for r in rules:
        value = STATISTICS[r.statistic]()
        free = F.lit(False) if r.unless is None else STATISTICS[r.unless]() > r.above
        if r.low is not None:
            sides.append(free | (value >= r.low))
        if r.high is not None:
            sides.append(free | (value <= r.high))
    return reduce(lambda a, b: a & b, sides, F.lit(True))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed`` (under 20 words, or over 30 % of the words in
    repeated 8-word windows) and ``kept`` for every row of ``docs``."""
    df = text_counts(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
