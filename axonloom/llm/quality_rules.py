"""Quality rules: a table of thresholds compiled into one projection, DataFrame functions only.

Measures are columns (lengths, symbol, stop-word and line ratios); a rule names a measure and its bounds, and the
verdict is the conjunction of all rules. Repeated 5-word windows are found inside the row: each window's 64-bit hash
is sorted with its place, equal neighbours repeat, and the covered words are the gaps between their places, at most
five each. Only texts whose window hashes aren't all distinct are sorted.

Defined cases: null and blank texts have no words, fail and aren't kept; ratios over nothing are 0; repeated rows stay
rows; other columns are ignored. All work is within a row: no shuffle, memory about 60 bytes a word of one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, symbols, and frequent function words of the languages served.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "a an and are as at be by for from he in is it of on or that the this to was with",
    "fr": "au de des du elle en est et il la le les ne par pas pour que qui sur un une",
    "de": "als auf das dem den der des die ein eine für ist mit nicht sich sie und von zu",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
}
WINDOW = 5
#: (measure, least, most); None: no bound. A row must satisfy all.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 25.0),
    ("symbol_ratio", None, 0.20),
    ("stop_word_ratio", 0.002, None),
    ("dup_line_ratio", None, 0.40),
    ("upper_ratio", None, 0.50),
]


def compiled(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """The rules as one boolean column."""
    tests = [t for name, low, high in rules for t in ((F.col(name) >= low) if low is not None else None, (F.col(name) <= high) if high is not None else None) if t is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more, of (hash, place) pairs in hash order."""
    def twin(x, i):
        return (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"])

    places = F.array_sort(F.transform(F.filter(windows, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(WINDOW))).alias("n"), p.alias("last")), lambda acc: acc["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    one = docs.select("doc_id", text.alias("t"), words.alias("words"))
    places = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.when(F.size("words") > WINDOW, F.transform(places, lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW))))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    two = one.select(
        "doc_id", "t", F.size("words").cast("bigint").alias("n_words"), hashes.alias("hashes"), lines.alias("lines"),
        _stops(stops).alias("n_stop"),
        (F.length("t") - F.length(F.translate("t", SPACES, ""))).alias("n_space"),
    )
    clash = F.size("hashes") > F.size(F.array_distinct("hashes"))
    three = two.withColumn("windows", F.when(clash, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n_lines = F.size("lines")
    four = three.select(
        "doc_id", "n_words", (F.length("t") - F.col("n_space")).cast("bigint").alias("word_chars"), _without(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), n_lines.alias("n_lines"),
        F.coalesce(_repeated(F.col("windows")), F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_stop",
        F.length(F.regexp_replace("t", r"\P{Lu}+", "")).alias("n_upper"), F.length(F.regexp_replace("t", r"\P{L}+", "")).alias("n_letters"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return four.select(
        "*", ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_word_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_upper", "n_letters").alias("upper_ratio"),
    )


def _stops(stops: list[str]) -> Column:
    """How many words are stop words, ending marks aside."""
    plain = F.split(F.lower(F.translate(F.array_join("words", " "), ".,;:!?", "")), " ")
    return F.size(F.filter(plain, lambda w: w.isin(stops)))


def judged(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the ratios."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"),
        "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "upper_ratio",
    )
