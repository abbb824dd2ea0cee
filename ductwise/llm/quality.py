"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each statistic of a text is one expression over its words or lines. The rules are put in order of rejections per second, both measured on
a sample, and evaluated as one CASE expression, which stops at the first rule that rejects. The order decides how much work
is done, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductwise.llm.common import NOT_SPACE, saved, smallest_hashes, unused, words

SYMBOLS = r"[#*$%&|<>]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Text:
    """A text with its words and the lines that have a word, each evaluated once for all that reads them; `known` holds statistics that are there already."""

    text: Column
    words: Column
    lines: Column
    known: Column | None = None

    def share_of_lines(self, pattern: str) -> Column:
        return F.size(F.filter(self.lines, lambda x: x.rlike(pattern)))

    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long") if self.known is None else self.known["word_chars"]

    def n_symbols(self) -> Column:
        return F.regexp_count(self.text, F.lit(SYMBOLS)).cast("long") if self.known is None else self.known["n_symbols"]

    def n_dup_lines(self) -> Column:
        return (F.size(self.lines) - F.size(F.array_distinct(self.lines))).cast("long") if self.known is None else self.known["n_dup_lines"]

    def n_repeat_words(self) -> Column:
        return repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for a text to be rejected."""

    name: str
    rejects: Callable[[Text], Column]


#: Thresholds follow common practice for web text.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols() > t.n_words()),
    Rule("mean_word_length", lambda t: _let(t.word_chars(), lambda n: (n < 2 * t.n_words()) | (n > 20 * t.n_words()))),
    Rule("duplicate_lines", lambda t: 10 * t.n_dup_lines() > 3 * F.size(t.lines)),
    Rule("upper_case", lambda t: 2 * (F.length(t.text) - F.length(F.regexp_replace(t.text, "[A-Z]", ""))) > t.word_chars()),
    Rule("ellipsis_lines", lambda t: 10 * t.share_of_lines("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$") > 3 * F.size(t.lines)),
    Rule("bullet_lines", lambda t: 10 * t.share_of_lines("^[\\x20\\x09-\\x0D]*[-•*]") > 9 * F.size(t.lines)),
    Rule("few_words_with_letters", lambda t: 10 * F.size(F.filter(t.words, lambda w: w.rlike("\\p{L}"))) < 7 * t.n_words()),
)
#: What fails the base, whatever else is asked.
BASE = (Rule("few_words", lambda t: t.n_words() < 50), Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words()))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often `use` reads it and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def of_text(use: Callable[[Text], Column], name: str = "text") -> Column:
    """`use` of a text column; null counts as empty. One expression, so a filter on it does not split a text twice."""
    lines = lambda text: F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return _let(F.coalesce(F.col(name), F.lit("")), lambda text: _let(words(text), lambda w: _let(lines(text), lambda x: use(Text(text, w, x)))))


def rejected(rules: Iterable[Rule], t: Text) -> Column:
    """Whether one of the rules rejects; evaluation stops at the first that does."""
    verdict = F.when(F.lit(False), True)
    for r in rules:
        verdict = verdict.when(F.coalesce(r.rejects(t), F.lit(False)), True)
    return verdict.otherwise(False)


def repeated_words(words: Column) -> Column:
    """How many words are in a 3-word window that the array holds twice or more.

    A window's hash with its position in the low bits makes one plain number; sorting those brings equal windows together,
    and the whole hashes decide whether neighbours are equal.
    """

    def counted(w: Column) -> Column:
        high = F.lit(-1).cast("long") - F.pow(F.lit(2), F.ceil(F.log2(F.size(w) + 1))).cast("long") + 1

        def of_hashes(h: Column, high: Column) -> Column:
            place = lambda x: (x - x.bitwiseAND(high)).cast("int")
            same = lambda x, y: F.get(h, place(x)) == F.get(h, place(y))
            twice = lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            packed = F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long")))
            return F.aggregate(
                F.sort_array(F.transform(_let(F.sort_array(packed), twice), place)),
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
                lambda a: a["n"],
            )

        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(high, lambda m: of_hashes(h, m))).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(w) > 3, _let(hashes, repeats)).otherwise(F.lit(0).cast("long"))

    return _let(words, counted)


def cascade_order(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = 1000, passes: int = 3) -> list[tuple[Rule, float, float]]:
    """Rules with their measured seconds for the sample and rejected share, most rejections per second first.

    The sample is the sample_rows rows with the smallest hash of doc_id; it sets the order only. A rule is timed over the texts
    themselves, statistics and all, as the least of `passes` runs, less what a run without a rule takes.
    """
    chosen = smallest_hashes(docs.select("doc_id"), "doc_id", sample_rows).distinct()
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").coalesce(1))
    n = max(1, sample.count())

    def timed(verdict: Column) -> tuple[float, int]:
        took, hits = float("inf"), 0
        for _ in range(passes):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(verdict)).first()[0]
            took = min(took, time.perf_counter() - began)
        return took, hits

    empty, _ = timed(of_text(lambda t: F.size(t.words) + F.size(t.lines) < 0))
    found = [(r, *timed(of_text(lambda t, r=r: rejected([r], t)))) for r in rules]
    found = [(r, max(took - empty, 1e-3), hits / n) for r, took, hits in found]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def judged(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    kept is false if the base fails or a rule of the cascade rejects. Null and empty texts have no words and fail the base.
    Every row of `docs` gives one row, repeated ones included; columns of `docs` with one of the added names are replaced.
    """
    order = [r for r, _, _ in cascade_order(docs, rules, sample_rows)]

    def all_of(t: Text) -> Column:
        stats = F.struct(*[getattr(t, c)().alias(c) for c in STATS])
        base = lambda s: (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        return _let(stats, lambda s: F.struct(*[s[c].alias(c) for c in STATS], base(s).alias("base_failed"), F.when(base(s), False).otherwise(~rejected(order, replace(t, known=s))).alias("kept")))

    added = [*STATS, "base_failed", "kept"]
    (found,) = unused(docs, "found")
    out = docs.withColumn(found, of_text(all_of))
    return out.select(*[c for c in docs.columns if c not in added], *[F.col(found)[c].alias(c) for c in added])


def keep_good(docs: DataFrame, rules: Iterable[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Rows of `docs`, with its columns, that base and cascade keep; the base's two rules take their places in the cascade."""
    order = [r for r, _, _ in cascade_order(docs, [*BASE, *rules], sample_rows)]
    return docs.where(~of_text(lambda t: rejected(order, t)))
