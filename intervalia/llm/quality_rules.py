"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate over measures that are computed where it is reached. `plan_cascade` evaluates each rule on
a bounded sample (SAMPLE_ROWS rows of least hash), many times over in one job, for its cost above that of a job
that only finds the words, and takes as next rule the one with the most rejections per cost among the rows that the rules
before it leave. `verdict` evaluates the rules in that order and stops at the first that rejects. The order
changes only the speed, never the verdict. `score` also returns the measures of the base rule, which are computed for
every row; those of the other rules are computed only where the base rule and the rules before let a text through.

Null, blank and empty texts have no words and fail the base rule; very long ones are judged whole, in a row of their own;
repeated rows are judged each by itself; null doc_ids stay null; an empty table gives no rows. Columns beside the
text are kept by keep(), whatever their names; score() names its own columns as in MEASURES, base_failed and kept
and takes those names from columns of docs that have them. Equal windows of words are known by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervalia.llm.common import WORD, dropped, saved, text_of, words

SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which the rules are measured.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """A rule rejects where `reject` of the measures holds; `needs` names the measures that it reads."""

    name: str
    reject: Callable[[dict[str, Column]], Column]
    needs: tuple[str, ...]


def count_of(text: Column, characters: str) -> Column:
    """Characters of text in a class of a pattern."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur at least twice in the text.

    The windows are sorted by hash, those equal to a neighbour keep their starts, and the sorted
    starts cover min(width, gap) new words each: n log n in the words of one text, with no shuffle.
    """
    starts = F.sequence(F.lit(0), F.size(w) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def count(h: Column) -> Column:
        # most texts repeat no window, which needs no sort
        keyed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(once(F.sort_array(keyed), covered))

    return F.when(F.size(w) > width, once(hashes, count)).otherwise(F.lit(0)).cast("long")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it, in filters too."""
    return F.get(F.transform(F.array(value), f), 0)


#: The measures of the base rule.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(t: Column, w: Column) -> dict[str, Column]:
    """Native measures of a text t with words w."""
    split = F.split(t, "\n")
    lines = F.filter(split, lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_lines": F.size(split).cast("long"),
        "n_upper": count_of(t, "A-Z"),
        "n_exclaims": count_of(t, "!"),
        "n_digits": count_of(t, "0-9"),
        "n_ellipses": F.regexp_count(t, F.lit(r"\.\.\.|\u2026")).cast("long"),
        "n_bullets": F.size(F.filter(split, lambda x: F.ltrim(x).rlike("^[-*\u2022] "))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
        "longest_word": F.array_max(F.transform(w, F.length)).cast("long"),
    }


def base_fails(m: dict[str, Column]) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def default_rules() -> list[Rule]:
    """The rules that follow the base rule."""
    return [
        Rule("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"], ("n_symbols", "n_words")),
        Rule("shouting", lambda m: (100 * m["n_upper"] > 40 * m["word_chars"]) & (5 * m["n_exclaims"] > m["n_words"]), ("n_upper", "word_chars", "n_exclaims", "n_words")),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"]), ("word_chars", "n_words")),
        Rule("duplicate_lines", lambda m: (m["n_dup_lines"] >= 3) & (2 * m["n_dup_lines"] > m["n_lines"]), ("n_dup_lines", "n_lines")),
        Rule("digits", lambda m: 100 * m["n_digits"] > 40 * m["word_chars"], ("n_digits", "word_chars")),
        Rule("ellipses", lambda m: (m["n_ellipses"] >= 5) & (100 * m["n_ellipses"] > 10 * m["n_words"]), ("n_ellipses", "n_words")),
        Rule("bullets", lambda m: (m["n_lines"] >= 5) & (100 * m["n_bullets"] > 90 * m["n_lines"]), ("n_bullets", "n_lines")),
        Rule("few_words", lambda m: (m["n_words"] >= 100) & (100 * m["n_distinct_words"] < 5 * m["n_words"]) & (m["n_distinct_words"] < 50), ("n_distinct_words", "n_words")),
        Rule("endless_word", lambda m: m["longest_word"] > 1000, ("longest_word",)),
    ]


#: Times over that a rule is evaluated on the sample to measure its cost.
REPEATS = 4


def plan_cascade(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in their order, with cost (seconds for the sample), the share they reject of all and of the rows left.

    The sample is written once; what reaches the driver is a truth value for each of its rows and rules. An empty
    table gives every rule cost and shares 0, in the order given.
    """
    if not rules:
        return []
    picked = df.select(text_of().alias("text")).orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    sample = saved(picked.coalesce(1), "rule-sample")
    verdicts = sample.select(*[F.coalesce(once(words(), _rejection(r)), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]).collect()
    many = sample.crossJoin(F.broadcast(df.sparkSession.range(REPEATS)))  # a constant number of rows

    def seconds(hit: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count(F.when(hit, 1))).first()
        return time.perf_counter() - began

    idle = min(seconds(once(words(), lambda w: F.size(w) < F.col("id") - REPEATS)) for _ in range(3)) if verdicts else 0.0  # every rule gets the words
    cost = [max(seconds(once(words(), _rejection(r))) - idle, 1e-4) / REPEATS if verdicts else 0.0 for r in rules]
    dropped(sample)
    left, out, open_ = list(verdicts), [], list(range(len(rules)))
    while open_:
        hits = {k: sum(v[k] for v in left) for k in open_}
        k = max(open_, key=lambda k: (hits[k] / cost[k] if cost[k] else 0.0, -k))
        out.append({"rule": rules[k].name, "cost": cost[k], "rejects": sum(v[k] for v in verdicts) / len(verdicts) if verdicts else 0.0, "rejects_of_left": hits[k] / len(left) if left else 0.0})
        left = [v for v in left if not v[k]]
        open_.remove(k)
    return out


def _rejection(rule: Rule) -> Callable[[Column], Column]:
    return lambda w: rule.reject(measures(text_of(), w))


def verdict(m: dict[str, Column], rules: list[Rule], order: list[dict]) -> Column:
    """Whether no rule rejects; rules after the first that does are not evaluated."""
    by = {r.name: r for r in rules}
    passes = F.when(F.lit(False), F.lit(False))
    for x in order:
        passes = passes.when(F.coalesce(by[x["rule"]].reject(m), F.lit(False)), F.lit(False))
    return passes.otherwise(F.lit(True))


def score(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every row of docs with the measures of the base rule, base_failed and kept."""
    rules = default_rules() if rules is None else rules
    order = plan_cascade(docs, rules)

    def judged(w: Column) -> Column:
        made = measures(text_of(), w)
        base = F.struct(*[made[k].alias(k) for k in MEASURES])

        def rest(b: Column) -> Column:
            m = made | {k: b[k] for k in MEASURES}
            failed = base_fails(m)
            return F.struct(*[b[k].alias(k) for k in MEASURES], failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(m, rules, order)).alias("kept"))

        return once(base, rest)

    found = [*MEASURES, "base_failed", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in found]
    judged_ = docs.select(*own, once(words(), judged).alias("_judged"))
    return judged_.select(*own, *[F.col("_judged")[k].alias(k) for k in found])


def keep(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs.

    The base rule's cheap half comes first, then the cascade, then its costly half; a measure is only
    computed where a rule that reads it is reached.
    """
    rules = default_rules() if rules is None else rules
    order = plan_cascade(docs, rules)

    def passes(w: Column) -> Column:
        m = measures(text_of(), w)
        return F.when(m["n_words"] < 50, False).when(~verdict(m, rules, order), False).otherwise(~base_fails(m))

    return docs.where(once(words(), passes))
