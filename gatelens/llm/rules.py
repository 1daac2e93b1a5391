"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule's cost and rejection rate are estimated on a bounded sample; the
cascade then tries the rules, the base ones among them, by rejections per
second, and a row that one rule rejects isn't put to the rules after it. Rules
on counts that every row has anyway cost next to nothing, those that search the
text again cost the search.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLANKS = " \t\n\x0b\x0c\r"
SAMPLE_ROWS = 2_000
REPEATS = 5
#: Costs in seconds a sample row are told apart from this one on.
LEAST_COST = 1e-7
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where the SQL condition on the features or on the text (column ``text``) holds."""

    name: str
    rejects: str


#: The first two are the base rules; the others are the method's.
BASE = (Rule("few_words", "n_words < 20"), Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"))
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("capitals", r"2 * regexp_count(text, '\\p{Lu}') > word_chars"),
    Rule("digits", "2 * regexp_count(text, '[0-9]') > word_chars"),
    Rule("letters", r"3 * regexp_count(text, '\\p{L}') < word_chars"),
)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Only arrays with an equal pair are
    sorted; the words under the hits are then counted from one hit to the next.
    """

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))

    def hits(s: Column) -> Column:
        same = lambda x, y: F.coalesce(F.get(s, y)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        some = let(placed, lambda s: let(F.sort_array(hits(s)), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), some).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > window, let(hashes(words), count)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """keep, the text and its features; a null text has no words and no lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*keep, text.alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumns({"__words": split, "__lines": lines})
    return df.select(
        *[c for c in df.columns if c not in ("__words", "__lines")],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
    )


def costs(sample: DataFrame, rules: tuple[Rule, ...], repeats: int = REPEATS) -> dict[str, tuple[float, float]]:
    """Each rule's seconds and rejections, both a row of the sample.

    A rule's cost is its least time of several runs, less that of a rule that
    looks at nothing, so that what else a machine does in between counts little.
    """
    sample = sample.cache()  # a bounded sample; the rules alone are measured, not its reading
    total = max(sample.count(), 1)

    def run(condition: str) -> tuple[float, int]:
        began = time.perf_counter()
        n = sample.agg(F.count_if(F.expr(condition))).first()[0]
        return time.perf_counter() - began, n

    every = {"": "text is null", **{r.name: r.rejects for r in rules}}
    for condition in every.values():  # the first run also compiles
        run(condition)
    took = [{name: run(condition) for name, condition in every.items()} for _ in range(repeats)]
    sample.unpersist()
    least = {name: min(t[name][0] for t in took) for name in every}
    return {r.name: (max((least[r.name] - least[""]) / total, LEAST_COST), took[0][r.name][1] / total) for r in rules}


def order_rules(sample: DataFrame, rules: tuple[Rule, ...], repeats: int = REPEATS) -> list[Rule]:
    """The rules by rejections per second on the sample; of equal ones the cheaper first, then by name."""
    found = costs(sample, rules, repeats)
    return sorted(rules, key=lambda r: (-found[r.name][1] / found[r.name][0], found[r.name][0], r.name))


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a later rule is evaluated only where all before it let pass."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(rule.rejects), F.lit(False)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    base_failed: one of the base rules rejects. kept: none of all rules does;
    the order that the sample of about sample_rows rows gives changes the cost
    only. A null or empty text has zero words and fails the base. A text is
    whole in one row's arrays, a few dozen bytes a word, so a task's memory
    bounds the longest text (about a twentieth of it in bytes). Rows are judged one by one, so equal rows get equal
    results; ids may be null or repeat, other columns play no part. No rows in,
    no rows out.
    """
    share = min(1.0, sample_rows / max(docs.select(F.lit(1)).count(), 1))
    sample = materialize(docs.select(F.col(text_col).alias("text")).sample(share, seed=1), "sample")
    order = order_rules(features(sample, "text"), base + rules)
    judged = features(docs, text_col, F.col(id_col).alias("doc_id"))
    failed = F.lit(False)
    for rule in base:
        failed = failed | F.expr(rule.rejects)
    return judged.withColumns({"base_failed": failed, "kept": cascade(order)}).drop("text")


#: The same in DuckDB's SQL; the verdict doesn't depend on the rules' order.
SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
d as (select row_number() over () as r, * from t),
win as (select r, i, list_slice(w, i, i + 7) as s from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8)),
hit as (select r, i from (select r, i, count(*) over (partition by r, s) as n from win) where n > 1),
cover as (select r, sum(least(8, coalesce(nxt - i, 8)))::bigint as n from (select r, i, lead(i) over (partition by r order by i) as nxt from hit) group by r),
f as (select doc_id, text, len(w)::bigint as n_words,
 length(list_aggregate(w, 'string_agg', ''))::bigint as chars,
 len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
 coalesce(cover.n, 0)::bigint as n_repeat_words
 from d left join cover using (r)),
g as (select doc_id, text, n_words, coalesce(chars, 0)::bigint as word_chars, n_symbols,
 (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_repeat_words,
 (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_words
 or word_chars < 2 * n_words or word_chars > 20 * n_words
 or 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
 or 2 * len(regexp_extract_all(text, '[0-9]')) > word_chars
 or 3 * len(regexp_extract_all(text, '\p{L}')) < word_chars) as kept
from g
"""
