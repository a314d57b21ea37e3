"""Text analysis as Spark columns, with the same rules for a driver-side term and as SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import STEP2, STEP3, STEP4, STOP_WORDS

CAMEL = "([a-z])([A-Z])"
RAW = "[a-zA-Z0-9]+(?:[-_][a-zA-Z0-9]+)*"


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms."""

    remove_stop_words: bool = True
    stem: bool = True
    split_camel_case: bool = True
    min_token_length: int = 1
    custom_stop_words: frozenset[str] | None = None

    @property
    def stop_words(self) -> frozenset[str]:
        return STOP_WORDS if self.custom_stop_words is None else frozenset(self.custom_stop_words)

    def tokens(self, text: str | Column) -> Column:
        """Array of the surviving tokens, as written: separators always split, so tokens are runs of letters and digits."""
        text = F.col(text) if isinstance(text, str) else text
        spaced = F.regexp_replace(text, CAMEL, "$1 $2") if self.split_camel_case else text
        found = F.coalesce(F.regexp_extract_all(spaced, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.array().cast("array<string>"))
        if self.remove_stop_words and self.stop_words:
            stop = sorted(self.stop_words)
            found = F.filter(found, lambda t: ~F.lower(t).isin(stop))
        if self.min_token_length > 1:
            found = F.filter(found, lambda t: F.length(t) >= self.min_token_length)
        return found

    def term(self, word: str) -> str:
        """A query word as the index holds it: lower case and stemmed, but neither split nor stop-filtered."""
        return stem(word.lower()) if self.stem else word.lower()


# The five steps of the stemmer, for the driver.


_VOWELS = frozenset("aeiouy")


def _voiced(s: str) -> bool:
    return not _VOWELS.isdisjoint(s)


def _single(s: str) -> str:
    return s[:-1] if len(s) > 1 and s[-1] == s[-2] and s[-1] not in "aeiouy" else s


def _step1(w: str) -> str:
    for suffix, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(suffix):
            return w[: len(w) - cut]
    for suffix in ("ed", "ing"):
        rest = w[: len(w) - len(suffix)]
        if w.endswith(suffix) and _voiced(rest):
            return _single(rest)
    return w


def _replaced(w: str, rules) -> str:
    for suffix, new in rules:
        if not w.endswith(suffix):
            continue
        rest = w[: len(w) - len(suffix)]
        if _voiced(rest) and not (suffix == "ion" and (len(w) <= 4 or rest[-1] not in "st")):
            return rest + new
    return w


def _step5(w: str) -> str:
    rest = w[:-1]
    if w.endswith("e") and _voiced(rest) and (len(re.findall("[aeiouy]", rest)) > 1 or _single(rest) != rest):
        return rest
    return w


_RULES = {2: STEP2, 3: tuple((s, "") for s in STEP3), 4: tuple((s, "") for s in STEP4)}
_SUFFIXES = {k: tuple(s for s, _ in rules) for k, rules in _RULES.items()}


def stem(word: str) -> str:
    """A simplified Porter stem of one word."""
    w = word.lower().strip()
    if len(w) <= 2:
        return w
    w = _step1(w)
    for k in (2, 3, 4):
        if w.endswith(_SUFFIXES[k]):
            w = _replaced(w, _RULES[k])
    return _step5(w)


@lru_cache(maxsize=1 << 18)
def held_stem(word: str) -> str:
    """``stem``, for workers, which meet the same words in batch after batch."""
    return stem(word)


# The same steps as columns.


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _rule_column(w: Column, rules) -> Column:
    out = None
    for suffix, new in rules:
        rest = _cut(w, len(suffix))
        ok = w.endswith(suffix) & rest.rlike("[aeiouy]")
        if suffix == "ion":
            ok = ok & (F.length(w) > 4) & rest.rlike("[st]$")
        value = F.concat(rest, F.lit(new)) if new else rest
        out = F.when(ok, value) if out is None else out.when(ok, value)
    return out.otherwise(w)


def stem_step(w: Column, step: int) -> Column:
    """One step of the stemmer on a lower-case word."""
    if step in _RULES:
        return _rule_column(w, _RULES[step])
    if step == 1:
        def undoubled(x: Column) -> Column:
            return F.when(x.rlike("([^aeiouy])\\1$"), _cut(x, 1)).otherwise(x)

        ed, ing = _cut(w, 2), _cut(w, 3)
        return (
            F.when(w.endswith("sses") | w.endswith("ies"), ed).when(w.endswith("ss"), w).when(w.endswith("s"), _cut(w, 1))
            .when(w.endswith("ed") & ed.rlike("[aeiouy]"), undoubled(ed))
            .when(w.endswith("ing") & ing.rlike("[aeiouy]"), undoubled(ing)).otherwise(w)
        )
    rest = _cut(w, 1)
    many = F.regexp_count(rest, F.lit("[aeiouy]")) > 1
    return F.when(w.endswith("e") & rest.rlike("[aeiouy]") & (many | rest.rlike("([^aeiouy])\\1$")), rest).otherwise(w)


def with_stems(words: DataFrame, word: str, out: str = "term") -> DataFrame:
    """``words`` with each word's stem; a column per step keeps the plan linear in the number of rules."""
    steps = [f"__stem{k}" for k in range(6)]
    df = words.withColumn(steps[0], F.lower(word))
    for k in range(1, 6):
        df = df.withColumn(steps[k], stem_step(F.col(steps[k - 1]), k))
    return df.withColumn(out, F.when(F.length(steps[0]) <= 2, F.col(steps[0])).otherwise(F.col(steps[5]))).drop(*steps)


def token_rows(docs: DataFrame, analyzer: Analyzer, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, pos, token): surviving tokens, numbered after filtering; and the columns ``keep``."""
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, F.posexplode(analyzer.tokens(text)).alias("pos", "token"))


def token_offsets(docs: DataFrame, analyzer: Analyzer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, token, offset): as ``token_rows``, with character offsets.

    Parts of one word are taken to be one character apart, so that offsets
    after a camelCase boundary are one too high for each.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(text, F.lit(f"[^a-zA-Z0-9]*{RAW}"), F.lit(0))).alias("k", "piece"))
    ends = W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    word = F.regexp_extract("piece", f"{RAW}$", 0)
    at = raw.select("doc_id", "k", word.alias("word"), (F.sum(F.length("piece")).over(ends) - F.length(word)).alias("start"))
    every = Analyzer(False, False, analyzer.split_camel_case)
    part = at.select("doc_id", "k", "start", F.posexplode(every.tokens("word")).alias("j", "token"))
    before = W.partitionBy("doc_id", "k").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("offset", (F.col("start") + F.coalesce(F.sum(F.length("token") + 1).over(before), F.lit(0))).cast("int"))
    if analyzer.remove_stop_words:
        part = part.where(~F.lower("token").isin(sorted(analyzer.stop_words)) if analyzer.stop_words else F.lit(True))
    part = part.where(F.length("token") >= analyzer.min_token_length)
    order = W.partitionBy("doc_id").orderBy("k", "j")
    return part.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "token", "offset")


# And as SQL.


def tokens_sql(text: str, analyzer: Analyzer) -> str:
    spaced = f"regexp_replace({text}, '{CAMEL}', '\\1 \\2', 'g')" if analyzer.split_camel_case else text
    out = f"regexp_extract_all({spaced}, '[a-zA-Z0-9]+')"
    if analyzer.remove_stop_words and analyzer.stop_words:
        stop = ", ".join(f"'{w}'" for w in sorted(analyzer.stop_words))
        out = f"list_filter({out}, lambda t: lower(t) NOT IN ({stop}))"
    if analyzer.min_token_length > 1:
        out = f"list_filter({out}, lambda t: length(t) >= {analyzer.min_token_length})"
    return out


def _rest(w: str, n: int) -> str:
    return f"left({w}, greatest(length({w}) - {n}, 0))"


def _twice(x: str) -> str:
    return f"(length({x}) >= 2 AND right({x}, 1) = left(right({x}, 2), 1) AND NOT regexp_matches(right({x}, 1), '[aeiouy]'))"


def stem_step_sql(w: str, step: int) -> str:
    """The CASE expression of one step."""
    if step in _RULES:
        out = []
        for suffix, new in _RULES[step]:
            rest = _rest(w, len(suffix))
            more = f" AND length({w}) > 4 AND right({rest}, 1) IN ('s', 't')" if suffix == "ion" else ""
            out.append(f"WHEN suffix({w}, '{suffix}') AND regexp_matches({rest}, '[aeiouy]'){more} THEN {rest} || '{new}'")
        return f"CASE {' '.join(out)} ELSE {w} END"
    if step == 1:
        out = [f"WHEN suffix({w}, 'sses') OR suffix({w}, 'ies') THEN {_rest(w, 2)}", f"WHEN suffix({w}, 'ss') THEN {w}", f"WHEN suffix({w}, 's') THEN {_rest(w, 1)}"]
        for suffix in ("ed", "ing"):
            rest = _rest(w, len(suffix))
            out.append(f"WHEN suffix({w}, '{suffix}') AND regexp_matches({rest}, '[aeiouy]') THEN CASE WHEN {_twice(rest)} THEN {_rest(rest, 1)} ELSE {rest} END")
        return f"CASE {' '.join(out)} ELSE {w} END"
    rest = _rest(w, 1)
    many = f"len(regexp_extract_all({rest}, '[aeiouy]')) > 1"
    return f"CASE WHEN suffix({w}, 'e') AND regexp_matches({rest}, '[aeiouy]') AND ({many} OR {_twice(rest)}) THEN {rest} ELSE {w} END"


def stems_sql(source: str, word: str = "token") -> str:
    """Query of (word, s0 .. s5, term) over a query that gives distinct words."""
    q = f"SELECT {word}, lower({word}) AS s0 FROM ({source})"
    for k in range(1, 6):
        q = f"SELECT *, {stem_step_sql(f's{k - 1}', k)} AS s{k} FROM ({q})"
    return f"SELECT *, CASE WHEN length(s0) <= 2 THEN s0 ELSE s5 END AS term FROM ({q})"
