"""Quality rules: a threshold table compiled into one Spark projection.

Native: every measure and every verdict is a built-in expression; there is no user function.

Defined cases: null text counts as empty and fails the base rules; an empty table gives an empty
result; repeated rows are judged one by one; very long texts are counted exactly, and need memory for
their own words only; measures equal to a threshold pass.
The input's own columns stay in ``judge()``; its results replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that it for on with as was be by this are from at an or not he "
    "der die das und den von zu mit für des sich nicht auf dem ist im ein eine als auch "
    "de la le et les en du un pour que une est qui dans par sur au pas avec il "
    "el las los y del se no por con para su es una al lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= measure <= high``; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table of the method's verdict.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("exclamation_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeat_words(found: Column) -> Column:
    """Words covered by windows of three words that occur twice or more in the array ``found``.

    Each window becomes one long: a hash in the high bits and its position in as many low bits as
    the array needs. Sorting brings equal windows together, so the work is n log n and not n squared.
    Of the windows whose hash another has, the words themselves are sorted and compared.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("long")))
        key = lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits), bits).bitwiseOR(i.cast("long"))
        spans = let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key)), lambda s: alike(s, bits))
        whole = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.cast("long").alias("i"))
        same = let(F.sort_array(F.transform(spans, lambda i: whole(i.cast("int")))), repeated)
        return F.when(n >= 3, let(same, covered)).otherwise(F.lit(0).cast("long"))

    def either(s: Column, equal) -> Column:
        """The elements that are equal to the one before or after."""
        return F.filter(s, lambda x, i: F.coalesce(equal(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(equal(x, F.get(s, i - 1)), F.lit(False)))

    def alike(s: Column, bits: Column) -> Column:
        high = lambda x: F.call_function("shiftright", x, bits)
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.transform(either(s, lambda x, y: high(x) == high(y)), lambda x: x.bitwiseAND(mask))

    def repeated(s: Column) -> Column:
        return F.sort_array(F.transform(either(s, lambda x, y: x["w"] == y["w"]), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))
        return F.aggregate(F.transform(p, step), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(found, windows)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios that rules can name."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Two projections: the words are split once and then used by every measure.
    df = docs.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_exclamations": F.regexp_count(body, F.lit("!")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    }).drop("_words", "_lines")
    per_word = lambda x: F.col(x) / F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "exclamation_ratio": per_word("n_exclamations"),
        "stop_word_ratio": per_word("n_stop_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    })


def failures(rules: tuple[Rule, ...] = RULES) -> Column:
    """The array of the measures whose rule a document fails."""
    sides = []
    for r in rules:
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            inside = inside & (F.col(r.measure) <= F.lit(r.high))
        sides.append(F.when(~inside, F.lit(r.measure)))
    return F.array_compact(F.array(*sides)) if sides else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with all measures, ``failed_rules``, ``base_failed`` and ``kept``."""
    df = measure(docs, text).withColumn("failed_rules", failures(rules))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, in their own columns."""
    return judge(docs.withColumns({f"_in_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})).where("kept").select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for ``query()``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratios = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "exclamation_ratio": "n_exclamations / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    fails = ", ".join("case when not (" + " and ".join([f"{ratios[r.measure]} >= {r.low}"] * (r.low is not None) + [f"{ratios[r.measure]} <= {r.high}"] * (r.high is not None)) + f") then '{r.measure}' end" for r in RULES)
    return rf"""
with t as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from {docs}),
win as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from t)),
rep as (select rid, i from (select *, count(*) over (partition by rid, a, b, c) as n from win) where n > 1),
cov as (select rid, count(distinct i + k) as n from rep, (select unnest([0, 1, 2]) as k) group by rid),
m as (
  select t.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as n_symbols,
         length(body) - length(replace(body, '!', '')) as n_exclamations,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
         len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words,
         coalesce(cov.n, 0) as n_repeat_words
  from t left join cov using (rid)),
j as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
             array_to_string(list_filter([{fails}], lambda x: x is not null), ',') as failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and failed_rules = '' as kept, failed_rules from j"""
