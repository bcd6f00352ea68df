"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects texts whose ratio is over a cutoff. Labelled documents are a holdout: for each
stratum and rule the cutoffs are tried from the most lenient on, and one is certified if the
exact binomial probability of so few rejections among the good documents, were the true rate of
false rejection the rule's share of `risk`, is at most delta. Cutoffs of a rule are tested in this
fixed sequence up to the first that fails. All strata together are tested like one more stratum,
the pool, and delta is shared out over these and the rules (Bonferroni). So with probability
1 - alpha no certified cutoff rejects more than risk / 5 of the good documents of its stratum or
of the pool, and all five rules together no more than `risk`. A stratum too small to certify any
cutoff of a rule backs off to the pool's cutoffs; then the bound is the pool's.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import column, cut

SYMBOLS = "#*$%&|<>"
#: Rules: name, ratio, cutoffs from lenient to strict.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01)),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("shouting", "n_capitals / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("long_words", "word_chars / greatest(n_words, 1)", (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5)),
)
#: Strata: these languages, and all others together.
STRATA = ("de", "en", "es", "fr")
POOL = "pool"
MIN_WORDS, MAX_REPEATS = 50, 0.5


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: T.word_chars(line) > 0)
    wide = docs.withColumns({"__w": T.words(text), "__lines": lines})
    # a window's words as one hash; the last two positions start no window
    grams = F.slice(F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2))), 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    wide = wide.withColumn("__g", grams)
    twice = F.size(F.array_distinct("__g")) < F.size("__g")
    wide = wide.withColumn("__p", F.when(twice, F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, k, d: p["h"] == F.get("__p", k + d)["h"]
    at = F.transform("__p", lambda p, k: F.when(F.coalesce(same(p, k, -1), F.lit(False)) | F.coalesce(same(p, k, 1), F.lit(False)), p["i"]))
    wide = wide.withColumn("__q", F.sort_array(F.filter(at, lambda i: i.isNotNull())))
    cover = F.transform("__q", lambda q, k: F.least(F.lit(3), F.coalesce(F.get("__q", k + 1) - q, F.lit(3))))
    return wide.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": T.word_chars(text),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_capitals": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        }
    ).drop("__w", "__lines", "__g", "__p", "__q")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly; 1 where k is at least n p."""
    log_top = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j))
    top = F.when(k > 0, log_top).otherwise(0.0) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))

    def lower(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i) / (n - k + 1 + i) * odds
        return F.struct((a["s"] + t).alias("s"), t.alias("t"))

    ratio = F.when(k > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), start, lower)["s"]).otherwise(1.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top + F.log(ratio)))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def certified(labelled: DataFrame, risk: float, alpha: float) -> dict[tuple[str, str], float]:
    """A certified cutoff for each (stratum, rule) that has a useful one. risk is that of one rule.

    labelled: measured documents with stratum and good (boolean). Of the certified cutoffs the
    one is taken whose share of rejected bad documents most exceeds ten times that of good ones.
    Where a stratum certifies none it is taken from the pool's, by the pool's shares, among those
    that reject at most `risk` of the stratum's own good documents; there must be some of these.
    """
    over = [(name, k, c, F.expr(ratio) > c) for name, ratio, cutoffs in RULES for k, c in enumerate(cutoffs)]
    counts = [F.sum((hit & (F.col("good") == want)).cast("long")).alias(f"{name}_{k}_{want}") for name, k, _, hit in over for want in (True, False)]
    table = labelled.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"), F.sum((~F.col("good")).cast("long")).alias("m"), *counts)
    whole = table.groupBy(F.lit(POOL).alias("stratum")).agg(*[F.sum(c).alias(c) for c in table.columns[1:]])
    tests = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{name}_{k}_True").alias("k"), F.col(f"{name}_{k}_False").alias("b")) for name, k, c, _ in over])
    tests = cut(table.unionByName(whole)).select("stratum", "n", "m", F.inline(tests))
    delta = alpha / (len(RULES) * (len(STRATA) + 2))
    gain = F.col("b") / F.greatest("m", F.lit(1)) - 10 * F.col("k") / F.greatest("n", F.lit(1))
    holds = binomial_tail(F.col("n"), F.col("k"), risk) <= delta
    steps = defaultdict(list)
    for r in tests.withColumns({"holds": holds, "gain": gain}).orderBy("stratum", "rule", "step").collect():  # one for each stratum and cutoff
        steps[r.stratum, r.rule].append(r)
    out = {}
    for (where, rule), own in steps.items():
        if where == POOL:
            continue
        passed = list(takewhile(lambda r: r.holds, own))
        if not passed and own[0].n:
            shared = takewhile(lambda r: r.holds, steps[POOL, rule])
            passed = [p for p, r in zip(shared, own) if r.k <= risk * r.n]
        useful = [r for r in passed if r.gain > 0]
        if useful:
            out[where, rule] = max(useful, key=lambda r: (r.gain, -r.step)).cutoff
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", risk: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, th) for each document.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. kept is false
    then, or if a certified cutoff of the document's stratum is exceeded. labels (doc_id,
    quality): rows with quality 1 are the good holdout, those with 0 the bad one; null ids and
    labels are left out, and of repeated ids each row counts. With probability 1 - alpha the
    cutoffs of all rules together reject at most `risk` of a stratum's good documents that pass
    the base rule, or of the pool's where a stratum uses its cutoffs. A null text has no words; a
    null language is in the stratum "other". A stratum without good labels, or with too few in
    all strata together, has no cutoff, and only the base rule rejects. Repeated rows each give a
    row. th tells rows apart by text and language. Other columns are ignored.
    """
    source = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("__text"), column(lang_col).alias("__lang"), F.xxhash64(text_col, lang_col).alias("th"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))
    rows = cut(measured(source, "__text").withColumns({"stratum": stratum(F.col("__lang")), "base_failed": base}).drop("__text", "__lang"))
    marks = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    limits = certified(rows.where("not base_failed").join(marks, "doc_id"), risk / len(RULES), alpha)
    over = F.lit(False)
    for (where, rule), cutoff in sorted(limits.items()):
        ratio = next(r for name, r, _ in RULES if name == rule)
        over = over | ((F.col("stratum") == where) & (F.expr(ratio) > cutoff))
    return rows.withColumn("kept", ~F.col("base_failed") & ~over)
