"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule compares two counts of a text. Its cutoff is chosen for every stratum (language) from labelled texts: a cutoff
is certified when the exact binomial test rejects "the rule turns away at least ``risk`` of good texts", that is, when
P(Bin(n, risk) <= k) is at most the level, for n good labelled texts of which it turns away k. Cutoffs are tested from the
mildest on and the first failure ends a rule's sequence, so a sequence needs no correction; the level is split over all
(stratum, rule) sequences (Bonferroni), of which the pool of all strata has its own. The strictest certified cutoff holds.
Where a stratum's own labels certify none, that of the pool holds; where the pool has none either, the rule turns nothing away.
With R rules of risk r each, at most R * r of the good texts of a stratum with its own cutoffs are turned away, and of all
good texts together where the pool's hold, with probability 1 - ``delta``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, write_shared

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Turns a text away when ``scale * top > cutoff * base`` (``above``) or ``<`` (not ``above``); cutoffs from mild to strict."""

    name: str
    top: str
    base: str
    scale: int
    above: bool
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", 100, True, (200, 150, 100, 75, 50, 40, 30, 20, 15, 10, 5)),
    Rule("dup_lines", "n_dup_lines", "n_words", 1000, True, (100, 75, 50, 40, 30, 20, 15, 10, 5)),
    Rule("repeats", "n_repeat_words", "n_words", 100, True, (45, 40, 35, 30, 25, 20, 15, 10, 5)),
    Rule("long_words", "word_chars", "n_words", 10, True, (200, 150, 120, 100, 90, 80, 70)),
    Rule("short_words", "word_chars", "n_words", 10, False, (15, 20, 25, 30, 35, 40)),
)
RISK, DELTA = 0.02, 0.05
#: Stratum of all labelled texts together. Other strata are named "=" and their value, or "" for null.
POOL = "*"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows found twice or more: sort the windows, keep the positions of equal neighbours, sum the cover."""
    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")))
    equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))

    def found(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1)))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(F.sort_array(windows), lambda s: _let(found(s), cover))


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of whole texts (null: no word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(k) for k in keep], text.alias("text"))
    trimmed = F.trim(F.col("text"), F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    counts = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words")))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dups = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    rows = rows.select(
        "doc_id", *keep, counts.alias("c"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), dups.alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *keep, "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words").withColumn("base_failed", failed)


def _hit(rule: Rule, cutoff) -> Column:
    left, right = rule.scale * F.col(rule.top), cutoff * F.col(rule.base)
    return left > right if rule.above else left < right


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from logarithms of the terms."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.exp(n * F.log1p(F.lit(-p))).alias("s"))
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.when(k < 1, start["s"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["s"]))


def certified_cutoffs(good: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Statistics of good labelled texts with ``stratum`` -> one row ``stratum, <rule>...`` of certified cutoffs (null: none), the pool's among them."""
    counts = good.rollup("stratum").agg(F.count("*").alias("n"), *[F.sum(_hit(r, c).cast("long")).alias(f"{r.name}_{c}") for r in rules for c in r.cutoffs])
    counts = counts.withColumn("stratum", F.coalesce("stratum", F.lit(POOL)))
    tests = [F.struct(F.lit(r.name).alias("rule"), F.lit(j).alias("place"), F.lit(c).alias("cutoff"), F.col(f"{r.name}_{c}").alias("k")) for r in rules for j, c in enumerate(r.cutoffs)]
    long = counts.select("stratum", "n", F.explode(F.array(*tests)).alias("t")).select("stratum", "n", "t.*").withColumn("all", F.lit(0))
    strata = counts.agg(F.count("*").alias("strata")).withColumn("all", F.lit(0))
    # more than n * risk turned away is never certified; the test is spared then
    passed = (F.col("k") <= risk * F.col("n")) & (binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(delta) / (F.col("strata") * len(rules)))
    judged = long.join(F.broadcast(strata), "all").withColumn("passed", passed)  # one row
    first_bad = judged.groupBy("stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("passed"), F.col("place"))), F.lit(1 << 30)).alias("bad"), F.collect_list(F.struct("place", "cutoff")).alias("all"))
    best = first_bad.select("stratum", "rule", F.array_max(F.filter("all", lambda x: x["place"] < F.col("bad")))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", [r.name for r in rules]).agg(F.first("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """Statistics and verdict of every whole text, one row per input row.

    -> ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``reason``, the first
    rule that turned the text away (null if kept). All good labelled texts (quality 1) that pass the base rules are the
    holdout: cutoffs are drawn from a fixed grid, so nothing is fitted elsewhere. A null stratum is one of its own, beside the empty
    one; a stratum without enough labels takes the pool's cutoffs. Null texts have no word and fail the base rule. Null ids and repeated
    rows are kept; repeated labels of an id count once, and ids with two different labels not at all. An empty table gives
    an empty result.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")) if stratum in docs.columns else F.lit("")
    named = docs.select("doc_id", "text", name.alias("stratum"))
    stats = write_shared(base_statistics(named, "stratum"), "rule-statistics")
    good = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1")
    cutoffs = write_shared(certified_cutoffs(stats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), rules, risk, delta), "rule-cutoffs")
    small = cutoffs.count() <= BROADCAST_ROWS
    pool = cutoffs.where(F.col("stratum") == POOL).select(F.lit(0).alias("all"), *[F.col(r.name).alias(f"pool_{r.name}") for r in rules])  # one row
    judged = stats.join(F.broadcast(cutoffs) if small else cutoffs, "stratum", "left").withColumn("all", F.lit(0)).join(F.broadcast(pool), "all", "left")
    reason = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *[F.when(_hit(r, F.coalesce(r.name, f"pool_{r.name}")), F.lit(r.name)) for r in rules])
    return judged.withColumn("reason", reason).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), "reason"
    )


def oracle(rules: tuple[Rule, ...] = RULES, risk: float = RISK, delta: float = DELTA) -> str:
    """The query over whole tables in DuckDB SQL; windows are compared as text, tails come from lgamma."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    op = lambda r: ">" if r.above else "<"
    grid = ", ".join(f"('{r.name}', {j}, {c})" for r in rules for j, c in enumerate(r.cutoffs))
    hit = " ".join(f"WHEN g.rule = '{r.name}' THEN {r.scale} * s.{r.top} {op(r)} g.cutoff * s.{r.base}" for r in rules)
    picked = ", ".join(f"max(CASE WHEN rule = '{r.name}' THEN cutoff END) AS {r.name}" for r in rules)
    pools = ", ".join(f"max(CASE WHEN stratum = '{POOL}' THEN {r.name} END) AS {r.name}" for r in rules)
    reasons = " ".join(f"WHEN s.{r.top} * {r.scale} {op(r)} coalesce(c.{r.name}, q.{r.name}) * s.{r.base} THEN '{r.name}'" for r in rules)
    return f"""
    WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, {spaces}, '')) > 0) AS lines FROM t),
    win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
    s0 AS (SELECT w.doc_id, stratum, len(words) AS n_words, length(translate(text, {spaces}, '')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
    s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s0),
    good AS (SELECT s.* FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1)),
    grid(rule, place, cutoff) AS (VALUES {grid}),
    pooled AS (SELECT * FROM good UNION ALL SELECT * REPLACE ('{POOL}' AS stratum) FROM good),
    k AS (SELECT s.stratum, g.rule, g.place, g.cutoff, count(*) AS n, count(*) FILTER (WHERE CASE {hit} END) AS k FROM pooled s, grid g GROUP BY ALL),
    p AS (SELECT *, (SELECT sum(exp(lgamma(k.n + 1) - lgamma(i + 1) - lgamma(k.n - i + 1) + i * ln({risk}) + (k.n - i) * ln(1 - {risk}))) FROM unnest(range(0, k.k + 1)) AS u(i)) AS tail FROM k),
    ok AS (SELECT *, tail <= {delta} / ((SELECT count(DISTINCT stratum) FROM pooled) * {len(rules)}) AND k <= {risk} * n AS passed FROM p),
    best AS (SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM ok o
        WHERE place < coalesce((SELECT min(place) FROM ok b WHERE b.stratum = o.stratum AND b.rule = o.rule AND NOT b.passed), 1000000) GROUP BY stratum, rule),
    c AS (SELECT stratum, {picked} FROM best GROUP BY stratum),
    q AS (SELECT {pools} FROM c),
    r AS (SELECT s.*, CASE WHEN base_failed THEN 'base' {reasons} END AS reason FROM s LEFT JOIN c USING (stratum), q)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM r"""
