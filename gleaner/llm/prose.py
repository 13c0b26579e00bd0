"""Problem 1: per-document text statistics, and learned rules that tell prose from lists, tables and junk.

The statistics are native expressions over the lines of a text. An ordered rule list is induced on labelled documents
(labelled.py, a bounded set) by incremental reduced-error pruning: rules are grown on two thirds by information gain and
pruned on one third, until a new rule is no better than chance. The list is exported as one SQL CASE expression over the
statistics and applied natively, so no text leaves the JVM.

Null texts have null statistics and are no cases; empty and blank texts have zeros. Texts under MIN_CHARS are no cases.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.labelled import documents
from gleaner.llm.tables import flat_samples

MIN_CHARS = 40
#: A line is written like prose if at least this share of its words is common.
PROSE_LINE = 0.1
#: Common function words of the five languages; single characters in Chinese.
COMMON = {
    "en": "the a an and or but of to in on at by for from with without as is are was were be been it its this that these those each every one not no if when while because so than then there which who what how we you i they he she his her their our my can will would do does did has have had before after about into up out all some any more most only once until since both such other than very please am should could something anything else me again whether where".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine in im an am auf aus bei mit nach von vom zu zum zur für über unter vor hinter neben ist sind war waren wird werden wurde es er sie wir ich man dass wenn weil während damit bis als wie was welche wer so auch nur noch schon sich sein hat haben kann dieser diese dieses jede jeder beide denn ohne trotz laut".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas non que qu qui quand comment pourquoi si car donc dans sur sous avec sans pour par en au aux à est sont était a ont il elle nous vous je on ce cet cette ces se sa son ses leur plus même tandis avant après chez y c s n j m t".split(),
    "es": "el la los las un una unos unas y o pero no ni que qué quien cuando cómo como por para con sin en de del al a se su sus lo le es son era fue ha han hay está si porque mientras antes después según durante este esta esto ese esa cada más muy ya también nos me mi tu dice entre sobre cuándo cuál puede pasa sea algo así tras otra otro".split(),
    "zh": list("了这那每个在是把和就才只会能与也还而从当如果因为所以我们你他她它不没有都很被让于一么什怎请说个有着些以"),
}
FEATURES = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "odd_ratio", "stop_share", "common_share", "prose_share", "separators", "bullet_share", "single_share", "sentence_rate", "distinct_share")


#: What each statistic needs to be summed over the lines.
_SUMS = {
    "words": {"words"}, "mean_word_length": {"letters", "words"}, "stop_share": {"stop", "chars"}, "common_share": {"common", "words"}, "prose_share": {"prose", "chars"},
    "separators": {"words"}, "bullet_share": {"bullet", "chars"}, "single_share": {"single", "words"}, "sentence_rate": {"words"}, "distinct_share": {"words"},
}


def statistics(text: Column, fields: tuple[str, ...] = FEATURES) -> Column:
    """Struct of statistics of a text: n_chars and those of FEATURES that are asked for. Shares of lines are weighted
    with their characters. Null for null."""
    common = sorted({w for ws in COMMON.values() for w in ws})
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    words_of = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"(\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+)"))
    number = lambda c: c.cast("double")
    n_common = lambda w: number(F.size(F.filter(w, lambda x: x.isin(common))))
    parts = {
        "chars": lambda x, w: number(F.length(x)),
        "words": lambda x, w: number(F.size(w)),
        "common": lambda x, w: n_common(w),
        "single": lambda x, w: number(F.size(F.filter(w, lambda y: (F.length(y) == 1) & ~y.rlike(r"\p{IsHan}")))),
        "letters": lambda x, w: number(F.aggregate(w, F.lit(0), lambda n, y: n + F.length(y))),
        "stop": lambda x, w: F.when(x.rlike(r"[.!?。！？…:：;][\"'”’»)*_\s]*$"), number(F.length(x))).otherwise(0.0),
        "bullet": lambda x, w: F.when(x.rlike(r"^\s*([-*•·+]|\d{1,3}[.)、])\s"), number(F.length(x))).otherwise(0.0),
        "prose": lambda x, w: F.when((n_common(w) >= PROSE_LINE * F.size(w)) & (F.size(w) > 0), number(F.length(x))).otherwise(0.0),
    }
    sums = [k for k in parts if any(k in _SUMS.get(f, ()) for f in fields)]
    measured = F.transform(F.transform(lines, lambda x: F.struct(x.alias("x"), words_of(x).alias("w"))), lambda s: F.struct(*[parts[k](s["x"], s["w"]).alias(k) for k in sums]))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in sums])
    total = F.aggregate(measured, zero, lambda t, s: F.struct(*[(t[k] + s[k]).alias(k) for k in sums])) if sums else None
    left = lambda keep: F.length(F.regexp_replace(text, keep, ""))
    size = number(F.length(text))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    ratio = {
        "mean_word_length": ("letters", "words"), "stop_share": ("stop", "chars"), "common_share": ("common", "words"), "prose_share": ("prose", "chars"),
        "bullet_share": ("bullet", "chars"), "single_share": ("single", "words"),
    }

    def finish(t: Column) -> Column:
        made = {
            "words": lambda: t["words"],
            "symbol_ratio": lambda: per(left(r"[\p{L}\p{M}\p{N}\s]+"), size),
            "digit_ratio": lambda: per(left(r"[^\p{Nd}]+"), size),
            "odd_ratio": lambda: per(left(r"[^\x{80}-\x{9f}\x{a1}-\x{bf}\x{fffd}\x{2500}-\x{25ff}]+"), size),
            "separators": lambda: per(left(r"[^,;|/\t、]+"), t["words"]),
            "sentence_rate": lambda: per(F.size(F.regexp_extract_all(text, F.lit(r"([.!?](?=\s|$)|[。！？])"))) * 1.0, t["words"]),
            "distinct_share": lambda: per(F.size(F.array_distinct(words_of(text))) * 1.0, t["words"]),
        } | {k: (lambda a=a, b=b: per(t[a], t[b])) for k, (a, b) in ratio.items()}
        return F.struct(F.length(text).alias("n_chars"), *[made[f]().alias(f) for f in fields])

    # The sums are bound once: an expression used in several fields would be computed for each.
    out = F.transform(F.array(total), finish)[0] if sums else finish(F.lit(None))
    return F.when(text.isNotNull(), out)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, FEATURES.index(self.feature)]
        return values <= self.threshold if self.at_most else values >= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), bool)


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        best, best_gain = None, 1e-9
        for j, feature in enumerate(FEATURES):
            values = x[inside, j]
            order = np.argsort(values, kind="stable")
            v, positive = values[order], y[inside][order]
            ups = np.cumsum(positive)
            for i in np.flatnonzero(v[1:] > v[:-1]):
                middle = float((v[i] + v[i + 1]) / 2)
                for at_most, p, size in ((True, ups[i], i + 1), (False, p0 - ups[i], len(v) - i - 1)):
                    if p:
                        gain = p * (np.log2(p / size) - np.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = Condition(feature, at_most, round(middle, 6)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def tightest(rule: Rule) -> Rule:
    """The rule with one condition per statistic and direction, the tightest, which holds for the same documents."""
    best: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        old = best.get((c.feature, c.at_most))
        if old is None or (c.threshold < old.threshold) == c.at_most:
            best[c.feature, c.at_most] = c
    return tuple(best.values())


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that is worth most on held-out documents, and its share of right cases."""
    best, best_worth, right = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        inside = covers(rule[:k], x)
        p, n = y[inside].sum(), (~y[inside]).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best_worth:
            best, best_worth, right = rule[:k], worth, p / max(1, p + n)
    return best, right


def induce(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """Ordered rules for the positive class, by incremental reduced-error pruning."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(y), bool)
    while y[left].any():
        at = rng.permutation(np.flatnonzero(left))
        grow, held = at[: len(at) * 2 // 3], at[len(at) * 2 // 3 :]
        rule = _grow(x[grow], y[grow])
        if not rule:
            break
        rule, right = _prune(rule, x[held], y[held])
        if right < 0.5:
            break
        inside = covers(rule, x) & left
        if not inside.any():
            break
        rules.append(tightest(rule))
        left &= ~inside
    return rules


def to_case(rules: list[Rule]) -> str:
    """The rule list as a SQL CASE: the number of the first rule that holds, from 1; 0 for prose."""
    arms = [f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)]
    return f"CASE {' '.join(arms)} ELSE 0 END" if arms else "0"


def labelled_statistics(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the labelled documents (at most DOCUMENTS rows)."""
    rows = [(i, t, y) for i, (t, y) in enumerate(documents())]
    df = spark.createDataFrame(rows, "i int, t string, y boolean").withColumn("s", statistics(F.col("t")))
    got = df.select("i", "y", *[f"s.{f}" for f in FEATURES]).orderBy("i").collect()
    return np.array([r[2:] for r in got], dtype=float), np.array([r[1] for r in got])


@lru_cache(maxsize=1)
def _rules(spark: SparkSession) -> tuple[Rule, ...]:
    return tuple(induce(*labelled_statistics(spark)))


def judged(df: DataFrame, text: str, spark: SparkSession) -> DataFrame:
    """df with struct s of the statistics the rules use and rule, the rule that calls it no prose (0: prose)."""
    rules = list(_rules(spark))
    case, used = to_case(rules), tuple(f for f in FEATURES if any(c.feature == f for rule in rules for c in rule))
    for f in used:
        case = case.replace(f"{f} <=", f"s.{f} <=").replace(f"{f} >=", f"s.{f} >=")
    return df.withColumn("s", statistics(F.col(text), used)).withColumn("rule", F.when(F.col("s.n_chars") >= MIN_CHARS, F.expr(case)).otherwise(0))


def found(spark: SparkSession, root: str) -> DataFrame:
    """p1_found: flat samples whose output is for the most part a list, a table or junk."""
    rows = flat_samples(spark, root, "id", "output").filter(F.length("output") >= MIN_CHARS)
    return judged(rows, "output", spark).filter("rule > 0").select("id").distinct()


def sample_statistics(spark: SparkSession, root: str) -> DataFrame:
    """p1_statistics: statistics of output and instruction of every flat sample, once per id."""
    rows = flat_samples(spark, root, "id", "instruction", "output").withColumns({"o": statistics(F.col("output")), "i": statistics(F.col("instruction"))})
    fields = ("n_chars", *FEATURES)
    out = rows.select("id", *[F.col(f"o.{f}").alias(f"output_{f}") for f in fields], *[F.col(f"i.{f}").alias(f"instruction_{f}") for f in fields])
    return out.dropDuplicates(["id"])


QUERIES = {"p1_found": found, "p1_statistics": sample_statistics}
ORACLE_SQL: dict[str, str] = {}
