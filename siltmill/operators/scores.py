"""Scores of single answers as columns, and their aggregates."""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.text import words
from .sampling import hash_share


def golds(choices: Column, gold_index: Column) -> Column:
    return F.filter(F.transform(gold_index, lambda i: F.get(choices, i)), lambda c: c.isNotNull())


def best_pair(first: Column, second: Column, score) -> Column:
    """The highest score of any pair of elements; null where there is no pair."""
    return F.array_max(F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: score(a, b)))))


def exact_match(gold: Column, prediction: Column, how: str = "full") -> Column:
    """1 if the trimmed prediction is, begins or ends with the trimmed gold; an empty prediction is 0."""
    g, p = F.trim(gold), F.trim(prediction)
    test = {"full": g == p, "prefix": F.startswith(p, g), "suffix": F.endswith(p, g)}[how]
    return F.when((prediction != "") & test, 1).otherwise(0)


def bag_f1(gold: Column, prediction: Column) -> Column:
    """F1 of the two sets of words."""
    a, b = F.array_distinct(words(gold)), F.array_distinct(words(prediction))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def best_choice(scores: Column) -> Column:
    """Index of the highest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def choice_accuracy(scores: Column, gold_index: Column) -> Column:
    return F.array_contains(gold_index, best_choice(scores)).cast("int")


def by_characters(logprobs: Column, choices: Column, skip_blank: bool = False) -> Column:
    """Log-probabilities for each character of the choice."""
    size = lambda c: F.length(c) - F.when(F.lit(skip_blank) & F.startswith(c, F.lit(" ")), 1).otherwise(0)
    return F.zip_with(logprobs, choices, lambda p, c: F.try_divide(p, size(c).cast("double")))


def by_tokens(logprobs: Column, tokens: Column) -> Column:
    return F.zip_with(logprobs, tokens, lambda p, t: F.try_divide(p, F.size(t).cast("double")))


def by_prior(logprobs: Column, unconditioned: Column) -> Column:
    return F.zip_with(logprobs, unconditioned, lambda p, q: p - q)


def gold_probability(logprobs: Column, gold_index: Column) -> Column:
    """Share of the best gold choice in the summed probabilities."""
    p = F.transform(logprobs, lambda x: F.exp(x))
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return F.try_divide(F.array_max(F.transform(gold_index, lambda i: F.get(p, i))), total)


def reciprocal_rank(scores: Column, gold_index: Column) -> Column:
    """1 by the best rank of a gold choice; equal scores share the best rank."""
    ranks = F.transform(gold_index, lambda i: F.size(F.filter(scores, lambda s: s > F.get(scores, i))))
    return 1.0 / (F.array_min(ranks) + 1)


def recall_at(scores: Column, gold_index: Column, k: int) -> Column:
    """1 if a gold choice is among the k best; of equal scores the lower index is better."""
    order = F.transform(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), lambda x: x["i"])
    return F.arrays_overlap(F.slice(order, 1, k), gold_index).cast("int")


def truth_scores(logprobs: Column, single: int, true_ones: Column) -> tuple[Column, Column]:
    """Whether the first of the single-answer choices is best, and the share of the true ones among the others' probabilities."""
    rest = F.transform(F.slice(logprobs, F.lit(single + 1), F.size(logprobs)), lambda x: F.exp(x))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return (best_choice(F.slice(logprobs, 1, single)) == 0).cast("int"), F.try_divide(add(F.slice(rest, 1, true_ones)), add(rest))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams, joined by blanks."""
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shared_ngrams(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, g: n + F.least(times(a, g), times(b, g)))


def rouge_n(gold: Column, prediction: Column, n: int) -> Column:
    """F1 of the n-gram multisets."""
    a, b = ngrams(words(gold), n), ngrams(words(prediction), n)
    return F.coalesce(F.try_divide(2.0 * shared_ngrams(a, b), (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def bleu_n(gold: Column, prediction: Column, n: int) -> Column:
    """Clipped n-gram precision of one order with the brevity penalty."""
    a, b = words(gold), words(prediction)
    precision = F.coalesce(F.try_divide(shared_ngrams(ngrams(a, n), ngrams(b, n)).cast("double"), F.size(ngrams(b, n)).cast("double")), F.lit(0.0))
    penalty = F.when(F.size(b) == 0, 0.0).when(F.size(b) > F.size(a), 1.0).otherwise(F.exp(1 - F.size(a) / F.greatest(F.size(b), F.lit(1))))
    return precision * penalty


def common_prefix(gold: Column, prediction: Column) -> Column:
    """Words that two texts begin with together."""
    equal = F.zip_with(words(gold), words(prediction), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(equal).cast("bigint"))


def novel_share(source: Column, summary: Column, n: int) -> Column:
    """Share of the summary's distinct n-grams that the source has not."""
    a, b = ngrams(words(source), n), F.array_distinct(ngrams(words(summary), n))
    return F.coalesce(F.try_divide(F.size(F.array_except(b, a)).cast("double"), F.size(b).cast("double")), F.lit(0.0))


def _numbered(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of two texts as numbers, equal ones alike."""
    known: dict[str, int] = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in z], np.int64) for z in (x, y))


def edit_distance(x: list[str], y: list[str]) -> int:
    """Fewest words to replace, put in or leave out. A row of the table is one step of array arithmetic."""
    a, b = _numbered(x, y)
    places = np.arange(len(b) + 1)
    row = places.copy()
    for i, w in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != w))
        # words put in: the least of what stands to the left, plus the way from there
        row = np.minimum.accumulate(np.concatenate(([i], best)) - places) + places
    return int(row[-1])


def common_subsequence(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, by one number whose bits stand for the words of x."""
    masks: dict[str, int] = {}
    for i, w in enumerate(x):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    state = full
    for w in y:
        hit = state & masks.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(x) - state.bit_count()


@F.pandas_udf(K.LongType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in words."""
    return pd.Series([edit_distance((x or "").split(), (y or "").split()) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(K.DoubleType())
def edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less the edit distance by the longer text's words; two empty texts are alike."""
    words_ = [((x or "").split(), (y or "").split()) for x, y in zip(a, b)]
    return pd.Series([1 - edit_distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in words_])


@F.pandas_udf(K.DoubleType())
def longest_common_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words (ROUGE-L)."""
    out = []
    for x, y in zip(a, b):
        x, y = (x or "").split(), (y or "").split()
        n = common_subsequence(x, y)
        out.append(2 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out)


def union_of_subsequences(sentence: list[str], others: list[list[str]]) -> set[int]:
    """Places of the sentence's words that lie in the longest common subsequence with any of the others."""
    held: set[int] = set()
    for other in others:
        table = np.zeros((len(sentence) + 1, len(other) + 1), np.int32)
        a, b = _numbered(sentence, other)
        for i in range(len(a)):
            # the longest so far: from above, or one more where the words agree
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == a[i])))
        i, j = len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                held.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i - 1, j] >= table[i, j - 1]:
                i -= 1
            else:
                j -= 1
    return held


@F.pandas_udf(K.DoubleType())
def summary_f1(gold: pd.Series, prediction: pd.Series) -> pd.Series:
    """ROUGE-Lsum: lines are sentences; of each gold one counts what any of the predicted ones shares with it in order, each word as often as both texts have it."""
    out = []
    for g, p in zip(gold, prediction):
        gold_lines, lines_ = ([x.split() for x in (t or "").split("\n") if x.split()] for t in (g, p))
        have, left = (Counter(w for x in z for w in x) for z in (gold_lines, lines_))
        size, other, hits = have.total(), left.total(), 0
        for sentence in gold_lines:
            for i in sorted(union_of_subsequences(sentence, lines_)):
                w = sentence[i]
                if have[w] > 0 and left[w] > 0:
                    have[w] -= 1
                    left[w] -= 1
                    hits += 1
        out.append(2 * hits / (size + other) if hits else 0.0)
    return pd.Series(out)


def best_assignment(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the highest sum, every row or every column in one pair: the Hungarian method, in cubic time."""
    turned = scores.shape[0] > scores.shape[1]
    cost = -(scores.T if turned else scores)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], column = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[column]:
            used[column] = True
            row = owner[column]
            free = ~used[1:]
            slack = cost[row - 1] - u[row] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], column
            following = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[following]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            column = following
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def reading_words(answer: str) -> list[str]:
    """Words of an answer as reading comprehension compares them: small letters, without punctuation and articles, numbers in one spelling."""
    out = []
    for token in re.split("[ -]", answer):
        token = token.lower()
        if not _is_number(token):
            token = "".join(c for c in token if c not in string.punctuation)
        token = str(float(token)) if _is_number(token) else re.sub(r"\b(a|an|the)\b", " ", token)
        out += token.split()
    return out


@F.pandas_udf(K.StringType())
def reading_normal(answers: pd.Series) -> pd.Series:
    """An answer as reading comprehension compares it."""
    return pd.Series([" ".join(reading_words(a or "")) for a in answers], dtype=object)


def spans_score(golds_: list[str], found: list[str]) -> tuple[float, float]:
    """Exact match of the spans as sets, and the mean word F1 of their best one-to-one assignment; a span without any of the gold one's numbers does not match it."""
    gold_words, words_ = ([reading_words(x) for x in z] for z in (golds_, found))
    exact = float({" ".join(x) for x in gold_words} == {" ".join(x) for x in words_})
    scores = np.zeros((len(gold_words), len(words_)))
    for i, g in enumerate(map(set, gold_words)):
        numbers = {w for w in g if _is_number(w)}
        for j, p in enumerate(map(set, words_)):
            if not numbers or numbers & p:
                precision, recall = (len(g & p) / len(x) if x else 1.0 for x in (p, g))
                scores[i, j] = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    if not scores.size:
        return exact, 0.0
    return exact, sum(scores[i, j] for i, j in best_assignment(scores)) / max(scores.shape)


@F.pandas_udf(K.StructType([K.StructField("exact", K.DoubleType()), K.StructField("f1", K.DoubleType())]))
def reading_scores(golds_: pd.Series, predictions: pd.Series) -> pd.DataFrame:
    """spans_score of lists of spans; F1 to two digits."""
    spans = lambda x: [s or "" for s in x] if x is not None else []
    rows = [spans_score(spans(g), spans(p)) for g, p in zip(golds_, predictions)]
    return pd.DataFrame({"exact": [a for a, _ in rows], "f1": [round(b, 2) for _, b in rows]})


@F.pandas_udf(K.DoubleType())
def assigned_f1(golds_: pd.Series, predictions: pd.Series) -> pd.Series:
    """Mean word F1 of the best one-to-one assignment of predicted spans to gold spans; spans left over count 0, two empty lists agree."""

    def f1(a: str, b: str) -> float:
        x, y = set(a.lower().split()), set(b.lower().split())
        return 2 * len(x & y) / (len(x) + len(y)) if x & y else 0.0

    out = []
    for g, p in zip(golds_, predictions):
        gold, found = ([x or "" for x in z] if z is not None else [] for z in (g, p))
        if not gold or not found:
            out.append(float(not gold and not found))
            continue
        scores = np.array([[f1(a, b) for b in found] for a in gold])
        out.append(sum(scores[i, j] for i, j in best_assignment(scores)) / max(scores.shape))
    return pd.Series(out)


def majority(answers: Column) -> Column:
    """The most frequent answer, of equally frequent ones the first."""
    times = F.transform(answers, lambda a: F.size(F.filter(answers, lambda x: x == a)))
    return F.get(answers, F.array_position(times, F.array_max(times)).cast("int") - 1)


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Chance that k of n samples hold a correct one."""
    wrong = n - correct
    factors = F.when(correct > 0, F.sequence(wrong + 1, n)).otherwise(F.array().cast("array<bigint>"))
    return F.when(wrong < k, 1.0).otherwise(1.0 - F.aggregate(factors, F.lit(1.0), lambda p, i: p * (1.0 - k / i)))


def many_of_k(n: Column, correct: Column, k: int, share: float) -> Column:
    """Chance that at least this share of k drawn samples is correct (hypergeometric tail, as products of ratios; n from k on)."""
    least = max(1, math.ceil(share * k))
    # i correct ones: k over i, times the chance that the first i draws are correct and the others wrong
    ratio = lambda i, j: F.when(j < i, (correct - j) / (n - j) * (k - j) / (j + 1)).otherwise((n - correct - (j - i)) / (n - j))
    terms = F.transform(F.sequence(F.lit(least), F.lit(k)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, j: p * ratio(i, j)))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


# How many levels of brackets the answer box may hold.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def final_answer(text: Column) -> Column:
    """The last boxed answer, else what follows 'answer is', else the last number."""
    boxed = F.regexp_extract_all(text, F.lit(BOXED), 1)
    said = F.regexp_extract(text, r"answer is:?\s*([^\n.]+)", 1)
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), 0)
    return F.when(F.size(boxed) > 0, F.element_at(boxed, -1)).when(said != "", F.trim(said)).when(F.size(numbers) > 0, F.replace(F.element_at(numbers, -1), F.lit(","), F.lit(""))).otherwise("")


def as_number(text: Column) -> Column:
    """A number with separators or a percent sign; null if it is none."""
    bare = F.replace(F.trim(text), F.lit(","), F.lit(""))
    percent = F.endswith(bare, F.lit("%"))
    return F.when(percent, F.regexp_replace(bare, "%+$", "").try_cast("double") / 100).otherwise(bare.try_cast("double"))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Whether two strings are the same text or numbers that agree within the tolerance, also up to a factor of 100."""
    x, y = as_number(a), as_number(b)
    close = lambda p, q: F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False)) | F.coalesce(close(x, y) | close(x / 100, y) | close(x * 100, y), F.lit(False))


def mean_error(score: str) -> list[Column]:
    """Mean, standard error of the mean and number of scores."""
    n = F.count(score)
    return [F.avg(score).alias("mean"), F.try_divide(F.stddev_samp(score), F.sqrt(n)).alias("stderr"), n.alias("samples")]


def confusion(truth: Column, guess: Column) -> list[Column]:
    return [F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")]


def matthews() -> Column:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def f1_score() -> Column:
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def grouped_means(scores: DataFrame, group: str, task: str, score: str) -> DataFrame:
    """level, name and value: the mean of each task, of the tasks of each group that has two or more, and of all tasks."""
    tasks = scores.groupBy(group, task).agg(F.avg(score).alias("value"))
    levels = [
        tasks.select(F.lit("task").alias("level"), F.concat_ws(":", group, task).alias("name"), "value"),
        tasks.groupBy(group).agg(F.avg("value").alias("value"), F.count("*").alias("n")).where("n > 1").select(F.lit("group").alias("level"), F.col(group).alias("name"), "value"),
        tasks.agg(F.avg("value").alias("value")).select(F.lit("all").alias("level"), F.lit("all").alias("name"), "value"),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def bootstrap_error(scores: DataFrame, key: list[str], score: str, turns: int, seed: int) -> DataFrame:
    """Spread of the mean over resamples. Each row is drawn a Poisson number of times, decided by a hash of turn and key, so nothing is gathered."""
    #: The cumulative chances of 0, 1, 2, ... draws of a Poisson variable of mean 1.
    edges = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    rows = scores.select(*key, score, F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    u = hash_share(seed, F.col("turn"), *map(F.col, key))
    draws = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    means = rows.withColumn("_d", draws).groupBy("turn").agg((F.sum(F.col(score) * F.col("_d")) / F.sum("_d")).alias("mean"))
    return means.agg(F.stddev_samp("mean").alias("stderr"), F.count("*").alias("turns"))


def pivoted(means: DataFrame, row: str, column: str, value: str, digits: int = 6) -> DataFrame:
    """A row for each of `row`, a column for each name in `column` (a short list of tasks), and average: the mean of the row's values."""
    names = sorted(r[0] for r in means.select(column).distinct().collect())
    wide = means.groupBy(row).pivot(column, names).agg(F.round(F.first(value), digits))
    return wide.join(means.groupBy(row).agg(F.round(F.avg(value), digits).alias("average")), row)


def with_missing(results: DataFrame, mark: str = "N/A", digits: int = 4) -> DataFrame:
    """Results as text for a report, missing ones marked."""
    text = lambda c, kind: F.when(F.col(c).isNull(), mark).otherwise(F.format_number(c, digits) if kind in ("double", "float") else F.col(c).cast("string")).alias(c)
    return results.select(*(text(c, kind) for c, kind in results.dtypes))


def latest_by(df: DataFrame, key: list[str], time: str, tie: str, value: str) -> DataFrame:
    """key and the value of the last row in time."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def preferred(df: DataFrame, key: list[str], name: str, value: str, order: list[str]) -> DataFrame:
    """Of each key the row whose name comes first in the order; names not in it come after, alphabetically."""
    place = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(name)), F.lit(0)), F.lit(len(order) + 1))
    return df.groupBy(*key).agg(F.min_by(F.struct(name, value), F.struct(place, name)).alias("_b")).select(*key, f"_b.{name}", f"_b.{value}")


def _number(text: str) -> float | None:
    """A number with separators or a percent sign."""
    bare = text.strip().replace(",", "")
    try:
        return float(bare.rstrip("%").rstrip("\\")) / 100 if bare.endswith("%") else float(bare)
    except ValueError:
        return None


def _parts(text: str) -> list[list[str]] | None:
    """Rows of a matrix, or the one row of a list or tuple, as strings; None where the text is neither."""
    for name in ("pmatrix", "bmatrix"):
        a, b = f"\\begin{{{name}}}", f"\\end{{{name}}}"
        if text.startswith(a) and text.endswith(b):
            return [[x.strip() for x in row.split("&")] for row in text[len(a) : -len(b)].split("\\\\") if row.strip()]
    if len(text) > 2 and text[0] in "([" and text[-1] in ")]":
        return [[x.strip() for x in text[1:-1].split(",")]]
    return None


def answers_equal(prediction: str, truth: str, tolerance: float = 1e-4) -> bool:
    """Whether two answers are equal as texts, as numbers (also up to a factor of 100), entry by entry as tuples or matrices, or as the right side of an
    equation for a short name. Formulas are not transformed."""
    p, t = prediction.strip(), truth.strip()
    if p == t:
        return True
    x, y = _number(p), _number(t)
    if x is not None and y is not None:
        return any(math.isclose(z, x, rel_tol=tolerance) for z in (y / 100, y, y * 100))
    if not p:
        return False
    bare = lambda z: re.sub(r"[(){}\[\]]", "", z).lower()
    if bare(p) == bare(t):
        return True
    a, b = _parts(p), _parts(t)
    if a is not None and b is not None:
        if [len(r) for r in a] == [len(r) for r in b] and all(answers_equal(u, v, tolerance) for r, s in zip(a, b) for u, v in zip(r, s)):
            return True
    sides = p.split("="), t.split("=")
    if all(len(s) == 2 for s in sides):
        (pl, pr), (tl, tr) = sides
        return answers_equal(pl, tl, tolerance) and answers_equal(pr, tr, tolerance) or answers_equal(pl, tr, tolerance) and answers_equal(pr, tl, tolerance)
    for own, other in (sides, sides[::-1]):
        if len(own) == 2 and len(own[0].strip()) <= 2 and len(other) == 1:
            return answers_equal(own[1], other[0], tolerance)
    return False


@F.pandas_udf(K.BooleanType())
def math_equal(truth: pd.Series, prediction: pd.Series) -> pd.Series:
    """answers_equal of two columns; null is the empty text."""
    return pd.Series([answers_equal(p or "", t or "") for t, p in zip(truth, prediction)])


def token_entropy(rows: DataFrame, key: str, logprobs: str) -> DataFrame:
    """Mean negative log-probability, mean of the entropy's terms -p log p, and the number of positions, by key. Summed by row before anything is grouped."""
    add = lambda f: F.aggregate(F.transform(logprobs, f), F.lit(0.0), lambda a, b: a + b)
    own = rows.select(key, add(lambda x: -x).alias("a"), add(lambda x: -x * F.exp(x)).alias("b"), F.size(logprobs).alias("n"))
    n = F.sum("n")
    return own.groupBy(key).agg((F.sum("a") / n).alias("cross_entropy"), (F.sum("b") / n).alias("entropy_terms"), n.alias("positions"))


#: Scores by name: which rows have what they need, and the score of a row with golds, text, logprobs, choices and gold_index.
REGISTRY = {
    "acc": ("logprobs IS NOT NULL AND size(logprobs) = size(choices)", lambda: choice_accuracy(F.col("logprobs"), F.col("gold_index"))),
    "acc_char": ("logprobs IS NOT NULL AND size(logprobs) = size(choices)", lambda: choice_accuracy(by_characters(F.col("logprobs"), F.col("choices")), F.col("gold_index"))),
    "mrr": ("logprobs IS NOT NULL AND size(logprobs) = size(choices)", lambda: reciprocal_rank(F.col("logprobs"), F.col("gold_index"))),
    "probability": ("logprobs IS NOT NULL AND size(logprobs) = size(choices)", lambda: gold_probability(F.col("logprobs"), F.col("gold_index"))),
    "em": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), exact_match)),
    "prefix_em": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), lambda a, b: exact_match(a, b, "prefix"))),
    "suffix_em": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), lambda a, b: exact_match(a, b, "suffix"))),
    "f1": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), bag_f1)),
    "rouge1": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), lambda a, b: rouge_n(a, b, 1))),
    "rouge2": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), lambda a, b: rouge_n(a, b, 2))),
    "number": ("text IS NOT NULL AND size(text) > 0", lambda: best_pair(F.col("golds"), F.col("text"), lambda a, b: numbers_equal(a, b).cast("int"))),
}


def run_scores(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """score, the columns in `by`, value (the mean) and samples, for the scores of these names. The rows are read once for each score."""
    unknown = set(names) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown scores: {', '.join(sorted(unknown))}")
    out = None
    for name in names:
        needed, score = REGISTRY[name]
        own = rows.where(needed).withColumn("__s", score().cast("double")).where("__s IS NOT NULL").groupBy(*by).agg(F.avg("__s").alias("value"), F.count("*").alias("samples"))
        own = own.select(F.lit(name).alias("score"), *by, "value", "samples")
        out = own if out is None else out.unionByName(own)
    return out
