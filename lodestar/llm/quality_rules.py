"""Quality rules: fixed limits, then robust multivariate outliers for each language and source.

Every text gives a vector of transformed statistics. The minimum-covariance-determinant estimate
of a group is sought from several starts by concentration steps: distances under the last
estimate, the part of the rows with the smallest ones, their mean and covariance as the next. The
start with the smallest determinant after two steps goes on until its determinant stops falling.
A step is one aggregation over the narrow table of statistics for all groups and starts: rows are
summed by bins of their distance, and a group's estimate is read from its bins, whose number does
not grow with the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, fresh, prepare, stable, utf8, with_fields

#: Words of a window that must not repeat within a text.
WINDOW = 8
#: A text with fewer words fails, and one with a larger share of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a group's rows that a concentration step keeps.
SUPPORT = 0.75
#: Concentration steps of all starts, and of the best one at most.
FIRST_STEPS, STEPS = 2, 12
#: A step ends the search if the determinant falls by less than this share.
FALLS = 1e-4
#: Bins for each factor of e between squared distances, and for each unit of a statistic.
BINS, UNIT = 64, 64
#: Groups of fewer rows are pooled by language, and languages of fewer rows with each other.
MIN_GROUP = 200
#: The smallest standard deviations, by dimension: differences below them are never evidence.
#: Six of them are in every dimension's reach, where the source has none: 5.8 % of symbols, 5.8
#: duplicated lines for 100 words, 25 % of repeated words.
FLOORS = (0.35, 0.25, 0.4, 0.04, 0.083)
#: Squared distance beyond which a row goes: chi-square with five degrees of freedom, upper tail 1e-6.
CUTOFF = 35.9
#: Median of that distribution, for scaling the distances of a group.
CHI2_MEDIAN = 4.3515
DIMS = len(FLOORS)
#: Texts to be taken out that may be broadcast.
FEW_ROWS = 1 << 20

_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_WHITE = bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r")
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.random.default_rng(8).integers(1, 2**63, size=WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums += mixed[k : k + n] * _MIX[k]
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():  # different sums: no window repeats
        return 0
    step, classes = 1, ids
    while step < window:  # classes of windows by exact pairs of shorter windows; window is a power of two
        pairs = classes[:-step] * (len(words) + 1) + classes[step:]
        classes = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(classes)[classes] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges) > 0).sum())


def text_statistics(data: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    if not data:
        return 0, 0, 0, 0, 0
    words = data.split()
    chars = len(data) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))) - _continuation(data)
    symbols = len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _continuation(data: bytes) -> int:
    if data.isascii():
        return 0
    a = np.frombuffer(data, dtype=np.uint8)
    return int(((a & 0xC0) == 0x80).sum())


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the five statistics as long columns, and their names (fresh if docs has them)."""
    prepare(docs.sparkSession)
    names = fresh(docs, *_STATS)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_statistics(x) for x in utf8(batch.column(at))], dtype=np.int64).reshape(-1, len(names))
            yield attach(batch, {n: pa.array(rows[:, i]) for i, n in enumerate(names)})

    return docs.mapInArrow(run, with_fields(docs.schema, *((n, T.LongType()) for n in names))), names


def vector(n_words: str, word_chars: str, n_symbols: str, n_dup_lines: str, n_repeat_words: str) -> list[Column]:
    """Transformed statistics: sizes by logarithm, shares by square root."""
    words = F.greatest(F.col(n_words), F.lit(1)).cast("double")
    return [
        F.log1p(F.col(n_words).cast("double")),
        F.col(word_chars) / words,
        F.sqrt(F.lit(100.0) * F.col(n_symbols) / F.greatest(F.col(word_chars), F.lit(1))),
        F.sqrt(F.col(n_dup_lines) / words),
        F.sqrt(F.col(n_repeat_words) / words),
    ]


def chi_square(x: float, degrees: int) -> float:
    """The chi-square distribution function, by its series."""
    half, term = degrees / 2, 1.0
    total, k = 0.0, 0
    term = math.exp(-x / 2 + half * math.log(x / 2) - math.lgamma(half + 1))
    while term > 1e-17 * total or k < 5:
        total += term
        k += 1
        term *= (x / 2) / (half + k)
    return total


#: The chi-square value that SUPPORT of good rows stay under, and what a core's covariance is short of all rows' by.
_INSIDE = next(x / 1000 for x in range(1, 100_000) if chi_square(x / 1000, DIMS) >= SUPPORT)
CONSISTENCY = SUPPORT / chi_square(_INSIDE, DIMS + 2)
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_M, _V = [f"m{i}" for i in range(DIMS)], [f"v{i}{j}" for i, j in _PAIRS]
_STATE = ", ".join(["start int", *(f"{c} double" for c in (*_M, *_V)), "logdet double"])


def _sums(x: list[Column]) -> list[Column]:
    """Count, sums and products of five columns."""
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)), *(F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS)]


_S, _P = [f"s{i}" for i in range(DIMS)], [f"p{i}{j}" for i, j in _PAIRS]


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of summed rows: n, sums, products."""
    mean = sums[1 : 1 + DIMS] / sums[0]
    cov = np.zeros((DIMS, DIMS))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = sums[1 + DIMS + k] / sums[0] - mean[i] * mean[j]
    return mean, cov


def _state(start: int, mean: np.ndarray, cov: np.ndarray) -> list[float]:
    """start, mean, upper triangle of the inverse, logarithm of the determinant of a covariance, no dimension of
    which is tighter than its floor, and which is never singular."""
    cov = cov * 0.999
    cov[range(DIMS), range(DIMS)] = np.maximum(np.diag(cov) / 0.999, np.square(FLOORS))
    inverse = np.linalg.inv(cov)
    return [start, *mean, *(inverse[i, j] for i, j in _PAIRS), float(np.linalg.slogdet(cov)[1])]


def _starts(vectors: DataFrame, group: str) -> DataFrame:
    """(group, start, estimate): the median with the floors as spread, with the quartiles' spread, with the
    covariance of signs, and with that of rows whose far values are drawn in."""
    kind = dict(vectors.dtypes)[group]
    values = vectors.select(group, F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.floor(F.col(f"x{i}") * UNIT).alias("bin")) for i in range(DIMS)))).alias("v"))
    bins = values.groupBy(group, "v.d", "v.bin").agg(F.count("*").alias("n"))

    def quartiles(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {group: [rows[group].iloc[0]]}
        for d, of in rows.sort_values("bin").groupby("d"):
            upto = of["n"].cumsum().to_numpy()
            low, mid, high = ((of["bin"].to_numpy()[np.searchsorted(upto, share * upto[-1])] + 0.5) / UNIT for share in (0.25, 0.5, 0.75))
            out[f"m{d}"], out[f"r{d}"] = [mid], [max((high - low) / 1.349, FLOORS[d])]
        return pd.DataFrame(out)

    fields = ", ".join([f"{group} {kind}", *(f"m{i} double, r{i} double" for i in range(DIMS))])
    middle = stable(bins.groupBy(group).applyInPandas(quartiles, fields))
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"r{i}") for i in range(DIMS)]
    length = F.sqrt(sum((c * c for c in z), F.lit(0.0)) + 1e-12)
    near = vectors.join(_small(middle), group).select(group, *(c.alias(f"z{i}") for i, c in enumerate(z)), length.alias("length"))
    ways = F.array(F.struct(F.lit(2).alias("start"), *(F.col(f"z{i}") / F.col("length") for i in range(DIMS))), F.struct(F.lit(3).alias("start"), *(F.tanh(f"z{i}") for i in range(DIMS)))).cast(f"array<struct<start:int,{','.join(f'y{i}:double' for i in range(DIMS))}>>")
    summed = near.select(group, F.explode(ways).alias("w")).select(group, "w.*").groupBy(group, "start").agg(*_sums([F.col(f"y{i}") for i in range(DIMS)]))

    def begin(rows: pd.DataFrame, middles: pd.DataFrame) -> pd.DataFrame:
        at = middles.iloc[0]
        mean, spread = at[_M].to_numpy(dtype=float), at[[f"r{i}" for i in range(DIMS)]].to_numpy(dtype=float)
        made = [_state(0, mean, np.diag(np.square(FLOORS))), _state(1, mean, np.diag(np.square(spread)))]
        for _, r in rows.sort_values("start").iterrows():
            _, cov = _moments(r[["n", *_S, *_P]].to_numpy(dtype=float))
            size = np.sqrt(np.maximum(np.diag(cov), 1e-12))  # its correlations, with the quartiles' spread
            made.append(_state(int(r["start"]), mean, cov / np.outer(size, size) * np.outer(spread, spread)))
        return pd.DataFrame([[at[group], *m] for m in made], columns=[group, "start", *_M, *_V, "logdet"])

    return stable(summed.groupBy(group).cogroup(middle.groupBy(group)).applyInPandas(begin, f"{group} {kind}, {_STATE}"))


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    return sum((F.lit(1.0 if i == j else 2.0) * F.col(f"v{i}{j}") * d[i] * d[j] for i, j in _PAIRS), F.lit(0.0))


def _bin() -> Column:
    return F.floor(F.log(_distance() + 1e-9) * BINS)


def _step(vectors: DataFrame, now: DataFrame, group: str, support: float) -> DataFrame:
    """The next estimate of each group and start, from the sums of its rows by bins of distance."""
    near = vectors.join(_small(now), group).select(group, "start", _bin().alias("bin"), *(f"x{i}" for i in range(DIMS)))
    bins = near.groupBy(group, "start", "bin").agg(*_sums([F.col(f"x{i}") for i in range(DIMS)]))

    def concentrate(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        upto = rows["n"].cumsum().to_numpy()
        inside = rows.iloc[: int(np.searchsorted(upto, support * upto[-1])) + 1]
        mean, cov = _moments(inside[["n", *_S, *_P]].to_numpy(dtype=float).sum(axis=0))
        return pd.DataFrame([[rows[group].iloc[0], *_state(int(rows["start"].iloc[0]), mean, cov * CONSISTENCY)]], columns=[group, "start", *_M, *_V, "logdet"])

    return stable(bins.groupBy(group, "start").applyInPandas(concentrate, f"{group} {dict(now.dtypes)[group]}, {_STATE}"))


def _best(states: DataFrame, group: str) -> DataFrame:
    """The estimate with the smallest determinant of each group; ties by start."""
    rest = [c for c in states.columns if c != group]
    least = states.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("b"))
    return least.select(group, *(F.col("b")[c].alias(c) for c in rest))


def estimate(vectors: DataFrame, group: str, support: float = SUPPORT) -> DataFrame:
    """Minimum-covariance-determinant estimates: group, m*, v*, and ``scale`` of its distances.

    vectors has the group and x0..x4. The covariance is the core's, made consistent for normal
    rows before floors hold; scale is what the group's median distance is over the chi-square median, 1 at least.
    """
    now = _starts(vectors, group)
    for _ in range(FIRST_STEPS):
        now = _step(vectors, now, group, support)
    best = now = stable(_best(now, group))
    for _ in range(STEPS):
        after = _step(vectors, now, group, support)
        both = after.join(best.select(group, F.col("logdet").alias("was")), group)
        now = stable(both.where(F.col("logdet") < F.col("was") - FALLS).drop("was"))
        if not now.limit(1).count():
            break
        best = stable(_best(best.unionByName(now), group))
    bins = vectors.join(_small(best), group).groupBy(group, _bin().alias("bin")).agg(F.count("*").alias("n"))

    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        upto = rows["n"].cumsum().to_numpy()
        at = rows["bin"].to_numpy()[int(np.searchsorted(upto, 0.5 * upto[-1]))]
        return pd.DataFrame({group: [rows[group].iloc[0]], "scale": [max(math.exp((at + 0.5) / BINS) / CHI2_MEDIAN, 1.0)]})

    scales = bins.groupBy(group).applyInPandas(middle, f"{group} {dict(vectors.dtypes)[group]}, scale double")
    return stable(best.join(scales, group).drop("start", "logdet"))


def _group_keys(rows: DataFrame, pair: str, lang: Column, min_group: int) -> DataFrame:
    """(pair, group): the pair itself, else its language's pool, else the pool of all; small pools have no group."""
    pools = stable(rows.groupBy(pair, F.coalesce(lang, F.lit("")).alias("_lang")).agg(F.count("*").alias("_n")))
    own = F.when(F.col("_n") >= min_group, F.concat(F.lit("pair "), F.col(pair)))
    of_language = pools.where(F.col("_n") < min_group).groupBy("_lang").agg(F.sum("_n").alias("_l"))
    pools = pools.join(_small(of_language), "_lang", "left").withColumn("_group", F.coalesce(own, F.when(F.col("_l") >= min_group, F.concat(F.lit("language "), F.col("_lang")))))
    left = pools.where("_group is null").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_a"))
    pools = pools.crossJoin(F.broadcast(left))  # one row
    return pools.select(pair, F.coalesce("_group", F.when(F.col("_a") >= min_group, F.lit("all"))).alias("_group"))


def _few(df: DataFrame, rows: int = 50_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; beyond that the join is Spark's to choose."""
    return F.broadcast(df) if _few(df) else df


def _pair() -> Column:
    return F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))


def _verdicts(rows: DataFrame, names: list[str], estimates: DataFrame, keys: DataFrame, base: str, kept: str, cutoff: float) -> DataFrame:
    """rows, which have the statistics and the pair, with base_failed and kept instead of the pair."""
    own = [c for c in rows.columns if c != "_pair"]
    with_x = rows.withColumns({f"x{i}": x for i, x in enumerate(vector(*names))})
    model = _small(stable(keys.join(estimates, "_group")))
    failed = (F.col(names[0]) < MIN_WORDS) | (F.col(names[4]) * 100 > F.col(names[0]) * MAX_REPEAT_PERCENT)
    far = F.coalesce(_distance() / F.col("scale") > cutoff, F.lit(False))
    return with_x.join(model, "_pair", "left").select(*own, failed.alias(base), (~failed & ~far).alias(kept))


def _fit(narrow: DataFrame, names: list[str], min_group: int) -> tuple[DataFrame, DataFrame]:
    """Estimates by group, and the group of each pair, from the rows that pass the fixed limits."""
    failed = (F.col(names[0]) < MIN_WORDS) | (F.col(names[4]) * 100 > F.col(names[0]) * MAX_REPEAT_PERCENT)
    passed = narrow.where(~failed)
    keys = stable(_group_keys(passed, "_pair", F.col("lang"), min_group))
    vectors = passed.join(_small(keys), "_pair").where("_group is not null").select("_group", *(x.alias(f"x{i}") for i, x in enumerate(vector(*names))))
    return estimate(vectors, "_group"), keys


def judged(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Rows that pass
    are held against the estimate of their language and source (null is a value of its own);
    pairs under min_group rows are pooled by language, and what is still under it over all
    rows; a pool that stays under it has no estimate and rejects nothing. Every row has its own
    verdict, repeated rows the same one; a null text has no words and fails; an empty table
    gives no rows; other columns are not read.
    """
    rows, names = with_statistics(docs.select("doc_id", "text", "lang", "source"))
    narrow = stable(rows.select("doc_id", "lang", *names, _pair().alias("_pair")))
    estimates, keys = _fit(narrow, names, min_group)
    return _verdicts(narrow, names, estimates, keys, "base_failed", "kept", cutoff).drop("lang")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of docs that ``judged`` keeps, in docs' own columns; texts are never shuffled."""
    width = len(docs.columns)
    inner = docs.toDF(*(f"c{i}" for i in range(width)))  # so that no name of docs meets one of ours
    named = {c: f"c{docs.columns.index(c)}" for c in ("text", "lang", "source")}
    inner = inner.withColumnsRenamed({v: k for k, v in named.items()})
    back = {v: k for k, v in named.items()}
    rows, names = with_statistics(inner)
    rows = rows.withColumn("_pair", _pair())
    keys_of_row = {"_k1": F.xxhash64("text", "lang", "source"), "_k2": F.xxhash64(F.lit(1), "source", "lang", "text")}
    narrow = stable(rows.withColumns(keys_of_row).select("lang", *names, "_pair", *keys_of_row))
    estimates, keys = _fit(narrow, names, min_group)
    gone = stable(_verdicts(narrow, names, estimates, keys, "_base", "_kept", cutoff).where(~F.col("_kept")).select(*keys_of_row).distinct())
    if _few(gone, FEW_ROWS):  # what goes is taken out, and no text is looked at twice
        kept = inner.withColumns(keys_of_row).join(F.broadcast(gone), list(keys_of_row), "left_anti")
    else:
        kept = _verdicts(rows, names, estimates, keys, "_base", "_kept", cutoff).where("_kept")
    return kept.select(*(F.col(back.get(f"c{i}", f"c{i}")).alias(docs.columns[i]) for i in range(width)))
