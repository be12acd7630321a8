"""Quality rules: an isolation forest on rule statistics, calibrated by labels.

Each document gets rule statistics; a forest of random splits, fitted on a
bounded sample, scores how quickly a document is isolated; the cut is set on
all labelled rows, where it tells good from bad best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, set_aside, shared_dir, table

STATS_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_stop_ends long, n_upper long, n_distinct_words long"
)
#: The same as a type.
STATS_STRUCT = "struct<" + ", ".join(x.replace(" ", ":") for x in STATS_SCHEMA.split(", ")) + ">"
NAMES = tuple(x.split()[0] for x in STATS_SCHEMA.split(", "))
SYMBOLS = b"#*$%&|<>"
#: Features of the forest, each a share or a bounded figure computed from the statistics. Repeats are
#: the base rule's; as features, repeated lines and digits isolate good documents before bad ones.
FEATURES = ("mean_word", "symbol_share", "upper_share", "end_share", "distinct_share")


@dataclass(frozen=True)
class ForestConfig:
    """Parameters; ``fit_rows`` and ``bins`` bound what reaches the driver.

    The fitting rows are those with the smallest hash of their doc_id, so
    reruns agree whatever the partitioning.
    """

    trees: int = 100
    subsample: int = 256
    fit_rows: int = 4096
    #: Steps of the anomaly (0 to 1) at which the cut can lie.
    bins: int = 10_000
    #: Where no row is labelled bad: of the rows labelled good, the share that the cut may reject.
    good_loss: float = 0.002
    min_words: int = 50
    seed: int = 7


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) > 2_000_000:  # three ids no longer fit in 63 bits: number the pairs first
        _, pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)
        key = pair[:-1] * len(ids) + code[2:]
    else:
        key = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _stats(data: bytes | None) -> tuple[int, ...]:
    data = data or b""
    words = data.split()
    n = len(words)
    # code points: bytes that aren't UTF-8 continuations
    joined = b"".join(words)
    high = np.frombuffer(joined, np.uint8)
    chars = int(len(high) - ((high & 0xC0) == 0x80).sum())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    seen: set[bytes] = set()
    lines = dup = ends = 0
    for line in data.split(b"\n"):
        bare = line.strip()
        if bare:
            lines += 1
            ends += bare[-1:] in b".!?:;"
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return n, chars, symbols, dup, _repeat_words(words), lines, ends, upper, len(set(words))


def _table(texts: pa.Array) -> dict[str, list[int]]:
    """The statistics of a batch by name; one text at a time as Python bytes."""
    rows = [_stats(x.as_py()) for x in texts]
    return dict(zip(NAMES, zip(*rows, strict=True) if rows else ((),) * len(NAMES), strict=True))


def rule_statistics(docs: DataFrame, into: str = "_stats") -> DataFrame:
    """``docs`` with a struct column ``into`` of the fields of ``STATS_SCHEMA``.

    The statistics are exact over whole texts. A null text counts as empty
    (all statistics 0). Other columns stay in the JVM, whatever their names;
    repeated rows stay repeated.
    """

    @F.arrow_udf(STATS_STRUCT)
    def stats(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in _table(texts).values()], list(NAMES))

    # Not deterministic on paper, so that no filter above makes Spark run it twice.
    return docs.withColumn(into, stats.asNondeterministic()(F.encode("text", "UTF-8")))


def features(stats: dict) -> np.ndarray:
    """One row of ``FEATURES`` for each document, from its statistics."""
    x = {k: np.asarray(v, np.float64) for k, v in stats.items()}
    words, chars, lines = (np.maximum(x[c], 1.0) for c in ("n_words", "word_chars", "n_lines"))
    values = {
        "mean_word": np.minimum(x["word_chars"] / words, 40.0), "symbol_share": np.minimum(x["n_symbols"] / chars, 1.0),
        "upper_share": x["n_upper"] / chars, "end_share": x["n_stop_ends"] / lines, "distinct_share": np.minimum(x["n_distinct_words"] / np.sqrt(words), 40.0),
    }
    return np.column_stack([values[f] for f in FEATURES])


def _mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n if n > 2 else 1.0


def fit_forest(x: np.ndarray, cfg: ForestConfig) -> list[dict]:
    """Trees as flat lists: split feature (-1 at a leaf), cut, children, depth plus leaf correction."""
    rng = np.random.default_rng(cfg.seed)
    limit = int(np.ceil(np.log2(max(2, cfg.subsample)))) + 2
    trees = []
    for _ in range(cfg.trees):
        rows = rng.choice(len(x), min(cfg.subsample, len(x)), replace=False)
        tree: dict = {"feature": [], "cut": [], "left": [], "right": [], "path": []}

        def grow(part: np.ndarray, depth: int, tree=tree) -> int:
            at = len(tree["feature"])
            for k, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("path", depth + _mean_path(len(part)))):
                tree[k].append(v)
            lo, hi = (part.min(0), part.max(0)) if len(part) else (None, None)
            open_ = np.flatnonzero(hi > lo) if len(part) > 1 else []
            if depth < limit and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(lo[f], hi[f]))
                tree["feature"][at], tree["cut"][at] = f, cut
                tree["left"][at] = grow(part[part[:, f] < cut], depth + 1)
                tree["right"][at] = grow(part[part[:, f] >= cut], depth + 1)
            return at

        grow(x[rows], 0)
        trees.append(tree)
    return trees


def path_score(trees: list[dict], x: np.ndarray, subsample: int) -> np.ndarray:
    """Anomaly in (0, 1): 2 ** (-mean path / expected path)."""
    total = np.zeros(len(x))
    for t in trees:
        feature, cut, left, right, path = (np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "path"))
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            node = at[live]
            go = x[live, feature[node]] < cut[node]
            at[live] = np.where(go, left[node], right[node])
            live = live[feature[at[live]] >= 0]
        total += path[at]
    return np.power(2.0, -total / max(1, len(trees)) / max(1e-9, _mean_path(subsample)))


def _bounded(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows of smallest hash of doc_id: a bounded, repeatable sample."""
    return df.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)


def _cut(counts: list[tuple[int, int, int]], cfg: ForestConfig) -> float | None:
    """The anomaly up to which documents stay, from (bin, good rows, bad rows).

    It has the best balanced accuracy (rejected share of bad rows less that of
    good ones); of equal cuts the highest.
    """
    good, bad = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not good:
        return None
    best, g, b = (-2.0, 0), 0, 0
    for step, more_good, more_bad in sorted(counts):
        g, b = g + more_good, b + more_bad
        if bad:
            best = max(best, ((bad - b) / bad - (good - g) / good, step))
        elif good - g <= cfg.good_loss * good:
            return (step + 1) / cfg.bins
    return (best[1] + 1) / cfg.bins


def quality_verdicts(docs: DataFrame, labels: DataFrame, cfg: ForestConfig | None = None, text: bool = True) -> DataFrame:
    """``docs`` with ``_stats``, ``base_failed``, ``anomaly`` and ``_kept``.

    ``labels`` (doc_id, quality 0/1) supplies the rows: the forest is fitted on
    at most ``fit_rows`` labelled documents, and the cut is the anomaly of best
    balanced accuracy over all labelled documents that pass the base rule,
    counted on executors. Documents are scored once and written. A document is kept unless it fails the base rule (too few words,
    or more than half of its words in repeated 3-word windows) or its anomaly
    is above the cut. Rows with a null label or doc_id don't count. Without
    usable labels there is no cut and the base rule alone decides. Null texts
    fail the base rule. Repeated rows get equal verdicts; an empty table
    gives an empty table.
    """
    cfg = cfg or ForestConfig()
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # At most fit_rows ids: a proven bound for the broadcast and for the driver.
    marks = _bounded(ids.select("doc_id"), cfg.fit_rows, cfg.seed)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    drawn = rule_statistics(drawn).where(F.col("_stats.n_words") >= cfg.min_words)
    local = drawn.select("doc_id", "_stats.*").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    fit = features({n: local[n] for n in NAMES}) if len(local) else np.zeros((0, len(FEATURES)))
    failed = (F.col("_stats.n_words") < cfg.min_words) | (100 * F.col("_stats.n_repeat_words") > 50 * F.col("_stats.n_words"))
    if len(fit) < 2:
        out = rule_statistics(docs).withColumn("base_failed", failed)
        return out.withColumn("anomaly", F.lit(None).cast("double")).withColumn("_kept", ~F.col("base_failed"))
    trees = fit_forest(fit, cfg)
    n = min(cfg.subsample, len(fit))

    @F.arrow_udf(STATS_STRUCT[:-1] + ",anomaly:double>")
    def judged(texts: pa.Array) -> pa.Array:  # statistics and path lengths in one pass; the forest is a few thousand numbers
        stats = _table(texts)
        score = path_score(trees, features(stats), n) if len(texts) else np.zeros(0)
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in stats.values()], pa.array(score)], [*NAMES, "anomaly"])

    out = docs.withColumn("_stats", judged.asNondeterministic()(F.encode("text", "UTF-8")))
    out = out.withColumn("base_failed", failed).withColumn("anomaly", F.col("_stats.anomaly"))
    out = materialise(out if text else out.drop("text"), shared_dir(docs.sparkSession), "judged")
    step = F.floor(F.col("anomaly") * cfg.bins).cast("long").alias("step")
    scored = out.where("not base_failed").select(F.col("doc_id").cast("long").alias("doc_id"), step).join(ids, "doc_id")
    tally = scored.groupBy("step").agg(F.count(F.when(F.col("quality") == 1, 1)), F.count(F.when(F.col("quality") != 1, 1)))
    cut = _cut([tuple(r) for r in tally.collect()], cfg)  # at most bins + 1 rows
    if cut is None:
        return out.withColumn("anomaly", F.lit(None).cast("double")).withColumn("_kept", ~F.col("base_failed"))
    return out.withColumn("_kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * cfg.bins) < F.round(F.lit(cut * cfg.bins))))


def filter_quality(docs: DataFrame, labels: DataFrame, cfg: ForestConfig | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    docs, moved = set_aside(docs, "_stats", "base_failed", "anomaly", "_kept")
    out = quality_verdicts(docs, labels, cfg).where("_kept").select(*[f"`{c}`" for c in docs.columns])
    return out.withColumnsRenamed({v: k for k, v in moved.items()})


def op10(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of all ``documents``."""
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text=False)
    stats = [F.col(f"_stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *stats, "base_failed", F.col("_kept").alias("kept"), "anomaly")
