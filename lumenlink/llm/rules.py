"""Quality rules: statistics of texts and decision lists learned from labelled ones.

``text_statistics`` counts; ``learn_list`` grows and prunes threshold conjunctions by sequential
covering; ``verdict`` turns the ordered list into one Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlink.llm import kernels as K
from lumenlink.llm.store import hash_sample, keep

#: Labelled rows that a list is learned from, at most (the least by a hash of the id).
MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct_words")
#: Features of the learned rules, as expressions over the counts that hold wherever n_words > 0.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_a_word": "n_symbols / n_words",
    "dup_lines_a_line": "n_dup_lines / n_lines",
    "repeated_share": "n_repeat_words / n_words",
    "capitals_a_char": "n_upper / word_chars",
    "marks_a_word": "n_marks / n_words",
    "digits_a_char": "n_digits / word_chars",
    "distinct_share": "n_distinct_words / n_words",
    "words": "n_words",
    "words_a_line": "n_words / n_lines",
}
_SYMBOL, _UPPER, _MARK, _DIGIT = (np.zeros(256, dtype=bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_MARK[list(b"!?;:\"'()[]{}=+@/\\^~_`")] = True
_DIGIT[48:58] = True


def _per_doc(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag)])
    return sums[offs[1:]] - sums[offs[:-1]]


def count_block(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each document of a block."""
    n = len(offs) - 1
    w = K.Words(buf, offs)
    h = w.hashes()
    tag = K.mix(np.arange(1, n + 1, dtype=np.uint64))  # keeps equal items of different documents apart
    starts = (buf & 0xC0) != 0x80  # the first byte of each code point
    out = {"n_words": np.diff(w.offs), "word_chars": _per_doc(starts & ~K.SEPARATOR[buf], offs)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = _per_doc(table[buf], offs)
    # Lines: between newlines and document bounds.
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    begin = begin[begin < len(buf)]
    doc = np.searchsorted(offs, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(buf)), offs[doc + 1])
    end = np.where((end > begin) & (buf[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(begin) else end
    worded = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    lines, of = K.Rolling(buf).of(begin[worded], end[worded]), doc[worded]
    distinct = np.unique(K.mix(lines) ^ tag[of], return_index=True)[1]
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[distinct], minlength=n)
    first = np.unique(K.mix(h) ^ tag[w.doc], return_index=True)[1]
    out["n_distinct_words"] = np.bincount(w.doc[first], minlength=n)
    # Words in 3-word windows that occur twice or more in the text.
    three = K.grams(h, 3)
    at = np.flatnonzero(w.doc[: len(three)] == w.doc[2:]) if len(three) else np.zeros(0, dtype=np.int64)
    _, which, times = np.unique(K.mix(three[at]) ^ tag[w.doc[at]], return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    marked = np.zeros(len(h), dtype=bool)
    for k in range(3):
        marked[again + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[marked], minlength=n)
    return out


def _statistics(batches):
    for batch in batches:
        for i, j, buf, offs in K.blocks(batch.column(1)):
            got = count_block(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id as ``id``, and COUNTS.  A null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_statistics, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is it at least?, threshold) that rejects."""

    conditions: tuple[tuple[str, bool, float], ...]
    hits: int = field(default=0, compare=False)
    errors: int = field(default=0, compare=False)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, above, at in self.conditions:
            out &= x[name] >= at if above else x[name] <= at
        return out

    def column(self) -> Column:
        parts = [F.expr(FEATURES[name]).cast("double") >= F.lit(at) if above else F.expr(FEATURES[name]).cast("double") <= F.lit(at) for name, above, at in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[tuple[str, bool, float]]:
    """Add the condition with the best information gain until no good row is covered."""
    rule: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (~bad & inside).any():
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        base, best = np.log2(p / (p + n)), (1e-9, None, None)
        for name, v in x.items():
            at = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, cuts)))
            order = np.argsort(v[inside], kind="stable")
            values, wrong = v[inside][order], bad[inside][order]
            total = np.concatenate([[0], np.cumsum(wrong)])
            for above in (True, False):
                cut = np.searchsorted(values, at, side="left" if above else "right")
                p1 = total[-1] - total[cut] if above else total[cut]
                n1 = (len(values) - cut if above else cut) - p1
                gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1) / np.maximum(p1 + n1, 1)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, above, float(at[k])), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return rule


def _prune(rule: list[tuple[str, bool, float]], x: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, bool, float]]:
    """Cut the tail of conditions whose removal does not worsen (p - n) / (p + n) on held-out rows."""
    best, worth = rule, -2.0
    for k in range(len(rule), 0, -1):
        got = Rule(tuple(rule[:k])).covers(x)
        p, n = int((bad & got).sum()), int((~bad & got).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value >= worth:
            best, worth = rule[:k], value
    return best


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3, most_rules: int = 24, most_conditions: int = 4, cuts: int = 48, precision: float = 0.95) -> list[Rule]:
    """Sequential covering: ordered rules that reject, each learned from what the earlier ones leave.

    Two thirds of the rows grow a rule and one third prunes it; a rule enters if at least
    ``precision`` of the rows that it covers in each part are bad, and learning ends with the first
    that does not.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    held = rng.random(len(bad)) < 1 / 3
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules:
        grow, prune = left & ~held, left & held
        if (bad & grow).sum() < 3 or not (~bad & grow).any():
            break
        found = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions, cuts)
        if not found:
            break
        rule = Rule(tuple(_prune(found, {k: v[prune] for k, v in x.items()}, bad[prune])))
        got = rule.covers(x) & left
        fits = all((bad & got & part).sum() >= precision * max(1, (got & part).sum()) for part in (held, ~held) if (got & part).any())
        if not fits or (bad & got).sum() < 3:
            break
        rules.append(Rule(rule.conditions, int((bad & got).sum()), int((~bad & got).sum())))
        left &= ~got
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over COUNTS: is a text with words kept?"""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **how) -> list[Rule]:
    """Learn from the rows of ``text_statistics`` that pass the base rules and have a 0/1 label, one row for each id.  Of several labels of an id the least counts, and so of several rows."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    usable = stats.where(~base_failed()).join(known, "id")  # only labelled rows are told apart
    rows = usable.groupBy("id", "label").agg(F.min(F.struct(*COUNTS)).alias("s")).select("id", "label", "s.*")
    values = [F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]
    table = hash_sample(rows, "id", MAX_LABELLED).select("label", *values).toPandas()
    if not len(table):
        return []
    return learn_list({f: table[f].to_numpy(dtype=float) for f in FEATURES}, table["label"].to_numpy() == 0, **how)


def decision_list(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the first five of COUNTS, base_failed, kept, the other counts.

    kept is false where the base rules fail (fewer than 50 words, or more than half of the words in
    repeated 3-word windows; null and empty texts too) and the learned list's verdict elsewhere.
    Without usable labels the list is empty and everything that passes the base rules is kept.
    """
    stats = keep(text_statistics(docs, id_col, text_col), "statistics")
    rules = fit_rules(stats, labels, id_col)
    failed = base_failed()
    kept = F.when(failed, F.lit(False)).otherwise(verdict(rules))
    return stats.select(F.col("id").alias(id_col), *COUNTS[:5], failed.alias("base_failed"), kept.alias("kept"), *COUNTS[5:])

