"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good, bad or abstains; most rules can only tell one of the two.
Nobody says which rules are right: expectation-maximisation estimates, from how the votes of all documents agree,
how often each rule votes bad, abstains and votes good on good and on bad documents, and how many documents are good. A
document's posterior probability of being good replaces the filter in which every rule must pass.

The model: a document is good with probability ``share``. Given that, rules vote independently: rule r votes bad with
probability b, and where it doesn't, good with probability g, else it abstains. Two constraints tell the classes
apart: no rule votes bad more often on good documents than on bad ones, nor, where it doesn't vote bad, good
more often on bad ones. An estimate that breaks one is replaced by that of all documents together, which is the maximum
under the constraint. So each round raises the likelihood (with the pseudo-documents of PRIOR), and the posterior is Bayes'
rule. ``share`` is estimated like the rest; a least value may be asked for.

Votes are counted by pattern in Spark. There are at most 3 ** len(RULES) patterns, whatever the input, and only
those that occur go to the driver and come back as a small table to join.

Defined results: a null text is an empty text; it has no words and fails the base rules. Rows are judged one by
one, so repeated rows get equal results and extra columns don't matter. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespark.llm.words import NEWLINE, Chunk, chunks, pair, span_hashes

#: measure; the rule votes good inside the first bounds, bad outside the second, and else abstains
RULES = {
    "length": ("n_words", (80, math.inf), (10, math.inf)),
    "symbols": ("symbols_per_word", None, (0, 0.25)),
    "symbol_words": ("symbol_word_share", None, (0, 0.2)),
    "letters": ("letter_share", (0.93, 1), (0.75, 1)),
    "lone_marks": ("lone_mark_share", None, (0, 0.2)),
    "dup_lines": ("dup_line_share", None, (0, 0.4)),
    "repeats": ("repeat_share", None, (0, 0.4)),
    "capitals": ("capital_share", None, (0, 0.7)),
    "endings": ("ending_share", (0.03, 0.3), (0, 0.7)),
    "word_length": ("mean_word", (3, 9), (1.5, 25)),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_POSTERIOR = 0.5
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _ENDING = _flags("#*$%&|<>"), _flags(".!?")
_UPPER, _LOWER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("abcdefghijklmnopqrstuvwxyz")
_CHAR = (np.arange(256) & 0xC0) != 0x80
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 0xC0)  # a character outside ASCII counts as a letter
_SOLID = _LETTER | _flags("0123456789")


def _measure(c: Chunk) -> dict[str, np.ndarray]:
    row_of_word = np.repeat(np.arange(c.rows), c.n_words)
    out = {"n_words": c.n_words, "word_chars": c.row_sums(_CHAR[c.buf] & c.inside), "n_symbols": c.row_sums(_SYMBOL[c.buf])}

    text = c.buf != NEWLINE
    starts, ends = c.spans(text)
    has = np.searchsorted(c.starts, starts) < np.searchsorted(c.starts, ends)  # lines with a word
    lines = np.stack([starts[has], ends[has]], 1)
    row = np.searchsorted(c.at, lines[:, 0], "right") - 1
    key = pair(span_hashes(c.buf, lines[:, 0], lines[:, 1]), row.astype(np.uint64))
    n_lines = np.bincount(row, minlength=c.rows)
    distinct = np.bincount(row[np.unique(key, return_index=True)[1]], minlength=c.rows)
    out["n_dup_lines"] = n_lines - distinct

    pos, w = c.windows(c.hashes(), 3)
    key = pair(w, row_of_word[pos].astype(np.uint64))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    found = pos[n[inverse] > 1] if len(key) else pos
    again = np.zeros(len(c.starts), bool)
    for k in range(3):
        again[found + k] = True
    out["n_repeat_words"] = np.bincount(row_of_word, weights=again, minlength=c.rows).astype(np.int64)

    some, chars = np.maximum(c.n_words, 1), np.maximum(out["word_chars"], 1)
    upper, letters = c.row_sums(_UPPER[c.buf]), c.row_sums((_UPPER | _LOWER)[c.buf])
    by_word = lambda flag: np.bincount(row_of_word, weights=flag, minlength=c.rows) / some
    out |= {
        "symbols_per_word": out["n_symbols"] / some, "symbol_word_share": by_word(c.word_sums(_SYMBOL[c.buf]) > 0), "letter_share": c.row_sums(_LETTER[c.buf]) / chars,
        "lone_mark_share": by_word(c.word_sums(_SOLID[c.buf]) == 0), "dup_line_share": out["n_dup_lines"] / np.maximum(n_lines, 1), "repeat_share": out["n_repeat_words"] / some,
        "capital_share": upper / np.maximum(letters, 1), "ending_share": by_word(_ENDING[c.buf[c.ends - 1]]), "mean_word": out["word_chars"] / some,
    }
    return out


def _votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """A character for each rule and row: + good, - bad, 0 abstains. Rows without words get no vote but length's."""
    marks = []
    for what, good, fair in RULES.values():
        x = m[what]
        mark = np.where((x < fair[0]) | (x > fair[1]), "-", np.where((x >= good[0]) & (x <= good[1]), "+", "0") if good else "0")
        marks.append(mark if what == "n_words" else np.where(m["n_words"] == 0, "0", mark))
    return np.array(["".join(x) for x in zip(*marks, strict=True)], dtype=object)


def _measured(texts: pa.Array) -> list[pa.Array]:
    parts = [(m := _measure(c), _votes(m)) for c in chunks(texts)]
    return [pa.array(np.concatenate([m[k] for m, _ in parts] or [[]]), pa.int64()) for k in _COUNTS] + [pa.array(np.concatenate([v for _, v in parts] or [np.empty(0, object)]), pa.string())]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, and ``votes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_measured(b.column(1))], ["doc_id", *_COUNTS, "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in _COUNTS)}, votes string")


class Fit(NamedTuple):
    """share of good documents; b and g by class (0 good, 1 bad) and rule; posterior by pattern; log likelihood (with the
    pseudo-documents) after each round; was the least share asked for reached."""

    share: float
    b: np.ndarray
    g: np.ndarray
    posterior: dict[str, float]
    history: list[float]
    bound: bool

    def rates(self) -> np.ndarray:
        """Probability by class, vote (good, bad, abstain) and rule."""
        return np.stack([(1 - self.b) * self.g, self.b, (1 - self.b) * (1 - self.g)], 1)

    def accuracies(self) -> dict[str, dict[str, float]]:
        """Of each rule: how often it votes, and how often its votes are right (None if it never votes)."""
        joint = self.rates() * np.array([self.share, 1 - self.share])[:, None, None]
        out = {}
        for k, name in enumerate(RULES):
            votes = joint[:, :2, k].sum()
            out[name] = {"votes": float(votes), "right": float((joint[0, 0, k] + joint[1, 1, k]) / votes), "good_right": float(joint[0, 0, k] / joint[:, 0, k].sum()), "bad_right": float(joint[1, 1, k] / joint[:, 1, k].sum())}
        return out


#: pseudo-documents of each class, and how often these vote bad, and good where they don't
PRIOR, PRIOR_B, PRIOR_G = 2.0, np.array([0.02, 0.5]), np.array([0.6, 0.4])


def estimate(patterns: dict[str, int], rounds: int = 500, least_share: float | None = None) -> Fit:
    """Fit the model to patterns and their numbers."""
    keys = sorted(patterns)
    rules = len(keys[0]) if keys else len(RULES)
    n = np.array([patterns[k] for k in keys], float)
    marks = np.array([list(k) for k in keys], dtype="U1").reshape(len(keys), rules)
    bad, good, none = (marks == v for v in "-+0")
    b, g = (np.repeat(x[:, None], rules, 1) for x in (PRIOR_B, PRIOR_G))
    share, post, history, bound = 0.9, np.ones(len(keys)), [], False
    for _ in range(rounds if keys else 0):
        like = [math.log(p) + bad @ np.log(b[c]) + good @ np.log((1 - b[c]) * g[c]) + none @ np.log((1 - b[c]) * (1 - g[c])) for c, p in ((0, share), (1, 1 - share))]
        post = 1 / (1 + np.exp(np.clip(like[1] - like[0], -700, 700)))
        prior = PRIOR * sum((PRIOR_B[c] * np.log(b[c]) + (1 - PRIOR_B[c]) * (np.log(1 - b[c]) + PRIOR_G[c] * np.log(g[c]) + (1 - PRIOR_G[c]) * np.log(1 - g[c]))).sum() for c in (0, 1))
        history.append(float(n @ np.logaddexp(*like) + prior + PRIOR * (math.log(share) + math.log(1 - share))))
        if len(history) > 1 and history[-1] - history[-2] < 1e-9 * abs(history[-1]) and len(history) > 20:
            break
        w = np.stack([n * post, n * (1 - post)])
        share = (w[0].sum() + PRIOR) / (n.sum() + 2 * PRIOR)
        if bound := least_share is not None and share < least_share:
            share = least_share
        of_b, all_b = w @ bad + PRIOR * PRIOR_B[:, None], w.sum(1, keepdims=True) + PRIOR
        of_g, all_g = w @ good + PRIOR * ((1 - PRIOR_B) * PRIOR_G)[:, None], w @ ~bad + PRIOR * (1 - PRIOR_B)[:, None]
        b, g = of_b / all_b, of_g / all_g
        b = np.where(b[0] > b[1], of_b.sum(0) / all_b.sum(), b)
        g = np.where(g[0] < g[1], of_g.sum(0) / all_g.sum(0), g)
    return Fit(float(share), b, g, {k: round(float(x), 9) for k, x in zip(keys, post, strict=True)}, history, bound)


def fit(votes: DataFrame, least_share: float | None = None) -> Fit:
    """Of all rows of ``votes``."""
    counted = votes.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    return estimate({r["votes"]: r["count"] for r in counted}, least_share=least_share)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, least_share: float | None = None) -> DataFrame:
    """Add base_failed, kept and posterior to a table made by ``measures``. ``measured`` is read twice."""
    posterior = fit(measured, least_share).posterior
    table = measured.sparkSession.createDataFrame(sorted(posterior.items()), "votes string, posterior double")
    rows = measured.join(F.broadcast(table), "votes")  # 3 ** len(RULES) rows at most
    return rows.select(*measured.columns, base_failed().alias("base_failed"), "posterior", (~base_failed() & (F.col("posterior") >= MIN_POSTERIOR)).alias("kept"))


def keep_good(docs: DataFrame, least_share: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is kept. Texts are measured twice, which costs
    less than carrying them through a join."""
    posterior = fit(measures(docs), least_share).posterior
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *counts, votes = _measured(b.column(b.schema.get_field_index("text")))
            n, repeats = counts[0].to_numpy(), counts[4].to_numpy()
            ok = (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n) & (np.array([posterior[v] for v in votes.to_pylist()]) >= MIN_POSTERIOR)
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, schema)
