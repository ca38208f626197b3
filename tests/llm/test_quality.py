import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavespark.llm import quality, storage, words


def plain(text):
    own = re.findall(words.WORD, text or "")
    windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    n = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(words.WORD, line):
            dup += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab# \n\té🙂\x00", max_size=40), max_size=6))
def test_counts(texts):
    found = quality._measured(pa.array(texts, pa.string()))
    assert [tuple(c[k].as_py() for c in found[:5]) for k in range(len(texts))] == [plain(t) for t in texts]


def corpus():
    clean = [" ".join(f"some{k} words{j}" + "." * (j % 9 == 8) for j in range(60)) for k in range(300)]
    marks = [" ".join(f"w{k}{j}" + "#%&"[j % 3] * 3 for j in range(90)) for k in range(12)]
    shout = [" ".join("BUY!! NOW!! CHEAP!!".split() * 30) for _ in range(9)]
    return clean, marks, shout


def test_junk_goes_and_clean_documents_stay(spark):
    clean, marks, shout = corpus()
    rows = [(k, t) for k, t in enumerate(clean + marks + shout)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = {r["doc_id"]: r for r in quality.judge(storage.table(quality.measures(docs), "m")).collect()}
    assert all(judged[k]["kept"] for k in range(300)) and not any(judged[k]["kept"] for k in range(300, 321))
    assert not judged[305]["base_failed"] and judged[305]["posterior"] < 0.5  # the label model's own verdict
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {k for k, r in judged.items() if r["kept"]}


def test_corpus_without_junk_stays_whole(spark):
    docs = spark.createDataFrame(list(enumerate(corpus()[0])), "doc_id long, text string")
    assert quality.keep_good(docs).count() == 300


def planted(seed, share=0.8, n=60_000):
    """Votes of documents drawn from the model, with its probabilities."""
    rng = np.random.default_rng(seed)
    k = len(quality.RULES)
    b = np.stack([rng.uniform(0.01, 0.1, k), rng.uniform(0.3, 0.7, k)])
    g = np.stack([rng.uniform(0.6, 0.9, k), rng.uniform(0.1, 0.5, k)])
    bad = (rng.random(n) > share).astype(int)
    votes = np.where(rng.random((n, k)) < b[bad], "-", np.where(rng.random((n, k)) < g[bad], "+", "0"))
    return share, b, g, bad, ["".join(v) for v in votes]


@pytest.mark.parametrize(("seed", "share"), [(1, 0.8), (2, 0.95), (3, 0.25)])
def test_planted_probabilities_are_recovered(seed, share):
    share, b, g, bad, votes = planted(seed, share)
    fit = quality.estimate(Counter(votes))
    assert abs(fit.share - share) < 0.01 and np.abs(fit.b - b).max() < 0.03 and np.abs(fit.g - g).max() < 0.04
    assert np.mean([(fit.posterior[v] < 0.5) == x for v, x in zip(votes, bad, strict=True)]) > 0.97
    assert min(np.diff(fit.history)) > -1e-6  # the likelihood never falls
    right = fit.accuracies()
    for k, name in enumerate(quality.RULES):
        marks = np.array([v[k] for v in votes])
        assert abs(right[name]["bad_right"] - bad[marks == "-"].mean()) < 0.05 and abs(right[name]["votes"] - (marks != "0").mean()) < 0.02


def test_posterior_is_bayes_rule():
    rest = "0" * (len(quality.RULES) - 4)
    patterns = {"+00+" + rest: 900, "+--0" + rest: 40, "0--0" + rest: 9, "+00+" + rest[:-1] + "-": 3}
    fit = quality.estimate(patterns)
    rates = fit.rates()
    assert np.allclose(rates.sum(1), 1)
    for p, found in fit.posterior.items():
        like = [fit.share, 1 - fit.share]
        for c in (0, 1):
            for j, v in enumerate(p):
                like[c] *= rates[c, "+-0".index(v), j]
        assert abs(found - like[0] / sum(like)) < 1e-4
    assert fit.posterior["+00+" + rest] > 0.9 and fit.posterior["+--0" + rest] < 0.1
    assert (fit.b[0] <= fit.b[1] + 1e-12).all() and (fit.g[0] >= fit.g[1] - 1e-12).all()


def test_mostly_junk():
    """The share of good documents has no floor, unless one is asked for."""
    rest = "0" * (len(quality.RULES) - 4)
    patterns = {"+00+" + rest: 200, "+--0" + rest: 500, "0--0" + rest: 300}
    free, held = quality.estimate(patterns), quality.estimate(patterns, least_share=0.5)
    assert abs(free.share - 0.2) < 0.02 and not free.bound and held.share == 0.5 and held.bound
    assert free.posterior["+00+" + rest] > 0.9 and free.posterior["+--0" + rest] < 0.1


def test_awkward(awkward, nothing):
    rows = quality.judge(storage.table(quality.measures(awkward), "m")).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"] and by[7]["n_words"] == 60_000
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 10, None}
    assert quality.keep_good(nothing).count() == 0 and quality.judge(quality.measures(nothing)).count() == 0
